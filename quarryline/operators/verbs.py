"""The verbs that lead from one level to the next, as plain functions of DataFrames.

All are equi-joins on the whole key of a level, so Catalyst chooses their strategy, pushes filters through them and prunes
columns at the scans. A parent only restricts its children: a left semi join, which returns each child once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADS = ("refs/heads/HEAD", "HEAD")
MASTER = "refs/heads/master"


def require(df: DataFrame, verb: str, *columns: str) -> None:
    """Raise unless df has all the columns that a verb needs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{verb} can not be applied: the frame lacks {', '.join(missing)}")


def references_of(repositories: DataFrame, references: DataFrame) -> DataFrame:
    require(repositories, "references", "id")
    parent = repositories.select(F.col("id").alias("repository_id")).distinct()
    return references.join(parent, "repository_id", "left_semi").select(*references.columns)


def commits_of(references: DataFrame, commits: DataFrame, tip_only: bool = True) -> DataFrame:
    """Commits of the references; the newest of each, or all."""
    require(references, "commits", "repository_id", "name")
    own = commits.filter("index = 0") if tip_only else commits
    parent = references.select("repository_id", F.col("name").alias("reference_name")).distinct()
    return own.join(parent, ["repository_id", "reference_name"], "left_semi").select(*commits.columns)


def tree_entries_of(commits: DataFrame, tree_entries: DataFrame) -> DataFrame:
    require(commits, "tree_entries", "repository_id", "reference_name", "hash")
    parent = commits.select("repository_id", "reference_name", F.col("hash").alias("commit_hash")).distinct()
    return tree_entries.join(parent, ["repository_id", "reference_name", "commit_hash"], "left_semi").select(*tree_entries.columns)


def with_contents(tree_entries: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per tree entry whose content exists, with its path. contents: (blob_id, content, is_binary), one row a blob."""
    joined = tree_entries.join(contents.select("blob_id", "content", "is_binary"), F.col("blob") == F.col("blob_id"))
    return joined.select("blob_id", "commit_hash", "repository_id", "reference_name", "content", "is_binary", "path")


def blobs_of(tree_entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """with_contents from a table of blobs that may have several rows a blob."""
    require(tree_entries, "blobs", "commit_hash", "repository_id", "reference_name", "path", "blob")
    return with_contents(tree_entries, blobs.select("blob_id", "content", "is_binary").dropDuplicates(["blob_id"]))


def reference_named(df: DataFrame, *names: str) -> DataFrame:
    """Rows of the references of these names, at any level that knows its reference."""
    column = next((c for c in ("reference_name", "name") if c in df.columns), None)
    if column is None:
        raise ValueError("the frame has neither reference_name nor name")
    return df.filter(F.col(column).isin(*names))


def heads(df: DataFrame) -> DataFrame:
    return reference_named(df, *HEADS)


def masters(df: DataFrame) -> DataFrame:
    return reference_named(df, MASTER)


def remote(references: DataFrame) -> DataFrame:
    require(references, "remote_references", "is_remote")
    return references.filter("is_remote")
