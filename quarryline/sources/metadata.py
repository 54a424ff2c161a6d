"""Snapshots of the metadata as Parquet: written once from the repositories, then read by ordinary scans and joins.

commits keep no reference columns and tree_entries no repository columns, each row once; repository_has_commits links commits
with references, and reading joins them back. Every table can be read alone. A snapshot is written to a folder of its own and
becomes the current one by the rename of a small file, so that readers see either all of the old tables or all of the new ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import SCHEMAS

TABLES = ("repositories", "references", "commits", "repository_has_commits", "tree_entries")
#: The column by which a table's files are sorted, so that filters on it skip row groups.
SORTED = {"repositories": "id", "references": "repository_id", "commits": "hash", "repository_has_commits": "repository_id", "tree_entries": "commit_hash"}
#: Paths and hashes hardly repeat, so that a faster codec leaves much more of them.
COMPRESSION = "zstd"
#: The file that names the current snapshot's folder.
CURRENT = "CURRENT"


def _files(spark: SparkSession, root: str) -> tuple[Any, Callable[[str], Any]]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = lambda name: path(f"{root}/{name}")
    return at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _current(spark: SparkSession, root: str) -> str | None:
    fs, at = _files(spark, root)
    if not fs.exists(at(CURRENT)):
        return None
    stream = fs.open(at(CURRENT))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _once(rows: DataFrame) -> DataFrame:
    """Distinct rows by the order in which they are written next: one sort in place of two hash tables of all rows and a sort."""
    same = Window.partitionBy(*rows.columns).orderBy(rows.columns[0])
    return rows.withColumn("copy", F.row_number().over(same)).filter("copy = 1").drop("copy")


def save(spark: SparkSession, table: Callable[[str], DataFrame], path: str, name: str = "metadata") -> str:
    """Write the five tables as the current snapshot below path/name, in place of the one before; the folder written to."""
    root, folder = f"{path.rstrip('/')}/{name}", f"snapshot-{uuid.uuid4().hex}"
    fs, at = _files(spark, root)
    target = f"{root}/{folder}"
    table("commits").write.parquet(f"{target}/walked", compression=COMPRESSION)  # the repositories' logs are walked once for both tables
    commits = spark.read.parquet(f"{target}/walked")
    frames = {
        "repositories": table("repositories"),
        "references": table("references"),
        "commits": commits.drop("repository_id", "reference_name", "index").dropDuplicates(["hash"]),
        "repository_has_commits": commits.select("hash", "reference_name", "repository_id", "index"),
        "tree_entries": _once(table("tree_entries").select("commit_hash", "path", "blob")),
    }
    for key in TABLES:
        frames[key].sortWithinPartitions(SORTED[key]).write.parquet(f"{target}/{key}", compression=COMPRESSION)
    fs.delete(at(f"{folder}/walked"), True)

    before, draft = _current(spark, root), f".{CURRENT}-{uuid.uuid4().hex}"
    stream = fs.create(at(draft), False)
    try:
        stream.write(bytearray(folder.encode()))
    finally:
        stream.close()
    if before:
        fs.delete(at(CURRENT), False)
    fs.rename(at(draft), at(CURRENT))
    if before:
        fs.delete(at(before), True)
    return target


def load(spark: SparkSession, path: str, name: str = "metadata") -> dict[str, DataFrame]:
    """The first four levels of the current snapshot in their full schemas."""
    root = f"{path.rstrip('/')}/{name}"
    folder = _current(spark, root)
    if folder is None:
        raise ValueError(f"{root} holds no snapshot")
    read = lambda key: spark.read.parquet(f"{root}/{folder}/{key}")
    links = read("repository_has_commits")
    columns = lambda key: [F.col(f"`{c}`") for c in SCHEMAS[key].names]
    places = links.select(F.col("hash").alias("commit_hash"), "repository_id", "reference_name").repartition("commit_hash").distinct()  # moved once, for the distinct and the join
    entries = read("tree_entries").join(places, "commit_hash")
    return {
        "repositories": read("repositories").select(*columns("repositories")),
        "references": read("references").select(*columns("references")),
        "commits": links.join(read("commits"), "hash").select(*columns("commits")),
        "tree_entries": entries.select(*columns("tree_entries")),
    }
