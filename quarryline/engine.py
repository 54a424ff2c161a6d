"""The entry point: repositories below a path as five tables, five views and a chain of typed frames."""

from __future__ import annotations

import os
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions
from .operators import verbs
from .operators.frames import BlobsFrame, Chain, RepositoriesFrame
from .schemas import LEVELS
from .sources import git, metadata
from .sources.discovery import check_format


#: The keys of the session's configuration that stand in for arguments, as text.
CONF = {"skip_cleanup": "quarryline.cleanup.skip", "skip_read_errors": "quarryline.read.errors.skip", "fmt": "quarryline.repository.format", "splits": "quarryline.repository.splits"}


class Engine:
    """path: a folder of repositories, reached alike from the driver and the executors; fmt: standard or bare; splits: partitions for each repository.

    Arguments that aren't given come from the session's configuration (CONF), or else are standard, False and 1.
    """

    def __init__(self, spark: SparkSession, path: str, fmt: str | None = None, skip_cleanup: bool | None = None, skip_read_errors: bool | None = None, splits: int | None = None):
        conf = lambda name, given, least: spark.conf.get(CONF[name], least) if given is None else str(given)
        self.spark, self.path, self.format = spark, path, check_format(conf("fmt", fmt, "standard"))
        self._skip_cleanup, self._skip_read_errors = (conf(n, x, "false").lower() == "true" for n, x in (("skip_cleanup", skip_cleanup), ("skip_read_errors", skip_read_errors)))
        self.splits = int(conf("splits", splits, "1"))
        self._metadata: dict[str, DataFrame] = {}
        git.register(spark)
        functions.register(spark)
        self._views()

    def _git(self, table: str, tip_only: bool = False, **options: Any) -> DataFrame:
        given = {"path": self.path, "table": table, "format": self.format, "tip_only": tip_only, "skip_read_errors": self._skip_read_errors, "splits": self.splits} | options
        return self.spark.read.format("git").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in given.items()}).load()

    def table(self, name: str, tip_only: bool = False) -> DataFrame:
        """A level from the current backend; tip_only spares a Git scan the older commits."""
        if name not in LEVELS:
            raise ValueError(f"table {name!r} is not supported; there are {', '.join(LEVELS)}")
        return self._metadata[name] if name in self._metadata else self._git(name, tip_only)

    def chained(self, chain: Chain) -> DataFrame | None:
        """The last level of a chain in one scan, its conditions on the levels above pushed into the walk; None if the backend or a condition doesn't allow it."""
        if self._metadata:
            return None
        *above, (level, _) = chain.levels
        parents = [(p, conditions) for p, conditions in above if conditions]
        scan = self._git(level, chain.tip_only, parents=",".join(p for p, _ in parents), with_path=level == "blobs")
        columns = [F.col(f"`{c}`") for c in scan.columns if not c.startswith("__")]
        try:
            for parent, conditions in parents:
                view = scan.select(F.col(f"`__{parent}`.*"), F.struct(*(F.col(f"`{c}`") for c in scan.columns)).alias("__row"))
                for condition in conditions:
                    view = view.filter(condition)
                scan = view.select("__row.*")
            if level == "commits" and chain.tip_only:
                scan = scan.filter("index = 0")
            return scan.select(*columns)
        except AnalysisException:  # a condition bound to another frame
            return None

    def contents(self, tree_entries: DataFrame) -> DataFrame:
        """Blobs of tree entries: the distinct ones are read from their repositories, whatever the entries come from."""
        verbs.require(tree_entries, "blobs", "commit_hash", "repository_id", "reference_name", "path", "blob")
        places = self.table("repositories").select(F.col("id").alias("repository_id"), "repository_path").distinct()
        located = tree_entries.select("repository_id", "blob").distinct().join(places, "repository_id").select("repository_path", "blob").distinct()
        return verbs.with_contents(tree_entries, git.contents(located, self.format, self._skip_read_errors))

    def _views(self) -> None:
        for level in LEVELS:
            self.table(level).createOrReplaceTempView(level)

    def _set(self, **values: Any) -> Engine:
        for name, value in values.items():
            setattr(self, name, value)
        self._views()
        return self

    def set_repositories_path(self, path: str) -> Engine:
        return self._set(path=path)

    def set_repositories_format(self, fmt: str) -> Engine:
        return self._set(format=check_format(fmt))

    def skip_cleanup(self, skip: bool) -> Engine:
        """Kept for its callers: repositories are read in place, so nothing is left to clean up."""
        return self._set(_skip_cleanup=skip)

    def skip_read_errors(self, skip: bool) -> Engine:
        return self._set(_skip_read_errors=skip)

    @property
    def repositories(self) -> RepositoriesFrame:
        return RepositoriesFrame(self.table("repositories"), self, Chain(((LEVELS[0], ()),)))

    def blobs(self, repository_ids: list[str] | None = None, reference_names: list[str] | None = None, commit_hashes: list[str] | None = None) -> BlobsFrame:
        """Blobs of the given repositories, references and commits; of the newest commits unless commits are given."""
        for what, given in (("repository_ids", repository_ids), ("reference_names", reference_names), ("commit_hashes", commit_hashes)):
            if given is not None and not isinstance(given, list):
                raise TypeError(f"{what} must be a list")
        repositories = self.repositories
        if repository_ids:
            repositories = repositories.filter(F.col("id").isin(repository_ids))
        references = repositories.references
        if repository_ids:
            references = references.filter(F.col("repository_id").isin(repository_ids))
        if reference_names:
            references = references.filter(F.col("name").isin(reference_names))
        if commit_hashes:
            return references.all_reference_commits.filter(F.col("hash").isin(commit_hashes)).blobs
        return references.blobs

    def save_metadata(self, path: str, name: str = "metadata") -> str:
        """Write all metadata (of all commits) as Parquet below an existing folder."""
        if "://" not in path and not os.path.isdir(path):
            raise ValueError(f"{path} is no folder")
        return metadata.save(self.spark, self._git, path, name)

    def from_metadata(self, path: str, name: str = "metadata") -> Engine:
        """Take all levels but blobs from a snapshot."""
        return self._set(_metadata=metadata.load(self.spark, path, name))

    def from_repositories(self) -> Engine:
        return self._set(_metadata={})

    @property
    def active_executors(self) -> int:
        return 1 if self.spark.sparkContext.master.startswith("local") else self.spark.sparkContext.defaultParallelism
