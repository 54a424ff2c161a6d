"""The Spark data source "git": partitions by repository and reference, filters pushed into the walk, a chain of levels in one scan.

    spark.dataSource.register(GitDataSource)
    spark.read.format("git").option("path", ...).option("table", "commits").load()

Options: path, table (one of the five levels), format (standard or bare), tip_only (only the newest commit of each
reference is walked, at any level), skip_read_errors, splits (partitions that the references of one repository are dealt to), parents (levels
above whose rows come along as structs __LEVEL, so that a chain with conditions on several levels is one scan), with_path (blobs also
have their path). Pushed filters narrow the walk where they name a level's own keys, of the table or of a parent; Spark applies every filter again, so a
pushed one can only save work. References of one tip share its walk. An error ends what it belongs to: a reference's log, a commit's tree.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import LEVELS, schema as table_schema
from .discovery import check_format, discover, git_dir_of
from .repository import Repository, RepositoryError

#: Rows and bytes in a batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: The columns by which a scan can skip work, for each table.
KEYS = {
    "repositories": ("id",),
    "references": ("repository_id", "name"),
    "commits": ("repository_id", "reference_name", "hash", "index"),
    "tree_entries": ("repository_id", "reference_name", "commit_hash", "path", "blob"),
    "blobs": ("repository_id", "reference_name", "commit_hash", "blob_id"),
}
#: Tasks that the contents of one repository are dealt to.
READERS = 8


def _log(e: Exception) -> None:
    logging.getLogger(__name__).warning("skipped: %s", e)


@dataclass
class RepositoryPartition(InputPartition):
    path: str
    git_dir: str
    part: int = 0
    parts: int = 1

    def __post_init__(self) -> None:
        super().__init__((self.path, self.git_dir, self.part))


@dataclass
class Wanted:
    """Values that pushed filters leave for a level's column, where one without an entry takes all, and how many commits of a log they reach."""

    values: dict[tuple[str, str], frozenset] = field(default_factory=dict)
    most: int | None = None

    def narrow(self, level: str, column: str, values: frozenset) -> None:
        key = (level, column)
        self.values[key] = self.values[key] & values if key in self.values else values
        if key == ("commits", "index"):
            self.reach(max((x for x in values if isinstance(x, int)), default=-1) + 1)

    def reach(self, most: int) -> None:
        self.most = max(0, most if self.most is None else min(self.most, most))

    def takes(self, level: str, row: dict[str, Any]) -> bool:
        return all(row.get(c) in values for (of, c), values in self.values.items() if of == level and c in row)


class GitReader(DataSourceReader):
    def __init__(self, table: str, options: dict[str, str], kind: StructType):
        flag = lambda name: options.get(name, "false").lower() == "true"
        self.table, self.kind = table, to_arrow_schema(kind)
        self.path, self.format = options["path"], check_format(options.get("format", "standard"))
        self.skip_errors, self.with_path = flag("skip_read_errors"), flag("with_path")
        self.parents, self.splits = parents_of(options), int(options.get("splits", "1"))
        self.wanted = Wanted(most=1 if flag("tip_only") else None)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            *above, name = getattr(f, "attribute", None) or ("",)
            level = above[0].removeprefix("__") if len(above) == 1 else self.table if not above else ""
            if name in KEYS.get(level, ()):
                if isinstance(f, EqualTo | EqualNullSafe):
                    self.wanted.narrow(level, name, frozenset([f.value]))
                elif isinstance(f, In):
                    self.wanted.narrow(level, name, frozenset(f.value))
                elif isinstance(f, LessThan | LessThanOrEqual) and (level, name) == ("commits", "index"):
                    self.wanted.reach(int(f.value) + isinstance(f, LessThanOrEqual))
            yield f

    def partitions(self) -> list[InputPartition]:
        parts = 1 if self.table == "repositories" else self.splits
        return [RepositoryPartition(path, git_dir, k, parts) for path, git_dir in discover(self.path, self.format) for k in range(parts)]

    def read(self, partition: RepositoryPartition) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        size = 0
        for row in self._safely(self._rows(partition)):
            held.append(row)
            size += len(row.get("content") or b"") + 200
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=self.kind)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=self.kind)

    def _safely(self, rows: Iterator[Any]) -> Iterator[Any]:
        """Rows up to an error, which ends them quietly if errors are to be skipped."""
        try:
            yield from rows
        except (RepositoryError, OSError, ValueError) as e:
            if not self.skip_errors:
                raise
            _log(e)

    def _rows(self, partition: RepositoryPartition) -> Iterator[dict[str, Any]]:
        takes = self.wanted.takes
        with Repository(partition.path, partition.git_dir) as repository:
            references = repository.references()
            repositories = repository.repositories(references)
            if self.table == "repositories":
                yield from (r for r in repositories.values() if takes("repositories", r))
                return
            tips: dict[str, list[dict[str, Any]]] = {}
            for k, r in enumerate(references):
                if k % partition.parts == partition.part and takes("references", r) and takes("repositories", repositories[r["repository_id"]]):
                    key = {"repository_id": r["repository_id"], "reference_name": r["name"]}
                    if all(takes(level, key) for level in (self.table, *self.parents) if level in ("commits", "tree_entries", "blobs")):
                        tips.setdefault(r["hash"], []).append(r)
            above = lambda r: {"__repositories": repositories[r["repository_id"]], "__references": r}
            if self.table == "references":
                yield from (r | above(r) for own in tips.values() for r in own)
                return
            for tip, own in tips.items():
                yield from self._safely(self._walked(repository, tip, own, above))

    def _walked(self, repository: Repository, tip: str, references: list[dict[str, Any]], above: Any) -> Iterator[dict[str, Any]]:
        takes = self.wanted.takes
        for index, commit in enumerate(repository.log(tip, self.wanted.most)):
            commits = [commit | {"index": index, "repository_id": r["repository_id"], "reference_name": r["name"]} | above(r) for r in references]
            commits = [c for c in commits if takes("commits", c)]
            if self.table == "commits":
                yield from commits
                continue
            keys = [{"commit_hash": c["hash"], "repository_id": c["repository_id"], "reference_name": c["reference_name"]} for c in commits]
            keys = [(k, {x: c[x] for x in ("__repositories", "__references")} | {"__commits": c}) for k, c in zip(keys, commits, strict=True) if takes(self.table, k)]
            if keys:
                yield from self._safely(self._below(repository, commit["hash"], keys))

    def _below(self, repository: Repository, commit: str, keys: list[tuple[dict[str, Any], dict[str, Any]]]) -> Iterator[dict[str, Any]]:
        takes = self.wanted.takes
        for path, hash_ in repository.entries(commit):
            own = {"path": path, "blob": hash_}
            if not takes("tree_entries", own):
                continue
            if self.table == "tree_entries":
                yield from (k | own | parents for k, parents in keys)
            elif takes("blobs", {"blob_id": hash_}) and (blob := repository.blob(hash_)):
                yield from (k | blob | {"blob_id": hash_, "path": path, "__tree_entries": k | own} | parents for k, parents in keys)


def parents_of(options: dict[str, str]) -> list[str]:
    return [p for p in options.get("parents", "").split(",") if p]


class GitDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def _table(self) -> str:
        table = self.options.get("table")
        if table not in LEVELS:
            raise ValueError(f"option table is required, one of {', '.join(LEVELS)}; it is {table!r}")
        return table

    def schema(self) -> StructType:
        fields = list(table_schema(self._table()).fields)
        if self._table() == "blobs" and self.options.get("with_path", "false").lower() == "true":
            fields.append(StructField("path", StringType()))
        above = LEVELS[: list(LEVELS).index(self._table())]
        for p in parents_of(dict(self.options)):
            if p not in above:
                raise ValueError(f"{p} is no level above {self._table()}")
            fields.append(StructField(f"__{p}", table_schema(p)))
        return StructType(fields)

    def reader(self, schema: StructType) -> GitReader:
        if "path" not in self.options:
            raise ValueError("option path is required")
        return GitReader(self._table(), dict(self.options), self.schema())


def contents(located: DataFrame, fmt: str, skip_errors: bool) -> DataFrame:
    """(blob_id, content, is_binary) of the blobs (repository_path, blob) that exist, each read once, in the repositories themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, repository, held, size = None, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.string(), pa.binary(), pa.bool_()), strict=True)], names=["blob_id", "content", "is_binary"])

        try:
            for batch in batches:
                for path, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    try:
                        if path != at:
                            if repository:
                                repository.__exit__()
                            at, repository = path, None
                            git_dir = git_dir_of(path, fmt)
                            if git_dir is None:
                                raise RepositoryError(path, [], "no repository is there")
                            repository = Repository(path, git_dir)
                        found = repository and repository.blob(blob)
                    except (RepositoryError, OSError, ValueError) as e:
                        if not skip_errors:
                            raise
                        _log(e)
                        continue
                    if found:
                        held.append((blob, found["content"], found["is_binary"]))
                        size += len(found["content"]) + 200
                    if size >= BATCH_BYTES:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()
        finally:
            if repository:
                repository.__exit__()

    dealt = located.repartition("repository_path", F.pmod(F.xxhash64("blob"), F.lit(READERS))).sortWithinPartitions("repository_path", "blob")
    return dealt.mapInArrow(run, "blob_id string, content binary, is_binary boolean").dropDuplicates(["blob_id"])


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitDataSource)
