"""Shards by size-tiered compaction under a versioned manifest.

A store is a folder with immutable Parquet shards in data/, lists of each run's shards in runs/ and manifests in manifest/. An append writes
one run of small shards and commits a manifest that names it. Compaction sorts runs into tiers by size, each tier `ratio` times the one
below, and merges any `fan_in` runs of one tier: their small files become files of about the target size, files that are large
enough already are listed anew and not rewritten. So a row is rewritten at most once a tier, and no more once its file has the target's size.
A reader keeps the version that it opened.

A commit writes its manifest under a temporary name and renames it to the next version's number; a rename never replaces
a file, so of two writers one wins and the other takes the new version into account and tries again. Shards of a lost
or repeated task are never listed. Merging neither shuffles nor sorts: a task reads the small files and writes a large one.
A manifest has one entry per run, whose number grows with the logarithm of the table; a run's list has one entry per file, never rows.
Every merge is checked against the rows of what it merged. A writer marks its folder in pending/ until it has committed, and
vacuum spares marked folders, unless the mark is older than `abandoned` seconds.

Defined results: rows are kept whole, nulls, repeats and all columns included; an arrival without rows commits a run without
rows; a store whose versions hold no rows reads as an empty table of their columns; a store without a version raises; columns must agree by name
and type with the first arrival's, in any order, or the append raises; any column name is a column like others.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ShardStore:
    """A table of shards below path, which every executor and the driver can reach."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 64 << 20, fan_in: int = 4, ratio: int = 4, smallest: int = 1 << 20, abandoned: int = 86_400):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fan_in, self.ratio, self.smallest, self.abandoned = target_bytes, fan_in, ratio, smallest, abandoned
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- small files

    def _list(self, folder: str) -> list[tuple[str, int]]:
        """(name, bytes) of what a folder below the store holds."""
        at = self._path(f"{self.path}/{folder}")
        return sorted((x.getPath().getName(), x.getLen()) for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _write(self, name: str, body: dict) -> None:
        stream = self._fs.create(self._path(f"{self.path}/{name}"), False)
        try:
            stream.write(bytearray(json.dumps(body).encode()))
        finally:
            stream.close()

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    # --- versions

    def version(self) -> int:
        """The newest committed version, 0 before the first."""
        return max((int(name[1:-5]) for name, _ in self._list("manifest") if name.startswith("v")), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return self._load(f"manifest/v{version:08d}.json") if version else {"version": 0, "schema": None, "runs": []}

    def runs(self, version: int | None = None) -> list[dict]:
        """The runs of a version: id, rows, bytes and number of files."""
        return self._manifest(version)["runs"]

    def files(self, run: dict) -> list[list]:
        """(path below data/, bytes, rows) of a run's files."""
        return self._load(f"runs/{run['id']}.json")["files"]

    def _commit(self, change: Callable[[list[dict]], list[dict]], schema: StructType | None = None) -> int:
        """Apply change to the newest runs and publish the result as the next version, however many writers there are."""
        while True:
            now = self._manifest()
            own = now["schema"]
            if schema is not None:
                fields = sorted((f.name, f.dataType.simpleString()) for f in schema.fields)
                if own is not None and fields != sorted((f.name, f.dataType.simpleString()) for f in StructType.fromJson(own).fields):
                    raise ValueError(f"the arrival's columns {fields} are not those of {self.path}")
                own = own or schema.jsonValue()
            draft, final = (f"manifest/{x}" for x in (f".draft-{uuid.uuid4().hex}", f"v{now['version'] + 1:08d}.json"))
            self._write(draft, {"version": now["version"] + 1, "schema": own, "runs": change(now["runs"])})
            paths = [self._path(f"{self.path}/{x}") for x in (draft, final)]
            if not self._fs.exists(paths[1]) and self._fs.rename(*paths):
                return now["version"] + 1
            self._delete(draft)

    # --- writing

    def _written(self, rows: DataFrame, by: str | None = None) -> tuple[str, list[list]]:
        """Write rows to a folder of their own, marked as pending; (folder, files with bytes and rows)."""
        folder = uuid.uuid4().hex
        self._write(f"pending/{folder}", {})
        writer = rows.write.partitionBy(by) if by else rows.write
        writer.parquet(f"{self.path}/data/{folder}")
        return folder, self._counted(folder)

    def _counted(self, folder: str) -> list[list]:
        sizes = {}
        for name, size in self._list(f"data/{folder}"):
            below = self._list(f"data/{folder}/{name}") if "=" in name else [("", size)]
            sizes |= {f"{folder}/{name}/{x}".rstrip("/"): n for x, n in below if (x or name).endswith(".parquet")}
        if not sizes:
            return []
        at = self.spark.read.parquet(*(f"{self.path}/data/{f}" for f in sizes)).groupBy(F.input_file_name().alias("at")).agg(F.count(F.lit(1)).alias("n"))  # from the files' footers
        rows = {unquote(r["at"])[unquote(r["at"]).index(folder) :]: r["n"] for r in at.collect()}
        return [[f, size, rows.get(f, 0)] for f, size in sorted(sizes.items())]

    def _run(self, files: list[list]) -> dict:
        own = uuid.uuid4().hex
        self._write(f"runs/{own}.json", {"files": files})
        return {"id": own, "files": len(files), "bytes": sum(f[1] for f in files), "rows": sum(f[2] for f in files)}

    def append(self, arrival: DataFrame) -> int:
        """Write one arrival as a run of small shards; the version that holds it."""
        folder, files = self._written(arrival)
        run = self._run(files)
        version = self._commit(lambda runs: [*runs, run], arrival.schema)
        self._delete(f"pending/{folder}")
        return version

    def append_by(self, rows: DataFrame, arrival: str) -> int:
        """Write the arrivals of a column's values in one pass, each a run and a version of its own; the column isn't kept. Without rows there is one version with an empty run."""
        folder, files = self._written(rows, arrival)
        schema = StructType([f for f in rows.schema.fields if f.name != arrival])
        arrivals: dict[str, list[list]] = {}
        for f in files:
            arrivals.setdefault(f[0].rsplit("/", 2)[-2], []).append(f)
        for own in arrivals.values() or [[]]:
            run = self._run(own)
            version = self._commit(lambda runs, run=run: [*runs, run], schema)
        self._delete(f"pending/{folder}")
        return version

    # --- compaction

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.ratio)) + 1)

    def compact(self) -> int:
        """Merge until no tier holds fan_in runs; the resulting version."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for run in self.runs():
                tiers.setdefault(self.tier(run["bytes"]), []).append(run)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fan_in]
            if not full:
                return self.version()
            group = tiers[full[0]][: self.fan_in]
            folder, merged = self._merge(group)
            gone = {r["id"] for r in group}

            def swap(runs: list[dict], merged: dict = merged, gone: set[str] = gone) -> list[dict]:
                have = {r["id"] for r in runs}
                return [*(r for r in runs if r["id"] not in gone), merged] if gone <= have else runs  # another writer merged them first

            self._commit(swap)
            self._delete(f"pending/{folder}")

    def _merge(self, group: list[dict]) -> tuple[str, dict]:
        files = [f for r in group for f in self.files(r)]
        large = [f for f in files if 2 * f[1] >= self.target_bytes]
        small = [f for f in files if 2 * f[1] < self.target_bytes]
        folder, written = "none", []
        if small:
            folder, written = self._written(self._read(small).coalesce(max(1, round(sum(f[1] for f in small) / self.target_bytes))))
        if sum(f[2] for f in small) != sum(f[2] for f in written):
            raise RuntimeError(f"a merge of {sum(f[2] for f in small)} rows wrote {sum(f[2] for f in written)}")
        return folder, self._run([*large, *written])

    # --- reading

    def _read(self, files: list[list], schema: StructType | None = None) -> DataFrame:
        schema = schema or StructType.fromJson(self._manifest()["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f[0]}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        manifest = self._manifest(version)
        if not manifest["version"]:
            raise ValueError(f"{self.path} has no committed version")
        return self._read([f for r in manifest["runs"] for f in self.files(r)], StructType.fromJson(manifest["schema"]))

    def vacuum(self) -> None:
        """Delete shards and lists that the newest version doesn't name; only for when no reader holds an older one."""
        folders, lists = self._list("data"), self._list("runs")  # before the marks, and these before the version: a writer commits first and unmarks then
        old = (time.time() - self.abandoned) * 1000
        at = self._path(f"{self.path}/pending")
        marks = self._fs.listStatus(at) if self._fs.exists(at) else []
        pending = {x.getPath().getName() for x in marks if x.getModificationTime() > old}
        runs = self.runs()
        live = {f[0] for r in runs for f in self.files(r)}
        kept = {f.split("/", 1)[0] for f in live} | pending
        for name, _ in folders:
            if name not in kept:
                self._delete(f"data/{name}")
            elif name not in pending:
                for path in self._leaves(name):
                    if path not in live:
                        self._delete(f"data/{path}")
        if not pending:
            for name, _ in lists:
                if name.removesuffix(".json") not in {r["id"] for r in runs}:
                    self._delete(f"runs/{name}")

    def _leaves(self, folder: str) -> list[str]:
        found = []
        for name, _ in self._list(f"data/{folder}"):
            found += [f"{folder}/{name}/{x}" for x, _ in self._list(f"data/{folder}/{name}")] if "=" in name else [f"{folder}/{name}"]
        return [f for f in found if f.endswith(".parquet")]
