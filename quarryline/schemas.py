"""The five levels and the storage-only table that links commits and references."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = ("repositories", "references", "commits", "tree_entries", "blobs")


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


_TEXT, _LIST = T.StringType(), T.ArrayType(T.StringType(), containsNull=False)

SCHEMAS = {
    "repositories": _table(("id", _TEXT, False), ("urls", _LIST, False), ("is_fork", T.BooleanType(), True), ("repository_path", _TEXT, True)),
    "references": _table(("repository_id", _TEXT, False), ("name", _TEXT, False), ("hash", _TEXT, False), ("is_remote", T.BooleanType(), False)),
    "commits": _table(
        ("repository_id", _TEXT, False),
        ("reference_name", _TEXT, False),
        ("index", T.IntegerType(), False),
        ("hash", _TEXT, False),
        ("message", _TEXT, False),
        ("parents", _LIST, True),
        ("parents_count", T.IntegerType(), False),
        ("author_email", _TEXT, True),
        ("author_name", _TEXT, True),
        ("author_date", T.TimestampType(), True),
        ("committer_email", _TEXT, True),
        ("committer_name", _TEXT, True),
        ("committer_date", T.TimestampType(), True),
    ),
    "tree_entries": _table(("commit_hash", _TEXT, False), ("repository_id", _TEXT, False), ("reference_name", _TEXT, False), ("path", _TEXT, False), ("blob", _TEXT, False)),
    "blobs": _table(
        ("blob_id", _TEXT, False),
        ("commit_hash", _TEXT, False),
        ("repository_id", _TEXT, False),
        ("reference_name", _TEXT, False),
        ("content", T.BinaryType(), True),
        ("is_binary", T.BooleanType(), False),
    ),
    "repository_has_commits": _table(("hash", _TEXT, False), ("reference_name", _TEXT, False), ("repository_id", _TEXT, False), ("index", T.IntegerType(), False)),
}


def schema(table: str) -> T.StructType:
    """The columns of a table; an unknown name raises."""
    if table not in SCHEMAS:
        raise ValueError(f"table {table!r} is not supported; there are {', '.join(SCHEMAS)}")
    return SCHEMAS[table]
