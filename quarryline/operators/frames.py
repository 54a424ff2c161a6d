"""Typed frames: a DataFrame with the verbs of its level.

A frame wraps a DataFrame and delegates to it; whatever method returns a DataFrame comes back as the same kind of frame,
so filters, sorts, samples and set operations keep the verbs. As long as a chain from the repositories down has only been filtered,
its frames remember the conditions (Chain), and an engine that can reads the whole chain in one scan; after any other
method, the next verb is a semi join with what the frame holds.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import languages, uast
from . import verbs


@dataclass(frozen=True)
class Chain:
    """The conditions on each level so far, the last level being the frame's own, and whether only newest commits are in it."""

    levels: tuple[tuple[str, tuple[Any, ...]], ...]
    tip_only: bool = False

    def where(self, condition: Any) -> Chain:
        level, conditions = self.levels[-1]
        return replace(self, levels=(*self.levels[:-1], (level, (*conditions, condition))))

    def down(self, level: str, tip_only: bool | None = None) -> Chain:
        return Chain((*self.levels, (level, ())), self.tip_only if tip_only is None else tip_only)


class TypedFrame:
    """Delegates to .df; engine gives the tables that verbs join with."""

    def __init__(self, df: DataFrame, engine: Any, chain: Chain | None = None):
        self.df, self.engine, self.chain = df, engine, chain

    def _wrap(self, df: DataFrame, chain: Chain | None = None) -> TypedFrame:
        return type(self)(df, self.engine, chain)

    def _widened(self, others: list[Any]) -> None:
        """Called on a frame that may have taken in rows of others."""

    def _where(self, verb: Callable[..., DataFrame], condition: Any) -> TypedFrame:
        return self._wrap(verb(self.df), self.chain and self.chain.where(condition))

    def _down(self, level: str, joined: Callable[[], DataFrame], tip_only: bool | None = None) -> tuple[DataFrame, Any, Chain | None]:
        """The next level: in one scan of the chain if the engine can, else joined."""
        chain = self.chain and self.chain.down(level, tip_only)
        df = self.engine.chained(chain) if chain and hasattr(self.engine, "chained") else None
        return (joined(), self.engine, None) if df is None else (df, self.engine, chain)

    def __getattr__(self, name: str) -> Any:
        if name in ("df", "engine", "chain"):  # before __init__, as in copies
            raise AttributeError(name)
        found = getattr(self.df, name)
        if not callable(found) or isinstance(found, type):
            return found

        @functools.wraps(found)
        def call(*args: Any, **kwargs: Any) -> Any:
            bare = lambda x: x.df if isinstance(x, TypedFrame) else x
            out = found(*map(bare, args), **{k: bare(v) for k, v in kwargs.items()})
            if isinstance(out, DataFrame):
                given = [*args, *kwargs.values()]
                frame = self._wrap(out, self.chain.where(given[0]) if self.chain and name in ("filter", "where") else None)
                if name.startswith("union") or name == "transform":
                    frame._widened([x for x in given if isinstance(x, TypedFrame | DataFrame)] if name != "transform" else [None])
                return frame
            if isinstance(out, list) and out and all(isinstance(x, DataFrame) for x in out):  # randomSplit
                return [self._wrap(x) for x in out]
            return out

        return call

    def __getitem__(self, item: Any) -> Any:
        out = self.df[item]
        return self._wrap(out) if isinstance(out, DataFrame) else out

    def __dir__(self) -> list[str]:
        return sorted({*super().__dir__(), *dir(self.df)})


class RepositoriesFrame(TypedFrame):
    @property
    def references(self) -> ReferencesFrame:
        return ReferencesFrame(*self._down("references", lambda: verbs.references_of(self.df, self.engine.table("references"))))

    @property
    def remote_references(self) -> ReferencesFrame:
        return self.references.remote_references

    @property
    def head_ref(self) -> ReferencesFrame:
        return self.references.head_ref

    @property
    def master_ref(self) -> ReferencesFrame:
        return self.references.master_ref


class ReferencesFrame(TypedFrame):
    @property
    def remote_references(self) -> ReferencesFrame:
        return self._where(verbs.remote, "is_remote")

    @property
    def head_ref(self) -> ReferencesFrame:
        return self._where(verbs.heads, F.col("name").isin(*verbs.HEADS))

    @property
    def master_ref(self) -> ReferencesFrame:
        return self._where(verbs.masters, F.col("name") == verbs.MASTER)

    def ref(self, name: str) -> ReferencesFrame:
        return self._where(lambda df: verbs.reference_named(df, name), F.col("name") == name)

    @property
    def commits(self) -> CommitsFrame:
        """The newest commit of each reference."""
        verbs.require(self.df, "commits", "repository_id", "name")
        return CommitsFrame(*self._down("commits", lambda: verbs.commits_of(self.df, self.engine.table("commits")), True), references=self)

    @property
    def all_reference_commits(self) -> CommitsFrame:
        verbs.require(self.df, "commits", "repository_id", "name")
        return CommitsFrame(*self._down("commits", lambda: verbs.commits_of(self.df, self.engine.table("commits"), tip_only=False)), references=self, tip_only=False)

    @property
    def blobs(self) -> BlobsFrame:
        return self.commits.tree_entries.blobs


class _TipFrame(TypedFrame):
    """tip_only: whether only newest commits are in it, so that a Git scan below needs no others."""

    def __init__(self, df: DataFrame, engine: Any, chain: Chain | None = None, tip_only: bool = True):
        super().__init__(df, engine, chain)
        self._tip_only = tip_only

    def _wrap(self, df: DataFrame, chain: Chain | None = None) -> TypedFrame:
        return type(self)(df, self.engine, chain, self._tip_only)

    def _widened(self, others: list[Any]) -> None:
        self._tip_only = self._tip_only and all(isinstance(x, _TipFrame) and x._tip_only for x in others)


class CommitsFrame(_TipFrame):
    """references: the frame that the commits come from, so that all its commits stay in reach of a chain on the newest."""

    def __init__(self, df: DataFrame, engine: Any, chain: Chain | None = None, tip_only: bool = True, references: ReferencesFrame | None = None):
        super().__init__(df, engine, chain, tip_only)
        self._references = references

    def _wrap(self, df: DataFrame, chain: Chain | None = None) -> CommitsFrame:
        return CommitsFrame(df, self.engine, chain, self._tip_only, self._references)

    def _widened(self, others: list[Any]) -> None:
        super()._widened(others)
        if self._references is not None:
            known = [x._references for x in others if isinstance(x, CommitsFrame) and x._references is not None]
            self._references = functools.reduce(lambda a, b: a.unionByName(b).distinct(), known, self._references) if len(known) == len(others) else None

    @property
    def all_reference_commits(self) -> CommitsFrame:
        if self._references is None:
            parent = self.df.select("repository_id", F.col("reference_name").alias("name"))
            return CommitsFrame(verbs.commits_of(parent, self.engine.table("commits"), tip_only=False), self.engine, tip_only=False)
        return self._references.all_reference_commits

    @property
    def tree_entries(self) -> TreeEntriesFrame:
        verbs.require(self.df, "tree_entries", "repository_id", "reference_name", "hash")
        return TreeEntriesFrame(*self._down("tree_entries", lambda: verbs.tree_entries_of(self.df, self.engine.table("tree_entries", tip_only=self._tip_only))), tip_only=self._tip_only)

    @property
    def blobs(self) -> BlobsFrame:
        return self.tree_entries.blobs


class TreeEntriesFrame(_TipFrame):
    @property
    def blobs(self) -> BlobsFrame:
        verbs.require(self.df, "blobs", "commit_hash", "repository_id", "reference_name", "path", "blob")
        return BlobsFrame(*self._down("blobs", lambda: self.engine.contents(self.df)))


class BlobsFrame(TypedFrame):
    def classify_languages(self) -> BlobsWithLanguageFrame:
        return BlobsWithLanguageFrame(languages.classify(self.df), self.engine)

    def extract_uasts(self) -> UastsFrame:
        return UastsFrame(uast.extract(self.df), self.engine)


class BlobsWithLanguageFrame(BlobsFrame):
    """Blobs with a column lang, which extract_uasts follows."""


class UastsFrame(TypedFrame):
    def query_uast(self, query: str, query_col: str = "uast", output_col: str = "result") -> UastsFrame:
        return self._wrap(uast.query(self.df, query, query_col, output_col))

    def extract_tokens(self, input_col: str = "result", output_col: str = "tokens", as_written: bool = False) -> UastsFrame:
        return self._wrap(uast.tokens(self.df, input_col, output_col, as_written))


def count_by(frame: TypedFrame | DataFrame, *columns: str) -> DataFrame:
    """Rows of each value, the most frequent first."""
    df = frame.df if isinstance(frame, TypedFrame) else frame
    return df.groupBy(*columns).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *columns)
