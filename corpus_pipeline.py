"""From raw documents to packed sequences: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages the rows are written as
Parquet in the cluster's shared folder and read again. SQL can't express fingerprints, the forest or the packing, so
there is no ORACLE_SQL; tests/llm/test_pipeline.py holds the rows of run() against a brute-force version.

Columns other than those of documents are ignored whatever their names; an empty table stays empty in every stage. What
each stage does with nulls, blank and very long texts, ties and repeated rows is said at its operator and below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm import quality_ledger, secret_scan, simhash, vector_packing
from quarryline.llm.common import Scratch, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of policy v1, by the failure bits of their ledger row.

    Rows with a null or blank text fail (too few words); repeated rows and ids, null ids and other nulls are kept as they are; all columns but COLUMNS go.
    """
    book = quality_ledger.ledger(docs, carry=("text", "lang", "source", "n_chars"))
    # the observation also keeps the filter above the measurements, which Catalyst would otherwise copy into it
    seen = book.observe("ledger", F.count(F.lit(1)).alias("rows"), *(F.count(F.when(F.expr(f"failures & {1 << i} <> 0"), 1)).alias(r.name) for i, r in enumerate(quality_ledger.RULES)))
    return seen.filter(quality_ledger.kept("v1")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 on five words: that of the smallest id.

    Of rows with one id only those of one group count as copies, so unlike texts of one id stay; rows that repeat as a whole stay once. Rows without
    an id take no part and stay. Blank and null texts are one group.
    """
    groups = simhash.similar_documents(docs, similarity=0.8, words=5)
    gone = groups.filter("NOT first").select("doc_id", "text_id").distinct()
    twice = materialize(groups.filter("first").groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")
    named = docs.select(*COLUMNS).withColumn("text_id", F.xxhash64(F.col("text").cast("string")))
    stay = named.join(gone.hint("merge"), ["doc_id", "text_id"], "left_anti")  # the copies that go grow with the corpus: never broadcast
    if not twice.isEmpty():
        once = stay.join(twice, ["doc_id", "text_id"], "left_semi").dropDuplicates(["doc_id", "text_id"])
        stay = stay.join(twice, ["doc_id", "text_id"], "left_anti").unionByName(once)
    return stay.select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked; a null text stays null, with a null n_chars."""
    done = secret_scan.scan(docs.select(*COLUMNS), secret_scan.train(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of up to 2048 tokens; a null or empty text is one piece, the end id."""
    return vector_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048, end_id=0)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
