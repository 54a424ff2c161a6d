"""The numbered operators as queries over the synthetic tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, feistel, quality_ledger, secret_scan, sentencepiece_bpe, sharding, simhash, simple8b, vector_packing, vector_search
from .common import materialize, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: A key for the synthetic tables; a real one comes from a secret store.
PSEUDONYM_KEY = b"synthetic tables"
#: Into so many arrivals the documents are dealt.
ARRIVALS = 8

ORACLE_SQL["op1_sharding"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, scratch_path(spark, "shards"))
    store.append_by(docs.withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), "arrival")
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "text", "lang", "source", "n_chars")


@query
def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger under both policies; only_rule is the one rule of v1 that rejects a row, restored how many rows its ablation brings back."""
    book = materialize(quality_ledger.ledger(table(spark, sf_dir, "documents")), "ledger")
    alone = quality_ledger.ablations(book, "v1").select(F.col("rule").alias("only_rule"), F.col("failed_alone").alias("restored"))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = book.select("doc_id", *measures, (~quality_ledger.kept("base")).alias("base_failed"), quality_ledger.kept("v1").alias("kept"), "failures", quality_ledger.only_rule("v1").alias("only_rule"))
    return judged.join(F.broadcast(alone), "only_rule", "left").select("doc_id", *measures, "base_failed", "kept", "failures", "only_rule", "restored")  # a row for each rule


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(spark))
    return done.select("doc_id", "text", "lang", "source", "n_candidates", "n_secrets")


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat_format.format_conversations(messages.withColumn("parts", chat_format.text_parts(F.col("text"))))
    read = done.select("conv_id", "formatted", chat_format.parse_turns(F.col("formatted")).alias("turns"), chat_format.parse_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op5_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = feistel.key_table(spark, scratch_path(spark, "key"), PSEUDONYM_KEY)
    done = feistel.pseudonymize(table(spark, sf_dir, "documents"), key)
    return done.select("doc_id", "text", "lang", "source", F.size("findings").cast("long").alias("n_findings"), F.array_join(F.transform("findings", lambda m: F.concat_ws(":", m["kind"], m["pseudonym"])), ";").alias("findings"))


@query
def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "simple8b")
    simple8b.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return simple8b.read_digests(spark, path)


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * 256
        return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).when(F.abs(scaled) < float("inf"), scaled)  # larger doubles are whole

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", whole).alias("embedding"))
    return vector_search.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = vector_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
