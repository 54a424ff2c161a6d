"""Quality rules as a bitmask ledger, by DataFrame functions alone.

`ledger` measures every text once, evaluates every rule once, and stores the measurements with one bit for each failed
rule. Policies are versioned masks over those bits: applying one, or asking what each of its rules removes alone, reads
the ledger and never the texts. Windows of words are compared by 64-bit hashes. Everything about a text stays within its row, so nothing is shuffled before the few
counts of `ablations`, which are pre-aggregated by their bits.

Defined results: null or blank text measures zero everywhere and fails too_few_words; texts of any length are measured
whole; repeated rows and ids keep one ledger row each; null ids are kept; empty tables give empty ledgers; other
columns are ignored (or carried by name through `carry`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let

#: Words in the window whose repeats are counted.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """fails: a condition in SQL over the measurements."""

    name: str
    fails: str


#: Bit i of a ledger belongs to rule i; new rules go at the end so that stored ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("upper_case", "100 * n_upper > 60 * word_chars"),
    Rule("exclamations", "2 * n_exclaims > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
)

#: Which rules reject, by version.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")


def mask(policy: str, rules: tuple[Rule, ...] = RULES, policies: dict[str, tuple[str, ...]] = POLICIES) -> int:
    """The bits of a policy's rules."""
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[name] for name in policies[policy])


def _lost(text: Column, pattern: str) -> Column:
    """How many characters of text match a pattern of single characters."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _covered(grams: Column) -> Column:
    """How many words the windows that occur twice or more cover. grams: hashes of the windows in order."""

    def spread(ordered: Column) -> Column:
        like = lambda x, j: F.coalesce(F.get(ordered, j)["g"] == x["g"], F.lit(False))
        same = lambda x, j: like(x, j - 1) | like(x, j + 1)
        at = F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"]))
        own = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(at, own)

    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(ordered, spread))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, measurements, carried columns) of every row."""
    word, blank = SPACES.replace("[", "[^"), F.lit("")
    text = F.coalesce(F.col(text_col).cast("string"), blank)
    kept = [F.col(f"`{c}`") for c in carry if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), *kept)
    split = rows.withColumn("__words", F.array_remove(F.split("__text", f"{SPACES}+"), ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(word))
    wide = split.withColumns({
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
        "__joined": F.array_join("__words", ""),
        "__lines": lines,
    })
    grams = F.when(F.size("__hashes") < WINDOW, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("__hashes") - WINDOW), lambda i: F.xxhash64(*(F.get("__hashes", i + k) for k in range(WINDOW))))
    )
    wide = wide.withColumn("__grams", grams)
    found = {
        "n_words": F.size("__words"),
        "word_chars": F.length("__joined"),
        "n_symbols": _lost(F.col("__text"), "[#*$%&|<>]"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _covered(F.col("__grams")),
        "n_lines": F.size("__lines"),
        "n_upper": _lost(F.col("__joined"), r"\p{Lu}+"),
        "n_exclaims": _lost(F.col("__joined"), "!+"),
    }
    return wide.select(F.col("__id").alias(id_col), *(c.cast("long").alias(n) for n, c in found.items()), *kept, *([F.col("__text").alias(text_col)] if text_col in carry else []))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """The measurements with `failures`: bit i set if rule i failed."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured(docs, id_col, text_col, carry).withColumn("failures", failures)


def kept(policy: str, **how) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy, **how))) == 0


def only_rule(policy: str, rules: tuple[Rule, ...] = RULES, policies: dict[str, tuple[str, ...]] = POLICIES) -> Column:
    """The rule without which the policy would keep a ledger row that it rejects; null if there is none or the row is kept."""
    bits = F.col("failures").bitwiseAND(F.lit(mask(policy, rules, policies)))
    return F.coalesce(*(F.when(bits == 1 << i, r.name) for i, r in enumerate(rules) if r.name in policies[policy]))


def ablations(book: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """(rule, failed, failed_alone): how many rows each rule of a policy rejects, and how many only it does, which is what dropping it would bring back."""
    whole = mask(policy, rules, policies)
    seen = book.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    named = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).alias("bit")) for i, r in enumerate(rules) if r.name in policies[policy]))).alias("r")
    hit = seen.select("bits", "n", named).filter("bits & r.bit <> 0")
    return hit.groupBy("r.rule").agg(F.sum("n").alias("failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"))
