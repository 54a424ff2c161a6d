r"""Secret scanning with a random forest that removes false positives.

Candidates are runs of key characters, with a digit in them, a known beginning or after an assignment, and quoted values
without white space that are assigned to a name. The forest judges each by its length,
how often the class of its characters changes, how much of it dictionary words cover, what form it has (path, address, digest
in its usual place), and the words around it. The dictionary is the words of a public tokenizer's vocabulary. The forest is trained by
Spark's ML library on labelled findings (`labelled_findings` makes a set by rule; real ones can be given instead), at most MOST_LABELS
of them, and then travels to the tasks as small arrays that give the model's own probabilities: scanning a text stays within its row, so
nothing is shuffled, and all candidates of a slice of rows are judged at once.

Defined results: null text stays null and has no findings; a text without findings is returned as it was; texts of
any length are scanned whole; repeated rows and ids are kept; equal texts are masked alike; a score at the threshold is a secret; empty tables
give empty results; other columns pass through, but for earlier ones named n_candidates and n_secrets, which are replaced.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Labelled findings that training takes at most, a bound on what reaches the driver.
MOST_LABELS = 20_000
#: The vocabulary whose words are the dictionary.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Put in a secret's place.
MASK = "[SECRET]"

# Words that stand before or in secrets, before harmless digests, and in placeholders.
SECRET_WORDS = frozenset("token tokens secret secrets password passwd pwd pass apikey api_key key access_key secret_key auth authorization bearer credential credentials private".split())
HARMLESS_WORDS = frozenset("commit sha sha1 sha256 md5 digest checksum hash etag uuid guid id build version revision rev image data base64 order invoice isbn parent tree blob".split())
PLACEHOLDERS = frozenset("example sample changeme change your placeholder dummy test xxxx none null redacted todo here insert".split())


@lru_cache(maxsize=2)
def dictionary(path: str) -> frozenset[str]:
    """The words of four letters and more in a byte-level vocabulary of the tokenizers library, lower-cased."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return frozenset(p[1:].lower() for p in pieces if re.fullmatch("\u0120[A-Za-z][a-z]{3,}", p))


_RUN = r"[A-Za-z0-9+/_\-]{8,}={0,2}(?:\.[A-Za-z0-9+/_\-]{4,}={0,2})*"
#: A candidate, with the name that it's assigned to: a quoted value, a run of key characters with signs inside, or after no name a run alone. The first part of an address's //user:password@ is no value.
CANDIDATE = re.compile(
    r"(?:(?:(?<=://)|(?<![A-Za-z0-9+/_.\-@]))((?=[0-9.\-]*+[A-Za-z_])[A-Za-z0-9_][A-Za-z0-9_.\-]*+)[\"'`]?[ \t]*+(?::=|=>|[=:])[ \t]*+[\"'`]?(?!//[^\s/@:]*+:[^\s/@]++@)|(?<![A-Za-z0-9+/_.\-@]))"
    r"((?(1)(?:(?<=[\"'`])[^\s\"'`]{8,}+(?=[\"'`])"
    r"|(?:" + _RUN + r"|[A-Za-z0-9+/_\-]+(?=[.!$%^*~#?&][A-Za-z0-9+/_\-.!$%^*~#?&]{6}))(?:(?:[.!$%^*~#?]|&(?![A-Za-z0-9_.\-]+=))+[A-Za-z0-9+/_\-]+={0,2})*+(?:[!$%^*~#]+(?=[\"'\s]|$))?)"
    r"|" + _RUN + r"(?!@)))(?![A-Za-z0-9])"
)
_NAMED = re.compile(f"()({_RUN})")
_WORD = re.compile(r"[A-Za-z_][\w]*")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SHAPES = (re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I), re.compile(r"\d+(?:[-.]\d+)*"), re.compile(r"[A-Za-z]+(?:[-_/.][A-Za-z0-9]{1,12})*"))
_PREFIXES = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|sk[-_]|pk[-_]|xox[abprs]-|glpat-|eyJ|SG\.|AGE-SECRET)")

FEATURES = ("length", "transitions", "entropy", "digits", "upper", "hex", "coverage", "separators", "path", "prefix", "uuid", "number", "words", "assigned", "quoted", "secret_before", "harmless_before", "placeholder", "secret_after", "colon", "label")


def candidates(text: str) -> Iterator[re.Match]:
    """Runs of key characters that hold a digit or begin as known keys do, and values that are assigned to a name; a name can be such a run itself."""
    for m in CANDIDATE.finditer(text):
        if m[1]:
            name = _NAMED.match(text, *m.span(1))
            if name and name.end() == m.end(1) and _telling(name[2]):
                yield name
        if len(m[2]) >= 8 and (m[1] or _telling(m[2])):
            yield m


def _telling(run: str) -> bool:
    return any(c.isdigit() for c in run) or bool(_PREFIXES.match(run))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(text: str, m: re.Match, known: frozenset[str]) -> list[float]:
    """The measurements of one candidate in its surroundings, in the order of FEATURES."""
    own, name = m[2], (m[1] or "").lower()
    n, kinds = len(own), [_class(c) for c in own]
    counts = np.unique(list(own), return_counts=True)[1] / n
    covered = sum(len(p) for p in _PARTS.findall(own) if p.lower() in known)
    before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 30]
    near = [w.lower() for w in _WORD.findall(before)[-2:]]
    ahead = text[max(0, m.start(2) - 8) : m.start(2)]
    sign = ahead.rstrip("\"'`> \t")[-1:]
    assigned = bool(m[1]) or sign in ("=", ":")
    named = {name, *(near[-1:] if assigned else near)} - {""}
    named |= {p for w in named for p in re.split(r"[_.\-]", w)}
    return [
        n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(-(counts * np.log2(counts)).sum()),
        kinds.count(2) / n,
        kinds.count(1) / n,
        float(not own.strip("0123456789abcdefABCDEF")),
        covered / n,
        kinds.count(3) / n,
        float("/" in before[-12:].split(" ")[-1] or "." in before[-1:] or own.count("/") > 1),
        float(bool(_PREFIXES.match(own))),
        *(float(bool(s.fullmatch(own))) for s in _SHAPES),
        float(assigned),
        float(ahead[-1:] in ("\"", "'", "`") or after[:1] in ("\"", "'", "`")),
        float(bool(named & SECRET_WORDS)),
        float(bool(named & HARMLESS_WORDS)),
        float(any(p in own.lower() for p in PLACEHOLDERS) or len(set(own)) < 4),
        float(bool({w.lower() for w in _WORD.findall(after)[:2]} & SECRET_WORDS)),
        float(sign == ":"),
        float(bool(set(re.split(r"[_.\-]", own.lower())) & SECRET_WORDS and after.lstrip("\"'` \t")[:1] in ("=", ":"))),
    ]


def labelled_findings(n: int = 6000, seed: int = 7, vocabulary: str = VOCABULARY) -> list[tuple[str, int]]:
    """(text around one candidate, 1 for a secret) by rule: keys of many forms against digests, ids, numbers, paths, names and placeholders."""
    rng = random.Random(seed)
    pick = lambda alphabet, lo, hi=None: "".join(rng.choices(alphabet, k=rng.randint(lo, hi or lo)))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    upper, lower = alnum[:26] + alnum[52:], "abcdefghijklmnopqrstuvwxyz"
    words, secret, harmless = sorted(w for w in dictionary(vocabulary) if len(w) < 11), sorted(SECRET_WORDS), sorted(HARMLESS_WORDS)
    filler = lambda: " ".join(rng.choice((rng.choice(words), pick(lower, 2, 9))) for _ in range(rng.randint(0, 4)))
    quote = lambda s: (q := rng.choice(('"', "'", ""))) + s + q
    sign = lambda: rng.choice((" = ", "=", ": ", ":", " := "))
    key = lambda: rng.choice((pick(hexa, 16, 64), pick(alnum, 12, 64), pick(alnum + "+/", 24, 64), pick(upper, 16, 40), pick(alnum + "_-", 16, 48)))
    quoted = lambda s: (q := rng.choice(('"', "'"))) + s + q
    name = lambda: rng.choice((f"{rng.choice(('S3', 'db2', 'K8'))}_{rng.choice(secret)}", f"{rng.choice(secret)}_{rng.randint(1, 9)}", f"S3_{rng.choice(secret)}".upper(), f"MY_{'_'.join(rng.sample(words, 4))}_{rng.choice(secret)}".upper()))
    uuid = lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
    secrets = (
        lambda: f"{rng.choice(secret)}{sign()}{quote(key())}",
        lambda: f"{rng.choice(words)}_{rng.choice(secret)}{sign()}{quote(key())}",
        lambda: f"{rng.choice(('AKIA', 'ASIA'))}{pick(upper, 16)}",
        lambda: f"{rng.choice(('ghp_', 'gho_', 'glpat-', 'sk-', 'sk_live_', 'xoxb-', 'AIza'))}{pick(alnum, 20, 40)}",
        lambda: f"Authorization: Bearer {pick(alnum, 24, 60)}",
        lambda: f"{rng.choice(secret)}{sign()}{quote(uuid())}",
        lambda: f"{name()}{sign()}{quote(key())}",
        lambda: f"{rng.choice((name(), rng.choice(secret)))}{sign()}{quoted(rng.choice((pick(alnum[:52], 12, 40), pick(lower, 12, 28), pick(lower, 4, 9) + rng.choice('&!$#%@') + pick(alnum, 6, 20))))}",
        lambda: f"{rng.choice(secret)}{sign()}{pick(alnum[:52], 16, 40)}",
        lambda: f'{{"{rng.choice((name(), rng.choice(secret)))}":{rng.choice(("", " "))}"{rng.choice((key(), pick(alnum[:52], 12, 40)))}"}}',
        lambda: f"{rng.choice(('AKIA', 'ASIA'))}{pick(alnum[:26], 16)}",
        lambda: f"{rng.choice(('https', 'postgres', 'ftp'))}://{pick(lower, 3, 7)}:{rng.choice((key(), pick(alnum[:52], 12, 30), 'ghp_' + pick(alnum, 30, 36)))}@{rng.choice(words)}.com",
    )
    others = (
        lambda: f"{rng.choice(harmless)}{rng.choice((' ', ': ', '=', ' = '))}{quote(rng.choice((pick(hexa, 32), pick(hexa, 40), pick(hexa, 64), uuid())))}",
        lambda: pick(hexa, 7, 64),
        lambda: uuid(),
        lambda: pick("0123456789", 8, 20),
        lambda: f"{rng.choice(words)}/{rng.choice(words)}/{rng.choice(words)}{rng.randint(0, 99)}.{rng.choice(('py', 'js', 'txt', 'md'))}",
        lambda: "".join(w.title() for w in rng.sample(words, 3)) + str(rng.randint(0, 99)),
        lambda: "_".join(rng.sample(words, 3)) + str(rng.randint(0, 99)),
        lambda: f"{rng.choice(secret)}{sign()}{quote(rng.choice(sorted(PLACEHOLDERS)) + '_' + rng.choice(words) + str(rng.randint(0, 9)))}",
        lambda: f"{rng.choice(secret)}{sign()}{quote(rng.choice('x0*1a') * 12 + '1')}",
        lambda: f"{rng.choice(words)}={rng.choice(words)}{rng.randint(1000, 99999)}",
        lambda: pick(lower, 9, 18) + str(rng.randint(0, 9)),
        lambda: f"{rng.choice(words)}{sign()}{quote(rng.choice((pick(lower, 8, 14), '-'.join(rng.sample(words, 2)), '_'.join(rng.sample(words, 3)), ''.join(w.title() for w in rng.sample(words, 3)))))}",
        lambda: f"{rng.choice(secret)}{sign()}{rng.choice(('_'.join(rng.sample(words, 2)), '.'.join(rng.sample(words, 2)), ''.join(w.title() for w in rng.sample(words, 2)), pick(lower, 8, 11)))}",
        lambda: f"{name()}{rng.choice((' = ', '=', ': ', ':'))}{pick(lower, 2, 6)}",
        lambda: f"{name()}{rng.choice((' = ', '=', ': ', ':'))}{pick(lower, 2, 6)}",
        lambda: f"{rng.choice(words).upper()}{rng.randint(1, 99)}_{rng.choice(secret).upper()}{rng.choice((' = ', '=', ': ', ':'))}{pick(lower, 2, 6)}",
        lambda: f"{pick(lower, 3, 9)}: {pick(lower, 8, 14)}",
        lambda: f"https://{rng.choice(words)}.com/{rng.choice(words)}/{rng.choice(words)}{rng.choice(('', str(rng.randint(0, 99))))}",
        lambda: f"data:image base64 {pick(alnum + '+/', 60, 200)}",
    )
    rows = []
    while len(rows) < n:
        label = rng.random() < 0.5
        text = f"{filler()} {rng.choice(secrets if label else others)()} {filler()}"
        if sum(1 for _ in candidates(text)) == 1:
            rows.append((text, int(label)))
    return rows


class Forest:
    """Trees as arrays: for each node the feature, the threshold, both children and the share of secrets; a leaf has feature -1. known: the dictionary."""

    def __init__(self, trees: list[np.ndarray], known: frozenset[str]):
        self.trees, self.known = trees, known

    @classmethod
    def of(cls, spark: SparkSession, model: RandomForestClassificationModel, known: frozenset[str]) -> Forest:
        """The nodes as Spark's ML library saves them."""
        with Scratch(spark, "forest") as scratch:
            model.write().save(scratch.path)
            nodes = spark.read.parquet(f"{scratch.path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # bounded by trees and depth
        trees: dict[int, list[list[float]]] = {}
        for r in nodes:
            split = r["split"]
            inner = r["leftChild"] >= 0
            threshold = split["leftCategoriesOrThreshold"][0] if inner else 0.0
            trees.setdefault(r["treeID"], []).append([split["featureIndex"] if inner else -1, threshold, r["leftChild"], r["rightChild"], r["impurityStats"][1] / sum(r["impurityStats"])])
        return cls([np.array(t) for _, t in sorted(trees.items())], known)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The mean over the trees of the share of secrets in each row's leaf."""
        total = np.zeros(len(rows))
        for tree in self.trees:
            at = np.zeros(len(rows), int)
            while (inner := tree[at, 0] >= 0).any():
                i = np.flatnonzero(inner)
                node = tree[at[i]]
                left = rows[i, node[:, 0].astype(int)] <= node[:, 1]
                at[i] = np.where(left, node[:, 2], node[:, 3]).astype(int)
            total += tree[at, 4]
        return total / len(self.trees)


def fit(spark: SparkSession, findings: list[tuple[str, int]] | None = None, trees: int = 24, depth: int = 8, seed: int = 1, vocabulary: str = VOCABULARY) -> tuple[RandomForestClassificationModel, DataFrame]:
    """Spark's model and the measured findings that it was trained on, of which the first MOST_LABELS are used."""
    rows = []
    for text, label in (findings if findings is not None else labelled_findings(vocabulary=vocabulary))[:MOST_LABELS]:
        rows += [(Vectors.dense(features(text, m, dictionary(vocabulary))), float(label)) for m in candidates(text)]
    data = spark.createDataFrame(rows, ["features", "label"]).coalesce(2)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(data), data


def train(spark: SparkSession, findings: list[tuple[str, int]] | None = None, vocabulary: str = VOCABULARY, **how) -> Forest:
    """A forest from labelled findings."""
    return Forest.of(spark, fit(spark, findings, vocabulary=vocabulary, **how)[0], dictionary(vocabulary))


def scan_texts(texts: list[str | None], forest: Forest) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of every candidate of each text, all judged at once; those of at least the threshold are secrets."""
    found = [list(candidates(t)) if t else [] for t in texts]
    rows = [features(t, m, forest.known) for t, ms in zip(texts, found, strict=True) for m in ms]
    scores = iter(forest.scores(np.array(rows)).tolist() if rows else ())
    return [[(*m.span(2), next(scores)) for m in ms] for ms in found]


def scan_text(text: str, forest: Forest) -> list[tuple[int, int, float]]:
    return scan_texts([text], forest)[0]


def masked(text: str | None, bad: list[tuple[int, int, float]]) -> str | None:
    """The text with MASK in place of the spans, which are in order and apart."""
    if not bad:
        return text
    starts, ends = [0, *(x[1] for x in bad)], [*(x[0] for x in bad), len(text)]
    return MASK.join(text[a:b] for a, b in zip(starts, ends, strict=True))


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with every secret masked in its text, n_candidates and n_secrets."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # some ten thousand numbers and words, however many rows
    docs = docs.select(F.col(f"`{text_col}`").cast("string").alias(text_col), *(F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_candidates", "n_secrets")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                texts = part.column(0).to_pylist()
                found = scan_texts(texts, shared.value)
                bad = [[x for x in own if x[2] >= threshold] for own in found]
                done = [pa.array([masked(t, b) for t, b in zip(texts, bad, strict=True)], pa.string()), *part.columns[1:], *(pa.array([len(x) for x in own], pa.int64()) for own in (found, bad))]
                yield pa.record_batch(done, names=[*part.schema.names, "n_candidates", "n_secrets"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_candidates long, n_secrets long"
    return docs.mapInArrow(run, schema)
