"""The registered queries of the numbered operators over a folder of small tables with odd rows, against brute force."""

import base64
import hashlib
import hmac
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarryline.llm import quality_ledger, secret_scan
from quarryline.llm.queries import ORACLE_SQL, PSEUDONYM_KEY, QUERIES
from tests.conftest import SF_DIR
from tests.llm.test_operators import brute_components, brute_fingerprint, luhn, measured, tokenizer

ODD = [
    (90001, None), (90002, ""), (90003, " \n\t "), (90004, "w " * 20_000 + "end"), (90005, "x" * 30_000), (90006, "Ünïcode straße, 日本語 é \x1c\x85 it's don't\n\ntwo  spaces <|endoftext|>"),
    (90007, "same text here for two ids, long enough to be kept by the rules of all"), (90008, "same text here for two ids, long enough to be kept by the rules of all"), (90006, "another text under an id that is taken"),
    (90009, "pay 4111 1111 1111 1111 or 4111111111111111 from 10.0.0.1, call +1 (516) 555-2642 or 4111111111111112"), (90010, "again 4111111111111111 and 10.0.0.1, mail a.b@example.com."), (90011, "# * $ < > & | % a b c d e f g h i j"),
    (90012, "one line\n" * 12), (None, "a row without an id"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    read = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")
    docs = read("documents").orderBy("doc_id").limit(90)
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    docs.unionByName(odd).withColumn("n_words", F.lit("clash")).withColumn("offset", F.lit(1)).repartition(3).write.parquet(f"{root}/documents.parquet")
    vectors = read("embeddings")
    n = len(vectors.first()["embedding"])
    other = [(100_000, None, 0), (100_050, [], 0), (100_100, [float("nan")] * n, 0), (100_150, [None] * n, 0), (100_200, [1.0] * 3, 0), (100_201, [2.0] * 3, 0), (100_202, [float("inf")] * 3, 0), (None, [1.0] * n, 0)]
    vectors.unionByName(spark.createDataFrame(other, vectors.schema)).repartition(3).write.parquet(f"{root}/embeddings.parquet")
    talks = read("conversations")
    said = [(80_001, 1, "user", None), (80_001, 2, "assistant", "\\l<b> </turn>\n" * 3), (80_002, 1, None, "x"), (80_003, 1, "assistant", "long " * 60_000)]
    talks.unionByName(spark.createDataFrame(said, talks.schema)).repartition(3).write.parquet(f"{root}/conversations.parquet")
    return str(root)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def rows(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, duck.execute(ORACLE_SQL[name]).fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_empty_tables(spark, folder, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t in ("documents", "embeddings", "conversations"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    assert {n: QUERIES[n](spark, str(root)).count() for n in QUERIES} == {n: int(n == "op4_chat_format") for n in QUERIES}


def test_op1(spark, folder):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(rows(spark, folder, "op1_sharding")) == Counter(spark.read.parquet(f"{folder}/documents.parquet").select(columns).collect())


def test_op2(spark, folder, texts):
    want = Counter()
    for doc_id, text in texts:
        words, chars, symbols, dup, repeat = measured(text)
        want[doc_id, words, chars, symbols, dup, repeat, words < 10 or 100 * repeat > 20 * words] += 1
    got = rows(spark, folder, "op2_rule_ledger")
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    alone = Counter(r["only_rule"] for r in got)
    for r in got:
        failed = [x.name for i, x in enumerate(quality_ledger.RULES) if r["failures"] >> i & 1]
        assert r["kept"] == (not failed) and r["only_rule"] == (failed[0] if len(failed) == 1 else None)
        assert r["restored"] == (alone[r["only_rule"]] if r["only_rule"] else None)


def test_op3(spark, folder, texts):
    forest = secret_scan.train(spark)
    want = Counter()
    for doc_id, text in texts:
        found = secret_scan.scan_text(text, forest)
        bad = [x for x in found if x[2] >= 0.5]
        masked = text
        for start, end, _ in reversed(bad):
            masked = masked[:start] + secret_scan.MASK + masked[end:]
        want[doc_id, masked, len(found), len(bad)] += 1
    assert Counter((r["doc_id"], r["text"], r["n_candidates"], r["n_secrets"]) for r in rows(spark, folder, "op3_secret_scan")) == want


def test_op4(spark, folder):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        talks[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    said = r"\### Assistant: </turn> ok"
    talks[-7] = [(0, "user", said), (1, "assistant", said)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, turns in talks.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want[i] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    got = rows(spark, folder, "op4_chat_format")
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert all(r["formatted_chars"] >= r["loss_chars"] for r in got)


def permuted(left, right, a, b, domain):
    """The network by itself: eight rounds, digests by the standard library."""
    for k in range(8):
        shift = lambda half, k=k: int(hmac.new(PSEUDONYM_KEY, f"{domain}/{k}/{half}".encode(), hashlib.sha256).hexdigest()[:15], 16)
        left, right = (left, (right + shift(left)) % b) if k % 2 else ((left + shift(right)) % a, right)
    return left, right


def permuted_digits(digits, kind):
    n, u = len(digits), len(digits) // 2
    left, right = permuted(int(digits[:u]), int(digits[u:]), 10**u, 10 ** (n - u), f"{kind}{n}")
    return f"{left:0{u}d}{right:0{n - u}d}"


def laid_out(form, digits):
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in form)


def pseudonymized(text):
    """Cards, addresses, phones and mail addresses in the layouts of the tables."""

    def one(m):
        s, digits = m[0], re.sub(r"\D", "", m[0])
        if "@" in s:
            return f"u{hmac.new(PSEUDONYM_KEY, f'email/{s.lower()}'.encode(), hashlib.sha256).hexdigest()[:14]}@pseudonym.invalid"
        if s.startswith("+"):
            return "+1" + laid_out(s[2:], permuted_digits(digits[1:], "phone"))
        if "." in s:
            o = [int(x) for x in s.split(".")]
            if max(o) > 255:
                return s
            p, q = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
            return f"{p // 256}.{p % 256}.{q // 256}.{q % 256}"
        if not luhn(digits):
            return s
        new = permuted_digits(digits[:-1], "card")
        return laid_out(s, new + next(str(d) for d in range(10) if luhn(new + str(d))))

    pattern = r"(?<![\w%+.-])[\w%+.-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)|(?<!\w)\d{4}(?: ?\d{4}){3}(?![\d\w])"
    return text and re.sub(pattern, one, text)


def test_op5(spark, folder, texts):
    got = rows(spark, folder, "op5_feistel")
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, pseudonymized(t)) for i, t in texts)
    assert sum(r["n_findings"] for r in got) > 10 and all((r["n_findings"] > 0) == bool(r["findings"]) for r in got)


def by_id(texts):
    return sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_op6(spark, folder, texts):
    encode, start, want = tokenizer("byte_bpe_50k.json"), 0, Counter()
    for doc_id, text in by_id(texts):
        ids = np.array([*encode(text), 0], "<u4")
        want[doc_id, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in rows(spark, folder, "op6_simple8b")) == want


def test_op7(spark, folder):
    found = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = [(i, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, v in found if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    want = Counter()
    for i, v in found:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in found if j != i and len(w) == len(v))[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    assert Counter(tuple(r) for r in rows(spark, folder, "op7_topk")) == want
    assert (100_200, 1, 100_201, 256 * 256 * 6) in want


def test_op8(spark, folder, texts):
    fps = [(i, brute_fingerprint(t, 3)) for i, t in texts]
    label, least = brute_components({f for _, f in fps}, 3), {}
    for i, f in fps:
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    assert Counter(tuple(r) for r in rows(spark, folder, "op8_simhash")) == Counter((i, f"{f:016x}", least.get(label[f])) for i, f in fps)


def test_op9(spark, folder, texts):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4").tobytes()
        want[doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows(spark, folder, "op9_sentencepiece_bpe")) == want


def packed_right(got, texts, encode):
    """Every piece once, sequences gapless and within 2048 tokens; the number of sequences and one that no packing goes below."""
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*encode(text), 0], "<u4")
        want.update((doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), fewest(sorted(r["length"] for r in got))


def fewest(lengths, most=2048):
    """Pieces over half a sequence are alone with small ones; what these have no room for needs sequences of its own."""
    bound = -(-sum(lengths) // most)
    for small in {0, *(x for x in lengths if 2 * x <= most)}:
        lone = [x for x in lengths if x > most - small]
        halves = [x for x in lengths if most / 2 < x <= most - small]
        rest = sum(x for x in lengths if small <= x <= most / 2) - (len(halves) * most - sum(halves))
        bound = max(bound, len(lone) + len(halves) + max(0, -(-rest // most)))
    return bound


def test_op10(spark, folder, texts):
    bins, least = packed_right(rows(spark, folder, "op10_packing"), texts, tokenizer("word_bpe_49k.json"))
    assert bins <= 1.05 * least + 1
