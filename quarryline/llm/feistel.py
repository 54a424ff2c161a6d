"""Format-preserving pseudonyms for personal data, by DataFrame functions alone.

Matches of one pattern are validated: card numbers by their check digit, addresses by their octets, dates by the calendar, social security
numbers by their ranges, phones by country code and count of digits; what fails is left alone. A validated number or date is permuted by a keyed
Feistel network over its own domain: the digits of a number keep their count and layout (a card's check digit is made anew, so the pseudonym is a
valid card), an address maps to an address, a date to a date in the same layout, a social security number to one in the valid ranges. As the network
is a permutation for each key and format, equal values have equal pseudonyms in every document and different values of one format
never meet. Mail addresses, which have no fixed domain, become keyed digests. Everything happens within a row: no shuffle, and texts of
any length are rewritten whole. Every repetition in the pattern is possessive, so that a match of any length needs no stack.

The key comes in a table of one row (key_table), read by the tasks as a scalar subquery, so that plans and event logs show where it lies and not
what it is; digests are HMAC-SHA256 under it.

Defined results: null text stays null with no findings; a text without validated findings is returned as it was; repeated
rows and ids are kept; empty tables give empty results; other columns pass through unchanged whatever their names, but for one named
findings, which is replaced; a key table of no row or several raises.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Rounds of the network, an even number so that both halves change equally often.
ROUNDS = 8
#: Dates from EPOCH on that take part, as 250 x 292 days.
EPOCH, DAYS = "1900-01-01", (250, 292)
#: Valid social security numbers: areas 1 to 899 but 666, groups 1 to 99 and serials 1 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999

# The forms looked for, tried in this order at each place of a text.
FORMS = {
    "email": r"(?<![\p{L}\p{N}_%+.-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![\p{L}\p{N}+])\+[1-9]\d{0,2}+[ .-]?+\(\d{2,4}+\)[ .-]?+\d{3}[ .-]?+\d{4}(?!\d)"
    r"|(?<![\p{L}\p{N}+])\+1[ .-]?+[2-9]\d{2}[ .-]?+[2-9]\d{2}[ .-]?+\d{4}(?!\d)"
    r"|(?<![\p{L}\p{N}+])\+[2-9]\d{0,2}+[ .-]?+(?:\d{1,4}+|\(\d{1,4}+\))[ .-]?+\d{2,9}+(?:[.-]\d{2,5}+| \d{2,3}+(?!\d)){0,3}+(?!\d)"
    r"|(?<![\p{L}\d.-])(?:\([2-9]\d{2}\) ?+|[2-9]\d{2}[.-])[2-9]\d{2}[.-]\d{4}(?!-?\d)",
    "date": r"(?<!\d)(?<!\d[./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}|\d{2}\.\d{2}\.\d{4})(?![./-]?\d)",
    "ssn": r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?!-?\d)",
    "ip": r"(?<!\d)(?<!\d\.)\d{1,3}+\.\d{1,3}+\.\d{1,3}+\.\d{1,3}+(?!\.?\d)",
    "card": r"(?<![\p{L}\d])(?<!\d[.-])(?:\d{4}[ -]?+\d{4}[ -]?+\d{4}[ -]?+\d{1,7}+|\d{4}[ -]\d{6}[ -]\d{4,5}+)(?!-?\d)(?!\p{L})",
}
PATTERN = "|".join(f"(?:{x})" for x in FORMS.values())
#: What every form holds; texts without it are passed on at once.
HINT = r"@|\d[\d ()./-]{6}"

POWERS = [10**i for i in range(12)]


def key_table(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """Write a key at path in the cluster's storage and read it back as the table that pseudonymize takes: the two pads of HMAC-SHA256."""
    whole = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pads = {name: bytes(x ^ pad for x in whole).hex() for name, pad in (("inner", 0x36), ("outer", 0x5C))}
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/key.json")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(json.dumps(pads).encode()))
    finally:
        stream.close()
    return spark.read.schema("inner string, outer string").json(path).select(F.unhex("inner").alias("inner"), F.unhex("outer").alias("outer"))


def keyed_digest(key: Column, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal digits; key: struct of both pads."""
    inner = F.unhex(F.sha2(F.concat(key["inner"], F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(key["outer"], inner), 256)


def permute(left: Column, right: Column, a: Column, b: Column, key: Column, domain: Column) -> Column:
    """A keyed permutation of the pairs (left < a, right < b): each half in turn is shifted by a digest of the other."""

    def shift(half: Column, k: int) -> Column:
        digest = keyed_digest(key, F.concat(domain, F.lit(f"/{k}/"), half.cast("string")))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def rounds(pair: Column, k: int) -> Column:
        if k == ROUNDS:
            return pair
        own = lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + shift(p["l"], k), b).alias("r")) if k % 2 else F.struct(F.pmod(p["l"] + shift(p["r"], k), a).alias("l"), p["r"].alias("r"))
        return rounds(let(pair, own), k + 1)

    return rounds(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), 0)


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def permute_digits(digits: Column, key: Column, kind: str) -> Column:
    """A string of 2 to 22 digits to one of the same length; halves of their own lengths."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    power = lambda k: F.get(F.array(*(F.lit(x).cast("long") for x in POWERS)), k)
    done = permute(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n), power(u), power(n - u), key, F.concat(F.lit(kind), n.cast("string")))
    return let(done, lambda p: F.concat(F.lpad(p["l"].cast("string"), u, F.lit("0")), F.lpad(p["r"].cast("string"), n - u, F.lit("0"))))


def check_digit(payload: Column) -> Column:
    """The Luhn digit that completes a number."""
    doubled = lambda c, j: let(c.cast("int") * F.when(j % 2 == 0, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0))
    total = F.aggregate(F.transform(F.regexp_extract_all(F.reverse(payload), F.lit(r"\d"), F.lit(0)), doubled), F.lit(0), lambda s, d: s + d)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def lay_out(form: Column, digits: Column) -> Column:
    """The digits in the places that digits have in form."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    put = lambda acc, ch: F.when(ch.between("0", "9"), F.struct(F.concat(acc["s"], F.substring(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["s"], ch).alias("s"), acc["k"].alias("k")))
    return F.aggregate(F.regexp_extract_all(form, F.lit("."), F.lit(0)), start, put, lambda acc: acc["s"])


def kind_of(match: Column) -> Column:
    shape = lambda p: match.rlike(f"^(?:{p})$")
    return (
        F.when(match.contains("@"), "email")
        .when(shape(r"\d{4}([-/.])\d{2}\1\d{2}|\d{2}\.\d{2}\.\d{4}"), "date")
        .when(match.startswith("+") | match.startswith("(") | shape(r"\d{3}[.-]\d{3}[.-]\d{4}"), "phone")
        .when(shape(r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(match.contains("."), "ip")
        .otherwise("card")
    )


def _padded(number: Column, digits: int) -> Column:
    return F.lpad(number.cast("string"), digits, "0")


def pseudonym(match: Column, key: Column) -> Column:
    """struct(kind, value, tail) of one match of PATTERN: the pseudonym, null where it doesn't validate, and what of the match follows it."""
    bare = F.regexp_replace(match, r"\D", "")

    # an address ends with the last label that begins with two letters, and with these letters if others follow
    labels = F.split(F.substring_index(match, "@", -1), r"\.")
    told = lambda ls: F.array_max(F.filter(F.sequence(F.lit(1), F.size(ls) - 1), lambda k: F.get(ls, k).rlike("^[A-Za-z]{2}")))
    kept = let(labels, lambda ls: let(told(ls), lambda k: F.concat(F.array_join(F.slice(ls, F.lit(1), k), "."), F.lit("."), F.regexp_extract(F.get(ls, k), "^[A-Za-z]+", 0))))
    whole = F.concat(F.substring_index(match, "@", 1), F.lit("@"), kept)
    email = let(whole, lambda m: F.struct(F.concat(F.lit("u"), F.substring(keyed_digest(key, F.concat(F.lit("email/"), F.lower(m))), 1, 14), F.lit("@pseudonym.invalid")).alias("value"), F.substring(match, F.length(m) + 1, F.length(match)).alias("tail")))

    # the country code goes up to the first sign behind it, or is 1, 7 or two digits; the rest is permuted in its layout
    country = F.coalesce(F.nullif(F.regexp_extract(match, r"^\+\d{1,3}(?!\d)", 0), F.lit("")), F.regexp_extract(match, r"^\+(?:[17]|\d{2})", 0))
    rest = F.substring(match, F.length(country) + 1, F.length(match))
    phone = F.when(F.length(bare).between(8, 15), F.concat(country, lay_out(rest, permute_digits(F.regexp_replace(rest, r"\D", ""), key, "phone"))))

    area, group, serial = (F.substring(match, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = permute(area - F.when(area > 666, 2).otherwise(1), (group - 1) * SERIALS + serial - 1, F.lit(AREAS), F.lit(GROUPS * SERIALS), key, F.lit("ssn"))
    ssn = F.when(valid, let(moved, lambda p: F.concat_ws("-", _padded(p["l"] + F.when(p["l"] > 664, 2).otherwise(1), 3), _padded(_div(p["r"], F.lit(SERIALS)) + 1, 2), _padded(F.pmod(p["r"], F.lit(SERIALS)) + 1, 4))))

    german = match.rlike(r"^\d{2}\.")
    parsed = F.when(german, F.try_to_date(match, "dd.MM.yyyy")).otherwise(F.try_to_date(F.translate(match, "/.", "--"), "yyyy-MM-dd"))
    day = F.datediff(parsed, F.lit(EPOCH).cast("date")).cast("long")
    size = DAYS[0] * DAYS[1]
    layout = F.when(german, "date dmy").otherwise("date")
    to = lambda d: permute(_div(d, F.lit(DAYS[1])), F.pmod(d, F.lit(DAYS[1])), F.lit(DAYS[0]), F.lit(DAYS[1]), key, layout)
    shown = lambda x: F.when(german, F.date_format(x, "dd.MM.yyyy")).otherwise(F.regexp_replace(x.cast("string"), "-", F.substring(match, 5, 1)))
    date = let(day, lambda d: F.when(d.between(0, size - 1), let(F.date_add(F.lit(EPOCH).cast("date"), let(to(d), lambda p: (p["l"] * DAYS[1] + p["r"]).cast("int"))), shown)))

    octets = F.split(match, r"\.").cast("array<int>")
    address = let(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), let(permute(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip")), lambda p: F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (_div(p[h], F.lit(256)), F.pmod(p[h], F.lit(256))))))))

    payload = F.substring(bare, F.lit(1), F.length(bare) - 1)
    numbered = let(permute_digits(payload, key, "card"), lambda p: lay_out(match, F.concat(p, check_digit(p))))
    card = F.when(F.length(bare).between(13, 19) & (check_digit(payload) == F.substring(bare, F.length(bare), F.lit(1))), numbered)

    kind = kind_of(match)
    alone = F.when(kind == "phone", phone).when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "ip", address).otherwise(card)
    done = F.when(kind == "email", email).otherwise(F.struct(alone.alias("value"), F.lit("").alias("tail")))
    return let(done, lambda d: F.struct(kind.alias("kind"), d["value"].alias("value"), d["tail"].alias("tail")))


def pseudonymize(docs: DataFrame, key: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text rewritten and a column findings: (kind, pseudonym) of every validated match, in order. key: as key_table gives it."""
    taken = {c.lower() for c in docs.columns}
    own, hidden = (next(n for k in range(len(taken) + 1) if (n := f"__{name}{k}") not in taken) for name in ("found", "key"))
    text = F.col(f"`{text_col}`").cast("string")
    none = F.array().cast("array<struct<kind:string,value:string,tail:string,was:string>>")
    each = lambda m: let(pseudonym(m, F.col(hidden)), lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("value"), p["tail"].alias("tail"), m.alias("was")))
    found = F.when(text.rlike(HINT), F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), each)).otherwise(none)
    marked = docs.withColumn(hidden, key.select(F.struct("inner", "outer")).scalar()).withColumn(own, found)
    gaps = F.split(text, PATTERN, -1)
    put = F.array_join(F.zip_with(gaps, F.col(own), lambda gap, m: F.concat(gap, F.coalesce(F.concat(m["value"], m["tail"]), m["was"], F.lit("")))), "")
    right = F.filter(own, lambda m: m["value"].isNotNull())
    return marked.withColumns({
        text_col: F.when(F.size(right) > 0, put).otherwise(text),
        "findings": F.transform(right, lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("pseudonym"))),
    }).drop(own, hidden)
