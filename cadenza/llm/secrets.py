"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models over 63 character classes are counted from labelled samples, one of random strings and one of ordinary
identifiers; a candidate string's log-likelihood ratio is the sum over its character pairs. Strings far on the random side
become spans beside those of the patterns. Counting, scoring and locating are DataFrame expressions; only the
63 x 63 pair counts reach the driver.

Positions: ``split`` gives the text between matches and ``regexp_extract_all`` the matches, so starts are running sums
of their lengths, taken block by block so that a text with very many matches stays far from quadratic cost.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import own_names

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 12

_CHARS = string.ascii_lowercase + string.ascii_uppercase + string.digits
CLASSES = len(_CHARS) + 1
_CLASS_OF = [_CHARS.index(chr(c)) if chr(c) in _CHARS else CLASSES - 1 for c in range(128)]
_INT_ARRAY = "array(" + ",".join(map(str, _CLASS_OF)) + ")"


@dataclass(frozen=True)
class Scan:
    """Candidates are runs of ``[A-Za-z0-9+/_=-]`` of at least ``least`` characters. A candidate is a secret if its log-likelihood ratio
    reaches ``total`` and ``mean`` a pair. Ordinary identifiers are counted from about ``sample_docs`` documents, chosen by a hash of
    their ids, texts of at most ``sample_longest`` characters; ``sample_random`` random strings are made."""

    least: int = 16
    total: float = 25.0
    mean: float = 2.5
    sample_docs: int = 2000
    sample_longest: int = 20_000
    sample_random: int = 3000
    smooth: float = 0.5

    @property
    def candidate(self) -> str:
        return rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{self.least},}}"


def _class(c: Column) -> Column:
    code = F.ascii(c)
    return F.coalesce(F.get(F.expr(_INT_ARRAY), F.when(code < 128, code).otherwise(32)), F.lit(CLASSES - 1))


def _pairs(chars: Column) -> Column:
    """Pair numbers of the neighbours in an array of characters."""
    codes = F.transform(chars, _class)
    n = F.size(chars)
    return F.zip_with(F.slice(codes, 1, F.greatest(n - 1, F.lit(0))), F.slice(codes, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a * CLASSES + b)


def _chars(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all character pairs from (token, secret): log P(next | previous, random) - log P(next | previous, ordinary). What follows a
    character is mixed with the single characters' shares, so that a pair never seen counts by how rare its second character is.

    Null tokens and labels are ignored; without samples every ratio is 0.
    """
    words = samples.where("token is not null and secret is not null").groupBy("secret", "token").agg(F.count("*").alias("times"))  # a word's pairs are taken once
    pairs = words.select("secret", "times", F.explode(_pairs(_chars(F.col("token")))).alias("pair"))
    counts = {(bool(r.secret), r.pair): r.n for r in pairs.groupBy("secret", "pair").agg(F.sum("times").alias("n")).collect()}
    follow: dict[bool, list[list[float]]] = {}
    for y in (True, False):
        table = [[counts.get((y, a * CLASSES + b), 0) for b in range(CLASSES)] for a in range(CLASSES)]
        alone = [sum(row[b] for row in table) + smooth for b in range(CLASSES)]
        alone = [n / sum(alone) for n in alone]
        weight = smooth * CLASSES  # of the single characters' shares among what follows a character, so that a rare one says as little as it should
        follow[y] = [[(row[b] + weight * alone[b]) / (sum(row) + weight) for b in range(CLASSES)] for row in table]
    return [math.log(follow[True][a][b]) - math.log(follow[False][a][b]) for a in range(CLASSES) for b in range(CLASSES)]


def random_strings(spark, n: int) -> DataFrame:
    """Labelled random strings made from digests: hex, base64 and base64's capitals in turn, so that these alphabets are known."""
    digest = F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256))
    plain = F.regexp_replace(F.base64(digest), "=+$", "")
    token = F.when(F.col("id") % 3 == 1, plain).when(F.col("id") % 3 == 2, F.upper(plain)).otherwise(F.lower(F.hex(digest)))
    return spark.range(n).select(token.alias("token"), F.lit(True).alias("secret"))


def ordinary(docs: DataFrame, scan: Scan) -> DataFrame:
    """Labelled ordinary identifiers: the words of a bounded sample of documents without a base match, those too short to be candidates, as random
    strings among them would pass for ordinary."""
    every = max(1, docs.count() // scan.sample_docs)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).where("text is not null").where(F.length("text") <= scan.sample_longest)  # the sample first: patterns cost most
    some = some.where(~F.col("text").rlike(ASSIGN) & ~F.col("text").rlike(ACCESS) & ~F.col("text").rlike(HEX)).select("text")
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("token"))
    return words.where(F.length("token") < scan.least).select("token", F.lit(False).alias("secret"))


_INTS = "array<int>"


def running_sums(rows: DataFrame, lengths: str, out: str) -> DataFrame:
    """Adds ``out``: the sums of all earlier elements of a column, in blocks of the square root of its size.

    Each step is a column of its own: an array written inside a lambda would be made again for every element.
    """
    own, n = own_names(rows), F.size(lengths)
    each, blocks, bases = map(own, ("width", "blocks", "bases"))
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    rows = rows.withColumn(each, width)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / F.col(each)).cast("int"))).otherwise(F.array().cast(_INTS))
    rows = rows.withColumn(blocks, F.transform(starts, lambda b: F.slice(lengths, b * F.col(each) + 1, F.col(each))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_INTS).alias("out"))
    scan = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    rows = rows.withColumn(bases, scan(F.transform(blocks, total)))
    sums = F.zip_with(bases, blocks, lambda base, xs: F.transform(scan(xs), lambda x: x + base))
    return rows.withColumn(out, F.flatten(sums)).drop(each, blocks, bases)


def locate(rows: DataFrame, text: Column, pattern: str, out: str, group: int = 0) -> DataFrame:
    """Adds ``out``: array<struct<s, e, v>> of the leftmost non-overlapping matches, code point offsets (end exclusive) and a group."""
    own = own_names(rows)
    found, gaps, sizes, steps, before, values = map(own, ("found", "gaps", "sizes", "steps", "before", "values"))
    none = F.array().cast("array<string>")
    every = lambda k: F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(k))).otherwise(none)
    rows = rows.withColumn(found, every(0))
    n = F.size(found)
    rows = rows.withColumn(gaps, F.when(n > 0, F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), 1, n)).otherwise(F.array().cast(_INTS)))
    rows = rows.withColumn(sizes, F.transform(found, lambda x: F.length(x)))
    rows = rows.withColumn(steps, F.zip_with(gaps, sizes, lambda a, b: a + b))
    rows = running_sums(rows, steps, before)
    rows = rows.withColumn(values, F.col(found) if group == 0 else F.when(n > 0, every(group)).otherwise(none))
    zipped = F.arrays_zip(F.col(before).alias("b"), F.col(gaps).alias("g"), F.col(sizes).alias("n"), F.col(values).alias("v"))
    spans = F.transform(zipped, lambda x: F.struct((x["b"] + x["g"]).alias("s"), (x["b"] + x["g"] + x["n"]).alias("e"), x["v"].alias("v")))
    return rows.withColumn(out, spans).drop(found, gaps, sizes, steps, before, values)


def scan_secrets(docs: DataFrame, ratios: list[float], scan: Scan = Scan()) -> DataFrame:
    """Every row and column of ``docs`` (text among them) plus spans: array of (start, kind, end), by start, then kind as in ``KINDS``.

    Offsets count code points, end exclusive. Null texts count as empty. Strings found by the models that touch a base
    span are left out. An existing column spans is replaced. One pass; no shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop("spans")
    own = own_names(docs)
    assign, access, hex_, random, base_ = map(own, ("assign", "access", "hex", "random", "base"))
    rows = locate(docs, text, ASSIGN, assign, 2)
    rows = rows.withColumn(assign, F.filter(assign, lambda x: F.length(x["v"]) >= LEAST_VALUE))
    rows = locate(locate(locate(rows, text, ACCESS, access), text, HEX, hex_), text, scan.candidate, random)
    matrix = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # one literal, folded once
    score = lambda token: F.aggregate(_pairs(_chars(token)), F.lit(0.0), lambda acc, p: acc + F.get(matrix, p))
    limit = lambda token: F.greatest(F.lit(scan.total), F.lit(scan.mean) * (F.length(token) - 1))
    rows = rows.withColumn(random, F.filter(random, lambda x: score(x["v"]) >= limit(x["v"])))
    kind = lambda c, k: F.transform(c, lambda x: F.struct(x["s"].cast("long").alias("start"), F.lit(k).alias("kind"), x["e"].cast("long").alias("end")))
    base = F.concat(kind(assign, 0), kind(access, 1), kind(hex_, 2))
    rows = rows.withColumn(base_, F.sort_array(base))
    extra = F.filter(kind(random, 3), lambda x: ~F.exists(base_, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    rows = rows.withColumn("spans", F.sort_array(F.concat(base_, extra)))
    return rows.drop(assign, access, hex_, random, base_)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """Trains on random strings and on the table's own ordinary identifiers, then scans every text."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    samples = random_strings(docs.sparkSession, scan.sample_random).unionByName(ordinary(docs, scan))
    found = scan_secrets(docs, train(samples, scan.smooth), scan)
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
