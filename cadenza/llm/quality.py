"""Quality rules as a bitmask ledger.

Every rule is evaluated once: its measurement becomes a column and its failure one bit of ``failures``. Policies are
versioned sets of bits, so applying one is a bitwise AND, and ablations (what would be kept without a rule, which
rule alone rejects a document) are bitwise aggregates over the ledger; the texts aren't read again.

Everything is a DataFrame expression. Repeated windows are found inside a row: each 5-word window gives one long
whose upper bits are a hash and whose lower bits are its position; sorted longs bring equal windows side by side.
Windows so found are then compared as text, so a hash can't decide. All steps are linear or a sort in
the length of one text, and no row is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import own_names

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
_POSITION_BITS = 31
_POSITION = (1 << _POSITION_BITS) - 1


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    Words are ``[^\\x20\\x09-\\x0D]+``; null, empty and blank texts have none. Existing columns of these names are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = own_names(docs)
    words, lines, sorted_, alike, texts, starts = map(own, ("words", "lines", "sorted", "alike", "texts", "starts"))
    rows = docs.withColumn(words, F.filter(F.split(text, SPACE), lambda w: w != ""))
    rows = rows.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(words)
    at = lambda i: F.get(words, i)
    window_key = F.transform(
        F.when(n > WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.shiftleft(F.xxhash64(*[at(i + k) for k in range(WINDOW)]), _POSITION_BITS).bitwiseOR(i.cast("long")),
    )
    rows = rows.withColumn(sorted_, F.sort_array(F.transform(window_key, lambda x: F.coalesce(x, F.lit(0).cast("long")))))
    rows = rows.withColumn(alike, _alike(sorted_, lambda x: F.shiftright(x, _POSITION_BITS), lambda x: x.bitwiseAND(F.lit(_POSITION).cast("long")).cast("int")))
    rows = rows.withColumn(texts, F.when(F.size(alike) > 0, F.sort_array(F.transform(alike, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    rows = rows.withColumn(starts, F.sort_array(_alike(texts, lambda x: x["w"], lambda x: x["i"])))
    gap = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size(starts) > 0, F.aggregate(gap, F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(0)
    long = lambda c: c.cast("long")
    return rows.withColumns(
        {
            "n_words": long(n),
            "word_chars": long(F.length(F.array_join(words, ""))),
            "n_symbols": long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))),
            "n_lines": long(F.size(lines)),
            "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
            "n_repeat_words": long(covered),
        }
    ).drop(words, lines, sorted_, alike, texts, starts)


def _alike(column: str, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """Values of the elements of a sorted array whose key equals a neighbour's."""
    c = F.col(column)
    pick = lambda x, i: ((i > 0) & (key(F.get(c, i - 1)) == key(x))) | ((i < F.size(c) - 1) & (key(F.get(c, i + 1)) == key(x)))
    return F.transform(F.filter(c, lambda x, i: F.coalesce(pick(x, i), F.lit(False))), value)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


#: The order is the bit order and never changes; new rules are added at the end.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: _c("n_words") < 10),
    Rule("repeated_windows", lambda: 100 * _c("n_repeat_words") > 20 * _c("n_words")),
    Rule("short_words", lambda: _c("word_chars") < 2 * _c("n_words")),
    Rule("long_words", lambda: _c("word_chars") > 20 * _c("n_words")),
    Rule("symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("repeated_lines", lambda: 100 * _c("n_dup_lines") > 30 * _c("n_lines")),
)


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def mask(*names: str) -> int:
    return sum(bit(n) for n in names)


#: Version: the rules that reject a document. Versions are never changed, only added.
POLICIES: dict[int, int] = {
    1: mask("few_words", "repeated_windows"),
    2: mask("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines"),
}
BASE, LATEST = 1, 2


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements and failures, one bit a rule."""
    rows = measured(docs)
    bits = [F.when(r.fails(), F.lit(bit(r.name))).otherwise(F.lit(0)).cast("long") for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return rows.withColumn("failures", out)


def passes(version: int = LATEST) -> Column:
    """A ledger row's verdict under a policy."""
    return F.col("failures").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablations(rows: DataFrame, version: int = LATEST) -> DataFrame:
    """One row a rule of the policy: rule, n_failed, n_sole (rejected by this rule alone), n_kept_without. An empty ledger gives zeros."""
    policy = POLICIES[version]
    f = F.col("failures").bitwiseAND(F.lit(policy).cast("long"))
    own = [r for r in RULES if bit(r.name) & policy]
    count = lambda c: F.count_if(c)
    aggs = []
    for r in own:
        b = F.lit(bit(r.name)).cast("long")
        aggs += [count(f.bitwiseAND(b) != 0).alias(f"f_{r.name}"), count(f == b).alias(f"s_{r.name}"), count(f.bitwiseAND(F.lit(policy & ~bit(r.name)).cast("long")) == 0).alias(f"k_{r.name}")]
    one = rows.agg(*aggs)
    table = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f_{r.name}").alias("n_failed"), F.col(f"s_{r.name}").alias("n_sole"), F.col(f"k_{r.name}").alias("n_kept_without")) for r in own])
    return one.select(F.explode(table).alias("x")).select("x.*")


def failure_patterns(rows: DataFrame) -> DataFrame:
    """How many documents show each combination of failures: a table of at most 2^rules rows that answers any policy."""
    return rows.groupBy("failures").agg(F.count("*").alias("n_docs"))
