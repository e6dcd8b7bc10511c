"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted into cells (source, language, topic). Raking scales the cells' sampling
probabilities in turn so that the expected tokens of every source, language and topic meet their targets; a
probability never passes 1, and what a full cell can't give is taken up by the others in later rounds. Each document is then kept if
a hash of its id, uniform in [0, 1), lies below its cell's probability: the same documents whatever
the partitioning, and more of them, never others, if a probability rises.

Only one row a cell is gathered. Up to ``MOST_CELLS`` cells are raked on the driver; more are raked as DataFrames by the same rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import own_names, stored

MOST_CELLS = 100_000
AXES = ("source", "lang", "topic")
_UNKNOWN = "unknown"


@dataclass(frozen=True)
class Mix:
    """``shares`` names an axis's target shares; categories it doesn't name keep their relative sizes within ``rest``, the
    share left over. An axis without shares gets its observed shares raised to ``temperature[axis]`` (1: as they are).
    ``budget`` is the expected fraction of all tokens kept."""

    budget: float = 0.8
    temperature: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.9, "topic": 1.0})
    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = 100
    tolerance: float = 1e-7
    seed: int = 17


def _shape(docs: DataFrame, topic_col: Column | None) -> tuple[Column, Column, Column, Column]:
    """source, lang, topic and word count of a row. A table without topics gets one made by rule from the shape of the text."""
    text = F.col("text").cast("string")
    n = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    own = topic_col if topic_col is not None else F.col("topic") if "topic" in docs.columns else None
    if own is None:
        lines = F.coalesce(F.regexp_count(text, F.lit("\n")), F.lit(0)) + 1
        own = F.when(n < 50, "brief").when(n < 6 * lines, "listing").when(n >= 2000, "long").otherwise("prose")
    known = lambda c: F.coalesce(c.cast("string"), F.lit(_UNKNOWN))
    return known(F.col("source")), known(F.col("lang")), known(own), n


def counted(docs: DataFrame, topic_col: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens. Null categories are ``unknown``; null and empty texts have 0 tokens."""
    source, lang, topic, n = _shape(docs, topic_col)
    return docs.select("doc_id", source.alias("source"), lang.alias("lang"), topic.alias("topic"), n.alias("n_tokens"))


def targets(totals: dict[str, float], axis: str, mix: Mix) -> dict[str, float]:
    """Expected tokens of each category of one axis."""
    everything = sum(totals.values())
    named = {k: v for k, v in mix.shares.get(axis, {}).items() if totals.get(k, 0) > 0}
    rest = {k: v for k, v in totals.items() if k not in named}
    shares = dict(named)
    power = 1.0 if named else mix.temperature.get(axis, 1.0)
    scale = sum(v**power for v in rest.values() if v > 0)
    left = max(0.0, 1.0 - sum(named.values()))
    shares |= {k: (left * v**power / scale if v > 0 else 0.0) for k, v in rest.items()}
    whole = sum(shares.values()) or 1.0
    return {k: v / whole * mix.budget * everything for k, v in shares.items()}


def rake(codes: np.ndarray, tokens: np.ndarray, wanted: list[np.ndarray], mix: Mix) -> np.ndarray:
    """Probabilities of cells: codes (cells x axes) index each axis's ``wanted`` tokens."""
    p = np.full(len(tokens), min(1.0, mix.budget))
    for _ in range(mix.rounds):
        before = p.copy()
        for axis, want in enumerate(wanted):
            have = np.bincount(codes[:, axis], p * tokens, len(want))
            p = np.minimum(1.0, p * np.divide(want, have, out=np.ones(len(want)), where=have > 0)[codes[:, axis]])
        if np.abs(p - before).max(initial=0) < mix.tolerance:
            break
    return p


def _rake_cells(cells: DataFrame, mix: Mix) -> DataFrame:
    rows = cells.orderBy(*AXES).collect()
    tokens = np.array([r.tokens for r in rows], float)
    codes, wanted = [], []
    for axis in AXES:
        names = sorted({r[axis] for r in rows})
        at = {n: k for k, n in enumerate(names)}
        code = np.array([at[r[axis]] for r in rows], np.int64)
        want = targets(dict(zip(names, np.bincount(code, tokens, len(names)), strict=True)), axis, mix)
        codes.append(code)
        wanted.append(np.array([want[n] for n in names]))
    p = rake(np.stack(codes, 1), tokens, wanted, mix)
    return cells.sparkSession.createDataFrame(pa.table({a: pa.array([r[a] for r in rows], pa.string()) for a in AXES} | {"probability": pa.array(p, pa.float64())}))


def _wanted(sums: DataFrame, axis: str, mix: Mix) -> DataFrame:
    """``targets`` as a DataFrame (axis, want), from (axis, t): for any number of categories."""
    everything = sums.agg(F.sum("t")).first()[0] or 0
    named = mix.shares.get(axis, {})
    present = {r[0] for r in sums.where(F.col(axis).isin(list(named)) & (F.col("t") > 0)).select(axis).collect()} if named else set()
    named = {k: v for k, v in named.items() if k in present}
    power = 1.0 if named else mix.temperature.get(axis, 1.0)
    share = F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(0.0)
    rest = sums.where(~F.col(axis).isin(list(named))) if named else sums
    scale = rest.agg(F.sum(share)).first()[0] or 1.0
    raw = F.lit(max(0.0, 1.0 - sum(named.values()))) * share / scale
    for k, v in named.items():
        raw = F.when(F.col(axis) == k, F.lit(float(v))).otherwise(raw)
    sums = sums.withColumn("share", raw)
    whole = sums.agg(F.sum("share")).first()[0] or 1.0
    return sums.select(axis, (F.col("share") * (mix.budget * everything / whole)).alias("want"))


def _rake_frames(cells: DataFrame, mix: Mix) -> DataFrame:
    """The same rule for any number of cells: marginals are aggregates, factors are joined; each round cuts the lineage."""
    wants = [stored(_wanted(cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("t")), axis, mix), "targets") for axis in AXES]
    now = stored(cells.withColumn("p", F.lit(min(1.0, mix.budget))), "cells")
    for _ in range(mix.rounds):
        new = now.withColumn("old", F.col("p"))
        for axis, want in zip(AXES, wants, strict=True):
            have = new.groupBy(axis).agg(F.sum(F.col("p") * F.col("tokens")).alias("have")).join(want, axis)
            factor = have.select(axis, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0).alias("factor"))
            new = new.join(factor, axis).withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col("factor"))).drop("factor")
        new = stored(new, "cells")
        moved = new.agg(F.max(F.abs(F.col("p") - F.col("old")))).first()[0] or 0.0
        now = new.drop("old")
        if moved < mix.tolerance:
            break
    return now.select(*AXES, F.col("p").alias("probability"))


def probabilities(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row a cell of ``counted`` rows: source, lang, topic, probability."""
    cells = stored(rows.groupBy(*AXES).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "cells")
    if cells.count() > MOST_CELLS:
        return _rake_frames(cells, mix)
    return F.broadcast(_rake_cells(cells, mix))


def uniform(doc_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from an id, the same in any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def mixed(docs: DataFrame, mix: Mix = Mix(), topic_col: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept for every row of ``docs`` (doc_id, text, source, lang).

    Rows with equal ids share their draw. Cells without tokens have the budget as probability. Columns of other names are ignored, but a column
    topic is used as it is. An empty table gives an empty result.
    """
    rows = stored(counted(docs, topic_col), "counted")
    out = rows.join(probabilities(rows, mix), list(AXES))
    return out.withColumn("kept", uniform(F.col("doc_id"), mix.seed) < F.col("probability")).select("doc_id", *AXES, "n_tokens", "probability", "kept")


def sampled(docs: DataFrame, mix: Mix = Mix(), topic_col: Column | None = None) -> DataFrame:
    """The rows of ``docs``, unchanged, that the mixture keeps. The texts are read twice instead of shuffled."""
    kept = probabilities(counted(docs, topic_col), mix)
    source, lang, topic, _ = _shape(docs, topic_col)
    own = own_names(docs)
    cell = F.struct(source.alias("source"), lang.alias("lang"), topic.alias("topic"))
    table = kept.select(F.struct(*AXES).alias(own("cell")), F.col("probability").alias(own("probability")))
    out = docs.withColumn(own("cell"), cell).join(table, own("cell"))
    return out.where(uniform(F.col("doc_id"), mix.seed) < F.col(own("probability"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def marginals(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """What the mixture reaches, from rows of ``mixed``: axis, category, tokens, wanted, expected (tokens), gap (expected / wanted - 1, null where
    nothing is wanted). A gap stays where probabilities have come to 1, or where no weighting meets all targets."""
    long = rows.select("n_tokens", "probability", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("category")) for a in AXES])).alias("x"))
    sums = stored(long.groupBy("x.axis", "x.category").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected")), "marginals")
    wanted = None
    for axis in AXES:
        own = _wanted(sums.where(F.col("axis") == axis).select(F.col("category").alias(axis), F.col("tokens").cast("double").alias("t")), axis, mix)
        own = own.select(F.lit(axis).alias("axis"), F.col(axis).alias("category"), F.col("want").alias("wanted"))
        wanted = own if wanted is None else wanted.unionByName(own)
    return sums.join(wanted, ["axis", "category"]).select("axis", "category", "tokens", "wanted", "expected", (F.col("expected") / F.nullif("wanted", F.lit(0.0)) - 1.0).alias("gap"))
