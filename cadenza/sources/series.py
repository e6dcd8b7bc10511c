"""Series and fact tables: scans, unpivoting wide rows, membership digests, sinks."""

from __future__ import annotations

import json
import platform
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "tier int, series string, configuration string, implementation string, metric string, value double, unit string"


def read_csv(spark: SparkSession, path: str, series_id: str | None = None, schema: str = "ds timestamp_ntz, y double") -> DataFrame:
    """A CSV of one series, or of many with their own series_id column in ``schema``."""
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows if series_id is None else rows.withColumn("series_id", F.lit(series_id))


def unpivot(wide: DataFrame, id_col: str, values: list[str], start: Column, step_days: int) -> DataFrame:
    """series_id, ds, y from one row a series: the k-th value belongs to start + k steps; nulls and NaN are dropped."""
    packed = F.array(*[F.col(f"`{v}`").cast("double") for v in values])
    rows = wide.select(F.col(id_col).alias("series_id"), F.to_date(start).alias("_start"), F.posexplode(packed).alias("_k", "y"))
    rows = rows.where(F.col("y").isNotNull() & ~F.isnan("y"))
    return rows.select("series_id", F.date_add("_start", F.col("_k") * step_days).cast("timestamp_ntz").alias("ds"), "y")


def membership_digest(members: DataFrame) -> DataFrame:
    """frequency, n, digest: SHA-256 of the sorted ids, one a line; an edited member list has another digest."""
    ids = F.sort_array(F.collect_list(F.col("series_id").cast("string")))
    return members.groupBy("frequency").agg(F.count("*").alias("n"), F.sha2(F.array_join(ids, "\n").cast("binary"), 256).alias("digest"))


def check_digest(members: DataFrame, expected: dict[str, str]) -> None:
    found = {r.frequency: r.digest for r in membership_digest(members).collect()}
    if found != expected:
        raise ValueError(f"the member list differs from its digest: {sorted(k for k in found.keys() | expected.keys() if found.get(k) != expected.get(k))}")


def manifest_digest(members: DataFrame) -> DataFrame:
    """n and digest of a whole member list (frequency, series_id): SHA-256 of the sorted lines frequency:id. A member list, not a corpus of rows: it makes
    one row."""
    lines = F.sort_array(F.collect_list(F.struct(F.col("frequency").cast("string").alias("frequency"), F.col("series_id").cast("string").alias("series_id"))))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x["frequency"], F.lit(":"), x["series_id"])), "\n")
    return members.agg(F.count("*").alias("n"), F.sha2(text.cast("binary"), 256).alias("digest"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """frequency and series_id of a JSON manifest ({"digest": ..., "series": {frequency: [ids]}}); raises if its members don't have its digest."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "digest string, series map<string,array<string>>").alias("x"))
    members = raw.select(F.explode("x.series").alias("frequency", "ids")).select("frequency", F.explode("ids").alias("series_id"))
    want, found = raw.select("x.digest").first()[0], manifest_digest(members).first().digest
    if want != found:
        raise ValueError(f"the manifest has been edited: its digest says {str(want)[:12]}, its contents hash to {found[:12]}")
    return members


def write_manifest(members: DataFrame, path: str) -> None:
    """The JSON manifest of a member list, as one text file in a folder."""
    lists = members.groupBy("frequency").agg(F.sort_array(F.collect_list(F.col("series_id").cast("string"))).alias("ids"))
    series = lists.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("frequency", "ids")))).alias("series"))
    rows = series.crossJoin(F.broadcast(manifest_digest(members).select("digest")))  # one row by one row
    rows.select(F.to_json(F.struct("digest", "series")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def exclusions(series: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """stage, rule, n_excluded, n_left: how many rows each rule, in their order, leaves of those that the rules before it left. A null verdict excludes."""
    kept, cols = F.lit(True), []
    for name, rule in rules.items():
        now = kept & F.coalesce(rule, F.lit(False))
        cols.append(F.struct(F.lit(len(cols)).cast("long").alias("stage"), F.lit(name).alias("rule"), F.count_if(kept & ~now).alias("n_excluded"), F.count_if(now).alias("n_left")))
        kept = now
    return series.agg(*[c.alias(f"s{k}") for k, c in enumerate(cols)]).select(F.explode(F.array(*[F.col(f"s{k}") for k in range(len(cols))])).alias("x")).select("x.*")


def census(series: DataFrame, members: DataFrame) -> DataFrame:
    return series.join(members.select("series_id").distinct(), "series_id", "left_semi")


def sample_series(series: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` series per frequency of (series_id, frequency), the same whatever the partitioning: those with the smallest keyed numbers."""
    from pyspark.sql import Window

    from ..functions.expressions import uniform

    order = Window.partitionBy("frequency").orderBy(uniform(F.lit(seed), F.col("series_id")), "series_id")
    rows = series.select("series_id", "frequency").distinct().withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= n).select("frequency", "series_id")


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of one list only, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))


def profile(starts: DataFrame) -> DataFrame:
    """Per frequency of (series_id, frequency, start): counts, distinct starts, the most common start (the earliest of equals) and its count."""
    by = starts.groupBy("frequency", "start").agg(F.count("*").alias("n"))
    return by.groupBy("frequency").agg(F.sum("n").alias("n_series"), F.count("*").alias("n_starts"), F.max_by("start", F.struct("n", -F.datediff("start", F.lit("1970-01-01").cast("date")))).alias("modal_start"), F.max("n").alias("modal_count"))


def write_facts(facts: DataFrame, path: str, **extra: object) -> None:
    """Sorted CSV parts and, beside them, a JSON line of metadata."""
    order = ["tier", "series", "configuration", "implementation", "metric"]
    facts.select(*[c.split(" ")[0] for c in FACTS.split(", ")]).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(f"{path}/facts", header=True)
    meta = {"written": datetime.now().isoformat(timespec="seconds"), "python": platform.python_version(), "spark": facts.sparkSession.version} | extra
    facts.sparkSession.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(f"{path}/facts", header=True, schema=FACTS)


def replace_rows(facts: DataFrame, new: DataFrame, configuration: str) -> DataFrame:
    """The facts with one configuration's rows replaced, e.g. summaries made again without fitting."""
    return facts.where(F.col("configuration") != configuration).unionByName(new)


def write_checkpoint(facts: DataFrame, path: str) -> None:
    """Appends the facts of a part of a run; what is committed there need not be measured again."""
    facts.select(*[c.split(" ")[0] for c in FACTS.split(", ")]).write.mode("append").parquet(path)


def checkpointed(spark: SparkSession, path: str) -> DataFrame | None:
    """Series already measured by an interrupted run, for an anti-join."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(FACTS).parquet(path).select(F.col("series").alias("series_id")).distinct()
    except AnalysisException:
        return None


def generate(spark: SparkSession, truths: DataFrame, seed: int = 0) -> DataFrame:
    """Forward simulation: series_id, ds, y from (series_id, start, rows, k, m, delta, changepoints_t, amplitude, period, sigma) with keyed noise."""
    from ..functions.expressions import linear_trend, normal

    rows = truths.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("t", F.col("i") / (F.col("rows") - 1))
    wave = F.col("amplitude") * F.sin(F.lit(6.283185307179586) * F.col("i") / F.col("period"))
    y = linear_trend(F.col("t"), F.col("k"), F.col("m"), F.col("delta"), F.col("changepoints_t")) + wave + F.col("sigma") * normal(F.lit(seed), F.col("series_id"), F.col("i"))
    return rows.select("series_id", F.date_add("start", F.col("i")).cast("timestamp_ntz").alias("ds"), y.alias("y"))
