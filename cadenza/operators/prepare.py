"""History preparation: cleaning, checks, per-series statistics, scaling, seasonality selection, changepoints, initial points.

A history is a DataFrame (series_id, ds, y, ...). Series are prepared together: statistics are one aggregate over
series_id, and rows get them back by a join on it, which Spark turns into a broadcast where they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from .. import constants as C
from ..functions.expressions import DAY, micros
from ..spec import ModelSpec


def by_series(*order: str) -> Window:
    return Window.partitionBy("series_id").orderBy(*order)


def parts_for(df: DataFrame, each: int) -> int:
    """Parts of about ``each`` bytes of what ``df`` reads, and at least the session's shuffle partitions: for shuffles before costly work, which must not be
    drawn together because their bytes are few. Catalyst's estimate of a join is the product of its sides, hence only the leaves count."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(1_000_000, max(least, -(-sum(x for x in sizes if x < 1 << 60) // each)))


def require_columns(df: DataFrame, *names: str) -> None:
    if not {"ds", "y"} & set(names) <= set(df.columns):
        raise ValueError('Dataframe must have columns "ds" and "y" with the dates and values respectively.')
    for n in names:
        if n not in df.columns:
            raise ValueError(f"Column {n!r} missing from dataframe")
    if "ds" in df.columns and isinstance(df.schema["ds"].dataType, TimestampType):
        raise ValueError("Column ds has timezone specified, which is not supported. Remove timezone.")


def clean_history(df: DataFrame) -> DataFrame:
    """Rows whose y is neither null nor NaN, with y as double and ``us``, microseconds since 1970."""
    require_columns(df, "ds", "y")
    y = F.col("y").cast("double")
    return df.withColumn("y", y).where(F.col("y").isNotNull() & ~F.isnan("y")).withColumn("us", micros(F.col("ds")))


def history_status(df: DataFrame) -> DataFrame:
    """One row a series: n_rows, n_usable, status. Problems are reported in the order in which they are looked for."""
    require_columns(df, "ds", "y")
    y = F.col("y").cast("double")
    usable = y.isNotNull() & ~F.isnan(y)
    counts = df.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.count_if(usable).alias("n_usable"), F.count_if(usable & (F.abs(y) == float("inf"))).alias("n_inf"), F.count_if(usable & F.col("ds").isNull()).alias("n_null_ds"),
        F.countDistinct(F.when(usable, F.col("ds"))).alias("n_ds"),
    )
    status = (
        F.when(F.col("n_usable") < 2, "Dataframe has less than 2 non-NaN rows.").when(F.col("n_inf") > 0, "Found infinity in column y.").when(F.col("n_null_ds") > 0, "Found NaN in column ds.")
        .when(F.col("n_ds") < 2, "All rows have the same ds.").otherwise("ok")
    )
    return counts.select("series_id", "n_rows", "n_usable", status.alias("status"))


def raise_for_status(df: DataFrame) -> None:
    bad = history_status(df).where("status <> 'ok'").orderBy("series_id").limit(1).collect()
    if bad:
        raise ValueError(f"series {bad[0].series_id}: {bad[0].status}")


def history_spacing(clean: DataFrame) -> DataFrame:
    """series_id, span_days and min_spacing_days: the smallest positive step between dates, duplicates ignored."""
    step = F.col("us") - F.lag("us").over(by_series("us"))
    rows = clean.select("series_id", "us", step.alias("step"))
    return rows.groupBy("series_id").agg(((F.max("us") - F.min("us")) / float(DAY)).alias("span_days"), (F.min(F.when(F.col("step") > 0, F.col("step"))) / float(DAY)).alias("min_spacing_days"))


def with_floor(df: DataFrame, spec: ModelSpec) -> DataFrame:
    floor = F.coalesce(F.col("floor").cast("double"), F.lit(0.0)) if "floor" in df.columns and spec.growth == "logistic" else F.lit(0.0)
    return df.withColumn("floor", floor)


def capacity_status(df: DataFrame) -> DataFrame:
    """Checks of cap and floor for logistic growth, one row a series."""
    if "cap" not in df.columns:
        raise ValueError('Capacities must be supplied for logistic growth in column "cap"')
    cap = F.col("cap").cast("double")
    floor = F.coalesce(F.col("floor").cast("double"), F.lit(0.0)) if "floor" in df.columns else F.lit(0.0)
    bad = df.groupBy("series_id").agg(F.count_if(cap.isNull()).alias("no_cap"), F.count_if(cap <= floor).alias("low_cap"))
    return bad.select("series_id", F.when(F.col("no_cap") > 0, "Capacities must be supplied for logistic growth in column \"cap\"").when(F.col("low_cap") > 0, "cap must be greater than floor.").otherwise("ok").alias("status"))


def series_stats(clean: DataFrame) -> DataFrame:
    """One row a series: n, start_us, end_us, y_scale, y_min, y_max, span_days, min_spacing_days."""
    step = F.col("us") - F.lag("us").over(by_series("us"))
    top = F.max(F.abs("y"))
    rows = clean.select("series_id", "us", "y", step.alias("step"))
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.when(top == 0, 1.0).otherwise(top).alias("y_scale"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        ((F.max("us") - F.min("us")) / float(DAY)).alias("span_days"), (F.min(F.when(F.col("step") > 0, F.col("step"))) / float(DAY)).alias("min_spacing_days"),
    )


def scaled_time(us: Column) -> Column:
    return (us - F.col("start_us")) / (F.col("end_us") - F.col("start_us")).cast("double")


def scale_history(clean: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds t in [0, 1] over the history and y_scaled = (y - floor) / max |y|; the divisor ignores the floor."""
    floor = F.col("floor") if "floor" in clean.columns else F.lit(0.0)
    rows = clean.join(stats.select("series_id", "start_us", "end_us", "y_scale"), "series_id")
    rows = rows.withColumn("t", scaled_time(F.col("us"))).withColumn("y_scaled", (F.col("y") - floor) / F.col("y_scale"))
    if "cap" in clean.columns:
        rows = rows.withColumn("cap_scaled", (F.col("cap").cast("double") - floor) / F.col("y_scale"))
    return rows


def auto_seasonality(stats: DataFrame, keep: bool = False) -> DataFrame:
    """series_id and whether its history supports yearly, weekly and daily seasonality; with ``keep`` beside the other columns."""
    flags = []
    for name, (_, _, span, spacing) in C.BUILT_IN.items():
        ok = F.col("span_days") >= span
        flags.append((ok if spacing is None else ok & F.coalesce(F.col("min_spacing_days") < spacing, F.lit(False))).alias(name))
    return stats.select("*" if keep else "series_id", *flags)


def seasonality_warnings(stats: DataFrame, spec: ModelSpec) -> DataFrame:
    """series_id and warning for series whose built-in seasonality was asked for though the history is shorter than it needs, one row each."""
    out = None
    for name, (_, _, span, _) in C.BUILT_IN.items():
        asked = getattr(spec, name)
        if (asked == "auto" and isinstance(asked, str)) or spec.built_in(name, False) is None:
            continue
        rows = stats.where(F.col("span_days") < span).select("series_id", F.lit(f"{name} seasonality is under-identified: the history spans less than {span:g} days.").alias("warning"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else stats.select("series_id", F.lit("").alias("warning")).limit(0)


def changepoint_count(rows: Column, spec: ModelSpec) -> Column:
    """At most one changepoint less than the rows they are placed among."""
    hist = F.floor(rows * F.lit(float(spec.changepoint_range)))
    return F.when(F.lit(spec.n_changepoints) + 1 > hist, F.greatest(hist - 1, F.lit(0))).otherwise(F.lit(spec.n_changepoints))


def _placed(rows: DataFrame, spec: ModelSpec) -> DataFrame:
    """Adds picked, an array with the row's t if a changepoint falls on it, from columns n, row (from 0 by date, ties by y) and t.

    The i-th changepoint lies on row round(i * step), halves to even. There are never more than rows to place them on, so step is at
    least 1 and only the i next to row / step can fall on a row.
    """
    hist, n = F.floor(F.col("n") * F.lit(float(spec.changepoint_range))), changepoint_count(F.col("n"), spec)
    step = (hist - 1) / F.greatest(n, F.lit(1))
    near = F.round(F.col("row") / F.greatest(step, F.lit(1.0)))
    on = lambda i: (i >= 1) & (i <= n) & (F.bround(i * step) == F.col("row"))
    return rows.withColumn("picked", F.when(on(near - 1) | on(near) | on(near + 1), F.array("t")).otherwise(F.array().cast("array<double>")))


def _gathered() -> Column:
    """A series' changepoints; one at 0 stands in if there are none."""
    found = F.sort_array(F.flatten(F.collect_list(F.when(F.size("picked") > 0, F.col("picked")))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0.0)))


def explicit_changepoints(stats: DataFrame, spec: ModelSpec) -> DataFrame:
    if not spec.changepoints:
        return stats.select("series_id", F.array(F.lit(0.0)).alias("changepoints_t"))
    dates = F.array(*[micros(F.lit(d).cast("timestamp_ntz")) for d in spec.changepoints])
    inside = F.forall(dates, lambda u: (u >= F.col("start_us")) & (u <= F.col("end_us")))
    at = F.when(inside, dates).otherwise(F.raise_error(F.lit("Changepoints must fall within training data.")).cast("array<bigint>"))
    return stats.select("series_id", F.sort_array(F.transform(at, lambda u: (u - F.col("start_us")) / (F.col("end_us") - F.col("start_us")).cast("double"))).alias("changepoints_t"))


def changepoints(scaled: DataFrame, stats: DataFrame, spec: ModelSpec) -> DataFrame:
    """series_id and changepoints_t: evenly spaced over the first rows of a series by date (ties by y), or the given dates.

    A series without any gets one dummy changepoint at 0.
    """
    if spec.changepoints is not None:
        return explicit_changepoints(stats, spec)
    ranked = scaled.select("series_id", "t", (F.row_number().over(by_series("us", "y")) - 1).alias("row")).join(stats.select("series_id", "n"), "series_id")
    return _placed(ranked, spec).groupBy("series_id").agg(_gathered().alias("changepoints_t"))


def series_info(clean: DataFrame, spec: ModelSpec) -> DataFrame:
    """``series_stats`` and ``changepoints`` of every series together: one shuffle and one sort of (series_id, us, y)."""
    if spec.changepoints is not None:
        stats = series_stats(clean)
        return stats.join(explicit_changepoints(stats, spec), "series_id")
    whole, order = Window.partitionBy("series_id"), by_series("us", "y")
    rows = clean.select(
        "series_id", "us", "y", (F.col("us") - F.lag("us").over(order)).alias("step"), (F.row_number().over(order) - 1).alias("row"),
        F.count("*").over(whole).alias("n"), F.min("us").over(whole).alias("start_us"), F.max("us").over(whole).alias("end_us"),
    )
    rows = _placed(rows.withColumn("t", F.try_divide(F.col("us") - F.col("start_us"), (F.col("end_us") - F.col("start_us")).cast("double"))), spec)
    top = F.max(F.abs("y"))
    return rows.groupBy("series_id").agg(
        F.first("n").alias("n"), F.first("start_us").alias("start_us"), F.first("end_us").alias("end_us"), F.when(top == 0, 1.0).otherwise(top).alias("y_scale"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        ((F.max("us") - F.min("us")) / float(DAY)).alias("span_days"), (F.min(F.when(F.col("step") > 0, F.col("step"))) / float(DAY)).alias("min_spacing_days"), _gathered().alias("changepoints_t"),
    )


def initial_point(scaled: DataFrame, spec: ModelSpec) -> DataFrame:
    """series_id, k, m: the line through the first and the last point, its logit for logistic growth, the mean for flat."""
    if spec.growth == "flat":
        return scaled.groupBy("series_id").agg(F.lit(0.0).alias("k"), F.avg("y_scaled").alias("m"))
    first, last = F.struct("us", "y_scaled"), F.struct("us", (-F.col("y_scaled")).alias("y"))  # of equal dates the smallest y
    value = ["y_scaled", "t", *(["cap_scaled"] if spec.growth == "logistic" else [])]
    ends = scaled.groupBy("series_id").agg(F.min_by(F.struct(*value), first).alias("a"), F.max_by(F.struct(*value), last).alias("b"))
    span = F.col("b.t") - F.col("a.t")
    if spec.growth == "linear":
        slope = (F.col("b.y_scaled") - F.col("a.y_scaled")) / span
        return ends.select("series_id", slope.alias("k"), (F.col("a.y_scaled") - slope * F.col("a.t")).alias("m"))
    clamp = lambda e: F.greatest(F.col(f"{e}.cap_scaled") * 0.01, F.least(F.col(f"{e}.cap_scaled") * 0.99, F.col(f"{e}.y_scaled")))
    ends = ends.withColumn("r0", F.col("a.cap_scaled") / clamp("a")).withColumn("r1", F.col("b.cap_scaled") / clamp("b"))
    ends = ends.withColumn("r0", F.when(F.abs(F.col("r0") - F.col("r1")) <= 0.01, F.col("r0") * 1.05).otherwise(F.col("r0")))
    l0, l1 = F.ln(F.col("r0") - 1), F.ln(F.col("r1") - 1)
    return ends.select("series_id", ((l0 - l1) / span).alias("k"), (l0 * span / (l0 - l1)).alias("m"))
