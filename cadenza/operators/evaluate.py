"""Rolling-origin evaluation, accuracy metrics and paired comparison, as DataFrame operations over all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import DAY, from_micros, micros, sign_test
from ..sources.series import replace_rows
from ..spec import ModelSpec
from .fit import fit
from .forecast import predict_point
from .uncertainty import predict

#: frequency: (horizon, initial, period) in days.
HORIZONS = {"Weekly": (364, 728, 364), "Daily": (90, 730, 180)}
#: Metrics compared as ratios; the others as differences.
RELATIVE = ("mae", "rmse", "mape", "smape", "interval_width", "sum_abs_delta", "l1_penalty")


def cutoffs(history: DataFrame, horizon: float, initial: float, period: float) -> DataFrame:
    """series_id and cutoff: last - horizon - i * period for i = 0, 1, ..., as long as at least ``initial`` days of history end there."""
    ends = history.groupBy("series_id").agg(F.min(micros(F.col("ds"))).alias("lo"), F.max(micros(F.col("ds"))).alias("hi"))
    first, floor = F.col("hi") - int(horizon * DAY), F.col("lo") + int(initial * DAY)
    rows = ends.select("series_id", first.alias("first"), floor.alias("floor")).where("first >= floor")
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("first") - F.col("floor")) / int(period * DAY)))
    return rows.select("series_id", "first", F.explode(steps).alias("i")).select("series_id", from_micros(F.col("first") - F.col("i") * int(period * DAY)).alias("cutoff"))


def eligible(history: DataFrame, horizon: float, initial: float, period: float) -> DataFrame:
    """The series that the protocol can measure."""
    return cutoffs(history, horizon, initial, period).select("series_id").distinct()


def folds(history: DataFrame, cuts: DataFrame, horizon: float) -> tuple[DataFrame, DataFrame]:
    """Training rows (up to the cutoff) and test rows (after it, within the horizon), keyed by series_id = '<series>|<cutoff>'."""
    rows = history.withColumn("ds", F.col("ds").cast("timestamp_ntz")).join(cuts, "series_id")
    key = F.concat_ws("|", "series_id", F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss"))
    rows = rows.withColumn("series", F.col("series_id")).withColumn("series_id", key)
    before = F.col("ds") <= F.col("cutoff")
    after = ~before & (micros(F.col("ds")) <= micros(F.col("cutoff")) + int(horizon * DAY))
    train = rows.where(before)
    enough = train.groupBy("series_id").agg(F.count_if(F.col("y").isNotNull()).alias("n"), F.countDistinct("ds").alias("k")).where("n >= 2 and k >= 2").select("series_id")
    return train.join(enough, "series_id", "left_semi"), rows.where(after).join(enough, "series_id", "left_semi")


def cross_validation(history: DataFrame, spec: ModelSpec, horizon: float, initial: float, period: float, bounds: bool = False, done: DataFrame | None = None) -> DataFrame:
    """series_id, cutoff, ds, y, yhat (yhat_lower, yhat_upper): every fold is a series of its own, so all folds of all series are fitted
    in one pass. ``done`` names series to leave out, e.g. those a resumed run has measured."""
    if done is not None:
        history = history.join(done.select("series_id").distinct(), "series_id", "left_anti")
    train, test = folds(history, cutoffs(history, horizon, initial, period), horizon)
    models = fit(train.drop("series", "cutoff"), spec)
    forecast = predict(test.drop("series", "cutoff", "y"), models, spec) if bounds else predict_point(test.drop("series", "cutoff", "y"), models, spec)
    names = ["yhat", *(["yhat_lower", "yhat_upper"] if bounds else [])]
    out = test.select("series_id", "series", "cutoff", "ds", F.col("y").cast("double").alias("y")).join(forecast.select("series_id", "ds", *names), ["series_id", "ds"])
    return out.select(F.col("series").alias("series_id"), "cutoff", "ds", "y", *names)


def metric_columns(bounds: bool = False) -> dict[str, Column]:
    """Aggregates over rows (y, yhat, and bounds). Ratios ignore rows whose denominator is 0."""
    e, y, f = F.col("y") - F.col("yhat"), F.col("y"), F.col("yhat")
    out = {
        "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mape": F.avg(F.abs(e) / F.nullif(F.abs(y), F.lit(0.0))),
        "smape": F.avg(2.0 * F.abs(e) / F.nullif(F.abs(y) + F.abs(f), F.lit(0.0))),
    }
    if bounds:
        out |= {"coverage": F.avg(((y >= F.col("yhat_lower")) & (y <= F.col("yhat_upper"))).cast("double")), "interval_width": F.avg(F.col("yhat_upper") - F.col("yhat_lower"))}
    return out


def accuracy(rows: DataFrame, *keys: str, bounds: bool = False) -> DataFrame:
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_columns(bounds).items()])


def sparsity(models: DataFrame, tau: float) -> DataFrame:
    """series_id, sum_abs_delta, exact_zeros, l1_penalty."""
    total = F.aggregate(F.transform("delta", lambda d: F.abs(d)), F.lit(0.0), lambda a, x: a + x)
    return models.select("series_id", total.alias("sum_abs_delta"), F.size(F.filter("delta", lambda d: d == 0)).alias("exact_zeros"), (total / tau).alias("l1_penalty"))


def measurements(wide: DataFrame, implementation: str, tier: int = 2, configuration: str = "default", unit: str | None = None) -> DataFrame:
    """Tidy facts (tier, series, configuration, implementation, metric, value, unit) from one column a metric."""
    names = [c for c in wide.columns if c != "series_id"]
    long = wide.select("series_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("series_id", names, "metric", "value")
    return long.select(F.lit(tier).alias("tier"), F.col("series_id").alias("series"), F.lit(configuration).alias("configuration"), F.lit(implementation).alias("implementation"), "metric", "value", F.lit(unit).cast("string").alias("unit"))


def paired_differences(facts: DataFrame, ours: str, theirs: str) -> DataFrame:
    """series, metric, difference for series measured by both implementations: ours / theirs - 1 for ratios (dropped if theirs is 0), else ours - theirs."""
    both = facts.where(F.col("implementation").isin(ours, theirs)).groupBy("series", "metric").pivot("implementation", [ours, theirs]).agg(F.max("value"))
    both = both.select("series", "metric", F.col(f"`{ours}`").alias("a"), F.col(f"`{theirs}`").alias("b")).dropna()
    difference = F.when(F.col("metric").isin(*RELATIVE), F.col("a") / F.nullif("b", F.lit(0.0)) - 1.0).otherwise(F.col("a") - F.col("b"))
    finite = ~F.isnan("difference") & (F.abs("difference") < float("inf"))
    return both.select("series", "metric", difference.alias("difference")).where(F.col("difference").isNotNull() & finite)


def summary_columns(x: str = "difference") -> list[Column]:
    wins, losses = F.count_if(F.col(x) < 0), F.count_if(F.col(x) > 0)
    return [
        F.count("*").alias("n"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.25)).alias("iqr_low"), F.percentile(x, F.lit(0.75)).alias("iqr_high"),
        wins.alias("wins"), losses.alias("losses"), F.count_if(F.col(x) == 0).alias("ties"),
    ]


def paired_summary(differences: DataFrame) -> DataFrame:
    """Per metric: n, median, quartiles, wins (below 0), losses, ties and the exact two-sided sign test (null below six untied pairs)."""
    rows = differences.groupBy("metric").agg(*summary_columns())
    return rows.withColumn("p_value", sign_test(F.col("wins"), F.col("losses")))


def stratified_summary(differences: DataFrame, stratum: Column) -> DataFrame:
    """The same by stratum and pooled (stratum null), from one pass."""
    rows = differences.withColumn("stratum", stratum)
    rows = rows.groupingSets([["metric", "stratum"], ["metric"]], "metric", "stratum").agg(F.grouping_id().alias("level"), *summary_columns())
    return rows.withColumn("p_value", sign_test(F.col("wins"), F.col("losses")))


def holm(tests: DataFrame, *family: str) -> DataFrame:
    """Adds adjusted, Holm's step-down p-values within each family; null p-values stay null and don't count."""
    real = tests.where(F.col("p_value").isNotNull())
    keys = list(family)
    rank = Window.partitionBy(*keys).orderBy("p_value") if keys else Window.orderBy("p_value")
    n = F.count("*").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    scaled = real.withColumn("_raw", F.col("p_value") * (n - F.row_number().over(rank) + 1))
    upto = rank.rowsBetween(Window.unboundedPreceding, 0)
    out = scaled.withColumn("adjusted", F.least(F.lit(1.0), F.max("_raw").over(upto))).drop("_raw")
    return out.unionByName(tests.where(F.col("p_value").isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def log_slope(points: DataFrame, size: str, value: str, *keys: str) -> DataFrame:
    """Exponent of ``value`` in ``size`` by log-log regression; keys with fewer than three positive points give none."""
    rows = points.where((F.col(size) > 0) & (F.col(value) > 0)).select(*keys, F.ln(size).alias("_x"), F.ln(value).alias("_y"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("exponent")).where("n >= 3")


def linear_fit(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def showcase(facts: DataFrame, ours: str, theirs: str, usable: float = 0.10) -> DataFrame:
    """The best, the middle and the worst series by relative RMSE advantage, among those whose worse sMAPE is usable. Two numbers a series are ranked
    in one task."""
    wide = facts.where(F.col("metric").isin("rmse", "smape") & F.col("implementation").isin(ours, theirs)).groupBy("series").pivot("metric", ["rmse", "smape"]).agg(
        F.max(F.when(F.col("implementation") == ours, F.col("value"))).alias("a"), F.max(F.when(F.col("implementation") == theirs, F.col("value"))).alias("b")
    )
    ok = wide.where("rmse_a is not null and rmse_b <> 0 and smape_a is not null and smape_b is not null").where(F.greatest("smape_a", "smape_b") <= usable)
    ranked = ok.select("series", ((F.col("rmse_b") - F.col("rmse_a")) / F.col("rmse_b")).alias("advantage"))
    order = Window.orderBy(F.desc("advantage"), F.desc("series"))
    ranked = ranked.withColumn("rank", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    pick = F.when(F.col("rank") == 0, "best").when(F.col("rank") == F.floor(F.col("n") / 2), "middle").when(F.col("rank") == F.col("n") - 1, "worst")
    return ranked.withColumn("pick", pick).where("pick is not null and n >= 3").select("pick", "series", "advantage", "rank")


def resummarised(facts: DataFrame, ours: str, theirs: str, tier: int = 2) -> DataFrame:
    """The facts with their paired summary (configuration summary) made again, nothing fitted: a row for each metric and number of ``paired_summary``."""
    rows = paired_summary(paired_differences(facts.where(F.col("configuration") != "summary"), ours, theirs))
    names = [c for c in rows.columns if c != "metric"]
    long = rows.select("metric", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("metric", names, "unit", "value")
    new = long.select(F.lit(tier).alias("tier"), F.lit("paired").alias("series"), F.lit("summary").alias("configuration"), F.lit(ours).alias("implementation"), "metric", "value", "unit")
    return replace_rows(facts, new, "summary")


def gate_tier(a: DataFrame, b: DataFrame, design: float = 1e-9, posterior: float = 1e-6) -> DataFrame:
    """Two implementations' models of the same series, one row each: the largest gaps of changepoints and of scales, the columns of either, the log
    posteriors, and ok: the gaps below ``design``, as many columns, and a posterior of ``a`` no more than ``posterior`` (relative) below that of ``b``."""
    pick = lambda df, e: df.select("series_id", *[F.col(c).alias(f"{c}_{e}") for c in ("changepoints_t", "y_scale", "regressor_mu", "regressor_std", "beta", "lp")])
    both = pick(a, "a").join(pick(b, "b"), "series_id")

    def widest(name: str) -> Column:
        gaps = F.zip_with(f"{name}_a", f"{name}_b", lambda x, y: F.abs(x - y))
        same = F.size(f"{name}_a") == F.size(f"{name}_b")
        return F.when(same, F.coalesce(F.array_max(gaps), F.lit(0.0))).otherwise(float("inf"))

    scale = F.greatest(F.abs(F.col("y_scale_a") - F.col("y_scale_b")), widest("regressor_mu"), widest("regressor_std"))
    rows = both.select("series_id", widest("changepoints_t").alias("changepoints_gap"), scale.alias("scale_gap"), F.size("beta_a").cast("long").alias("columns_a"), F.size("beta_b").cast("long").alias("columns_b"), "lp_a", "lp_b")
    ok = (F.col("changepoints_gap") < design) & (F.col("scale_gap") < design) & (F.col("columns_a") == F.col("columns_b")) & (F.col("lp_a") >= F.col("lp_b") - posterior * (1 + F.abs("lp_b")))
    return rows.withColumn("ok", ok)


def gate(a: DataFrame, b: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """Largest and mean absolute difference of columns of two results, e.g. of two kernels' forecasts; divide them by y_scale first to compare series."""
    both = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    gap = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
    return both.agg(*[f(gap(c)).alias(f"{n}_{c}") for c in columns for n, f in (("max", F.max), ("mean", F.avg))])
