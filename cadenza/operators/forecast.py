"""Point forecasts and components: expressions over future rows joined with the models table; no Python runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import DAY, dot, from_micros, linear_trend, logistic_trend, micros, sum_of
from ..spec import ModelSpec
from .features import holiday_table
from .fit import nested_models, row_features, selectable
from .prepare import scaled_time

_MODEL_COLUMNS = ["start_us", "end_us", "y_scale", "yearly", "weekly", "daily", "changepoints_t", "k", "m", "delta", "sigma_obs", "beta", "regressor_mu", "regressor_std", "holiday_columns", "has_floor"]


def future_frame(history: DataFrame, periods: int, include_history: bool = True) -> DataFrame:
    """series_id and ds: each series' dates, then ``periods`` days after its last one."""
    last = history.groupBy("series_id").agg(F.max(micros(F.col("ds"))).alias("us"))
    days = F.sequence(F.lit(1), F.lit(periods)) if periods > 0 else F.array().cast("array<int>")
    ahead = last.select("series_id", "us", F.explode(days).alias("i")).select("series_id", from_micros(F.col("us") + F.col("i").cast("long") * DAY).alias("ds"))
    return history.select("series_id", F.col("ds").cast("timestamp_ntz").alias("ds")).unionByName(ahead) if include_history else ahead


def modes(spec: ModelSpec) -> Column | None:
    """1 for the multiplicative entries of x, 0 for the others; None if there are none."""
    if all(m == "additive" for m in _all_modes(spec)):
        return None
    parts = []
    for s, flag in selectable(spec):
        block = F.array_repeat(F.lit(float(s.mode == "multiplicative")), 2 * s.order)
        parts.append(block if flag is None else F.when(F.col(flag), block).otherwise(F.array().cast("array<double>")))
    parts += [F.array_repeat(F.lit(float(spec.holiday_mode == "multiplicative")), F.size("holiday_columns"))] if spec.has_holidays else []
    parts += [F.array(*[F.lit(float(r.mode == "multiplicative")) for r in spec.regressors])] if spec.regressors else []
    return F.concat(*parts) if parts else None


def _all_modes(spec: ModelSpec) -> list[str]:
    return [*(s.mode for s, _ in selectable(spec)), *([spec.holiday_mode] if spec.has_holidays else []), *(r.mode for r in spec.regressors)]


def scaled_trend(spec: ModelSpec, delta: Column | None = None, points: Column | None = None) -> Column:
    """The trend in scaled units, from columns t, k, m (and cap_scaled)."""
    delta, points = F.col("delta") if delta is None else delta, F.col("changepoints_t") if points is None else points
    if spec.growth == "flat":
        return F.col("m")
    if spec.growth == "linear":
        return linear_trend(F.col("t"), F.col("k"), F.col("m"), delta, points)
    return logistic_trend(F.col("t"), F.col("cap_scaled"), F.col("k"), F.col("m"), delta, points)


def joined(future: DataFrame, models: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, calendar: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Future rows with their model's columns, t, floor and the design row x.

    Rows of series without a model are dropped. Logistic growth needs cap in the future as well, and floor if the history had one. The holidays of the
    specification's country are ``calendar``'s. Regressors with a predictor are filled (``with_predicted``).
    """
    future = with_predicted(future, models, spec, calendar, history)
    own = set(_MODEL_COLUMNS) | {"t", "us", "x"}
    rows = future.select(*[c for c in future.columns if c not in own]).join(models.select("series_id", *_MODEL_COLUMNS, F.col("n").alias("_n_history")), "series_id")
    rows = rows.withColumn("ds", F.col("ds").cast("timestamp_ntz")).withColumn("us", micros(F.col("ds"))).withColumn("t", scaled_time(F.col("us")))
    logistic = spec.growth == "logistic"
    if logistic and "cap" not in future.columns:
        raise ValueError('Capacities must be supplied for logistic growth in column "cap"')
    if logistic and "floor" in future.columns:
        floor = F.coalesce(F.col("floor").cast("double"), F.lit(0.0))
    elif logistic:
        floor = F.when(F.col("has_floor"), F.raise_error(F.lit('Expected column "floor".')).cast("double")).otherwise(0.0)
    else:
        floor = F.lit(0.0)
    rows = rows.withColumn("floor", floor)
    if logistic:
        cap = F.col("cap").cast("double")
        rows = rows.withColumn("cap_scaled", F.when(cap > F.col("floor"), (cap - F.col("floor")) / F.col("y_scale")).otherwise(F.raise_error(F.lit("cap must be greater than floor.")).cast("double")))
    return row_features(rows, spec, holidays, calendar)


def with_predicted(future: DataFrame, models: DataFrame, spec: ModelSpec, calendar: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Future rows with the columns of regressors that have a predictor: behind the history their own models' forecast; before its end the caller's
    value, or where there is none that of ``history``."""
    own = [r for r in spec.regressors if r.predictor is not None]
    if not own:
        return future
    future = future.withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    last = models.select("series_id", F.col("end_us").alias("_end"))
    dates = future.select("series_id", "ds").distinct().join(last, "series_id").where(micros(F.col("ds")) > F.col("_end")).select("series_id", "ds")
    for r in own:
        values = predict_point(dates, nested_models(models, r.name), r.predictor, calendar=calendar).select("series_id", "ds", F.col("yhat").alias("_yhat"))
        given = F.col(r.name).cast("double") if r.name in future.columns else F.lit(None).cast("double")
        if history is not None:
            known = history.groupBy("series_id", F.col("ds").cast("timestamp_ntz").alias("ds")).agg(F.first(F.col(r.name).cast("double"), True).alias("_known"))
            future = future.join(known, ["series_id", "ds"], "left")
            given = F.coalesce(given, F.col("_known"))
        ahead = micros(F.col("ds")) > F.col("_end")
        future = future.join(last, "series_id").join(values, ["series_id", "ds"], "left").withColumn(r.name, F.when(ahead, F.col("_yhat")).otherwise(given)).drop("_end", "_yhat", "_known")
    return future


def with_point(rows: DataFrame, spec: ModelSpec) -> DataFrame:
    """Adds trend, lift (the multiplicative factor), additive (scaled) and yhat. The factor applies to the trend with its floor."""
    rows = rows.withColumn("trend", scaled_trend(spec) * F.col("y_scale") + F.col("floor"))
    mult = modes(spec)
    if mult is None:
        rows = rows.withColumn("lift", F.lit(1.0)).withColumn("additive", dot(F.col("x"), F.col("beta")))
    else:
        rows = rows.withColumn("_mult", mult)
        xb = F.zip_with("x", "beta", lambda a, b: a * b)
        rows = rows.withColumn("_xb", xb).withColumn("lift", 1.0 + dot(F.col("_xb"), F.col("_mult"))).withColumn("additive", sum_of(F.col("_xb")) - dot(F.col("_xb"), F.col("_mult")))
        rows = rows.drop("_mult", "_xb")
    return rows.withColumn("yhat", F.col("trend") * F.col("lift") + F.col("additive") * F.col("y_scale"))


def predict_point(future: DataFrame, models: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, calendar: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """series_id, ds, trend, seasonality, yhat: the forecast without intervals. yhat = trend + seasonality."""
    rows = with_point(joined(future, models, spec, holidays, calendar, history), spec)
    seasonality = F.col("additive") * F.col("y_scale") + F.col("trend") * (F.col("lift") - 1.0)
    return rows.select("series_id", "ds", "trend", seasonality.alias("seasonality"), "yhat")


def _named_sum(effects: Column, name: str) -> Column:
    return F.aggregate(F.filter(effects, lambda e: e["name"] == F.lit(name)), F.lit(0.0), lambda acc, e: acc + e["v"])


def component_columns(spec: ModelSpec, country: list[str] | None = None) -> dict[str, Column]:
    """Each component's part of the mean in the series' units if additive, as a factor if multiplicative, from columns x and beta.

    A seasonality that a series doesn't have is null for it. ``country`` names the country's holidays; those that the fit didn't see are 0.
    """
    at, parts, kinds = F.lit(1), [], []
    take = lambda start, n: sum_of(F.zip_with(F.slice("x", start, n), F.slice("beta", start, n), lambda a, b: a * b))
    for s, flag in selectable(spec):
        n = F.lit(2 * s.order) if flag is None else F.when(F.col(flag), 2 * s.order).otherwise(0)
        value = take(at, n)
        parts.append((s.name, s.mode, "seasonality", value if flag is None else F.when(F.col(flag), value)))
        at = at + n
    if spec.has_holidays:
        n = F.size("holiday_columns")
        effects = F.zip_with(F.col("holiday_columns"), F.zip_with(F.slice("x", at, n), F.slice("beta", at, n), lambda a, b: a * b), lambda c, v: F.struct(F.substring_index(c, "_delim_", 1).alias("name"), v.alias("v")))
        for name in sorted({h.name for h in spec.holidays} | set(country or [])):
            parts.append((name, spec.holiday_mode, "holiday", _named_sum(effects, name)))
        at = at + n
    for r in spec.regressors:
        parts.append((r.name, r.mode, "regressor", take(at, F.lit(1))))
        at = at + 1
    out: dict[str, list[Column]] = {}
    for name, mode, kind, value in parts:
        scaled = value * F.col("y_scale") if mode == "additive" else value
        out.setdefault(name, []).append(scaled)
        out.setdefault(f"{mode}_terms", []).append(F.coalesce(scaled, F.lit(0.0)))
        if kind == "holiday":
            out.setdefault("holidays", []).append(scaled)
        if kind == "regressor":
            out.setdefault(f"extra_regressors_{mode}", []).append(scaled)
    for mode in ("additive", "multiplicative"):
        out.setdefault(f"{mode}_terms", [F.lit(0.0)])
    kinds = {}
    for name, values in out.items():
        total = values[0]
        for v in values[1:]:
            total = total + v
        kinds[name] = total
    return kinds


def predict_components(future: DataFrame, models: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, intervals: bool = True, calendar: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """series_id, ds and each component; with ``intervals`` also <component>_lower and _upper, which equal it: the parameters are a point.
    Every holiday that the country's calendar names is a component."""
    rows = joined(future, models, spec, holidays, calendar, history)
    named = [r[0] for r in holiday_table(future, replace(spec, holidays=()), None, calendar).select("holiday").distinct().collect()] if spec.country is not None else []
    cols = component_columns(spec, named)
    rows = rows.select("series_id", "ds", *[c.alias(n) for n, c in cols.items()])
    if intervals and spec.uncertainty_samples:
        rows = rows.select("series_id", "ds", *[F.col(n).alias(n + e) for n in cols for e in ("", "_lower", "_upper")])
    return rows


def fill_regressors(future: DataFrame, history: DataFrame, predicted: dict[str, DataFrame]) -> DataFrame:
    """Future rows with regressor columns from their own models' yhat (series_id, ds, yhat). Dates of the history take the caller's value
    if there is one, else the history's; later dates take the forecast."""
    last = history.groupBy("series_id").agg(F.max(micros(F.col("ds"))).alias("_last"))
    future = future.withColumn("ds", F.col("ds").cast("timestamp_ntz")).join(last, "series_id")
    for name, values in predicted.items():
        known = history.groupBy("series_id", F.col("ds").cast("timestamp_ntz").alias("ds")).agg(F.first(F.col(name).cast("double"), True).alias("_known"))
        future = future.join(known, ["series_id", "ds"], "left").join(values.select("series_id", "ds", F.col("yhat").alias("_yhat")), ["series_id", "ds"], "left")
        given = F.col(name).cast("double") if name in future.columns else F.lit(None).cast("double")
        past = micros(F.col("ds")) <= F.col("_last")
        future = future.withColumn(name, F.when(past, F.coalesce(given, F.col("_known"))).otherwise(F.col("_yhat"))).drop("_known", "_yhat")
    return future.drop("_last")


__all__ = ["component_columns", "fill_regressors", "future_frame", "joined", "predict_components", "predict_point", "with_point", "with_predicted"]
