"""One query an operator, over the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import fourier, linear_trend, seasonal_time, uniform
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import fit as FIT
from ..operators import forecast as FC
from ..operators import prepare as P
from ..operators import uncertainty as U
from ..sources import series as S
from ..sources import store
from ..spec import Holiday, ModelSpec
from ..streaming.scoring import score_stream
from . import fixtures as D

DATE = "yyyy-MM-dd"
HOLIDAYS = (Holiday("new_year", datetime(1999, 1, 1), 0, 1), Holiday("new_year", datetime(2000, 1, 1), 0, 1), Holiday("summer", datetime(1998, 7, 4), -1, 1))


def r(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def day(c: str = "ds") -> Column:
    return F.date_format(c, DATE)


def clean_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.daily(spark, sf_dir)
    rows = rows.withColumn("y", F.when(F.dayofweek("ds") == 1, F.lit(None)).when(F.dayofweek("ds") == 2, F.lit(float("nan"))).otherwise(F.col("y")))
    return P.clean_history(rows).select("series_id", day().alias("day"), r("y").alias("y"))


def history_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.daily(spark, sf_dir).select("series_id", "ds", "y")
    some = rows.where("series_id = 'A'")
    named = lambda name, df: df.withColumn("series_id", F.lit(name))
    bad = named("nan", some.withColumn("y", F.lit(float("nan")))).unionByName(named("inf", some.withColumn("y", F.when(F.dayofmonth("ds") == 1, float("inf")).otherwise(F.col("y")))))
    bad = bad.unionByName(named("null ds", some.withColumn("ds", F.when(F.dayofmonth("ds") > 1, F.col("ds"))))).unionByName(named("one", some.where(F.col("ds") == "1999-01-04").unionByName(some.where(F.col("ds") == "1999-01-04"))))
    return P.history_status(rows.unionByName(bad))


def history_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [f(spark, sf_dir).select("series_id", "ds", "y") for f in (D.daily, D.weekly, D.hourly)]
    spacing = P.history_spacing(P.clean_history(rows[0].unionByName(rows[1]).unionByName(rows[2])))
    return spacing.select("series_id", r("span_days").alias("span_days"), r("min_spacing_days").alias("min_spacing_days"))


def auto_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [f(spark, sf_dir).select("series_id", "ds", "y") for f in (D.daily, D.weekly, D.hourly)]
    return P.auto_seasonality(P.series_stats(P.clean_history(rows[0].unionByName(rows[1]).unionByName(rows[2]))))


def _scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    clean = P.clean_history(D.daily(spark, sf_dir))
    stats = P.series_stats(clean)
    return P.scale_history(clean, stats), stats


def scale_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir)[0].select("series_id", day().alias("day"), r("t").alias("t"), r("y_scaled").alias("y_scaled"))


def changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, stats = _scaled(spark, sf_dir)
    points = P.changepoints(scaled, stats, ModelSpec())
    return points.select("series_id", F.posexplode("changepoints_t").alias("position", "t")).select("series_id", F.col("position").cast("long").alias("position"), r("t").alias("t"))


def changepoints_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, stats = _scaled(spark, sf_dir)
    points = P.changepoints(scaled, stats, ModelSpec(changepoints=(datetime(1998, 3, 1), datetime(1997, 6, 1))))
    return points.select("series_id", F.posexplode("changepoints_t").alias("position", "t")).select("series_id", F.col("position").cast("long").alias("position"), r("t").alias("t"))


def _init(growth: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scaled, stats = _scaled(spark, sf_dir)
        if growth == "logistic":
            scaled = scaled.join(stats.select("series_id", (F.col("y_max") * 1.25 / F.col("y_scale")).alias("cap_scaled")), "series_id")
        return P.initial_point(scaled, ModelSpec(growth=growth)).select("series_id", r("k").alias("k"), r("m").alias("m"))

    return query


linear_init, flat_init, logistic_init = _init("linear"), _init("flat"), _init("logistic")


def capacity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.daily(spark, sf_dir).withColumn("cap", F.when(F.col("series_id") == "A", F.lit(1e9)).when(F.col("series_id") == "N", F.lit(-1.0)))
    return P.capacity_status(rows)


def _fourier(period: float, order: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = D.daily(spark, sf_dir).select("series_id", "ds", F.posexplode(fourier(seasonal_time(F.col("ds")), period, order)).alias("position", "value"))
        return rows.select("series_id", day().alias("day"), F.col("position").cast("long").alias("position"), r("value").alias("value"))

    return query


fourier_weekly, fourier_yearly = _fourier(7.0, 3), _fourier(365.25, 2)


def conditional_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ModelSpec().add_seasonality("winter_week", 7.0, 1, condition_name="winter")
    rows = X.seasonality_features(D.daily(spark, sf_dir).withColumn("days", seasonal_time(F.col("ds"))), spec.seasonalities)
    return rows.select("series_id", day().alias("day"), r(F.get("seasonal", F.lit(0))).alias("s1"), r(F.get("seasonal", F.lit(1))).alias("c1"))


def holiday_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ModelSpec(holidays=HOLIDAYS)
    rows = D.daily(spark, sf_dir)
    names = X.holiday_columns(spec.holidays)
    rows = X.holiday_features(rows, X.holiday_frame(rows, spec), names)
    rows = rows.select("series_id", F.posexplode("holiday").alias("position", "on"))
    return rows.groupBy("series_id", F.get(F.array(*[F.lit(n) for n in names]), "position").alias("column")).agg(F.sum("on").alias("days"))


def country_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = D.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "AA").otherwise("BB").alias("country"), F.col("o_orderdate").alias("ds"), F.col("o_orderpriority").alias("holiday"))
    years = D.daily(spark, sf_dir).where(F.year("ds") < 1998).select(F.year("ds").alias("year"))
    return X.country_holidays(calendar, "AA", years).select("holiday", day().alias("day"))


def regressor_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ModelSpec().add_regressor("disc").add_regressor("promo")
    rows = X.regressor_stats(D.daily(spark, sf_dir), spec.regressors)
    return rows.select("series_id", *[r(c).alias(c) for c in ("disc_mu", "disc_std", "promo_mu", "promo_std")])


def design_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ModelSpec(holidays=HOLIDAYS, holidays_prior_scale=3.0, holidays_mode="multiplicative").add_seasonality("monthly", 30.5, 2).add_regressor("disc", 0.5)
    cols = X.design_columns(spec, spec.seasonalities_for(False, True, False))
    return spark.createDataFrame([(k, c.name, c.component, float(c.prior_scale), c.mode) for k, c in enumerate(cols)], "position long, name string, component string, prior_scale double, mode string")


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = FIT.gram(D.daily(spark, sf_dir), ModelSpec(yearly=False, weekly=True, daily=False, changepoints=()))
    n = F.size("zy")
    cells = parts.select("series_id", n.alias("p"), F.posexplode("zz").alias("at", "value")).select("series_id", (F.floor(F.col("at") / F.col("p"))).cast("long").alias("i"), (F.col("at") % F.col("p")).cast("long").alias("j"), "value")
    return cells.groupBy("series_id", "i", "j").agg(r(F.sum("value"), 4).alias("value"))


def _trend(growth: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        history = D.daily(spark, sf_dir)
        spec = D.literal_spec(growth=growth)
        if growth == "logistic":
            top = history.groupBy("series_id").agg((F.max("y") * 1.25).alias("cap"))
            history = history.join(top, "series_id")
        rows = FC.predict_point(history, D.literal_models(history, growth), spec)
        return rows.select("series_id", day().alias("day"), r("trend").alias("trend"))

    return query


trend_linear, trend_flat, trend_logistic = _trend("linear"), _trend("flat"), _trend("logistic")


def predict_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    rows = FC.predict_point(FC.future_frame(history, 30), D.literal_models(history), D.literal_spec())
    return rows.select("series_id", day().alias("day"), *[r(c).alias(c) for c in ("trend", "seasonality", "yhat")])


def predict_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    rows = FC.predict_point(FC.future_frame(history, 30), D.literal_models(history), D.literal_spec(mode="multiplicative"))
    return rows.select("series_id", day().alias("day"), *[r(c).alias(c) for c in ("trend", "seasonality", "yhat")])


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    rows = FC.predict_components(history, D.literal_models(history), D.literal_spec())
    return rows.select("series_id", day().alias("day"), *[r(c).alias(c) for c in ("weekly", "weekly_lower", "weekly_upper", "additive_terms", "multiplicative_terms")])


def future_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FC.future_frame(D.daily(spark, sf_dir), 10).select("series_id", day().alias("day"))


def regressor_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    future = FC.future_frame(history, 5)
    predicted = FC.future_frame(history, 5).withColumn("yhat", F.dayofmonth("ds").cast("double"))
    rows = FC.fill_regressors(future, history, {"disc": predicted})
    return rows.select("series_id", day().alias("day"), r("disc").alias("disc"))


def _future(spark: SparkSession, sf_dir: str, n: int = 30) -> tuple[DataFrame, DataFrame]:
    history = D.daily(spark, sf_dir).select("series_id", "ds", "y")
    return history, FC.future_frame(history, n, False)


def trend_uncertainty_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, future = _future(spark, sf_dir)
    rows = U.trend_intervals(future, D.literal_models(history), D.literal_spec())
    return rows.select("series_id", day().alias("day"), r("trend_lower", 4).alias("trend_lower"), r("trend_upper", 4).alias("trend_upper"))


def trend_uncertainty_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, _ = _future(spark, sf_dir)
    rows = U.trend_forecast_uncertainty(D.literal_models(history), D.literal_spec(), history, 30)
    return rows.select("series_id", day().alias("day"), r("trend_lower", 4).alias("trend_lower"), r("trend_upper", 4).alias("trend_upper"))


def yhat_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, future = _future(spark, sf_dir)
    rows = U.predict(future, D.literal_models(history), D.literal_spec())
    return rows.select("series_id", day().alias("day"), *[r(c, 4).alias(c) for c in ("yhat_lower", "yhat", "yhat_upper")], "vectorized")


def predictive_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, future = _future(spark, sf_dir)
    rows = U.predictive_samples(future, D.literal_models(history), D.literal_spec())
    return rows.select("series_id", day().alias("day"), F.col("sample").cast("long").alias("sample"), r("yhat", 4).alias("yhat"))


def fit_kkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    spec = ModelSpec()
    rows = FIT.certificate(history, FIT.fit(history, spec), spec)
    return rows.select("series_id", "n_params", (F.col("kkt") < 1e-3).alias("kkt_ok"))


def fit_constant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir).select("series_id", "ds", F.lit(-7.5).alias("y"))
    models = FIT.fit(history, ModelSpec())
    rows = FC.predict_point(FC.future_frame(history, 3, False), models, ModelSpec()).join(models.select("series_id", "sigma_obs", "status"), "series_id")
    return rows.select("series_id", day().alias("day"), r("yhat").alias("yhat"), r("sigma_obs", 12).alias("sigma_obs"), "status")


def fit_recovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series made from known parameters, with hardly any noise, is fitted and forecast back."""
    truths = D.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("series_id"), F.lit("2015-01-01").cast("date").alias("start"), F.lit(800).alias("rows"), (1.0 + F.col("r_regionkey")).alias("k"), F.lit(2.0).alias("m"),
        F.array(F.lit(1.5)).alias("delta"), F.array(F.lit(0.4)).alias("changepoints_t"), F.lit(0.3).alias("amplitude"), F.lit(7.0).alias("period"), F.lit(0.001).alias("sigma"),
    )
    history = S.generate(spark, truths)
    spec = ModelSpec(yearly=False)
    rows = FC.predict_point(FC.future_frame(history, 14, False), FIT.fit(history, spec), spec)
    t = (F.datediff(F.to_date("ds"), "start")) / (F.col("rows") - 1)
    truth = linear_trend(t, F.col("k"), F.col("m"), F.col("delta"), F.col("changepoints_t")) + F.col("amplitude") * F.sin(6.283185307179586 * F.datediff(F.to_date("ds"), "start") / F.col("period"))
    return rows.join(truths, "series_id").groupBy("series_id").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("yhat") - truth)) < 0.05).alias("recovered"))


def cv_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cutoffs(D.daily(spark, sf_dir), *E.HORIZONS["Daily"]).select("series_id", day("cutoff").alias("cutoff"))


def cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds scored with each training window's mean as forecast."""
    history = D.daily(spark, sf_dir).select("series_id", "ds", "y")
    train, test = E.folds(history, E.cutoffs(history, *E.HORIZONS["Daily"]), 90)
    mean = train.groupBy("series_id").agg(F.avg("y").alias("yhat"), (F.avg("y") - F.stddev_samp("y")).alias("yhat_lower"), (F.avg("y") + F.stddev_samp("y")).alias("yhat_upper"))
    rows = E.accuracy(test.join(mean, "series_id"), "series", "cutoff", bounds=True)
    return rows.select(F.col("series").alias("series_id"), day("cutoff").alias("cutoff"), *[r(c, 5).alias(c) for c in ("mae", "rmse", "mape", "smape", "coverage", "interval_width")])


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.cross_validation(D.daily(spark, sf_dir).select("series_id", "ds", "y"), ModelSpec(), *E.HORIZONS["Daily"])
    return E.accuracy(rows, "series_id", "cutoff")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.table(spark, sf_dir, "orders")
    rows = orders.groupBy(F.concat(F.substring("o_orderpriority", 1, 1), F.lit(":"), (F.col("o_custkey") % 17).cast("string")).alias("series"), F.when(F.col("o_orderkey") % 2 == 0, "ours").otherwise("theirs").alias("implementation"))
    rows = rows.agg((F.avg("o_totalprice") / 1000).alias("rmse"), (F.avg(F.col("o_totalprice") % 10) / 100).alias("smape"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("coverage"))
    return rows.unpivot(["series", "implementation"], ["rmse", "smape", "coverage"], "metric", "value")


def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.paired_summary(E.paired_differences(_facts(spark, sf_dir), "ours", "theirs"))
    return rows.select("metric", "n", *[r(c).alias(c) for c in ("median", "iqr_low", "iqr_high")], "wins", "losses", "ties", r("p_value").alias("p_value"))


def stratified_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.stratified_summary(E.paired_differences(_facts(spark, sf_dir), "ours", "theirs"), F.substring("series", 1, 1))
    return rows.select("metric", F.coalesce("stratum", F.lit("all")).alias("stratum"), "n", r("median").alias("median"), "wins", "losses", r("p_value").alias("p_value"))


def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("test"), F.when(F.col("p_size") % 9 > 0, uniform(F.lit("p"), F.col("p_partkey")) / 10).alias("p_value"))
    return E.holm(tests, "family").select("family", "test", r("p_value").alias("p_value"), r("adjusted").alias("adjusted"))


def scaling_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("what"), (F.col("o_custkey") % 50).alias("size")).agg(F.sum("o_totalprice").alias("value"))
    return E.log_slope(points, "size", "value", "what").select("what", "n", r("exponent").alias("exponent"))


def memory_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    return E.linear_fit(points, "l_quantity", "price", "l_returnflag").select("l_returnflag", *[r(c).alias(c) for c in ("slope", "intercept", "r2")])


def showcase_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.showcase(_facts(spark, sf_dir), "ours", "theirs").select("pick", "series", r("advantage").alias("advantage"), F.col("rank").cast("long").alias("rank"))


def sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal rates and one that is exactly zero."""
    models = D.literal_models(D.daily(spark, sf_dir)).withColumn("delta", F.concat("delta", F.array(F.lit(0.0))))
    rows = E.sparsity(models, 0.05)
    return rows.select("series_id", r("sum_abs_delta").alias("sum_abs_delta"), F.col("exact_zeros").cast("long").alias("exact_zeros"), r("l1_penalty").alias("l1_penalty"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = D.daily(spark, sf_dir).groupBy("series_id").agg(F.avg("y").alias("mae"), F.max("y").alias("rmse"))
    return E.measurements(wide, "ours", unit="units").withColumn("value", r("value")).withColumn("tier", F.col("tier").cast("long"))


def agreement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    add = predict_point(spark, sf_dir)
    mult = predict_multiplicative(spark, sf_dir)
    del history
    return E.gate(add, mult, ["series_id", "day"], "yhat").select(r("max_yhat").alias("max_yhat"), r("mean_yhat").alias("mean_yhat"))


def unpivot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = D.table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("V1"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("V2"), F.lit(float("nan")).alias("V3"), F.col("n_regionkey").alias("V4"))
    return S.unpivot(wide, "n_name", ["V1", "V2", "V3", "V4"], F.lit("2020-01-01"), 7).select("series_id", day().alias("day"), "y")


def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.membership_digest(D.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("frequency"), F.col("c_name").alias("series_id")))


def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.profile(D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("series_id"), F.col("o_orderpriority").alias("frequency"), F.to_date("o_orderdate").alias("start")))
    return rows.select("frequency", "n_series", "n_starts", day("modal_start").alias("modal_start"), "modal_count")


def corpus_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_name").alias("series_id"), "c_nationkey")
    return S.drift(rows.where("c_nationkey % 3 <> 0").select("series_id"), rows.where("c_nationkey % 5 <> 0").select("series_id"))


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    return S.census(history, E.eligible(history, 90, 730, 180)).groupBy("series_id").agg(F.count("*").alias("n"))


def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir).select("series_id", "ds", "y")
    rows = score_stream(history, D.literal_models(history), D.literal_spec())
    return rows.select("series_id", day().alias("day"), r("z", 4).alias("z"), "anomaly")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipped quantity by return flag, fitted and forecast 90 days ahead."""
    history = D.daily(spark, sf_dir).select("series_id", "ds", "y")
    spec = ModelSpec()
    return FC.predict_point(FC.future_frame(history, 90, False), FIT.fit(history, spec), spec)


def _certified(history: DataFrame, spec: ModelSpec) -> DataFrame:
    """Status and the residual and curvature recomputed from the data and the parameters, not those that the solver reports."""
    models = FIT.fit(history, spec)
    found = FIT.certificate(history, models, spec).select("series_id", "kkt", "least_curvature")
    rows = models.select("series_id", "status", "beta").join(found, "series_id")
    return rows.select("series_id", "status", ((F.col("kkt") < 1e-3) & (F.col("least_curvature") > -1e-6)).alias("kkt_ok"), F.size("beta").cast("long").alias("n_beta"))


def fit_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _certified(D.daily(spark, sf_dir), ModelSpec(mode="multiplicative", yearly=2, n_changepoints=5))


def fit_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    history = history.join(history.groupBy("series_id").agg((F.max("y") * 1.25).alias("cap")), "series_id")
    return _certified(history, ModelSpec(growth="logistic", yearly=2, n_changepoints=5))


_FLAT = ModelSpec(growth="flat", yearly=False, weekly=False, daily=False)


def fit_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level and one regressor: parameters, noise and log posterior that SQL finds by itself."""
    models = FIT.fit(D.daily(spark, sf_dir), _FLAT.add_regressor("promo"))
    return models.select("series_id", r("m").alias("m"), r(F.get("beta", F.lit(0))).alias("beta"), r("sigma_obs").alias("sigma_obs"), r("lp", 4).alias("lp"))


def fit_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level and a regressor that the fit standardises; forecasts apply the history's mean and deviation."""
    history, spec = D.daily(spark, sf_dir), _FLAT.add_regressor("disc")
    rows = FC.predict_point(history.withColumn("disc", F.col("disc") + 1), FIT.fit(history, spec), spec)
    return rows.select("series_id", day().alias("day"), r("yhat", 4).alias("yhat"))


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar: the first days of months on which something was ordered, in one country, and all days in another."""
    days = D.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ds")).distinct()
    return days.where(F.dayofmonth("ds") == 1).select(F.lit("AA").alias("country"), "ds", F.lit("first").alias("holiday")).unionByName(days.select(F.lit("BB").alias("country"), "ds", F.lit("other").alias("holiday")))


def fit_country_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level and a country's holiday, fitted and forecast through the calendar."""
    history, calendar, spec = D.daily(spark, sf_dir), _firsts(spark, sf_dir), _FLAT.add_country_holidays("AA")
    models = FIT.fit(history, spec, calendar=calendar)
    rows = FC.predict_point(FC.future_frame(history, 30), models, spec, calendar=calendar)
    return rows.select("series_id", day().alias("day"), r("yhat", 4).alias("yhat"))


def fit_nested_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regressor whose future comes from its own model, a level: fit and forecast see to it."""
    history = D.daily(spark, sf_dir)
    spec = _FLAT.add_regressor("disc", predictor=_FLAT)
    rows = FC.predict_point(FC.future_frame(history, 10), FIT.fit(history, spec), spec, history=history)
    return rows.select("series_id", day().alias("day"), r("yhat", 4).alias("yhat"))


def cv_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling-origin evaluation of levels."""
    rows = E.cross_validation(D.daily(spark, sf_dir).select("series_id", "ds", "y"), _FLAT, *E.HORIZONS["Daily"])
    return E.accuracy(rows, "series_id", "cutoff").select("series_id", day("cutoff").alias("cutoff"), *[r(c, 4).alias(c) for c in ("mae", "rmse", "mape", "smape")])


def certificate_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimality residual, the squared errors and the objective of parameters that were not fitted."""
    history = D.daily(spark, sf_dir)
    rows = FIT.certificate(history, D.literal_models(history), ModelSpec(yearly=False, weekly=True, daily=False))
    return rows.select("series_id", "n_params", "n_zero_rates", r("kkt", 3).alias("kkt"), r("ssr").alias("ssr"), r("objective", 3).alias("objective"))


def trend_logistic_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    history = history.join(history.groupBy("series_id").agg((F.max("y") * 1.25).alias("cap"), (F.min("y") / 2).alias("floor")), "series_id")
    models = D.literal_models(history, "logistic").withColumn("has_floor", F.lit(True))
    rows = FC.predict_point(history, models, D.literal_spec(growth="logistic"))
    return rows.select("series_id", day().alias("day"), r("trend").alias("trend"))


def predict_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = D.daily(spark, sf_dir)
    models = store.from_json(store.to_json(D.literal_models(history)))
    rows = FC.predict_point(FC.future_frame(history, 30), models, D.literal_spec())
    return rows.select("series_id", day().alias("day"), r("yhat").alias("yhat"))


def component_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ModelSpec(holidays=HOLIDAYS, holidays_mode="multiplicative").add_seasonality("monthly", 30.5, 1).add_regressor("disc").add_regressor("promo", mode="multiplicative")
    return X.component_table(spark, X.design_columns(spec, spec.seasonalities_for(False, False, False)))


def gate_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments kernel against the row kernel, an implementation of its own, over the same models."""
    history, spec = D.daily(spark, sf_dir), ModelSpec(yearly=2, n_changepoints=8)
    rows = E.gate_tier(FIT.fit(history, spec, kernel="moments"), FIT.fit(history, spec, kernel="rows"))
    return rows.select("series_id", r("changepoints_gap", 9).alias("changepoints_gap"), r("scale_gap", 9).alias("scale_gap"), "columns_a", "columns_b", "ok")


def corpus_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return S.exclusions(orders, {"observations": F.col("n") >= 5, "span": F.datediff("hi", "lo") >= 730, "start": F.year("lo") < 1998})


def resummarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired rows made again from the facts in place of stale ones."""
    facts = _facts(spark, sf_dir).select(F.lit(2).alias("tier"), "series", F.lit("default").alias("configuration"), "implementation", "metric", "value", F.lit("").alias("unit"))
    stale = facts.limit(0).unionByName(spark.createDataFrame([(2, "paired", "summary", "ours", "old", 1.0, "")], facts.schema))
    rows = E.resummarised(facts.unionByName(stale), "ours", "theirs").where("configuration = 'summary'")
    return rows.select("series", "metric", r("value").alias("value"), "unit")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.manifest_digest(D.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("frequency"), F.col("c_name").alias("series_id")))


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history written as CSV and scanned back."""
    path = D.scratch(spark, "history")
    D.daily(spark, sf_dir).select("series_id", "ds", "y").write.csv(path, header=True)
    return S.read_csv(spark, path, schema="series_id string, ds timestamp_ntz, y double").select("series_id", day().alias("day"), r("y").alias("y"))


def facts_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written to the results files and read back."""
    path = D.scratch(spark, "results")
    S.write_facts(_facts(spark, sf_dir).select(F.lit(2).alias("tier"), "series", F.lit("default").alias("configuration"), "implementation", "metric", "value", F.lit("1").alias("unit")), path)
    return S.read_facts(spark, path).select("series", "implementation", "metric", r("value").alias("value"), "unit")


def cv_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an interrupted evaluation has left to do: the checkpoint already holds the series of returned items."""
    history, path = D.daily(spark, sf_dir).select("series_id", "ds", "y"), D.scratch(spark, "checkpoint")
    S.write_checkpoint(E.measurements(history.where("series_id = 'R'").groupBy("series_id").agg(F.avg("y").alias("mae")), "ours"), path)
    rows = E.cross_validation(history, _FLAT, *E.HORIZONS["Daily"], done=S.checkpointed(spark, path))
    return E.accuracy(rows, "series_id", "cutoff").select("series_id", day("cutoff").alias("cutoff"), *[r(c, 4).alias(c) for c in ("mae", "rmse", "mape", "smape")])


def changepoints_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model without changepoints has one dummy at the start."""
    points = P.changepoints(*_scaled(spark, sf_dir), ModelSpec(n_changepoints=0))
    return points.select("series_id", F.posexplode("changepoints_t").alias("position", "t")).select("series_id", F.col("position").cast("long").alias("position"), r("t").alias("t"))


def logistic_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic forecast asked for the approximate sampler takes the exact one."""
    history, future = _future(spark, sf_dir)
    top = history.groupBy("series_id").agg((F.max("y") * 1.25).alias("cap"))
    rows = U.predict(future.join(top, "series_id"), D.literal_models(history, "logistic"), D.literal_spec(growth="logistic"), vectorized=True)
    return rows.select("series_id", day().alias("day"), r("trend").alias("trend"), (F.col("trend_lower") <= F.col("trend_upper")).alias("ordered"), "vectorized")


def built_in_seasonalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that each way of asking for a built-in seasonality gives; 0 where there is none."""
    rows = []
    for name in ("yearly", "weekly", "daily"):
        for asked in ("auto", True, False, 7):
            for auto in (False, True):
                found = ModelSpec(**{name: asked}).built_in(name, auto)
                rows.append((name, str(asked).lower(), auto, found.order if found else 0))
    return spark.createDataFrame(rows, "name string, asked string, supported boolean, fourier_order long")


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks say of specifications and frames that can't be used, and of some that can."""
    rows, spec = D.daily(spark, sf_dir), ModelSpec()
    cases = {
        "growth": lambda: ModelSpec(growth="cubic"),
        "range": lambda: ModelSpec(changepoint_range=1.5),
        "mode": lambda: spec.add_seasonality("monthly", 30.5, 3, mode="other"),
        "prior": lambda: spec.add_regressor("disc", 0.0),
        "sampling": lambda: ModelSpec(options={"mcmc_samples": 10}),
        "reserved": lambda: spec.add_seasonality("trend", 30.5, 3),
        "delimiter": lambda: spec.add_regressor("a_delim_b"),
        "taken": lambda: spec.add_seasonality("monthly", 30.5, 3).add_regressor("monthly"),
        "order": lambda: spec.add_seasonality("monthly", 30.5, 0),
        "columns": lambda: P.clean_history(rows.drop("y")),
        "time zone": lambda: P.clean_history(rows.withColumn("ds", F.col("ds").cast("timestamp"))),
        "regressor": lambda: X.regressor_stats(rows, spec.add_regressor("none").regressors),
        "own weekly": lambda: spec.add_seasonality("weekly", 7, 2),
        "absmax": lambda: ModelSpec(options={"scaling": "absmax"}),
    }

    def said(case) -> str:
        try:
            case()
        except (ValueError, NotImplementedError) as e:
            return str(e)
        return "ok"

    return spark.createDataFrame([(name, said(case)) for name, case in cases.items()], "case string, message string")


def holidays_only_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A country's holiday that falls on no year of the history has no column in the fit, hence no effect on the forecast."""
    history, spec = D.daily(spark, sf_dir), _FLAT.add_country_holidays("AA")
    later = history.groupBy().agg(F.date_trunc("year", F.add_months(F.max("ds"), 12)).cast("timestamp_ntz").alias("ds")).select(F.lit("AA").alias("country"), "ds", F.lit("later").alias("holiday"))
    calendar = _firsts(spark, sf_dir).unionByName(later)
    models = FIT.fit(history, spec, calendar=calendar)
    rows = FC.predict_point(FC.future_frame(history, 400), models, spec, calendar=calendar)
    return rows.select("series_id", day().alias("day"), r("yhat", 4).alias("yhat"))


def holidays_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays registered anew stand in place of the earlier ones; their prior scale is the default of later regressors."""
    spec = ModelSpec().add_holidays([Holiday("old", datetime(1998, 1, 1), 0, 0)], prior_scale=2.0).add_holidays([*HOLIDAYS], prior_scale=4.0, mode="multiplicative").add_regressor("disc")
    cols = X.design_columns(spec, spec.seasonalities_for(False, False, False))
    return spark.createDataFrame([(k, c.name, float(c.prior_scale), c.mode) for k, c in enumerate(cols)], "position long, name string, prior_scale double, mode string")


def fit_many_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default model for each supplier's weekly quantity."""
    rows = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("series_id"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("ds"))
    models = FIT.fit(rows.agg(F.sum("l_quantity").alias("y")), ModelSpec())
    return models.select("series_id", "n", "status", (F.col("kkt") < 1e-3).alias("kkt_ok"), F.size("delta").cast("long").alias("n_changepoints"))


def sample_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_name").alias("series_id"), F.col("c_mktsegment").alias("frequency"))
    return S.sample_series(rows, 7, 3)


def seasonality_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [f(spark, sf_dir).select("series_id", "ds", "y") for f in (D.daily, D.hourly)]
    return P.seasonality_warnings(P.series_stats(P.clean_history(rows[0].unionByName(rows[1]))), ModelSpec(yearly=True, weekly=False))


def tau_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FIT.tau_path(D.daily(spark, sf_dir), ModelSpec(yearly=2), [0.001, 0.05, 5.0])
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), (F.max("kkt") < 1e-3).alias("kkt_ok"), (F.max(F.struct("tau", "sum_abs_delta"))["sum_abs_delta"] >= F.min(F.struct("tau", "sum_abs_delta"))["sum_abs_delta"]).alias("grows"))


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of series made from known parameters, in the posterior's own metric."""
    base = D.table(spark, sf_dir, "region").select(F.col("r_name").alias("series_id"), (1.0 + F.col("r_regionkey")).alias("k"))
    made = base.select(
        "series_id", F.lit("2015-01-01").cast("date").alias("start"), F.lit(400).alias("rows"), "k", F.lit(2.0).alias("m"), F.array(F.lit(0.0)).alias("delta"), F.array(F.lit(0.0)).alias("changepoints_t"),
        F.lit(0.0).alias("amplitude"), F.lit(7.0).alias("period"), F.lit(0.05).alias("sigma"),
    )
    history, spec = S.generate(spark, made), ModelSpec(changepoints=(), yearly=False, weekly=False, daily=False)
    models = FIT.fit(history, spec)
    none = F.array().cast("array<double>")
    truths = models.select("series_id", "y_scale").join(base, "series_id").select("series_id", (F.col("k") / F.col("y_scale")).alias("k"), (2.0 / F.col("y_scale")).alias("m"), F.array(F.lit(0.0)).alias("delta"), none.alias("beta"))
    rows = FIT.recovery(history, models, truths, spec)
    return rows.select("series_id", (F.col("k_error") < 0.02).alias("k_ok"), (F.col("m_error") < 0.02).alias("m_ok"), (F.col("identified_error") < 10).alias("identified_ok"), ((F.col("least_curvature") > 0) & (F.col("excess_over_truth") < 0) & (F.abs(F.col("excess_over_truth") - F.col("predicted_excess")) < 1e-6)).alias("curved"))


NAMES = (
    "clean_history history_status history_spacing auto_seasonality scale_history changepoints changepoints_explicit linear_init flat_init logistic_init capacity_status fourier_weekly fourier_yearly "
    "conditional_seasonality holiday_features country_holidays regressor_standardize design_columns gram_matrix trend_linear trend_flat trend_logistic predict_point predict_multiplicative components "
    "future_frame regressor_fill trend_uncertainty_approx trend_uncertainty_exact yhat_interval predictive_samples fit_kkt fit_constant_series fit_recovers fit_multiplicative fit_logistic cv_cutoffs "
    "cv_metrics cross_validation paired_summary stratified_summary holm scaling_slope memory_fit showcase_selection sparsity measurements agreement_gate unpivot_series corpus_digest corpus_profile "
    "corpus_drift census stream_scoring flagship sample_series seasonality_warnings tau_path recovery fit_many_series "
    "fit_closed_form fit_standardized fit_country_holidays fit_nested_regressor cv_closed_form certificate_literal trend_logistic_floor predict_from_json component_membership gate_kernels "
    "corpus_exclusions resummarise manifest csv_scan facts_files cv_resumed changepoints_none logistic_sampler built_in_seasonalities rejections holidays_only_ahead holidays_replaced"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
