"""Specifications, features, fits, forecasts and persistence over small histories."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from cadenza.operators import evaluate as E
from cadenza.operators import fit as FIT
from cadenza.operators import forecast as FC
from cadenza.operators import prepare as P
from cadenza.operators import uncertainty as U
from cadenza.sources import series as SRC
from cadenza.sources import store
from cadenza.spec import Holiday, ModelSpec
from cadenza.streaming.scoring import rolling_errors, score_stream
from pyspark.sql import functions as F

START = datetime(2015, 1, 1)


def frame(spark, n=200, series=("a", "b"), extra=()):
    rows = []
    for s, name in enumerate(series):
        r = np.random.default_rng(s)
        for i in range(n):
            y = 5 + s + 0.01 * i + 0.5 * np.sin(2 * np.pi * i / 7) + 0.05 * r.standard_normal()
            rows.append((name, START + timedelta(days=i), float(y), float(i % 17), float(i % 5 == 0), i % 2 == 0, 20.0))
    return spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double, temp double, promo double, even boolean, cap double")


def test_spec_validation():
    for bad in (dict(growth="cubic"), dict(changepoint_range=1.5), dict(mode="x"), dict(changepoint_prior_scale=0), dict(n_changepoints=-1)):
        with pytest.raises(ValueError):
            ModelSpec(**bad)
    with pytest.raises(NotImplementedError):
        ModelSpec(options={"mcmc_samples": 100})
    with pytest.raises(ValueError):
        ModelSpec(holidays=(Holiday("h", START, 1, 0),))
    with pytest.raises(ValueError):
        ModelSpec(holidays=(Holiday("h", START, prior_scale=1.0), Holiday("h", START, prior_scale=2.0)))
    spec = ModelSpec()
    for name in ("trend", "yhat_lower", "a_delim_b", "ds", "holidays"):
        with pytest.raises(ValueError):
            spec.add_regressor(name)
    assert spec.add_seasonality("weekly", 7, 5).built_in("weekly", True) is None
    with pytest.raises(ValueError):
        spec.add_regressor("temp").add_seasonality("temp", 3, 1)
    with pytest.raises(ValueError):
        spec.add_seasonality("m", 30, 0)
    assert ModelSpec(weekly=1).built_in("weekly", False).order == 1 and ModelSpec(weekly=True).built_in("weekly", False).order == 3
    assert [s.name for s in spec.add_seasonality("m", 30, 2).seasonalities_for(True, True, False)] == ["m", "yearly", "weekly"]
    assert spec.add_regressor("x").regressors[0].prior_scale == spec.holidays_prior_scale
    assert ModelSpec(changepoints=(START,)).n_changepoints == 1 and spec.add_country_holidays("TU").country == "TR"


def test_input_errors(spark):
    good = frame(spark, 10, ("a",))
    with pytest.raises(ValueError, match='must have columns "ds" and "y"'):
        P.clean_history(good.drop("y"))
    with pytest.raises(ValueError, match="timezone"):
        P.clean_history(good.withColumn("ds", F.col("ds").cast("timestamp")))
    with pytest.raises(ValueError, match="less than 2"):
        P.raise_for_status(good.withColumn("y", F.lit(None).cast("double")))
    P.raise_for_status(good)
    with pytest.raises(ValueError, match="Capacities"):
        FIT.fit(good.drop("cap"), ModelSpec(growth="logistic"))


def test_changepoint_rules(spark):
    for n, want in ((2, 0), (3, 1), (20, 15), (26, 19), (40, 25), (200, 25)):
        df = P.clean_history(frame(spark, n, ("a",)))
        stats = P.series_stats(df)
        found = P.changepoints(P.scale_history(df, stats), stats, ModelSpec()).first().changepoints_t
        hist = int(np.floor(n * 0.8))
        k = hist - 1 if 26 > hist else 25
        index = np.linspace(0, hist - 1, k + 1).round().astype(int)[1:] if k > 0 else []
        expected = [i / (n - 1) for i in index] or [0.0]
        assert np.allclose(found, expected) and (len(index) == want or want == 0)
    spec = ModelSpec(changepoints=(START - timedelta(days=1),))
    df = P.clean_history(frame(spark, 20, ("a",)))
    stats = P.series_stats(df)
    with pytest.raises(Exception, match="within training data"):
        P.changepoints(P.scale_history(df, stats), stats, spec).collect()


def test_fit_is_certified_and_forecasts(spark):
    df, spec = frame(spark, 300), ModelSpec(uncertainty_samples=50)
    models = FIT.fit(df, spec).cache()
    for r in FIT.certificate(df, models, spec).collect():
        assert r.kkt < 1e-4 and r.n_zero_rates > 0
    out = U.predict(FC.future_frame(df, 14), models, spec).cache()
    assert out.count() == 2 * 314
    assert out.where("abs(yhat - trend - seasonality) > 1e-9 or yhat_lower > yhat_upper").count() == 0
    truth = out.where("ds > '2015-10-27'").collect()
    for r in truth:
        i = (r.ds - START).days
        assert abs(r.yhat - (5 + (r.series_id == "b") + 0.01 * i + 0.5 * np.sin(2 * np.pi * i / 7))) < 0.25
    band = U.intervals(U.predictive_samples(FC.future_frame(df, 14), models, spec), 0.8, "trend")
    assert band.where("ds < '2015-10-28' and abs(trend_upper - trend_lower) > 1e-9").count() == 0
    assert FIT.get_parameters(models).select(F.size("theta")).first()[0] == 2 + 25 + 1 + 6


def test_holidays_conditions_regressors_components(spark):
    spec = ModelSpec(weekly=False, holidays=(Holiday("h", START + timedelta(days=30), -1, 1),)).add_seasonality("even_week", 7, 2, condition_name="even").add_regressor("temp").add_regressor("promo", mode="additive")
    df = frame(spark, 150).withColumn("y", F.col("y") + 3 * F.col("promo") + F.when(F.col("ds") == START + timedelta(days=30), 4.0).otherwise(0.0))
    models = FIT.fit(df, spec).cache()
    rows = FC.predict_components(df, models, spec).cache()
    got = rows.where(F.col("ds") == START + timedelta(days=30)).first()
    assert got.h > 2 and rows.where(F.col("ds") == START + timedelta(days=40)).first().h == 0
    assert rows.join(df.where("not even").select("series_id", "ds"), ["series_id", "ds"]).where("even_week <> 0").count() == 0
    total = F.abs(F.col("additive_terms") - F.col("even_week") - F.col("h") - F.col("temp") - F.col("promo"))
    assert rows.where(total > 1e-9).count() == 0 and rows.where("holidays <> h or extra_regressors_additive <> temp + promo").count() == 0
    point = FC.predict_point(df, models, spec).join(rows, ["series_id", "ds"])
    assert point.where("abs(yhat - trend - additive_terms) > 1e-9").count() == 0
    with pytest.raises(Exception, match="non-boolean"):
        FC.predict_point(df.withColumn("even", F.lit(None).cast("boolean")), models, spec).collect()


def test_multiplicative_and_logistic(spark):
    df = frame(spark, 220).withColumn("y", F.exp(F.col("y") / 10))
    for spec in (ModelSpec(mode="multiplicative", n_changepoints=4), ModelSpec(growth="logistic", n_changepoints=4), ModelSpec(growth="flat"), ModelSpec(growth="logistic", mode="multiplicative", n_changepoints=3)):
        models = FIT.fit(df, spec).cache()
        assert [r.status for r in models.collect()] == ["ok", "ok"]
        err = FC.predict_point(df, models, spec).join(df.select("series_id", "ds", "y"), ["series_id", "ds"]).select(F.avg(F.abs(F.col("yhat") - F.col("y")))).first()[0]
        assert err < (0.2 if spec.growth == "flat" else 0.06), spec


def test_exact_sampler_and_logistic_draws(spark):
    df = frame(spark, 120, ("a",))
    for spec in (ModelSpec(uncertainty_samples=200), ModelSpec(growth="logistic", n_changepoints=5, uncertainty_samples=40)):
        models = FIT.fit(df, spec).cache()
        future = FC.future_frame(df, 30, False).withColumn("cap", F.lit(20.0))
        a = U.predict(future, models, spec, vectorized=False)
        assert a.where("trend_lower > trend + 1e-6 or trend_upper < trend - 1e-6").count() == 0 and a.count() == 30
        assert a.first().vectorized is False


def test_samplers_agree(spark):
    df, spec = frame(spark, 120, ("a",)), ModelSpec(uncertainty_samples=400)
    models = FIT.fit(df, spec).withColumn("delta", F.transform("delta", lambda _: F.lit(0.5))).cache()
    widths = []
    for v in (True, False):
        draws = U.predictive_samples(FC.future_frame(df, 40, False), models, spec, vectorized=v)
        widths.append(draws.groupBy("ds").agg((F.stddev("trend")).alias("w")).orderBy(F.desc("ds")).first().w)
    assert 0.75 < widths[0] / widths[1] < 1.33


def test_draws_do_not_depend_on_partitioning(spark):
    df, spec = frame(spark, 60, ("a", "b")), ModelSpec(uncertainty_samples=10)
    models = FIT.fit(df, spec).cache()
    one = sorted(map(tuple, U.predictive_samples(FC.future_frame(df, 5, False), models, spec).collect()))
    two = sorted(map(tuple, U.predictive_samples(FC.future_frame(df, 5, False).repartition(7), models.repartition(3), spec).collect()))
    assert one == two


def test_nested_regressor(spark):
    spec = ModelSpec(uncertainty_samples=20).add_regressor("temp", predictor=ModelSpec(yearly=False))
    df = frame(spark, 150)
    models, nested = FIT.fit(df, spec), FIT.fit_regressors(df, spec)
    future = FC.future_frame(df, 10)
    own = spec.regressors[0].predictor
    filled = FC.fill_regressors(future, df, {"temp": FC.predict_point(future, nested["temp"], own)})
    assert filled.where("temp is null").count() == 0
    draws = {"temp": U.predictive_samples(future, nested["temp"], own, n=20)}
    assert U.predict(filled, models, spec, regressor_draws=draws).where("yhat_lower <= yhat_upper").count() == 2 * 160


def test_models_round_trip(spark, tmp_path):
    df, spec = frame(spark, 60), ModelSpec()
    models = FIT.fit(df, spec).cache()
    store.save_models(models, str(tmp_path / "m"))
    want = sorted(map(tuple, FC.predict_point(df, models, spec).collect()))
    assert sorted(map(tuple, FC.predict_point(df, store.load_models(spark, str(tmp_path / "m")), spec).collect())) == want
    assert sorted(map(tuple, FC.predict_point(df, store.from_json(store.to_json(models)), spec).collect())) == want
    with pytest.raises(ValueError, match="Model has not been fit"):
        store.require_fitted(models.where("series_id = 'a'"), df)


def test_refit_is_fresh(spark):
    a, b = frame(spark, 60, ("a",)), frame(spark, 90, ("a",))
    spec = ModelSpec()
    FIT.fit(a, spec).collect()
    assert [tuple(r) for r in FIT.fit(b, spec).collect()] == [tuple(r) for r in FIT.fit(b, spec).collect()]


def test_long_series_are_summed_by_chunks(spark, monkeypatch):
    df, spec = frame(spark, 200, ("a",)), ModelSpec()
    one = FIT.fit(df, spec).first()
    monkeypatch.setattr(FIT, "CHUNK", 16)
    assert FIT.gram(df, spec).count() > 5
    two = FIT.fit(df, spec).first()
    assert np.allclose(one.beta, two.beta, atol=1e-6) and np.isclose(one.lp, two.lp)


def test_cross_validation_resumes(spark):
    df = frame(spark, 200).select("series_id", "ds", "y")
    done = spark.createDataFrame([("a",)], "series_id string")
    rows = E.cross_validation(df, ModelSpec(yearly=False, uncertainty_samples=20), 20, 100, 40, bounds=True, done=done)
    scores = E.accuracy(rows, "series_id", "cutoff", bounds=True).collect()
    assert {r.series_id for r in scores} == {"b"} and len(scores) == 2 and all(r.mae < 0.5 for r in scores)


def test_facts_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("a", 1.5, 2.0), ("b", 0.5, None)], "series_id string, mae double, rmse double")
    facts = E.measurements(wide, "ours")
    SRC.write_facts(facts, str(tmp_path / "f"), note="x")
    assert SRC.read_facts(spark, str(tmp_path / "f")).count() == 4
    assert SRC.checkpointed(spark, str(tmp_path / "none")) is None
    members = spark.createDataFrame([("Daily", "a"), ("Daily", "b")], "frequency string, series_id string")
    digest = {r.frequency: r.digest for r in SRC.membership_digest(members).collect()}
    SRC.check_digest(members, digest)
    with pytest.raises(ValueError):
        SRC.check_digest(members.limit(1), digest)


def test_streaming_scores(spark, tmp_path):
    df, spec = frame(spark, 60).select("series_id", "ds", "y"), ModelSpec()
    models = FIT.fit(df, spec).cache()
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, models, spec).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 120
    assert rolling_errors(score_stream(df, models, spec), "7 days").count() > 10


def test_sign_test_is_exact(spark):
    from math import comb

    from cadenza.functions.expressions import sign_test

    pairs = [(a, b) for a in range(0, 14) for b in range(0, 14)] + [(400, 500)]
    for r in spark.createDataFrame(pairs, "a long, b long").withColumn("p", sign_test(F.col("a"), F.col("b"))).collect():
        n = r.a + r.b
        want = min(1.0, 2 * sum(comb(n, i) for i in range(min(r.a, r.b) + 1)) / 2**n) if n >= 6 else None
        assert (r.p is None) == (want is None) and (want is None or abs(r.p - want) < 1e-9)
