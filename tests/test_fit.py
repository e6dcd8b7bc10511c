"""Country holidays, floors, nested regressors, saddles, traces and manifests."""

from datetime import timedelta

import numpy as np
import pytest
from cadenza.functions import draws
from cadenza.operators import fit as FIT
from cadenza.operators import forecast as FC
from cadenza.operators import solve as S
from cadenza.operators import uncertainty as U
from cadenza.sources import series as SRC
from cadenza.spec import Holiday, ModelSpec
from pyspark.sql import functions as F
from test_model import START, frame

PLAIN = ModelSpec(yearly=False, weekly=False, daily=False, n_changepoints=2, uncertainty_samples=20)


def calendar(spark):
    days = [("XX", START + timedelta(days=d), "feast") for d in (20, 60, 215)] + [("XX", START - timedelta(days=4000), "old"), ("YY", START, "other")]
    return spark.createDataFrame(days, "country string, ds timestamp_ntz, holiday string")


def test_country_holidays_are_fitted_and_forecast(spark):
    cal = calendar(spark)
    df = frame(spark, 200, ("a",)).withColumn("y", F.col("y") + F.when(F.col("ds").isin(START + timedelta(days=20), START + timedelta(days=60)), 3.0).otherwise(0.0))
    spec = PLAIN.add_country_holidays("XX")
    with pytest.raises(ValueError, match="calendar"):
        FIT.fit(df, spec)
    models = FIT.fit(df, spec, calendar=cal).cache()
    row = models.first()
    assert row.holiday_columns == ["feast_delim_+0"] and len(row.beta) == 1 and row.beta[0] * row.y_scale > 2.5
    with pytest.raises(ValueError, match="calendar"):
        FC.predict_point(df, models, spec)
    ahead = {r.ds: r for r in FC.predict_point(FC.future_frame(df, 30, False), models, spec, calendar=cal).collect()}
    feast, next_day = ahead[START + timedelta(days=215)], ahead[START + timedelta(days=216)]
    assert feast.yhat - next_day.yhat > 2.5  # behind the history the calendar goes on
    parts = FC.predict_components(FC.future_frame(df, 30, False), models, spec, calendar=cal, intervals=False).where(F.col("ds") == START + timedelta(days=215)).first()
    assert parts.feast > 2.5 and parts.old == 0 and parts.holidays == parts.feast
    merged = spec.add_holidays([Holiday("feast", START + timedelta(days=20)), Holiday("own", START + timedelta(days=90))])
    assert FIT.fit(df, merged, calendar=cal).first().holiday_columns == ["feast_delim_+0", "own_delim_+0"]
    with pytest.raises(ValueError, match="already used for a regressor"):
        FIT.fit(df, spec.add_regressor("feast"), calendar=cal)
    with pytest.raises(ValueError, match="reserved"):
        FIT.fit(df, spec, calendar=cal.withColumn("holiday", F.lit("trend")))


def test_holidays_replace_and_scales_are_checked():
    spec = ModelSpec().add_holidays([Holiday("a", START)], prior_scale=3.0).add_holidays([Holiday("b", START)])
    assert [h.name for h in spec.holidays] == ["b"] and spec.holidays_prior_scale == 3.0
    with pytest.raises(ValueError, match="> 0"):
        ModelSpec().add_holidays([Holiday("a", START)], prior_scale=0)
    with pytest.raises(ValueError, match="finite"):
        ModelSpec().add_seasonality("s", float("inf"), 1)


def test_a_floor_is_asked_for(spark):
    df = frame(spark, 120, ("a",)).withColumn("floor", F.lit(3.0))
    spec = ModelSpec(growth="logistic", yearly=False, weekly=False, n_changepoints=2)
    models = FIT.fit(df, spec).cache()
    assert models.first().has_floor and not FIT.fit(df.drop("floor"), spec).first().has_floor
    with pytest.raises(Exception, match='Expected column "floor"'):
        FC.predict_point(df.drop("floor"), models, spec).collect()
    error = FC.predict_point(df, models, spec).join(df.select("ds", "y"), "ds").select(F.avg(F.abs(F.col("yhat") - F.col("y")))).first()[0]
    assert error < 0.45


def test_nested_regressors_need_no_wiring(spark):
    spec = PLAIN.add_regressor("temp", predictor=ModelSpec(yearly=False, weekly=True, n_changepoints=2))
    df = frame(spark, 100)
    models = FIT.fit(df, spec).cache()
    future = FC.future_frame(df, 10)
    nested = FC.predict_point(FC.future_frame(df, 10, False), FIT.nested_models(models, "temp"), spec.regressors[0].predictor)
    rows = FC.with_predicted(future, models, spec, history=df)
    assert rows.where("temp is null").count() == 0
    got = rows.join(nested, ["series_id", "ds"]).where("abs(temp - yhat) > 1e-9")
    assert rows.join(nested, ["series_id", "ds"]).count() == 20 and got.count() == 0
    assert rows.join(df.select("series_id", "ds", F.col("temp").alias("own")), ["series_id", "ds"]).where("temp <> own").count() == 0
    alone = U.predict(FC.future_frame(df, 10, False), models, spec).cache()
    fixed = U.predict(FC.future_frame(df, 10, False), models, spec, regressor_draws={}).cache()
    assert alone.count() == 20 and alone.where("yhat_lower > yhat_upper").count() == 0
    assert alone.join(fixed.select("series_id", "ds", F.col("yhat_upper").alias("other")), ["series_id", "ds"]).where("yhat_upper <> other").count() > 0
    with pytest.raises(Exception, match="Not enough data"):
        FIT.fit(df.withColumn("temp", F.when(F.col("ds") == START, 1.0)), PLAIN.add_regressor("temp", predictor=PLAIN)).collect()


def test_infinite_values_are_refused(spark):
    with pytest.raises(Exception, match="Found infinity"):
        FIT.fit(frame(spark, 30, ("a",)).withColumn("y", F.when(F.col("ds") == START, float("inf")).otherwise(F.col("y"))), PLAIN).collect()


def saddle():
    """Ten weeks and a multiplicative regressor, whose posterior has a saddle where a descent by first derivatives may stop."""
    x = np.array([-0.765373794858952, -0.745331536770327, -0.624945409342729, -0.397781064567571, -0.0697682981574691, 0.340703463699156, 0.804220969494088, 1.28317620368431, 1.73567381412022, 2.12006230186318])
    y = np.array([1, 1, 0, 1, 0, 1, 0, 2, 2, 0]) / 2
    t = np.arange(10) / 9
    rows = S.Rows(t, y, ((x - x.mean()) / x.std(ddof=1))[:, None], t[[4, 7]], "linear", np.ones(1))
    return rows, np.full(1, 10.0)


def test_saddles_are_left():
    rows, scales = saddle()
    d, l1 = S.priors({"tau": 0.05}, 2, scales)
    r = np.random.default_rng(193)
    starts = [np.r_[r.normal(0, 1), r.normal(0.5, 0.5), r.normal(0, 0.1, 2), r.normal(0, 1)] for _ in range(10)] + [np.r_[0.0, 0.5, 0, 0, 0.0], np.r_[-0.29145, 0.23628, 0, 0, -1.02744]]
    found = [S.fit_rows(rows, x, scales, 0.05) for x in starts]
    best = max(f.lp for f in found)
    for f in found:
        theta = np.r_[f.k, f.m, f.delta, f.beta]
        assert f.status == "ok" and S.downwards(rows, theta, d, l1) is None, f
        assert S.least_curvature(rows, theta, d, l1) > -1e-6
    assert max(f.lp for f in found[-2:]) > best - 1e-6
    level = np.r_[0.0, 0.35, 0.0, 0.0, 0.0]
    slope = rows.gradient(level, S._value(rows, level, d, l1)[1])[1]
    assert np.isfinite(slope).all() and all(a >= b for a, b in zip(found[0].trace, found[0].trace[1:], strict=False))


def test_initial_points_are_used():
    rows, scales = saddle()
    first = next(FIT.starting_points(rows, scales, ModelSpec(), {"k": 2.0, "m": 1.0, "delta": [0.1, 0.2], "beta": [0.5]}))
    assert first.tolist() == [2.0, 1.0, 0.1, 0.2, 0.5]
    with pytest.raises(ValueError, match="entries"):
        list(FIT.starting_points(rows, scales, ModelSpec(), {"beta": [1.0, 2.0]}))


def test_quadratic_change_is_the_change_of_a_quadratic():
    r = np.random.default_rng(1)
    a = r.normal(size=(5, 5))
    h, g, l1 = a @ a.T, r.normal(size=5), np.array([0.0, 1.0, 2.0, 0.0, 3.0])
    f = lambda x: x @ h @ x / 2 + g @ x + l1 @ np.abs(x)
    for _ in range(10):
        x, y = r.normal(size=5), r.normal(size=5)
        assert np.isclose(S.quadratic_change(h, x, y, h @ x + g, l1), f(y) - f(x))
    assert np.isclose(S.quadratic_distance(h, x, y), (y - x) @ h @ (y - x) / 2)


def test_kernels_traces_and_certificates(spark):
    df, spec = frame(spark, 80, ("a",)), ModelSpec(yearly=False, n_changepoints=4)
    a, b = FIT.fit(df, spec, kernel="moments").cache(), FIT.fit(df, spec, kernel="rows").cache()
    assert abs(a.first().lp - b.first().lp) < 1e-5 * abs(a.first().lp)
    for m in (a, b):
        rows = FIT.loss_envelope(m).orderBy("round").collect()
        assert rows and all(r.envelope <= r.loss for r in rows) and rows[-1].envelope == min(r.loss for r in rows) and abs(rows[-1].envelope + m.first().lp) < 1e-6
    mult = ModelSpec(mode="multiplicative", yearly=False, n_changepoints=3)
    models = FIT.fit(df, mult).cache()
    own = FIT.certificate(df, models, mult).first()
    assert own.kkt < 1e-3 and own.least_curvature > -1e-6 and abs(own.objective + models.first().lp) < 1e-6
    moved = FIT.certificate(df, models.withColumn("k", F.col("k") + 0.1), mult).first()
    assert moved.kkt > 1 and moved.objective > own.objective
    with pytest.raises(ValueError, match="moments kernel"):
        FIT.fit(df, mult, kernel="moments")


def test_logistic_rates_may_be_zero(spark):
    from cadenza.functions.expressions import logistic_offsets, logistic_trend

    delta, s = [-2.0, 1.0], [0.3, 0.6]
    arrays = [F.array(*[F.lit(v) for v in x]) for x in (delta, s)]
    row = spark.range(1).select(logistic_trend(F.lit(0.5), F.lit(1.0), F.lit(2.0), F.lit(0.1), *arrays).alias("flat"), logistic_trend(F.lit(0.3), F.lit(1.0), F.lit(2.0), F.lit(0.1), *arrays).alias("edge"), logistic_offsets(F.lit(2.0), F.lit(0.1), *arrays).alias("offsets")).first()
    assert np.isclose(row.flat, row.edge) and np.isclose(row.flat, 1 / (1 + np.exp(-0.4)))
    gamma, jac = S.logistic_parts(2.0, 0.1, np.array(delta), np.array(s))
    assert np.allclose(row.offsets, gamma) and gamma[0] == 0 and np.isfinite(jac).all()
    for k in range(4):
        step = np.zeros(4)
        step[k] = 1e-6
        at = lambda e: S.logistic_parts(2.0 + e[0], 0.1 + e[1], np.array([0.5, 1.0]) + e[2:], np.array(s))[0]
        assert np.allclose(S.logistic_parts(2.0, 0.1, np.array([0.5, 1.0]), np.array(s))[1][:, k], (at(step) - at(-step)) / 2e-6, atol=1e-6)


def test_draws_are_even():
    u = draws.uniforms([draws.key(0, "x", k) for k in range(200)], 1000)
    assert abs(u.mean() - 0.5) < 0.003 and abs(np.quantile(u, 0.1) - 0.1) < 0.004 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01
    assert abs(draws.normal(u[:100], u[100:]).std() - 1) < 0.01 and abs(np.abs(draws.laplace(u, 2.0)).mean() - 2) < 0.03
    assert (draws.uniforms([5], 10)[0][:4] == draws.uniforms([5], 4)[0]).all()


def test_manifests_and_checkpoints(spark, tmp_path):
    members = spark.createDataFrame([("Weekly", "w1"), ("Daily", "b"), ("Daily", "a")], "frequency string, series_id string")
    SRC.write_manifest(members, str(tmp_path / "m"))
    assert sorted(map(tuple, SRC.read_manifest(spark, str(tmp_path / "m")).collect())) == [("Daily", "a"), ("Daily", "b"), ("Weekly", "w1")]
    text = spark.read.text(str(tmp_path / "m")).first()[0]
    spark.createDataFrame([(text.replace("w1", "w2"),)], "value string").write.text(str(tmp_path / "n"))
    with pytest.raises(ValueError, match="edited"):
        SRC.read_manifest(spark, str(tmp_path / "n"))
    facts = spark.createDataFrame([(2, "a", "default", "ours", "mae", 1.0, "")], SRC.FACTS)
    SRC.write_checkpoint(facts, str(tmp_path / "c"))
    SRC.write_checkpoint(facts.withColumn("series", F.lit("b")), str(tmp_path / "c"))
    assert {r.series_id for r in SRC.checkpointed(spark, str(tmp_path / "c")).collect()} == {"a", "b"}


def test_components_of_two_modes_are_refused():
    from cadenza.operators.features import DesignColumn, components

    with pytest.raises(ValueError, match="both"):
        components([DesignColumn("a", "x", 1.0, "additive", "holiday"), DesignColumn("b", "x", 1.0, "multiplicative", "regressor")])

