"""Sampled uncertainty: trend draws, predictive draws and centred intervals.

Rows are dealt and sorted by series once; a task walks each series' dates in order with one vector of samples as state, and takes the
quantiles where the draws are, so neither draws nor joins on them cross the network. Random numbers depend on (seed, stream, series,
step or date, sample) alone (``functions.draws``): neither partitioning, retries nor row order change a draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as R
from ..spec import ModelSpec
from .fit import PART_BYTES, nested_models
from .forecast import future_frame, joined, with_point
from .prepare import parts_for

SEED = 0
#: Bytes of draws held at a time.
_HELD = 4 << 20
_POINT = ["trend", "seasonality", "yhat"]


class _Series:
    """One series' trend samplers, fed its dates in order."""

    def __init__(self, series: str, first: dict, n: int, vectorized: bool, growth: str, seed: object) -> None:
        self.series, self.n, self.seed, self.growth = series, n, seed, growth
        self.delta, self.points = (np.array(first[c], float) for c in ("delta", "changepoints_t"))
        self.k, self.m = first["k"], first["m"]
        #: The scale of new rate changes: the fitted ones' mean size, never quite 0.
        self.scale = float(np.abs(self.delta).sum() / len(self.delta) + 1e-8) if len(self.delta) else 1e-8
        self.approximate = vectorized and growth == "linear"
        if self.approximate:
            ahead = first["n_future"]
            self.width = (first["t_hi"] - first["t_lo"]) / (ahead - 1) if ahead > 1 else first["history_step"]
            self.step, self.shift, self.slope, self.value = 0, np.zeros(n), np.zeros(n), np.zeros(n)
        elif growth != "flat":
            self.events = list(self._events(max(0.0, (first["t_hi"] or 0.0) - 1.0)))

    def _key(self, stream: str, at: object) -> int:
        return R.key(self.seed, stream, self.series, at)

    def _events(self, length: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Times and sizes of new rate changes on (1, 1 + length], the e-th of every sample together: a Poisson process as sums of exponential waits
        with the fitted changepoints' rate, and Laplace sizes. A sample without an e-th change has it at infinity."""
        rate, at, e = float(len(self.points)), np.zeros(self.n), 0
        while rate and length:
            e += 1
            at = at - np.log(np.maximum(R.uniforms([self._key("wait", e)], self.n)[0], R.LEAST)) / rate
            here = at <= length
            if not here.any():
                return
            yield np.where(here, 1.0 + at, np.inf), R.laplace(R.uniforms([self._key("jump", e)], self.n)[0], self.scale)

    def deviation(self, t: np.ndarray) -> np.ndarray:
        """Dates by samples: how far the scaled trend (or the argument of the logistic curve) leaves the fitted one. 0 up to the history's end."""
        out = np.zeros((len(t), self.n))
        ahead = np.flatnonzero(t > 1)
        if self.growth == "flat" or not len(ahead):
            return out
        if not self.approximate:
            for at, size in self.events:
                out[ahead] += np.where(t[ahead, None] >= at, size * np.maximum(t[ahead, None] - np.where(np.isfinite(at), at, 0.0), 0.0), 0.0)
            return out
        # Every future step may change the slope; a change is split over its step and the next one, summed to slopes and again to values.
        steps = range(self.step + 1, self.step + 1 + len(ahead))
        coin = R.uniforms([self._key("coin", s) for s in steps], self.n) < len(self.points) * self.width
        shift = np.where(coin, R.laplace(R.uniforms([self._key("size", s) for s in steps], self.n), self.scale), 0.0)
        half = (np.vstack([self.shift, shift[:-1]]) + shift) / 2
        slope = np.cumsum(np.vstack([self.slope, half]), axis=0)[1:]
        value = np.cumsum(np.vstack([self.value, slope]), axis=0)[1:]
        self.step, self.shift, self.slope, self.value = self.step + len(ahead), shift[-1], slope[-1], value[-1]
        out[ahead] = value * self.width
        return out

    def trend(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        t, scale = rows["t"], rows["y_scale"][:, None]
        moved = self.deviation(t)
        if self.growth != "logistic":
            return rows["trend"][:, None] + moved * scale
        argument = self.k * (t - self.m) + np.maximum(t[:, None] - self.points, 0.0) @ self.delta
        x = argument[:, None] + moved
        e = np.exp(-np.abs(x))
        return rows["cap_scaled"][:, None] * np.where(x >= 0, 1.0 / (1.0 + e), e / (1.0 + e)) * scale + rows["floor"][:, None]

    def noise(self, dates: list[str]) -> np.ndarray:
        u, v = (R.uniforms([self._key(s, d) for d in dates], self.n) for s in ("noise1", "noise2"))
        return R.normal(u, v)


def _drawn(rows: DataFrame, spec: ModelSpec, n: int, vectorized: bool, seed: object, effects: list[str], use: Callable[[np.ndarray, np.ndarray, dict], list[pa.Array]], schema: str, source: DataFrame) -> DataFrame:
    """``use`` on blocks of dates by samples: trend draws, yhat draws and the rows' columns. Returns series_id, ds and what it gives."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    growth, mult = spec.growth, [r.mode == "multiplicative" for r in spec.regressors if r.name in effects]
    numbers = ["t", "trend", "seasonality", "yhat", "lift", "additive", "y_scale", "floor", "sigma_obs", *(["cap_scaled"] if growth == "logistic" else []), *[f"_{x}_{e}" for e in effects for x in ("value", "effect")]]
    each = max(1, _HELD // (8 * max(1, n)))
    whole = Window.partitionBy("series_id")
    ahead = F.when(F.col("t") > 1, F.col("t"))
    rows = rows.repartition(parts_for(source, PART_BYTES), "series_id")
    rows = rows.withColumns({"n_future": F.count(ahead).over(whole), "t_lo": F.min(ahead).over(whole), "t_hi": F.max(ahead).over(whole), "_at": F.date_format("ds", "yyyy-MM-dd HH:mm:ss"), "history_step": 1.0 / F.greatest(F.col("_n_history") - 1, F.lit(1))})
    rows = rows.select("series_id", "ds", "us", "_at", *numbers, "k", "m", "delta", "changepoints_t", "n_future", "t_lo", "t_hi", "history_step", *[f"_draws_{e}" for e in effects]).sortWithinPartitions("series_id", "us", "ds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            series = b.column("series_id").to_pylist()
            begins = [k for k in range(b.num_rows) if k == 0 or series[k] != series[k - 1]]
            for lo, hi in zip(begins, [*begins[1:], b.num_rows], strict=True):
                if state is None or series[lo] != now:
                    now = series[lo]
                    state = _Series(now, b.slice(lo, 1).to_pylist()[0], n, vectorized, growth, seed)
                for at in range(lo, hi, each):
                    part = b.slice(at, min(each, hi - at))
                    own = {c: part.column(c).to_numpy(zero_copy_only=False) for c in numbers}
                    trend = state.trend(own)
                    lift, additive = np.repeat(own["lift"][:, None], n, 1), np.repeat(own["additive"][:, None], n, 1)
                    for name, m in zip(effects, mult, strict=True):
                        values = [np.full(n, v) if d is None else np.asarray(d, float) for d, v in zip(part.column(f"_draws_{name}").to_pylist(), own[f"_value_{name}"], strict=True)]
                        moved = np.where(own["t"][:, None] > 1, np.stack(values) - own[f"_value_{name}"][:, None], 0.0) * own[f"_effect_{name}"][:, None]
                        lift, additive = (lift + moved, additive) if m else (lift, additive + moved)
                    scale = own["y_scale"][:, None]
                    yhat = trend * lift + additive * scale + state.noise(part.column("_at").to_pylist()) * own["sigma_obs"][:, None] * scale
                    yield pa.RecordBatch.from_arrays([part.column("series_id"), part.column("ds"), *use(trend, yhat, own)], ["series_id", "ds", *names])

    return rows.mapInArrow(run, f"series_id string, ds timestamp_ntz, {schema}")


def _with_regressor_draws(rows: DataFrame, future: DataFrame, models: DataFrame, spec: ModelSpec, n: int, vectorized: bool, seed: object, calendar: DataFrame | None, given: dict[str, DataFrame] | None) -> tuple[DataFrame, list[str]]:
    """Adds the draws of regressors that have models of their own, or those ``given`` as rows (series_id, ds, sample, yhat)."""
    own = [r for r in spec.regressors if (r.name in given if given is not None else r.predictor is not None)]
    for r in own:
        if given is not None:
            found = given[r.name].groupBy("series_id", "ds").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "yhat"))), lambda x: x["yhat"]).alias(f"_draws_{r.name}"))
        else:
            dates = rows.where("t > 1").select("series_id", "ds").distinct()
            found = sample_arrays(dates, nested_models(models, r.name), r.predictor, vectorized=vectorized, seed=f"{seed}|{r.name}", n=n, calendar=calendar).select("series_id", "ds", F.col("yhat").alias(f"_draws_{r.name}"))
        k = [x.name for x in spec.regressors].index(r.name)
        effect = F.element_at("beta", k - len(spec.regressors)) / F.get("regressor_std", F.lit(k))
        rows = rows.join(found, ["series_id", "ds"], "left").withColumn(f"_value_{r.name}", F.col(r.name).cast("double")).withColumn(f"_effect_{r.name}", effect)
    return rows, [r.name for r in own]


def _quantiles(width: float) -> Callable[[np.ndarray], list[pa.Array]]:
    return lambda x: [pa.array(q) for q in np.quantile(x, edges(width), axis=1)]


def _rows(future: DataFrame, models: DataFrame, spec: ModelSpec, holidays: DataFrame | None, calendar: DataFrame | None, history: DataFrame | None) -> DataFrame:
    rows = with_point(joined(future, models, spec, holidays, calendar, history), spec)
    return rows.withColumn("seasonality", F.col("additive") * F.col("y_scale") + F.col("trend") * (F.col("lift") - 1.0))


def sample_arrays(future: DataFrame, models: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, vectorized: bool = True, seed: object = SEED, n: int | None = None, calendar: DataFrame | None = None, history: DataFrame | None = None, regressor_draws: dict[str, DataFrame] | None = None) -> DataFrame:
    """series_id, ds, trend, yhat: arrays of draws of the trend and of the observation, the k-th entries of one series belonging together.
    Dates must be distinct within a series. Logistic growth always takes the exact sampler."""
    n = spec.uncertainty_samples if n is None else n
    rows, effects = _with_regressor_draws(_rows(future, models, spec, holidays, calendar, history), future, models, spec, n, vectorized, seed, calendar, regressor_draws)
    listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))
    return _drawn(rows, spec, n, vectorized, seed, effects, lambda trend, yhat, own: [listed(trend), listed(yhat)], "trend array<double>, yhat array<double>", future)


def predictive_samples(future: DataFrame, models: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, vectorized: bool = True, seed: object = SEED, n: int | None = None, regressor_draws: dict[str, DataFrame] | None = None, calendar: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """series_id, ds, sample, trend, yhat: ``sample_arrays``, one row a draw.

    Regressors with a predictor are drawn from their own models after the history; ``regressor_draws`` gives other draws (series_id, ds, sample,
    yhat) by regressor.
    """
    rows = sample_arrays(future, models, spec, holidays, vectorized, seed, n, calendar, history, regressor_draws)
    both = F.posexplode(F.arrays_zip(F.col("trend").alias("trend"), F.col("yhat").alias("yhat"))).alias("sample", "x")
    return rows.select("series_id", "ds", both).select("series_id", "ds", "sample", "x.trend", "x.yhat")


def edges(width: float) -> tuple[float, float]:
    return (1.0 - width) / 2, (1.0 + width) / 2


def intervals(draws: DataFrame, width: float, *names: str) -> DataFrame:
    """series_id, ds and <name>_lower, <name>_upper: centred quantiles over rows of draws, linearly interpolated."""
    lo, hi = edges(width)
    return draws.groupBy("series_id", "ds").agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{e}") for c in names for e, q in (("lower", lo), ("upper", hi))])


def predict(future: DataFrame, models: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, vectorized: bool = True, seed: object = SEED, regressor_draws: dict[str, DataFrame] | None = None, calendar: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """series_id, ds, trend, trend_lower, trend_upper, yhat_lower, yhat_upper, seasonality, yhat, vectorized (which sampler ran).

    Without samples the bounds are null.
    """
    rows = _rows(future, models, spec, holidays, calendar, history)
    bounds = ["trend_lower", "trend_upper", "yhat_lower", "yhat_upper"]
    n = spec.uncertainty_samples
    if n:
        rows, effects = _with_regressor_draws(rows, future, models, spec, n, vectorized, seed, calendar, regressor_draws)
        q = _quantiles(spec.interval_width)
        schema = ", ".join(f"{c} double" for c in [*_POINT, *bounds])
        point = _drawn(rows, spec, n, vectorized, seed, effects, lambda trend, yhat, own: [*[pa.array(own[c]) for c in _POINT], *q(trend), *q(yhat)], schema, future)
    else:
        point = rows.select("series_id", "ds", *_POINT, *[F.lit(None).cast("double").alias(c) for c in bounds])
    return point.select("series_id", "ds", "trend", *bounds, "seasonality", "yhat", F.lit(vectorized and spec.growth != "logistic").alias("vectorized"))


def trend_intervals(future: DataFrame, models: DataFrame, spec: ModelSpec, vectorized: bool = True, seed: object = SEED, holidays: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """series_id, ds, trend_lower, trend_upper, without observation noise."""
    rows = _rows(future, models, spec, holidays, calendar, None)
    q = _quantiles(spec.interval_width)
    return _drawn(rows, spec, spec.uncertainty_samples, vectorized, seed, [], lambda trend, yhat, own: q(trend), "trend_lower double, trend_upper double", future)


def trend_forecast_uncertainty(models: DataFrame, spec: ModelSpec, history: DataFrame, horizon: int = 30, seed: object = SEED) -> DataFrame:
    """Exact-sampler trend bounds for ``horizon`` days after the history (linear and flat growth)."""
    return trend_intervals(future_frame(history, horizon, False), models, spec, False, seed)
