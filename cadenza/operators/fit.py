"""Fitting many series: features in Catalyst, moments or rows to a NumPy kernel, one model row a series.

Where predictions are linear in the parameters, a series' rows only enter by their moments. Rows are dealt by (series, chunk)
with at most about CHUNK rows each, so a long series is summed by many tasks; the features are computed after that shuffle, which
hence carries plain rows. A series of one chunk is solved where its rows are; of the others one matrix a chunk goes on to the
solver. Tasks stream sorted rows and take all series of a batch together, so that many short series cost no call each.
Logistic or multiplicative models need a series' rows together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expressions import seasonal_time
from ..spec import ModelSpec, Seasonality
from . import prepare as P
from . import solve as S
from .features import DesignColumn, design_columns, holiday_columns, holiday_features, holiday_table, regressor_stats, seasonality_block, train_holiday_columns

CHUNK = 8192
#: Bytes of Catalyst's size estimate a part.
PART_BYTES = 8 << 20
KERNEL = (
    "series_id string, growth string, n long, start_us long, end_us long, y_scale double, yearly boolean, weekly boolean, daily boolean, changepoints_t array<double>, "
    "k double, m double, delta array<double>, sigma_obs double, beta array<double>, regressor_mu array<double>, regressor_std array<double>, lp double, kkt double, iterations int, status string, trace array<double>"
)
#: A model: what the kernel found, and what a forecast has to know of the fit. ``predictors`` are the regressors' own models as JSON.
MODEL = KERNEL + ", holiday_columns array<string>, has_floor boolean, predictors map<string,string>"
_CARRIED = ["n", "start_us", "end_us", "y_scale", "y_min", "y_max", "yearly", "weekly", "daily", "changepoints_t", "regressor_mu", "regressor_std"]
_CARRIED_KINDS = "n long, start_us long, end_us long, y_scale double, y_min double, y_max double, yearly boolean, weekly boolean, daily boolean, changepoints_t array<double>, regressor_mu array<double>, regressor_std array<double>"
_MOMENTS = "chunk int, rows long, zz array<double>, zy array<double>, yy double"
_KINDS = {
    "string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "int": pa.int32(),
}


def selectable(spec: ModelSpec) -> list[tuple[Seasonality, str | None]]:
    """Every seasonality a series may have, with the flag column that tells (none: always)."""
    out: list[tuple[Seasonality, str | None]] = [(s, None) for s in spec.seasonalities]
    for name in C.BUILT_IN:
        s = spec.built_in(name, True)
        if s is not None:
            out.append((s, name if getattr(spec, name) == "auto" and isinstance(getattr(spec, name), str) else None))
    return out


def row_features(df: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, calendar: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Adds x, the design row, whose length depends on the series' flags yearly, weekly and daily. The holiday columns are ``names``, or those
    that a row's model has (holiday_columns)."""
    use = spec.has_holidays and names != []
    df = holiday_features(df, holiday_table(df, spec, holidays, calendar), names) if use else df
    df = df.withColumn("_days", seasonal_time(F.col("ds")))
    empty = F.array().cast("array<double>")
    blocks = [seasonality_block(s, F.col("_days")) if flag is None else F.when(F.col(flag), seasonality_block(s, F.col("_days"))).otherwise(empty) for s, flag in selectable(spec)]
    blocks += [F.col("holiday")] if use else []
    if spec.regressors:
        shifted = [(F.col(r.name).cast("double") - F.get("regressor_mu", F.lit(i))) / F.get("regressor_std", F.lit(i)) for i, r in enumerate(spec.regressors)]
        blocks.append(F.array(*shifted))
    return df.withColumn("x", F.concat(*blocks) if blocks else empty).drop("_days", "holiday")


def columns_for(spec: ModelSpec, yearly: bool, weekly: bool, daily: bool, holidays: list[str] | None = None) -> list[DesignColumn]:
    return design_columns(spec, spec.seasonalities_for(yearly, weekly, daily), holidays)


def moments(t: np.ndarray, y: np.ndarray, x: np.ndarray, s: np.ndarray) -> S.Moments:
    z = np.column_stack([t, np.ones(len(t)), np.maximum(t[:, None] - s[None, :], 0.0) * (t[:, None] >= s[None, :]), x])
    return S.Moments(len(t), z.T @ z, z.T @ y, float(y @ y))


def prepared(df: DataFrame, spec: ModelSpec) -> tuple[DataFrame, DataFrame]:
    """Scaled rows and one row a series of everything a fit needs to know beforehand."""
    clean = P.with_floor(P.clean_history(df), spec)
    if spec.growth == "logistic" and "cap" not in df.columns:
        raise ValueError('Capacities must be supplied for logistic growth in column "cap"')
    info = P.series_info(clean, spec)
    info = P.auto_seasonality(info, keep=True)
    for name in C.BUILT_IN:
        asked = getattr(spec, name)
        if not (asked == "auto" and isinstance(asked, str)):
            info = info.withColumn(name, F.lit(spec.built_in(name, False) is not None))
    if spec.regressors:
        mu = regressor_stats(clean, spec.regressors)
        arrays = [F.array(*[F.col(f"{r.name}_{k}") for r in spec.regressors]).alias(f"regressor_{k}") for k in ("mu", "std")]
        info = info.join(mu.select("series_id", *arrays), "series_id")
    else:
        none = F.array().cast("array<double>")
        info = info.withColumn("regressor_mu", none).withColumn("regressor_std", none)
    return clean, info


def _features(df: DataFrame, spec: ModelSpec, chunk: int | None, holidays: DataFrame | None, calendar: DataFrame | None, names: list[str], more: DataFrame | None = None) -> DataFrame:
    """series_id, chunk, t, y_scaled, x (cap_scaled) and info, dealt and sorted by series and chunk. ``info``, the columns of the series and those of
    ``more``, stands on the rows of the first date, and on every row of a series that has several chunks."""
    clean, info = prepared(df, spec)
    extra = [c for c in more.columns if c not in ("series_id", *_CARRIED)] if more is not None else []
    info = info.drop(*[c for c in more.columns if c in _CARRIED]).join(more, "series_id") if more is not None else info
    cap = spec.growth == "logistic"
    plain = sorted({s.condition for s in spec.seasonalities if s.condition} | {r.name for r in spec.regressors})
    rows = clean.select("series_id", "ds", "us", "y", "floor", *([F.col("cap").cast("double").alias("cap")] if cap else []), *plain).join(info, "series_id")
    finite = F.when(F.abs("y") == float("inf"), F.raise_error(F.lit("Found infinity in column y.")).cast("double")).otherwise(F.col("y"))
    rows = rows.withColumn("t", P.scaled_time(F.col("us"))).withColumn("y_scaled", (finite - F.col("floor")) / F.col("y_scale"))
    if cap:
        ok = F.when(F.col("cap").isNull() | (F.col("cap") <= F.col("floor")), F.raise_error(F.lit("cap must be greater than floor.")).cast("double")).otherwise(F.col("cap"))
        rows = rows.withColumn("cap_scaled", (ok - F.col("floor")) / F.col("y_scale"))
    one = F.col("us") == F.col("start_us")
    if chunk is None:
        rows = rows.withColumn("chunk", F.lit(0))
    else:
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("us"), F.ceil(F.col("n") / chunk)).cast("int"))
        one = one | (F.col("n") > chunk)
    carried = F.when(one, F.struct(*_CARRIED, *extra)).alias("info")
    means = ["regressor_mu", "regressor_std"] if spec.regressors else []
    rows = rows.select("series_id", "chunk", "ds", "t", "y_scaled", *(["cap_scaled"] if cap else []), "yearly", "weekly", "daily", *plain, *means, carried)
    rows = rows.repartition(P.parts_for(df, PART_BYTES), "series_id", "chunk")
    rows = row_features(rows, spec, holidays, calendar, names).select("series_id", "chunk", "t", "y_scaled", "x", *(["cap_scaled"] if cap else []), "info")
    return rows.sortWithinPartitions("series_id", "chunk")


def _sorted_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole groups of rows sorted by ``keys``, those of a batch together: a table and its groups' edges."""

    def edges(x: pa.Table) -> list[int]:
        new = np.zeros(max(0, x.num_rows - 1), bool)
        for k in keys:
            codes = x.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new |= codes[1:] != codes[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist(), x.num_rows]

    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        if len(edges(pa.concat_tables([held[-2].slice(held[-2].num_rows - 1), held[-1]] if len(held) > 1 else held).select(list(keys)))) <= 2:
            continue  # one group goes on
        x = pa.concat_tables(held).combine_chunks()
        e = edges(x)
        yield x.slice(0, e[-2]).combine_chunks(), e[:-1]
        held = [x.slice(e[-2])]
    if held:
        x = pa.concat_tables(held).combine_chunks()
        yield x, edges(x)


def _columns(rows: list[dict], schema: str) -> pa.RecordBatch:
    names = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[kind]) for n, kind in names], [n for n, _ in names])


class _Groups:
    """The groups of a table of ``_features`` rows as arrays, in an order that doesn't depend on how rows arrived."""

    def __init__(self, x: pa.Table, edges: list[int]) -> None:
        self.x, self.edges = x, edges
        self.t, self.y = (x.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("t", "y_scaled"))
        self.cap = x.column("cap_scaled").combine_chunks().to_numpy(zero_copy_only=False) if "cap_scaled" in x.column_names else None
        lists = x.column("x").combine_chunks()
        self.flat = lists.flatten().to_numpy(zero_copy_only=False)
        offs = lists.offsets.to_numpy().astype(np.int64)
        self.offs = offs - offs[0]
        self.info = x.column("info").combine_chunks()
        self.some = np.flatnonzero(np.asarray(self.info.is_valid()))

    def __iter__(self) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        names, chunks = self.x.column("series_id"), self.x.column("chunk")
        for a, b in zip(self.edges[:-1], self.edges[1:], strict=True):
            at = self.some[np.searchsorted(self.some, a)]
            info = {"series_id": names[a].as_py(), "chunk": chunks[a].as_py()} | self.info[int(at)].as_py()
            p = int(self.offs[a + 1] - self.offs[a])
            x = self.flat[self.offs[a] : self.offs[b]].reshape(b - a, p)
            order = np.lexsort((self.y[a:b], self.t[a:b]))
            yield info, self.t[a:b][order], self.y[a:b][order], x[order], None if self.cap is None else self.cap[a:b][order]


def _summed(df: DataFrame, spec: ModelSpec, holidays: DataFrame | None, calendar: DataFrame | None, names: list[str], use: Callable[[dict, S.Moments], list[dict]], schema: str, more: DataFrame | None = None, more_kinds: str = "") -> DataFrame:
    """``use`` on every series' carried columns and moments: where the rows are if they make one chunk, else where the chunks' moments meet."""
    rows = _features(df, spec, CHUNK, holidays, calendar, names, more)
    size = CHUNK
    carried = _CARRIED_KINDS + more_kinds
    done = ", ".join(f"r{k} {c.split(' ')[1]}" for k, c in enumerate(schema.split(", ")))
    own = [c.split(" ")[0] for c in schema.split(", ")]
    packed = f"series_id string, solved boolean, {carried}, {_MOMENTS}, {done}"

    def result(info: dict, mo: S.Moments) -> list[dict]:
        return [{"series_id": info["series_id"], "solved": True} | {f"r{k}": r[c] for k, c in enumerate(own)} for r in use(info, mo)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, edges in _sorted_groups(batches, "series_id", "chunk"):
            out = []
            for info, t, y, features, _ in _Groups(x, edges):
                mo = moments(t, y, features, np.array(info["changepoints_t"]))
                if info["n"] <= size:
                    out += result(info, mo)
                else:
                    out.append(info | {"solved": False, "rows": mo.n, "zz": mo.zz.ravel(), "zy": mo.zy, "yy": mo.yy})
            yield _columns(out, packed)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, edges in _sorted_groups(batches, "series_id"):
            solved = x.filter(x.column("solved"))
            if solved.num_rows:
                yield from solved.select([f"r{k}" for k in range(len(own))]).rename_columns(own).to_batches()
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if not x.column("solved")[a].as_py():
                    g = x.slice(a, b - a)
                    out += use(g.slice(0, 1).to_pylist()[0], _added(g))
            if out:
                yield _columns(out, schema)

    part = rows.mapInArrow(sums, packed)
    part = part.repartition(P.parts_for(df, 4 * PART_BYTES), "series_id").sortWithinPartitions("series_id")
    return part.mapInArrow(solve, schema)


def gram(df: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Moments by (series_id, chunk): the columns a model row carries on, rows, zz (row by row), zy, yy."""
    schema = f"series_id string, {_CARRIED_KINDS}, {_MOMENTS}"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, edges in _sorted_groups(batches, "series_id", "chunk"):
            out = []
            for info, t, y, features, _ in _Groups(x, edges):
                mo = moments(t, y, features, np.array(info["changepoints_t"]))
                out.append(info | {"rows": mo.n, "zz": mo.zz.ravel(), "zy": mo.zy, "yy": mo.yy})
            yield _columns(out, schema)

    return _features(df, spec, CHUNK, holidays, calendar, train_holiday_columns(df, spec, calendar)).mapInArrow(sums, schema)


def _added(g: pa.Table) -> S.Moments:
    """The moments of all chunks of one series, added in their order."""
    g = g.sort_by("chunk").combine_chunks()
    p, n = len(g.column("zy")[0]), g.num_rows
    flat = lambda c: g.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).sum(axis=0)
    return S.Moments(int(np.sum(g.column("rows").to_numpy())), flat("zz").reshape(p, p), flat("zy"), float(np.sum(g.column("yy").to_numpy())))


def _prior_scales(spec: ModelSpec, info: dict, names: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    cols = columns_for(spec, info["yearly"], info["weekly"], info["daily"], names)
    return np.array([c.prior_scale for c in cols]), np.array([float(c.mode == "multiplicative") for c in cols])


def _model(info: dict, spec: ModelSpec, fit: S.Fit) -> dict:
    own = {k: info[k] for k in ("series_id", "n", "start_us", "end_us", "y_scale", "yearly", "weekly", "daily", "changepoints_t", "regressor_mu", "regressor_std")}
    found = {"k": fit.k, "m": fit.m, "delta": fit.delta, "sigma_obs": fit.sigma, "beta": fit.beta, "lp": fit.lp, "kkt": fit.kkt, "iterations": fit.iterations, "status": fit.status, "trace": fit.trace}
    return own | {"growth": spec.growth} | found


def _constant(info: dict, p: int, m: float) -> S.Fit:
    return S.Fit(0.0, m, np.zeros(len(info["changepoints_t"])), np.zeros(p), C.CONSTANT_SIGMA, float("nan"), 0.0, 0, "constant")


def with_fit_columns(models: DataFrame, names: list[str] = [], has_floor: bool = False) -> DataFrame:  # noqa: B006
    """Kernel rows with what a forecast has to know of the fit."""
    columns = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return models.withColumn("holiday_columns", columns).withColumn("has_floor", F.lit(has_floor)).withColumn("predictors", F.create_map().cast("map<string,string>"))


def fit(df: DataFrame, spec: ModelSpec = ModelSpec(), holidays: DataFrame | None = None, initial: dict | None = None, calendar: DataFrame | None = None, kernel: str = "auto") -> DataFrame:
    """One model row (MODEL) a series of a history (series_id, ds, y, ...). Series that can't be fitted raise, naming the reason:
    call ``prepare.history_status`` first to tell them apart.

    ``calendar`` (country, ds, holiday) gives the holidays of the specification's country. Regressors with a predictor have models of their
    own, which travel inside the model row. ``initial`` overrides entries of the starting point (k, m, delta, beta, sigma_obs) of the row kernel; the
    convex case has one optimum and needs none. ``kernel`` is moments (convex models only), rows, or auto: moments where they suffice.
    """
    if kernel not in ("auto", "moments", "rows"):
        raise ValueError('kernel must be "auto", "moments" or "rows"')
    if kernel == "moments" and not spec.convex:
        raise ValueError("The moments kernel needs a model that is linear in its parameters.")
    names = train_holiday_columns(df, spec, calendar)
    if spec.convex and kernel != "rows":
        models = _fit_convex(df, spec, holidays, calendar, names)
    else:
        models = _fit_rows(df, spec, holidays, calendar, names, initial or {})
    models = with_fit_columns(models, names, spec.growth == "logistic" and "floor" in df.columns)
    nested = fit_regressors(df, spec, calendar)
    for name, own in nested.items():
        as_json = own.select("series_id", F.to_json(F.struct(*[F.col(c.split(" ")[0]) for c in MODEL.split(", ")])).alias("_json"))
        models = models.join(as_json, "series_id").withColumn("predictors", F.map_concat("predictors", F.create_map(F.lit(name), F.col("_json")))).drop("_json")
    return models.select(*[c.split(" ")[0] for c in MODEL.split(", ")])


def _fit_convex(df: DataFrame, spec: ModelSpec, holidays: DataFrame | None, calendar: DataFrame | None, names: list[str]) -> DataFrame:
    def solve(info: dict, mo: S.Moments) -> list[dict]:
        scales, _ = _prior_scales(spec, info, names)
        if info["y_min"] == info["y_max"]:
            return [_model(info, spec, _constant(info, len(scales), info["y_min"] / info["y_scale"]))]
        return [_model(info, spec, S.fit_moments(mo, len(info["changepoints_t"]), scales, spec.changepoint_prior_scale, spec.growth == "flat"))]

    return _summed(df, spec, holidays, calendar, names, solve, KERNEL)


def tau_path(df: DataFrame, spec: ModelSpec, taus: list[float], holidays: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """series_id, tau, sigma_obs, n_rates (not zero), sum_abs_delta, lp, kkt of the convex fit at each strength of the rate prior. The moments
    are made once."""
    names = train_holiday_columns(df, spec, calendar)

    def solve(info: dict, mo: S.Moments) -> list[dict]:
        out = []
        for tau in taus:
            found = S.fit_moments(mo, len(info["changepoints_t"]), _prior_scales(spec, info, names)[0], float(tau), spec.growth == "flat")
            out.append({"series_id": info["series_id"], "tau": float(tau), "sigma_obs": found.sigma, "n_rates": int((found.delta != 0).sum()), "sum_abs_delta": float(np.abs(found.delta).sum()), "lp": found.lp, "kkt": found.kkt})
        return out

    return _summed(df, spec, holidays, calendar, names, solve, "series_id string, tau double, sigma_obs double, n_rates long, sum_abs_delta double, lp double, kkt double")


_RECOVERY = "series_id string, k_error double, m_error double, delta_error double, beta_error double, identified_error double, excess_over_truth double, predicted_excess double, least_curvature double, most_curvature double"


def recovery(df: DataFrame, models: DataFrame, truths: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """How far fitted parameters are from those that made a series (series_id, k, m, delta, beta, in scaled units): the root mean square
    error of each block, the identified error (half the squared distance in the posterior's own metric at the truth), the objective's excess over
    the truth's (both at the fitted noise; below 0 for any fit worth the name) and its second-order prediction, and the smallest and largest
    curvature. For models that are linear in their parameters."""
    own = models.select("series_id", F.col("k").alias("k_fit"), F.col("m").alias("m_fit"), F.col("delta").alias("delta_fit"), F.col("beta").alias("beta_fit"), "sigma_obs")
    more = own.join(truths.select("series_id", "k", "m", "delta", "beta"), "series_id")
    names = train_holiday_columns(df, spec, calendar)

    def compare(info: dict, mo: S.Moments) -> list[dict]:
        d, l1 = S.priors({"tau": spec.changepoint_prior_scale}, len(info["delta"]), _prior_scales(spec, info, names)[0])
        sigma = info["sigma_obs"]
        h = mo.zz / sigma**2 + np.diag(d)
        truth = np.concatenate([[info["k"], info["m"]], info["delta"], info["beta"]])
        point = np.concatenate([[info["k_fit"], info["m_fit"]], info["delta_fit"], info["beta_fit"]])
        gradient = (mo.zz @ truth - mo.zy) / sigma**2 + d * truth
        rms = lambda a, b: float(np.sqrt(np.mean((np.asarray(a) - np.asarray(b)) ** 2))) if len(np.atleast_1d(a)) else 0.0
        value = lambda x: S.objective(x, sigma, mo.ssr(x), mo.n, d, l1)
        spectrum = S.curvature_spectrum(h)
        return [{
            "series_id": info["series_id"], "k_error": rms([info["k"]], [info["k_fit"]]), "m_error": rms([info["m"]], [info["m_fit"]]), "delta_error": rms(info["delta"], info["delta_fit"]),
            "beta_error": rms(info["beta"], info["beta_fit"]), "identified_error": S.quadratic_distance(h, truth, point), "excess_over_truth": value(point) - value(truth),
            "predicted_excess": S.quadratic_change(h, truth, point, gradient, l1), "least_curvature": float(spectrum[0]), "most_curvature": float(spectrum[-1]),
        }]

    kinds = ", k_fit double, m_fit double, delta_fit array<double>, beta_fit array<double>, sigma_obs double, k double, m double, delta array<double>, beta array<double>"
    return _summed(df, spec, holidays, calendar, names, compare, _RECOVERY, more, kinds)


def _by_rows(df: DataFrame, spec: ModelSpec, holidays: DataFrame | None, calendar: DataFrame | None, names: list[str], use: Callable[[dict, S.Rows, np.ndarray], dict], schema: str, more: DataFrame | None = None) -> DataFrame:
    """``use`` on every series' carried columns, row kernel and prior scales."""
    rows = _features(df, spec, None, holidays, calendar, names, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, edges in _sorted_groups(batches, "series_id"):
            out = []
            for info, t, y, features, cap in _Groups(x, edges):
                scales, mult = _prior_scales(spec, info, names)
                out.append(use(info, S.Rows(t, y, features, np.array(info["changepoints_t"]), spec.growth, mult, cap), scales))
            yield _columns(out, schema)

    return rows.mapInArrow(run, schema)


def _fit_rows(df: DataFrame, spec: ModelSpec, holidays: DataFrame | None, calendar: DataFrame | None, names: list[str], initial: dict) -> DataFrame:
    def solve(info: dict, kernel: S.Rows, scales: np.ndarray) -> dict:
        if info["y_min"] == info["y_max"] and spec.growth != "logistic":
            return _model(info, spec, _constant(info, len(scales), float(kernel.y[0])))
        best = None
        for start in starting_points(kernel, scales, spec, initial):
            found = S.fit_rows(kernel, start, scales, spec.changepoint_prior_scale, sigma=initial.get("sigma_obs"))
            if best is None or found.lp > best.lp:
                best = found
        return _model(info, spec, best)

    return _by_rows(df, spec, holidays, calendar, names, solve, KERNEL)


def starting_points(kernel: S.Rows, scales: np.ndarray, spec: ModelSpec, initial: dict) -> Iterator[np.ndarray]:
    """The usual first point; for multiplicative terms also the additive fit's trend, which is convex."""
    t, y, cap, s = kernel.t, kernel.y, kernel.cap, len(kernel.s)
    span = t[-1] - t[0]
    if spec.growth == "flat":
        k, m = 0.0, float(y.mean())
    elif spec.growth == "linear":
        last = int(np.argmax(t == t[-1]))
        k = float((y[last] - y[0]) / span)
        m = float(y[0] - k * t[0])
    else:
        last = int(np.argmax(t == t[-1]))
        r0, r1 = (float(cap[i] / max(0.01 * cap[i], min(0.99 * cap[i], y[i]))) for i in (0, last))
        r0 = 1.05 * r0 if abs(r0 - r1) <= 0.01 else r0
        l0, l1 = np.log(r0 - 1), np.log(r1 - 1)
        k, m = float((l0 - l1) / span), float(l0 * span / (l0 - l1))
    first = np.concatenate([[initial.get("k", k), initial.get("m", m)], initial.get("delta", np.zeros(s)), initial.get("beta", np.zeros(len(scales)))])
    if len(first) != 2 + s + len(scales):
        raise ValueError(f"initial delta and beta need {s} and {len(scales)} entries")
    yield first
    if spec.growth != "logistic" and not initial:
        z = np.column_stack([t, np.ones(len(t)), kernel.hinge, kernel.x])
        convex = S.fit_moments(S.Moments(len(t), z.T @ z, z.T @ y, float(y @ y)), s, scales, spec.changepoint_prior_scale, spec.growth == "flat")
        yield np.concatenate([[convex.k, convex.m], convex.delta, np.zeros(len(scales))])


def get_parameters(models: DataFrame) -> DataFrame:
    """series_id and theta: k, m, delta, sigma_obs, beta as one array."""
    return models.select("series_id", F.concat(F.array("k", "m"), "delta", F.array("sigma_obs"), "beta").alias("theta"))


def fit_regressors(df: DataFrame, spec: ModelSpec, calendar: DataFrame | None = None) -> dict[str, DataFrame]:
    """Models of the regressors that have a predictor of their own, fitted to their raw values where there are any."""
    out = {}
    for r in spec.regressors:
        if r.predictor is not None:
            value = F.col(r.name).cast("double")
            own = df.select("series_id", "ds", value.alias("y"))
            few = F.count_if(F.col("y").isNotNull() & ~F.isnan("y")).over(P.Window.partitionBy("series_id")) < 2
            stop = F.raise_error(F.lit(f"Not enough data to fit regressor model for {r.name!r}.")).cast("double")
            out[r.name] = fit(own.withColumn("y", F.when(few, stop).otherwise(F.col("y"))), r.predictor, calendar=calendar)
    return out


def nested_models(models: DataFrame, name: str) -> DataFrame:
    """The models of one regressor that travel inside model rows."""
    return models.select(F.from_json(F.col("predictors")[name], MODEL).alias("x")).where("x is not null").select("x.*")


def certificate(df: DataFrame, models: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Recomputes the optimality residual from the data: series_id, n_params, n_zero_rates, kkt, ssr, objective, least_curvature. The models' own
    changepoints count, not those that the specification would place.

    For models that are linear in their parameters from the moments, else from the rows; least_curvature (null for the former, which are convex) is below 0 by
    more than rounding only at a saddle.
    """
    more = models.select("series_id", "k", "m", "delta", "sigma_obs", "beta", "changepoints_t")
    names = train_holiday_columns(df, spec, calendar)
    schema = "series_id string, n_params long, n_zero_rates long, kkt double, ssr double, objective double, least_curvature double"

    def row(info: dict, theta: np.ndarray, ssr: float, gradient: np.ndarray, n: int, d: np.ndarray, l1: np.ndarray, curvature: float | None) -> dict:
        if spec.growth == "flat":
            gradient[[0, *range(2, 2 + len(info["delta"]))]] = 0.0
        residual = S.kkt_residual(theta, info["sigma_obs"], gradient, ssr, n, d, l1)
        return {"series_id": info["series_id"], "n_params": len(theta) + 1, "n_zero_rates": sum(x == 0 for x in info["delta"]), "kkt": residual, "ssr": ssr, "objective": S.objective(theta, info["sigma_obs"], ssr, n, d, l1), "least_curvature": curvature}

    def parts(info: dict, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        theta = np.concatenate([[info["k"], info["m"]], info["delta"], info["beta"]])
        return theta, *S.priors({"tau": spec.changepoint_prior_scale}, len(info["delta"]), scales)

    def linear(info: dict, mo: S.Moments) -> list[dict]:
        theta, d, l1 = parts(info, _prior_scales(spec, info, names)[0])
        return [row(info, theta, mo.ssr(theta), (mo.zz @ theta - mo.zy) / info["sigma_obs"] ** 2, mo.n, d, l1, None)]

    def general(info: dict, kernel: S.Rows, scales: np.ndarray) -> dict:
        theta, d, l1 = parts(info, scales)
        ssr, gradient = kernel.gradient(theta, info["sigma_obs"])
        return row(info, theta, ssr, gradient, len(kernel.y), d, l1, S.least_curvature(kernel, theta, d, l1))

    if spec.convex:
        return _summed(df, spec, holidays, calendar, names, linear, schema, more, ", k double, m double, delta array<double>, sigma_obs double, beta array<double>")
    return _by_rows(df, spec, holidays, calendar, names, general, schema, more)


def loss_envelope(models: DataFrame) -> DataFrame:
    """series_id, round, loss, envelope: the objective after each round of a fit and the lowest so far."""
    low = F.aggregate(
        "trace", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.least(F.element_at(acc, -1), x))))
    )
    rows = models.select("series_id", F.posexplode(F.arrays_zip(F.col("trace").alias("loss"), low.alias("envelope"))).alias("round", "x"))
    return rows.select("series_id", F.col("round").cast("long").alias("round"), "x.loss", "x.envelope")


__all__ = ["KERNEL", "MODEL", "certificate", "columns_for", "fit", "fit_regressors", "get_parameters", "gram", "loss_envelope", "nested_models", "prepared", "recovery", "row_features", "selectable", "tau_path", "with_fit_columns"]
