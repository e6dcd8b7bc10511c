"""DuckDB SQL of the queries, written from the definitions and sharing only the literal models' values with them."""

from __future__ import annotations

import math

from . import fixtures as D

_HIST = "hist AS (SELECT l_returnflag AS series_id, l_shipdate AS ds, sum(l_quantity)::DOUBLE AS y, sum(l_discount * 100)::DOUBLE AS disc, (day(l_shipdate) <= 5)::INT::DOUBLE AS promo, month(l_shipdate) IN (11, 12, 1, 2) AS winter FROM lineitem GROUP BY 1, 2)"
_STATS = "stats AS (SELECT series_id, count(*) AS n, min(ds) AS lo, max(ds) AS hi, CASE WHEN max(abs(y)) = 0 THEN 1.0 ELSE max(abs(y)) END AS y_scale, max(y) AS y_max FROM hist GROUP BY 1)"
_T = "(date_diff('microsecond', lo, ds) / date_diff('microsecond', lo, hi)::DOUBLE)"
_SCALED = f"scaled AS (SELECT h.*, lo, hi, n, y_scale, y_max, {_T} AS t, y / y_scale AS y_scaled FROM hist h JOIN stats USING (series_id))"
_DAY = "strftime(ds, '%Y-%m-%d') AS day"
_ALL = """daily3 AS (SELECT series_id, ds, y FROM hist
  UNION ALL SELECT o_orderpriority, date_trunc('week', o_orderdate)::TIMESTAMP, count(*)::DOUBLE FROM orders GROUP BY 1, 2
  UNION ALL SELECT event_type, date_trunc('hour', ts)::TIMESTAMP, count(*)::DOUBLE FROM events GROUP BY 1, 2),
spacing AS (SELECT series_id, date_diff('microsecond', min(ds), max(ds)) / 86400e6 AS span_days, min(CASE WHEN step > 0 THEN step END) / 86400e6 AS min_spacing_days
  FROM (SELECT series_id, ds, date_diff('microsecond', lag(ds) OVER (PARTITION BY series_id ORDER BY ds), ds) AS step FROM daily3) GROUP BY 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _future(n: int, history: bool) -> str:
    ahead = f"SELECT series_id, hi + to_days(i::INT) AS ds FROM stats, range(1, {n + 1}) g(i)"
    return f"fut AS ({'SELECT series_id, ds FROM hist UNION ALL ' if history else ''}{ahead}),\nf AS (SELECT fut.series_id, ds, lo, hi, n, y_scale, y_max, {_T} AS t, epoch_us(ds) / 86400e6 AS days FROM fut JOIN stats USING (series_id))"


_HINGES = " + ".join(f"CASE WHEN t >= {s!r} THEN {d!r} * (t - {s!r}) ELSE 0 END" for s, d in zip(D.POINTS, D.DELTA, strict=True))
_LINEAR = f"(({D.K!r} * t + {D.M!r} + {_HINGES}) * y_scale)"
_WEEK = "(" + " + ".join(f"{D.WEEKLY[2 * i]!r} * sin({2 * math.pi / 7!r} * days * {i + 1}) + {D.WEEKLY[2 * i + 1]!r} * cos({2 * math.pi / 7!r} * days * {i + 1})" for i in range(3)) + ")"


def _logistic(top: str = "1.25 * y_max") -> str:
    rate, offset, gammas = D.LOGISTIC_K, D.LOGISTIC_M, []
    for s, d in zip(D.POINTS, D.DELTA, strict=True):
        gammas.append((s - offset) * (1 - rate / (rate + d)))
        rate, offset = rate + d, offset + gammas[-1]
    on = lambda xs: " + ".join(f"CASE WHEN t >= {s!r} THEN {x!r} ELSE 0 END" for s, x in zip(D.POINTS, xs, strict=True))
    return f"(({top}) / (1 + exp(-(({D.LOGISTIC_K!r} + {on(D.DELTA)}) * (t - ({D.LOGISTIC_M!r} + {on(gammas)}))))))"


def _uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE / 4503599627370496)"


def _counter(*parts: str) -> str:
    """The number of column sample under a key: SplitMix64 over the first 64 bits of the key's MD5."""
    whole = "18446744073709551616::UHUGEINT"
    key = f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 16))::UBIGINT"
    begin = f"[(({key}::UHUGEINT + (sample + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {whole})::UBIGINT]"
    step = lambda x, by, factor: f"list_transform({x}, lambda v: (xor(v, v >> {by})::UHUGEINT * {factor}::UHUGEINT % {whole})::UBIGINT)"
    return f"list_transform({step(step(begin, 30, 0xBF58476D1CE4E5B9), 27, 0x94D049BB133111EB)}, lambda v: (xor(v, v >> 31) >> 11)::DOUBLE / 9007199254740992)[1]"


def _laplace(scale: str, u: str) -> str:
    c = f"(greatest({u}, 1e-15) - 0.5)"
    return f"(-{scale} * sign({c}) * ln(greatest(1e-15, 1.0 - 2.0 * abs({c}))))"


_NORMAL = f"(sqrt(-2.0 * ln(greatest(noise1, 1e-15))) * cos({2 * math.pi!r} * noise2))"


_SCALE = repr(sum(abs(d) for d in D.DELTA) / len(D.DELTA) + 1e-8)
_N, _N_SAMPLES = len(D.POINTS), 1000


def _approx(n: int) -> str:
    date = "strftime(ds, '%Y-%m-%d %H:%M:%S')"
    return (
        _with(_HIST, _STATS, _future(n, False))
        + f""", steps AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS step, (max(t) OVER (PARTITION BY series_id) - min(t) OVER (PARTITION BY series_id)) / ({n} - 1) AS width FROM f),
every AS (SELECT *, i AS sample FROM steps, range(0, {_N_SAMPLES}) g(i)),
drawn AS (SELECT *, {_counter("0", "'coin'", "series_id", "step")} AS coin, {_counter("0", "'size'", "series_id", "step")} AS size, {_counter("0", "'noise1'", "series_id", date)} AS noise1, {_counter("0", "'noise2'", "series_id", date)} AS noise2 FROM every),
shifts AS (SELECT *, CASE WHEN coin < {_N} * width THEN {_laplace(_SCALE, "size")} ELSE 0 END AS shift FROM drawn),
halves AS (SELECT *, (lag(shift, 1, 0) OVER w + shift) / 2 AS half FROM shifts WINDOW w AS (PARTITION BY series_id, sample ORDER BY step)),
slopes AS (SELECT *, sum(half) OVER (PARTITION BY series_id, sample ORDER BY step) AS slope FROM halves),
draws AS (SELECT *, {_LINEAR} + sum(slope) OVER (PARTITION BY series_id, sample ORDER BY step) * width * y_scale AS trend_draw, {_LINEAR} AS trend, {_WEEK} AS week FROM slopes),
noisy AS (SELECT *, trend_draw + week * y_scale + {_NORMAL} * {D.SIGMA!r} * y_scale AS yhat_draw FROM draws)
"""
    )


def _levels(rows: str, keys: str = "series_id") -> str:
    """The posterior's maximum of y = m + b x + noise by ``keys`` from ``rows`` (y, x), scaled by the largest y: parameters at fixed noise and the noise
    in closed form, in turn."""
    join = f"USING ({keys})"
    return f"""top AS (SELECT {keys}, max(abs(y)) AS y_scale FROM {rows} GROUP BY ALL),
sums AS (SELECT {keys}, any_value(y_scale) AS y_scale, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y / y_scale) AS sy, sum(x * y / y_scale) AS sxy, sum((y / y_scale) * (y / y_scale)) AS syy FROM {rows} JOIN top {join} GROUP BY {keys}),
it AS (SELECT {keys}, 0 AS i, 1.0::DOUBLE AS sigma, 0.0::DOUBLE AS m, 0.0::DOUBLE AS b, 0.0::DOUBLE AS ssr FROM sums
  UNION ALL SELECT {keys}, i + 1, sqrt(2 * ssr2 / (n + sqrt(n * n + 16 * ssr2))), m2, b2, ssr2 FROM (
    SELECT *, syy - 2 * m2 * sy - 2 * b2 * sxy + m2 * m2 * n + 2 * m2 * b2 * sx + b2 * b2 * sxx AS ssr2 FROM (
      SELECT *, (sy / v * (sxx / v + 0.01) - sxy / v * sx / v) / det AS m2, ((n / v + 0.04) * sxy / v - sx / v * sy / v) / det AS b2 FROM (
        SELECT *, (n / v + 0.04) * (sxx / v + 0.01) - (sx / v) * (sx / v) AS det FROM (SELECT *, sigma * sigma AS v FROM it JOIN sums {join} WHERE i < 60))))),
level AS (SELECT {keys}, m, b, sigma, ssr, n, y_scale, -(n * ln(sigma) + ssr / (2 * sigma * sigma) + 2 * sigma * sigma + m * m / 50 + b * b / 200) AS lp FROM it JOIN sums {join} WHERE i = 60)"""


def _recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _certificate() -> str:
    z = ["t", "1", *[f"(CASE WHEN t >= {p!r} THEN t - {p!r} ELSE 0 END)" for p in D.POINTS], *_GRAM_Z]
    theta = [D.K, D.M, *D.DELTA, *D.WEEKLY]
    precision = [0.04, 0.04, *[0.0] * len(D.DELTA), *[0.01] * len(D.WEEKLY)]
    pull = [0.0, 0.0, *[math.copysign(20.0, d) for d in D.DELTA], *[0.0] * len(D.WEEKLY)]
    mean = " + ".join(f"{v!r} * {c}" for v, c in zip(theta, z, strict=True))
    slopes = ", ".join(f"abs(-sum(e * {c}) / {D.SIGMA**2!r} + {p * v!r} + {q!r})" for c, v, p, q in zip(z, theta, precision, pull, strict=True))
    prior = sum(p * v * v / 2 for p, v in zip(precision, theta, strict=True)) + 20.0 * sum(map(abs, D.DELTA))
    return f"""SELECT series_id, {len(theta) + 1}::BIGINT AS n_params, 0::BIGINT AS n_zero_rates, round(greatest({slopes}, abs(count(*) / {D.SIGMA!r} - sum(e * e) / {D.SIGMA**3!r} + {D.SIGMA / 0.25!r}) * {D.SIGMA!r} / count(*)), 3) AS kkt,
  round(sum(e * e), 6) AS ssr, round(count(*) * ln({D.SIGMA!r}) + sum(e * e) / {2 * D.SIGMA**2!r} + {D.SIGMA**2 / 0.5!r} + {prior!r}, 3) AS objective
FROM (SELECT *, y_scaled - ({mean}) AS e FROM (SELECT *, epoch_us(ds) / 86400e6 AS days FROM scaled)) GROUP BY 1"""


_FACTS = """facts AS (SELECT series, implementation, unnest(['rmse', 'smape', 'coverage']) AS metric, unnest([rmse, smape, coverage]) AS value FROM (
  SELECT substr(o_orderpriority, 1, 1) || ':' || (o_custkey % 17) AS series, CASE WHEN o_orderkey % 2 = 0 THEN 'ours' ELSE 'theirs' END AS implementation,
    avg(o_totalprice) / 1000 AS rmse, avg(o_totalprice % 10) / 100 AS smape, avg((o_orderstatus = 'F')::INT::DOUBLE) AS coverage FROM orders GROUP BY 1, 2)),
diff AS (SELECT a.series, a.metric, CASE WHEN a.metric IN ('rmse', 'smape') THEN a.value / nullif(b.value, 0) - 1 ELSE a.value - b.value END AS d
  FROM facts a JOIN facts b USING (series, metric) WHERE a.implementation = 'ours' AND b.implementation = 'theirs'),
known AS (SELECT * FROM diff WHERE d IS NOT NULL AND isfinite(d))"""
_COUNTS = "count(*) FILTER (d < 0) AS wins, count(*) FILTER (d > 0) AS losses"

_CUT = """cuts AS (SELECT series_id, hi - to_days(90) - to_days((180 * i)::INT) AS cutoff FROM stats, range(0, 100) g(i) WHERE hi - to_days(90) - to_days((180 * i)::INT) >= lo + to_days(730))"""

_HOLIDAYS = """win("column", d) AS (VALUES ('new_year_delim_+0', DATE '1999-01-01'), ('new_year_delim_+1', DATE '1999-01-02'), ('new_year_delim_+0', DATE '2000-01-01'), ('new_year_delim_+1', DATE '2000-01-02'),
  ('summer_delim_-1', DATE '1998-07-03'), ('summer_delim_+0', DATE '1998-07-04'), ('summer_delim_+1', DATE '1998-07-05'))"""

_BAD = """bad AS (SELECT series_id, ds, y FROM hist
  UNION ALL SELECT 'nan', ds, 'nan'::DOUBLE FROM hist WHERE series_id = 'A'
  UNION ALL SELECT 'inf', ds, CASE WHEN day(ds) = 1 THEN 'inf'::DOUBLE ELSE y END FROM hist WHERE series_id = 'A'
  UNION ALL SELECT 'null ds', CASE WHEN day(ds) > 1 THEN ds END, y FROM hist WHERE series_id = 'A'
  UNION ALL SELECT 'one', ds, y FROM hist, range(2) WHERE series_id = 'A' AND ds = TIMESTAMP '1999-01-04'),
seen AS (SELECT series_id, count(*) AS n_rows, count(*) FILTER (y IS NOT NULL AND NOT isnan(y)) AS n_usable, count(*) FILTER (isinf(y)) AS n_inf, count(*) FILTER (ds IS NULL AND NOT isnan(y)) AS n_null, count(DISTINCT ds) FILTER (NOT isnan(y)) AS n_ds FROM bad GROUP BY 1)"""

_MOVED = """mean AS (SELECT series_id, avg(disc) AS mu, stddev_samp(disc) AS sd FROM hist GROUP BY 1),
rows AS (SELECT series_id, y, (disc - mu) / sd AS x FROM hist JOIN mean USING (series_id))"""

_GRAM_Z = [f"{f}({2 * math.pi / 7!r} * days * {i})" for i in (1, 2, 3) for f in ("sin", "cos")]


def _fourier(period: float, order: int) -> str:
    terms = ", ".join(f"{f}({2 * math.pi / period!r} * days * {i})" for i in range(1, order + 1) for f in ("sin", "cos"))
    return _with(_HIST) + f"SELECT series_id, day, position::BIGINT AS position, round(value, 6) + 0.0 AS value FROM (SELECT series_id, {_DAY}, unnest(range({2 * order})) AS position, unnest([{terms}]) AS value FROM (SELECT *, epoch_us(ds) / 86400e6 AS days FROM hist))"


def _trend(expression: str) -> str:
    return _with(_HIST, _STATS, _SCALED) + f"SELECT series_id, {_DAY}, round({expression}, 6) AS trend FROM scaled"


ORACLES: dict[str, str] = {
    "clean_history": _with(_HIST) + f"SELECT series_id, {_DAY}, round(y, 6) AS y FROM hist WHERE dayofweek(ds) NOT IN (0, 1)",
    "history_status": _with(_HIST, _BAD)
    + """SELECT series_id, n_rows, n_usable, CASE WHEN n_usable < 2 THEN 'Dataframe has less than 2 non-NaN rows.' WHEN n_inf > 0 THEN 'Found infinity in column y.' WHEN n_null > 0 THEN 'Found NaN in column ds.'
  WHEN n_ds < 2 THEN 'All rows have the same ds.' ELSE 'ok' END AS status FROM seen""",
    "history_spacing": _with(_HIST, _ALL) + "SELECT series_id, round(span_days, 6) AS span_days, round(min_spacing_days, 6) AS min_spacing_days FROM spacing",
    "auto_seasonality": _with(_HIST, _ALL) + "SELECT series_id, span_days >= 730 AS yearly, span_days >= 14 AND coalesce(min_spacing_days < 7, false) AS weekly, span_days >= 2 AND coalesce(min_spacing_days < 1, false) AS daily FROM spacing",
    "scale_history": _with(_HIST, _STATS, _SCALED) + f"SELECT series_id, {_DAY}, round(t, 6) AS t, round(y_scaled, 6) AS y_scaled FROM scaled",
    "changepoints": _with(_HIST, _STATS, _SCALED)
    + """, ranked AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY ds, y) - 1 AS r, floor(n * 0.8) AS h FROM scaled)
SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY t) - 1)::BIGINT AS position, round(t, 6) AS t FROM ranked, range(1, 26) g(i) WHERE r = round_even(i * ((h - 1) / 25), 0)""",
    "changepoints_explicit": _with(_HIST, _STATS)
    + f"SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1)::BIGINT AS position, round({_T}, 6) AS t FROM stats, (VALUES (TIMESTAMP '1998-03-01'), (TIMESTAMP '1997-06-01')) v(ds)",
    "linear_init": _with(_HIST, _STATS, _SCALED) + "SELECT series_id, round(arg_max(y_scaled, t) - arg_min(y_scaled, t), 6) AS k, round(arg_min(y_scaled, t), 6) AS m FROM scaled GROUP BY 1",
    "flat_init": _with(_HIST, _STATS, _SCALED) + "SELECT series_id, 0.0::DOUBLE AS k, round(avg(y_scaled), 6) AS m FROM scaled GROUP BY 1",
    "logistic_init": _with(_HIST, _STATS, _SCALED)
    + """, e AS (SELECT series_id, any_value(1.25 * y_max / y_scale) AS c, arg_min(y_scaled, t) AS y0, arg_max(y_scaled, t) AS y1 FROM scaled GROUP BY 1),
q AS (SELECT series_id, c / greatest(0.01 * c, least(0.99 * c, y0)) AS r0, c / greatest(0.01 * c, least(0.99 * c, y1)) AS r1 FROM e),
l AS (SELECT series_id, ln(CASE WHEN abs(r0 - r1) <= 0.01 THEN 1.05 * r0 ELSE r0 END - 1) AS l0, ln(r1 - 1) AS l1 FROM q)
SELECT series_id, round(l0 - l1, 6) AS k, round(l0 / (l0 - l1), 6) AS m FROM l""",
    "capacity_status": _with(_HIST)
    + "SELECT DISTINCT series_id, CASE series_id WHEN 'A' THEN 'ok' WHEN 'N' THEN 'cap must be greater than floor.' ELSE 'Capacities must be supplied for logistic growth in column \"cap\"' END AS status FROM hist",
    "fourier_weekly": _fourier(7.0, 3),
    "fourier_yearly": _fourier(365.25, 2),
    "conditional_seasonality": _with(_HIST)
    + f"SELECT series_id, {_DAY}, round(CASE WHEN winter THEN sin({2 * math.pi / 7!r} * days) ELSE 0 END, 6) + 0.0 AS s1, round(CASE WHEN winter THEN cos({2 * math.pi / 7!r} * days) ELSE 0 END, 6) + 0.0 AS c1 FROM (SELECT *, epoch_us(ds) / 86400e6 AS days FROM hist)",
    "holiday_features": _with(_HIST, _HOLIDAYS) + "SELECT series_id, \"column\", (count(d2))::DOUBLE AS days FROM (SELECT s.series_id, win.\"column\", h.ds AS d2 FROM (SELECT DISTINCT series_id FROM hist) s CROSS JOIN win LEFT JOIN hist h ON h.series_id = s.series_id AND h.ds::DATE = win.d) GROUP BY 1, 2",
    "country_holidays": _with(_HIST)
    + f"SELECT DISTINCT o_orderpriority AS holiday, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (SELECT year(ds) FROM hist WHERE year(ds) < 1998)",
    "regressor_standardize": _with(_HIST) + "SELECT series_id, round(avg(disc), 6) AS disc_mu, round(stddev_samp(disc), 6) AS disc_std, 0.0::DOUBLE AS promo_mu, 1.0::DOUBLE AS promo_std FROM hist GROUP BY 1",
    "design_columns": """WITH c(position, name, component, prior_scale, mode) AS (
  SELECT i, 'monthly_delim_' || (i + 1), 'monthly', 10.0, 'additive' FROM range(4) g(i) UNION ALL SELECT 4 + i, 'weekly_delim_' || (i + 1), 'weekly', 10.0, 'additive' FROM range(6) g(i)
  UNION ALL SELECT 9 + row_number() OVER (ORDER BY n), n, split_part(n, '_delim_', 1), 3.0, 'multiplicative' FROM (VALUES ('new_year_delim_+0'), ('new_year_delim_+1'), ('summer_delim_+0'), ('summer_delim_+1'), ('summer_delim_-1')) v(n)
  UNION ALL SELECT 15, 'disc', 'disc', 0.5, 'additive')
SELECT position::BIGINT AS position, name, component, prior_scale::DOUBLE AS prior_scale, mode FROM c""",
    "gram_matrix": _with(_HIST, _STATS, _SCALED)
    + f""", z AS (SELECT series_id, [t, 1.0, t, {', '.join(_GRAM_Z)}] AS z FROM (SELECT *, epoch_us(ds) / 86400e6 AS days FROM scaled))
SELECT series_id, i::BIGINT AS i, j::BIGINT AS j, round(sum(z[i + 1] * z[j + 1]), 4) + 0.0 AS value FROM z, range(9) a(i), range(9) b(j) GROUP BY 1, 2, 3""",
    "trend_linear": _trend(_LINEAR),
    "trend_flat": _trend(f"{D.M!r} * y_scale"),
    "trend_logistic": _trend(_logistic()),
    "predict_point": _with(_HIST, _STATS, _future(30, True)) + f"SELECT series_id, {_DAY}, round({_LINEAR}, 6) AS trend, round({_WEEK} * y_scale, 6) + 0.0 AS seasonality, round({_LINEAR} + {_WEEK} * y_scale, 6) AS yhat FROM f",
    "predict_multiplicative": _with(_HIST, _STATS, _future(30, True)) + f"SELECT series_id, {_DAY}, round({_LINEAR}, 6) AS trend, round({_LINEAR} * {_WEEK}, 6) + 0.0 AS seasonality, round({_LINEAR} * (1 + {_WEEK}), 6) AS yhat FROM f",
    "components": _with(_HIST, _STATS, _SCALED)
    + f"SELECT series_id, {_DAY}, round(w, 6) + 0.0 AS weekly, round(w, 6) + 0.0 AS weekly_lower, round(w, 6) + 0.0 AS weekly_upper, round(w, 6) + 0.0 AS additive_terms, 0.0::DOUBLE AS multiplicative_terms FROM (SELECT series_id, ds, {_WEEK} * y_scale AS w FROM (SELECT *, epoch_us(ds) / 86400e6 AS days FROM scaled))",
    "future_frame": _with(_HIST, _STATS, _future(10, True)) + f"SELECT series_id, {_DAY} FROM f",
    "regressor_fill": _with(_HIST, _STATS, _future(5, True)) + f"SELECT f.series_id, strftime(f.ds, '%Y-%m-%d') AS day, round(CASE WHEN f.ds <= hi THEN disc ELSE day(f.ds) END, 6) AS disc FROM f LEFT JOIN hist h ON h.series_id = f.series_id AND h.ds = f.ds",
    "trend_uncertainty_approx": _approx(30) + f"SELECT series_id, {_DAY}, round(quantile_cont(trend_draw, 0.1), 4) AS trend_lower, round(quantile_cont(trend_draw, 0.9), 4) AS trend_upper FROM draws GROUP BY 1, 2",
    "yhat_interval": _approx(30) + f"SELECT series_id, {_DAY}, round(quantile_cont(yhat_draw, 0.1), 4) AS yhat_lower, round(any_value(trend + week * y_scale), 4) AS yhat, round(quantile_cont(yhat_draw, 0.9), 4) AS yhat_upper, true AS vectorized FROM noisy GROUP BY 1, 2",
    "predictive_samples": _approx(30) + f"SELECT series_id, {_DAY}, sample, round(yhat_draw, 4) AS yhat FROM noisy",
    "trend_uncertainty_exact": _with(_HIST, _STATS, _future(30, False))
    + f""", top AS (SELECT series_id, max(t) - 1 AS length FROM f GROUP BY 1),
grid AS (SELECT series_id, length, s.i AS sample, e.i AS event FROM top, range(0, {_N_SAMPLES}) s(i), range(1, 20) e(i)),
drawn AS (SELECT *, {_counter("0", "'wait'", "series_id", "event")} AS w, {_counter("0", "'jump'", "series_id", "event")} AS j FROM grid),
ev AS (SELECT *, -ln(greatest(w, 1e-15)) / {float(_N)} AS wait, {_laplace(_SCALE, "j")} AS jump FROM drawn),
arrivals AS (SELECT *, sum(wait) OVER (PARTITION BY series_id, sample ORDER BY event) AS arrival FROM ev),
draws AS (SELECT f.series_id, ds, g.sample, any_value({_LINEAR}) + coalesce(sum(CASE WHEN arrival <= length AND t >= 1 + arrival THEN jump * (t - 1 - arrival) END), 0) * any_value(y_scale) AS trend_draw
  FROM f JOIN arrivals g USING (series_id) GROUP BY 1, 2, 3)
SELECT series_id, {_DAY}, round(quantile_cont(trend_draw, 0.1), 4) AS trend_lower, round(quantile_cont(trend_draw, 0.9), 4) AS trend_upper FROM draws GROUP BY 1, 2""",
    "fit_kkt": _with(_HIST, _STATS) + "SELECT series_id, (1 + 2 + 25 + CASE WHEN hi - lo >= to_days(730) THEN 20 ELSE 0 END + 6)::BIGINT AS n_params, true AS kkt_ok FROM stats",
    "fit_constant_series": _with(_HIST, _STATS, _future(3, False)) + f"SELECT series_id, {_DAY}, -7.5::DOUBLE AS yhat, 1e-9::DOUBLE AS sigma_obs, 'constant' AS status FROM f",
    "fit_recovers": "SELECT r_name AS series_id, 14::BIGINT AS n, true AS recovered FROM region",
    "fit_multiplicative": _with(_HIST) + "SELECT DISTINCT series_id, 'ok' AS status, true AS kkt_ok, 10::BIGINT AS n_beta FROM hist",
    "fit_logistic": _with(_HIST) + "SELECT DISTINCT series_id, 'ok' AS status, true AS kkt_ok, 10::BIGINT AS n_beta FROM hist",
    "cv_cutoffs": _with(_HIST, _STATS, _CUT) + "SELECT series_id, strftime(cutoff, '%Y-%m-%d') AS cutoff FROM cuts",
    "cv_metrics": _with(_HIST, _STATS, _CUT)
    + """, train AS (SELECT series_id, cutoff, avg(y) AS f, stddev_samp(y) AS s FROM hist JOIN cuts USING (series_id) WHERE ds <= cutoff GROUP BY 1, 2),
test AS (SELECT h.series_id, cutoff, y, f, s FROM hist h JOIN train USING (series_id) WHERE ds > cutoff AND ds <= cutoff + to_days(90))
SELECT series_id, strftime(cutoff, '%Y-%m-%d') AS cutoff, round(avg(abs(y - f)), 5) AS mae, round(sqrt(avg((y - f) * (y - f))), 5) AS rmse, round(avg(abs(y - f) / nullif(abs(y), 0)), 5) AS mape,
  round(avg(2 * abs(y - f) / nullif(abs(y) + abs(f), 0)), 5) AS smape, round(avg((y BETWEEN f - s AND f + s)::INT), 5) AS coverage, round(avg(2 * s), 5) AS interval_width FROM test GROUP BY 1, 2""",
    "paired_summary": "WITH "
    + _FACTS
    + f""", s AS (SELECT metric, count(*) AS n, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.25) AS iqr_low, quantile_cont(d, 0.75) AS iqr_high, {_COUNTS}, count(*) FILTER (d = 0) AS ties FROM known GROUP BY 1),
tail AS (SELECT metric, sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) AS p FROM s, range(0, 1000) g(i) WHERE i <= least(wins, losses) GROUP BY 1)
SELECT metric, n, round(median, 6) AS median, round(iqr_low, 6) AS iqr_low, round(iqr_high, 6) AS iqr_high, wins, losses, ties, CASE WHEN wins + losses >= 6 THEN round(least(1.0, 2 * p), 6) END AS p_value FROM s JOIN tail USING (metric)""",
    "stratified_summary": "WITH "
    + _FACTS
    + f""", s AS (SELECT metric, coalesce(stratum, 'all') AS stratum, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, {_COUNTS} FROM (SELECT *, substr(series, 1, 1) AS stratum FROM known) GROUP BY GROUPING SETS ((metric, stratum), (metric))),
tail AS (SELECT metric, stratum, sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) AS p FROM s, range(0, 1000) g(i) WHERE i <= least(wins, losses) GROUP BY 1, 2)
SELECT s.*, CASE WHEN wins + losses >= 6 THEN round(least(1.0, 2 * p), 6) END AS p_value FROM s JOIN tail USING (metric, stratum)""",
    "holm": f"""WITH t AS (SELECT p_brand AS family, p_partkey AS test, CASE WHEN p_size % 9 > 0 THEN {_uniform("'p'", "p_partkey")} / 10 END AS p FROM part),
q AS (SELECT *, p * (count(p) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST) + 1) AS raw FROM t)
SELECT family, test, round(p, 6) AS p_value, CASE WHEN p IS NOT NULL THEN round(least(1.0, max(raw) OVER (PARTITION BY family ORDER BY p NULLS LAST ROWS UNBOUNDED PRECEDING)), 6) END AS adjusted FROM q""",
    "scaling_slope": """SELECT what, count(*) AS n, round(regr_slope(ln(value), ln(size)), 6) AS exponent FROM (SELECT o_orderstatus AS what, o_custkey % 50 AS size, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2) WHERE size > 0 AND value > 0 GROUP BY 1 HAVING count(*) >= 3""",
    "memory_fit": "SELECT l_returnflag, round(regr_slope(l_extendedprice / 1000, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice / 1000, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice / 1000, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1",
    "showcase_selection": "WITH "
    + _FACTS
    + """, w AS (SELECT series, max(value) FILTER (metric = 'rmse' AND implementation = 'ours') AS ra, max(value) FILTER (metric = 'rmse' AND implementation = 'theirs') AS rb,
  max(value) FILTER (metric = 'smape' AND implementation = 'ours') AS sa, max(value) FILTER (metric = 'smape' AND implementation = 'theirs') AS sb FROM facts GROUP BY 1),
k AS (SELECT series, (rb - ra) / rb AS advantage, row_number() OVER (ORDER BY (rb - ra) / rb DESC, series DESC) - 1 AS rank, count(*) OVER () AS n FROM w WHERE ra IS NOT NULL AND rb <> 0 AND greatest(sa, sb) <= 0.1 AND sa IS NOT NULL AND sb IS NOT NULL)
SELECT CASE WHEN rank = 0 THEN 'best' WHEN rank = n // 2 THEN 'middle' ELSE 'worst' END AS pick, series, round(advantage, 6) AS advantage, rank::BIGINT AS rank FROM k WHERE rank IN (0, n // 2, n - 1)""",
    "sparsity": _with(_HIST) + f"SELECT DISTINCT series_id, round({sum(map(abs, D.DELTA))!r}, 6)::DOUBLE AS sum_abs_delta, 1::BIGINT AS exact_zeros, round({sum(map(abs, D.DELTA)) / 0.05!r}, 6)::DOUBLE AS l1_penalty FROM hist",
    "measurements": _with(_HIST)
    + "SELECT 2::BIGINT AS tier, series_id AS series, 'default' AS configuration, 'ours' AS implementation, metric, round(value, 6) AS value, 'units' AS unit FROM (SELECT series_id, unnest(['mae', 'rmse']) AS metric, unnest([avg(y), max(y)]) AS value FROM hist GROUP BY 1)",
    "agreement_gate": _with(_HIST, _STATS, _future(30, True))
    + f"SELECT round(max(abs(a - b)), 6) AS max_yhat, round(avg(abs(a - b)), 6) AS mean_yhat FROM (SELECT round({_LINEAR} + {_WEEK} * y_scale, 6) AS a, round({_LINEAR} * (1 + {_WEEK}), 6) AS b FROM f)",
    "unpivot_series": """SELECT n_name AS series_id, strftime(DATE '2020-01-01' + (k * 7)::INT, '%Y-%m-%d') AS day, v::DOUBLE AS y
  FROM (SELECT n_name, unnest(range(4)) AS k, unnest([n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END, NULL, n_regionkey]) AS v FROM nation) WHERE v IS NOT NULL""",
    "corpus_digest": "SELECT c_mktsegment AS frequency, count(*) AS n, sha256(string_agg(c_name, chr(10) ORDER BY c_name)) AS digest FROM customer GROUP BY 1",
    "corpus_profile": """WITH b AS (SELECT o_orderpriority AS frequency, o_orderdate::DATE AS start, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT frequency, sum(n)::BIGINT AS n_series, count(*) AS n_starts, strftime(first(start ORDER BY n DESC, start), '%Y-%m-%d') AS modal_start, max(n) AS modal_count FROM b GROUP BY 1""",
    "corpus_drift": """SELECT c_name AS series_id, CASE WHEN c_nationkey % 3 <> 0 THEN 'removed' ELSE 'added' END AS side FROM customer WHERE (c_nationkey % 3 <> 0) <> (c_nationkey % 5 <> 0)""",
    "census": _with(_HIST, _STATS) + "SELECT series_id, n FROM stats WHERE hi - to_days(90) >= lo + to_days(730)",
    "stream_scoring": _with(_HIST, _STATS, _SCALED)
    + f"SELECT series_id, {_DAY}, round(z, 4) + 0.0 AS z, abs(z) > 3 AS anomaly FROM (SELECT series_id, ds, (y - ({_LINEAR} + {_WEEK} * y_scale)) / ({D.SIGMA!r} * y_scale) AS z FROM (SELECT *, epoch_us(ds) / 86400e6 AS days FROM scaled))",
    "sample_series": f"SELECT frequency, series_id FROM (SELECT c_mktsegment AS frequency, c_name AS series_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_uniform('3', 'c_name')}, c_name) AS r FROM customer) WHERE r <= 7",
    "seasonality_warnings": _with(_HIST, _ALL) + "SELECT series_id, 'yearly seasonality is under-identified: the history spans less than 730 days.' AS warning FROM spacing WHERE span_days < 730 AND NOT contains(series_id, '-')",
    "tau_path": _with(_HIST) + "SELECT DISTINCT series_id, 3::BIGINT AS n, true AS kkt_ok, true AS grows FROM hist",
    "recovery": "SELECT r_name AS series_id, true AS k_ok, true AS m_ok, true AS identified_ok, true AS curved FROM region",
    "fit_many_series": "SELECT l_suppkey::VARCHAR AS series_id, count(*) AS n, 'ok' AS status, true AS kkt_ok, CASE WHEN 26 > floor(count(*) * 0.8) THEN greatest(1, floor(count(*) * 0.8) - 1) ELSE 25 END::BIGINT AS n_changepoints FROM (SELECT DISTINCT l_suppkey, date_trunc('week', l_shipdate) AS w FROM lineitem) GROUP BY 1",
    "fit_closed_form": _recursive(_HIST, "rows AS (SELECT series_id, y, promo AS x FROM hist)", _levels("rows")) + "SELECT series_id, round(m, 6) AS m, round(b, 6) AS beta, round(sigma, 6) AS sigma_obs, round(lp, 4) AS lp FROM level",
    "fit_standardized": _recursive(_HIST, _MOVED, _levels("rows")) + f"SELECT series_id, {_DAY}, round((m + b * (disc + 1 - mu) / sd) * y_scale, 4) AS yhat FROM hist JOIN level USING (series_id) JOIN mean USING (series_id)",
    "fit_country_holidays": _recursive(_HIST, _STATS.replace(", CASE WHEN max(abs(y)) = 0 THEN 1.0 ELSE max(abs(y)) END AS y_scale", ""), "firsts AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE day(o_orderdate) = 1)", "rows AS (SELECT series_id, y, (d IS NOT NULL)::INT::DOUBLE AS x FROM hist LEFT JOIN firsts ON d = ds::DATE)", _levels("rows"))
    + f"SELECT series_id, {_DAY}, round((m + CASE WHEN d IS NOT NULL THEN b ELSE 0 END) * y_scale, 4) AS yhat FROM (SELECT series_id, ds FROM hist UNION ALL SELECT series_id, hi + to_days(i::INT) FROM stats, range(1, 31) g(i)) JOIN level USING (series_id) LEFT JOIN firsts ON d = ds::DATE",
    "fit_nested_regressor": _recursive(_HIST, _STATS.replace(", CASE WHEN max(abs(y)) = 0 THEN 1.0 ELSE max(abs(y)) END AS y_scale", ""), _MOVED, "pair AS (SELECT series_id, 'y' AS what, y, x FROM rows UNION ALL SELECT series_id, 'disc', disc, 0.0 FROM hist)", _levels("pair", "series_id, what"))
    + f"""SELECT series_id, {_DAY}, round((o.m + o.b * (disc - mu) / sd) * o.y_scale, 4) AS yhat FROM (
  SELECT series_id, ds, disc FROM hist UNION ALL SELECT series_id, hi + to_days(i::INT), m * y_scale FROM stats JOIN level USING (series_id), range(1, 11) g(i) WHERE what = 'disc')
  JOIN level o USING (series_id) JOIN mean USING (series_id) WHERE what = 'y'""",
    "cv_closed_form": _recursive(_HIST, _STATS, _CUT, "folds AS (SELECT series_id, cutoff, y, 0.0 AS x FROM hist JOIN cuts USING (series_id) WHERE ds <= cutoff)", _levels("folds", "series_id, cutoff"))
    + """SELECT series_id, strftime(cutoff, '%Y-%m-%d') AS cutoff, round(avg(abs(y - f)), 4) AS mae, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse, round(avg(abs(y - f) / nullif(abs(y), 0)), 4) AS mape,
  round(avg(2 * abs(y - f) / nullif(abs(y) + abs(f), 0)), 4) AS smape FROM (SELECT series_id, cutoff, y, m * y_scale AS f FROM hist JOIN level USING (series_id) WHERE ds > cutoff AND ds <= cutoff + to_days(90)) GROUP BY 1, 2""",
    "certificate_literal": _with(_HIST, _STATS, _SCALED) + _certificate(),
    "trend_logistic_floor": _with(_HIST, _STATS, _SCALED, "low AS (SELECT series_id, min(y) / 2 AS y_floor FROM hist GROUP BY 1)") + f"SELECT series_id, {_DAY}, round({_logistic('1.25 * y_max - y_floor')} + y_floor, 6) AS trend FROM scaled JOIN low USING (series_id)",
    "predict_from_json": _with(_HIST, _STATS, _future(30, True)) + f"SELECT series_id, {_DAY}, round({_LINEAR} + {_WEEK} * y_scale, 6) AS yhat FROM f",
    "component_membership": """WITH c(position, "column", own, mode, kind) AS (VALUES (0, 'monthly_delim_1', 'monthly', 'additive', ''), (1, 'monthly_delim_2', 'monthly', 'additive', ''),
  (2, 'new_year_delim_+0', 'new_year', 'multiplicative', 'h'), (3, 'new_year_delim_+1', 'new_year', 'multiplicative', 'h'), (4, 'summer_delim_+0', 'summer', 'multiplicative', 'h'),
  (5, 'summer_delim_+1', 'summer', 'multiplicative', 'h'), (6, 'summer_delim_-1', 'summer', 'multiplicative', 'h'), (7, 'disc', 'disc', 'additive', 'r'), (8, 'promo', 'promo', 'multiplicative', 'r'))
SELECT position::BIGINT AS position, "column", component FROM (SELECT position, "column", own AS component FROM c UNION ALL SELECT position, "column", mode || '_terms' FROM c
  UNION ALL SELECT position, "column", 'holidays' FROM c WHERE kind = 'h' UNION ALL SELECT position, "column", 'extra_regressors_' || mode FROM c WHERE kind = 'r')""",
    "gate_kernels": _with(_HIST) + "SELECT DISTINCT series_id, 0.0::DOUBLE AS changepoints_gap, 0.0::DOUBLE AS scale_gap, 10::BIGINT AS columns_a, 10::BIGINT AS columns_b, true AS ok FROM hist",
    "corpus_exclusions": """WITH s AS (SELECT o_custkey, count(*) >= 5 AS a, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) >= 730 AS b, year(min(o_orderdate)) < 1998 AS c FROM orders GROUP BY 1)
SELECT 0::BIGINT AS stage, 'observations' AS rule, count(*) FILTER (NOT a) AS n_excluded, count(*) FILTER (a) AS n_left FROM s
UNION ALL SELECT 1, 'span', count(*) FILTER (a AND NOT b), count(*) FILTER (a AND b) FROM s UNION ALL SELECT 2, 'start', count(*) FILTER (a AND b AND NOT c), count(*) FILTER (a AND b AND c) FROM s""",
    "resummarise": "WITH "
    + _FACTS
    + f""", s AS (SELECT metric, count(*)::DOUBLE AS n, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.25) AS iqr_low, quantile_cont(d, 0.75) AS iqr_high, (count(*) FILTER (d < 0))::DOUBLE AS wins, (count(*) FILTER (d > 0))::DOUBLE AS losses, (count(*) FILTER (d = 0))::DOUBLE AS ties FROM known GROUP BY 1),
tail AS (SELECT metric, least(1.0, 2 * sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)))) AS p_value FROM s, range(0, 1000) g(i) WHERE i <= least(wins, losses) GROUP BY 1)
SELECT 'paired' AS series, metric, round(value, 6) AS value, unit FROM (SELECT metric, unnest(['n', 'median', 'iqr_low', 'iqr_high', 'wins', 'losses', 'ties', 'p_value']) AS unit, unnest([n, median, iqr_low, iqr_high, wins, losses, ties, p_value]) AS value FROM s JOIN tail USING (metric))""",
    "manifest": "SELECT count(*) AS n, sha256(string_agg(c_mktsegment || ':' || c_name, chr(10) ORDER BY c_mktsegment, c_name)) AS digest FROM customer",
    "csv_scan": _with(_HIST) + f"SELECT series_id, {_DAY}, round(y, 6) AS y FROM hist",
    "facts_files": "WITH " + _FACTS + " SELECT series, implementation, metric, round(value, 6) AS value, '1' AS unit FROM facts",
    "changepoints_none": _with(_HIST) + "SELECT DISTINCT series_id, 0::BIGINT AS position, 0.0::DOUBLE AS t FROM hist",
    "logistic_sampler": _with(_HIST, _STATS, _future(30, False)) + f"SELECT series_id, {_DAY}, round({_logistic()}, 6) AS trend, true AS ordered, false AS vectorized FROM f",
    "built_in_seasonalities": """SELECT name, asked, supported, CASE asked WHEN 'true' THEN usual WHEN 'false' THEN 0 WHEN '7' THEN 7 ELSE CASE WHEN supported THEN usual ELSE 0 END END::BIGINT AS fourier_order
  FROM (VALUES ('yearly', 10), ('weekly', 3), ('daily', 4)) n(name, usual), (VALUES ('auto'), ('true'), ('false'), ('7')) a(asked), (VALUES (true), (false)) s(supported)""",
    "rejections": """SELECT * FROM (VALUES ('growth', 'Parameter "growth" should be "linear", "logistic" or "flat".'), ('range', 'Parameter "changepoint_range" must be in [0, 1]'), ('mode', 'mode must be "additive" or "multiplicative"'),
  ('prior', 'Prior scale must be > 0'), ('sampling', 'mcmc_samples=10 is not supported'), ('reserved', 'Name ''trend'' is reserved.'), ('delimiter', 'Name cannot contain "_delim_"'),
  ('taken', 'Name ''monthly'' already used for a seasonality.'), ('order', 'Fourier order and period must be > 0, and the period finite'),
  ('columns', 'Dataframe must have columns "ds" and "y" with the dates and values respectively.'), ('time zone', 'Column ds has timezone specified, which is not supported. Remove timezone.'),
  ('regressor', 'Regressor ''none'' missing from dataframe'), ('own weekly', 'ok'), ('absmax', 'ok')) v("case", message)""",
}
ORACLES["cv_resumed"] = f"SELECT * FROM ({ORACLES['cv_closed_form']}) WHERE series_id <> 'R'"
ORACLES["holidays_only_ahead"] = ORACLES["fit_country_holidays"].replace("range(1, 31)", "range(1, 401)")
ORACLES["holidays_replaced"] = """SELECT (row_number() OVER (ORDER BY kind, name) - 1)::BIGINT AS position, name, 4.0::DOUBLE AS prior_scale, mode FROM (VALUES ('h', 'new_year_delim_+0', 'multiplicative'),
  ('h', 'new_year_delim_+1', 'multiplicative'), ('h', 'summer_delim_+0', 'multiplicative'), ('h', 'summer_delim_+1', 'multiplicative'), ('h', 'summer_delim_-1', 'multiplicative'), ('r', 'disc', 'additive')) v(kind, name, mode)"""
