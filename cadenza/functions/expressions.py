"""Column expressions. All of them are built-in functions, so plans stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ds: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp or date, whatever the session's time zone."""
    ds = ds.cast("timestamp_ntz")
    day = F.datediff(F.to_date(ds), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.date_part(F.lit("SECOND"), ds) * 1_000_000).cast("long")
    return day * DAY + F.hour(ds).cast("long") * 3_600_000_000 + F.minute(ds).cast("long") * 60_000_000 + second


def from_micros(us: Column) -> Column:
    day = F.floor(us / DAY).cast("int")
    start = F.date_add(F.lit("1970-01-01").cast("date"), day).cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((us - day.cast("long") * DAY) / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)"))


def seasonal_time(ds: Column) -> Column:
    """Days since 1970-01-01."""
    return micros(ds) / F.lit(float(DAY))


def fourier(days: Column, period: float, order: int) -> Column:
    """sin and cos of each harmonic in turn."""
    angle = lambda i: F.lit(2.0 * math.pi / period) * days * F.lit(float(i))
    return F.array(*[f(angle(i)) for i in range(1, order + 1) for f in (F.sin, F.cos)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def linear_trend(t: Column, k: Column, m: Column, delta: Column, changepoints: Column) -> Column:
    """(k + A delta) t + (m - A (s * delta)), with the indicator A kept inside the fold."""
    shift = F.aggregate(F.zip_with(delta, changepoints, lambda d, s: F.when(t >= s, d * (t - s)).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
    return k * t + m + shift


def logistic_offsets(k: Column, m: Column, delta: Column, changepoints: Column) -> Column:
    """How far the curve's offset moves at each changepoint so that the curve stays continuous.

    Behind a changepoint the curve's argument is rate * t - level, where rate is k plus the changes so far and level is k m plus the changes times their
    times; the offset is level / rate. Where a rate is 0 the offset stays.
    """
    begin = F.struct(k.cast("double").alias("rate"), (k * m).cast("double").alias("level"), m.cast("double").alias("at"), F.array().cast("array<double>").alias("out"))

    def move(acc: Column, x: Column) -> Column:
        rate, level = acc["rate"] + x["d"], acc["level"] + x["d"] * x["s"]
        at = F.when(rate == 0, acc["at"]).otherwise(F.try_divide(level, rate))
        return F.struct(rate.alias("rate"), level.alias("level"), at.alias("at"), F.concat(acc["out"], F.array(at - acc["at"])).alias("out"))

    return F.aggregate(F.zip_with(delta, changepoints, lambda d, s: F.struct(d.alias("d"), s.alias("s"))), begin, move, lambda acc: acc["out"])


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def logistic_trend(t: Column, cap: Column, k: Column, m: Column, delta: Column, changepoints: Column) -> Column:
    """Continuity makes the curve's argument piecewise linear in t, whatever the rates, also where one is 0."""
    return cap * sigmoid(linear_trend(t, k, -k * m, delta, changepoints))


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) that depends on its key only: neither partitioning nor order changes a draw."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def normal(*parts: Column) -> Column:
    """Box-Muller from two keyed uniforms."""
    u = F.greatest(uniform(*parts, F.lit("n1")), F.lit(1e-15))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * uniform(*parts, F.lit("n2")))


def laplace(scale: Column, *parts: Column) -> Column:
    u = F.greatest(uniform(*parts, F.lit("l")), F.lit(1e-15)) - 0.5
    return -scale * F.signum(u) * F.ln(F.greatest(F.lit(1e-15), 1.0 - 2.0 * F.abs(u)))


def sign_test(wins: Column, losses: Column, least: int = 6) -> Column:
    """Two-sided exact sign test; null below ``least`` untied pairs. The tail is summed in logarithms."""
    n, low = wins + losses, F.least(wins, losses)
    logs = F.aggregate(
        F.sequence(F.lit(0).cast("long"), low),
        F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct((acc["term"] + F.when(i < low, F.ln((n - i).cast("double")) - F.ln((i + 1).cast("double"))).otherwise(0.0)).alias("term"), (acc["sum"] + F.exp(acc["term"] - n * math.log(2.0))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(n >= least, F.least(F.lit(1.0), 2.0 * logs))
