"""The design: Fourier blocks, holiday windows and regressors as one array a row, and what its columns mean.

Column order: seasonalities as registered, then holiday columns by name, then regressors as registered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import fourier
from ..spec import Holiday, ModelSpec, Regressor, Seasonality


@dataclass(frozen=True)
class DesignColumn:
    name: str
    component: str
    prior_scale: float
    mode: str
    kind: str


def holiday_column(name: str, offset: int) -> str:
    return f"{name}_delim_{'+' if offset >= 0 else '-'}{abs(offset)}"


def holiday_columns(holidays: tuple[Holiday, ...]) -> list[str]:
    """Names of the (holiday, offset) columns, in code point order."""
    return sorted({holiday_column(h.name, k) for h in holidays for k in range(h.lower, h.upper + 1)})


def design_columns(spec: ModelSpec, seasonalities: tuple[Seasonality, ...], holidays: list[str] | None = None) -> list[DesignColumn]:
    """``holidays`` are the holiday columns in their order, by default those of the specification's own holidays."""
    holidays = holiday_columns(spec.holidays) if holidays is None else holidays
    out = [DesignColumn(f"{s.name}_delim_{k + 1}", s.name, s.prior_scale, s.mode, "seasonality") for s in seasonalities for k in range(2 * s.order)]
    scales = {h.name: h.prior_scale or spec.holidays_prior_scale for h in spec.holidays}
    out += [DesignColumn(c, c.split("_delim_")[0], scales.get(c.split("_delim_")[0], spec.holidays_prior_scale), spec.holiday_mode, "holiday") for c in holidays]
    return out + [DesignColumn(r.name, r.name, r.prior_scale, r.mode, "regressor") for r in spec.regressors]


def components(columns: list[DesignColumn]) -> dict[str, list[int]]:
    """Component: positions of its columns. Besides each component the totals of both modes, of all holidays and of the regressors of
    either mode. Without any column a component zeros stands alone. A component with columns of both modes is an error."""
    if not columns:
        return {"zeros": []}
    kinds: dict[str, set[str]] = {}
    for c in columns:
        kinds.setdefault(c.component, set()).add(c.mode)
    for name, found in kinds.items():
        if len(found) > 1:
            raise ValueError(f"Component {name!r} has both additive and multiplicative columns.")
    out: dict[str, list[int]] = {}
    for k, c in enumerate(columns):
        out.setdefault(c.component, []).append(k)
    for k, c in enumerate(columns):
        out.setdefault(f"{c.mode}_terms", []).append(k)
        if c.kind == "holiday":
            out.setdefault("holidays", []).append(k)
        if c.kind == "regressor":
            out.setdefault(f"extra_regressors_{c.mode}", []).append(k)
    for mode in ("additive", "multiplicative"):
        out.setdefault(f"{mode}_terms", [])
    return out


def component_table(spark: SparkSession, columns: list[DesignColumn]) -> DataFrame:
    """``components`` as a relation: position, column, component, one row for each membership."""
    rows = [(k, columns[k].name, name) for name, at in components(columns).items() for k in at]
    return spark.createDataFrame(rows, "position long, column string, component string")


def condition(name: str) -> Column:
    """A boolean, or a number that is 0 or 1; anything else, null too, is an error of the row."""
    value = F.col(name).cast("double")
    return F.when(value == 1.0, F.lit(True)).when(value == 0.0, F.lit(False)).otherwise(F.raise_error(F.lit(f"Found non-boolean in column '{name}'")).cast("boolean"))


def seasonality_block(s: Seasonality, days: Column) -> Column:
    block = fourier(days, s.period, s.order)
    if s.condition is None:
        return block
    return F.when(condition(s.condition), block).otherwise(F.array_repeat(F.lit(0.0), 2 * s.order))


def seasonality_features(df: DataFrame, seasonalities: tuple[Seasonality, ...], days: str = "days") -> DataFrame:
    """Adds seasonal, the concatenated Fourier blocks; rows outside a seasonality's condition have zeros in its block."""
    blocks = [seasonality_block(s, F.col(days)) for s in seasonalities]
    return df.withColumn("seasonal", F.concat(*blocks) if blocks else F.array().cast("array<double>"))


def holiday_occurrences(holidays: DataFrame) -> DataFrame:
    """day and column: the days that a holiday's window covers, from (holiday, ds, lower_window, upper_window)."""
    rows = holidays.where("ds is not null").select("holiday", F.to_date("ds").alias("on"), F.explode(F.sequence(F.col("lower_window").cast("int"), F.col("upper_window").cast("int"))).alias("offset"))
    sign = F.when(F.col("offset") >= 0, "+").otherwise("-")
    return rows.select(F.date_add("on", F.col("offset")).alias("day"), F.concat("holiday", F.lit("_delim_"), sign, F.abs("offset").cast("string")).alias("column")).distinct()


def holiday_features(df: DataFrame, holidays: DataFrame, names: list[str] | None) -> DataFrame:
    """Adds holiday, one 0/1 number for each of ``names``, or of the row's own holiday_columns: matched by calendar day. Names that
    don't occur stay 0; several occurrences on one day still count once."""
    if names is not None and not names:
        return df.withColumn("holiday", F.array().cast("array<double>"))
    by_day = holiday_occurrences(holidays).groupBy("day").agg(F.collect_set("column").alias("_on"))
    rows = df.withColumn("_day", F.to_date("ds")).join(by_day.withColumnRenamed("day", "_day"), "_day", "left")
    on = lambda n: F.coalesce(F.array_contains("_on", n).cast("double"), F.lit(0.0))
    block = F.transform("holiday_columns", on) if names is None else F.array(*[on(F.lit(n)) for n in names])
    return rows.withColumn("holiday", block).drop("_day", "_on")


def holiday_frame(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """The specification's holidays as a table."""
    rows = [(h.name, h.ds, h.lower, h.upper) for h in spec.holidays]
    return df.sparkSession.createDataFrame(rows, "holiday string, ds timestamp_ntz, lower_window int, upper_window int")


def _calendar(calendar: DataFrame | None, country: str) -> DataFrame:
    if calendar is None:
        raise ValueError(f"The holidays of {country!r} need a calendar (country, ds, holiday).")
    rows = calendar.where((F.col("country") == country) & F.col("ds").isNotNull() & F.col("holiday").isNotNull())
    return rows.select("holiday", F.col("ds").cast("timestamp_ntz").alias("ds"), F.lit(0).alias("lower_window"), F.lit(0).alias("upper_window")).distinct()


def country_holidays(calendar: DataFrame, country: str, years: DataFrame) -> DataFrame:
    """A calendar's (country, ds, holiday) rows for the years present in ``years`` (column year), as a holiday table."""
    rows = _calendar(calendar, country).withColumn("year", F.year("ds")).join(years.select("year").distinct(), "year", "left_semi")
    return rows.select("holiday", "ds", "lower_window", "upper_window")


def holiday_table(df: DataFrame, spec: ModelSpec, holidays: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """The specification's holidays (or ``holidays`` in their place) and its country's, for any dates: days outside a frame's years match no row."""
    own = (holiday_frame(df, spec) if holidays is None else holidays).select("holiday", F.col("ds").cast("timestamp_ntz").alias("ds"), "lower_window", "upper_window")
    return own if spec.country is None else own.unionByName(_calendar(calendar, spec.country))


def train_holiday_columns(df: DataFrame, spec: ModelSpec, calendar: DataFrame | None = None) -> list[str]:
    """The holiday columns that a fit of ``df`` has: the specification's, and the country's holidays in the years of the history. A forecast
    keeps them all and adds none. A country's names, few by nature, reach the driver."""
    names = set(holiday_columns(spec.holidays))
    if spec.country is not None:
        found = country_holidays(_named(calendar, spec.country), spec.country, df.select(F.year("ds").alias("year")))
        for r in found.select("holiday").distinct().collect():
            spec.validate_name(r.holiday, "holiday")
            names.add(holiday_column(r.holiday, 0))
    return sorted(names)


def _named(calendar: DataFrame | None, country: str) -> DataFrame:
    _calendar(calendar, country)
    return calendar


def regressor_stats(df: DataFrame, regressors: tuple[Regressor, ...]) -> DataFrame:
    """series_id and, for each regressor, <name>_mu and <name>_std: mean and sample deviation, or (0, 1) if it isn't standardised. With
    ``auto`` a column of exactly the values 0 and 1 is left alone; so is a constant one."""
    aggs = []
    for r in regressors:
        if r.name not in df.columns:
            raise ValueError(f"Regressor {r.name!r} missing from dataframe")
        x = F.col(r.name).cast("double")
        bad = F.count_if(x.isNull() | F.isnan(x)) > 0
        mu, std = F.avg(x), F.stddev_samp(x)
        binary = (F.min(x) == 0) & (F.max(x) == 1) & (F.count_if((x != 0) & (x != 1)) == 0)
        on = (F.min(x) != F.max(x)) & (~binary if r.standardize == "auto" else F.lit(bool(r.standardize)))
        stop = F.raise_error(F.lit(f"Found NaN in column {r.name!r}")).cast("double")
        aggs += [F.when(bad, stop).when(on, mu).otherwise(0.0).alias(f"{r.name}_mu"), F.when(on, std).otherwise(1.0).alias(f"{r.name}_std")]
    return df.groupBy("series_id").agg(*aggs)


def regressor_features(df: DataFrame, regressors: tuple[Regressor, ...]) -> Column:
    cols = [(F.col(r.name).cast("double") - F.col(f"{r.name}_mu")) / F.col(f"{r.name}_std") for r in regressors]
    return F.array(*cols) if cols else F.array().cast("array<double>")
