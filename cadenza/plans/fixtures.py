"""Series built from the test tables, and literal models whose forecasts SQL can recompute."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prepare as P
from ..operators.fit import with_fit_columns
from ..spec import ModelSpec

#: Fixed values of the literal model.
K, M, SIGMA = 0.2, 0.4, 0.05
POINTS, DELTA = (0.2, 0.5, 0.7), (0.3, -0.2, 0.1)
WEEKLY = (0.05, -0.02, 0.01, 0.03, -0.04, 0.02)
LOGISTIC_K, LOGISTIC_M = 2.0, 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share; a local session that names none takes a temporary folder."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="cadenza-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipped quantity by return flag, with a real and a binary regressor and a condition."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ds"))
    rows = rows.agg(F.sum("l_quantity").alias("y"), F.sum(F.col("l_discount") * 100).alias("disc"))
    return rows.withColumn("promo", (F.dayofmonth("ds") <= 5).cast("double")).withColumn("winter", F.month("ds").isin(11, 12, 1, 2))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("ds"))
    return rows.agg(F.count("*").cast("double").alias("y"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ds"))
    return rows.agg(F.count("*").cast("double").alias("y"))


def literal_spec(**changes: object) -> ModelSpec:
    from dataclasses import replace

    return replace(ModelSpec(yearly=False, weekly=True, daily=False), **changes)


def literal_models(history: DataFrame, growth: str = "linear") -> DataFrame:
    """The literal parameters with each series' own scaling."""
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    k, m = (LOGISTIC_K, LOGISTIC_M) if growth == "logistic" else (K, M)
    stats = P.series_stats(P.clean_history(history))
    none = F.array().cast("array<double>")
    models = stats.select(
        "series_id", F.lit(growth).alias("growth"), "n", "start_us", "end_us", "y_scale", F.lit(False).alias("yearly"), F.lit(True).alias("weekly"), F.lit(False).alias("daily"),
        array(POINTS).alias("changepoints_t"), F.lit(k).alias("k"), F.lit(m).alias("m"), array(DELTA).alias("delta"), F.lit(SIGMA).alias("sigma_obs"), array(WEEKLY).alias("beta"),
        none.alias("regressor_mu"), none.alias("regressor_std"), F.lit(0.0).alias("lp"), F.lit(0.0).alias("kkt"), F.lit(0).alias("iterations"), F.lit("literal").alias("status"), none.alias("trace"),
    )
    return with_fit_columns(models)
