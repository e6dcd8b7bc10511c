"""A stream of observations against the models table: a stream-static join, so models are read again with each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.forecast import joined, with_point
from ..spec import ModelSpec


def score_stream(observations: DataFrame, models: DataFrame, spec: ModelSpec, width: float = 3.0) -> DataFrame:
    """series_id, ds, y, yhat, z, anomaly for every observation (streaming or not): z is the error in observation deviations."""
    rows = with_point(joined(observations, models, spec), spec)
    z = (F.col("y") - F.col("yhat")) / (F.col("sigma_obs") * F.col("y_scale"))
    return rows.select("series_id", "ds", F.col("y").cast("double").alias("y"), "yhat", z.alias("z"), (F.abs(z) > width).alias("anomaly"))


def rolling_errors(scored: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mean absolute error by series and window, closed by the watermark."""
    rows = scored.withColumn("at", F.col("ds").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy("series_id", F.window("at", window)).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"), F.count_if("anomaly").alias("anomalies"))
