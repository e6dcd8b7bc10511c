"""Persisting models: a Parquet table, and one JSON object a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fit import MODEL


def save_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def to_json(models: DataFrame) -> DataFrame:
    """series_id and model, a JSON object of everything prediction reads."""
    return models.select("series_id", F.to_json(F.struct(*[c.split(" ")[0] for c in MODEL.split(", ")])).alias("model"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("model", MODEL).alias("x")).select("x.*")


def require_fitted(models: DataFrame, series: DataFrame) -> None:
    """Raises if a series has no model."""
    missing = series.select("series_id").distinct().join(models, "series_id", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"Model has not been fit. ({missing[0].series_id})")
