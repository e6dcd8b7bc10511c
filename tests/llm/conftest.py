import pytest
from odd_rows import ODD
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    base = spark.createDataFrame(ODD, "doc_id long, text string")
    return base.withColumns({c: F.lit(None).cast("string") for c in ("source", "lang", "score", "spans", "hits", "n_words", "bucket", "id", "comp", "topic_", "failures", "_words", "start")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")
