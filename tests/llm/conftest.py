import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Texts (or (text, lang, source)) to a table of documents, ids from 0."""

    def make(rows, extra=False):
        full = [(i, *((r, "en", "s") if r is None or isinstance(r, str) else r)) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DDL)
        return df.selectExpr("*", "1 AS start", "'x' AS shard", "2 AS key", "3 AS count", "'y' AS class_id") if extra else df

    return make
