"""How often a text is prepared for its dates."""

from pyspark.sql import functions as F

from sorrel.functions import normalize


def test_dates_are_read_once(spark):
    df = spark.range(1).select(normalize.date_range(F.concat(F.lit("July 6"), F.col("id").cast("string"))).alias("r"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
