"""Broadcast checks by rows and bytes."""

from pyspark.sql import functions as F

from docmill.functions.sizing import fits, maybe_broadcast, row_bytes


def test_bytes_follow_variable_values(spark):
    df = spark.createDataFrame(
        [(1, "x" * 1000, [1.0] * 50, {"k": "v" * 300}, ["a" * 200], (1, "y" * 100)), (None,) * 6],
        "a long, s string, v array<double>, m map<string,string>, t array<string>, st struct<q:int,r:string>")
    big, none = [r[0] for r in df.select(row_bytes(df)).collect()]
    assert big - none >= 1000 + 400 + 300 + 200 + 100 and none < 150


def test_fits_counts_rows_and_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 10_000).alias("s"))
    assert fits(wide) and not fits(wide, max_bytes=50_000) and not fits(wide, max_rows=9)
    assert fits(wide.limit(0), 0, 0)
    hint = maybe_broadcast(wide)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hint.lower()
    assert "broadcast" not in maybe_broadcast(wide, max_bytes=10)._jdf.queryExecution().logical().toString().lower()
