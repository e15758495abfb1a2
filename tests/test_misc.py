"""Numbering, bundles, the entry contract."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartwalk.operators.ids import dense_index
from cartwalk.sources import io as IO


def test_dense_index_equals_row_number(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 3 % 1009).alias("v")).distinct()
    got = dense_index(df, ["v"], "i", start=1, num_partitions=5)
    want = df.withColumn("i", F.row_number().over(Window.orderBy("v")).cast("long"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_bundle_roundtrip(spark):
    path = IO.new_dir(spark, "bundle-test")
    t = spark.range(10)
    IO.save_bundle(spark, path, {"t": t, "x": 1.5, "lst": [1, 2], "nested": {"u": spark.range(3), "s": "a"},
                                 ".hidden": 3})
    b = IO.load_bundle(spark, path)
    assert b["t"].count() == 10 and b["x"] == 1.5 and b["lst"] == [1, 2]
    assert b["nested"]["u"].count() == 3 and b["nested"]["s"] == "a"
    assert ".hidden" not in b


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["session_id", "item_id", "rank", "score"]
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 140
