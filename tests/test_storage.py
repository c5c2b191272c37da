"""Shared tables and joins with hot keys."""

import pytest
from lodestrata.storage import materialize, release, shared_dir, skew_join
from pyspark.sql import functions as F


def test_written_tables_are_read_back_and_go(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    table = materialize(df, "test")
    assert table.columns == df.columns and table.exceptAll(df).count() == 0
    path = table.inputFiles()[0].rpartition("/")[0].replace("file:", "").replace("//", "/")
    release(spark)
    import os

    assert not os.path.exists(path)


def test_skew_join_equals_a_join(spark):
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), "id").unionByName(spark.createDataFrame([(None, 1)], "k bigint, id bigint"))
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v")).filter("k < 40")
    want = big.join(small, "k")
    for share in (1 / 2000, 0.1, 2.0):
        got = skew_join(big, small, ["k"], "n", 3001, share)
        assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared_dir(Cluster)
