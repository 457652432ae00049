"""Random lookups over more parts than one run can all ask for."""

import __spark_entry__


def test_every_part_is_asked_for(spark, tmp_path):
    n = 120_000
    spark.range(n).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    rows = __spark_entry__.queries()["random_queries"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(1_000_000, 1_000_000, n, True)]
