import re

from pyspark.sql import functions as F

from marketframe.llm.common import HOT_KEYS, attached, hot_from, remove_tables, run_dir, saved


def test_hot_rows_are_spread(spark):
    """The rows of a hot key and those without one reach many tasks, and all get their values."""
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 4 == 1, None).when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).cast("bigint").alias("k"))
    values = rows.where("k IS NOT NULL AND k <> 11").groupBy("k").agg(F.count("*").alias("n"))
    out = attached(rows, values, "k", values.where(F.col("n") > hot_from(4000)))
    want = {r.id: r for r in rows.join(values, "k", "left").collect()}
    got = out.collect()
    assert len(got) == 4000 and all(r.n == want[r.id].n and r.k == want[r.id].k for r in got)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        tasks = attached(rows, values, "k", values.where(F.col("n") > 64)).groupBy(F.spark_partition_id().alias("p")).count().collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(r["count"] for r in tasks) < 1500 and re.search("__at", plan)


def test_bound_of_hot_keys():
    assert hot_from(0) == hot_from(1000) == 64 and hot_from(10**10) * HOT_KEYS >= 10**10


def test_remove_tables(spark):
    df = saved(spark.range(3), "some")
    where = run_dir(spark)
    assert df.count() == 3
    remove_tables(spark)
    import os

    assert not os.path.exists(where.removeprefix("file:"))
    assert saved(spark.range(2), "more").count() == 2
