"""Connected components by alternating large-star and small-star steps.

Kiveris et al., 2014. Each step groups links by node with map-side combining and
joins the minimum back, so a node with very many links is handled by the skewed
join, never gathered. Nothing is collected but two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import new_path, removed, saved


def _stars(links: DataFrame, path: str) -> DataFrame:
    """Large-star, then small-star, on links (u, v) with u > v; the links between the two are kept at ``path``."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = saved(large, "stars", path)
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node, root``: for every node with a link, the smallest node that it reaches."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    spark = links.sparkSession
    at, mark = new_path(spark, "links"), None
    now = saved(pairs, "links", at)
    for _ in range(most):
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark or not row.n:
            break
        mark = (row.n, row.h)
        stars, new = new_path(spark, "stars"), new_path(spark, "links")
        now = saved(_stars(now, stars), "links", new)
        # the links of the round before are written out anew; nothing reads them any more
        removed(spark, stars)
        removed(spark, at)
        at = new
    else:
        raise RuntimeError(f"no fixpoint after {most} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
