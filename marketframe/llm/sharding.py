"""Shards by proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row of rank r among
the n rows of its source gets the fractional rank (r + u) / n, where u is a
seeded random number of the source, from 0 to 1, so that sources with few rows
don't all lie in the middle. All rows are sorted by fractional rank, which
interleaves the sources in proportion, and the sorted order is cut into equal
runs: every shard holds the mixture of the whole and shard sizes differ by one
row at most.

No source, no key and no shard is ever gathered in one task: ranks are found in
buckets of the random order (and of the fractional rank), whose sizes are
counted first and summed up, in two levels, to where each bucket starts. A
bucket with many times its share (rows with one key, or without any) is split
further at random.

Edge cases: null sources form a source of their own; a null text is empty; rows
with a null key are placed too; repeated rows are separate rows. An empty table
gives no rows. Fewer rows than shards: some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import HOT_KEYS, saved, text_of

#: Rows that a bucket holds on average, at most.
BUCKET_ROWS = 2_000
#: A bucket with so many times that is split at random.
SPLIT = 8
#: Buckets whose rows are summed up together first.
SUMMED = 1024


def _starts(counts: DataFrame, group: list[str], bucket: str, part: str) -> DataFrame:
    """Where each part of a bucket begins: the rows of its group before it.

    ``counts`` has a row per group, bucket and part, not per row of the data;
    stretches of buckets are summed first, so no task walks all of a group's.
    """
    cut = counts.withColumn("stretch", F.expr(f"{bucket} div {SUMMED}"))
    before = Window.partitionBy(*group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    long = cut.groupBy(*group, "stretch").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy(*group, "stretch").orderBy(bucket, part).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return own.join(long.select(*group, "stretch", "base"), [*group, "stretch"]).withColumn("start", F.col("base") + F.col("own")).drop("stretch", "base", "own")


def _order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _fraction(digest: Column, digits: int = 6) -> Column:
    """A number from the first digits of a digest."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def _parted(rows: DataFrame, group: list[str], counts: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``part``: 0, or in buckets with many times their share a random one of several."""
    many = counts.where(F.col("n") > max(SPLIT * BUCKET_ROWS, total // HOT_KEYS))  # at most HOT_KEYS rows
    many = many.select(*group, F.ceil(F.col("n") / BUCKET_ROWS).alias("parts"))
    part = F.coalesce(F.pmod(F.col("spread"), F.col("parts")), F.lit(0))
    return rows.join(F.broadcast(many), group, "left").withColumn("part", part).drop("parts")


def interleaved(
    docs: DataFrame, shards: int, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """``key, source, size, text_crc32, shard, slot`` for every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 16, ``slot`` the place in the
    shard, gapless from 0.
    """
    content = text_of(text)
    order = _order(seed, key)
    rows = docs.select(
        F.col(key).alias("k"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("s"),
        (F.octet_length(content).cast("bigint") + 16).alias("size"),
        F.crc32(content.cast("binary")).alias("crc"),
        order.alias("o"),
        _fraction(order).alias("o24"),
        F.xxhash64(F.lit("spread"), F.monotonically_increasing_id()).alias("spread"),
    )
    rows = saved(rows, "shard-rows")  # a few dozen bytes a row; the texts are read once
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("b", F.expr(f"o24 * {buckets} div {1 << 24}"))
    rows = _parted(rows, ["s", "b"], rows.groupBy("s", "b").agg(F.count("*").alias("n")), total)
    counts = saved(rows.groupBy("s", "b", "part").agg(F.count("*").alias("n")), "shard-buckets")
    sizes = counts.groupBy("s").agg(F.sum("n").alias("n_s"))
    starts = _starts(counts, ["s"], "b", "part").join(sizes, "s").select("s", "b", "part", "start", "n_s")
    in_bucket = Window.partitionBy("s", "b", "part").orderBy("o", "k", "crc", "size")
    first = (_fraction(_order(seed, "s")) + 0.5) / float(1 << 24)
    ranked = (
        rows.withColumn("i", F.row_number().over(in_bucket) - 1)
        .join(starts, ["s", "b", "part"])
        .withColumn("fraction", (F.col("start") + F.col("i") + first) / F.col("n_s"))
        .withColumn("f", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
        .select("k", "s", "size", "crc", "o", "spread", "fraction", "f")
    )
    ranked = saved(ranked, "shard-ranks")
    ranked = _parted(ranked, ["f"], ranked.groupBy("f").agg(F.count("*").alias("n")), total)
    # one row per fraction bucket: rows / BUCKET_ROWS of them
    counts = saved(ranked.groupBy("f", "part").agg(F.count("*").alias("n")).withColumn("one", F.lit(1)), "shard-cuts")
    cuts = _starts(counts, ["one"], "f", "part")
    in_fraction = Window.partitionBy("f", "part").orderBy("fraction", "s", "o", "k", "crc", "size")
    placed = (
        ranked.withColumn("i", F.row_number().over(in_fraction) - 1)
        .join(cuts.select("f", "part", "start"), ["f", "part"])
        .withColumn("p", F.col("start") + F.col("i"))
    )
    # shard j holds the positions from ceil(j * total / shards) on
    shard = F.expr(f"p * {shards} div {max(total, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        F.col("k").alias(key),
        F.when(F.col("s") != "", F.substring("s", 2, 1 << 30)).alias(source),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("p") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")).alias("slot"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard, rows in slot order. ``key`` must be unique."""
    shards = placed.select(key, "shard", "slot")
    (
        docs.join(shards, key)
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
