"""Benchmark decontamination by size-partitioned MinHash containment search.

Items of the benchmark are sets of five-word shingles. A document leaks an item
if it holds at least 80 % of the item's shingles. Since documents are far longer
than items, resemblance says nothing and containment is searched directly: items
are partitioned by the size of their sets, and each partition has its own law.
An item of n shingles in a partition that asks for t hits has a sketch of its
n - ceil(0.8 n) + t smallest hashes (bottom-k MinHash); as a document with enough
of the item lacks at most n - ceil(0.8 n) of them, it holds t at least, so no
leak is lost. Small items can ask for one hit only; larger ones ask for more, so
a long document that shares a common phrase with many items is a candidate of
few. Candidates are compared with the item, shingle by shingle.

All of it is DataFrame operations. Sketches, candidates and leaking keys are
counted and broadcast while they have at most ``BROADCAST_ROWS`` rows, so texts
stay where they are read; beyond that they are joined by a shuffle.

Words are runs of letters and digits in lower case, so case and punctuation
don't hide a leak.

Edge cases: null texts are empty; an item of fewer than five words is one
shingle of its own length, met by a document that holds those words in a row;
items without a word never match. Each different text under one item id is an
item of its own, with its own sketch and, if it leaks, its own row; equal ones
count once. Rows with a null key can't be reported and are skipped; repeated
rows are reported once; equal items are all reported. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import let, saved, text_of

SHINGLE = 5
PERCENT = 80
BROADCAST_ROWS = 200_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _starts(each: Column, n: int) -> Column:
    return F.when(F.size(each) >= n, F.sequence(F.lit(1), F.size(each) - (n - 1))).otherwise(F.array().cast("array<int>"))


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The distinct shingles as text, for exact comparison."""
    return let(words(text), lambda w: F.array_distinct(F.transform(_starts(w, n), lambda i: F.array_join(F.slice(w, i, n), " "))))


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """A hash for each shingle, with repeats; the words are hashed once."""
    each = F.transform(words(text), lambda w: F.xxhash64(w))
    return let(each, lambda w: F.transform(_starts(w, n), lambda i: F.xxhash64(F.slice(w, i, n))))


def _length(text: Column) -> Column:
    """The words of a shingle of an item: five, or all that it has."""
    return F.least(F.size(words(text)), F.lit(SHINGLE))


def _of_lengths(of, text: Column, lengths: list[int]) -> Column:
    """The shingles ``of(text, n)`` of every length, in one array."""
    return F.concat(*[of(text, n) for n in lengths])


def need(size: Column, percent: int = PERCENT) -> Column:
    """Shingles that a document must hold of an item with ``size``."""
    return F.floor((size * percent + 99) / 100).cast("int")


def size_class(n: Column) -> Column:
    """The partition of an item: sizes from one power of two to the next."""
    return F.floor(F.log2(n)).cast("int")


def hits(of: Column) -> Column:
    """How many hashes of a sketch a document must hold, by the item's size class."""
    return F.greatest(F.lit(1), of - 1)


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``h, item, size_class``: the smallest hashes of each item, as many as its size and its class ask for."""
    one = items.select("item", "n", size_class(F.col("n")).alias("size_class"), F.explode(F.array_distinct("hashes")).alias("h"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("h"))
    most = F.col("n") - need(F.col("n"), percent) + hits(F.col("size_class"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select("h", "item", "size_class")


def _sent(small: DataFrame, rows: int) -> DataFrame:
    """The smaller side of a join, with its number of rows: broadcast within the bound, else sorted and merged."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """``key, item, n_shingles, n_shared, containment``: every document with at least ``percent`` of an item."""
    content = text_of(item_text)
    whole = F.array(F.array_join(words(content), " ")), F.array(F.xxhash64(F.transform(words(content), lambda w: F.xxhash64(w))))
    short = _length(content) < SHINGLE
    items = benchmark.where(F.col(item).isNotNull() & (_length(content) > 0)).select(
        F.col(item).alias("id"),
        _length(content).alias("length"),
        F.when(short, whole[0]).otherwise(shingles(content)).alias("shingles"),
        F.when(short, whole[1]).otherwise(shingle_hashes(content)).alias("hashes"),
    )
    # the texts under one id are told apart by their sets
    digest = F.sha2(F.array_join(F.array_sort("shingles"), "\n"), 256)
    items = items.withColumn("item", F.struct("id", digest.alias("digest"))).withColumn("n", F.size("shingles"))
    items = saved(items.dropDuplicates(["item"]), "benchmark-items")
    lengths = sorted({SHINGLE, *(r.length for r in items.select("length").distinct().collect())})
    sketch = saved(sketches(items, percent), "benchmark-sketches")
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).where("key IS NOT NULL")
    met = rows.select("key", F.explode(_of_lengths(shingle_hashes, F.col("text"), lengths)).alias("h"))
    met = met.join(_sent(sketch, sketch.count()), "h")
    held = met.select("key", "item", "size_class", "h").distinct().groupBy("key", "item", "size_class").agg(F.count("*").alias("held"))
    candidates = saved(held.where(F.col("held") >= hits(F.col("size_class"))).select("key", "item"), "leak-candidates")
    compared = (
        # few documents are candidates; where they are many after all, texts are shuffled
        rows.join(_sent(candidates.groupBy("key").agg(F.collect_set("item").alias("found")), candidates.count()), "key")
        .select("key", _of_lengths(shingles, F.col("text"), lengths).alias("held"), F.explode("found").alias("item"))
        .join(items.select("item", "n", "shingles"), "item")
        .withColumn("n_shared", F.size(F.array_intersect("held", "shingles")))
        .where(F.col("n_shared") >= need(F.col("n"), percent))
    )
    return compared.select(
        F.col("key").alias(key),
        F.col("item.id").alias(item),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.col("n_shared").cast("bigint").alias("n_shared"),
        (F.col("n_shared") / F.col("n")).alias("containment"),
    ).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that leak an item; rows with a null key stay."""
    leaking = saved(leaks(docs, benchmark, key, **how).select(key).distinct(), "leaking-keys")
    return docs.join(_sent(leaking, leaking.count()), key, "left_anti").select(*docs.columns)
