"""Token counts through a digest cache.

The cache is a parquet table ``(digest, n_tokens)`` partitioned by a tokenizer
version. Texts are reduced to SHA-256 digests of their normalised content,
digests are joined with the cache, and only distinct texts that the cache does
not hold are encoded; their counts are appended.

Edge cases: a null text counts as empty (0 tokens, 0 bytes). Repeated rows each
get a row. Empty tables give empty results. Other columns are ignored. Two runs
may append the same digest; readers take one entry per digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import attached, hot_from, saved, text_of

#: Texts given to the tokenizer at once; bounds a worker's memory.
BATCH = 64


def piece_counter(model_file: str):
    """A function from texts to token counts, for a sentencepiece model."""

    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

    return load


def bpe_counter(json_file: str):
    """A function from texts to token counts, for a tokenizers file."""

    def load():
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(json_file)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]

    return load


def version_of(path: str) -> str:
    """A version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def content_digest(text: Column) -> Column:
    """SHA-256 of the content as 32 bytes.

    The normal form is the text itself with null as empty: any stronger one
    (case, white space) would join texts with different counts.
    """
    return F.unhex(F.sha2(text, 256))


def read_cache(spark, path: str, version: str) -> DataFrame | None:
    """The cached counts of one tokenizer version; None if there are none yet."""
    try:
        table = spark.read.schema("digest binary, n_tokens bigint, tokenizer string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return table.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str, load, version: str, text: str = "text") -> DataFrame:
    """``(digest, n_tokens)`` for every distinct text of ``docs``.

    ``load()`` runs in the worker and gives a function from a list of texts to
    their counts. Missing counts are appended to the table at ``cache_path``.
    """
    spark = docs.sparkSession
    content = text_of(text)
    # copies collapse before the shuffle, so a text that fills a third of the table moves once per task
    distinct = docs.select(content_digest(content).alias("digest"), content.alias("text")).dropDuplicates(["digest"])
    cached = read_cache(spark, cache_path, version)
    missing = distinct if cached is None else distinct.join(cached, "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = load()
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                yield pd.DataFrame({"digest": part["digest"], "n_tokens": count(part["text"].tolist())})

    encoded = missing.mapInPandas(encode, "digest binary, n_tokens bigint")
    encoded.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    return counts if counts is not None else encoded.limit(0)


def token_counts(
    docs: DataFrame, cache_path: str, load, version: str, limit: int = 4096, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit, digest`` for every row of ``docs``."""
    counts = count_tokens(docs, cache_path, load, version, text)
    content = text_of(text)
    rows = docs.select(
        F.col(key).alias("key"), F.octet_length(content).cast("bigint").alias("n_bytes"), content_digest(content).alias("digest")
    )
    # digests of texts that very many rows have, counted before the shuffle
    often = rows.groupBy("digest").count().where(F.col("count") > hot_from(docs.count()))
    found = attached(rows, counts, "digest", saved(often, "frequent-texts"))
    return found.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.hex("digest").alias("digest")
    )
