"""A dated lake of day files, and folders of files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, timedelta
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.dates import parsed_time

STOCKS, OPTIONS, DAY_AGGREGATES = "us_stocks_sip", "us_options_opra", "day_aggs_v1"


def day_path(root: str, category: str, day: str, agg_key: str = DAY_AGGREGATES) -> str:
    """``root/category/agg_key/yyyy/mm/yyyy-mm-dd.parquet``."""
    date.fromisoformat(day)
    return f"{root}/{category}/{agg_key}/{day[:4]}/{day[5:7]}/{day}.parquet"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _aside(path: str) -> str:
    """Where the old files of ``path`` are while new ones take their place; Spark passes over such names."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/_replaced-{name}"


def _committed(spark: SparkSession, path: str) -> str | None:
    """Where the files of ``path`` are: there, or aside if a writer was lost between its two renames; None if nowhere."""
    return next((p for p in (path, _aside(path)) if _exists(spark, p)), None)


def read_day(spark: SparkSession, root: str, category: str, day: str, agg_key: str = DAY_AGGREGATES) -> DataFrame:
    """One day's table, read lazily; FileNotFoundError if the day isn't there."""
    path = day_path(root, category, day, agg_key)
    if (found := _committed(spark, path)) is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(found)


def read_stocks_and_options_day(spark: SparkSession, root: str, day: str) -> tuple[DataFrame, DataFrame]:
    return read_day(spark, root, STOCKS, day), read_day(spark, root, OPTIONS, day)


def _rename(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"can't move {old} to {new}")


def _moved(spark: SparkSession, df: DataFrame, by: str, staging: str, target_of) -> None:
    """One write, partitioned by a column of texts; each partition's folder is then renamed to ``target_of`` its value.

    Renaming is one call to the file system per value, no job. Old files are
    renamed aside first and deleted last, so at every moment a reader finds
    either all the old or all the new ones of a value.
    """
    df.write.partitionBy(by).parquet(staging)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.listStatus(path(staging)):
        name = found.getPath().getName()
        if name.startswith(f"{by}="):
            target = path(target_of(unquote(name.partition("=")[2])))
            fs.mkdirs(target.getParent())
            aside = path(_aside(target.toString()))
            if fs.exists(target):
                fs.delete(aside, True)  # of a writer that was lost after its second rename
                _rename(fs, target, aside)
            _rename(fs, found.getPath(), target)
            fs.delete(aside, True)
    fs.delete(path(staging), True)


def write_days(df: DataFrame, root: str, category: str, day: str = "date", agg_key: str = DAY_AGGREGATES) -> None:
    """``df`` as day files of the lake, in one job; days that are there already are replaced."""
    dated = df.withColumn(day, F.date_format(day, "yyyy-MM-dd")).where(F.col(day).isNotNull())
    _moved(df.sparkSession, dated, day, f"{root}/{category}/_staging-{uuid.uuid4().hex}", lambda d: day_path(root, category, d, agg_key))


def write_tickers(df: DataFrame, root: str, folder: str, ticker: str = "ticker") -> None:
    """``df`` as one file per ticker below ``folder`` (``dividends_by_ticker``, ``earnings_by_ticker``), in one job."""
    there = df.where(F.col(ticker).isNotNull())
    _moved(df.sparkSession, there, ticker, f"{root}/_staging-{uuid.uuid4().hex}", lambda t: f"{root}/{folder}/{t}.parquet")


def days(start: str, end: str) -> list[str]:
    """Dates from start to end, both included."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    return [(first + timedelta(n)).isoformat() for n in range((last - first).days + 1)]


def read_days(spark: SparkSession, root: str, category: str, start: str, end: str, agg_key: str = DAY_AGGREGATES, schema: str | None = None, skip_corrupt: bool = False) -> DataFrame:
    """All days of a range that are there, in one scan; missing days are passed over.

    Without any day the table is empty, with the columns of ``schema`` if given.
    """
    paths = [p for d in days(start, end) if (p := _committed(spark, day_path(root, category, d, agg_key)))]
    if not paths:
        return spark.createDataFrame([], schema or "ticker string")
    reader = spark.read.option("ignoreCorruptFiles", skip_corrupt)
    return (reader.schema(schema) if schema else reader).parquet(*paths)


def read_stocks_and_options(spark: SparkSession, root: str, start: str, end: str, stocks: str = STOCKS, options: str = OPTIONS, **how) -> tuple[DataFrame, DataFrame]:
    return read_days(spark, root, stocks, start, end, **how), read_days(spark, root, options, start, end, **how)


def _read_tickers(spark: SparkSession, folder: str, tickers: str | Sequence[str]) -> DataFrame:
    wanted = [tickers] if isinstance(tickers, str) else list(tickers)
    paths = [p for t in wanted if (p := _committed(spark, f"{folder}/{t}.parquet"))]
    if not paths:
        return spark.createDataFrame([], "ticker string")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:_replaced-)?([^/]+)\.parquet(?:/[^/]*)?$", 1)
    return spark.read.option("mergeSchema", True).parquet(*paths).withColumn("ticker", F.url_decode(name))


def read_dividends(spark: SparkSession, root: str, tickers: str | Sequence[str]) -> DataFrame:
    """Dividends of tickers that have a file, with ``ticker``; ``ex_dividend_date`` as a timestamp."""
    df = _read_tickers(spark, f"{root}/dividends_by_ticker", tickers)
    if "ex_dividend_date" not in df.columns:
        return df
    kind = df.schema["ex_dividend_date"].dataType.typeName()
    return df.withColumn("ex_dividend_date", parsed_time(F.col("ex_dividend_date"), kind))


def read_earnings(spark: SparkSession, root: str, tickers: str | Sequence[str]) -> DataFrame:
    """Earnings of tickers that have a file, with ``ticker``."""
    return _read_tickers(spark, f"{root}/earnings_by_ticker", tickers)


def read_tree(spark: SparkSession, root: str, suffix: str, format: str = "parquet", skip_corrupt: bool = True, schema: str | None = None, **options) -> DataFrame:
    """All files below ``root`` that end in ``suffix``, as one table.

    FileNotFoundError if there are none; unreadable files are passed over unless
    ``skip_corrupt`` is false. Without a schema parquet footers are all read to
    find it, as any file may be the unreadable one; pass one for large trees.
    """
    if not _exists(spark, root):
        raise ValueError(f"no such folder: {root}")
    reader = spark.read.format(format).options(**{"recursiveFileLookup": True, "pathGlobFilter": f"*{suffix}", "ignoreCorruptFiles": skip_corrupt, **options})
    if schema:
        reader = reader.schema(schema)
    elif format == "parquet":
        reader = reader.option("mergeSchema", skip_corrupt)
    try:
        df = reader.load(root)
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise FileNotFoundError(f"no *{suffix} below {root}") from e
        raise
    if not df.inputFiles():
        raise FileNotFoundError(f"no *{suffix} below {root}")
    return df


def csv_to_lake(spark: SparkSession, source: str, target: str, suffix: str = ".csv.gz", schema: str | None = None, skip_corrupt: bool = True) -> DataFrame:
    """Compressed CSV files below ``source`` as parquet partitioned by ``date``, which names the file or its folder.

    A gzip file can't be split, so there are as many tasks as files. Without a
    schema it is inferred, which reads the files twice.
    """
    how = {"header": True, "ignoreCorruptFiles": skip_corrupt, "mode": "DROPMALFORMED" if skip_corrupt else "FAILFAST"}
    reader = spark.read.options(recursiveFileLookup=True, pathGlobFilter=f"*{suffix}", **how)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(source)
    dated = df.withColumn("date", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})[^/]*(?:/[^/]*)?$", 1)))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(target)
    return spark.read.parquet(target)


SKIPPED = "path string, reason string"


def skipped_files(spark: SparkSession, roots: str | Sequence[str], suffix: str = ".parquet", schema: str | None = None) -> DataFrame:
    """``path, reason``: the parquet files below ``roots`` that a reader which passes over unreadable ones loses.

    One scan tells which files give a row. Of the others, whose paths reach the
    driver to be read once more, the bytes are looked at: ``no parquet file`` (a
    mark is missing at either end) or ``broken`` (it has both and can't be read).
    A whole file of no rows is not lost; files without a byte Spark doesn't list.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    how = {"recursiveFileLookup": True, "pathGlobFilter": f"*{suffix}"}
    listed = spark.read.format("binaryFile").options(**how).load(roots).select(plain(F.col("path")).alias("path"))
    reader = spark.read.options(**how, ignoreCorruptFiles=True, mergeSchema=schema is None)
    try:
        found = (reader.schema(schema) if schema else reader).parquet(*roots)
        read = found.select(plain(F.url_decode("_metadata.file_path")).alias("path")).distinct()
        listed = listed.join(read, "path", "left_anti")
    except AnalysisException as e:  # not one file with a schema
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    if not (lost := [r.path for r in listed.collect()]):
        return spark.createDataFrame([], SKIPPED)
    mark = F.lit(bytearray(b"PAR1"))
    whole = (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)
    reason = F.when(whole, "broken").otherwise("no parquet file")
    told = {r.path: r.reason for r in spark.read.format("binaryFile").load(lost).select(plain(F.col("path")).alias("path"), reason.alias("reason")).collect()}
    broken = _broken(spark, [p for p, r in told.items() if r == "broken"])
    return spark.createDataFrame([(p, r) for p, r in told.items() if r != "broken" or p in broken], SKIPPED)


def _broken(spark: SparkSession, paths: list[str]) -> set[str]:
    """Which of some parquet files can't be read, by halves."""
    if not paths:
        return set()
    try:
        spark.read.option("mergeSchema", True).parquet(*paths).write.format("noop").mode("append").save()
        return set()
    except Exception:  # whatever a reader says of a broken file
        if len(paths) == 1:
            return set(paths)
        half = len(paths) // 2
        return _broken(spark, paths[:half]) | _broken(spark, paths[half:])


def _size(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def skipped_days(spark: SparkSession, root: str, category: str, start: str, end: str, agg_key: str = DAY_AGGREGATES, schema: str | None = None) -> DataFrame:
    """``day, path, reason``: what ``read_days`` passes over in a range, days without files and files without readable rows."""
    paths = {d: day_path(root, category, d, agg_key) for d in days(start, end)}
    there = {d: found for d, p in paths.items() if (found := _committed(spark, p))}
    empty = {d for d, p in there.items() if _size(spark, p) == 0}
    told = [(d, p, "missing") for d, p in paths.items() if d not in there] + [(d, there[d], "empty file") for d in sorted(empty)]
    missing = spark.createDataFrame(told, "day string, path string, reason string")
    if not there:
        return missing
    lost = skipped_files(spark, list(there.values()), "", schema)
    return missing.unionByName(lost.select(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.parquet", 1).alias("day"), "path", "reason"))


def malformed(spark: SparkSession, source: str, schema: str, suffix: str = ".csv.gz") -> DataFrame:
    """``path, line``: the lines of CSV files that ``csv_to_lake`` drops because they don't fit ``schema``."""
    bad = "__line"
    how = {"recursiveFileLookup": True, "pathGlobFilter": f"*{suffix}", "header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "ignoreCorruptFiles": True}
    found = spark.read.options(**how).schema(f"{schema}, {bad} string").csv(source)
    # a condition on all columns, which always holds: of a line that is parsed in part only, Spark doesn't see the fault
    every = F.hash(*[c for c in found.columns if c != bad]) >= -(2**31)
    return found.where(F.col(bad).isNotNull() & every).select(F.col("_metadata.file_path").alias("path"), F.col(bad).alias("line"))
