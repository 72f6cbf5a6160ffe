"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, as in local tests, a new local folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_runs: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables, within the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    return _runs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_tables(spark: SparkSession) -> None:
    """Deletes all tables that the operators saved in this application. Their results must have been read or written by then."""
    if (path := _runs.pop(spark.sparkContext.applicationId, None)) is not None:
        removed(spark, path)


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: later jobs reread the files, so a lost executor costs
    no recomputation and no retried task can see another result. The tables of
    an application are in one folder (``run_dir``), which ``remove_tables``
    deletes when their results have been used.
    """
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: At most so many keys are taken for hot ones, whatever the number of rows.
HOT_KEYS = 10_000
#: Keys with fewer rows are never hot.
FEW = 64


def hot_from(total: int) -> int:
    """Keys with more rows than this are hot; of ``total`` rows at most ``HOT_KEYS`` keys can have so many."""
    return max(FEW, total // HOT_KEYS)


def attached(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``rows`` left joined with ``values`` (one narrow row per key) on ``key``.

    ``hot``: the keys with more than ``hot_from`` rows, of which there are at
    most ``HOT_KEYS``. Their values are broadcast, and their rows, like those
    without a key, are spread over the tasks of the shuffle that joins the rest.
    ``known``: the values of the hot keys, where ``values`` hasn't them.
    """
    names = [c for c in values.columns if c != key]
    if known is None:
        known = values.join(F.broadcast(hot.select(key)), key, "left_semi")
    known = known.select(F.col(key).alias("__hot"), F.struct(*names).alias("__known"))
    found = rows.join(F.broadcast(known), F.col(key) == F.col("__hot"), "left")
    alone = F.col("__hot").isNotNull() | F.col(key).isNull()
    salt = F.when(alone, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))).otherwise(F.lit(0))
    # one struct as the key: a constant of its own on the right side would be folded into a condition on the left
    salted = found.withColumn("__at", F.struct(F.col(key), salt.alias("salt")))
    rest = values.select(F.struct(F.col(key), F.lit(0).cast("bigint").alias("salt")).alias("__at"), F.struct(*names).alias("__rest"))
    joined = salted.join(rest, "__at", "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"__known.{c}"), F.col(f"__rest.{c}")).alias(c) for c in names])


def text_of(col: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; no words: an empty array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda variable stands for the value; a plain column expression would be
    inlined wherever it is used, also inside other lambdas, once per element.
    """
    return F.transform(F.array(value), body)[0]
