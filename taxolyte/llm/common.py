"""What the operators of this subpackage share: table access, shared storage and the word rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space characters.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)

_BATCH_BYTES, LEAN = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="taxolyte-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def lean(spark: SparkSession) -> None:
    """From now on Arrow batches of this session are of at most 4 MB, also in what is written after a stage has returned."""
    spark.conf.set(_BATCH_BYTES, LEAN)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most 16 MB meanwhile: a batch is held by the executor and by its Python worker."""
    old = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, LEAN if old == LEAN else "16m")
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES) if old is None else spark.conf.set(_BATCH_BYTES, old)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later steps neither repeat the work
    nor depend on files of one executor."""
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows from which on a key is joined apart from the others, and such keys that may be broadcast.
HOT_ROWS, FEW_HOT = 1024, 100_000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than HOT_ROWS rows."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > HOT_ROWS).select(key)


def join_unique(spark: SparkSession, left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """left, with the columns of right's row for its key; right has one row for each key. how: left, or inner, which leaves out rows without one.

    A key may hold most rows of left: hot are the keys with more than HOT_ROWS; they are broadcast with their rows of right, so theirs
    are not shuffled, nor are null keys. If there are more such keys than FEW_HOT, none of them holds much of so many rows.
    """
    hot = materialize(spark, right.join(hot, key), "hot")
    n = hot.limit(FEW_HOT + 1).count()
    filled = left.filter(F.col(key).isNotNull())
    if 0 < n <= FEW_HOT:
        cold = filled.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key, how)
        out = cold.unionByName(filled.join(F.broadcast(hot), key))
    else:
        out = filled.join(right, key, how)
    if how == "inner":
        return out
    added = (F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key)
    return out.unionByName(left.filter(F.col(key).isNull()).select("*", *added))


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def ascii_lower(text: str) -> str:
    return text.translate(ASCII_LOWER)
