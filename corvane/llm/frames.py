"""Small helpers that the operators share: tables, paths, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds as one piece of numpy work. One longer text makes a piece of its own.
PIECE_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names; only a local master (tests) does without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints/corvane")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, with their lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession) -> str:
    """A new place for a table in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def remove_table(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def rewritten(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared checkpoint folder and read again: columns can still be pruned.

    The table goes with the folder: what is made of it may be read at any time.
    """
    spark = df.sparkSession
    path = table_path(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def ascii_lower(text):
    """A-Z to a-z and nothing else; the quick way where the text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_key(*columns: str, seed: int = 0):
    """64 bits from the columns' values, in their order. Spark's hash skips a null; here it counts as a value of its own."""
    parts = [p for c in columns for p in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.xxhash64(F.lit(seed), *parts)


def pieces(batches: Iterator[pa.RecordBatch], text_index: int = 1, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that each holds about `limit` bytes of text, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(text_index).cast(pa.binary()).to_pylist()] if batch.num_rows else []
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


#: Rows and bytes of an Arrow batch, so that a run of very long texts does not fill a task's memory at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_ROWS and BATCH_BYTES; Spark has no setting for a single operator."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        value = re.fullmatch(r"(\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}").lower())
        if value is None or not 0 < int(value[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def give_back() -> None:
    """Hands the memory that a task's arrays have left free back to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch | None], schema: str, text_index: int = 1, limit: int = PIECE_BYTES, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over pieces: fn sees a slice of the batch and its texts and returns a batch, or None.

    `after` is called when a task has seen its last piece.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text_index, limit):
            out = fn(batch, texts)
            if out is not None and out.num_rows:
                yield out
        if after is not None:
            after()
        give_back()

    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, rows: int, total: int, *keys: str) -> DataFrame:
    """About `rows` of the `total` rows (all, if fewer), by a hash of the keys; equal input, equal sample.

    Each task returns its share only, so what reaches the driver does not grow with the tasks. Keys that
    hold equal values on many rows could bring them all in; twice `rows` is never passed.
    """
    level = min(1.0, rows / max(total, 1))
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(level * (1 << 30))).limit(2 * rows)


#: A key with over one in this many of all rows is a hot one; there are fewer of these than this.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, table_key: str, count: str) -> DataFrame:
    """Equi-join with a table of one row a key that says how many rows each key has.

    Hot keys (over a thousandth of all rows each, so fewer than a thousand) are sent to all tasks, and their rows
    stay where they are; the others are dealt out. Both tables are read more than once: checkpoint them first.
    """
    total = table.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    sent = F.broadcast(table.where(hot))
    on = F.col(key) == F.col(table_key)
    cold = rows.join(F.broadcast(table.where(hot).select(F.col(table_key).alias("__cv_hot"))), F.col(key) == F.col("__cv_hot"), "left_anti")
    return rows.join(sent, on).unionByName(cold.join(table.where(~hot), on))
