"""Lineage cuts and checks that several stages share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.schemas import InputError


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the cluster names; only a local master, as in tests, does without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints/corvane")


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """The rows, written as Parquet in the checkpoint folder and read again: packed, and columns can still be pruned.

    With `by`, rows are dealt by these columns and stay so: what joins or groups by them, or by more, deals them no more.
    `dealt`: they have been dealt so, into as many parts.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = uuid.uuid4().hex
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{name}"
    if not by:
        df.write.parquet(path)
        return spark.read.parquet(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(parts, *by)).write.format("parquet").bucketBy(parts, *by).option("path", path).saveAsTable(f"corvane_{name}")
    return spark.table(f"corvane_{name}")


def _repeated(batches: Iterator) -> Iterator:
    """The hashes of a part that stand in it more than once: they are sorted, eight bytes each."""
    import numpy as np
    import pyarrow as pa

    h = np.concatenate([np.empty(0, "int64"), *[b.column(0).to_numpy() for b in batches]])
    h.sort()
    yield pa.RecordBatch.from_pydict({"h": pa.array(np.unique(h[1:][h[1:] == h[:-1]]))})


def refuse_repeated(df: DataFrame, error: type[InputError], code: str, message: str, column: str, many: bool = False) -> None:
    """Raise if a text stands in several rows. Only those whose 64-bit hash repeats are compared whole.

    Of `many` texts the hashes are dealt, packed and sorted: counting them would keep nearly each in a table twice.
    """
    text = df.select(F.col(column).alias("x"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = text.select(F.xxhash64("x").alias("h"))
    again = hashes.repartition(parts, "h").mapInArrow(_repeated, "h long") if many else hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    if not again.isEmpty():
        few = text.withColumn("h", F.xxhash64("x")).join(again, "h", "left_semi")
        refuse(few.groupBy("x").count().where("count > 1"), error, code, message, "x")


def refuse(df: DataFrame, error: type[InputError], code: str, message: str, column: str) -> None:
    """Raise if the table has a row; the first one's column goes into the message."""
    row = df.select(F.col(column).cast("string").alias("x")).orderBy("x").first()
    if row is not None:
        raise error(code, f"{message}: {row['x']}")


def rank_of(column, names) -> Column:
    """Position of a literal name in a fixed order."""
    out = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        out = F.when(column == name, i).otherwise(out)
    return out
