"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import ascii_lower, documents


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("__cv_id"), text.alias("__cv_norm")).withColumns({"__cv_hash": F.unhex(F.md5(F.col("__cv_norm").cast("binary")))})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Groups form on (MD5, normalised text), so
    Spark compares the bytes of all texts that share a hash; equal texts collapse within a task before
    anything is shuffled, however many copies there are. Of equal texts the row with the largest
    (`keep="max"`) or smallest (`keep="min"`) id stays.

    Null text counts as empty. A null id never stays while its group has another id; if all are null,
    one of the rows stays. Of repeated rows with the same id and text exactly one stays. An empty
    table gives an empty result; other columns are not read.
    """
    pick = {"max": F.max, "min": F.min}[keep]
    rows = _keyed(docs, id_col, text_col)
    groups = (
        rows.groupBy("__cv_hash", "__cv_norm")
        .agg(pick("__cv_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("__cv_hash", F.sha2(F.col("__cv_norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    ids = rows.select("__cv_id", "__cv_hash", F.sha2(F.col("__cv_norm").cast("binary"), 256).alias("text_sha256")).groupBy("__cv_id", "__cv_hash", "text_sha256").agg(F.count(F.lit(1)).alias("__cv_copies"))
    return (
        ids.join(groups, ["__cv_hash", "text_sha256"])
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__cv_copies"))).alias("__cv_nth"))
        .select(F.col("__cv_id").alias(id_col), "keep_id", "group_size", (F.col("__cv_id").eqNullSafe(F.col("keep_id")) & (F.col("__cv_nth") == 1)).alias("kept"), "text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, one of each group of equal texts, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("__cv_keep"), F.col("text_sha256").alias("__cv_sha"))
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    mine = docs.withColumn("__cv_sha_own", F.sha2(text.cast("binary"), 256))
    found = mine.join(kept, F.col("__cv_sha_own").eqNullSafe(F.col("__cv_sha")) & F.col(id_col).eqNullSafe(F.col("__cv_keep")))
    return found.dropDuplicates(["__cv_sha", "__cv_keep"]).select(*docs.columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
