"""Line dedup by distinct-site spread: HyperLogLog sketches of sites per line hash.

Each line's sites go into a HyperLogLog sketch; sketches merge by aggregation, a partial one in each task
first, so a line on a third of all pages costs a sketch a task. Lines whose estimate is clearly below
the threshold are no boilerplate, clearly above it they are, and those near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import checkpointed, documents

#: log2 of a sketch's registers: 1.04 / sqrt(2**12) is a standard error of 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold count as near: six standard errors.
NEAR = 0.1
#: Wide lines (16 bytes each) that are sent to all tasks.
MOST_SENT = 200_000


def _lines(docs: DataFrame, key_cols: list, text_col: str, site_col: str) -> DataFrame:
    """A row for each line with a word: key columns, line number, line hash, site."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    exploded = docs.select(*key_cols, F.col(site_col).cast("string").alias("__cv_site"), F.posexplode(lines).alias("__cv_no", "__cv_line"))
    return exploded.where(F.col("__cv_line").rlike(r"[^\x20\x09-\x0D]")).select("*", F.struct(F.xxhash64("__cv_line").alias("a"), F.xxhash64(F.lit(1), "__cv_line").alias("b")).alias("__cv_hash")).drop("__cv_line")


def wide_lines(lines: DataFrame, threshold: int) -> DataFrame:
    """__cv_wide: hashes of lines that stand on at least `threshold` distinct sites."""
    sites = lines.where(F.col("__cv_site").isNotNull())
    sketched = sites.groupBy("__cv_hash").agg(F.hll_sketch_agg("__cv_site", LG_K).alias("s")).select("__cv_hash", F.hll_sketch_estimate("s").alias("n"))
    spread = checkpointed(sketched.where(F.col("n") >= threshold * (1 - NEAR)))
    near = spread.where(F.col("n") <= threshold * (1 + NEAR)).select(F.col("__cv_hash").alias("__cv_near"))
    on = F.col("__cv_hash") == F.col("__cv_near")
    pairs = sites.select("__cv_hash", "__cv_site")
    # a few MB of hashes go to all tasks; beyond that each task makes its pairs distinct before they are dealt out by line
    pairs = pairs.join(F.broadcast(near), on, "left_semi").distinct() if near.count() <= MOST_SENT else pairs.distinct().join(near, on, "left_semi")
    exact = pairs.groupBy("__cv_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
    return spread.where(F.col("n") > threshold * (1 + NEAR)).select("__cv_hash").unionByName(exact.select("__cv_hash")).withColumnRenamed("__cv_hash", "__cv_wide")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", threshold: int = 3) -> DataFrame:
    """One row per document: id, n_lines, n_removed, kept_text.

    Lines are the \\n-split parts of a text that have a word (`[^\\x20\\x09-\\x0D]`), compared as they stand. A
    line found on at least `threshold` distinct sites is removed from every document. kept_text is the
    text's other lines, blank ones included, joined by \\n; n_lines and n_removed count lines with a word.

    Null text counts as empty. Rows with a null site count for no line's spread, but lose wide lines too.
    Repeated rows change no spread and get equal results, one row each. Other columns are not read; an empty
    table gives an empty result. Lines are told apart by two 64-bit hashes.
    """
    key = [F.xxhash64(F.col(text_col)).alias("__cv_key"), F.xxhash64(F.lit(1), F.col(text_col)).alias("__cv_key2")]
    lines = _lines(docs, key, text_col, site_col)
    wide = checkpointed(wide_lines(lines, threshold))
    # a few MB of hashes go to all tasks, so that a line on a third of all pages is dealt to none; beyond that a shuffle
    sent = F.broadcast(wide) if wide.count() <= MOST_SENT else wide
    hits = lines.join(sent, F.col("__cv_hash") == F.col("__cv_wide"), "left_semi")
    # equal texts lose the same lines: one set of line numbers for each text, however many copies it has
    removed = hits.groupBy("__cv_key", "__cv_key2").agg(F.collect_set("__cv_no").alias("__cv_gone")).select(F.col("__cv_key").alias("__cv_k"), F.col("__cv_key2").alias("__cv_k2"), "__cv_gone")
    # read back from a table, both sides of the join below are plain shuffles, of which Spark splits the partition of a text with very many copies
    removed = checkpointed(removed)
    rows = docs.select(F.col(id_col).alias("__cv_id"), F.col(text_col).alias("__cv_text"), *key)
    joined = rows.join(removed, (F.col("__cv_key") == F.col("__cv_k")) & (F.col("__cv_key2") == F.col("__cv_k2")), "left")
    joined = joined.withColumns({"__cv_parts": F.split(F.coalesce(F.col("__cv_text"), F.lit("")), "\n"), "__cv_gone": F.coalesce("__cv_gone", F.array().cast("array<int>"))})
    # a set difference of line numbers: linear in the lines of a text
    left = joined.withColumn("__cv_left", F.when(F.size("__cv_gone") > 0, F.array_except(F.sequence(F.lit(0), F.size("__cv_parts") - 1), "__cv_gone")))
    kept = F.when(F.col("__cv_left").isNull(), F.coalesce(F.col("__cv_text"), F.lit(""))).otherwise(F.array_join(F.transform("__cv_left", lambda i: F.get("__cv_parts", i)), "\n"))
    return left.select(
        F.col("__cv_id").alias(id_col),
        F.size(F.filter("__cv_parts", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"),
        F.size("__cv_gone").cast("long").alias("n_removed"),
        kept.alias("kept_text"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    got = line_dedup(documents(spark, sf_dir))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, source, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS no FROM d),
wide AS (SELECT x FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY x HAVING count(DISTINCT source) >= 3),
m AS (SELECT l.*, wide.x IS NOT NULL AS gone FROM l LEFT JOIN wide ON l.x = wide.x),
a AS (SELECT rid, count(*) FILTER (regexp_matches(x, '[^\x20\x09-\x0D]')) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM d JOIN a ON d.rid = a.rid
"""
