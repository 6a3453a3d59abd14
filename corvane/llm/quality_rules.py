"""Quality rules: base statistics of each document, and robust multivariate outliers.

Everything is DataFrame and SQL functions. The statistics make a vector of transformed numbers; for each
language and source a minimum-covariance-determinant estimate of centre and scatter is sought from several starts:
the coordinates' medians and median deviations, and the moments of small sets of documents chosen by a hash. From
each start concentration steps take the three quarters of the documents nearest to the centre as the next estimate's,
until the determinant of the scatter falls no more; of all starts the estimate with the least determinant counts.
Documents whose Mahalanobis distance under it passes the cut are rejected.

Vectors are held as integers (4096ths), so sums are exact and do not depend on the order of rows. Distances
are counted in narrow bins with their sums; a step needs one pass, and no task ever holds a group's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import checkpointed, content_key, documents

UNIT = 4096
DIMS = 5
#: Deviation added to each coordinate, so that groups without any still have an estimate: a tenth of a text's length,
#: a thirtieth of a word's, and of the shares' roots what one case in a text of a hundred words makes.
FLOORS = (0.1, 0.03, 0.1, 0.1, 0.1)
#: Smallest group that has an estimate of its own; smaller ones are pooled by language, then altogether.
LEAST = 50
#: Steps from each start at most; where the determinant still falls after them, the last estimate counts.
STEPS = 12
#: Sets of documents that are starts beside the medians, and about how many documents each has of a group.
SEEDS, SEED_ROWS = 2, 12
#: Groups up to which their tables (under 300 bytes a row) are sent to all tasks.
MOST_SENT = 20_000
HALF = 0.75
#: Makes the scatter of the nearest three quarters that of the whole, for five normal coordinates.
CONSISTENCY = 1.41
#: Squared distance beyond which a document is rejected (chance 1e-9 for five normal coordinates).
CUT = 52.0

_BLANK = r"[\x20\x09-\x0D]+"


def statistics(docs: DataFrame, text_col: str, carry: list) -> DataFrame:
    """`carry` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("__cv_text"), F.lit(""))
    rows = docs.select(*carry, F.col(text_col).alias("__cv_text")).withColumn("__cv_text", text)
    trimmed = F.btrim(F.col("__cv_text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("__cv_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK)))
    lines = F.filter(F.split(F.col("__cv_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns(
        {
            "n_words": F.size("__cv_words").cast("long"),
            "word_chars": F.length(F.array_join("__cv_words", "")).cast("long"),
            "n_symbols": (F.length("__cv_text") - F.length(F.regexp_replace("__cv_text", r"[#*$%&|<>]", ""))).cast("long"),
            "__cv_lines": lines,
            "__cv_hashes": F.transform("__cv_words", lambda w: F.xxhash64(w)),
        }
    ).drop("__cv_text", "__cv_words")
    rows = rows.withColumns(
        {
            "n_lines": F.size("__cv_lines").cast("long"),
            "n_dup_lines": (F.size("__cv_lines") - F.size(F.array_distinct("__cv_lines"))).cast("long"),
            "__cv_windows": F.when(
                F.col("n_words") >= 8, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 8), lambda i: F.xxhash64(*[F.get("__cv_hashes", i + k) for k in range(8)]))
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("__cv_lines", "__cv_hashes")
    rows = rows.withColumn("__cv_sorted", F.when(F.size(F.array_distinct("__cv_windows")) < F.size("__cv_windows"), F.sort_array(F.transform("__cv_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__cv_windows")
    s = F.col("__cv_sorted")
    same = lambda e, j: F.coalesce(e["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, j + 1)["h"], F.lit(False))
    rows = rows.withColumn("__cv_at", F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))).drop("__cv_sorted")
    at = F.col("__cv_at")
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(8), F.coalesce(F.get(at, j + 1) - p, F.lit(8))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__cv_at")


# SQL that Spark and DuckDB read alike; {rows}, {params} and so on stand for tables. Numbers with an exponent
# are doubles to both.
VECTOR = f"""
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  CAST(floor(ln(1e0 + n_words) * {UNIT} + 0.5) AS BIGINT) AS q1,
  CAST(floor(ln((word_chars + 1e0) / (n_words + 1e0)) * {UNIT} + 0.5) AS BIGINT) AS q2,
  CAST(floor(sqrt(n_symbols / (n_words + 1e0)) * {UNIT} + 0.5) AS BIGINT) AS q3,
  CAST(floor(sqrt(n_dup_lines / (n_lines + 1e0)) * {UNIT} + 0.5) AS BIGINT) AS q4,
  CAST(floor(sqrt(n_repeat_words / (n_words + 1e0)) * {UNIT} + 0.5) AS BIGINT) AS q5
FROM {{rows}}"""
SIZES = "SELECT {key} AS {key}_s, count(*) AS {key}_n FROM {{rows}} WHERE NOT base_failed {where} GROUP BY {key}"
POOL = f"""
SELECT r.*, CASE WHEN coalesce(a.{{key}}_n, 0) >= {LEAST} THEN {{key}} ELSE {{wider}} END AS {{into}}
FROM {{{{rows}}}} r LEFT JOIN {{{{sizes}}}} a ON r.{{key}} = a.{{key}}_s"""


def _median(width: int, value: str) -> str:
    """Per group and coordinate, the lower edge of the median's bin."""
    each = " UNION ALL ".join(f"SELECT grp, {i} AS dim, CAST(floor({value.format(i=i)} / {width}e0) AS BIGINT) AS bin FROM {{rows}}" for i in range(1, DIMS + 1))
    return f"""
SELECT grp AS med_grp, {", ".join(f"min(CASE WHEN dim = {i} THEN bin END) AS b{i}" for i in range(1, DIMS + 1))} FROM (
  SELECT grp, dim, bin, sum(n) OVER (PARTITION BY grp, dim ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY grp, dim) AS every
  FROM (SELECT grp, dim, bin, count(*) AS n FROM ({each}) u GROUP BY grp, dim, bin) c) w
WHERE 2 * upto >= every GROUP BY grp"""


MEDIANS = _median(64, "q{i}")
WITH_MEDIANS = f"SELECT r.*, {', '.join(f'b{i} * 64 + 32 AS c{i}' for i in range(1, DIMS + 1))} FROM {{rows}} r JOIN {{medians}} m ON r.grp = m.med_grp"
DEVIATIONS = _median(16, "abs(q{i} - c{i})")
_LOWER = [(i, j) for i in range(1, DIMS + 1) for j in range(1, i + 1)]
_MEANS = [f"m{i}" for i in range(1, DIMS + 1)]
_ENTRIES = [f"l{i}{j}" for i, j in _LOWER]
#: Vectors of the documents that estimates are made from.
VECTORS = f"SELECT grp, {', '.join(f'q{i}' for i in range(1, DIMS + 1))} FROM {{rows}} WHERE NOT base_failed"
#: More than any determinant: what a start has before its first step.
NO_DET = "1e300"
START = f"""
SELECT m.med_grp AS par_grp, 0 AS seed, {", ".join(f"(m.b{i} * 64 + 32) / {UNIT}e0 AS m{i}" for i in range(1, DIMS + 1))},
  {", ".join(f"sqrt((1.4826e0 * (d.b{i} * 16 + 8) / {UNIT}e0) * (1.4826e0 * (d.b{i} * 16 + 8) / {UNIT}e0) + {FLOORS[i - 1] ** 2!r}e0)" + f" AS l{i}{j}" if i == j else f"CAST(0 AS DOUBLE) AS l{i}{j}" for i, j in _LOWER)}, {NO_DET} AS det
FROM {{medians}} m JOIN {{deviations}} d ON m.med_grp = d.med_grp"""


def _distance() -> list[str]:
    """Select lists, one after the other, that end in d2: forward substitution by the triangular factor."""
    return [f"SELECT *, (q{i} / {UNIT}e0 - m{i}" + "".join(f" - l{i}{j} * y{j}" for j in range(1, i)) + f") / l{i}{i} AS y{i} FROM " for i in range(1, DIMS + 1)]


def _nested(selects: list[str], table: str) -> str:
    for n, s in enumerate(selects):
        table = f"({s}{table}) t{n}"
    return table


_JOINED = "(SELECT * FROM {rows} r LEFT JOIN {params} p ON r.grp = p.par_grp) j"
DISTANCE = f"SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(1, DIMS + 1))} AS d2 FROM {_nested(_distance(), _JOINED)}"
_SUMS = [f"sum(q{i}) AS s{i}" for i in range(1, DIMS + 1)] + [f"sum(q{i} * q{j}) AS s{i}{j}" for i, j in _LOWER]
_ALL_SUMS = [f"s{i}" for i in range(1, DIMS + 1)] + [f"s{i}{j}" for i, j in _LOWER]
_NEAREST = f"""(SELECT *, sum(n) OVER (PARTITION BY grp, seed ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY grp, seed) AS every FROM (
  SELECT grp, seed, bin, count(*) AS n, {", ".join(_SUMS)} FROM (SELECT *, CAST(floor(ln(d2 + 1e-9) * 32) AS BIGINT) AS bin FROM ({DISTANCE}) d WHERE d2 IS NOT NULL) b GROUP BY grp, seed, bin) c) w"""
_TOTALS = f"(SELECT grp AS par_grp, seed, CAST(sum(n) AS DOUBLE) AS n, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in _ALL_SUMS)} FROM {_NEAREST} WHERE before < {HALF}e0 * every GROUP BY grp, seed) t"
#: A hash of the vector that any engine computes alike: remainders of products below 2**53.
_HASHES = [f"SELECT *, (q1 * 48271 + q2 * 16807 + q3 * 69621 + q4 * 39373 + q5 * 30517 + {{k}}) % 2147483647 AS h1 FROM ", "SELECT *, (h1 * 48271 + {k}) % 2147483647 AS h2 FROM ", "SELECT *, (h2 * 69621 + {k}) % 2147483647 AS h3 FROM "]


def _moments(totals: str) -> str:
    return f"(SELECT par_grp, seed, {', '.join(f's{i} / n / {UNIT}e0 AS m{i}' for i in range(1, DIMS + 1))}, {', '.join(f'(s{i}{j} / n - s{i} / n * (s{j} / n)) / {UNIT}e0 / {UNIT}e0 * {CONSISTENCY}e0' + (f' + {FLOORS[i - 1] ** 2!r}e0' if i == j else '') + f' AS v{i}{j}' for i, j in _LOWER)} FROM {totals}) mo"


def _factor() -> list[str]:
    """Cholesky's factor, entry by entry, in column order."""
    out = []
    for j in range(1, DIMS + 1):
        out.append(f"SELECT *, sqrt(v{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j)) + f") AS l{j}{j} FROM ")
        if j < DIMS:
            out.append("SELECT *, " + ", ".join(f"(v{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, DIMS + 1)) + " FROM ")
    return out


def _estimate(totals: str, det: str) -> str:
    """Centre, triangular factor and determinant from sums."""
    return f"SELECT par_grp, seed, {', '.join(_MEANS + _ENTRIES)}, {det} AS det FROM {_nested(_factor(), _moments(totals))}"


_DET = " * ".join(f"l{i}{i} * l{i}{i}" for i in range(1, DIMS + 1))
#: One concentration step of all groups and starts; where the determinant does not fall, the estimate stays.
STEP = f"""SELECT p.par_grp, p.seed, {", ".join(f"CASE WHEN e.det < p.det THEN e.{c} ELSE p.{c} END AS {c}" for c in [*_MEANS, *_ENTRIES, "det"])}, p.det AS former
FROM {{params}} p JOIN ({_estimate(_TOTALS, _DET)}) e ON p.par_grp = e.par_grp AND p.seed = e.seed"""
#: Starts from the documents of a group whose hash falls on SEED_ROWS of as many places as the group has documents.
SEED = " UNION ALL ".join(
    _estimate(
        f"(SELECT grp AS par_grp, {k} AS seed, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'CAST({x} AS DOUBLE) AS {c}' for x, c in zip([x.split(' AS ')[0] for x in _SUMS], _ALL_SUMS, strict=True))} FROM (SELECT * FROM {_nested([h.format(k=k) for h in _HASHES], '{rows}')} JOIN {{sizes}} z ON grp = size_grp WHERE h3 % size < {SEED_ROWS}) chosen{k} GROUP BY grp) t",
        NO_DET,
    )
    for k in range(1, SEEDS + 1)
)
GROUP_SIZES = "SELECT grp AS size_grp, count(*) AS size FROM {rows} GROUP BY grp"
#: Of each group of enough documents the estimate with the least determinant, the first start's where they are equal.
BEST = f"""SELECT par_grp, {", ".join(_MEANS + _ENTRIES)} FROM (SELECT *, row_number() OVER (PARTITION BY par_grp ORDER BY det, seed) AS place FROM {{params}} p JOIN {{sizes}} z ON p.par_grp = z.size_grp) o
WHERE place = 1 AND size >= {LEAST}"""


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, `carry` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, kept, distance.

    Words are `[^\\x20\\x09-\\x0D]+`. base_failed: n_words < 20, or over 30 % of the words stand in 8-word windows
    found twice or more in the text. The vector: log of the words, log of the mean word length, roots of the
    shares of symbols, repeated lines and repeated words. Estimates come from documents that pass the base;
    `distance` is the Mahalanobis distance (null without an estimate) and kept documents pass the base and have
    none beyond the cut. A group has SEEDS + 1 starts, of up to STEPS steps each. Groups of fewer than 50 such documents are pooled by language, and these by all; if
    even that is too small, the base alone decides.

    Null text counts as empty (base_failed); null languages and sources are groups of their own. Repeated
    rows count as often as they stand and get equal verdicts; ids play no part. An empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    own = {c: F.col(c).alias(f"__cv{i}") for i, c in enumerate(carry)}
    carried = [F.col(id_col).alias("__cv_id"), *own.values(), F.concat(name(lang_col), F.lit("\x01"), name(source_col)).alias("g0"), name(lang_col).alias("g1")]
    rows = checkpointed(spark.sql(VECTOR, rows=statistics(docs, text_col, carried)))
    # tables with a row for each group go to all tasks while they are a few MB; beyond that joins deal the rows out
    few = rows.select("g0").distinct().count() <= MOST_SENT
    sent = F.broadcast if few else (lambda t: t)
    sizes = sent(spark.sql(SIZES.format(key="g0", where=""), rows=rows))
    rows = spark.sql(POOL.format(key="g0", wider="concat('lang', r.g1)", into="g2"), rows=rows, sizes=sizes)
    sizes = sent(spark.sql(SIZES.format(key="g2", where="AND g2 <> g0"), rows=rows))
    # a group that has its own estimate is large enough under g2 as well
    rows = checkpointed(spark.sql(POOL.format(key="g2", wider="CASE WHEN g2 = g0 THEN g0 ELSE 'all' END", into="grp"), rows=rows, sizes=sizes))
    vectors = checkpointed(spark.sql(VECTORS, rows=rows))
    sizes = checkpointed(spark.sql(GROUP_SIZES, rows=vectors))
    medians = checkpointed(spark.sql(MEDIANS, rows=vectors))
    deviations = spark.sql(DEVIATIONS, rows=spark.sql(WITH_MEDIANS, rows=vectors, medians=sent(medians)))
    starts = spark.sql(START, medians=medians, deviations=deviations).unionByName(spark.sql(SEED, rows=vectors, sizes=sent(sizes)))
    params = checkpointed(starts)
    for _ in range(STEPS):
        params = checkpointed(spark.sql(STEP, rows=vectors, params=sent(params)))
        if params.where("det < former").isEmpty():
            break
    judged = spark.sql(DISTANCE, rows=rows, params=sent(spark.sql(BEST, params=params, sizes=sizes)))
    return judged.select(
        F.col("__cv_id").alias(id_col),
        *[F.col(f"__cv{i}").alias(c) for i, c in enumerate(carry)],
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed"],
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(True))).alias("kept"),
        F.sqrt("d2").alias("distance"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that quality_rules keeps, with all their columns.

    Verdicts come back by the content they were made from (text, language, source), so rows need no unique id.
    """
    keyed = docs.withColumns({"__cv_key": content_key(lang_col, source_col, text_col), "__cv_key2": content_key(lang_col, source_col, text_col, seed=1)})
    verdicts = quality_rules(keyed, id_col, text_col, lang_col, source_col, carry=("__cv_key", "__cv_key2")).where("kept").select(F.col("__cv_key").alias("__cv_k"), F.col("__cv_key2").alias("__cv_k2")).distinct()
    return keyed.join(verdicts, (F.col("__cv_key") == F.col("__cv_k")) & (F.col("__cv_key2") == F.col("__cv_k2")), "left_semi").select(*docs.columns)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    got = quality_rules(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    parts = [
        ("d", r"SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') || chr(1) || coalesce('=' || source, '') AS g0, coalesce('=' || lang, '') AS g1 FROM documents"),
        ("tok", r"SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d"),
        ("win", "SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM tok)"),
        ("rep", "SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1"),
        ("cov", "SELECT rid, count(DISTINCT i + o) AS n FROM rep, range(0, 8) u(o) GROUP BY rid"),
        ("stats", r"SELECT tok.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM tok LEFT JOIN cov ON tok.rid = cov.rid"),
        ("vec", VECTOR.format(rows="stats")),
        ("z0", SIZES.format(key="g0", where="").format(rows="vec")),
        ("p0", POOL.format(key="g0", wider="concat('lang', r.g1)", into="g2").format(rows="vec", sizes="z0")),
        ("z2", SIZES.format(key="g2", where="AND g2 <> g0").format(rows="p0")),
        ("r", POOL.format(key="g2", wider="CASE WHEN g2 = g0 THEN g0 ELSE 'all' END", into="grp").format(rows="p0", sizes="z2")),
        ("v", VECTORS.format(rows="r")),
        ("z", GROUP_SIZES.format(rows="v")),
        ("med", MEDIANS.format(rows="v")),
        ("wm", WITH_MEDIANS.format(rows="v", medians="med")),
        ("dev", DEVIATIONS.format(rows="wm")),
        ("s0", START.format(medians="med", deviations="dev") + " UNION ALL " + SEED.format(rows="v", sizes="z")),
        *[(f"s{i + 1}", STEP.format(rows="v", params=f"s{i}")) for i in range(STEPS)],
        ("big", BEST.format(params=f"s{STEPS}", sizes="z")),
        ("judged", DISTANCE.format(rows="r", params="big")),
    ]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in parts) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce(d2 <= {CUT}, true)) AS kept FROM judged"


SQL = oracle()
