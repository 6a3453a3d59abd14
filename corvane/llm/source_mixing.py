"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A node's budget is shared among its children by weight; a child
that cannot use its share (it has too few tokens for the epochs allowed) leaves the rest to its siblings,
and only what all children of a node cannot use goes back to the node's own siblings. Each leaf then reads
its documents in seeded epochs: whole epochs as often as its budget holds them, and of one more epoch the
prefix that fits. An epoch's order is that of a hash of seed, epoch and id, so the prefix is a cut in the
hash; the cut is found by summing tokens in 4096 ranges of the hash and then within one of them.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.frames import checkpointed, documents

#: Up to so many leaves the tree is held on the driver; beyond, its last level is shared out in Spark.
MOST_LEAVES = 200_000
#: Leaves up to which their budgets and cuts (some 150 bytes each) are sent to all tasks; beyond, a join deals the rows out.
MOST_SENT = 50_000
DOMAINS = ("web", "books", "forum")
WEIGHTS = {"domain": {"web": 0.5, "books": 0.3, "forum": 0.2}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "source": {}}


def share(budget: int, children: list[tuple[Fraction, int]]) -> list[int]:
    """The budget by weight, none above its capacity; what one cannot use goes to the others.

    Sums to the budget, or to all capacities if they are less. Fractions of a token go to the largest
    remainders, the first child first.
    """
    out = [0] * len(children)
    budget = min(budget, sum(c for _, c in children))
    active = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = Fraction(budget)
    while active:
        total = sum(children[i][0] for i in active)
        full = [i for i in active if children[i][1] <= left * children[i][0] / total]
        if not full:
            parts = {i: left * children[i][0] / total for i in active}
            for i, p in parts.items():
                out[i] = int(p)
            rest = int(left) - sum(out[i] for i in active)
            for i in sorted(active, key=lambda i: (out[i] - parts[i], i))[:rest]:
                out[i] += 1
            break
        for i in full:
            out[i] = children[i][1]
            left -= children[i][1]
            active.remove(i)
    return out


def allot(leaves: dict[tuple[str, str, str], int], budget: int, weights: dict[str, dict[str, float]], epochs: int) -> dict[tuple[str, str, str], int]:
    """Each leaf's budget in tokens; `leaves` holds the tokens there are. A name without a weight weighs 1, in its level."""
    levels = ("domain", "lang", "source")

    def down(prefix: tuple[str, ...], mine: list[tuple[str, str, str]], amount: int) -> dict:
        depth = len(prefix)
        if depth == 3:
            return {mine[0]: amount}
        kids: dict[str, list] = {}
        for leaf in mine:
            kids.setdefault(leaf[depth], []).append(leaf)
        names = sorted(kids)
        usable = [(Fraction(str(weights.get(levels[depth], {}).get(n.removeprefix("="), 1.0))), sum(leaves[x] for x in kids[n]) * epochs) for n in names]
        out = {}
        for n, part in zip(names, share(amount, usable), strict=True):
            out |= down((*prefix, n), kids[n], part)
        return out

    return down((), sorted(leaves), budget) if leaves else {}


def leaf_budgets(sums: DataFrame, weights: dict[str, dict[str, float]], budget_share: Fraction, epochs: int, few: bool) -> DataFrame:
    """Leaves (domain, language, source, n tokens) with their budgets, by the driver where there are few, else their last level in Spark."""
    spark, on = sums.sparkSession, ["__cv_d", "__cv_l", "__cv_s"]
    if few:
        there = {(r["__cv_d"], r["__cv_l"], r["__cv_s"]): r["n"] for r in sums.collect()}
        shares = allot(there, int(budget_share * sum(there.values())), weights, epochs)
        return spark.createDataFrame([(*x, there[x], b) for x, b in shares.items()], "__cv_d string, __cv_l string, __cv_s string, n long, budget long")
    upper = sums.groupBy("__cv_d", "__cv_l").agg(F.sum("n").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(upper) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} domains and languages")
    there = {(r["__cv_d"], r["__cv_l"], ""): r["n"] for r in upper}
    shares = allot(there, int(budget_share * sum(there.values())), weights, epochs)
    budgets = F.broadcast(spark.createDataFrame([(d, lang, b) for (d, lang, _), b in shares.items()], "__cv_d string, __cv_l string, b long"))
    # whole weights, so that shares are compared without rounding
    given = {f"={n}": Fraction(str(w)) for n, w in weights.get("source", {}).items()}
    scale = lcm(*[w.denominator for w in given.values()])
    whole = {n: int(w * scale) for n, w in given.items()}
    every = lcm(scale, *[w for w in whole.values() if w])
    weight = F.lit(scale)
    for n, w in whole.items():
        weight = F.when(F.col("__cv_s") == n, w).otherwise(weight)
    big = lambda c: c.cast("decimal(38,0)")
    node = Window.partitionBy("__cv_d", "__cv_l")
    rows = sums.join(budgets, ["__cv_d", "__cv_l"]).withColumns({"w": weight, "cap": F.col("n") * epochs})
    rows = rows.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).withColumn("fills", big(F.col("cap")) * F.when(F.col("w") > 0, F.lit(every) / F.col("w")).otherwise(0).cast("long"))
    by = node.orderBy("fills", "__cv_s")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({"b": F.least(F.col("b"), F.sum("cap").over(node)), "below": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.sum("w").over(after)})
    # a leaf is full if it and all that fill up sooner have no more than their share of what is left then
    early = big(F.col("cap")) * big(F.col("w_left")) <= big(F.col("b") - F.col("below")) * big(F.col("w"))
    rows = rows.withColumn("early", early).withColumn("full", F.min("early").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"spare": F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(node), "w_open": F.greatest(F.lit(1), F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(node))})
    product = big(F.col("spare")) * big(F.col("w"))
    rows = rows.withColumns({"part": F.when(F.col("full"), 0).otherwise(F.floor(product / big(F.col("w_open"))).cast("long")), "over": (product % big(F.col("w_open")))})
    rows = rows.withColumns({"rest": F.col("spare") - F.sum("part").over(node), "nth": F.row_number().over(Window.partitionBy("__cv_d", "__cv_l", "full").orderBy(F.desc("over"), "__cv_s"))})
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.col("part") + (F.col("nth") <= F.col("rest")).cast("long"))
    return checkpointed(rows.select(*on, "n", share.cast("long").alias("budget")))


def default_domain(source_col: str) -> Column:
    """One of DOMAINS by a hash of the source, where a corpus has no domains of its own."""
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(source_col).cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % len(DOMAINS)
    return F.element_at(F.array(*map(F.lit, DOMAINS)), place + 1)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Column | None = None,
    weights: dict[str, dict[str, float]] | None = None,
    budget_share: float = 0.6,
    epochs: int = 4,
    seed: int = 17,
    keep_columns: bool = False,
) -> DataFrame:
    """One row per document: id (or all columns of `docs` with `keep_columns`), __cv_domain, __cv_tokens, __cv_budget (of its leaf), __cv_copies.

    Tokens are words `[^\\x20\\x09-\\x0D]+`. The whole budget is `budget_share` of all tokens; a leaf (domain,
    language, source) is read at most `epochs` times. `copies` says how often a document is read. The
    tokens read of a leaf never pass its budget, and fall short of it by less than the next document.

    Null text counts as empty (no tokens); null languages and sources are leaves of their own. Rows of a
    leaf with the same id stand at one place of the order and are taken or left together. Empty texts go with
    their place. An empty table gives an empty result. Columns of other names are not read.
    """
    weights = WEIGHTS if weights is None else weights
    spark = docs.sparkSession
    domain = default_domain(source_col) if domain is None else domain
    trimmed = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    tokens = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    leaf = [name(domain).alias("__cv_d"), name(F.col(lang_col)).alias("__cv_l"), name(F.col(source_col)).alias("__cv_s")]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__cv_i")
    # the text is read once for its tokens and once more where it is carried along
    rows = checkpointed(docs.select(F.col(id_col).alias("__cv_id"), key, *leaf, tokens.alias("__cv_n")))
    on = ["__cv_d", "__cv_l", "__cv_s"]
    sums = checkpointed(rows.groupBy(*on).agg(F.sum("__cv_n").alias("n")))
    n_leaves = sums.count()
    # a row is some 150 bytes: up to MOST_SENT of them go to all tasks, so that no leaf's texts are dealt to one
    sent = F.broadcast if n_leaves <= MOST_SENT else (lambda t: t)
    budgets = leaf_budgets(sums, weights, Fraction(str(budget_share)), epochs, n_leaves <= MOST_LEAVES)
    has = F.col("n") > 0
    leaves = budgets.select(*on, F.col("budget").alias("__cv_budget"), F.when(has, F.expr("budget div n")).otherwise(0).alias("__cv_whole"), F.when(has, F.expr("budget % n")).otherwise(0).alias("__cv_rest"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__cv_whole").cast("string"), F.col("__cv_i")).cast("binary"))
    placed = rows.join(sent(leaves), on).withColumn("__cv_h", order).withColumn("__cv_b", F.substring("__cv_h", 1, 3))
    upto = Window.partitionBy(*on).orderBy("__cv_b")
    ranges = placed.groupBy(*on, "__cv_rest", "__cv_b").agg(F.sum("__cv_n").alias("n")).withColumn("upto", F.sum("n").over(upto))
    edge = ranges.where((F.col("upto") > F.col("__cv_rest")) & (F.col("upto") - F.col("n") <= F.col("__cv_rest"))).select(*on, "__cv_b", (F.col("__cv_rest") - (F.col("upto") - F.col("n"))).alias("__cv_more"))
    within = Window.partitionBy(*on).orderBy("__cv_h")
    last = (
        placed.drop("__cv_rest").join(edge, [*on, "__cv_b"]).groupBy(*on, "__cv_b", "__cv_more", "__cv_h").agg(F.sum("__cv_n").alias("n"))
        .withColumn("upto", F.sum("n").over(within))
        .groupBy(*on, "__cv_b").agg(F.max(F.when(F.col("upto") <= F.col("__cv_more"), F.col("__cv_h"))).alias("h"))
        .select(*on, F.coalesce("h", "__cv_b").alias("__cv_cut"))
    )
    cuts = checkpointed(leaves.join(last, on, "left"))
    source = docs.select(*([F.col(c) for c in docs.columns] if keep_columns else [F.col(id_col)]), key, *leaf, tokens.alias("__cv_n")) if keep_columns else rows
    done = source.join(sent(cuts), on)
    copies = F.col("__cv_whole") + F.when(order <= F.col("__cv_cut"), 1).otherwise(0)
    first = [F.col(c) for c in docs.columns] if keep_columns else [F.col("__cv_id").alias(id_col)]
    return done.select(*first, F.expr("nullif(substr(__cv_d, 2), '')").alias("__cv_domain"), F.col("__cv_n").alias("__cv_tokens"), "__cv_budget", copies.cast("long").alias("__cv_copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all columns of `docs`, each as often as it is read."""
    mixed = mix_sources(docs, keep_columns=True, **options)
    return mixed.where("__cv_copies > 0").withColumn("__cv_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__cv_copies")))).select(*docs.columns)


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    got = mix_sources(documents(spark, sf_dir))
    return got.select("doc_id", F.col("__cv_domain").alias("domain"), F.col("__cv_tokens").alias("n_tokens"), F.col("__cv_budget").alias("leaf_budget"), F.col("__cv_copies").alias("copies"))


def _level(source: str, parent: str, name: str, weight: str) -> str:
    """SQL of one level: each child's share of its parent's budget `b`; needs `cap` and the columns named.

    Weights are tenths as integers, so that shares are compared without rounding; 60 is divisible by all of them.
    A child is full if it and all that fill up sooner have no more than their share of what is left then.
    """
    return f"""
SELECT * EXCLUDE (full1, below, w_left, early, spare, w_open, part, rest, nth), CASE WHEN full1 THEN cap ELSE part + CASE WHEN nth <= rest THEN 1 ELSE 0 END END AS share FROM (
  SELECT *, CAST(spare - sum(CASE WHEN full1 THEN 0 ELSE part END) OVER (PARTITION BY {parent}) AS HUGEINT) AS rest, row_number() OVER (PARTITION BY {parent}, full1 ORDER BY (spare * w) % w_open DESC, {name}) AS nth FROM (
    SELECT *, CASE WHEN full1 THEN 0 ELSE (spare * w) // w_open END AS part FROM (
      SELECT *, CAST(b0 - sum(CASE WHEN full1 THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS HUGEINT) AS spare, CAST(greatest(1, sum(CASE WHEN full1 THEN 0 ELSE w END) OVER (PARTITION BY {parent})) AS HUGEINT) AS w_open FROM (
        SELECT *, bool_and(early) OVER (PARTITION BY {parent} ORDER BY cap * 60 // w, {name} ROWS UNBOUNDED PRECEDING) AS full1 FROM (
          SELECT *, cap * w_left <= (b0 - below) * w AS early FROM (
            SELECT *, CAST(least(b, sum(cap) OVER (PARTITION BY {parent})) AS HUGEINT) AS b0, CAST(coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap * 60 // w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS below,
              CAST(sum(w) OVER (PARTITION BY {parent} ORDER BY cap * 60 // w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS w_left
            FROM (SELECT *, CAST({weight} AS HUGEINT) AS w FROM {source})))))))"""


def _weights(column: str, level: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '={n}' THEN {int(Fraction(str(w)) * 10)}" for n, w in WEIGHTS[level].items()) + " ELSE 10 END" if WEIGHTS[level] else "10"


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS i, '=' || [{", ".join(f"'{x}'" for x in DOMAINS)}][CAST('0x' || substr(md5(coalesce(source, '')), 1, 4) AS INT) % {len(DOMAINS)} + 1] AS d, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS HUGEINT) AS n FROM documents),
leaf AS (SELECT d, l, s, CAST(sum(n) AS HUGEINT) AS a, CAST(sum(n) * 4 AS HUGEINT) AS cap FROM t GROUP BY ALL),
dom AS (SELECT d, CAST(sum(cap) AS HUGEINT) AS cap, (SELECT CAST(sum(a) AS HUGEINT) * 6 // 10 FROM leaf) AS b, 0 AS top FROM leaf GROUP BY d),
dom_share AS ({_level("dom", "top", "d", _weights("d", "domain"))}),
lan AS (SELECT leaf.d, l, CAST(sum(leaf.cap) AS HUGEINT) AS cap, CAST(any_value(share) AS HUGEINT) AS b FROM leaf JOIN dom_share ON leaf.d = dom_share.d GROUP BY leaf.d, l),
lan_share AS ({_level("lan", "d", "l", _weights("l", "lang"))}),
src AS (SELECT leaf.d, leaf.l, s, a, leaf.cap, CAST(share AS HUGEINT) AS b FROM leaf JOIN lan_share ON leaf.d = lan_share.d AND leaf.l = lan_share.l),
src_share AS ({_level("src", "d, l", "s", _weights("s", "source"))}),
plan AS (SELECT d, l, s, CAST(share AS BIGINT) AS share, CASE WHEN a = 0 THEN 0 ELSE CAST(share AS HUGEINT) // a END AS whole, CASE WHEN a = 0 THEN 0 ELSE CAST(share AS HUGEINT) % a END AS rest, a FROM src_share),
placed AS (SELECT t.*, share, whole, rest, a, md5('17:' || CAST(whole AS VARCHAR) || ':' || i) AS h FROM t JOIN plan ON t.d = plan.d AND t.l = plan.l AND t.s = plan.s)
SELECT doc_id, substr(d, 2) AS domain, CAST(n AS BIGINT) AS n_tokens, share AS leaf_budget,
  CAST(whole + CASE WHEN a > 0 AND sum(n) OVER (PARTITION BY d, l, s ORDER BY h RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM placed
"""
