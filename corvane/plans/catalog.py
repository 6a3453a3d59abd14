"""Queries on the star-schema tables, each with the same operators that the repository path uses, and their SQL.

The tables stand for a repository: nations are projects, customers and suppliers files, orders symbols; a
customer depends on a supplier it bought from.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import files as fl
from corvane.functions.ids import knowledge_id
from corvane.functions.paths import ancestors, dirname
from corvane.functions.tables import checkpointed
from corvane.operators import context, explore, graph, resolve
from corvane.operators.cycles import elementary_cycles
from corvane.operators.knowledge import folder_closure, group_dependencies, project_membership, relation_rows
from corvane.plans import repository, shop, tree  # noqa: F401  (the tree adds its queries to the shop's)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# files -------------------------------------------------------------------------------------------------------------

PATHS = "concat(source, '/', lang, '/', CASE WHEN doc_id % 7 = 0 THEN 'node_modules/' WHEN doc_id % 11 = 0 THEN 'notes/' ELSE '' END, CAST(doc_id AS {text}), CASE doc_id % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.spec.tsx' WHEN 2 THEN '.PY' WHEN 3 THEN '' WHEN 4 THEN '.json' ELSE '.d.md' END)"
_PATHS_SQL = PATHS.format(text="VARCHAR")


def doc_paths(spark, d):
    return t(spark, d, "documents").withColumn("path", F.expr(PATHS.format(text="STRING")))


_EXT_SQL = "lower(regexp_extract(path, '.+(\\.[^./]*)$', 1))"
_LANG_SQL = "CASE nullif(" + _EXT_SQL + ", '') WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TSX' WHEN '.py' THEN 'Python' WHEN '.json' THEN 'JSON' WHEN '.md' THEN 'Markdown' ELSE 'Unknown' END"


@query(f"SELECT sha256(path) AS id, path, nullif({_EXT_SQL}, '') AS extension, {_LANG_SQL} AS language, sha256(coalesce(text, '')) AS content_hash FROM (SELECT *, {_PATHS_SQL} AS path FROM documents)")
def file_ids(spark, d):
    rows = doc_paths(spark, d).withColumn("extension", fl.extension("path"))
    return rows.select(F.sha2(F.col("path").cast("binary"), 256).alias("id"), "path", "extension", fl.language("extension").alias("language"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def content_hash_dups(spark, d):
    rows = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_CONTROL_SQL = "len(list_filter(regexp_extract_all(left(hex(encode(html)), 16384), '..'), lambda x: x < '20' AND x NOT IN ('09', '0A', '0C', '0D')))"


@query(f"SELECT page_id, ({_CONTROL_SQL} > 0.3 * least(8192, octet_length(encode(html))) AND html <> '') OR list_contains(regexp_extract_all(left(hex(encode(html)), 16384), '..'), '00') AS binary_content FROM pages")
def binary_filter(spark, d):
    return t(spark, d, "pages").select("page_id", fl.is_binary(F.col("html").cast("binary")).alias("binary_content"))


_NAMES_SQL = "'.DS_Store', '.cache', '.env', '.git', '.next', '.nx', 'DS_Store', 'build', 'coverage', 'dist', 'node_modules', '.corvane'"


@query(f"SELECT doc_id, path, list_has_any(string_split(path, '/'), [{_NAMES_SQL}]) AS ignored FROM (SELECT *, {_PATHS_SQL} AS path FROM documents)")
def hard_ignores(spark, d):
    return doc_paths(spark, d).select("doc_id", "path", fl.hard_ignored("path").alias("ignored"))


IGNORE_TEXT = "*.py\n# comment\nnotes/**\n!src3/**/*.md\nsrc1*/**/*.json\n!*1*.json\n/src5/en/*.ts\n"
_RULES_SQL = "(0, '(^|/)[^/]*\\.py$', false), (1, '^notes/.*$', false), (2, '^src3/(.*/)?[^/]*\\.md$', true), (3, '^src1[^/]*/(.*/)?[^/]*\\.json$', false), (4, '(^|/)[^/]*1[^/]*\\.json$', true), (5, '^src5/en/[^/]*\\.ts$', false)"


@query(f"WITH p AS (SELECT doc_id, {_PATHS_SQL} AS path FROM documents), r(ord, re, neg) AS (VALUES {_RULES_SQL}) SELECT doc_id, path, coalesce(NOT arg_max(neg, ord), false) AS ignored FROM p LEFT JOIN r ON regexp_matches(path, re) GROUP BY ALL")
def ignore_rules_last_match(spark, d):
    return doc_paths(spark, d).select("doc_id", "path", fl.ignored_by("path", False, fl.ignore_rules(IGNORE_TEXT)).alias("ignored"))


@query("WITH p AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM pages) SELECT nullif(CASE WHEN regexp_extract(path, '([^/]*)/*$', 1) = '..' THEN '' ELSE lower(regexp_extract(regexp_extract(path, '([^/]*)/*$', 1), '^.+(\\.[^.]*)$', 1)) END, '') AS extension, count(*) AS pages FROM p GROUP BY 1")
def url_extension(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    return t(spark, d, "pages").groupBy(fl.extension(path).alias("extension")).agg(F.count(F.lit(1)).alias("pages"))


PATTERNS = ["src1/*/*", "src2/**", "*/en/*.ts", "src*/d?/*"]
_PATTERNS_SQL = "('src1/*/*', '^src1/[^/]*/[^/]*$'), ('src2/**', '^src2/.*$'), ('*/en/*.ts', '^[^/]*/en/[^/]*\\.ts$'), ('src*/d?/*', '^src[^/]*/d\\?/[^/]*$')"


@query(f"WITH p AS (SELECT {_PATHS_SQL} AS path FROM documents), r(pattern, re) AS (VALUES {_PATTERNS_SQL}) SELECT pattern, count(path) AS matches FROM r LEFT JOIN p ON regexp_matches(path, re) GROUP BY pattern")
def workspace_glob_match(spark, d):
    one = doc_paths(spark, d).agg(*[F.count_if(F.col("path").rlike(fl.workspace_regex(p))).alias(f"m{i}") for i, p in enumerate(PATTERNS)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"m{i}").alias("matches")) for i, p in enumerate(PATTERNS)])).alias("r")).select("r.*")


@query(f"WITH p AS (SELECT {_PATHS_SQL} AS path FROM documents) SELECT {_LANG_SQL} AS language, count(*) AS files FROM p GROUP BY 1")
def language_histogram(spark, d):
    files = doc_paths(spark, d).select(fl.language(fl.extension("path")).alias("language"))
    return spark.createDataFrame(repository.language_histogram(files), "language string, files long")


_NAME_SQL = "regexp_extract(path, '[^/]*$')"


@query(f"WITH p AS (SELECT {_PATHS_SQL} AS path FROM documents), q AS (SELECT {_LANG_SQL} IN ('JSON', 'YAML', 'Markdown') OR {_NAME_SQL} = '.gitkeep' OR contains({_NAME_SQL}, '.config.') OR starts_with({_NAME_SQL}, 'tsconfig.') OR list_contains(string_split(path, '/'), 'config') AS config, list_contains(string_split(path, '/'), '__tests__') OR contains({_NAME_SQL}, '.spec.') OR contains({_NAME_SQL}, '.test.') AS test FROM p) SELECT config, test, count(*) AS files FROM q GROUP BY ALL")
def path_classifiers(spark, d):
    rows = doc_paths(spark, d).withColumn("language", fl.language(fl.extension("path")))
    return rows.groupBy(context.is_config("path").alias("config"), context.is_test("path").alias("test")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT count(*) AS files, count(*) FILTER (n > 1) AS in_folders, count(DISTINCT folder) AS folders FROM (SELECT path, len(string_split(path, '/')) AS n, nullif(regexp_extract(path, '^(.*[^/])/+[^/]+/*$', 1), '') AS folder FROM (SELECT " + _PATHS_SQL + " AS path FROM documents))")
def path_functions(spark, d):
    return doc_paths(spark, d).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.size(ancestors("path")) > 0).alias("in_folders"), F.count_distinct(dirname("path")).alias("folders"))


# modules -----------------------------------------------------------------------------------------------------------


_STORED = "CASE p_partkey % 5 WHEN 0 THEN base || '.tsx' WHEN 1 THEN base || '/index.ts' WHEN 2 THEN base || '.js' WHEN 3 THEN base || '.css' ELSE base END"


@query(
    f"""WITH b AS (SELECT p_partkey, p_brand || '/' || CAST(p_partkey AS VARCHAR) AS base FROM part), s AS (SELECT p_partkey, {_STORED} AS path FROM b),
c AS (SELECT p_partkey, unnest([base, base || '.ts', base || '.tsx', base || '.js', base || '.jsx', base || '/index.ts', base || '/index.tsx', base || '/index.js', base || '/index.jsx']) AS tried_path, unnest(range(9)) AS pos FROM b)
SELECT p_partkey, arg_min(path, pos) AS path, CAST(min(pos) AS BIGINT) AS tried FROM c JOIN (SELECT path FROM s) ON tried_path = path GROUP BY p_partkey"""
)
def module_candidates_first_hit(spark, d):
    asked = t(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("base"))
    stored = asked.select(F.expr(_STORED).alias("path"))
    tries = asked.select("p_partkey", resolve.candidates("base").alias("tries"))
    return resolve.first_hit(tries, ["p_partkey"], "tries", stored.select("path", F.col("path").alias("hit")), "path", "hit", "tried").withColumnRenamed("hit", "path")


@query(
    """WITH q AS (SELECT p_partkey, replace(p_name, ' ', '/') || '/' || p_type AS spec FROM part), a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS alias FROM part WHERE p_size < 20 UNION SELECT DISTINCT replace(p_name, ' ', '/') FROM part WHERE p_size % 4 = 0)
SELECT p_partkey, spec, max_by(alias, length(alias)) AS alias FROM q LEFT JOIN a ON spec = alias OR starts_with(spec, alias || '/') GROUP BY ALL"""
)
def alias_longest_prefix(spark, d):
    part = t(spark, d, "part")
    asked = part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), "p_type").alias("spec"))
    aliases = part.where("p_size < 20").select(F.split("p_name", " ")[0].alias("alias")).union(part.where("p_size % 4 = 0").select(F.replace("p_name", F.lit(" "), F.lit("/")))).distinct()
    best = resolve.longest_prefix(asked, "spec", aliases.withColumn("there", F.lit(1)), "alias").select(F.col("spec").alias("s"), "alias")
    return asked.join(best, F.col("spec") == F.col("s"), "left").select("p_partkey", "spec", "alias")


def bought(spark, d) -> DataFrame:
    """source (customer), target (supplier), kind, type_only: distinct edges."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return li.join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c:"), "o_custkey").alias("source_file_id"), F.concat(F.lit("s:"), "l_suppkey").alias("target_file_id"), F.lit("part").alias("source_specifier"), F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "F").alias("type_only"))


_EDGES = "e AS (SELECT DISTINCT 'c:' || o_custkey AS src, 's:' || l_suppkey AS tgt, l_returnflag AS kind, l_linestatus = 'F' AS type_only FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_EDGE_ID = "sha256('dependency' || chr(0) || src || chr(0) || tgt || chr(0) || kind || chr(0) || 'part' || chr(0) || CASE WHEN type_only THEN 'true' ELSE 'false' END)"


@query(f"WITH {_EDGES} SELECT {_EDGE_ID} AS id, src AS source_file_id, tgt AS target_file_id, 'part' AS source_specifier, kind, type_only FROM e")
def dependency_edges(spark, d):
    return resolve.dependency_edges(bought(spark, d))


@query(
    """SELECT 'c:' || o_custkey AS source_file_id, l_returnflag AS source_specifier, l_linestatus = 'F' AS type_only, array_to_string(list_sort(list(DISTINCT 's:' || l_suppkey)), ',') AS import_ids
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey >= 20 GROUP BY ALL"""
)
def external_dependencies(spark, d):
    outside = t(spark, d, "supplier").where("s_nationkey >= 20").select(F.concat(F.lit("s:"), "s_suppkey").alias("s"))
    rows = bought(spark, d).join(outside, F.col("target_file_id") == F.col("s"), "left_semi").select("source_file_id", F.col("kind").alias("source_specifier"), "type_only", F.col("target_file_id").alias("import_id"), F.lit(None).cast("string").alias("export_id"))
    return resolve.external_groups(rows).select("source_file_id", "source_specifier", "type_only", F.array_join("import_ids", ",").alias("import_ids"))


_STEPS = "steps AS (SELECT DISTINCT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events)"


@query(
    f"""WITH RECURSIVE {_STEPS}, ed AS (SELECT * FROM steps WHERE a IS NOT NULL), p AS (SELECT a AS head, b AS here, [a] AS route FROM ed UNION ALL SELECT p.head, ed.b, list_append(p.route, p.here) FROM p JOIN ed ON p.here = ed.a WHERE p.here > p.head AND NOT list_contains(p.route, p.here) AND ed.b >= p.head),
c AS (SELECT DISTINCT route FROM p WHERE here = head), v AS (SELECT route, unnest(list_concat(list_transform(range(1, len(route) + 1), lambda i: array_to_string(list_concat(route[i:], route[1:i - 1]), '>')), list_transform(range(1, len(route) + 1), lambda i: array_to_string(list_concat(list_reverse(route)[i:], list_reverse(route)[1:i - 1]), '>')))) AS x FROM c)
SELECT DISTINCT min(x) AS cycle FROM v GROUP BY route"""
)
def event_transition_cycles(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type").select(before.alias("a"), F.col("event_type").alias("b")).where("a IS NOT NULL").distinct()
    return elementary_cycles(edges).select(F.array_join("cycle", ">").alias("cycle")).distinct()


# knowledge ---------------------------------------------------------------------------------------------------------

_CUST_PATHS = "cp AS (SELECT c_custkey, 'r' || n_regionkey || '/n' || n_nationkey || '/' || lower(c_mktsegment) || '/' || c_custkey || '.ts' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def customer_paths(spark, d) -> DataFrame:
    # nation has 25 rows whatever the scale
    rows = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/"), F.lower("c_mktsegment"), F.lit("/"), "c_custkey", F.lit(".ts")).alias("path"))


_FOLDERS_SQL = "parts AS (SELECT string_split(path, '/') AS w FROM cp), f AS (SELECT array_to_string(w[1:unnest(range(1, len(w)))], '/') AS folder FROM parts)"


@query(f"WITH {_CUST_PATHS}, {_FOLDERS_SQL} SELECT DISTINCT folder, sha256('knowledge:v1' || chr(0) || 'folder' || chr(0) || folder) AS id FROM f")
def folder_closure_ids(spark, d):
    return folder_closure(customer_paths(spark, d)).select("folder", knowledge_id("folder", F.col("folder")).alias("id"))


_ROOTS = [("all", ""), ("west", "r1"), ("n3", "r1/n3"), ("build3", "r1/n3/building"), ("east", "r2")]
_ROOTS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _ROOTS)


@query(f"WITH {_CUST_PATHS}, r(project_id, root) AS (VALUES {_ROOTS_SQL}) SELECT path, max_by(project_id, length(root)) AS project_id FROM cp JOIN r ON root = '' OR path = root OR starts_with(path, root || '/') GROUP BY path")
def project_members(spark, d):
    roots = spark.createDataFrame(_ROOTS, "project_id string, root_relative_path string")
    return project_membership(customer_paths(spark, d).select("path"), roots)


def members(spark, d) -> DataFrame:
    """member, grp: customers and suppliers with their nation."""
    return t(spark, d, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("member"), F.col("c_nationkey").alias("grp")).unionByName(t(spark, d, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("member"), F.col("s_nationkey").alias("grp")))


@query(
    f"""WITH {_EDGES}, m AS (SELECT 'c:' || c_custkey AS member, c_nationkey AS grp FROM customer UNION ALL SELECT 's:' || s_suppkey, s_nationkey FROM supplier)
SELECT a.grp AS source_group, b.grp AS target_group, CAST(count(*) AS INT) AS dependency_count, CAST(count(*) FILTER (type_only) AS INT) AS type_only_dependency_count
FROM e JOIN m a ON src = a.member JOIN m b ON tgt = b.member WHERE a.grp <> b.grp GROUP BY ALL"""
)
def project_dependencies(spark, d):
    """The flagship: which group depends on which, by how many distinct edges."""
    edges = resolve.dependency_edges(bought(spark, d)).select("id", F.col("source_file_id").alias("source"), F.col("target_file_id").alias("target"), "type_only")
    return group_dependencies(edges, members(spark, d)).drop("dependency_ids")


# a graph: repository r, projects n:, files c: and s:, symbols o: -------------------------------------------------------

_NODES_SQL = """nodes AS (SELECT 'r' AS id, 'repository' AS kind, 'r' AS qualified_name UNION ALL SELECT 'n:' || n_nationkey, 'project', n_name FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'file', s_name FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'file', c_name FROM customer UNION ALL SELECT 'o:' || o_orderkey, 'symbol', 'o' || o_orderkey FROM orders)"""
_RELS_SQL = """rels AS (SELECT 'contains' AS kind, 'r' AS src, 'n:' || n_nationkey AS tgt FROM nation UNION ALL SELECT 'contains', 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier
  UNION ALL SELECT 'contains', 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION ALL SELECT 'belongs-to-project', 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 'declares', 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'depends-on', 'c:' || o_custkey, 's:' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT 'project-depends-on', 'n:' || c_nationkey, 'n:' || s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"""
_REL_ID = "sha256('knowledge:v1' || chr(0) || 'relation' || chr(0) || kind || chr(0) || src || chr(0) || tgt || chr(0) || chr(0))"
_G = f"WITH {_NODES_SQL}, {_RELS_SQL}, g AS (SELECT {_REL_ID} AS id, * FROM rels)"


def world(spark, d) -> graph.Graph:
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, supplier, customer, orders = (t(spark, d, x) for x in ("nation", "supplier", "customer", "orders"))
    node = lambda df, i, kind, name: df.select(i.alias("id"), F.lit(kind).alias("kind"), name.alias("qualified_name"))
    nodes = (
        node(spark.range(1), F.lit("r"), "repository", F.lit("r")).unionByName(node(nation, tag("n:", "n_nationkey"), "project", F.col("n_name"))).unionByName(node(supplier, tag("s:", "s_suppkey"), "file", F.col("s_name")))
        .unionByName(node(customer, tag("c:", "c_custkey"), "file", F.col("c_name"))).unionByName(node(orders, tag("o:", "o_orderkey"), "symbol", tag("o", "o_orderkey")))
    )
    uses = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    between = uses.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey").select("c_nationkey", "s_nationkey").distinct()
    parts = [
        relation_rows(nation, "contains", F.lit("r"), tag("n:", "n_nationkey")), relation_rows(supplier, "contains", tag("n:", "s_nationkey"), tag("s:", "s_suppkey")), relation_rows(customer, "contains", tag("n:", "c_nationkey"), tag("c:", "c_custkey")),
        relation_rows(customer, "belongs-to-project", tag("c:", "c_custkey"), tag("n:", "c_nationkey")), relation_rows(orders, "declares", tag("c:", "o_custkey"), tag("o:", "o_orderkey")),
        relation_rows(uses, "depends-on", tag("c:", "o_custkey"), tag("s:", "l_suppkey")), relation_rows(between, "project-depends-on", tag("n:", "c_nationkey"), tag("n:", "s_nationkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return graph.Graph(nodes, out.select("id", "kind", "source_node_id", "target_node_id"))


@query(f"{_G} SELECT kind, count(*) AS relations, count(DISTINCT src) AS sources, count(DISTINCT tgt) AS targets, min(id) AS first_id FROM g GROUP BY kind")
def relations_union(spark, d):
    return world(spark, d).relations.groupBy("kind").agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("source_node_id").alias("sources"), F.count_distinct("target_node_id").alias("targets"), F.min("id").alias("first_id"))


_LEGAL_SQL = """('contains', 'repository', 'project'), ('contains', 'repository', 'folder'), ('contains', 'repository', 'file'), ('contains', 'project', 'folder'), ('contains', 'project', 'file'), ('contains', 'project', 'symbol'),
  ('contains', 'folder', 'folder'), ('contains', 'folder', 'file'), ('belongs-to-project', 'file', 'project'), ('belongs-to-project', 'symbol', 'project'), ('declares', 'file', 'symbol'), ('exports', 'file', 'symbol'), ('binds-to', 'file', 'symbol'),
  ('depends-on', 'file', 'file'), ('parent-symbol', 'symbol', 'symbol'), ('project-depends-on', 'project', 'project')"""


@query(
    f"""{_G}, bad AS (SELECT * FROM g UNION ALL SELECT 'x' || id, 'declares', tgt, src FROM g WHERE kind = 'contains' UNION ALL SELECT 'y' || id, kind, src, 'gone' FROM g WHERE kind = 'project-depends-on'), m(k, s, x) AS (VALUES {_LEGAL_SQL})
SELECT bad.id, bad.kind, a.kind AS source_kind, b.kind AS target_kind FROM bad LEFT JOIN nodes a ON src = a.id LEFT JOIN nodes b ON tgt = b.id WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = bad.kind AND m.s = a.kind AND m.x = b.kind)"""
)
def endpoint_violations(spark, d):
    w = world(spark, d)
    turned = w.relations.where("kind = 'contains'").select(F.concat(F.lit("x"), "id").alias("id"), F.lit("declares").alias("kind"), F.col("target_node_id").alias("source_node_id"), F.col("source_node_id").alias("target_node_id"))
    lost = w.relations.where("kind = 'project-depends-on'").select(F.concat(F.lit("y"), "id").alias("id"), "kind", "source_node_id", F.lit("gone").alias("target_node_id"))
    return graph.endpoint_violations(w.nodes, w.relations.unionByName(turned).unionByName(lost)).select("id", "kind", "source_kind", "target_kind")


_NODE = "c:7"


@query(f"{_G} SELECT id, kind, tgt AS target_node_id FROM g WHERE src = '{_NODE}'")
def outgoing_relations(spark, d):
    return graph.outgoing(world(spark, d), _NODE).select("id", "kind", "target_node_id")


@query(f"{_G} SELECT id, kind, src AS source_node_id FROM g WHERE tgt = 'n:3' AND kind IN ('contains', 'project-depends-on')")
def incoming_relations(spark, d):
    return graph.incoming(world(spark, d), "n:3", ["contains", "project-depends-on"]).select("id", "kind", "source_node_id")


@query(f"{_G} SELECT n.id AS node_id, n.kind, r.kind AS relation_kind, direction FROM (SELECT tgt AS far, kind, 'outgoing' AS direction FROM g WHERE src = '{_NODE}' UNION ALL SELECT src, kind, 'incoming' FROM g WHERE tgt = '{_NODE}') r JOIN nodes n ON far = n.id")
def neighbors(spark, d):
    return graph.neighbors(world(spark, d), _NODE).select("node_id", "kind", "relation_kind", "direction")


_DEPTH2 = f"""{_G}, w AS (SELECT src AS near, tgt AS far FROM g WHERE kind IN ('depends-on', 'contains') UNION SELECT tgt, src FROM g WHERE kind IN ('depends-on', 'contains')), d0 AS (SELECT '{_NODE}' AS id),
d1 AS (SELECT DISTINCT far AS id FROM w JOIN d0 ON near = id), d2 AS (SELECT DISTINCT far AS id FROM w JOIN d1 ON near = d1.id), found AS (SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2) GROUP BY id)"""


@query(f"{_DEPTH2} SELECT id, CAST(depth AS INT) AS depth FROM found")
def neighborhood_depth2(spark, d):
    w = world(spark, d)
    return graph.discover(w.nodes, w.relations, w.nodes.where(F.col("id") == _NODE).select("id"), 2, "both", ["depends-on", "contains"])


@query(f"{_DEPTH2} SELECT 'NODE_LIMIT' AS reason, 'node' AS entity_kind, count(*) - 50 AS count FROM found HAVING count(*) > 50")
def neighborhood_omissions(spark, d):
    return graph.neighborhood(world(spark, d), _NODE, relation_kinds=["depends-on", "contains"], max_depth=2, max_nodes=50, max_relations=20000).omissions


def _view(spark, d, kind, **limits):
    w = world(spark, d)
    none = F.lit(None).cast("string")
    nodes = w.nodes.withColumns({"parent_symbol_id": none, "parent_folder_id": none, "folder_id": F.when(F.col("kind") == "file", F.lit("f")), "project_id": none})
    # ids are made of the relations that the view shows only
    node_kinds, relation_kinds = graph.VIEWS[kind]
    shown = graph.Graph(checkpointed(nodes.where(F.col("kind").isin(*node_kinds))), checkpointed(w.relations.where(F.col("kind").isin(*relation_kinds))))
    return graph.view(shown, kind, max_nodes=5000, max_relations=20000, **limits)


@query(f"{_G} SELECT id, src AS source_node_id, tgt AS target_node_id FROM g WHERE kind = 'project-depends-on'")
def view_project_dependencies(spark, d):
    return _view(spark, d, "project-dependencies").edges.select("id", "source_node_id", "target_node_id")


_FILES_SQL = f"{_G}, chosen AS (SELECT id FROM nodes WHERE kind = 'file' ORDER BY qualified_name, id LIMIT 5000), kept AS (SELECT g.* FROM g WHERE kind = 'depends-on' AND src IN (SELECT id FROM chosen) AND tgt IN (SELECT id FROM chosen))"


@query(f"{_FILES_SQL} SELECT count(*) AS nodes, (SELECT count(*) FROM (SELECT 1 FROM kept LIMIT 20000)) AS edges, (SELECT min(id) FROM chosen) AS first_node FROM chosen")
def view_file_dependencies(spark, d):
    got = _view(spark, d, "file-dependencies")
    return got.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.min("id").alias("first_node")).join(got.edges.agg(F.count(F.lit(1)).alias("edges")))


@query(f"{_G}, chosen AS (SELECT id, kind FROM nodes WHERE kind IN ('repository', 'project', 'file') UNION ALL (SELECT id, kind FROM nodes WHERE kind = 'symbol' ORDER BY qualified_name, id LIMIT greatest(0, 5000 - (SELECT count(*) FROM nodes WHERE kind <> 'symbol')))) SELECT kind, count(*) AS edges FROM g WHERE src IN (SELECT id FROM chosen) AND tgt IN (SELECT id FROM chosen) AND ((kind = 'contains' AND src = 'r') OR kind = 'declares') GROUP BY kind")
def view_repository(spark, d):
    return _view(spark, d, "repository").edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


@query(f"{_G}, e AS (SELECT id, unnest(list_distinct([src, tgt])) AS node FROM g) SELECT n.id, count(e.id) AS degree, CAST(least(88, floor(38 + 6 * sqrt(count(e.id)) + 0.5)) AS INT) AS size FROM nodes n LEFT JOIN e ON n.id = node GROUP BY n.id")
def degree_and_size(spark, d):
    w = world(spark, d)
    return explore.degrees(w.nodes, w.relations)


@query(f"{_G}, h AS (SELECT DISTINCT src, tgt FROM g WHERE kind IN ('contains', 'declares')), a AS (SELECT 'r' AS id, 2 AS remaining), b AS (SELECT tgt AS id, 1 AS remaining FROM h WHERE src = 'r' ), c AS (SELECT tgt AS id, CASE WHEN tgt = '{_NODE}' THEN 2 ELSE 0 END AS remaining FROM h JOIN b ON src = b.id WHERE b.id <> 'n:3'), d AS (SELECT tgt AS id, 1 AS remaining FROM h WHERE src = '{_NODE}' AND '{_NODE}' IN (SELECT id FROM c)) SELECT id, CAST(max(remaining) AS INT) AS remaining FROM (SELECT id, CASE WHEN id = 'n:3' THEN 0 ELSE remaining END AS remaining FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)) GROUP BY id")
def exploration_depth2(spark, d):
    w = world(spark, d)
    return explore.explore(w.relations.where("kind IN ('contains', 'declares')"), spark.createDataFrame([("r",)], "id string"), 2, expanded=[_NODE], collapsed=["n:3"])


@query(f"{_G}, h AS (SELECT src, tgt FROM g WHERE kind IN ('contains', 'declares')) SELECT id FROM (SELECT 'n:3' AS id UNION SELECT 'r' UNION SELECT tgt FROM h WHERE src = 'n:3' UNION SELECT b.tgt FROM h a JOIN h b ON a.tgt = b.src WHERE a.src = 'n:3')")
def isolated_closure(spark, d):
    w = world(spark, d)
    return explore.isolate(w.nodes, w.relations.where("kind IN ('contains', 'declares')"), "n:3")


# selections --------------------------------------------------------------------------------------------------------


_RANGES = "r AS (SELECT l_orderkey AS file, CAST(l_quantity AS INT) * 3 AS lo, CAST(l_quantity AS INT) * 3 + l_linenumber AS hi, l_linenumber AS priority FROM lineitem)"


@query(
    f"""WITH {_RANGES}, s AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY file ORDER BY lo, hi, priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 1 ELSE 0 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY lo, hi, priority ROWS UNBOUNDED PRECEDING) AS grp FROM s) SELECT file, min(lo) AS lo, max(hi) AS hi, CAST(min(priority) AS INT) AS priority, count(*) AS requests FROM g GROUP BY file, grp"""
)
def excerpt_ranges_merged(spark, d):
    from corvane.operators.context import merged_ranges

    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_quantity").cast("int") * 3).alias("lo"), (F.col("l_quantity").cast("int") * 3 + F.col("l_linenumber")).alias("hi"), F.col("l_linenumber").alias("priority"))
    return merged_ranges(rows, ["file"], "lo", "hi", ["priority"], 3).groupBy("file", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("priority").alias("priority"), F.count(F.lit(1)).alias("requests")).drop("island")


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN '0 target' WHEN '2-HIGH' THEN '1 direct-dependency' ELSE '2 same-file-symbol' END)), ', ') AS reasons FROM orders GROUP BY o_custkey")
def context_reasons(spark, d):
    from corvane.operators.context import in_order

    order = ["target", "direct-dependency", "same-file-symbol"]
    reason = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'target' WHEN '2-HIGH' THEN 'direct-dependency' ELSE 'same-file-symbol' END")
    got = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(reason).alias("r")).select("o_custkey", in_order(F.col("r"), order).alias("r"))
    number = F.transform("r", lambda x: F.concat(F.when(x == order[0], "0 ").when(x == order[1], "1 ").otherwise("2 "), x))
    return got.select("o_custkey", F.array_join(number, ", ").alias("reasons"))


def _texts(rows, make, name):
    """The rows (key, text) with what `make` gives for each text, in Arrow batches."""
    key = rows.columns[0]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, name])

    return rows.mapInArrow(run, f"{key} long, {name} string")


_MARK_SQL = "chr(10) || '/* … excerpt truncated … */' || chr(10)"


@query(f"WITH m AS (SELECT {_MARK_SQL} AS mark, 400 - length({_MARK_SQL}) AS room) SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, CAST(floor(room * 0.65) AS BIGINT)) || mark || right(text, CAST(room - floor(room * 0.65) AS BIGINT)) END AS excerpt FROM documents, m WHERE text IS NOT NULL")
def excerpt_truncate(spark, d):
    return _texts(t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), lambda x: context.truncate_text(x, 400), "excerpt")


@query("SELECT c_custkey, sha256('{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}') AS id FROM customer")
def canonical_json_id(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))).alias("body"))
    return _texts(rows, lambda x: context.json_id(json.loads(x)), "id")


@query(f"{_G}, v AS (SELECT id FROM nodes WHERE kind IN ('file', 'project') AND (contains(lower(id), 's:1') OR contains(lower(qualified_name), 's:1'))) SELECT 'node' AS element, id FROM v UNION ALL SELECT 'edge', id FROM g WHERE src IN (SELECT id FROM v) AND tgt IN (SELECT id FROM v)")
def visible_elements(spark, d):
    w = world(spark, d)
    nodes = w.nodes.select("id", "kind", F.col("qualified_name").alias("label"), F.lit(None).cast("string").alias("subtitle"), F.lit(None).cast("string").alias("path"))
    one, two = explore.visible(nodes, w.relations, " S:1 ", ["file", "project"])
    return one.select(F.lit("node").alias("element"), "id").unionByName(two.select(F.lit("edge").alias("element"), "id"))


QUERIES |= shop.QUERIES
SQL |= shop.SQL
