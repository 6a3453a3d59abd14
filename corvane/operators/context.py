"""Context packages: the files, symbols, relations and source excerpts that matter most to a target.

Candidates, rankings, relations and merged line ranges are relational; each step ends in a top-k within the
options' ceilings. Only what is selected reaches the driver, where the excerpts' running budget is kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import basename
from corvane.functions.tables import checkpointed, rank_of, refuse
from corvane.operators.graph import discover, first_rows
from corvane.operators.knowledge import Knowledge, Model
from corvane.operators.resolve import Resolution, Resolver
from corvane.schemas import ContextError

# Options, their ceilings, and the orders of reasons.
DEFAULTS = {
    "includeSource": True, "maxFiles": 20, "maxSymbols": 80, "maxRelations": 120, "maxExcerpts": 20, "maxExcerptCharacters": 4000, "maxTotalSourceCharacters": 30000,
    "dependencyDepth": 1, "dependentDepth": 1, "folderDepth": 1, "includeExternalDependencies": True, "includeDiagnostics": True,
}
CEILINGS = {"maxFiles": 500, "maxSymbols": 5000, "maxRelations": 10000, "maxExcerpts": 500, "maxExcerptCharacters": 100000, "maxTotalSourceCharacters": 1000000, "dependencyDepth": 5, "dependentDepth": 5, "folderDepth": 10}
REASONS = (
    "target", "contains-target", "target-declaration", "target-export", "parent-symbol", "child-symbol", "same-file-symbol", "direct-dependency", "transitive-dependency", "direct-dependent",
    "transitive-dependent", "bound-symbol", "binding-source", "project-entry-point", "project-public-symbol", "folder-member", "project-member",
)
EXCERPT_REASONS = ("target-symbol", "target-file-header", "exported-symbol", "bound-symbol", "dependency-entry-point", "project-entry-point")
SAFETY_CEILING = 2_000_000
MARKER = "\n/* … excerpt truncated … */\n"
HEAD_LINES, AROUND, GAP, LEAST_REST, HEAD_SHARE = 80, 2, 3, 128, 0.65


@dataclass
class Stages:
    """What the stages before have made of a repository.

    With a `Resolver` and a `Model`, tables are made of what is asked for; `imports` may then be what gives them.
    """

    scan_files: DataFrame
    parsed_files: DataFrame
    imports: DataFrame | Callable[[], DataFrame]
    exports: DataFrame
    diagnostics: DataFrame
    resolution: Resolution | Resolver
    knowledge: Knowledge | Model
    #: the root paths that scan, analysis, resolution and model are of, where they are known
    roots: tuple[str, ...] = ("",)


def in_order(values: Column, order) -> Column:
    """An array's distinct values in a fixed order."""
    wanted = F.array(*map(F.lit, order))
    return F.filter(wanted, lambda x: F.array_contains(values, x))


def merged_ranges(rows: DataFrame, keys: list[str], lo: str, hi: str, ties: list[str], gap: int) -> DataFrame:
    """The rows with `island`: ranges of a key that overlap, or lie at most `gap` lines apart, share one."""
    w = Window.partitionBy(*keys).orderBy(lo, hi, *ties)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("__fresh", F.when(F.col(lo) > before + gap, 1).otherwise(0))
    return fresh.withColumn("island", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def is_config(path: str = "relative_path", language: str = "language") -> Column:
    name = basename(path)
    return F.coalesce(F.col(language).isin("JSON", "YAML", "Markdown"), F.lit(False)) | (name == ".gitkeep") | name.contains(".config.") | name.startswith("tsconfig.") | F.array_contains(F.split(F.col(path), "/"), "config")


def is_test(path: str = "relative_path") -> Column:
    name = basename(path)
    return F.array_contains(F.split(F.col(path), "/"), "__tests__") | name.contains(".spec.") | name.contains(".test.")


def checked_options(options: dict | None) -> dict:
    out = DEFAULTS | (options or {})
    for key, most in CEILINGS.items():
        v = out.get(key)
        if not isinstance(v, int) or isinstance(v, bool) or not (1 if key.startswith("max") else 0) <= v <= most:
            raise ContextError("INVALID_OPTIONS", f"Invalid context option {key}.")
    return out


def _plain(path: str) -> str:
    path = path.replace("\\", "/")
    path = path[2:] if path.startswith("./") else path
    return path[:-1] if path.endswith("/") else path


def resolve_target(k: Knowledge, wanted: dict) -> dict:
    """The one node that a request names: by kind and exactly one way of looking it up."""
    kind = wanted["kind"]
    ways = {"file": ("fileId", "relativePath"), "symbol": ("symbolId", "qualifiedName"), "folder": ("folderId", "relativePath"), "project": ("projectId", "name", "rootRelativePath")}[kind]
    given = [w for w in ways if wanted.get(w)]
    files = [w for w in ("fileId", "fileRelativePath") if kind == "symbol" and wanted.get(w)]
    if len(given) != 1 or len(files) > 1 or (files and given[0] != "qualifiedName"):
        raise ContextError("TARGET_LOOKUP_INVALID", "Target must use exactly one valid lookup strategy.")
    way, value = given[0], wanted[given[0]]
    path = F.col("relative_path") if kind in ("file", "folder") else F.col("root_relative_path") if kind == "project" else None
    if kind == "symbol":
        paths = k.files.select(F.col("file_id").alias("__f"), "relative_path")
        rows = k.symbols.join(paths, F.col("file_id") == F.col("__f"))
        rows = rows.where(F.col("symbol_id") == value if way == "symbolId" else (F.col("qualified_name") == value) | (F.col("name") == value))
        if files:
            rows = rows.where(F.col("file_id") == wanted["fileId"] if files[0] == "fileId" else F.col("relative_path") == _plain(wanted["fileRelativePath"]))
        rows = rows.select("id", "name", "qualified_name", "relative_path", "project_id", "file_id", "symbol_id")
    else:
        table = {"file": k.files, "folder": k.folders, "project": k.projects}[kind]
        match = path == _plain(value) if way.endswith("elativePath") else F.col({"fileId": "file_id", "name": "name"}.get(way, "id")) == value
        none = F.lit(None).cast("string")
        rows = table.where(match).select("id", "name", "qualified_name", path.alias("relative_path"), (F.col("id") if kind == "project" else F.col("project_id")).alias("project_id"), (F.col("file_id") if kind == "file" else none).alias("file_id"), none.alias("symbol_id"))
    found = rows.limit(2).collect()
    if not found:
        raise ContextError("TARGET_NOT_FOUND", f"Context {kind} target was not found.")
    if len(found) > 1:
        raise ContextError("TARGET_AMBIGUOUS", f"Context {kind} target is ambiguous.")
    r = found[0]
    return {"kind": kind, "nodeId": r["id"], "name": r["name"], "qualifiedName": r["qualified_name"], "relativePath": r["relative_path"], "projectId": r["project_id"], "fileId": r["file_id"], "symbolId": r["symbol_id"]}


def _rule(rows: DataFrame, file_id, priority, depth, *reasons: str) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select((F.col(file_id) if isinstance(file_id, str) else file_id).alias("file_id"), col(priority).alias("priority"), col(depth).alias("depth"), F.explode(F.array(*[col(r) for r in reasons])).alias("reason"))


def _bindings_of(s: Stages, file_id: str) -> DataFrame:
    if isinstance(s.resolution, Resolver):
        return s.resolution.bindings_of(s.scan_files.sparkSession.createDataFrame([(file_id,)], "file_id string"))
    return s.resolution.bindings.where(F.col("source_file_id") == file_id)


def _crossing(s: Stages, project_id: str) -> DataFrame:
    """file_id, out, mine: ends of dependencies between a project and others."""
    k, deps = s.knowledge, s.resolution.dependencies
    if isinstance(k, Model):
        return k.crossing(project_id)
    crossing = k.project_dependencies.where((F.col("source_project_id") == project_id) | (F.col("target_project_id") == project_id)).select(F.explode("file_dependency_ids").alias("x")).distinct()
    cross = checkpointed(deps.join(crossing, F.col("id") == F.col("x"), "left_semi").select("source_file_id", "target_file_id").distinct())
    ends = cross.select(F.col("source_file_id").alias("cf"), F.lit(True).alias("out")).unionByName(cross.select(F.col("target_file_id").alias("cf"), F.lit(False).alias("out"))).distinct()
    return ends.join(k.files.select("file_id", "project_id"), F.col("cf") == F.col("file_id")).select("file_id", "out", (F.col("project_id") == project_id).alias("mine"))


def file_candidates(s: Stages, target: dict, options: dict) -> DataFrame:
    """Every rule's files with file_id, priority, depth, reasons, and the model's row of each; edges are counted, not listed."""
    k, found = s.knowledge, file_reasons(s, target, options)
    if isinstance(k, Model):
        return k.files_of(checkpointed(found))
    rows = found.withColumnRenamed("file_id", "__c").join(k.files, F.col("__c") == F.col("file_id")).drop("__c")
    return rows.withColumns({name: F.size(f"{name}_file_dependency_ids") for name in ("incoming", "outgoing")})


def file_reasons(s: Stages, target: dict, options: dict) -> DataFrame:
    """file_id, priority, depth, reasons: every rule's files, each file with its least priority and depth."""
    k = s.knowledge
    spark = k.files.sparkSession
    rules = []
    if target["fileId"]:
        base = spark.createDataFrame([(target["fileId"],)], "id string")
        rules.append(_rule(base, "id", 0, 0, "contains-target" if target["kind"] == "symbol" else "target"))
        edges = s.resolution.dependencies.select(F.col("id"), F.col("kind"), F.col("source_file_id").alias("source_node_id"), F.col("target_file_id").alias("target_node_id"))
        for direction, most, first, later, names in (("outgoing", "dependencyDepth", 10, 20, ("direct-dependency", "transitive-dependency")), ("incoming", "dependentDepth", 11, 21, ("direct-dependent", "transitive-dependent"))):
            found = discover(base, edges, base, options[most], direction).where("depth > 0")
            rules.append(_rule(found, "id", F.when(F.col("depth") == 1, first).otherwise(later), F.col("depth"), F.when(F.col("depth") == 1, names[0]).otherwise(names[1])))
        if target["symbolId"]:
            rules.append(_rule(s.resolution.bindings.where(F.col("target_symbol_id") == target["symbolId"]), "source_file_id", 12, 1, "binding-source"))
        rules.append(_rule(_bindings_of(s, target["fileId"]), "target_file_id", 12, 1, "bound-symbol"))
    elif target["kind"] == "folder":
        top = target["relativePath"]
        inside = k.files.where(F.col("relative_path").startswith(top + "/"))
        distance = F.size(F.split(F.substring("relative_path", len(top) + 2, 1 << 20), "/")) - 1
        if isinstance(k, Model):
            inside, offers = inside.join(k.offered.select(F.col("file_id").alias("__o")).distinct(), F.col("file_id") == F.col("__o"), "left"), F.col("__o").isNotNull()
        else:
            offers = F.size("public_symbol_ids") > 0
        grade = F.when((F.col("status") == "parsed") & ~is_config(), F.when(offers, 10).otherwise(20)).otherwise(30)
        rules.append(_rule(inside, "file_id", grade, distance, "folder-member"))
    else:
        me = target["nodeId"]
        if isinstance(k, Model):
            offering = k.symbols.join(k.shown_by(me), "symbol_id", "left_semi")
        else:
            shown = k.projects.where(F.col("id") == me).select(F.explode("public_symbol_ids").alias("p"))
            offering = k.symbols.join(shown, F.col("id") == F.col("p"), "left_semi")
        public = offering.select(F.col("file_id").alias("pf")).distinct().withColumn("public", F.lit(True))
        cross = checkpointed(_crossing(s, me))
        ends = cross.groupBy(F.col("file_id").alias("cf")).agg(F.max("out").alias("out"))
        mine = k.files.where(F.col("project_id") == me).join(public, F.col("file_id") == F.col("pf"), "left").join(ends, F.col("file_id") == F.col("cf"), "left")
        grade = F.when(F.col("public"), 10).when(F.col("cf").isNotNull(), 20).when(is_config(), 60).when(F.col("status") == "parsed", F.when(is_test(), 40).otherwise(30)).otherwise(60)
        rules.append(_rule(mine, "file_id", grade, 0, "project-member"))
        rules.append(_rule(mine.where("public"), "file_id", grade, 0, "project-public-symbol"))
        rules.append(_rule(mine.where("cf IS NOT NULL"), "file_id", grade, 0, F.when(F.col("out"), "direct-dependency").otherwise("direct-dependent")))
        # the other end of an edge that crosses the project's border is the project's
        rules.append(_rule(cross.where("NOT mine"), "file_id", 25, 1, F.when(F.col("out"), "direct-dependent").otherwise("direct-dependency")))
    every = rules[0]
    for r in rules[1:]:
        every = every.unionByName(r)
    best = every.groupBy("file_id").agg(F.min("priority").alias("priority"), F.min("depth").alias("depth"), F.collect_set("reason").alias("r"))
    return best.select("file_id", "priority", "depth", in_order(F.col("r"), REASONS).alias("reasons"))


def file_order() -> list[Column]:
    return [F.col("priority"), F.col("depth"), F.col("incoming").desc(), F.col("outgoing").desc(), F.col("relative_path"), F.col("file_id")]


def symbol_candidates(s: Stages, target: dict, files: DataFrame) -> DataFrame:
    """Symbols of the selected files with priority and reasons."""
    k = s.knowledge
    chosen = files.select(F.col("file_id").alias("__f"), F.col("relative_path").alias("__path"), F.col("priority").alias("__p"), F.col("reasons").alias("__r"), F.col("public_symbol_ids").alias("__public"))
    mine = checkpointed(k.symbols.join(F.broadcast(chosen), F.col("file_id") == F.col("__f")))
    rule = lambda rows, priority, reason: rows.select(F.col("symbol_id").alias("__sid"), (priority if isinstance(priority, Column) else F.lit(priority)).alias("priority"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    offered = F.array_contains("__public", F.col("id"))
    own = F.col("file_id") == target["fileId"] if target["fileId"] else F.lit(False)
    if target["kind"] == "symbol":
        node = target["nodeId"]
        up = mine.where(F.col("symbol_id") == target["symbolId"]).select(F.col("parent_symbol_id").alias("__up")).where("__up IS NOT NULL")
        rules = [
            rule(mine.where(F.col("symbol_id") == target["symbolId"]), 0, "target"), rule(mine.join(up, F.col("id") == F.col("__up"), "left_semi"), 1, "parent-symbol"), rule(mine.where(F.col("parent_symbol_id") == node), 2, "child-symbol"),
            rule(mine.where(own & (F.col("symbol_id") != target["symbolId"])), 6, "same-file-symbol"),
        ]
    elif target["kind"] == "file":
        bound = _bindings_of(s, target["fileId"]).where("target_symbol_id IS NOT NULL").select(F.col("target_symbol_id").alias("__b")).distinct()
        others = mine.where(~own).join(bound, F.col("symbol_id") == F.col("__b"), "left_anti")
        rules = [
            rule(mine.where(own), F.when(offered, 1).otherwise(2), F.when(offered, "target-export").otherwise("same-file-symbol")), rule(mine.join(bound, F.col("symbol_id") == F.col("__b"), "left_semi"), 3, "bound-symbol"),
            rule(others.where(offered), 4, "target-export"), rule(others, 5, "same-file-symbol"),
        ]
    else:
        has = lambda r: F.array_contains("__r", r)
        # a file's surface may name symbols of other selected files
        shown = chosen.select(F.explode("__public").alias("__s"), "__p", "__r")
        rules = [
            rule(k.symbols.join(chosen.select("__f"), F.col("file_id") == F.col("__f"), "left_semi").join(shown, F.col("id") == F.col("__s")), F.col("__p"), F.when(has("project-public-symbol"), "project-public-symbol").otherwise("target-export")),
            rule(mine, F.col("__p") + 1, F.when(has("folder-member"), "folder-member").otherwise("project-member")),
        ]
    every = rules[0]
    for r in rules[1:]:
        every = every.unionByName(r)
    best = every.groupBy("__sid").agg(F.min("priority").alias("priority"), in_order(F.collect_set("reason"), REASONS).alias("reasons"))
    return mine.join(best, F.col("symbol_id") == F.col("__sid")).drop("__sid", "__f", "__p", "__r", "__public").withColumnRenamed("__path", "file_path")


def symbol_order() -> list[Column]:
    return [F.col("priority"), F.col("file_path"), F.col("location.start_line"), F.col("location.start_column"), F.col("qualified_name"), F.col("symbol_id")]


COLLECTIONS = ("fileDependencies", "symbolBindings", "exports", "containment", "projectDependencies")


def relation_candidates(s: Stages, target: dict, files: DataFrame, symbols: DataFrame, project_ids: list[str], collections=COLLECTIONS) -> DataFrame:
    """collection, id, priority, body (a struct of the collections' fields, as JSON) of all relations among what is selected, or those of some collections."""
    k, r = s.knowledge, s.resolution
    fid = files.select(F.col("file_id").alias("x"), F.col("depth").alias("d"), F.col("relative_path").alias("p"))
    sid = symbols.select(F.col("symbol_id").alias("y"))
    entry = lambda rows, name, ident, priority, fields: rows.select(F.lit(name).alias("collection"), F.col(ident).alias("id"), priority.alias("priority"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("body"))
    c = F.col
    is_file = lambda col: c(col) == target["fileId"] if target["fileId"] else F.lit(False)
    # a target that is no symbol is matched by exports without one, as null equals null there
    is_symbol = lambda col: c(col).eqNullSafe(F.lit(target["symbolId"]).cast("string"))
    ends = lambda t, a, b: t.join(fid.select(c("x").alias("xa"), c("d").alias("da"), c("p").alias("pa")), c(a) == c("xa")).join(fid.select(c("x").alias("xb"), c("d").alias("db"), c("p").alias("pb")), c(b) == c("xb"))
    by_need = isinstance(r, Resolver)
    file_deps = lambda: ends(r.edges_between(files, files) if by_need else r.dependencies, "source_file_id", "target_file_id")
    deps = lambda: entry(file_deps(), "fileDependencies", "id", F.when(is_file("source_file_id") | is_file("target_file_id"), 1).otherwise(8), {"id": c("id"), "sourceFileId": c("source_file_id"), "targetFileId": c("target_file_id"), "sourceSpecifier": c("source_specifier"), "kind": c("kind"), "typeOnly": c("type_only"), "depthFromTarget": F.greatest("da", "db")})
    few = F.broadcast(fid.select(c("x").alias("xs")))

    def bound() -> DataFrame:
        # what binds stands in the selected files
        imports = s.imports() if callable(s.imports) else s.imports
        types = [t.join(few, c("file_id") == c("xs"), "left_semi").select(c("id").alias("__e"), c("type_only").alias("__t")) for t in (imports, s.exports)]
        rows = r.bindings_of(files) if by_need else r.bindings.join(few, c("source_file_id") == c("xs"), "left_semi")
        return rows.join(sid, c("target_symbol_id") == c("y"), "left_semi").join(types[0].unionByName(types[1]), c("source_entity_id") == c("__e"), "left")

    binds = lambda: entry(bound(), "symbolBindings", "id", F.when(is_symbol("target_symbol_id") | is_file("source_file_id"), 2).otherwise(4), {"id": c("id"), "sourceFileId": c("source_file_id"), "targetSymbolId": c("target_symbol_id"), "bindingKind": c("kind"), "importedName": c("imported_name"), "localName": c("local_name"), "typeOnly": F.coalesce("__t", F.lit(False))})
    ex = r.exports.join(fid.select(c("x").alias("xs")), c("source_file_id") == c("xs"), "left_semi").join(sid, c("target_symbol_id") == c("y"), "left").join(fid.select(c("x").alias("xt")), c("target_file_id") == c("xt"), "left")
    ex = ex.where("(target_symbol_id IS NULL OR y IS NOT NULL) AND (target_file_id IS NULL OR xt IS NOT NULL)").withColumn("shown_symbol", F.coalesce("target_symbol_id", "local_symbol_id"))
    outs = lambda: entry(ex, "exports", "export_id", F.when(is_file("source_file_id") | is_symbol("shown_symbol"), 3).otherwise(5), {"id": c("export_id"), "fileId": c("source_file_id"), "exportedName": c("exported_name"), "targetSymbolId": c("shown_symbol"), "targetFileId": c("target_file_id"), "typeOnly": c("type_only"), "defaultExport": c("exported_name") == "default", "status": c("status")})
    nodes = k.repository.select(c("id").alias("n")).unionByName(k.folders.select(c("id").alias("n"))).unionByName(files.select(c("id").alias("n"))).unionByName(symbols.select(c("id").alias("n"))).unionByName(k.projects.where(c("id").isin(project_ids)).select(c("id").alias("n")))
    held = lambda: k.containment(nodes.select(c("n").alias("id"))) if isinstance(k, Model) else k.relations.where("kind IN ('contains', 'declares', 'parent-symbol')").join(nodes.select(c("n").alias("ns")), c("source_node_id") == c("ns"), "left_semi").join(nodes.select(c("n").alias("nt")), c("target_node_id") == c("nt"), "left_semi")
    contain = lambda: entry(held(), "containment", "id", F.lit(9), {"id": c("id"), "parentNodeId": c("source_node_id"), "childNodeId": c("target_node_id"), "kind": c("kind")})
    touches = (c("source_project_id") == target["nodeId"]) | (c("target_project_id") == target["nodeId"]) if target["kind"] == "project" else F.lit(True)
    pd = lambda: k.project_dependencies.where(c("source_project_id").isin(project_ids) & c("target_project_id").isin(project_ids) & touches)
    projects = lambda: entry(pd(), "projectDependencies", "id", F.lit(0 if target["kind"] == "project" else 6), {"id": c("id"), "sourceProjectId": c("source_project_id"), "targetProjectId": c("target_project_id"), "dependencyCount": c("dependency_count"), "typeOnlyDependencyCount": c("type_only_dependency_count")})
    made = dict(zip(COLLECTIONS, (deps, binds, outs, contain, projects), strict=True))
    return reduce(DataFrame.unionByName, [made[name]().withColumn("body", F.to_json("body", {"ignoreNullFields": "false"})) for name in collections])


def excerpt_requests(target: dict, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, lo, hi, reason, symbol_id, mandatory, priority."""
    c = F.col
    row = lambda t, lo, hi, reason, symbol, mandatory, priority: t.select("file_id", F.lit(lo).alias("lo") if isinstance(lo, int) else lo.alias("lo"), F.lit(hi).alias("hi") if isinstance(hi, int) else hi.alias("hi"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), symbol.cast("string").alias("symbol_id"), F.lit(mandatory).alias("mandatory"), (priority if isinstance(priority, Column) else F.lit(priority)).alias("priority"))
    lo, hi, none = F.greatest(F.lit(1), c("location.start_line") - AROUND), c("location.end_line") + AROUND, F.lit(None)
    if target["kind"] == "symbol":
        return row(symbols.where(c("symbol_id") == target["symbolId"]), lo, hi, "target-symbol", c("symbol_id"), True, 0)
    if target["kind"] == "file":
        own, bound = c("file_id") == target["fileId"], F.array_contains("reasons", "bound-symbol")
        grade = F.when(own, F.when(c("exported"), 1).otherwise(2)).when(bound, 3).when(c("exported"), 4).otherwise(5)
        parts = [row(files.where(own), 1, HEAD_LINES, "target-file-header", none, True, 0), row(symbols, lo, hi, F.when(bound, "bound-symbol").otherwise("exported-symbol"), c("symbol_id"), False, grade), row(files.where(~own), 1, HEAD_LINES, "dependency-entry-point", none, False, 6)]
    else:
        has = lambda r: F.array_contains("reasons", r)
        whole = has("project-public-symbol") | has("direct-dependency") | has("direct-dependent") if target["kind"] == "project" else F.size("public_symbol_ids") > 0
        reason = F.when(has("project-public-symbol"), "project-entry-point").otherwise("dependency-entry-point") if target["kind"] == "project" else F.lit("dependency-entry-point")
        parts = [row(symbols, lo, hi, "exported-symbol", c("symbol_id"), False, F.when(c("exported"), 1).otherwise(2)), row(files.where(whole), 1, HEAD_LINES, reason, none, False, 5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_requests(requests: DataFrame) -> DataFrame:
    """Requests of a file that overlap or nearly touch, as one."""
    ranked = requests.withColumn("__r", rank_of(F.col("reason"), EXCERPT_REASONS))
    islands = merged_ranges(ranked, ["file_id"], "lo", "hi", ["__r", "symbol_id"], GAP)
    return islands.groupBy("file_id", "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), in_order(F.collect_set("reason"), EXCERPT_REASONS).alias("reasons"), F.array_sort(F.collect_set("symbol_id")).alias("symbol_ids"), F.min("priority").alias("priority"), F.max("mandatory").alias("mandatory")
    )


def _utf16(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def truncate_text(text: str, most: int) -> str:
    """At most `most` UTF-16 units of a text: its head and tail around a marker, no pair split (half a pair is left out)."""
    units = text.encode("utf-16-le", "surrogatepass")
    if len(units) <= 2 * most:
        return text
    part = lambda start, stop: units[2 * start : 2 * stop].decode("utf-16-le", "ignore")
    room = most - _utf16(MARKER)
    if room <= 0:
        return part(0, most)
    head, size = int(room * HEAD_SHARE), len(units) // 2
    return part(0, head) + MARKER + part(size - room + head, size)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_id(value) -> str:
    """The id of a value: SHA-256 of its canonical JSON."""
    return _sha(canonical_json(value))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _source_lines(r, source: dict) -> list[str] | str:
    """The lines of a requested file, or the reason to leave it out. A source that is not the scanned file is an error, and so is a target without one."""
    raw, path = source.get("content"), r["relative_path"]
    text = None if raw is None else bytes(raw).decode("utf-8", "replace")
    if text is not None:
        hashes = {source.get("content_hash", r["content_hash"]), _sha(text)}
        for wrong, code, what in (
            (_plain(source.get("relative_path", path)) != path, "SOURCE_FILE_MISMATCH", "a mismatched file identity"),
            (_utf16(text) > SAFETY_CEILING, "SOURCE_TOO_LARGE", "a file above the safety ceiling"),
            (hashes != {r["content_hash"]}, "SOURCE_HASH_MISMATCH", "content with a mismatched hash"),
        ):
            if wrong:
                raise ContextError(code, f"Source provider returned {what}.")
        if "\0" not in text:
            return re.split(r"\r\n|\n|\r", text)
    reason, word = ("SOURCE_UNAVAILABLE", "unavailable") if text is None else ("BINARY_FILE", "binary")
    if r["mandatory"]:
        raise ContextError("SOURCE_FILE_MISMATCH", f"Mandatory target source is {word}: {path}.")
    return reason


def _excerpt(r, lines: list[str], most: int, left: int) -> tuple[dict | None, list[str]]:
    """The excerpt that a request gets within its own limit and what is left of the budget, and the limits it met."""
    first, last = min(r["lo"], len(lines)), min(r["hi"], len(lines))
    text, met = "\n".join(lines[first - 1 : last]), []
    if _utf16(text) > most:
        text = truncate_text(text, most)
        met.append("EXCERPT_CHARACTER_LIMIT")
    if _utf16(text) > left:
        met.append("TOTAL_SOURCE_CHARACTER_LIMIT")
        if left < LEAST_REST:
            return None, met
        text = truncate_text(text, left)
    reasons, symbols = list(r["reasons"]), list(r["symbol_ids"])
    return {
        "id": json_id([r["file_id"], first, last, reasons, symbols, text]), "fileId": r["file_id"], "relativePath": r["relative_path"], "contentHash": r["content_hash"], "startLine": first, "endLine": last, "startCharacter": 0,
        "endCharacter": _utf16(lines[last - 1]), "text": text, "reasons": reasons, "symbolIds": symbols, "truncated": bool(met),
    }, met


def _excerpts(ranked: list, contents: dict, options: dict, omit) -> list[dict]:
    """Keeps the running budget; ranked requests in order, sources by file id (without content: not readable)."""
    out: list[dict] = []
    found: dict[str, list[str] | str] = {}
    left = options["maxTotalSourceCharacters"]
    for at, r in enumerate(ranked):
        if len(out) == options["maxExcerpts"]:
            omit("EXCERPT_LIMIT", "excerpt", len(ranked) - at)
            break
        f = r["file_id"]
        if f not in found:
            found[f] = _source_lines(r, contents.get(f) or {})
            if isinstance(found[f], str):
                omit(found[f], "source", 1, f)
        if isinstance(found[f], str):
            continue
        made, met = _excerpt(r, found[f], options["maxExcerptCharacters"], left)
        for reason in met:
            omit(reason, "excerpt", 1)
        if made is not None:
            out.append(made)
            left -= _utf16(made["text"])
    return sorted(out, key=lambda e: (e["relativePath"], e["startLine"], e["endLine"], e["id"]))


def external_modules(external: DataFrame, files: DataFrame) -> DataFrame:
    """External references of some files by specifier: f (file ids) and e (ids of their imports and exports), sorted."""
    ext = external.join(files.select(F.col("file_id").alias("__f")), F.col("source_file_id") == F.col("__f"), "left_semi")
    entities = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("import_ids", "export_ids")))))
    return ext.groupBy("source_specifier", "type_only").agg(F.array_sort(F.collect_set("source_file_id")).alias("f"), entities.alias("e"))


def check_stages(s: Stages) -> None:
    """The stages must be of one repository, and the model whole. The error's code names the stages that differ."""
    names = ("SCAN_ANALYSIS_MISMATCH", "SCAN_RESOLUTION_MISMATCH", "SCAN_KNOWLEDGE_MISMATCH")
    for code, root in zip(names, s.roots[1:], strict=False):
        if root != s.roots[0]:
            raise ContextError(code, f"Stages are of different roots: {s.roots[0]} and {root}.")
    k, r = s.knowledge, s.resolution
    if isinstance(k, Model):
        # its nodes are made of the scan, and it has refused parsed files that were not scanned
        k.check_ends()
        return
    scanned = s.scan_files.select(F.col("id").alias("__s"))
    placed = r.imports.select("source_file_id").unionByName(r.exports.select("source_file_id")).unionByName(r.dependencies.select("source_file_id")).unionByName(r.dependencies.select(F.col("target_file_id").alias("source_file_id")))
    for table, column, code, what in ((s.parsed_files, "file_id", names[0], "Analysis"), (placed, "source_file_id", names[1], "Resolution"), (k.files, "file_id", names[2], "Knowledge")):
        refuse(table.select(column).distinct().join(scanned, F.col(column) == F.col("__s"), "left_anti"), ContextError, code, f"{what} references a file absent from the scan", column)
    refuse(k.symbols.join(k.files.select(F.col("file_id").alias("__k")), F.col("file_id") == F.col("__k"), "left_anti"), ContextError, names[2], "Knowledge symbol references a missing file", "symbol_id")
    nodes = reduce(DataFrame.union, [t.select(F.col("id").alias("__n")) for t in (k.repository, k.projects, k.folders, k.files, k.symbols)])
    ends = k.relations.select("id", F.explode(F.array("source_node_id", "target_node_id")).alias("end"))
    refuse(ends.join(nodes, F.col("end") == F.col("__n"), "left_anti"), ContextError, "KNOWLEDGE_RELATION_INVALID", "Knowledge relation has a missing endpoint", "id")


def build_context(s: Stages, target: dict, options: dict | None = None, contents: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """A context package as plain values.

    `contents` has id and content (binary) of the scanned files, or gives them for the files asked for (id,
    relative_path, absolute_path, content_hash); it may say relative_path and content_hash too, which are then checked.
    """
    chosen = checked_options(options)
    check_stages(s)
    k = s.knowledge
    at = resolve_target(k, target)
    candidates = checkpointed(file_candidates(s, at, chosen))
    files = checkpointed(first_rows(candidates, file_order(), chosen["maxFiles"]))
    if at["fileId"] and files.where(F.col("file_id") == at["fileId"]).isEmpty():
        raise ContextError("CONTEXT_LIMIT_TOO_SMALL", "The file limit cannot contain mandatory context entities.")
    more = checkpointed(symbol_candidates(s, at, files))
    symbols = checkpointed(first_rows(more, symbol_order(), chosen["maxSymbols"]))
    if at["symbolId"] and symbols.where(F.col("symbol_id") == at["symbolId"]).isEmpty():
        raise ContextError("CONTEXT_LIMIT_TOO_SMALL", "The symbol limit cannot contain the target symbol.")
    file_rows, symbol_rows = files.orderBy("place").collect(), _symbols_of(k, symbols).orderBy("place").collect()
    project_ids = {r["project_id"] for r in file_rows if r["project_id"]} | ({at["projectId"]} if at["projectId"] else set())
    if at["kind"] == "project":
        touching = (k.project_pairs if isinstance(k, Model) else k.project_dependencies).where((F.col("source_project_id") == at["nodeId"]) | (F.col("target_project_id") == at["nodeId"]))
        project_ids |= {x for r in touching.select("source_project_id", "target_project_id").collect() for x in r}
    related = checkpointed(relation_candidates(s, at, files, symbols, sorted(project_ids)))
    kept = related.orderBy("priority", "collection", "id").limit(chosen["maxRelations"]).collect()
    bodies: dict[str, list] = {c: [] for c in ("fileDependencies", "symbolBindings", "exports", "containment", "projectDependencies")}
    for r in kept:
        bodies[r["collection"]].append(json.loads(r["body"]))
    omissions: dict[tuple, int] = {}

    def omit(reason: str, kind: str, n: int, entity: str | None = None) -> None:
        if n > 0:
            omissions[reason, kind, entity] = omissions.get((reason, kind, entity), 0) + n

    n_candidates, n_symbols, n_related = candidates.count(), more.count(), related.count()
    omit("FILE_LIMIT", "file", n_candidates - len(file_rows))
    omit("SYMBOL_LIMIT", "symbol", n_symbols - len(symbol_rows))
    omit("RELATION_LIMIT", "relation", n_related - len(kept))

    chains = files.where("folder_id IS NOT NULL").select(F.explode(F.expr("transform(sequence(1, size(split(relative_path, '/')) - 1), n -> array_join(slice(split(relative_path, '/'), 1, n), '/'))")).alias("relative_path")).distinct()
    wanted = k.folders.join(chains, "relative_path", "left_semi").select("id")
    if at["kind"] == "folder":
        top = at["relativePath"]
        depth = F.size(F.split("relative_path", "/")) - len(top.split("/"))
        near = F.col("relative_path").startswith(top + "/") & (depth <= chosen["folderDepth"])
        above = ["/".join(top.split("/")[:n]) for n in range(1, len(top.split("/")) + 1)]
        wanted = wanted.union(k.folders.where(near | F.col("relative_path").isin(above)).select("id")).distinct()
    folder_rows = k.folders.join(wanted, "id", "left_semi").orderBy("relative_path").collect()
    project_rows = _projects_of(k, sorted(project_ids)).orderBy("root_relative_path", "name").collect() if project_ids else []

    excerpts: list[dict] = []
    if chosen["includeSource"]:
        if contents is None:
            raise ContextError("SOURCE_PROVIDER_REQUIRED", "A source provider is required when source excerpts are enabled.")
        facts = files.select(F.col("file_id").alias("__f"), "relative_path", "content_hash")
        # a request for each selected symbol and file at most: the options' ceilings bound them
        ranked = merged_requests(excerpt_requests(at, files, symbols)).join(facts, F.col("file_id") == F.col("__f")).orderBy("priority", "relative_path", "lo", "hi").collect()
        need = files.select(F.col("file_id").alias("__f"))
        asked = s.scan_files.join(need, F.col("id") == F.col("__f"), "left_semi")
        given = contents(asked.select("id", "relative_path", "absolute_path", "content_hash")) if callable(contents) else contents.join(need, F.col("id") == F.col("__f"), "left_semi")
        said = [c for c in ("relative_path", "content_hash") if c in given.columns]
        sources = {r["id"]: r.asDict() for r in given.select("id", "content", *said).toLocalIterator()}
        excerpts = _excerpts(ranked, sources, chosen, omit)
    else:
        omit("SOURCE_DISABLED", "source", len(file_rows))

    notes: dict[str, list] = {}
    if chosen["includeDiagnostics"]:
        for r in s.diagnostics.join(files.select(F.col("file_id").alias("__f")), F.col("file_id") == F.col("__f"), "left_semi").orderBy("code", "message").collect():
            notes.setdefault(r["file_id"], []).append({"fileId": r["file_id"], "severity": r["severity"], "code": r["code"], "message": r["message"], "location": _location(r["location"])})
    modules = []
    if chosen["includeExternalDependencies"]:
        grouped = external_modules(s.resolution.external, F.broadcast(files))
        modules = [{"sourceSpecifier": r["source_specifier"], "sourceFileIds": r["f"], "typeOnly": r["type_only"], "contributingEntityIds": r["e"]} for r in grouped.orderBy("source_specifier", "type_only").collect()]

    repo = k.repository.select("id", "name").first()
    counts = {name: table.count() for name, table in (("project_count", k.projects), ("file_count", k.files), ("symbol_count", k.symbols))}
    out_files = [_file(r) | {"diagnostics": notes.get(r["file_id"], []), "selectionReasons": list(r["reasons"])} for r in file_rows]
    out_symbols = [_symbol(r) | {"selectionReasons": list(r["reasons"])} for r in symbol_rows]
    listed = [{"reason": r, "entityKind": kind, "entityId": e, "count": n, "details": None} for (r, kind, e), n in sorted(omissions.items(), key=lambda x: (x[0][0], x[0][1], x[0][2] or ""))]
    base = {
        "schemaVersion": "1",
        "target": at,
        "repository": {"nodeId": repo["id"], "name": repo["name"], "projectCount": counts["project_count"], "fileCount": counts["file_count"], "symbolCount": counts["symbol_count"]},
        "hierarchy": {"repositoryId": repo["id"], "projectIds": [r["id"] for r in project_rows], "folderIds": [r["id"] for r in folder_rows], "fileIds": [r["file_id"] for r in file_rows], "symbolIds": [r["symbol_id"] for r in symbol_rows]},
        "entities": {"projects": [_project(r) for r in project_rows], "folders": [_folder(r) for r in folder_rows], "files": out_files, "symbols": out_symbols, "externalModules": modules},
        "relationships": bodies,
        "excerpts": excerpts,
        "omissions": listed,
        "metrics": {"sourceCharacterCount": sum(_utf16(e["text"]) for e in excerpts), "fileCount": len(out_files), "symbolCount": len(out_symbols), "relationCount": len(kept), "excerptCount": len(excerpts), "projectCount": len(project_rows), "folderCount": len(folder_rows), "externalModuleCount": len(modules)},
        "selection": {
            "requestedTarget": target, "resolvedTargetNodeId": at["nodeId"], "options": chosen, "selectedFileCount": len(out_files), "selectedSymbolCount": len(out_symbols), "selectedRelationCount": len(kept), "selectedExcerptCount": len(excerpts),
            "omittedFileCount": n_candidates - len(out_files), "omittedSymbolCount": n_symbols - len(out_symbols), "omittedRelationCount": n_related - len(kept), "omittedExcerptCount": sum(n for (_, kind, _), n in omissions.items() if kind == "excerpt"),
        },
    }
    identity = {"version": "context:v1", "repository": repo["id"], "target": {"kind": at["kind"], "nodeId": at["nodeId"]}, "options": chosen, "hashes": [[r["file_id"], r["content_hash"]] for r in file_rows] if chosen["includeSource"] else []}
    return base | {"id": json_id(identity)}


def _symbols_of(k: Knowledge | Model, symbols: DataFrame) -> DataFrame:
    return k.symbols_of(symbols) if isinstance(k, Model) else symbols.withColumn("incoming_bindings", F.size("incoming_binding_ids"))


def _projects_of(k: Knowledge | Model, ids: list[str]) -> DataFrame:
    if isinstance(k, Model):
        return k.projects_of(ids)
    return k.projects.where(F.col("id").isin(ids)).withColumns({name: F.size(f"{name}_project_dependency_ids") for name in ("incoming", "outgoing")})


def _location(x):
    return None if x is None else {"startLine": x["start_line"], "startColumn": x["start_column"], "endLine": x["end_line"], "endColumn": x["end_column"]}


def _project(r) -> dict:
    return {"nodeId": r["id"], "name": r["name"], "projectKind": r["project_kind"], "rootRelativePath": r["root_relative_path"], "sourceRootRelativePath": r["source_root_relative_path"], "publicSymbolIds": sorted(r["public_symbol_ids"]), "incomingProjectDependencyCount": r["incoming"], "outgoingProjectDependencyCount": r["outgoing"]}


def _folder(r) -> dict:
    return {"nodeId": r["id"], "relativePath": r["relative_path"], "projectId": r["project_id"], "parentFolderId": r["parent_folder_id"], "descendantFileCount": r["descendant_file_count"], "descendantSymbolCount": r["descendant_symbol_count"]}


def _file(r) -> dict:
    return {
        "nodeId": r["id"], "fileId": r["file_id"], "relativePath": r["relative_path"], "projectId": r["project_id"], "folderId": r["folder_id"], "language": r["language"], "status": r["status"], "contentHash": r["content_hash"],
        "symbolIds": sorted(r["symbol_ids"]), "publicSymbolIds": sorted(r["public_symbol_ids"]), "importCount": r["import_count"], "exportCount": r["export_count"], "incomingInternalDependencyCount": r["incoming"],
        "outgoingInternalDependencyCount": r["outgoing"], "externalDependencyCount": r["external_dependency_count"], "diagnosticCount": r["diagnostic_count"], "hasSyntaxErrors": r["has_syntax_errors"],
    }


def _symbol(r) -> dict:
    return {
        "nodeId": r["id"], "symbolId": r["symbol_id"], "fileId": r["file_id"], "name": r["name"], "qualifiedName": r["qualified_name"], "symbolKind": r["symbol_kind"], "exported": r["exported"], "defaultExport": r["default_export"], "typeOnly": r["type_only"],
        "async": r["async"], "parentSymbolId": r["parent_symbol_id"], "childSymbolIds": sorted(r["child_symbol_ids"]), "incomingBindingCount": r["incoming_bindings"], "location": _location(r["location"]),
    }
