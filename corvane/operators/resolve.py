"""Module resolution: targets, effective exports, edges, bindings, external and unresolved references."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.ids import nul_id
from corvane.functions.order import human, uni
from corvane.functions.paths import dirname, extname, normalize
from corvane.functions.tables import checkpointed, refuse, refuse_repeated, stored
from corvane.operators.cycles import dependency_cycles
from corvane.schemas import ALIASES, ResolverInputError

#: Source extensions in the order they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
_ALIAS = re.compile(r"@?[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*")
#: Export statements of files that re-export in a circle, or from one, that the driver evaluates.
MOST_CIRCULAR = 500_000
#: Rows of a list that goes to all tasks.
MOST_SENT = 20_000
#: What a file offers under a name that several statements give: ambiguous, without an origin.
_CLASH = (True, None, None, None, None)
EFFECTIVE = "file_id string, name string, ambiguous boolean, immediate_export_id string, origin_file_id string, origin_export_id string, symbol_id string"


@dataclass
class Resolution:
    imports: DataFrame
    exports: DataFrame
    dependencies: DataFrame
    external: DataFrame
    bindings: DataFrame
    unresolved: DataFrame
    effective: DataFrame

    def cycles(self, parsed_files: DataFrame, most_nodes: int | None = None) -> DataFrame:
        return dependency_cycles(self.dependencies, parsed_files, most_nodes)

    def modules(self, parsed_files: DataFrame) -> DataFrame:
        """Per parsed file, its edges' ids both ways."""
        ins = self.dependencies.groupBy(F.col("target_file_id").alias("f")).agg(F.array_sort(F.collect_list("id")).alias("incoming_dependency_ids"))
        outs = self.dependencies.groupBy(F.col("source_file_id").alias("g")).agg(F.array_sort(F.collect_list("id")).alias("outgoing_dependency_ids"))
        none = F.array().cast("array<string>")
        return (
            parsed_files.select("file_id", "relative_path", "language")
            .join(ins, F.col("file_id") == F.col("f"), "left")
            .join(outs, F.col("file_id") == F.col("g"), "left")
            .select("file_id", "relative_path", "language", F.coalesce("incoming_dependency_ids", none).alias("incoming_dependency_ids"), F.coalesce("outgoing_dependency_ids", none).alias("outgoing_dependency_ids"))
        )


def checked_aliases(spark: SparkSession, aliases) -> DataFrame:
    """Aliases are workspace settings, a short list; each is checked on the driver."""
    rows = [(a[0], list(a[1])) for a in aliases]
    seen: set[str] = set()
    for alias, targets in rows:
        if not _ALIAS.fullmatch(alias) or not targets or alias in seen or any(t.startswith("/") or ".." in t.split("/") for t in targets):
            raise ResolverInputError("MALFORMED_WORKSPACE_ALIAS", f"Malformed workspace alias: {alias}.")
        seen.add(alias)
    return spark.createDataFrame(rows, ALIASES)


def check_stages(scan_files: DataFrame, parsed_files: DataFrame, symbols: DataFrame, imports: DataFrame | None, exports: DataFrame) -> None:
    """What the stages' tables must fulfil; without imports, what the others must."""
    pairs = scan_files.select("id", "relative_path").distinct()
    for key, code, text in (("id", "DUPLICATE_FILE_ID", "File ID has conflicting paths"), ("relative_path", "DUPLICATE_FILE_PATH", "Path has conflicting file IDs")):
        refuse_repeated(pairs, ResolverInputError, code, text, key)
    known = pairs.withColumnRenamed("relative_path", "p")
    refuse(parsed_files.join(known, (F.col("file_id") == F.col("id")) & (F.col("relative_path") == F.col("p")), "left_anti"), ResolverInputError, "UNKNOWN_ANALYSIS_FILE", "Analysis file is absent from the scan", "file_id")
    check_entities(symbols, exports, *([] if imports is None else [imports]))


def check_entities(*tables: DataFrame, many: bool = False) -> None:
    """An id stands for one symbol, import or export."""
    ids = reduce(DataFrame.unionAll, [t.select("id") for t in tables])
    refuse_repeated(ids, ResolverInputError, "DUPLICATE_ENTITY_ID", "Duplicate parser entity ID", "id", many)


def candidates(base) -> F.Column:
    """Paths to try for a base path, in order."""
    ext = extname(base)
    base = F.col(base) if isinstance(base, str) else base
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    swap = lambda exts: F.array(*[F.concat(stem, F.lit(e)) for e in exts])
    probe = F.array(base, *[F.concat(base, F.lit(e)) for e in EXTENSIONS], *[F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS])
    return F.when(ext == ".js", swap((".js", ".jsx", ".ts", ".tsx"))).when(ext == ".jsx", swap((".jsx", ".tsx"))).when(ext != "", F.array(base)).otherwise(probe)


def longest_prefix(requests: DataFrame, key: str, prefixes: DataFrame, prefix: str, whole_parts: bool = True) -> DataFrame:
    """Each distinct request with its longest matching prefix row, by an equi-join on the request's own prefixes."""
    parts = F.split(F.col(key), "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")) if whole_parts else F.transform(F.sequence(F.lit(1), F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))
    tried = requests.select(key).distinct().select(key, F.explode(own).alias("__prefix"))
    hits = tried.join(prefixes.withColumnRenamed(prefix, "__p"), F.col("__prefix") == F.col("__p"))
    best = hits.groupBy(key).agg(F.max_by(F.struct(*[c for c in hits.columns if c not in (key, "__prefix")]), F.length("__p")).alias("__hit"))
    return best.select(key, F.col("__hit.__p").alias(prefix), *[F.col(f"__hit.{c}").alias(c) for c in prefixes.columns if c != prefix])


def first_hit(requests: DataFrame, keys: list[str], places: str, table: DataFrame, path: str, value: str, at: str | None = None) -> DataFrame:
    """Per request the first of its candidate paths that the table has, its value, and the candidate's number from 0 on, if `at` names it.

    The table grows with the repository and paths are wider than Spark's estimate of them, so it is merged, never sent to all tasks.
    """
    tried = requests.select(*keys, F.posexplode(places).alias("__at", "__try"))
    there = table.select(F.col(path).alias("__path"), F.col(value).alias("__value")).hint("merge")
    number = [F.min("__at").cast("long").alias(at)] if at else []
    return tried.join(there, F.col("__try") == F.col("__path")).groupBy(*keys).agg(F.min_by("__value", "__at").alias(value), *number)


def _bad(source) -> F.Column:
    return (source == "") | source.contains("\\") | source.contains("\0") | source.startswith("/")


def _relative(source) -> F.Column:
    return source.isin(".", "..") | source.startswith("./") | source.startswith("../")


def source_kinds(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """The rows with their source's kind, and the alias that its longest prefix names: what the source alone tells."""
    s = F.col("source")
    best = longest_prefix(asked, "source", aliases, "alias").withColumnRenamed("source", "__s")
    scopes = aliases.where(F.col("alias").startswith("@")).select(F.split("alias", "/")[0].alias("__scope")).distinct()
    asked = asked.join(best, s == F.col("__s"), "left").join(scopes, F.split(s, "/")[0] == F.col("__scope"), "left")
    known = F.col("alias").isNotNull() | F.col("__scope").isNotNull()
    far = F.when(s.startswith("."), "relative").otherwise("unsupported")
    return asked.withColumn("kind", F.when(_bad(s), "unsupported").when(extname("source").isin(".mjs", ".cjs"), far).when(_relative(s), "relative").when(known, "workspace").otherwise("external"))


def module_targets(references: DataFrame, scan_files: DataFrame, parsed_files: DataFrame, aliases: DataFrame) -> DataFrame:
    """folder, source -> kind, target_file_id, reason, once for each distinct pair: files of a folder mean the same by a specifier."""
    asked = references.select("folder", "source").where("folder IS NOT NULL AND source IS NOT NULL").distinct()
    s = F.col("source")
    asked = source_kinds(asked, aliases)
    bad, relative = _bad(s), _relative(s)
    unsupported = bad | extname("source").isin(".mjs", ".cjs")
    local = normalize(F.concat(F.col("folder"), F.lit("/"), s))
    sub = F.when(s == F.col("alias"), "").otherwise(F.substring(s, F.length("alias") + 2, F.length(s)))
    bases = F.transform("target_relative_paths", lambda t: F.when(sub == "", t).otherwise(normalize(F.concat(F.coalesce(dirname(t), F.lit(".")), F.lit("/"), sub))))
    placed = asked.withColumns(
        {
            "bases": F.when(unsupported, F.lit(None)).when(relative, F.array(local)).otherwise(bases),
        }
    )
    escapes = (F.col("kind") == "relative") & ~unsupported & (F.col("bases")[0].isin("..", "../") | F.col("bases")[0].startswith("../"))
    placed = placed.withColumn("early", F.when(unsupported, "UNSUPPORTED_SPECIFIER").when(escapes, "PATH_ESCAPES_REPOSITORY").when((F.col("kind") == "workspace") & F.col("alias").isNull(), "WORKSPACE_ALIAS_NOT_FOUND"))
    # written, as Spark would otherwise work the paths out anew wherever a filter or an explosion names them
    placed = checkpointed(placed.select("folder", "source", "kind", "early", "bases"))
    # many folders reach one base: its candidates are looked up once
    open_ = checkpointed(placed.where("early IS NULL AND bases IS NOT NULL").select("bases").distinct().select("bases", F.flatten(F.transform("bases", candidates)).alias("tries")))
    parsed = first_hit(open_, ["bases"], "tries", parsed_files.select("relative_path", F.col("file_id").alias("target_file_id")), "relative_path", "target_file_id")
    seen = open_.select("bases", F.explode("tries").alias("t")).join(scan_files.select("relative_path"), F.col("t") == F.col("relative_path")).select("bases").distinct().withColumn("scanned", F.lit(True))
    tried = F.when(F.col("early").isNull(), F.col("bases")).alias("bases")
    found = placed.select("folder", "source", "kind", "early", tried).join(parsed, ["bases"], "left").join(seen, ["bases"], "left")
    late = F.when(F.col("target_file_id").isNull() & (F.col("kind") != "external"), F.when(F.col("scanned"), "TARGET_NOT_PARSED").otherwise("MODULE_NOT_FOUND"))
    return found.select("folder", "source", "kind", "target_file_id", F.coalesce("early", late).alias("reason"))


_ORDER = ["location.start_line", "location.start_column", "id"]


def _explicit(items: DataFrame, effective: DataFrame) -> DataFrame:
    """Effective rows of named exports, local ones and re-exports whose targets' rows are known."""
    theirs = effective.select(F.col("file_id").alias("__tf"), F.col("name").alias("__tn"), F.col("ambiguous").alias("__amb"), F.col("origin_file_id").alias("__of"), F.col("origin_export_id").alias("__oe"), F.col("symbol_id").alias("__sy"))
    local = F.col("source").isNull()
    seen = items.join(theirs, ~local & (F.col("target_file_id") == F.col("__tf")) & (F.coalesce("local_name", "exported_name") == F.col("__tn")), "left")
    sets = local | (F.col("__tf").isNotNull() & ~F.col("__amb"))
    row = F.struct(F.col("id").alias("i"), F.when(local, F.col("file_id")).otherwise(F.col("__of")).alias("f"), F.when(local, F.col("id")).otherwise(F.col("__oe")).alias("e"), F.when(local, F.col("symbol_id")).otherwise(F.col("__sy")).alias("s"))
    # of statements with one name the last that resolves counts
    last = F.max_by(F.when(sets, row), F.when(sets, F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(_ORDER)])))
    return (
        seen.groupBy("file_id", F.col("exported_name").alias("name")).agg(F.max(F.coalesce(F.col("__amb") & ~local, F.lit(False))).alias("ambiguous"), last.alias("r"))
        .where("ambiguous OR r IS NOT NULL")
        .select("file_id", "name", "ambiguous", F.col("r.i").alias("immediate_export_id"), F.col("r.f").alias("origin_file_id"), F.col("r.e").alias("origin_export_id"), F.col("r.s").alias("symbol_id"))
    )


def _stars(stars: DataFrame, named: DataFrame, effective: DataFrame) -> DataFrame:
    """Effective rows that export-all statements add: names exposed by exactly one of them, or ambiguous."""
    theirs = effective.where("name <> 'default'").withColumnRenamed("file_id", "__tf")
    shown = stars.select("id", "file_id", "target_file_id").join(theirs, F.col("target_file_id") == F.col("__tf"))
    names = named.select(F.col("file_id").alias("__nf"), F.col("exported_name").alias("__nn")).distinct()
    shown = shown.join(names, (F.col("file_id") == F.col("__nf")) & (F.col("name") == F.col("__nn")), "left_anti")
    one = F.first(F.struct("id", "origin_file_id", "origin_export_id", "symbol_id"))
    return (
        shown.groupBy("file_id", "name").agg((F.max("ambiguous") | (F.count(F.lit(1)) > 1)).alias("ambiguous"), one.alias("r"))
        .select("file_id", "name", "ambiguous", *[F.when(~F.col("ambiguous"), F.col(f"r.{c}")).alias(a) for c, a in (("id", "immediate_export_id"), ("origin_file_id",) * 2, ("origin_export_id",) * 2, ("symbol_id",) * 2)])
    )


def effective_exports(exports: DataFrame, parsed_files: DataFrame, calls: DataFrame | Callable[[], DataFrame] | None = None) -> DataFrame:
    """What each file offers by name. `exports` carries target_file_id (null: not resolved).

    Files are evaluated when all files they re-export from are: a round for each step of re-export depth.
    Files that re-export in a circle, and those that lead into one, are left; an in-progress file offers nothing
    and partial answers are kept, so these are evaluated one by one in the order of `calls` (file_id, rank; or what gives it).
    """
    spark = exports.sparkSession
    exports = checkpointed(exports.where("source IS NULL OR target_file_id IS NOT NULL"))
    needs = checkpointed(exports.where("source IS NOT NULL").select("file_id", F.col("target_file_id").alias("need")).where("need IS NOT NULL").distinct())
    pending = checkpointed(parsed_files.select("file_id").distinct())
    done = spark.createDataFrame([], EFFECTIVE)
    left = pending.count()
    while left:
        blocked = needs.join(pending.withColumnRenamed("file_id", "p"), F.col("need") == F.col("p"), "left_semi").select("file_id").distinct()
        ready = checkpointed(pending.join(blocked, "file_id", "left_anti"))
        n = ready.count()
        if not n:
            break
        mine = exports.join(ready, "file_id", "left_semi")
        named = mine.where("kind <> 'export-all'")
        new = _explicit(named, done).unionByName(_stars(mine.where("kind = 'export-all' AND source IS NOT NULL"), named, done))
        done = checkpointed(done.unionByName(new))
        pending = checkpointed(pending.join(ready, "file_id", "left_anti"))
        left -= n
    if left:
        done = done.unionByName(_circular(exports, pending, done, calls() if callable(calls) else calls, parsed_files))
    return done


def _circular(exports: DataFrame, pending: DataFrame, done: DataFrame, calls: DataFrame | None, parsed_files: DataFrame) -> DataFrame:
    """The files left by the rounds, on the driver: circles of re-exports and what leads into them, MOST_CIRCULAR statements at most."""
    spark = exports.sparkSession
    rows = exports.join(pending, "file_id", "left_semi").orderBy(*_ORDER).limit(MOST_CIRCULAR + 1).collect()
    if len(rows) > MOST_CIRCULAR:
        raise ResolverInputError("CIRCULAR_EXPORTS_TOO_LARGE", f"More than {MOST_CIRCULAR} exports lead into circles of re-exports.")
    outside = exports.join(pending, "file_id", "left_semi").select("target_file_id").distinct().join(pending, F.col("target_file_id") == F.col("file_id"), "left_anti").select("target_file_id")
    offers: dict[str, dict[str, tuple]] = {}
    for r in done.join(outside.withColumnRenamed("target_file_id", "o"), F.col("file_id") == F.col("o"), "left_semi").collect():
        offers.setdefault(r["file_id"], {})[r["name"]] = (r["ambiguous"], r["immediate_export_id"], r["origin_file_id"], r["origin_export_id"], r["symbol_id"])
    by_file: dict[str, list] = {}
    for r in rows:
        by_file.setdefault(r["file_id"], []).append(r)
    waiting = {r["file_id"] for r in pending.collect()}
    busy: set[str] = set()

    def answer(file: str):
        """A generator that yields the files it needs, is sent what they offer, and returns what the file offers."""
        if file in offers:
            return offers[file]
        if file in busy or file not in waiting:
            return {}
        busy.add(file)
        out: dict[str, tuple] = {}
        statements = by_file.get(file, [])
        own = {r["exported_name"] for r in statements if r["kind"] != "export-all"}
        for r in statements:
            if r["kind"] == "export-all":
                continue
            name = r["exported_name"]
            if r["source"] is None:
                origin = (file, r["id"], r["symbol_id"])
            else:
                theirs = yield r["target_file_id"]
                found = theirs.get(r["local_name"] or name)
                if found is None:
                    continue
                if found[0]:
                    out[name] = _CLASH
                    continue
                origin = found[2:]
            out[name] = (name in out and out[name][0], r["id"], *origin)
        for r in statements:
            if r["kind"] != "export-all" or r["source"] is None:
                continue
            theirs = yield r["target_file_id"]
            for name, found in theirs.items():
                if name != "default" and name not in own:
                    out[name] = _CLASH if found[0] or name in out else (False, r["id"], *found[2:])
        busy.discard(file)
        offers[file] = out
        return out

    def ask(file: str) -> None:
        # a stack of its own: re-exports may be nested deeper than calls can
        stack, got = [answer(file)], None
        while stack:
            try:
                stack.append(answer(stack[-1].send(got)))
                got = None
            except StopIteration as done:
                stack.pop()
                got = done.value

    order = calls.join(pending, "file_id", "left_semi").groupBy("file_id").agg(F.min("rank").alias("rank")).orderBy("rank").collect() if calls is not None else []
    first = [r["file_id"] for r in order]
    rest = [r["file_id"] for r in parsed_files.join(pending, "file_id", "left_semi").orderBy(*human("relative_path")).collect()]
    for file in [*first, *rest]:
        ask(file)
    found = [(f, name, *row) for f in waiting for name, row in offers.get(f, {}).items()]
    return spark.createDataFrame(found, EFFECTIVE)


def dependency_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges with their ids; needs source_file_id, target_file_id, kind, source_specifier, type_only."""
    parts = ["source_file_id", "target_file_id", "source_specifier", "kind", "type_only"]
    # distinct first: ids are made of, and shuffled with, the distinct rows only
    return _with_edge_ids(edges.select(*parts).distinct())


def _with_edge_ids(edges: DataFrame) -> DataFrame:
    return edges.select(nul_id("dependency", *map(F.col, ("source_file_id", "target_file_id", "kind", "source_specifier", "type_only"))).alias("id"), "source_file_id", "target_file_id", "source_specifier", "kind", "type_only")


def external_groups(references: DataFrame) -> DataFrame:
    """One row for each file, specifier and type_only, with the ids of its imports and exports, sorted."""
    pick = lambda c: F.array_sort(F.collect_set(c))
    return references.groupBy("source_file_id", "source_specifier", "type_only").agg(pick("import_id").alias("import_ids"), pick("export_id").alias("export_ids"))


class Resolver:
    """A repository's references, resolved: each table of a `Resolution` is made when it is first asked for.

    The stages' checks come before the first table, those of the imports before the first that reads imports. `imports` is
    a table or gives it. With `keep` the imports' tables are checkpointed; without, they are made anew from the
    stages' tables each time, which takes no room: imports may be far more than all else.
    """

    def __init__(self, scan_files: DataFrame, parsed_files: DataFrame, symbols: DataFrame, imports: DataFrame | Callable[[], DataFrame], exports: DataFrame, aliases=(), keep: bool = False) -> None:
        self._scan, self._parsed, self._symbols, self._given, self._asked_exports = scan_files, parsed_files, symbols, imports, exports
        self._aliases = checked_aliases(scan_files.sparkSession, aliases)
        self._kept = keep
        self._keep, self._result = (checkpointed, checkpointed) if keep else (lambda t: t, stored)
        check_stages(scan_files, parsed_files, symbols, None, exports)

    @property
    def parsed_files(self) -> DataFrame:
        """The files that edges join: an edge's source has its folder from here, and its target is found here by path."""
        return self._parsed

    def check_imports(self) -> None:
        """The checks of the imports, once."""
        _ = self._asked

    @cached_property
    def _asked(self) -> DataFrame:
        given = self._given() if callable(self._given) else self._given
        check_entities(self._symbols, self._asked_exports, given, many=True)
        return given

    def _in_folders(self, references: DataFrame) -> DataFrame:
        # files are far fewer than what they import: their side is hashed, the other not sorted
        folders = self._parsed.select(F.col("file_id").alias("__pf"), F.coalesce(dirname("relative_path"), F.lit(".")).alias("folder")).hint("shuffle_hash")
        return references.join(folders, F.col("file_id") == F.col("__pf"), "left").drop("__pf")

    def _targets(self, references: DataFrame) -> DataFrame:
        return checkpointed(module_targets(references, self._scan, self._parsed, self._aliases)).withColumnsRenamed({"folder": "__rf", "source": "__rs", "kind": "source_kind"})

    @staticmethod
    def _to(table: DataFrame, targets: DataFrame) -> DataFrame:
        return table.join(targets, (F.col("folder") == F.col("__rf")) & (F.col("source") == F.col("__rs")), "left").drop("__rf", "__rs")

    @cached_property
    def _placed_exports(self) -> DataFrame:
        exports = self._in_folders(self._asked_exports)
        return checkpointed(self._to(exports, self._targets(exports)))

    @cached_property
    def _in_place(self) -> DataFrame:
        """Imports with their folder and the name they want."""
        wanted = F.when(F.col("kind") == "default", "default").when(F.col("kind") == "named", F.col("imported_name"))
        return self._keep(self._in_folders(self._asked).withColumn("sought", wanted))

    @cached_property
    def _asks(self) -> DataFrame:
        """What each import asks. Dealt by folder and source: questions, targets, answers and edges deal them no more."""
        narrow = self._in_place.select("folder", "source", "file_id", "sought", "kind", "type_only")
        return narrow if self._kept else stored(narrow, ("folder", "source"))

    @cached_property
    def _questions(self) -> DataFrame:
        """folder, source, sought, kind, n: what imports ask, and how many ask it."""
        return self._result(self._asks.groupBy("folder", "source", "sought", "kind").agg(F.count(F.lit(1)).alias("n")))

    @cached_property
    def _import_targets(self) -> DataFrame:
        return self._targets(self._questions)

    @cached_property
    def _placed_imports(self) -> DataFrame:
        return self._to(self._in_place, self._import_targets)

    def _calls(self) -> DataFrame:
        # who asks whom first matters only to re-export circles
        asks = self._placed_imports.where("kind IN ('default', 'named') AND target_file_id IS NOT NULL").select("file_id", "target_file_id", F.lit(0).alias("part"), "location", "id")
        asks = asks.unionByName(self._placed_exports.where("target_file_id IS NOT NULL").select("file_id", "target_file_id", F.lit(1).alias("part"), "location", "id"))
        place = asks.join(self._paths, F.col("file_id") == F.col("__pf"))
        rank = F.struct(uni("source_relative_path").alias("place"), "source_relative_path", "part", F.col("location.start_line").alias("line"), F.col("location.start_column").alias("column"), "id")
        return place.select(F.col("target_file_id").alias("file_id"), rank.alias("rank"))

    @cached_property
    def _paths(self) -> DataFrame:
        return self._parsed.select(F.col("file_id").alias("__pf"), F.col("relative_path").alias("source_relative_path"))

    @cached_property
    def effective(self) -> DataFrame:
        return checkpointed(effective_exports(self._placed_exports, self._parsed, self._calls))

    @property
    def _offer(self) -> DataFrame:
        return self.effective.withColumnsRenamed({"file_id": "__ef", "name": "__en", "symbol_id": "__es"})

    @cached_property
    def _answers(self) -> DataFrame:
        """What each folder's specifier and sought name lead to: asked once, however many imports ask it."""
        asked = self._questions.select("folder", "source", "sought").distinct()
        return checkpointed(self._to(asked, self._import_targets).join(self._offer, (F.col("target_file_id") == F.col("__ef")) & (F.col("sought") == F.col("__en")), "left"))

    def _answered(self, table: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        """A table of folder, source, sought and kind with the answers, status and why."""
        answers = (self._answers if answers is None else answers).withColumnsRenamed({"folder": "__af", "source": "__as", "sought": "__an"})
        same = F.col("folder").eqNullSafe(F.col("__af")) & F.col("source").eqNullSafe(F.col("__as")) & F.col("sought").eqNullSafe(F.col("__an"))
        whole = F.col("kind").isin("namespace", "side-effect")
        return table.join(answers, same, "left").drop("__af", "__as", "__an").withColumns(
            {
                "status": F.when(_outside(), "external").when(_missing(), "unresolved").when(whole, "resolved-module").when(_matched(), "resolved-symbol").otherwise("unresolved"),
                "why": F.when(_outside(), None).when(_missing(), F.coalesce("reason", F.lit("MODULE_NOT_FOUND"))).when(whole | _matched(), None).when(F.col("ambiguous"), "AMBIGUOUS_EXPORT").otherwise("EXPORT_NOT_FOUND"),
            }
        )

    @cached_property
    def _im(self) -> DataFrame:
        wanted = F.when(F.col("kind") == "default", "default").otherwise(F.col("imported_name"))
        return self._keep(self._answered(self._in_place).withColumn("wanted", wanted))

    @cached_property
    def _ex(self) -> DataFrame:
        original = F.coalesce("local_name", "exported_name")
        ex = self._placed_exports.withColumn("wanted", original).join(self._offer, (F.col("target_file_id") == F.col("__ef")) & (F.col("wanted") == F.col("__en")) & (F.col("kind") != "export-all"), "left")
        return checkpointed(
            ex.withColumns(
                {
                    "status": F.when(_local(), "local-symbol").when(_outside(), "external").when(_missing(), "unresolved").when(_star(), "resolved-export-all").when(_matched(), "resolved-re-export").otherwise("unresolved"),
                    "why": F.when(_local() | _outside(), None).when(_missing(), F.coalesce("reason", F.lit("MODULE_NOT_FOUND"))).when(_star() | _matched(), None).when(F.col("ambiguous"), "AMBIGUOUS_EXPORT").otherwise("EXPORT_NOT_FOUND"),
                }
            )
        )

    @cached_property
    def imports(self) -> DataFrame:
        return self._im.select(
            F.col("id").alias("import_id"), F.col("file_id").alias("source_file_id"), F.col("source").alias("source_specifier"), "source_kind", F.col("kind").alias("import_kind"), "type_only", "status", "target_file_id",
            F.when(F.col("status") == "resolved-symbol", F.col("immediate_export_id")).alias("target_export_id"), _symbol("resolved-symbol").alias("target_symbol_id"), "location",
        )

    def import_counts(self) -> DataFrame:
        """status, source_kind, import_kind -> imports, with_file, with_symbol: imports that ask the same are counted first, then answered."""
        total = lambda known: F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0))
        return (
            self._answered(self._questions).groupBy("status", "source_kind", F.col("kind").alias("import_kind"))
            .agg(F.sum("n").alias("imports"), total(F.col("target_file_id").isNotNull()).alias("with_file"), total(_symbol("resolved-symbol").isNotNull()).alias("with_symbol"))
        )

    @cached_property
    def binding_counts(self) -> DataFrame:
        """target_symbol_id, n: how many bindings lead to a symbol. Imports that ask the same are counted together: each has one binding, its own."""
        imported = self._answered(self._questions).where("status = 'resolved-symbol'").select("__es", "n")
        one = F.lit(1).cast("long").alias("n")
        again = self._ex.where("status = 'resolved-re-export'").select("__es", one).unionByName(self._exposed.select("__es", one))
        return checkpointed(imported.unionByName(again).groupBy(F.col("__es").alias("target_symbol_id")).agg(F.sum("n").alias("n")))

    @property
    def _exposed(self) -> DataFrame:
        """Names that export-all statements hand on."""
        stars = self._placed_exports.where("kind = 'export-all' AND source IS NOT NULL").drop("symbol_id")
        return stars.join(self._offer.where("NOT ambiguous AND __en <> 'default'"), F.col("target_file_id") == F.col("__ef"))

    @cached_property
    def exports(self) -> DataFrame:
        return self._ex.select(
            F.col("id").alias("export_id"), F.col("file_id").alias("source_file_id"), "exported_name", "type_only", F.col("symbol_id").alias("local_symbol_id"), "target_file_id",
            F.when(F.col("status") == "resolved-re-export", F.col("origin_export_id")).alias("target_export_id"),
            F.when(_local(), F.col("symbol_id")).otherwise(_symbol("resolved-re-export")).alias("target_symbol_id"), "status", "location",
        )

    @cached_property
    def _edges(self) -> DataFrame:
        """Distinct edges without ids."""
        parts = ["source_file_id", "target_file_id", "source_specifier", "kind", "type_only"]
        edge = lambda t, kind: t.where("target_file_id IS NOT NULL").select(F.col("file_id").alias("source_file_id"), "target_file_id", F.col("source").alias("source_specifier"), kind.alias("kind"), "type_only")
        # a file has one folder, and a folder's source one target: what is distinct before the target is known stays so
        asks = self._asks.where("folder IS NOT NULL AND source IS NOT NULL")
        asks = asks.select("folder", "source", "file_id", F.when(F.col("kind") == "side-effect", "side-effect-import").otherwise("import").alias("edge"), "type_only").distinct()
        imported = edge(self._to(asks, self._import_targets), F.col("edge"))
        exported = edge(self._placed_exports.where("source IS NOT NULL"), F.when(_star(), "export-all").otherwise("re-export")).distinct()
        return self._result(imported.unionByName(exported).select(parts))

    @cached_property
    def dependencies(self) -> DataFrame:
        return self._keep(_with_edge_ids(self._edges))

    @cached_property
    def external(self) -> DataFrame:
        ext = lambda t, i, e: t.select(F.col("file_id").alias("source_file_id"), F.col("source").alias("source_specifier"), "type_only", i.alias("import_id"), e.alias("export_id"))
        none = F.lit(None).cast("string")
        # that a source is external it tells alone: neither its folder nor its target is looked up
        far = lambda t: t.join(self._far, F.col("source") == F.col("__fs"), "left_semi").join(self._paths, F.col("file_id") == F.col("__pf"), "left_semi")
        return external_groups(ext(far(self._asked), F.col("id"), none).unionByName(ext(far(self._asked_exports), none, F.col("id"))))

    @cached_property
    def _far(self) -> DataFrame:
        """External sources of imports and exports."""
        every = self._asked.select("source").unionByName(self._asked_exports.select("source"))
        sources = checkpointed(every.where(~_relative(F.col("source"))).distinct())
        far = checkpointed(source_kinds(sources, self._aliases).where("kind = 'external'").select(F.col("source").alias("__fs")))
        return F.broadcast(far) if far.count() <= MOST_SENT else far

    @cached_property
    def bindings(self) -> DataFrame:
        return self._result(_bindings(self._im, self._ex, self._exposed))

    def edges_between(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """The dependencies of a few files (`file_id`) with others: their ids are made for these only."""
        few = lambda t, name: F.broadcast(t.select(F.col("file_id").alias(name)))
        return _with_edge_ids(self._edges.join(few(sources, "__a"), F.col("source_file_id") == F.col("__a"), "left_semi").join(few(targets, "__b"), F.col("target_file_id") == F.col("__b"), "left_semi"))

    def bindings_of(self, files: DataFrame) -> DataFrame:
        """The bindings of a few files (`file_id`): only what they import is looked up."""
        few = F.broadcast(files.select(F.col("file_id").alias("__few")))
        own = lambda t: t.join(few, F.col("file_id") == F.col("__few"), "left_semi")
        # answers are sent their few askers, who are made first
        asked = checkpointed(own(self._in_place))
        keys = asked.select("folder", "source", "sought").distinct()
        wanted = keys.withColumnsRenamed({"folder": "__qf", "source": "__qs", "sought": "__qn"})
        same = F.col("folder").eqNullSafe(F.col("__qf")) & F.col("source").eqNullSafe(F.col("__qs")) & F.col("sought").eqNullSafe(F.col("__qn"))
        answers = checkpointed(self._answers.join(F.broadcast(wanted), same, "left_semi"))
        imported = self._answered(asked, answers).withColumn("wanted", F.when(F.col("kind") == "default", "default").otherwise(F.col("imported_name")))
        return _bindings(imported, own(self._ex), own(self._exposed))

    @cached_property
    def unresolved(self) -> DataFrame:
        lost = lambda t, name: t.where("why IS NOT NULL").select("file_id", "id", "source", name.alias("imported_name"), "why")
        import_name = F.when(_missing(), F.col("imported_name")).otherwise(F.col("wanted"))
        gone = lost(self._im, import_name).unionByName(lost(self._ex, F.when(_star(), None).otherwise(F.col("wanted"))))
        return (
            gone.select(nul_id("unresolved", F.col("file_id"), F.col("id"), F.col("source"), F.col("imported_name"), F.col("why")).alias("id"), F.col("file_id").alias("source_file_id"), F.col("id").alias("source_entity_id"), F.col("source").alias("source_specifier"), "imported_name", F.col("why").alias("reason"))
            .dropDuplicates(["id"]).join(self._paths, F.col("source_file_id") == F.col("__pf")).drop("__pf")
        )

    modules, cycles = Resolution.modules, Resolution.cycles


def _bindings(imports: DataFrame, exports: DataFrame, exposed: DataFrame) -> DataFrame:
    """What answered imports and exports, and names handed on, are bound to."""
    bind = lambda t, kind, imported, named: t.select(kind.alias("kind"), F.col("file_id").alias("source_file_id"), F.col("id").alias("source_entity_id"), F.col("origin_file_id").alias("target_file_id"), F.col("origin_export_id").alias("target_export_id"), F.col("__es").alias("target_symbol_id"), imported.alias("imported_name"), named.alias("local_name"))
    bound = (
        bind(imports.where("status = 'resolved-symbol'"), F.when(F.col("kind") == "default", "default-import").otherwise("named-import"), F.col("wanted"), F.col("local_name"))
        .unionByName(bind(exports.where("status = 'resolved-re-export'"), F.lit("re-export"), F.col("wanted"), F.col("exported_name")))
        .unionByName(bind(exposed, F.lit("export-all"), F.col("__en"), F.col("__en")))
    )
    parts = ["source_file_id", "source_entity_id", "target_file_id", "target_export_id", "target_symbol_id", "kind", "imported_name", "local_name"]
    return bound.select(nul_id("binding", *map(F.col, parts)).alias("id"), *parts).dropDuplicates(["id"])


def _symbol(kind: str) -> F.Column:
    return F.when(F.col("status") == kind, F.col("__es"))


def _outside() -> F.Column:
    return F.col("source_kind") == "external"


def _missing() -> F.Column:
    return F.col("target_file_id").isNull()


def _matched() -> F.Column:
    return F.col("__ef").isNotNull() & ~F.col("ambiguous")


def _local() -> F.Column:
    return F.col("source").isNull()


def _star() -> F.Column:
    return F.col("kind") == "export-all"


def resolve(scan_files: DataFrame, parsed_files: DataFrame, symbols: DataFrame, imports: DataFrame, exports: DataFrame, aliases=()) -> Resolution:
    """All of a repository's references, resolved. Tables as in `corvane.schemas`; aliases as (alias, target paths)."""
    r = Resolver(scan_files, parsed_files, symbols, imports, exports, aliases, keep=True)
    return Resolution(**{f.name: getattr(r, f.name) for f in fields(Resolution)})
