"""Knowledge, graph, artifact, exploration and context on hand-built repositories."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F
from test_resolve import model, named

from corvane import schemas as S
from corvane.operators import artifact, context, explore, graph
from corvane.operators.knowledge import build_knowledge
from corvane.operators.resolve import resolve

APP, LIB = "apps/web/src/main.ts", "libs/core/src/index.ts"
PROJECTS = [
    {"name": "web", "kind": "application", "root_relative_path": "apps/web", "entry_points": [{"relative_path": APP}]},
    {"name": "core", "kind": "library", "root_relative_path": "libs/core", "source_root_relative_path": "libs/core/src", "entry_points": [{"relative_path": LIB}]},
]
FILES = {
    APP: ([("@acme/core", "named", "tool", "tool"), ("react", "named", "r", "r")], []),
    LIB: ([], [named("tool", "s-tool"), named("other", "s-other")]),
    "libs/core/src/lone.ts": ([], []),
}


def stages(spark, files=FILES, projects=PROJECTS, order=None):
    tables = model(spark, files, scanned=["misc/config.json"])
    if order:
        tables = [t.repartition(order).orderBy(F.rand(order)) for t in tables]
    scan, parsed, symbols, imports, exports = tables
    got = resolve(scan, parsed, symbols, imports, exports, [("@acme/core", [LIB])])
    none, no_notes = spark.createDataFrame([], S.FAILURES), spark.createDataFrame([], S.DIAGNOSTICS)
    k = build_knowledge("/work/acme", scan, parsed, none, symbols, imports, exports, no_notes, got, projects)
    return context.Stages(scan, parsed, imports, exports, no_notes, got, k)


@pytest.fixture(scope="module")
def built(spark):
    return stages(spark)


@pytest.fixture(scope="module")
def world(built):
    return graph.create_graph(built.knowledge)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_hierarchy(built):
    k = built.knowledge
    assert sorted(r[0] for r in rows(k.folders, "relative_path")) == ["apps", "apps/web", "apps/web/src", "libs", "libs/core", "libs/core/src", "misc"]
    files = {r["relative_path"]: r for r in k.files.collect()}
    listed = k.repository.first()["file_ids"]
    assert [next(p for p, r in files.items() if r["id"] == i) for i in listed] == [APP, LIB, "libs/core/src/lone.ts", "misc/config.json", "README.md"]
    assert files["README.md"]["folder_id"] is None and files["misc/config.json"]["status"] == "skipped" and not files["misc/config.json"]["orphan"]
    assert files["libs/core/src/lone.ts"]["orphan"] and not files[APP]["orphan"]
    assert (files[APP]["internal_dependency_count"], files[APP]["external_dependency_count"], files[LIB]["export_count"]) == (1, 1, 2)
    deps = k.project_dependencies.collect()
    assert [(d["dependency_count"], d["type_only_dependency_count"]) for d in deps] == [(1, 0)]
    s = k.summaries.first().asDict()
    assert (s["project_count"], s["folder_count"], s["file_count"], s["parsed_file_count"], s["symbol_count"]) == (2, 7, 5, 3, 2)
    assert (s["public_project_symbol_count"], s["orphan_file_count"], s["root_file_count"], s["cross_project_dependency_count"]) == (2, 1, 1, 1)
    assert {r["relative_path"]: r["descendant_file_count"] for r in k.folders.collect()}["libs"] == 2


def test_longest_root_owns(spark):
    k = stages(spark, projects=[*PROJECTS, {"name": "libs", "kind": "unknown", "root_relative_path": "libs"}]).knowledge
    owner = dict(rows(k.projects, "id", "name"))
    files = {r["relative_path"]: owner.get(r["project_id"]) for r in k.files.collect()}
    assert files == {APP: "web", LIB: "core", "libs/core/src/lone.ts": "core", "misc/config.json": None, "README.md": None}
    folders = {r["relative_path"]: owner.get(r["project_id"]) for r in k.folders.collect()}
    assert folders["libs"] == "libs" and folders["libs/core/src"] == "core"


@pytest.mark.parametrize(
    ("extra", "code"),
    [
        ({"root_relative_path": "../x"}, "PROJECT_PATH_ESCAPES_REPOSITORY"), ({"root_relative_path": "apps/web"}, "DUPLICATE_PROJECT_ROOT"), ({"name": "web"}, "DUPLICATE_PROJECT_NAME"),
        ({"source_root_relative_path": "libs"}, "SOURCE_ROOT_OUTSIDE_PROJECT"), ({"entry_points": [{"relative_path": "misc/none.ts"}]}, "ENTRY_POINT_NOT_SCANNED"), ({"entry_points": [{"relative_path": LIB}]}, "ENTRY_POINT_OUTSIDE_PROJECT"),
    ],
)
def test_project_errors(spark, extra, code):
    with pytest.raises(S.KnowledgeInputError) as e:
        stages(spark, projects=[*PROJECTS, {"name": "misc", "kind": "unknown", "root_relative_path": "misc"} | extra])
    assert e.value.code == code


def test_order_invariance(spark, built):
    again = stages(spark, order=5)
    for name in ("repository", "projects", "folders", "files", "symbols", "relations", "project_dependencies", "summaries"):
        assert sorted(map(str, getattr(built.knowledge, name).collect())) == sorted(map(str, getattr(again.knowledge, name).collect()))


def test_graph_checks(world):
    nodes, relations = world.nodes, world.relations
    one = relations.where("kind = 'declares'").limit(1)
    for table, code in (
        (relations.unionByName(one), "DUPLICATE_RELATION_ID"), (relations.unionByName(one.withColumns({"id": F.lit("x"), "kind": F.lit("contains")})), "INCONSISTENT_ENDPOINT_KINDS"),
        (relations.unionByName(one.withColumns({"id": F.lit("x"), "target_node_id": F.lit("gone")})), "MISSING_RELATION_ENDPOINT"), (relations.unionByName(one.withColumns({"id": F.lit("x"), "kind": F.lit("odd")})), "INVALID_RELATION_KIND"),
    ):
        with pytest.raises(S.GraphInputError) as e:
            graph.checked_graph(nodes, table)
        assert e.value.code == code


def chain(spark, edges, kinds="file"):
    names = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(n, kinds, n) for n in names], "id string, kind string, qualified_name string")
    rels = spark.createDataFrame([(f"r-{a}{b}", "depends-on", a, b) for a, b in edges], "id string, kind string, source_node_id string, target_node_id string")
    return graph.Graph(nodes, rels)


def test_neighborhood(spark):
    g = chain(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    ids = lambda p: [r["id"] for r in p.nodes.orderBy("place").collect()]
    assert ids(graph.neighborhood(g, "a", direction="outgoing")) == ["a", "b"]
    assert ids(graph.neighborhood(g, "a", direction="outgoing", max_depth=2)) == ["a", "b", "c"]
    small = graph.neighborhood(g, "a", max_depth=2, max_nodes=2, max_relations=1)
    assert ids(small) == ["a", "b"] and {tuple(r) for r in small.omissions.collect()} == {("NODE_LIMIT", "node", 1)}
    loop = chain(spark, [("a", "a")])
    assert sorted(r["direction"] for r in graph.neighbors(loop, "a").collect()) == ["incoming", "outgoing"]
    with pytest.raises(S.GraphInputError):
        graph.neighborhood(g, "a", max_depth=11)
    with pytest.raises(S.GraphInputError):
        graph.neighborhood(g, "zz")


def test_views_and_artifact(world, tmp_path):
    one = artifact.create_artifact(world)
    kinds = [n["kind"] for n in one["graph"]["nodes"]]
    assert kinds == sorted(kinds, key=S.NODE_KINDS.index) and kinds[0] == "repository" and one["graph"]["rootNodeIds"] == [one["repository"]["id"]]
    # each file and symbol hangs in one place of the tree
    below = [e["targetId"] for e in one["graph"]["edges"]]
    files = {n["id"] for n in one["graph"]["nodes"] if n["kind"] in ("file", "symbol")}
    assert all(below.count(f) == 1 for f in files)
    deps = artifact.create_artifact(world, "project-dependencies")
    assert deps["summary"] == {"nodeCount": 2, "edgeCount": 1, "omissionCount": 0} and deps["graph"]["edges"][0]["metadata"] == {"dependencyCount": 1, "typeOnlyDependencyCount": 0}
    api = artifact.create_artifact(world, "public-api")
    assert [n["kind"] for n in api["graph"]["nodes"]] == ["project", "project", "file", "symbol", "symbol"]
    cut = artifact.create_artifact(world, "full", max_nodes=3)
    assert cut["summary"]["omissionCount"] == sum(o["count"] for o in cut["graph"]["omissions"]) > 0
    path = artifact.write_artifact(one, str(tmp_path / "out" / "graph.json"))
    assert artifact.load_artifact(path) == one
    artifact.write_artifact(deps, path, pretty=True)
    assert artifact.load_artifact(path) == deps and (tmp_path / "out" / "graph.json").read_text().endswith("}\n")
    (tmp_path / "mine.json").write_text("{}")
    with pytest.raises(S.ArtifactError):
        artifact.write_artifact(one, str(tmp_path / "mine.json"))
    for wrong, code in (({"schemaVersion": "2"}, "UNSUPPORTED_SCHEMA_VERSION"), ({**one, "summary": {"nodeCount": 0, "edgeCount": 0, "omissionCount": 0}}, "INVALID_ARTIFACT"), ([], "INVALID_ARTIFACT")):
        with pytest.raises(S.ArtifactError) as e:
            artifact.checked_artifact(json.loads(json.dumps(wrong)))
        assert e.value.code == code
    for bad, code in ((None, "NOT_CONFIGURED"), (str(tmp_path / "none"), "NOT_FOUND"), (str(tmp_path), "READ_FAILED")):
        with pytest.raises(S.ArtifactError) as e:
            artifact.load_artifact(bad)
        assert e.value.code == code


def test_target_view(world):
    repo = world.nodes.where("kind = 'repository'").first()["id"]
    near = graph.view(world, "repository", repo, max_depth=1)
    assert {r["kind"] for r in near.nodes.collect()} == {"repository", "project", "folder", "file"}
    with pytest.raises(S.GraphInputError):
        graph.view(world, "file-dependencies", repo)


def test_exploration(spark):
    g = chain(spark, [("repo", "one"), ("one", "two"), ("two", "three"), ("three", "four")], "folder")
    root = spark.createDataFrame([("repo",)], "id string")
    seen = lambda **o: sorted(r["id"] for r in explore.explore(g.relations, root, 3, **o).collect())
    assert seen() == ["one", "repo", "three", "two"]
    assert seen(expanded=["three"]) == ["four", "one", "repo", "three", "two"]
    assert seen(collapsed=["one"]) == ["one", "repo"]
    assert explore.isolate(g.nodes, g.relations, "three").count() == 5
    hidden = explore.has_hidden_children(g.relations, explore.explore(g.relations, root, 3))
    assert [r["id"] for r in hidden.collect()] == ["three"]
    assert {r["id"]: r["degree"] for r in explore.degrees(g.nodes, g.relations).collect()} == {"repo": 1, "one": 2, "two": 2, "three": 2, "four": 1}
    assert explore.adjacency(g.relations).count() == 4


def test_drawn_elements(spark):
    nodes = spark.createDataFrame([("a", "file", "a-very-long-file-name-that-does-not-fit.ts"), ("b", "odd", "b")], "id string, kind string, label string")
    edges = spark.createDataFrame([(str(i), "depends-on", "a", "b") for i in range(4)] + [("l", "depends-on", "b", "b")], "id string, kind string, source_node_id string, target_node_id string")
    got = {r["id"]: r for r in explore.node_elements(nodes, edges).collect()}
    assert (got["a"]["size"], got["a"]["font_size"], got["a"]["color"], got["a"]["display_label"]) == (50, 8, "#315f85", "a-very-long-file-…")
    assert (got["b"]["connection_count"], got["b"]["color"], got["b"]["display_label"]) == (5, "#71717a", "b")
    drawn = explore.edge_elements(edges.where("id = 'l'")).first()
    assert (drawn["group"], drawn["source"], drawn["target"], drawn["kind"]) == ("edges", "b", "b", "depends-on")


SOURCE = "\n".join(f"line {i}" for i in range(1, 121))


def with_sources(spark, s):
    import hashlib

    text = SOURCE.encode()
    digest = hashlib.sha256(text).hexdigest()
    scan = s.scan_files.withColumn("content_hash", F.lit(digest))
    k = dataclasses.replace(s.knowledge, files=s.knowledge.files.withColumn("content_hash", F.lit(digest)))
    return dataclasses.replace(s, scan_files=scan, knowledge=k), scan.select("id", F.lit(text).alias("content"))


def test_context_packages(spark, built):
    s, contents = with_sources(spark, built)
    got = context.build_context(s, {"kind": "file", "relativePath": APP}, contents=contents)
    assert [f["relativePath"] for f in got["entities"]["files"]] == [APP, LIB]
    assert [f["selectionReasons"] for f in got["entities"]["files"]] == [["target"], ["direct-dependency", "bound-symbol"]]
    assert [(x["name"], x["selectionReasons"]) for x in got["entities"]["symbols"]] == [("s-tool", ["bound-symbol"]), ("s-other", ["target-export", "same-file-symbol"])]
    assert [e["relativePath"] for e in got["excerpts"]] == [APP, LIB] and got["excerpts"][0]["endLine"] == 80 and got["excerpts"][0]["reasons"] == ["target-file-header"]
    assert got["entities"]["externalModules"][0]["sourceSpecifier"] == "react" and got["relationships"]["symbolBindings"][0]["importedName"] == "tool"
    assert context.build_context(s, {"kind": "file", "relativePath": APP}, contents=contents) == got
    small = context.build_context(s, {"kind": "file", "relativePath": APP}, {"maxTotalSourceCharacters": 700, "maxExcerptCharacters": 600}, contents)
    assert [e["truncated"] for e in small["excerpts"]] == [True] and {o["reason"] for o in small["omissions"]} >= {"EXCERPT_CHARACTER_LIMIT", "TOTAL_SOURCE_CHARACTER_LIMIT"}
    symbol = context.build_context(s, {"kind": "symbol", "symbolId": "s-tool"}, contents=contents)
    assert [(x["name"], x["selectionReasons"]) for x in symbol["entities"]["symbols"]] == [("s-tool", ["target"]), ("s-other", ["same-file-symbol"])]
    assert {f["relativePath"]: f["selectionReasons"] for f in symbol["entities"]["files"]}[APP] == ["direct-dependent", "binding-source"]
    off = context.build_context(s, {"kind": "project", "name": "core"}, {"includeSource": False, "maxRelations": 1})
    assert [f["relativePath"] for f in off["entities"]["files"]] == [LIB, APP, "libs/core/src/lone.ts"] and len(off["relationships"]["projectDependencies"]) == 1
    assert {o["reason"] for o in off["omissions"]} == {"RELATION_LIMIT", "SOURCE_DISABLED"}
    folder = context.build_context(s, {"kind": "folder", "relativePath": "libs"}, {"includeSource": False, "folderDepth": 1})
    assert len(folder["entities"]["folders"]) == 3  # ancestors of its files lie under it


def test_context_errors(spark, built):
    for target, code in (({"kind": "file", "relativePath": "no"}, "TARGET_NOT_FOUND"), ({"kind": "file"}, "TARGET_LOOKUP_INVALID"), ({"kind": "project", "name": "web", "projectId": "x"}, "TARGET_LOOKUP_INVALID")):
        with pytest.raises(S.ContextError) as e:
            context.build_context(built, target, {"includeSource": False})
        assert e.value.code == code
    with pytest.raises(S.ContextError) as e:
        context.checked_options({"maxFiles": 0})
    assert e.value.code == "INVALID_OPTIONS"


def test_truncation_keeps_pairs_whole():
    text = "😀" * 300
    short = context.truncate_text(text, 101)
    assert context._utf16(short) <= 101 and "�" not in short and context.MARKER in short
    assert context.truncate_text("abc", 10) == "abc"


def test_stages_must_fit(spark, built):
    gone = spark.createDataFrame([("gone.ts", "gone.ts", "TypeScript", "hash")], S.PARSED_FILES)
    r, k = built.resolution, built.knowledge
    replace = dataclasses.replace
    first = k.relations.limit(1)
    cases = [
        (replace(built, parsed_files=built.parsed_files.unionByName(gone)), "SCAN_ANALYSIS_MISMATCH"),
        (replace(built, roots=("/a", "/b")), "SCAN_ANALYSIS_MISMATCH"),
        (replace(built, roots=("/a", "/a", "/b")), "SCAN_RESOLUTION_MISMATCH"),
        (replace(built, resolution=replace(r, dependencies=r.dependencies.withColumn("target_file_id", F.lit("gone.ts")))), "SCAN_RESOLUTION_MISMATCH"),
        (replace(built, knowledge=replace(k, files=k.files.withColumn("file_id", F.concat(F.lit("x"), "file_id")))), "SCAN_KNOWLEDGE_MISMATCH"),
        (replace(built, knowledge=replace(k, symbols=k.symbols.withColumn("file_id", F.lit("gone.ts")))), "SCAN_KNOWLEDGE_MISMATCH"),
        (replace(built, knowledge=replace(k, relations=k.relations.unionByName(first.withColumns({"id": F.lit("new"), "target_node_id": F.lit("gone")})))), "KNOWLEDGE_RELATION_INVALID"),
    ]
    for stages_, code in cases:
        with pytest.raises(S.ContextError) as e:
            context.check_stages(stages_)
        assert e.value.code == code
    context.check_stages(built)


def test_sources_are_checked(spark, built):
    s, contents = with_sources(spark, built)
    target, digest = {"kind": "file", "relativePath": APP}, contents.select(F.sha2("content", 256)).first()[0]
    given = lambda asked: asked.join(contents, "id").withColumn("relative_path", F.concat(F.lit("./"), "relative_path"))
    assert context.build_context(s, target, contents=given) == context.build_context(s, target, contents=contents)
    for bad, code in (
        (contents.withColumn("relative_path", F.lit("other.ts")), "SOURCE_FILE_MISMATCH"),
        (contents.withColumn("content_hash", F.lit("0")), "SOURCE_HASH_MISMATCH"),
        (contents.withColumn("content", F.lit(b"other")).withColumn("content_hash", F.lit(digest)), "SOURCE_HASH_MISMATCH"),
        (contents.where("false"), "SOURCE_FILE_MISMATCH"),
    ):
        with pytest.raises(S.ContextError) as e:
            context.build_context(s, target, contents=bad)
        assert e.value.code == code


def test_counts_of_the_shop_need_no_whole_model(spark, monkeypatch):
    from corvane.operators import knowledge
    from corvane.plans import shop

    monkeypatch.setattr(knowledge, "build_knowledge", lambda *a: pytest.fail("the whole model was made"))
    monkeypatch.setattr(shop, "_MADE", {})
    d = "/root/testdata/sf0.001"
    assert [r["name"] for r in shop.graph_node(spark, d).collect()] == ["c7.ts"]
    for name in ("model_summary", "model_files", "model_symbols", "model_folders", "model_projects", "model_project_dependencies", "model_relation_kinds", "graph_nodes"):
        assert shop.QUERIES[name](spark, d).count()


def test_model_by_need_refuses_an_import_of_no_scanned_file(spark):
    from corvane.operators import graph, knowledge
    from corvane.operators.resolve import Resolver

    scan = spark.createDataFrame([("a.ts", "a.ts", "/r/a.ts", None, None, 1, "h", None)], S.SCAN_FILES)
    parsed = spark.createDataFrame([("a.ts", "a.ts", "TypeScript", "h")], S.PARSED_FILES)
    none = lambda schema: spark.createDataFrame([], schema)
    for file, bad in (("a.ts", False), ("gone.ts", True)):
        imports = spark.createDataFrame([("i", file, "x", "side-effect", None, None, False, (1, 0, 1, 1))], S.IMPORTS)
        resolver = Resolver(scan, parsed, none(S.SYMBOLS), lambda: imports, none(S.EXPORTS))  # noqa: B023
        model = knowledge.Model("/r", scan, parsed, none(S.FAILURES), none(S.SYMBOLS), lambda: imports, none(S.EXPORTS), resolver)  # noqa: B023
        if bad:
            with pytest.raises(S.KnowledgeInputError) as e:
                graph.checked_nodes(model)
            assert e.value.code == "MISSING_RELATION_NODE"
        else:
            assert sorted(r["kind"] for r in graph.checked_nodes(model).collect()) == ["file", "repository"]


def test_context_and_views_of_the_shop_need_no_whole_model(spark, monkeypatch):
    from corvane.operators import knowledge
    from corvane.plans import shop

    monkeypatch.setattr(knowledge, "build_knowledge", lambda *a: pytest.fail("the whole model was made"))
    monkeypatch.setattr(shop, "_MADE", {})
    d = "/root/testdata/sf0.001"
    for name in ("view_full", "artifact_elements", "context_file_candidates", "context_symbol_ranking", "context_relations", "context_excerpt_requests", "context_excerpts", "context_package", "context_project_candidates", "context_folder_candidates"):
        assert shop.QUERIES[name](spark, d).count()


def by_need(spark, s):
    from corvane.operators.knowledge import Model
    from corvane.operators.resolve import Resolver

    scan, parsed, symbols, imports, exports = model(spark, FILES, scanned=["misc/config.json"])
    r = Resolver(scan, parsed, symbols, lambda: imports, exports, [("@acme/core", [LIB])])
    k = Model("/work/acme", scan, parsed, spark.createDataFrame([], S.FAILURES), symbols, lambda: imports, exports, r, PROJECTS)
    return dataclasses.replace(s, imports=lambda: imports, resolution=r, knowledge=k)


def test_packages_by_need_equal_those_of_the_whole_model(spark, built, world):
    few = by_need(spark, built)
    for target in ({"kind": "file", "relativePath": APP}, {"kind": "symbol", "symbolId": "s-tool"}, {"kind": "project", "name": "core"}, {"kind": "folder", "relativePath": "libs"}):
        assert context.build_context(few, target, {"includeSource": False}) == context.build_context(built, target, {"includeSource": False})
    m = few.knowledge
    assert rows(m.project_dependencies, "id", "dependency_count", "type_only_dependency_count") == rows(built.knowledge.project_dependencies, "id", "dependency_count", "type_only_dependency_count")
    top = world.nodes.where("kind = 'repository'").select("id", "kind", "name")
    small = graph.Graph(top.unionByName(m.project_nodes, allowMissingColumns=True), m.project_relations)
    assert artifact.create_artifact(small, "project-dependencies") == artifact.create_artifact(world, "project-dependencies")


def test_omissions_of_the_shop_are_those_its_sql_counts(spark, monkeypatch):
    from corvane.plans import shop

    d = "/root/testdata/sf0.001"
    monkeypatch.setitem(context.DEFAULTS, "maxRelations", 1)
    assert {r["entity_kind"] for r in shop.context_omissions(spark, d).collect()} <= {"file", "symbol", "source"}
    made = context.build_context(shop.staged(spark, d), shop._ASKED, {"includeSource": False})
    assert "RELATION_LIMIT" in {o["reason"] for o in made["omissions"]}


def test_nodes_of_a_model_by_need_are_checked_without_its_edges(spark, monkeypatch):
    from corvane.operators import knowledge
    from corvane.operators.resolve import Resolver

    scan = spark.createDataFrame([(f, f, f"/r/{f}", None, None, 1, "h", None) for f in ("a.ts", "b.ts")], S.SCAN_FILES)
    parsed = spark.createDataFrame([(f, f, "TypeScript", "h") for f in ("a.ts", "b.ts")], S.PARSED_FILES)
    imports = spark.createDataFrame([("i", "a.ts", "./b", "side-effect", None, None, False, (1, 0, 1, 1))], S.IMPORTS)
    none = lambda schema: spark.createDataFrame([], schema)
    monkeypatch.setattr(Resolver, "_edges", property(lambda self: pytest.fail("the edges were made")))
    made = lambda given: knowledge.Model("/r", scan, parsed, none(S.FAILURES), none(S.SYMBOLS), lambda: given, none(S.EXPORTS), Resolver(scan, parsed, none(S.SYMBOLS), lambda: given, none(S.EXPORTS)))
    assert sorted(r["kind"] for r in graph.checked_nodes(made(imports)).collect()) == ["file", "file", "repository"]
    with pytest.raises(S.ResolverInputError) as e:
        made(imports.unionAll(imports)).check_ends()
    assert e.value.code == "DUPLICATE_ENTITY_ID"
