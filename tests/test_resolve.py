"""Resolver on hand-built models: one file a path, file_id = path, hash 'hash'."""

import pytest
from pyspark.sql import functions as F

from corvane import schemas as S
from corvane.functions.tables import refuse_repeated, stored
from corvane.operators import resolve as module
from corvane.operators.resolve import Resolver, effective_exports, first_hit, resolve


def loc(n=1):
    return (n, 0, n, 1)


def model(spark, files, scanned=(), unparsed=()):
    """files: path -> (imports, exports). imports: (source, kind, imported, local[, type_only]); exports: (kind, name, local, source, symbol[, type_only])."""
    paths = [*files, *scanned, *unparsed, "README.md"]
    scan = spark.createDataFrame([(p, p, "/r/" + p, None, None, 1, "hash", None) for p in paths], S.SCAN_FILES)
    parsed = spark.createDataFrame([(p, p, "TypeScript", "hash") for p in files], S.PARSED_FILES)
    im, ex, sy = [], [], []
    for p, (imports, exports) in files.items():
        for i, x in enumerate(imports, 1):
            im.append((f"{p}:i{i}", p, x[0], x[1], x[2], x[3], x[4] if len(x) > 4 else False, loc(i)))
        for i, x in enumerate(exports, 1):
            ex.append((f"{p}:e{i}", p, x[0], x[1], x[2], x[3], x[4], x[5] if len(x) > 5 else False, loc(i)))
            if x[4]:
                sy.append((x[4], x[4], x[4], "function", p, None, True, False, loc(i)))
    return scan, parsed, spark.createDataFrame(sy, S.SYMBOLS).dropDuplicates(["id"]), spark.createDataFrame(im, S.IMPORTS), spark.createDataFrame(ex, S.EXPORTS)


def named(name, symbol="s", local=None):
    return ("named", name, local or name, None, symbol)


def by_source(got):
    return {r["source_specifier"]: r for r in got.imports.collect()}


def side(*sources):
    return [(s, "side-effect", None, None) for s in sources]


def test_specifiers(spark):
    files = {f: ([], []) for f in ("src/exact.ts", "src/typed.ts", "src/component.tsx", "src/script.js", "src/view.jsx", "src/folder/index.ts")}
    files["src/main.ts"] = (side("./exact.ts", "./typed", "./component", "./script", "./view", "./folder", "./nested/../typed", "./user.service", "../../x", "/abs", "a\\b", "./x.mjs", "y.cjs", "react", "./broken", "./none", ""), [])
    got = by_source(resolve(*model(spark, files, unparsed=["src/broken.ts"])))
    want = {"./exact.ts": "src/exact.ts", "./typed": "src/typed.ts", "./component": "src/component.tsx", "./script": "src/script.js", "./view": "src/view.jsx", "./folder": "src/folder/index.ts", "./nested/../typed": "src/typed.ts"}
    assert {s: got[s]["target_file_id"] for s in want} == want
    assert got["react"]["status"] == "external" and got["y.cjs"]["source_kind"] == "unsupported" and got["./x.mjs"]["source_kind"] == "relative"
    reasons = {r["source_specifier"]: r["reason"] for r in resolve(*model(spark, files, unparsed=["src/broken.ts"])).unresolved.collect()}
    assert reasons == {"./user.service": "MODULE_NOT_FOUND", "../../x": "PATH_ESCAPES_REPOSITORY", "./broken": "TARGET_NOT_PARSED", "./none": "MODULE_NOT_FOUND"} | dict.fromkeys(["/abs", "a\\b", "./x.mjs", "y.cjs", ""], "UNSUPPORTED_SPECIFIER")


def test_extension_mapping(spark):
    files = {"module.js": ([], []), "module.ts": ([], []), "component.tsx": ([], []), "only.ts": ([], []), "main.ts": (side("./module.js", "./component.jsx", "./only.js"), [])}
    got = by_source(resolve(*model(spark, files)))
    assert [got[s]["target_file_id"] for s in ("./module.js", "./component.jsx", "./only.js")] == ["module.js", "component.tsx", "only.ts"]


def test_aliases(spark):
    files = {"libs/parser/src/index.ts": ([], []), "libs/parser/src/tool.ts": ([], []), "main.ts": (side("@acme/parser", "@acme/parser/tool", "@acme/none", "@other/x"), [])}
    got = by_source(resolve(*model(spark, files), aliases=[("@acme/parser", ["libs/parser/src/index.ts"])]))
    assert [(got[s]["source_kind"], got[s]["target_file_id"], got[s]["status"]) for s in ("@acme/parser", "@acme/parser/tool", "@acme/none", "@other/x")] == [
        ("workspace", "libs/parser/src/index.ts", "resolved-module"), ("workspace", "libs/parser/src/tool.ts", "resolved-module"), ("workspace", None, "unresolved"), ("external", None, "external"),
    ]
    with pytest.raises(S.ResolverInputError) as e:
        resolve(*model(spark, files), aliases=[("@", ["x"])])
    assert e.value.code == "MALFORMED_WORKSPACE_ALIAS"


def test_binding_forms(spark):
    target = [named("run", "s-run"), ("default", "default", None, None, "s-def"), named("other", "s-o")]
    imports = [("./lib", "default", None, "lib"), ("./lib", "named", "run", "run"), ("./lib", "named", "other", "alias"), ("./lib", "namespace", None, "ns"), ("./lib", "side-effect", None, None)]
    got = resolve(*model(spark, {"lib.ts": ([], target), "main.ts": (imports, [])}))
    assert sorted(r["kind"] for r in got.dependencies.collect()) == ["import", "side-effect-import"]
    assert sorted((r["kind"], r["target_symbol_id"], r["local_name"]) for r in got.bindings.collect()) == [("default-import", "s-def", "lib"), ("named-import", "s-o", "alias"), ("named-import", "s-run", "run")]
    assert [r["status"] for r in got.imports.orderBy("import_id").collect()] == ["resolved-symbol"] * 3 + ["resolved-module"] * 2


def test_missing_export(spark):
    got = resolve(*model(spark, {"lib.ts": ([], []), "main.ts": ([("./lib", "named", "gone", "gone")], [])}))
    assert [r["reason"] for r in got.unresolved.collect()] == ["EXPORT_NOT_FOUND"] and got.dependencies.count() == 1


def test_re_export_chain(spark):
    files = {
        "a.ts": ([], [named("User", "s")]),
        "b.ts": ([], [("re-export", "Person", "User", "./a", None)]),
        "index.ts": ([], [("re-export", "Person", "Person", "./b", None)]),
        "consumer.ts": ([("./index", "named", "Person", "P")], []),
    }
    got = resolve(*model(spark, files))
    row = got.imports.collect()[0]
    assert (row["status"], row["target_symbol_id"], row["target_export_id"]) == ("resolved-symbol", "s", "index.ts:e1")
    binding = got.bindings.where("kind = 'named-import'").collect()[0]
    assert (binding["target_file_id"], binding["target_export_id"]) == ("a.ts", "a.ts:e1")


def test_export_all(spark):
    star = lambda src: ("export-all", "*", None, src, None)
    files = {
        "a.ts": ([], [named("Shared", "a1"), named("Only", "a2"), ("default", "default", None, None, "a3")]),
        "b.ts": ([], [named("Shared", "b1")]),
        "barrel.ts": ([], [star("./a"), star("./b")]),
        "top.ts": ([], [star("./barrel"), named("Only", "t1")]),
        "main.ts": ([("./barrel", "named", n, n) for n in ("Only", "Shared")] + [("./barrel", "default", None, "d"), ("./top", "named", "Only", "o")], []),
    }
    got = resolve(*model(spark, files))
    assert [(r["status"], r["target_symbol_id"]) for r in got.imports.orderBy("import_id").collect()] == [("resolved-symbol", "a2"), ("unresolved", None), ("unresolved", None), ("resolved-symbol", "t1")]
    assert sorted((r["imported_name"], r["reason"]) for r in got.unresolved.collect()) == [("Shared", "AMBIGUOUS_EXPORT"), ("default", "EXPORT_NOT_FOUND")]
    # a statement binds all names of its target, also those that the file itself shadows
    assert sorted((r["source_file_id"], r["local_name"]) for r in got.bindings.where("kind = 'export-all'").collect()) == [("barrel.ts", "Only"), ("barrel.ts", "Shared"), ("barrel.ts", "Shared"), ("top.ts", "Only")]


def test_re_export_circle_ends(spark):
    star = lambda src: ("export-all", "*", None, src, None)
    files = {"a.ts": ([], [star("./b"), named("A", "sa")]), "b.ts": ([], [star("./a"), named("B", "sb")]), "main.ts": ([("./a", "named", "B", "B"), ("./b", "named", "A", "A"), ("./a", "named", "A", "A2")], [])}
    got = {r["import_id"]: r["status"] for r in resolve(*model(spark, files)).imports.collect()}
    # a.ts comes first and asks for b, which asks for a: a sees nothing of the unfinished b, and that answer is kept
    assert got == {"main.ts:i1": "unresolved", "main.ts:i2": "resolved-symbol", "main.ts:i3": "resolved-symbol"}


def test_deep_chains_into_a_circle(spark):
    star = lambda src: ("export-all", "*", None, src, None)
    depth = 1500  # deeper than Python's calls go
    files = {f"f{i}.ts": ([], [star(f"./f{i + 1}")]) for i in range(depth)} | {f"f{depth}.ts": ([], [star("./f0"), named("A", "sa")])}
    scan, parsed, symbols, _, exports = model(spark, files)
    placed = exports.withColumn("target_file_id", F.concat(F.substring("source", 3, 10), F.lit(".ts")))
    got = effective_exports(placed, parsed).where("name = 'A' AND NOT ambiguous")
    assert got.count() == depth + 1 and got.select("symbol_id").distinct().collect() == [("sa",)]


def test_ambiguous_names_of_a_circle(spark):
    star = lambda src: ("export-all", "*", None, src, None)
    files = {"a.ts": ([], [star("./b"), star("./c"), ("re-export", "N", "X", "./c", None)]), "b.ts": ([], [star("./a"), named("X", "b1")]), "c.ts": ([], [named("X", "c1"), ("default", "default", None, None, "c2")])}
    scan, parsed, symbols, _, exports = model(spark, files)
    placed = exports.withColumn("target_file_id", F.concat(F.substring("source", 3, 10), F.lit(".ts")))
    # b.ts is asked while a.ts is unfinished, and sees nothing of it
    got = {(r["file_id"], r["name"]): (r["ambiguous"], r["symbol_id"]) for r in effective_exports(placed, parsed).collect()}
    assert got == {("a.ts", "X"): (True, None), ("a.ts", "N"): (False, "c1"), ("b.ts", "X"): (False, "b1"), ("c.ts", "X"): (False, "c1"), ("c.ts", "default"): (False, "c2")}


def test_circles_beyond_the_bound_are_refused(spark, monkeypatch):
    from corvane.operators import resolve as module

    monkeypatch.setattr(module, "MOST_CIRCULAR", 1)
    star = lambda src: ("export-all", "*", None, src, None)
    with pytest.raises(S.ResolverInputError) as e:
        resolve(*model(spark, {"a.ts": ([], [star("./b")]), "b.ts": ([], [star("./a")])}))
    assert e.value.code == "CIRCULAR_EXPORTS_TOO_LARGE"


def test_cycles(spark):
    files = {"a.ts": (side("./b"), []), "b.ts": (side("./c"), []), "c.ts": (side("./a", "./d"), []), "d.ts": ([], []), "self.ts": (side("./self"), [])}
    scan, parsed, *rest = model(spark, files)
    got = resolve(scan, parsed, *rest)
    assert sorted(r["relative_paths"] for r in got.cycles(parsed).collect()) == [["a.ts", "b.ts", "c.ts"], ["self.ts"]]


def test_order_of_rows_does_not_matter(spark):
    files = {"lib.ts": ([], [named("x", "s1"), named("y", "s2")]), "main.ts": ([("./lib", "named", "x", "x"), ("react", "named", "r", "r")], [("export-all", "*", None, "./lib", None)])}
    tables = model(spark, files)
    one, two = resolve(*tables), resolve(*[t.orderBy(t.columns[0], ascending=False).repartition(7) for t in tables])
    for name in ("imports", "exports", "dependencies", "external", "bindings", "unresolved"):
        assert sorted(map(str, getattr(one, name).collect())) == sorted(map(str, getattr(two, name).collect()))


def test_input_checks(spark):
    scan, parsed, symbols, imports, exports = model(spark, {"a.ts": ([("x", "named", "x", "x")], [])})
    with pytest.raises(S.ResolverInputError) as e:
        resolve(scan.where("id <> 'a.ts'"), parsed, symbols, imports, exports)
    assert e.value.code == "UNKNOWN_ANALYSIS_FILE"
    with pytest.raises(S.ResolverInputError) as e:
        resolve(scan, parsed, symbols, imports.unionAll(imports), exports)
    assert e.value.code == "DUPLICATE_ENTITY_ID"


def test_first_hit_numbers_the_candidate_and_sends_no_table_to_all_tasks(spark):
    tries = spark.createDataFrame([(1, ["a", "a.ts", "a.js"]), (2, ["b", "b.ts"]), (3, ["c"])], "k long, tries array<string>")
    stored = spark.createDataFrame([("a.js",), ("a.ts",), ("b",)], "path string")
    got = first_hit(tries, ["k"], "tries", stored, "path", "path", "tried")
    assert sorted(map(tuple, got.collect())) == [(1, "a.ts", 1), (2, "b", 0)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_tables_are_made_when_they_are_asked_for(spark):
    files = {"lib/a.ts": ([], [named("x", "s1")]), "lib/b.ts": ([], [("re-export", "y", "x", "./a", None)]), "app/m.ts": ([("../lib/b", "named", "y", "y"), ("../lib/b", "named", "gone", "g"), ("react", "side-effect", None, None)], []), "app/n.ts": ([("../lib/b", "named", "y", "z")], [])}
    scan, parsed, symbols, imports, exports = model(spark, files)
    unread = lambda: pytest.fail("the imports were read")
    rows = lambda t: sorted(map(str, t.collect()))
    whole = resolve(scan, parsed, symbols, imports, exports)
    assert rows(Resolver(scan, parsed, symbols, unread, exports).exports) == rows(whole.exports)
    lazy = Resolver(scan, parsed, symbols, lambda: imports, exports)
    for name in ("imports", "dependencies", "external", "bindings", "unresolved", "effective"):
        assert rows(getattr(lazy, name)) == rows(getattr(whole, name))
    counted = whole.imports.groupBy("status", "source_kind", "import_kind").agg(F.count(F.lit(1)).alias("imports"), F.count("target_file_id").alias("with_file"), F.count("target_symbol_id").alias("with_symbol"))
    assert rows(lazy.import_counts()) == rows(counted)
    with pytest.raises(S.ResolverInputError) as e:
        Resolver(scan, parsed, symbols, lambda: imports.unionAll(imports), exports).import_counts()
    assert e.value.code == "DUPLICATE_ENTITY_ID"


def test_folders_that_reach_one_path_look_it_up_once(spark, monkeypatch):
    files = {"lib/a.ts": ([], [named("x", "s1")]), "app/r/m.ts": ([("../../lib/a", "named", "x", "x")], []), "app/s/n.ts": ([("../../lib/a", "named", "x", "x"), ("./gone", "named", "x", "g")], [])}
    asked = []
    monkeypatch.setattr(module, "first_hit", lambda requests, *a, **k: asked.append(requests.count()) or first_hit(requests, *a, **k))
    scan, parsed, symbols, imports, exports = model(spark, files)
    r = Resolver(scan, parsed, symbols, lambda: imports, exports)
    assert sorted(map(tuple, r.import_counts().select("status", "imports").collect())) == [("resolved-symbol", 2), ("unresolved", 1)]
    assert max(asked) == 2  # the exports ask for none


def test_external_references_are_told_by_their_source_alone(spark):
    files = {"lib/a.ts": ([("react", "named", "x", "x"), ("@lib/a", "named", "x", "y"), ("./b", "side-effect", None, None)], [named("x", "s1")]), "lib/b.ts": ([("react", "side-effect", None, None)], [])}
    scan, parsed, symbols, imports, exports = model(spark, files)
    r = Resolver(scan, parsed, symbols, lambda: imports, exports, [("@lib/a", ["lib/a.ts"])])
    r._import_targets = None  # not to be read
    assert sorted((x["source_file_id"], x["import_ids"]) for x in r.external.collect()) == [("lib/a.ts", ["lib/a.ts:i1"]), ("lib/b.ts", ["lib/b.ts:i1"])]
    assert "_in_place" not in r.__dict__ and "_far_targets" not in r.__dict__


def test_rows_stored_by_columns_are_dealt_no_more(spark):
    rows = stored(spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 2), ("b", "x", 2)], "f string, s string, n int"), ("f",))
    got = rows.select("f", "s").distinct()
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("a", "y"), ("b", "x")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_repeated_texts_and_nulls_are_refused(spark):
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    refuse_repeated(table("a", "b", None), S.ResolverInputError, "X", "x", "id")
    for bad in (("a", "b", "a"), (None, "a", None)):
        with pytest.raises(S.ResolverInputError):
            refuse_repeated(table(*bad), S.ResolverInputError, "X", "x", "id")


def test_bindings_are_counted_by_what_is_asked(spark):
    files = {"lib/a.ts": ([], [named("x", "s1"), named("y", "s2")]), "lib/i.ts": ([], [("export-all", "*", None, "./a", None), ("re-export", "z", "x", "./a", None)]), "app/m.ts": ([("../lib/i", "named", "z", "z"), ("../lib/a", "named", "x", "x")], []), "app/n.ts": ([("../lib/i", "named", "y", "y"), ("../lib/i", "named", "gone", "g")], [])}
    tables = model(spark, files)
    want = resolve(*tables).bindings.groupBy("target_symbol_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, Resolver(*tables).binding_counts.collect())) == sorted(map(tuple, want.collect()))


def test_external_exports_need_no_targets(spark):
    files = {"lib/a.ts": ([], [("re-export", "r", "r", "react", None), ("re-export", "x", "x", "./b", None)]), "lib/b.ts": ([], [named("x", "s1")])}
    r = Resolver(*model(spark, files))
    r._placed_exports = None  # not to be read
    assert [(x["source_file_id"], x["source_specifier"], x["import_ids"], len(x["export_ids"])) for x in r.external.collect()] == [("lib/a.ts", "react", [], 1)]


def test_many_repeated_texts_are_refused(spark):
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string").repartition(3)
    refuse_repeated(table("a", "b", None), S.ResolverInputError, "X", "x", "id", many=True)
    for bad in (("a", "b", "a"), (None, "a", None), ("a", "a", "b", "b")):
        with pytest.raises(S.ResolverInputError) as e:
            refuse_repeated(table(*bad), S.ResolverInputError, "X", "x", "id", many=True)
        assert e.value.code == "X"


def test_the_tables_of_the_shop_are_dealt_by_file_once(spark, monkeypatch):
    from corvane.plans import shop

    monkeypatch.setattr(shop, "_MADE", {})
    s = shop.shop(spark, "/root/testdata/sf0.001")
    got = s.imports.select("file_id").join(s.parsed.select("file_id"), "file_id", "left_anti")
    assert got.count() == 0
    assert "Exchange hashpartitioning" not in got.hint("shuffle_hash")._jdf.queryExecution().executedPlan().toString()
