"""Parser snippets, the scan of real folders, workspace settings, and column functions."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.functions import files as fl
from corvane.functions import paths
from corvane.functions.order import human
from corvane.operators.parse import analyze, read_file
from corvane.schemas import ScanError
from corvane.sources.repository import access_error, reread, scan_entries, scan_tables
from corvane.sources.workspace import load_aliases, load_projects


def pairs(source, language="TypeScript"):
    return [(s["qualified_name"], s["kind"]) for s in read_file("f", source, language)["symbols"]]


def test_symbols():
    source = "\n".join([
        "export async function run() {}", "const arrow = async () => 1;", "const expression = function () {};", "export class Service {", "  constructor() {}", "  execute() {}", "  static async create() {}", "}",
        "export interface Config {}", "export type Result = string;", "export enum State { Ready }", "export const value = 1;", "const handlers = { handle() {}, async load() {}, save: () => {} };",
    ])
    assert pairs(source) == [
        ("run", "function"), ("arrow", "function"), ("expression", "function"), ("Service", "class"), ("Service.constructor", "constructor"), ("Service.execute", "method"), ("Service.create", "method"),
        ("Config", "interface"), ("Result", "type-alias"), ("State", "enum"), ("value", "variable"), ("handlers.handle", "method"), ("handlers.load", "method"), ("handlers.save", "method"),
    ]
    rows = {s["name"]: s for s in read_file("f", source, "TypeScript")["symbols"]}
    assert rows["run"]["exported"] and rows["run"]["async"] and rows["arrow"]["async"] and rows["create"]["async"] and not rows["execute"]["async"]
    assert {rows[n]["parent_symbol_id"] for n in ("constructor", "execute", "create")} == {rows["Service"]["id"]} and rows["execute"]["exported"]
    assert rows["handle"]["parent_symbol_id"] is None and rows["load"]["async"]


@pytest.mark.parametrize(
    ("source", "language", "kind", "is_async"),
    [
        ("const fn = () => {};", "TypeScript", "function", False), ("const fn = function () {};", "TypeScript", "function", False), ("const fn = async () => {};", "TypeScript", "function", True), ("const fn = async function () {};", "TypeScript", "function", True),
        ("const fn = function* () {};", "TypeScript", "function", False), ("export const fn = 123;", "TypeScript", "variable", False), ("export const fn = {};", "TypeScript", "variable", False), ("export const fn = [];", "TypeScript", "variable", False),
        ("export const fn = class {};", "TypeScript", "variable", False), ("const fn = () => <button />;", "TSX", "function", False), ("const fn = <T,>(x: T): Map<string, T> => new Map<string, T>();", "TSX", "function", False),
        ("const fn = (a: number, b = { c: 1 }): Promise<void> => {\n  return <div title=\"a > b\">{x ? <b>1</b> : '}'}</div>;\n}", "TSX", "function", False), ("export const fn = /[/'\"]/.test(x) ? `a${`b}`}` : 'c'", "TypeScript", "variable", False),
    ],
)
def test_initialisers(source, language, kind, is_async):
    got = read_file("f", source, language)
    assert [(s["name"], s["kind"], s["async"]) for s in got["symbols"]] == [("fn", kind, is_async)] and not got["diagnostics"]


def test_places():
    s = read_file("f", "\n  function positioned() {}", "TypeScript")["symbols"][0]
    assert s["location"] == {"start_line": 2, "start_column": 2, "end_line": 2, "end_column": 26}


def test_imports():
    source = "import defaultValue, { value, other as alias } from './module';\nimport * as namespace from './namespace';\nimport './side-effect';\nimport type TypeDefault from './type-default';\nimport { type Shape } from './shape';\nimport type { A } from './a'\nconst lazy = import('./lazy');"
    got = [(x["kind"], x["imported_name"], x["local_name"], x["source"], x["type_only"]) for x in read_file("f", source, "TypeScript")["imports"]]
    assert got == [
        ("default", "default", "defaultValue", "./module", False), ("named", "value", "value", "./module", False), ("named", "other", "alias", "./module", False), ("namespace", "*", "namespace", "./namespace", False),
        ("side-effect", None, None, "./side-effect", False), ("default", "default", "TypeDefault", "./type-default", True), ("named", "Shape", "Shape", "./shape", True), ("named", "A", "A", "./a", True),
    ]


def test_exports():
    source = "\n".join([
        "function local() {}", "const listedVariable = 1;", "export function value() {}", "export class Service {}", "export const item = 1;", "export interface Config {}", "export type Result = string;", "export { local };",
        "export { listedVariable };", "export { local as alias };", "export { remote } from './remote';", "export type { Shape } from './shape';", "export * from './all';", "export default Service;",
    ])
    got = read_file("f", source, "TypeScript")
    assert [(x["kind"], x["exported_name"], x["local_name"], x["source"], x["type_only"]) for x in got["exports"]] == [
        ("named", "value", "value", None, False), ("named", "Service", "Service", None, False), ("named", "item", "item", None, False), ("named", "Config", "Config", None, True), ("named", "Result", "Result", None, True),
        ("named", "local", "local", None, False), ("named", "listedVariable", "listedVariable", None, False), ("named", "alias", "local", None, False), ("re-export", "remote", "remote", "./remote", False),
        ("re-export", "Shape", "Shape", "./shape", True), ("export-all", "*", None, "./all", False), ("default", "default", "Service", None, False),
    ]
    symbols = {s["name"]: s for s in got["symbols"]}
    assert got["exports"][5]["symbol_id"] == symbols["local"]["id"] and symbols["listedVariable"]["exported"] and symbols["local"]["exported"]


def test_odd_exports():
    got = read_file("f", "export default function () {}", "JavaScript")
    assert [(x["kind"], x["local_name"], x["symbol_id"]) for x in got["exports"]] == [("default", None, None)] and not got["diagnostics"]
    got = read_file("f", "export abstract class Base { abstract run(): void; }\nexport const { a, b } = c;\nexport function* gen() {}", "TypeScript")
    assert [(x["exported_name"], x["symbol_id"]) for x in got["exports"]] == [("Base", None), ("unknown", None), ("gen", None)] and not got["symbols"]
    assert [d["code"] for d in got["diagnostics"]] == ["MISSING_SYMBOL_NAME"]


def test_malformed_and_empty():
    got = read_file("f", "export function valid() {}\nconst broken = ;", "TypeScript")
    assert [s["name"] for s in got["symbols"]] == ["valid"] and [d["code"] for d in got["diagnostics"]] == ["TREE_SITTER_SYNTAX_ERROR"]
    for text in ("", "// comments only\n", "/* open", "'open", "}}}", "export", "import", "class", "const"):
        out = read_file("f", text, "TypeScript")
        assert not out["symbols"] and not out["imports"]


def tree(root, files):
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


def scanned(spark, root, **options):
    files, counts = scan_tables(scan_entries(spark, str(root), **options))
    return [r["relative_path"] for r in files.orderBy(*human("relative_path")).collect()], counts.first().asDict()


@pytest.mark.parametrize(
    ("files", "want", "ignored"),
    [
        ({".DS_Store": "", ".env": "", ".git/config": "", ".corvane/cache.json": "", ".corvaneignore": "!node_modules/", "dist/output.js": "", "node_modules/package/index.js": "", "src/index.ts": "a"}, [".corvaneignore", "src/index.ts"], 6),
        ({".gitignore": "*.log\nlogs/\n!keep.log\n", "debug.log": "", "keep.log": "", "logs/app.txt": "", "src/app.ts": ""}, [".gitignore", "keep.log", "src/app.ts"], 2),
        ({".gitignore": "/root.txt", "root.txt": "", "nested/root.txt": ""}, [".gitignore", "nested/root.txt"], 1),
        ({".gitignore": "*.ts", ".corvaneignore": "!keep.ts\nnotes/**", "keep.ts": "", "drop.ts": "", "notes/a.md": ""}, [".corvaneignore", ".gitignore", "keep.ts"], 2),
        ({"bin": bytes([1, 2, 0, 4]), "control": bytes([1] * 4 + [65] * 6), "source.c": "int x;\n"}, ["source.c"], 2),
        ({"misc/config.json": "{}", "README.md": "", "apps/a.ts": ""}, ["apps/a.ts", "misc/config.json", "README.md"], 0),
    ],
)
def test_scan(spark, tmp_path, files, want, ignored):
    tree(tmp_path, files)
    got, counts = scanned(spark, tmp_path)
    assert got == want and counts["total_ignored_entries"] == ignored


def test_scan_limits_links_and_errors(spark, tmp_path):
    tree(tmp_path, {"large.txt": "12345", "small.txt": "1234"})
    os.symlink(tmp_path / "small.txt", tmp_path / "link.txt")
    assert scanned(spark, tmp_path, max_bytes=4) == (["small.txt"], {"total_files": 1, "total_directories": 0, "total_ignored_entries": 2})
    for root, code in (("none", "REPOSITORY_NOT_FOUND"), ("small.txt", "INVALID_REPOSITORY")):
        with pytest.raises(ScanError) as e:
            scan_entries(spark, str(tmp_path / root))
        assert e.value.code == code
    with pytest.raises(ScanError):
        scan_entries(spark, str(tmp_path), max_bytes=-1)


def test_one_deep_folder_is_read_by_many_tasks(spark, tmp_path):
    tree(tmp_path, {".gitignore": "skip/\n", **{f"src/a{i}/b{j}/f.ts": "x" * (1 << 20) for i in range(6) for j in range(6)}, "src/skip/x.ts": "x", "src/node_modules/y.ts": "y"})
    entries = scan_entries(spark, str(tmp_path))
    assert entries.rdd.getNumPartitions() >= 5  # 36 MB
    files, counts = scan_tables(entries)
    assert files.count() == 37 and counts.first().asDict() == {"total_files": 37, "total_directories": 43, "total_ignored_entries": 2}


def test_small_files_share_a_part(spark, tmp_path):
    tree(tmp_path, {f"f{i}.ts": "x" for i in range(300)})
    entries = scan_entries(spark, str(tmp_path))
    assert entries.rdd.getNumPartitions() == 1 and entries.count() == 300


def test_sources_read_again(spark, tmp_path):
    tree(tmp_path, {"a.ts": "one", "b.ts": "two"})
    files, _ = scan_tables(scan_entries(spark, str(tmp_path)))
    files = files.drop("content")
    files = spark.createDataFrame(files.collect(), files.schema)  # as they were
    (tmp_path / "a.ts").write_text("changed")
    (tmp_path / "b.ts").unlink()
    got = {r["relative_path"]: (r["content"], r["content_hash"]) for r in reread(files).collect()}
    before = {r["relative_path"]: r["content_hash"] for r in files.collect()}
    assert bytes(got["a.ts"][0]) == b"changed" and got["a.ts"][1] != before["a.ts"] and got["b.ts"] == (None, None)


def test_file_system_errors_have_classes():
    kinds = [access_error(e()) for e in (FileNotFoundError, PermissionError, NotADirectoryError, IsADirectoryError, OSError)]
    assert kinds == ["not-found", "permission-denied", "invalid-entry", "invalid-entry", "unknown"]


def test_analysis_isolates_failures(spark):
    import hashlib

    row = lambda p, text, lang="TypeScript", digest=None: (p, p, lang, digest or hashlib.sha256((text or "").encode()).hexdigest(), text.encode() if text is not None else None)
    files = spark.createDataFrame([row("a.ts", "export const a = 1;"), row("b.ts", None), row("c.ts", "new", digest="old"), row("README.md", "# x", "Markdown")], "id string, relative_path string, language string, content_hash string, content binary")
    got = analyze(files)
    assert got.meta.first().asDict() == {"scanned_file_count": 4, "parsed_file_count": 1, "failed_file_count": 2, "skipped_file_count": 1}
    assert sorted((r["relative_path"], r["code"]) for r in got.failures.collect()) == [("b.ts", "SOURCE_READ_FAILED"), ("c.ts", "FILE_CHANGED_SINCE_SCAN")]
    assert [r["name"] for r in got.symbols.collect()] == ["a"]


def test_workspace(spark, tmp_path):
    tree(tmp_path, {
        "tsconfig.base.json": '{"compilerOptions": {"paths": {"@a/core": ["./libs/core/src/index.ts"], "@a/ui/*": ["libs/ui/src/*"], "bad": 3}}}', "package.json": '{"workspaces": ["packages/*", "./tools/**/"]}',
        "libs/core/project.json": '{"name": "core", "projectType": "library", "sourceRoot": "libs/core/src", "targets": {"build": {"options": {"main": "./libs/core/src/index.ts"}}}}', "libs/core/src/index.ts": "",
        "packages/one/package.json": '{"name": "one", "main": "./main.js", "exports": {".": {"import": "./esm.js", "types": ["./gone.d.ts"]}}}', "packages/one/main.js": "", "packages/one/esm.js": "", "packages/deep/two/package.json": '{"name": "two"}', "tools/x/y/package.json": '{"name": "xy"}',
    })
    files, _ = scan_tables(scan_entries(spark, str(tmp_path)))
    assert load_aliases(files) == [("@a/core", ["libs/core/src/index.ts"]), ("@a/ui", ["libs/ui/src/index.ts"])]
    # the compiler's settings count where the scan passes them over
    assert load_aliases(files.where("false"), str(tmp_path)) == load_aliases(files) and load_aliases(files, str(tmp_path / "libs")) == []
    got = [(p["name"], p["kind"], p["root_relative_path"], [e["relative_path"] for e in p["entry_points"]]) for p in load_projects(files)]
    assert got == [("core", "library", "libs/core", ["libs/core/src/index.ts"]), ("one", "unknown", "packages/one", ["packages/one/esm.js", "packages/one/main.js"]), ("xy", "unknown", "tools/x/y", [])]


def test_path_functions(spark):
    cases = {"a/b.ts": ("a", "b.ts", ".ts", "a/b.ts"), ".gitignore": (None, ".gitignore", "", ".gitignore"), "a/./b/../c.d.ts": ("a/./b/..", "c.d.ts", ".ts", "a/c.d.ts"), "../x": ("..", "x", "", "../x"), "./a/../..": ("./a/..", "..", "", ".."), "a/": (None, "a", "", "a/"), "x.": (None, "x.", ".", "x.")}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = {r["p"]: tuple(r)[1:] for r in df.select("p", paths.dirname("p"), paths.basename("p"), paths.extname("p"), paths.normalize("p")).collect()}
    assert got == cases


def test_binary_and_globs(spark):
    df = spark.createDataFrame([(1, b""), (2, b"text\n"), (3, b"a\x00b"), (4, bytes([1, 1, 65, 65])), (5, bytes([1, 65, 65, 65]))], "i int, c binary")
    assert {r["i"]: r[1] for r in df.select("i", fl.is_binary("c")).collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}
    assert fl.glob_regex("a/**/b?[!x]*.ts") == r"a/(?:.*/)?b[^/][^x][^/]*\.ts"
    assert [fl.glob_regex(g) for g in ("**", r"\*\[", "[ab", "a]", "[]", "x.[tj]s")] == [".*", r"\*\[", r"\[ab", r"a\]", r"\[\]", r"x\.[tj]s"]
    assert [r[1:] for r in fl.ignore_rules("# c\n\\!x\n!y/\n/z\n\n/")] == [(False, False), (True, True), (False, False)]
    assert df.select(F.lit("packages/a").rlike(fl.workspace_regex("packages/*")), F.lit("packages/a/b").rlike(fl.workspace_regex("packages/*"))).first()[:] == (True, False)
