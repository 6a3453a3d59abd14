"""The command line over a real folder, and streams of snapshots."""

import datetime
import json

import pytest
from test_parse_scan import tree

from corvane import cli
from corvane.plans.repository import analysis_only, open_repository, summary, write_tables
from corvane.streaming.changes import SNAPSHOT, changed_files, new_contents, on_change

FILES = {
    ".gitignore": "*.log\n", "x.log": "x", "README.md": "# r", "tsconfig.base.json": '{"compilerOptions": {"paths": {"@acme/core": ["libs/core/src/index.ts"]}}}',
    "apps/web/project.json": '{"name": "web", "projectType": "application", "targets": {"build": {"options": {"main": "apps/web/src/main.ts"}}}}', "apps/web/src/main.ts": "import { tool, gone } from '@acme/core';\nimport React from 'react';\nexport const start = () => tool();\n",
    "libs/core/project.json": '{"name": "core", "projectType": "library", "targets": {"build": {"options": {"main": "libs/core/src/index.ts"}}}}', "libs/core/src/index.ts": "export { tool } from './tool';\nexport * from './more';\n",
    "libs/core/src/tool.ts": "import { more } from './more';\nexport function tool() { return more; }\n", "libs/core/src/more.ts": "import './tool';\nexport const more = 1;\nexport class Box { open() {} }\n", "libs/core/src/bad.ts": "const = ;\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    tree(path, FILES)
    return str(path)


def call(spark, *argv):
    out, err = [], []
    code = cli.run(list(argv), spark, out.append, err.append, iter([0.0, 1.5, 2.0]).__next__)
    return code, "\n".join(out), "\n".join(err)


def test_index(spark, root):
    code, out, _ = call(spark, "index", root)
    assert code == 0 and out == "Repository scanned successfully\nDirectories: 6\nFiles: 10\nLanguages\nJSON: 3\nMarkdown: 1\nTypeScript: 5\nUnknown: 1\nIgnored: 1\nDuration: 1.50s"


def test_analyze(spark, root):
    code, out, _ = call(spark, "analyze", root)
    lines = out.split("\n")
    assert code == 0 and lines[0] == "Repository analyzed successfully"
    for want in ("Files scanned: 10", "Files parsed: 5", "Files skipped: 5", "Functions: 2", "Classes: 1", "Methods: 1", "Variables: 1", "Internal dependencies: 5", "External dependencies: 1", "Unresolved dependencies: 1", "Dependency cycles: 1", "Projects: 2", "Cross-project dependencies: 1", "Files with syntax errors: 1", "Orphan source files: 1"):
        assert want in lines, (want, out)
    code, out, _ = call(spark, "analyze", root, "--json")
    doc = json.loads(out)
    assert list(doc) == ["schemaVersion", "command", "repository", "summary", "analysis", "resolution", "knowledge"] and doc["schemaVersion"] == "3"
    assert doc["resolution"]["unresolvedDependencies"][0]["reason"] == "EXPORT_NOT_FOUND"
    assert doc["resolution"]["cycles"][0]["relativePaths"] == ["libs/core/src/more.ts", "libs/core/src/tool.ts"]
    assert [p["name"] for p in doc["knowledge"]["projects"]] == ["web", "core"]
    assert call(spark, "analyze", root, "--json")[1] == out


def test_an_analysis_by_itself(spark, root):
    """The parsed files alone, without aliases and projects: imports through the alias are external to it."""
    repo = open_repository(spark, root)
    text = cli.analysis_text(summary(analysis_only(root, repo.analysis)), 0.5).split("\n")
    for want in ("Files scanned: 10", "Files parsed: 5", "Functions: 2", "Internal dependencies: 4", "Projects: 0", "Cross-project dependencies: 0", "Duration: 0.50s"):
        assert want in text, (want, text)


def test_context_and_graph(spark, root, tmp_path):
    code, out, _ = call(spark, "context", root, "--symbol", "tool", "--in", "libs/core/src/tool.ts", "--json")
    got = json.loads(out)
    assert code == 0 and got["excerpts"][0]["reasons"] == ["target-symbol"] and "export function tool()" in got["excerpts"][0]["text"]
    code, out, _ = call(spark, "context", root, "--project", "core", "--no-source")
    assert code == 0 and out.startswith("Context package\nTarget: project core\nFile: libs/core\nProject: core\nSelected\n")
    path = str(tmp_path / "graph.json")
    code, out, _ = call(spark, "graph", root, "--view", "file-dependencies", "--output", path, "--pretty")
    assert code == 0 and "View: file-dependencies" in out and len(json.load(open(path))["graph"]["edges"]) == 5
    code, _, err = call(spark, "context", root, "--file", "none.ts")
    assert code == 1 and err == "Context file target was not found."


@pytest.mark.parametrize("argv", [[], ["run"], ["index", "a", "b"], ["index", "--json"], ["context"], ["context", "--file"], ["context", "--in", "x"], ["context", "--file", "a", "--max-files", "x"], ["graph", "--view", "odd"], ["analyze", "--json", "--json"]])
def test_usage_errors(argv):
    err = []
    assert cli.run(argv, None, lambda s: None, err.append) == 1 and err


def test_tables_sink(spark, root, tmp_path):
    repo = open_repository(spark, root)
    write_tables(repo, str(tmp_path / "model"))
    assert spark.read.parquet(str(tmp_path / "model" / "relations")).count() == repo.knowledge.relations.count()
    assert not repo.knowledge.files.where("relative_path = 'libs/core/src/more.ts' AND size(public_symbol_ids) <> 2").count()


def test_changed_files(spark):
    table = lambda rows: spark.createDataFrame(rows, "relative_path string, content_hash string")
    got = changed_files(table([("a", "1"), ("b", "1"), ("c", "1")]), table([("a", "1"), ("b", "2"), ("d", "1")]))
    assert sorted(map(tuple, got.collect())) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_stream_of_snapshots(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    when = datetime.datetime(2024, 1, 1, 12)
    for n, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")]]):
        spark.createDataFrame([(n, when + datetime.timedelta(minutes=n), *r) for r in rows], SNAPSHOT).write.mode("append").parquet(folder)
        on_change(new_contents(spark, folder), lambda df, _: seen.extend((r["relative_path"], r["content_hash"]) for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(seen) == [("a", "1"), ("b", "1"), ("b", "2")]
