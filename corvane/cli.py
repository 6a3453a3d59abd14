"""The command line: index, analyze, context, graph. Exit 0 on success, 1 with a message on standard error."""

from __future__ import annotations

import os
import re
import sys
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from corvane.operators import artifact as art
from corvane.operators.context import build_context
from corvane.operators.graph import VIEWS, create_graph
from corvane.plans import repository as plan
from corvane.schemas import SYMBOL_KINDS, InputError
from corvane.sources.repository import reread, scan_entries, scan_tables

OUTPUT = ".corvane/graph.json"
# The commands, flags and labels of the outputs below.
_LABELS = dict(zip(SYMBOL_KINDS, ("Functions", "Classes", "Methods", "Constructors", "Interfaces", "Type aliases", "Enums", "Variables"), strict=True))
_COMMANDS = ("index", "analyze", "context", "graph")
_TARGETS = {"--file": ("file", "relativePath"), "--symbol": ("symbol", "qualifiedName"), "--folder": ("folder", "relativePath"), "--project": ("project", "name")}
_CONTEXT_NUMBERS = {"--max-files": "maxFiles", "--max-symbols": "maxSymbols", "--max-relations": "maxRelations", "--max-excerpts": "maxExcerpts", "--max-source-chars": "maxTotalSourceCharacters", "--dependency-depth": "dependencyDepth", "--dependent-depth": "dependentDepth"}
_GRAPH_NUMBERS = {"--max-depth": "max_depth", "--max-nodes": "max_nodes", "--max-relations": "max_relations"}
_USAGE = {
    "index": "Usage: corvane index [repository-path]",
    "analyze": "Usage: corvane analyze [repository-path] [--json]",
    "context": "Usage: corvane context [repository-path] <--file path|--symbol name [--in path]|--folder path|--project name> [--json] [--no-source]",
    "graph": f"Usage: corvane graph [repository-path] [--output path] [--view {'|'.join(VIEWS)}] [--target node-id] [--max-depth number] [--max-nodes number] [--max-relations number] [--pretty]",
}


class UsageError(ValueError):
    pass


def parse_arguments(argv: list[str]) -> dict:
    """The command's settings; a UsageError says what can't be read."""
    if not argv or argv[0] not in _COMMANDS:
        raise UsageError(f"Usage: corvane <{'|'.join(_COMMANDS)}> [repository-path]")
    command, rest = argv[0], list(argv[1:])
    out: dict = {"command": command, "path": None, "json": False, "target": None, "options": {}, "graph": {}, "output": None, "pretty": False}

    def value() -> str:
        if not rest or rest[0].startswith("-") or not rest[0]:
            raise UsageError(_USAGE[command])
        return rest.pop(0)

    def number(flag: str) -> int:
        text = rest.pop(0) if rest else ""
        if not re.fullmatch(r"[+-]?\d+", text):
            raise UsageError(f"Invalid numeric option: {flag}")
        return int(text)

    while rest:
        word = rest.pop(0)
        if not word.startswith("-"):
            if out["path"] is not None:
                raise UsageError(_USAGE[command])
            out["path"] = word
        elif word == "--json" and command != "index" and not out["json"]:
            out["json"] = True
        elif command == "context" and word == "--no-source":
            out["options"]["includeSource"] = False
        elif command == "context" and word in _TARGETS:
            if out["target"]:
                raise UsageError(_USAGE[command])
            kind, way = _TARGETS[word]
            out["target"] = {"kind": kind, way: value()}
        elif command == "context" and word == "--in":
            if not out["target"] or out["target"]["kind"] != "symbol":
                raise UsageError(_USAGE[command])
            out["target"]["fileRelativePath"] = value()
        elif command == "context" and word in _CONTEXT_NUMBERS:
            out["options"][_CONTEXT_NUMBERS[word]] = number(word)
        elif command == "graph" and word == "--pretty" and not out["pretty"]:
            out["pretty"] = True
        elif command == "graph" and word == "--output" and out["output"] is None:
            out["output"] = value()
        elif command == "graph" and word == "--view" and "kind" not in out["graph"]:
            out["graph"]["kind"] = value()
            if out["graph"]["kind"] not in VIEWS:
                raise UsageError(_USAGE[command])
        elif command == "graph" and word == "--target" and "target_id" not in out["graph"]:
            out["graph"]["target_id"] = value()
        elif command == "graph" and word in _GRAPH_NUMBERS:
            out["graph"][_GRAPH_NUMBERS[word]] = number(word)
        else:
            raise UsageError(f"Unknown option: {word}\n{_USAGE[command]}")
    if command == "context" and not out["target"]:
        raise UsageError(_USAGE[command])
    return out


def scan_text(counts: dict, languages: list[tuple[str, int]], seconds: float) -> str:
    return "\n".join(["Repository scanned successfully", f"Directories: {counts['total_directories']}", f"Files: {counts['total_files']}", "Languages", *[f"{n}: {c}" for n, c in languages], f"Ignored: {counts['total_ignored_entries']}", f"Duration: {seconds:.2f}s"])


def analysis_text(s: dict, seconds: float) -> str:
    lost = ["Use --json to inspect unresolved dependencies."] if s["unresolvedDependencyCount"] else []
    return "\n".join([
        "Repository analyzed successfully", f"Files scanned: {s['scannedFileCount']}", f"Files parsed: {s['parsedFileCount']}", f"Files skipped: {s['skippedFileCount']}", f"Parse failures: {s['failedFileCount']}", "Symbols",
        *[f"{_LABELS[k]}: {s['symbolsByKind'][k]}" for k in SYMBOL_KINDS], f"Imports: {s['importCount']}", f"Exports: {s['exportCount']}", f"Files with syntax errors: {s['filesWithSyntaxErrors']}", "Module resolution",
        f"Internal dependencies: {s['internalDependencyCount']}", f"External dependencies: {s['externalDependencyCount']}", f"Resolved symbol bindings: {s['resolvedSymbolBindingCount']}", f"Unresolved dependencies: {s['unresolvedDependencyCount']}",
        f"Dependency cycles: {s['cycleCount']}", *lost, "Repository knowledge", f"Projects: {s['projectCount']}", f"Folders: {s['folderCount']}", f"Files: {s['knowledgeFileCount']}", f"Symbols: {s['symbolCount']}",
        f"Public file symbols: {s['publicFileSymbolCount']}", f"Public project symbols: {s['publicProjectSymbolCount']}", f"Cross-project dependencies: {s['crossProjectDependencyCount']}", f"Orphan source files: {s['orphanFileCount']}", f"Duration: {seconds:.2f}s",
    ])


def context_text(p: dict) -> str:
    t, m = p["target"], p["metrics"]
    project = next((x["name"] for x in p["entities"]["projects"] if x["nodeId"] == t["projectId"]), None)
    lines = ["Context package", f"Target: {t['kind']} {t['qualifiedName']}", f"File: {t['relativePath']}" if t["relativePath"] else "", f"Project: {project}" if project else "", "Selected", f"Files: {m['fileCount']}", f"Symbols: {m['symbolCount']}"]
    lines += [f"Relationships: {m['relationCount']}", f"Source excerpts: {m['excerptCount']}", f"Source characters: {m['sourceCharacterCount']:,}"]
    lines += ["Omissions", *[f"{o['reason']}: {o['count']}" for o in p["omissions"]]] if p["omissions"] else []
    return "\n".join(x for x in lines if x)


def graph_text(a: dict, root: str, path: str) -> str:
    return "\n".join(["Graph generated successfully", f"Repository: {root}", f"View: {a['view']['kind']}", f"Nodes: {a['summary']['nodeCount']}", f"Edges: {a['summary']['edgeCount']}", f"Omissions: {a['summary']['omissionCount']}", f"Output: {path}"])


def run(argv: list[str], spark: SparkSession | None = None, out: Callable[[str], None] = print, err: Callable[[str], None] = lambda s: print(s, file=sys.stderr), clock: Callable[[], float] = time.monotonic) -> int:
    """One command. The session, outputs and clock can be given."""
    try:
        args = parse_arguments(argv)
    except UsageError as e:
        err(str(e))
        return 1
    began = clock()
    spark = spark or SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    root = args["path"] or os.getcwd()
    try:
        if args["command"] == "index":
            files, counts = scan_tables(scan_entries(spark, root))
            out(scan_text(counts.first().asDict(), plan.language_histogram(files), clock() - began))
            return 0
        repo = plan.open_repository(spark, root)
        if args["command"] == "analyze":
            out(plan.document_text(plan.analysis_document(repo)).rstrip("\n") if args["json"] else analysis_text(plan.summary(repo), clock() - began))
        elif args["command"] == "context":
            package = build_context(repo.stages(), args["target"], args["options"], reread)
            out(plan.document_text(package).rstrip("\n") if args["json"] else context_text(package))
        else:
            made = art.create_artifact(create_graph(repo.knowledge), **args["graph"])
            path = art.write_artifact(made, os.path.join(repo.root, args["output"] or OUTPUT), args["pretty"])
            out(graph_text(made, repo.root, path))
        return 0
    except InputError as e:
        err(str(e))
        return 1


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
