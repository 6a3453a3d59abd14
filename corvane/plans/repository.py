"""The whole way from a folder to the knowledge model, and its summaries and exports."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.order import human
from corvane.functions.tables import checkpointed
from corvane.operators.context import Stages
from corvane.operators.knowledge import Knowledge, build_knowledge
from corvane.operators.parse import Analysis, analyze
from corvane.operators.resolve import Resolution, resolve
from corvane.schemas import SYMBOL_KINDS
from corvane.sources.repository import IGNORE_FILES, MAX_BYTES, scan_entries, scan_tables
from corvane.sources.workspace import load_aliases, load_projects


@dataclass
class Repository:
    root: str
    files: DataFrame  # the scan, with content
    counts: DataFrame
    analysis: Analysis
    resolution: Resolution
    knowledge: Knowledge

    def stages(self) -> Stages:
        a = self.analysis
        return Stages(self.files.drop("content"), a.parsed_files, a.imports, a.exports, a.diagnostics, self.resolution, self.knowledge, (self.root,))


def open_repository(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, ignore_files=IGNORE_FILES) -> Repository:
    """Scan, parse, resolve and model a source tree."""
    import os

    files, counts = scan_tables(scan_entries(spark, root, max_bytes, ignore_files))
    files = checkpointed(files)  # read once: later stages see the bytes that were hashed
    a = analyze(files)
    scan = files.drop("content")
    resolution = resolve(scan, a.parsed_files, a.symbols, a.imports, a.exports, load_aliases(files, os.path.realpath(root)))
    path = os.path.realpath(root)
    knowledge = build_knowledge(path, scan, a.parsed_files, a.failures, a.symbols, a.imports, a.exports, a.diagnostics, resolution, load_projects(files))
    return Repository(path, files, counts, a, resolution, knowledge)


def analysis_only(root: str, a: Analysis) -> Repository:
    """What an analysis says by itself: its parsed files stand for the scan, without aliases or projects."""
    none = F.lit(None).cast("string")
    scan = a.parsed_files.select(F.col("file_id").alias("id"), "relative_path", F.concat(F.lit(f"{root}/"), "relative_path").alias("absolute_path"), none.alias("extension"), "language", F.lit(0).cast("long").alias("size_bytes"), "content_hash", F.lit(None).cast("timestamp").alias("last_modified"))
    counts = scan.agg(F.count(F.lit(1)).alias("total_files"), F.lit(0).alias("total_directories"), F.lit(0).alias("total_ignored_entries"))
    resolution = resolve(scan, a.parsed_files, a.symbols, a.imports, a.exports)
    knowledge = build_knowledge(root, scan, a.parsed_files, a.failures, a.symbols, a.imports, a.exports, a.diagnostics, resolution)
    return Repository(root, scan, counts, a, resolution, knowledge)


def language_histogram(files: DataFrame) -> list[tuple[str, int]]:
    return [(r["language"], r["count"]) for r in files.groupBy("language").count().orderBy(*human("language")).collect()]


def summary(repo: Repository) -> dict:
    """The counters of an analysis, in their fixed order."""
    a, r, k = repo.analysis, repo.resolution, repo.knowledge.summaries.first()
    meta = a.meta.first()
    kinds = dict.fromkeys(SYMBOL_KINDS, 0) | {x["kind"]: x["count"] for x in a.symbols.groupBy("kind").count().collect()}
    broken = a.diagnostics.where("code = 'TREE_SITTER_SYNTAX_ERROR'").select("file_id").distinct().count()
    return {
        "scannedFileCount": meta["scanned_file_count"], "parsedFileCount": meta["parsed_file_count"], "skippedFileCount": meta["skipped_file_count"], "failedFileCount": meta["failed_file_count"], "filesWithSyntaxErrors": broken,
        "symbolCount": sum(kinds.values()), "importCount": a.imports.count(), "exportCount": a.exports.count(), "internalDependencyCount": r.dependencies.count(), "externalDependencyCount": r.external.count(),
        "resolvedSymbolBindingCount": r.bindings.count(), "unresolvedDependencyCount": r.unresolved.count(), "cycleCount": r.cycles(a.parsed_files).count(), "projectCount": k["project_count"], "folderCount": k["folder_count"],
        "knowledgeFileCount": k["file_count"], "publicFileSymbolCount": k["public_file_symbol_count"], "publicProjectSymbolCount": k["public_project_symbol_count"], "crossProjectDependencyCount": k["cross_project_dependency_count"],
        "orphanFileCount": k["orphan_file_count"], "symbolsByKind": kinds,
    }


def camel(value):
    """Rows and their parts as plain values with camelCase keys."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k.split("_")[0] + "".join(w.capitalize() for w in k.split("_")[1:]): camel(v) for k, v in value.items()}
    return [camel(v) for v in value] if isinstance(value, list) else value


#: Fields of a relation's metadata by its type.
_METADATA = {
    "dependency": ("type", "dependencyId", "typeOnly"), "export": ("type", "exportId", "exportedName", "typeOnly"), "binding": ("type", "bindingId", "bindingKind", "importedName", "localName", "typeOnly"),
    "project-dependency": ("type", "projectDependencyId", "dependencyCount", "typeOnlyDependencyCount"),
}


def analysis_document(repo: Repository) -> dict:
    """The analysis as one document (schema 3). It is as large as the repository: for very large ones write_tables is the sink."""
    a, r, k = repo.analysis, repo.resolution, repo.knowledge
    spot = ["location.start_line", "location.start_column"]
    grouped: dict[str, dict[str, list]] = {}
    for name, table, order in (("symbols", a.symbols, [*spot, "kind", "name"]), ("imports", a.imports, [*spot, "source", "kind"]), ("exports", a.exports, [*spot, "kind", "exported_name"]), ("diagnostics", a.diagnostics, [*spot, "code"])):
        for row in table.orderBy("file_id", *order).toLocalIterator():
            entry = camel(row)
            if name == "diagnostics":
                entry.pop("fileId")
            grouped.setdefault(row["file_id"], {}).setdefault(name, []).append(entry)
    parts = ("symbols", "imports", "exports", "diagnostics")
    files = [camel(f) | {p: grouped.get(f["file_id"], {}).get(p, []) for p in parts} for f in a.parsed_files.select("file_id", "relative_path", "language", "content_hash").orderBy(*human("relative_path")).collect()]
    links: dict[str, dict[str, list]] = {}
    for name, table, key in (("imports", r.imports, "import_id"), ("exports", r.exports, "export_id")):
        for row in table.orderBy("source_file_id", *spot, key).drop("location").toLocalIterator():
            links.setdefault(row["source_file_id"], {}).setdefault(name, []).append(camel(row))
    modules = []
    for m in r.modules(a.parsed_files).orderBy(*human("relative_path")).collect():
        own = links.get(m["file_id"], {})
        modules.append({"fileId": m["file_id"], "relativePath": m["relative_path"], "language": m["language"], "imports": own.get("imports", []), "exports": own.get("exports", []), "incomingDependencyIds": m["incoming_dependency_ids"], "outgoingDependencyIds": m["outgoing_dependency_ids"]})
    rows = lambda t, *order: [camel(x) for x in t.orderBy(*order).collect()]
    relations = rows(k.relations, *human("source_node_id", "kind", "target_node_id", "id"))
    for x in relations:
        if x["metadata"] is not None:
            x["metadata"] = {f: x["metadata"][f] for f in _METADATA[x["metadata"]["type"]]}
    paths = k.files.select(F.col("file_id").alias("__f"), F.col("relative_path").alias("__p"))
    edges = r.dependencies.join(paths, F.col("source_file_id") == F.col("__f")).drop("__f")
    symbols = k.symbols.join(paths, F.col("file_id") == F.col("__f")).orderBy(*human("__p"), *spot, "symbol_kind", "qualified_name").drop("__f", "__p")
    return {
        "schemaVersion": "3",
        "command": "analyze",
        "repository": {"rootPath": repo.root},
        "summary": summary(repo),
        "analysis": {"files": files, "failures": rows(a.failures, *human("relative_path"))},
        "resolution": {
            "modules": modules,
            "dependencies": [camel(x) for x in edges.orderBy(*human("__p"), "target_file_id", "kind", "source_specifier", "id").drop("__p").collect()],
            "externalDependencies": rows(r.external, "source_file_id", "source_specifier", "type_only"),
            "symbolBindings": rows(r.bindings, "source_file_id", "source_entity_id", "target_file_id", "id"),
            "unresolvedDependencies": rows(r.unresolved, *human("source_relative_path"), "source_entity_id", "reason", "id"),
            "cycles": rows(r.cycles(a.parsed_files), F.array_join("relative_paths", "\0")),
        },
        "knowledge": {
            "repository": camel(k.repository.first()), "projects": rows(k.projects, *human("root_relative_path", "name")), "folders": rows(k.folders, *human("relative_path")), "files": rows(k.files, *human("relative_path")),
            "symbols": [camel(x) for x in symbols.collect()], "relations": relations, "projectDependencies": rows(k.project_dependencies, "source_project_id", "target_project_id"),
        },
    }


def write_tables(repo: Repository, path: str) -> None:
    """Every table of the model as Parquet under a folder: the sink that grows with the repository."""
    k, a, r = repo.knowledge, repo.analysis, repo.resolution
    tables = {
        "scan_files": repo.files.drop("content"), "parsed_files": a.parsed_files, "symbols": a.symbols, "imports": a.imports, "exports": a.exports, "diagnostics": a.diagnostics, "failures": a.failures, "resolved_imports": r.imports,
        "resolved_exports": r.exports, "dependencies": r.dependencies, "external_dependencies": r.external, "symbol_bindings": r.bindings, "unresolved": r.unresolved, "cycles": r.cycles(a.parsed_files), "repository": k.repository,
        "projects": k.projects, "folders": k.folders, "files": k.files, "symbol_nodes": k.symbols, "relations": k.relations, "project_dependencies": k.project_dependencies, "summaries": k.summaries,
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def document_text(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"
