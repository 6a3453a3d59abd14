"""The graph artifact: a view as one JSON document, built, checked, written and read."""

from __future__ import annotations

import json
import os
import tempfile

from corvane.operators.graph import Graph, Projection, view
from corvane.schemas import NODE_KINDS, RELATION_KINDS, ArtifactError


def _kept(pairs: dict) -> dict:
    return {k: v for k, v in pairs.items() if v is not None}


def node_entry(r) -> dict:
    """Presentation of a node; what a kind lacks is left out."""
    # a model by need has a list's length in its place
    kind, n = r["kind"], lambda c: r[c] if isinstance(r[c], int) else len(r[c] or [])
    base = {"id": r["id"], "kind": kind, "label": r["name"]}
    if kind == "repository":
        return base | {"metadata": {"projectCount": n("project_ids"), "fileCount": n("file_ids")}}
    if r["qualified_name"] != r["name"]:
        base["subtitle"] = r["qualified_name"]
    if kind != "symbol":
        base["path"] = r["root_relative_path"] if kind == "project" else r["relative_path"]
    if kind != "project" and r["project_id"] is not None:
        base["projectId"] = r["project_id"]
    if kind == "project":
        meta = {"projectKind": r["project_kind"], "fileCount": n("file_ids"), "symbolCount": n("symbol_ids"), "publicSymbolCount": n("public_symbol_ids")}
    elif kind == "folder":
        meta = {"descendantFileCount": r["descendant_file_count"], "descendantSymbolCount": r["descendant_symbol_count"]}
    elif kind == "file":
        meta = _kept({
            "status": r["status"], "language": r["language"], "symbolCount": n("symbol_ids"), "publicSymbolCount": n("public_symbol_ids"), "internalDependencyCount": r["internal_dependency_count"],
            "externalDependencyCount": r["external_dependency_count"], "hasSyntaxErrors": r["has_syntax_errors"], "orphan": r["orphan"],
        })
    else:
        meta = {"symbolKind": r["symbol_kind"], "exported": r["exported"], "defaultExport": r["default_export"], "typeOnly": r["type_only"], "async": r["async"], "startLine": r["location"]["start_line"], "startColumn": r["location"]["start_column"]}
    return base | {"metadata": meta}


def edge_entry(r) -> dict:
    m = r["metadata"]
    fields = {
        "dependency": (("typeOnly", "type_only"),), "export": (("exportedName", "exported_name"), ("typeOnly", "type_only")),
        "binding": (("bindingKind", "binding_kind"), ("importedName", "imported_name"), ("localName", "local_name"), ("typeOnly", "type_only")),
        "project-dependency": (("dependencyCount", "dependency_count"), ("typeOnlyDependencyCount", "type_only_dependency_count")),
    }
    meta = _kept({name: m[c] for name, c in fields[m["type"]]}) if m is not None else {}
    return {"id": r["id"], "sourceId": r["source_node_id"], "targetId": r["target_node_id"], "kind": r["kind"], "label": r["kind"], "metadata": meta}


def projection_entry(p: Projection) -> dict:
    """A projection as plain values; its size is bounded by the limits it was made with."""
    return {
        "schemaVersion": "1",
        "rootNodeIds": [r["id"] for r in p.roots.collect()],
        "nodes": [node_entry(r) for r in p.nodes.orderBy("place").collect()],
        "edges": [edge_entry(r) for r in p.edges.orderBy("place").collect()],
        "omissions": [{"reason": r["reason"], "entityKind": r["entity_kind"], "count": r["count"]} for r in p.omissions.orderBy("reason").collect()],
    }


def create_artifact(graph: Graph, kind: str = "repository", target_id: str | None = None, max_depth: int | None = None, max_nodes: int = 5000, max_relations: int = 20000) -> dict:
    got = projection_entry(view(graph, kind, target_id, max_depth, max_nodes, max_relations))
    repository = graph.nodes.where("kind = 'repository'").select("id", "name").first()
    return checked_artifact(
        {
            "artifactKind": "repository-graph",
            "schemaVersion": "1",
            "repository": {"id": repository["id"], "name": repository["name"]},
            "view": {"kind": kind, "targetNodeId": target_id, "maxDepth": max_depth, "maxNodes": max_nodes, "maxRelations": max_relations},
            "summary": {"nodeCount": len(got["nodes"]), "edgeCount": len(got["edges"]), "omissionCount": sum(o["count"] for o in got["omissions"])},
            "graph": got,
        }
    )


def _whole(x, least: int, most: float = float("inf")) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and least <= x <= most


def _problem(a) -> str | None:
    """The first thing wrong with an artifact, if any."""
    if not isinstance(a, dict) or a.get("artifactKind") != "repository-graph" or a.get("schemaVersion") != "1":
        return "not a repository graph"
    parts = {k: a.get(k) for k in ("repository", "view", "summary", "graph")}
    if not all(isinstance(x, dict) for x in parts.values()):
        return "a section is missing"
    repository, shown, summary, graph = parts.values()
    if not all(isinstance(repository.get(k), str) for k in ("id", "name")):
        return "repository"
    target, depth = shown.get("targetNodeId", ""), shown.get("maxDepth", "")
    if shown.get("kind") not in ("repository", "project-dependencies", "file-dependencies", "public-api", "full") or not (target is None or isinstance(target, str) and "targetNodeId" in shown):
        return "view"
    if not (depth is None or _whole(depth, 0, 10)) or not _whole(shown.get("maxNodes"), 1, 5000) or not _whole(shown.get("maxRelations"), 1, 20000):
        return "view limits"
    if not all(_whole(summary.get(k), 0) for k in ("nodeCount", "edgeCount", "omissionCount")):
        return "summary"
    if graph.get("schemaVersion") != "1" or not all(isinstance(graph.get(k), list) for k in ("rootNodeIds", "nodes", "edges", "omissions")):
        return "graph"
    plain = lambda m: isinstance(m, dict) and all(isinstance(v, str | int | float | bool) for v in m.values())
    seen: set[str] = set()
    for n in graph["nodes"]:
        if not isinstance(n, dict) or n.get("kind") not in NODE_KINDS or not all(isinstance(n.get(k), str) for k in ("id", "label")) or not all(isinstance(n.get(k, ""), str) for k in ("subtitle", "path", "projectId")) or not plain(n.get("metadata")):
            return "a node is malformed"
        if n["id"] in seen:
            return f"Duplicate graph node ID: {n['id']}"
        seen.add(n["id"])
    edges: set[str] = set()
    for e in graph["edges"]:
        if not isinstance(e, dict) or e.get("kind") not in RELATION_KINDS or not all(isinstance(e.get(k), str) for k in ("id", "sourceId", "targetId", "label")) or not plain(e.get("metadata")):
            return "an edge is malformed"
        if e["id"] in edges:
            return f"Duplicate graph edge ID: {e['id']}"
        edges.add(e["id"])
        if e["sourceId"] not in seen or e["targetId"] not in seen:
            return f"Graph edge references a missing node: {e['id']}"
    for r in graph["rootNodeIds"]:
        if not isinstance(r, str) or r not in seen:
            return f"Graph root references a missing node: {r}"
    for o in graph["omissions"]:
        if not isinstance(o, dict) or o.get("reason") not in ("NODE_LIMIT", "RELATION_LIMIT") or o.get("entityKind") not in ("node", "relation") or not _whole(o.get("count"), 1):
            return "an omission is malformed"
    for what, n in (("node", len(graph["nodes"])), ("edge", len(graph["edges"])), ("omission", sum(o["count"] for o in graph["omissions"]))):
        if summary[f"{what}Count"] != n:
            return f"Graph {what} count mismatch."
    return None


def checked_artifact(value) -> dict:
    if isinstance(value, dict) and "schemaVersion" in value and value["schemaVersion"] != "1":
        raise ArtifactError("UNSUPPORTED_SCHEMA_VERSION", f"Unsupported repository graph artifact schema: {value['schemaVersion']}")
    wrong = _problem(value)
    if wrong:
        raise ArtifactError("INVALID_ARTIFACT", f"Invalid repository graph artifact: {wrong}")
    return value


def serialized(artifact: dict, pretty: bool = False) -> str:
    checked_artifact(artifact)
    return json.dumps(artifact, ensure_ascii=False, **({"indent": 2} if pretty else {"separators": (",", ":")})) + "\n"


def write_artifact(artifact: dict, path: str, pretty: bool = False) -> str:
    """Written beside its place and moved there in one step; a file that is no artifact is not overwritten."""
    text, path = serialized(artifact, pretty), os.path.abspath(path)
    if os.path.lexists(path):
        try:
            with open(path, encoding="utf-8") as f:
                checked_artifact(json.load(f))
        except (OSError, ValueError) as e:
            raise ArtifactError("OUTPUT_NOT_ARTIFACT", f"Refusing to overwrite a file that is not a graph artifact: {path}") from e
    try:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, beside = tempfile.mkstemp(prefix=".graph-", suffix=".tmp", dir=os.path.dirname(path))
        try:
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(beside, path)
        except BaseException:
            os.unlink(beside)
            raise
    except OSError as e:
        raise ArtifactError("OUTPUT_WRITE_FAILED", f"Cannot write {path}: {e.strerror}") from e
    return path


def load_artifact(path: str | None) -> dict:
    """An artifact from a file; error codes tell what went wrong."""
    if not path:
        raise ArtifactError("NOT_CONFIGURED", "No artifact path is configured.")
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError as e:
        raise ArtifactError("NOT_FOUND", f"Artifact not found: {path}") from e
    except (OSError, UnicodeDecodeError) as e:
        raise ArtifactError("READ_FAILED", f"Artifact cannot be read: {path}") from e
    try:
        value = json.loads(text)
    except ValueError as e:
        raise ArtifactError("INVALID_JSON", f"Artifact is not JSON: {path}") from e
    return checked_artifact(value)


#: What a server answers for each error of load_artifact.
HTTP_STATUS = {"NOT_CONFIGURED": 404, "NOT_FOUND": 404, "READ_FAILED": 500, "INVALID_JSON": 422, "UNSUPPORTED_SCHEMA_VERSION": 422, "INVALID_ARTIFACT": 422}
