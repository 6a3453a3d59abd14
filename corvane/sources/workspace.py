"""A workspace's settings: module aliases and projects, from its configuration files. Short lists, read on the driver."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.files import workspace_regex
from corvane.schemas import WorkspaceError

ALIAS_FILE = "tsconfig.base.json"


def _parsed(files: DataFrame, condition) -> list[tuple[str, object]]:
    """Path and JSON of the configuration files that match, by path."""
    out = []
    for r in files.where(condition).select("relative_path", "content").orderBy("relative_path").toLocalIterator():
        try:
            out.append((r["relative_path"], json.loads(bytes(r["content"]).decode("utf-8", "replace"))))
        except ValueError as e:
            raise WorkspaceError("INVALID_JSON", f"Not valid JSON: {r['relative_path']}") from e
    return out


def _settings(files: DataFrame, root: str | None) -> list:
    """The alias file's JSON: read at the root, where it counts even if the scan passes it over, or from the scan."""
    if root is None:
        return [conf for _, conf in _parsed(files, F.col("relative_path") == ALIAS_FILE)]
    try:
        with open(os.path.join(root, ALIAS_FILE), encoding="utf-8", errors="replace") as f:
            return [json.load(f)]
    except FileNotFoundError:
        return []
    except ValueError as e:
        raise WorkspaceError("INVALID_JSON", f"Not valid JSON: {ALIAS_FILE}") from e


def load_aliases(files: DataFrame, root: str | None = None) -> list[tuple[str, list[str]]]:
    """(alias, target paths) of the compiler's path settings."""
    out = []
    for conf in _settings(files, root):
        options = conf.get("compilerOptions") if isinstance(conf, dict) else None
        paths = options.get("paths") if isinstance(options, dict) else None
        for alias, targets in sorted((paths or {}).items()):
            if isinstance(targets, list) and targets and all(isinstance(t, str) for t in targets):
                name = alias.removesuffix("/*")
                if name:
                    out.append((name, [re.sub(r"/\*$", "/index.ts", re.sub(r"^\./", "", t)) for t in targets]))
    return out


def _export_paths(value) -> set[str]:
    if isinstance(value, str):
        return {value}
    inner = value if isinstance(value, list) else value.values() if isinstance(value, dict) else ()
    return set().union(*map(_export_paths, inner)) if inner else set()


def load_projects(files: DataFrame) -> list[dict]:
    """Projects: every project.json with a name, and packages of the workspace's patterns that have no project.json."""
    path = F.col("relative_path")
    out, taken = [], set()
    for at, conf in _parsed(files, (path == "project.json") | path.endswith("/project.json")):
        if not isinstance(conf, dict) or not isinstance(conf.get("name"), str) or not conf["name"]:
            continue
        root = at[: -len("project.json")].rstrip("/")
        targets = conf["targets"].values() if isinstance(conf.get("targets"), dict) else ()
        mains = {t["options"]["main"].removeprefix("./") for t in targets if isinstance(t, dict) and isinstance(t.get("options"), dict) and isinstance(t["options"].get("main"), str)}
        kind = conf.get("projectType") if conf.get("projectType") in ("application", "library") else "unknown"
        source = conf.get("sourceRoot") if isinstance(conf.get("sourceRoot"), str) else None
        out.append({"name": conf["name"], "kind": kind, "root_relative_path": root, "source_root_relative_path": source, "entry_points": [{"relative_path": m} for m in sorted(mains)]})
        taken.add(root)
    patterns: list[str] = []
    named: list[str] = []
    for _, conf in _parsed(files, path == "package.json"):
        found = conf.get("workspaces") if isinstance(conf, dict) else None
        found = found.get("packages") if isinstance(found, dict) else found
        patterns = sorted(p.removeprefix("./").removesuffix("/") for p in found or [] if isinstance(p, str)) if isinstance(found, list) else []
    if patterns:
        match = F.lit(False)
        for p in patterns:
            match = match | F.regexp_replace("relative_path", "/package\\.json$", "").rlike(workspace_regex(p))
        for at, conf in _parsed(files, path.endswith("/package.json") & match):
            root = at[: -len("/package.json")]
            if root in taken or not isinstance(conf, dict) or not isinstance(conf.get("name"), str) or not conf["name"]:
                continue
            wanted = {conf[c] for c in ("main", "module", "types") if isinstance(conf.get(c), str)} | _export_paths(conf.get("exports"))
            places = sorted({f"{root}/{w.removeprefix('./')}".replace("//", "/") for w in wanted})
            out.append({"name": conf["name"], "kind": "unknown", "root_relative_path": root, "source_root_relative_path": None, "entry_points": places})
            named += places
    # of what packages name, what the scan has: one look for all of them
    there = {r["relative_path"] for r in files.where(path.isin(named)).select("relative_path").collect()} if named else set()
    for p in out:
        p["entry_points"] = [e if isinstance(e, dict) else {"relative_path": e} for e in p["entry_points"] if isinstance(e, dict) or e in there]
    return sorted(out, key=lambda p: (p["root_relative_path"], p["name"]))
