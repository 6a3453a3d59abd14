"""Tables of the repository model as DDL, enumerations, and the errors of its stages."""

LOCATION = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"

SCAN_FILES = "id string, relative_path string, absolute_path string, extension string, language string, size_bytes bigint, content_hash string, last_modified timestamp"
PARSED_FILES = "file_id string, relative_path string, language string, content_hash string"
SYMBOLS = f"id string, name string, qualified_name string, kind string, file_id string, parent_symbol_id string, exported boolean, async boolean, location {LOCATION}"
IMPORTS = f"id string, file_id string, source string, kind string, imported_name string, local_name string, type_only boolean, location {LOCATION}"
EXPORTS = f"id string, file_id string, kind string, exported_name string, local_name string, source string, symbol_id string, type_only boolean, location {LOCATION}"
DIAGNOSTICS = f"file_id string, severity string, code string, message string, location {LOCATION}"
FAILURES = "file_id string, relative_path string, code string, message string"
ALIASES = "alias string, target_relative_paths array<string>"
ENTRY_POINT = "struct<export_name:string,relative_path:string>"
PROJECT_DEFS = f"name string, kind string, root_relative_path string, source_root_relative_path string, entry_points array<{ENTRY_POINT}>"
METADATA = (
    "struct<type:string,dependency_id:string,export_id:string,exported_name:string,binding_id:string,binding_kind:string,imported_name:string,"
    "local_name:string,project_dependency_id:string,dependency_count:int,type_only_dependency_count:int,type_only:boolean>"
)

# The names that the model's outputs must use.
LANGUAGES = {
    ".c": "C", ".cpp": "C++", ".cs": "C#", ".go": "Go", ".java": "Java", ".js": "JavaScript", ".json": "JSON", ".jsx": "JSX",
    ".md": "Markdown", ".py": "Python", ".rs": "Rust", ".ts": "TypeScript", ".tsx": "TSX", ".yaml": "YAML", ".yml": "YAML",
}
PARSEABLE = ("TypeScript", "TSX", "JavaScript", "JSX")
SYMBOL_KINDS = ("function", "class", "method", "constructor", "interface", "type-alias", "enum", "variable")
NODE_KINDS = ("repository", "project", "folder", "file", "symbol")
RELATION_KINDS = ("contains", "belongs-to-project", "declares", "exports", "depends-on", "binds-to", "parent-symbol", "project-depends-on")
#: relation kind, source node kind, target node kind
ENDPOINT_KINDS = [
    *[("contains", "repository", t) for t in ("project", "folder", "file")],
    *[("contains", "project", t) for t in ("folder", "file", "symbol")],
    *[("contains", "folder", t) for t in ("folder", "file")],
    *[("belongs-to-project", s, "project") for s in ("file", "symbol")],
    *[(k, "file", "symbol") for k in ("declares", "exports", "binds-to")],
    ("depends-on", "file", "file"),
    ("parent-symbol", "symbol", "symbol"),
    ("project-depends-on", "project", "project"),
]


class InputError(ValueError):
    """A stage was given input that contradicts itself; `code` says how."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class ResolverInputError(InputError):
    pass


class KnowledgeInputError(InputError):
    pass


class GraphInputError(InputError):
    pass


class ArtifactError(InputError):
    pass


class ContextError(InputError):
    pass


class ScanError(InputError):
    pass


class WorkspaceError(InputError):
    pass
