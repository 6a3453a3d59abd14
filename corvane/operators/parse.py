"""Symbols, imports and exports of JavaScript and TypeScript files.

Only the top level of a file counts, and one level of class and object members. Each file is read by itself in an
Arrow batch; a file that can't be read is a row of failures and touches no other. Columns of places are
characters from 0, lines count from 1.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.js_tokens import Source, Token
from corvane.functions.tables import checkpointed
from corvane.schemas import DIAGNOSTICS, EXPORTS, FAILURES, IMPORTS, PARSEABLE, SYMBOLS

_GO_ON = {".", "?.", ",", "(", "[", "=", "=>", "+", "-", "*", "/", "%", "&", "|", "^", "?", ":", "<", ">", "&&", "||", "??", "==", "===", "!=", "!==", "<=", ">=", "**", "+=", "-=", "*=", "/=", "||=", "&&=", "??=", ")", "]", "}"}
_GO_ON_NAMES = {"else", "catch", "finally", "instanceof", "in", "of", "as", "satisfies", "extends", "implements"}
_OPEN_END = {"else", "return", "typeof", "new", "extends", "implements", "as", "satisfies", "in", "of", "instanceof", "await", "keyof", "is"}
_MODIFIERS = {"public", "private", "protected", "static", "abstract", "override", "readonly", "declare", "accessor", "async", "get", "set"}


def _sha(*parts) -> str:
    return hashlib.sha256(":".join("true" if p is True else "false" if p is False else "" if p is None else str(p) for p in parts).encode("utf-8", "surrogatepass")).hexdigest()


class FileReader:
    """Reads one file's tokens into rows. Positions named `i` are token indexes."""

    def __init__(self, file_id: str, text: str, language: str) -> None:
        self.file, self.src = file_id, Source(text, language in ("TSX", "JSX", "JavaScript"))
        self.t = self.src.tokens
        self.n = len(self.t)
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.exports: list[dict] = []
        self.notes: list[dict] = []
        self.listed: set[str] = set()
        self.later: list = []

    # tokens
    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < self.n else ""

    def is_punct(self, i: int, text: str) -> bool:
        return 0 <= i < self.n and self.t[i].kind == "punct" and self.t[i].text == text

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.t[i].kind == "name"

    def past(self, i: int) -> int:
        """The token after this one, or after its bracket's other half."""
        return (self.t[i].mate if self.t[i].mate > i else i) + 1

    def location(self, first: int, last: int) -> dict:
        a, b, c, d = self.src.span(self.t[first].start, self.t[min(last, self.n - 1)].end)
        return {"start_line": a, "start_column": b, "end_line": c, "end_column": d}

    def ends_here(self, i: int) -> bool:
        """Whether a statement may end before token i, without a semicolon."""
        if i >= self.n:
            return True
        t, b = self.t[i], self.t[i - 1]
        if not t.line_before or (t.kind == "punct" and t.text in _GO_ON) or (t.kind == "name" and t.text in _GO_ON_NAMES):
            return False
        if b.kind == "punct" and b.text not in (")", "]", "}", "++", "--", ";", ">", "!"):
            return False
        return not (b.kind == "name" and b.text in _OPEN_END)

    def statement_end(self, i: int, stops: tuple[str, ...] = (";",)) -> int:
        """Index of the token after a statement or value that starts at i (a semicolon, if any, not passed)."""
        start = i
        while i < self.n:
            t = self.t[i]
            if t.kind == "punct" and (t.text in stops or (t.text in (")", "]", "}") and t.mate < i)):
                return i
            if i > start and self.ends_here(i):
                return i
            i = self.past(i)
        return self.n

    def past_generics(self, i: int) -> int:
        """Past `<...>` at i, if there is one."""
        if not self.is_punct(i, "<"):
            return i
        depth = 0
        while i < self.n:
            t = self.t[i]
            if t.kind == "punct" and t.text[0] == "<" and t.text in ("<", "<<"):
                depth += len(t.text)
            elif t.kind == "punct" and set(t.text) == {">"}:
                depth -= len(t.text)
                if depth <= 0:
                    return i + 1
            i = self.past(i)
        return i

    # rows
    def add_symbol(self, name: str, qualified: str, kind: str, first: int, last: int, parent: str | None, exported: bool, is_async: bool) -> dict:
        at = self.location(first, last)
        row = {"id": _sha("symbol", self.file, kind, qualified, at["start_line"], at["start_column"]), "name": name, "qualified_name": qualified, "kind": kind, "file_id": self.file, "parent_symbol_id": parent, "exported": exported, "async": is_async, "location": at}
        self.symbols.append(row)
        return row

    def add_import(self, first: int, last: int, source: str, kind: str, imported, local, types: bool) -> None:
        at = self.location(first, last)
        self.imports.append({"id": _sha("import", self.file, at["start_line"], at["start_column"], source, kind, imported, local, types), "file_id": self.file, "source": source, "kind": kind, "imported_name": imported, "local_name": local, "type_only": types, "location": at})

    def add_export(self, first: int, last: int, kind: str, name: str, local, source, symbol: dict | None, types: bool) -> None:
        at = self.location(first, last)
        if symbol is not None:
            symbol["exported"] = True
            for s in self.symbols:
                if s["parent_symbol_id"] == symbol["id"]:
                    s["exported"] = True
        self.exports.append({"id": _sha("export", self.file, at["start_line"], at["start_column"], kind, name, local, source, types), "file_id": self.file, "kind": kind, "exported_name": name, "local_name": local, "source": source, "symbol_id": symbol["id"] if symbol else None, "type_only": types, "location": at})

    def note(self, severity: str, code: str, message: str, at: dict) -> None:
        self.notes.append({"file_id": self.file, "severity": severity, "code": code, "message": message, "location": at})

    def top_symbol(self, name: str | None) -> dict | None:
        return next((s for s in self.symbols if s["parent_symbol_id"] is None and s["name"] == name), None) if name else None

    # statements
    def read(self) -> dict:
        for message, start, end in self.src.problems:
            a, b, c, d = self.src.span(start, end)
            self.note("error", "TREE_SITTER_SYNTAX_ERROR", message, {"start_line": a, "start_column": b, "end_line": c, "end_column": d})
        self._list_exports()
        i = 0
        while i < self.n:
            i = max(self._statement(i), i + 1)
        for action in self.later:  # exports refer to symbols that may stand below them
            action()
        at = lambda r: (r["location"]["start_line"], r["location"]["start_column"])
        return {
            "symbols": sorted(self.symbols, key=lambda r: (*at(r), r["kind"], r["name"])), "imports": sorted(self.imports, key=lambda r: (*at(r), r["source"], r["kind"])),
            "exports": sorted(self.exports, key=lambda r: (*at(r), r["kind"], r["exported_name"])), "diagnostics": sorted(self.notes, key=lambda r: (*at(r), r["code"])),
        }

    def _list_exports(self) -> None:
        """Names in `export { ... }` lists without a source: their variables count as exported."""
        i = 0
        while i < self.n:
            if self.text(i) == "export" and self.is_name(i):
                b = i + 2 if self.text(i + 1) == "type" else i + 1
                if self.is_punct(b, "{") and self.text(self.past(b)) != "from":
                    self.listed |= {local for _, _, local, _, _ in self._specifiers(b)}
            i = self.past(i)

    def _specifiers(self, brace: int):
        """(first, last, name, alias, type_only) of each entry of a `{ ... }` list."""
        i, end = brace + 1, self.t[brace].mate if self.t[brace].mate > 0 else self.n
        while i < end:
            first = i
            types = self.text(i) == "type" and i + 1 < end and not self.is_punct(i + 1, ",") and not (self.text(i + 1) == "as" and not self.is_name(i + 2))
            if types and self.text(i + 1) == "as" and self.text(i + 2) == "as":
                types = False
            i += types
            if i < end and self.t[i].kind in ("name", "string"):
                name = alias = self.text(i)
                last = i
                if self.text(i + 1) == "as" and i + 2 < end:
                    alias, last = self.text(i + 2), i + 2
                yield first, last, name, alias, types
                i = last + 1
            while i < end and not self.is_punct(i, ","):
                i = self.past(i)
            i += 1

    def _statement(self, i: int) -> int:
        t = self.t[i]
        if t.kind == "name" and t.text == "import" and not self.is_punct(i + 1, "(") and not self.is_punct(i + 1, "."):
            return self._import(i)
        if t.kind == "name" and t.text == "export":
            return self._export(i)
        if t.kind == "name" and t.text.startswith("@"):
            j = self._past_decorators(i)
            if self.text(j) in ("export", "class", "abstract"):
                return self._export(j) if self.text(j) == "export" else self._declaration(j, False, i)[0]
        got = self._declaration(i, False)
        if got:
            return got[0]
        if self.is_punct(i, "}") or self.is_punct(i, ";"):
            return i + 1
        end = self.statement_end(i)
        return end + 1 if self.is_punct(end, ";") else end

    def _past_decorators(self, i: int) -> int:
        while i < self.n and self.t[i].kind == "name" and self.t[i].text.startswith("@"):
            i += 1
            while self.is_punct(i, "."):
                i += 2
            if self.is_punct(i, "("):
                i = self.past(i)
        return i

    def _import(self, i: int) -> int:
        end = self.statement_end(i)
        source = next((j for j in range(i + 1, end) if self.t[j].kind == "string" and (j == i + 1 or self.text(j - 1) == "from")), None)
        past = end + 1 if self.is_punct(end, ";") else end
        if source is None:
            return past
        name = self.text(source)[1:-1]
        last = past - 1
        if source == i + 1:
            self.add_import(i, last, name, "side-effect", None, None, False)
            return past
        j = i + 1
        types = self.text(j) == "type" and not (self.text(j + 1) == "from" and self.t[j + 2].kind == "string") and not self.is_punct(j + 1, ",")
        j += types
        while j < source - 1:
            if self.is_punct(j, "{"):
                for first, stop, imported, local, own in self._specifiers(j):
                    self.add_import(first, stop, name, "named", imported, local, types or own)
                j = self.past(j)
            elif self.is_punct(j, "*"):
                self.add_import(j, j + 2, name, "namespace", "*", self.text(j + 2), types)
                j += 3
            elif self.is_name(j):
                self.add_import(j, j, name, "default", "default", self.text(j), types)
                j += 1
            else:
                j += 1
        return past

    def _export(self, i: int) -> int:
        j = i + 1
        default = self.text(j) == "default"
        types = self.text(j) == "type" and (self.is_punct(j + 1, "{") or self.is_punct(j + 1, "*"))
        at = self._past_decorators(j + default) if not types else j
        before = len(self.symbols)
        got = self._declaration(at, True, at) if not types and not self.is_punct(j, "{") and not self.is_punct(j, "*") else None
        if got:
            end, first, last, name = got
            mine = [s for s in self.symbols[before:] if s["parent_symbol_id"] is None]
            anonymous = default and not mine and name is None
            if not anonymous:

                def declared(mine=mine, first=first, last=last, name=name) -> None:
                    if not mine:
                        self.add_export(i, last, "default" if default else "named", "default" if default else name or "unknown", name, None, None, False)
                    for s in mine:
                        self.add_export(first, last, "default" if default else "named", "default" if default else s["name"], s["name"], None, s, s["kind"] in ("interface", "type-alias"))

                self.later.append(declared)
                return end
            self.later.append(lambda: self.add_export(i, last, "default", "default", None, None, None, False))
            return end
        b = j + types
        if self.is_punct(b, "{"):
            after = self.past(b)
            source = self.text(after + 1)[1:-1] if self.text(after) == "from" and after + 1 < self.n and self.t[after + 1].kind == "string" else None
            end = self.statement_end(after + 2 if source is not None else after) if source is not None else after
            entries = list(self._specifiers(b))

            def listed() -> None:
                for first, last, local, name, own in entries:
                    self.add_export(first, last, "named" if source is None else "re-export", name, local, source, self.top_symbol(local) if source is None else None, types or own)

            self.later.append(listed)
            return end + 1 if self.is_punct(end, ";") else end
        end = self.statement_end(j + default if j + default < self.n else j)
        past = end + 1 if self.is_punct(end, ";") else end
        if self.is_punct(b, "*") and self.text(b + 1) == "from" and b + 2 < self.n and self.t[b + 2].kind == "string":
            source = self.text(b + 2)[1:-1]
            self.later.append(lambda: self.add_export(i, past - 1, "export-all", "*", None, source, None, types))
            return past
        value = j + default if default else j + 1
        local = self.text(value) if default and value + 1 == end and self.is_name(value) or self.is_punct(j, "=") and value + 1 == end and self.is_name(value) else None
        self.later.append(lambda: self.add_export(i, past - 1, "default", "default", local, None, self.top_symbol(local), False))
        return past

    def _declaration(self, i: int, exported: bool, first: int | None = None) -> tuple[int, int, int, str | None] | None:
        """(index after, first token, last token, name) of a declaration at i, or None. Adds its symbols."""
        first = i if first is None else first
        word = self.text(i) if self.is_name(i) else ""
        j = i
        is_async = word == "async" and self.text(i + 1) == "function" and not self.t[i + 1].line_before
        if is_async:
            j += 1
        word = self.text(j) if self.is_name(j) else ""
        if word == "function":
            star = self.is_punct(j + 1, "*")
            name = j + 1 + star
            if not self.is_name(name):
                return (self._past_body(name), first, self._past_body(name) - 1, None) if exported else None
            end = self._past_body(name + 1)
            if not star and self.is_punct(end - 1, "}"):
                self.add_symbol(self.text(name), self.text(name), "function", first, end - 1, None, exported, is_async)
            return self._semicolon(end), first, end - 1, self.text(name)
        if word == "abstract" and self.text(j + 1) == "class":
            end = self._past_class(j + 2)
            return end, first, end - 1, self.text(j + 2)
        if word == "class":
            named = self.is_name(j + 1) and self.text(j + 1) not in ("extends", "implements")
            end = self._past_class(j + 1)
            if named:
                s = self.add_symbol(self.text(j + 1), self.text(j + 1), "class", first, end - 1, None, exported, False)
                if self.is_punct(end - 1, "}"):
                    self._members(self.t[end - 1].mate, s)
            elif not exported:
                self.note("warning", "MISSING_SYMBOL_NAME", "Skipped an unnamed class_declaration.", self.location(first, end - 1))
            return end, first, end - 1, self.text(j + 1) if named else None
        if word in ("interface", "enum") and self.is_name(j + 1) and not self.t[j + 1].line_before or word == "const" and self.text(j + 1) == "enum":
            name = j + 2 if word == "const" else j + 1
            k = name + 1
            while k < self.n and not self.is_punct(k, "{"):
                k = self.past(k)
            if k >= self.n:
                return None
            end = self.past(k)
            self.add_symbol(self.text(name), self.text(name), "interface" if word == "interface" else "enum", first, end - 1, None, exported, False)
            return end, first, end - 1, self.text(name)
        if word == "type" and self.is_name(j + 1) and not self.t[j + 1].line_before and (self.is_punct(j + 2, "=") or self.is_punct(j + 2, "<")):
            end = self.statement_end(self.past_generics(j + 2))
            end = self._semicolon(end)
            self.add_symbol(self.text(j + 1), self.text(j + 1), "type-alias", first, end - 1, None, exported, False)
            return end, first, end - 1, self.text(j + 1)
        if word in ("const", "let", "var") and (self.is_name(j + 1) or self.is_punct(j + 1, "{") or self.is_punct(j + 1, "[")):
            end = self._variables(j + 1, exported)
            end = self._semicolon(end)
            return end, first, end - 1, None
        if word in ("declare", "namespace", "module") and (self.is_name(j + 1) or self.t[min(j + 1, self.n - 1)].kind == "string") and j + 1 < self.n and not self.t[j + 1].line_before:
            k = j + 1
            while k < self.n and not self.is_punct(k, "{") and not self.is_punct(k, ";") and not (k > j + 1 and self.ends_here(k)):
                k = self.past(k)
            end = self.past(k) if self.is_punct(k, "{") else self._semicolon(k)
            return end, first, max(first, end - 1), None if word == "declare" else self.text(j + 1)
        return None

    def _semicolon(self, i: int) -> int:
        return i + 1 if self.is_punct(i, ";") else i

    def _past_body(self, i: int) -> int:
        """Past a function's parameters, return type and body (or signature)."""
        i = self.past_generics(i)
        if self.is_punct(i, "("):
            i = self.past(i)
        if self.is_punct(i, ":"):
            i += 1
            if self.is_punct(i, "{"):  # a return type that is an object type
                i = self.past(i)
            while i < self.n and not self.is_punct(i, "{") and not self.is_punct(i, ";") and not self.ends_here(i):
                i = self.past_generics(i) if self.is_punct(i, "<") else self.past(i)
                if self.is_punct(i, "{") and self.t[i - 1].kind == "punct" and self.text(i - 1) in ("|", "&", "=>", ":", "<", ","):
                    i = self.past(i)
        return self.past(i) if self.is_punct(i, "{") else i

    def _past_class(self, i: int) -> int:
        while i < self.n and not self.is_punct(i, "{"):
            i = self.past_generics(i) if self.is_punct(i, "<") else self.past(i)
        return self.past(i) if i < self.n else i

    def _method_name(self, i: int, end: int) -> tuple[int, bool]:
        """(index of the name, async) of a member that starts at i: past its modifiers."""
        is_async = False
        while i < end:
            after = i + 1
            is_word = self.is_name(i) and self.text(i) in _MODIFIERS
            ends = after >= end or (self.t[after].kind == "punct" and self.text(after) in ("(", ":", "=", ";", ",", "<", "?", "!", "}"))
            if self.is_punct(i, "*") or (is_word and not ends):
                is_async = is_async or self.text(i) == "async"
                i = after
            else:
                break
        return i, is_async

    def _members(self, brace: int, owner: dict) -> None:
        i, end = brace + 1, self.t[brace].mate
        while i < end:
            i = self._past_decorators(i)
            if i >= end or self.is_punct(i, ";"):
                i += 1
                continue
            first = i
            name, is_async = self._method_name(i, end)
            computed = self.is_punct(name, "[")
            k = self.past(name) if name < end else end
            k += self.is_punct(k, "?")
            if name < end and (self.is_punct(k, "(") or self.is_punct(k, "<")) and not self.is_punct(name, "{"):
                stop = self._past_body(k)
                if self.is_punct(stop - 1, "}") and stop - 1 > self.t[self.past_generics(k)].mate:
                    if computed:
                        self.note("warning", "MISSING_SYMBOL_NAME", "Skipped an unnamed method_definition.", self.location(first, stop - 1))
                    else:
                        text = self.text(name)
                        self.add_symbol(text, f"{owner['qualified_name']}.{text}", "constructor" if text == "constructor" else "method", first, stop - 1, owner["id"], owner["exported"], is_async)
                i = max(stop, first + 1)
                continue
            if self.text(first) == "static" and self.is_punct(first + 1, "{"):
                i = self.past(first + 1)
                continue
            i = max(self.statement_end(first), first + 1)

    def _value(self, i: int, end: int) -> tuple[str, bool]:
        """(kind, async) of a value that takes up tokens i to end."""
        is_async = self.text(i) == "async" and self.is_name(i) and i + 1 < end
        j = i + is_async
        if self.is_name(j) and self.text(j) == "function":
            star = self.is_punct(j + 1, "*")
            name = j + 1 + star
            stop = self._past_body(name + (self.is_name(name)))
            return ("generator" if star else "function", is_async) if stop >= end else ("other", False)
        k = self.past_generics(j)
        if self.is_name(k) and self.is_punct(k + 1, "=>") and k + 1 < end:
            return "arrow", is_async
        if self.is_punct(k, "("):
            after = self.past(k)
            if self.is_punct(after, ":"):
                while after < end and not self.is_punct(after, "=>"):
                    after = self.past(after)
            if after < end and self.is_punct(after, "=>"):
                return "arrow", is_async
        if self.is_punct(i, "{") and self.past(i) == end:
            return "object", False
        return "other", False

    def _variables(self, i: int, exported: bool) -> int:
        while i < self.n:
            first = i
            simple = self.is_name(i)
            k = self.past(i) + (self.is_punct(self.past(i), "!"))
            if self.is_punct(k, ":"):
                k += 1
                while k < self.n and not self.is_punct(k, "=") and not self.is_punct(k, ",") and not self.is_punct(k, ";") and not self.ends_here(k):
                    k = self.past_generics(k) if self.is_punct(k, "<") else self.past(k)
            value = None
            end = k
            if self.is_punct(k, "="):
                value = k + 1
                end = self.statement_end(value, (";", ","))
                while self.is_punct(end, ",") and not self._declarator(end + 1):
                    end = self.statement_end(end + 1, (";", ","))
            if not simple:
                self.note("warning", "MISSING_SYMBOL_NAME", "Skipped an unnamed variable_declarator.", self.location(first, max(first, end - 1)))
            else:
                name = self.text(first)
                out = exported or name in self.listed
                kind, is_async = self._value(value, end) if value is not None and value < end else ("other", False)
                function = kind in ("arrow", "function", "generator")
                s = self.add_symbol(name, name, "function" if function else "variable", first, max(first, end - 1), None, out, is_async) if out or function else None
                if kind == "object":
                    self._object(value, name, s["id"] if s else None, out)
            if not self.is_punct(end, ","):
                return end
            i = end + 1
        return i

    def _declarator(self, i: int) -> bool:
        """Whether another variable starts at i, after a comma."""
        if not (self.is_name(i) or self.is_punct(i, "{") or self.is_punct(i, "[")):
            return False
        after = self.past(i)
        return after >= self.n or self.ends_here(after) or (self.t[after].kind == "punct" and self.text(after) in ("=", ":", ",", ";", "!"))

    def _object(self, brace: int, owner: str, parent: str | None, exported: bool) -> None:
        i, end = brace + 1, self.t[brace].mate
        while i < end:
            first = i
            name, is_async = self._method_name(i, end)
            stop = self.statement_end_in_object(first, end)
            simple = name < end and self.t[name].kind in ("name", "string", "number")
            if simple and (self.is_punct(name + 1, "(") or self.is_punct(name + 1, "<")):
                self.add_symbol(self.text(name), f"{owner}.{self.text(name)}", "method", first, stop - 1, parent, exported, is_async)
            elif simple and name == first and self.is_punct(name + 1, ":"):
                kind, own = self._value(name + 2, stop)
                if kind in ("arrow", "function"):
                    self.add_symbol(self.text(name), f"{owner}.{self.text(name)}", "method", first, stop - 1, parent, exported, own)
            i = stop + 1

    def statement_end_in_object(self, i: int, end: int) -> int:
        while i < end and not self.is_punct(i, ","):
            i = self.past(i)
        return min(i, end)


def read_file(file_id: str, text: str, language: str) -> dict:
    return FileReader(file_id, text, language).read()


@dataclass
class Analysis:
    parsed_files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    exports: DataFrame
    diagnostics: DataFrame
    failures: DataFrame
    meta: DataFrame


_SECTIONS = {"symbols": SYMBOLS, "imports": IMPORTS, "exports": EXPORTS, "diagnostics": DIAGNOSTICS, "failures": FAILURES}


def analyze(files: DataFrame) -> Analysis:
    """Parses scanned files of the four languages. `files` has the scan's columns and content (null: not readable)."""
    mine = files.where(F.col("language").isin(*PARSEABLE)).select("id", "relative_path", "language", "content_hash", "content")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fail = lambda code, message, r=r: out.append((r["id"], "failures", json.dumps({"file_id": r["id"], "relative_path": r["relative_path"], "code": code, "message": message})))
                if r["content"] is None:
                    fail("SOURCE_READ_FAILED", f"Could not read {r['relative_path']}.")
                elif hashlib.sha256(r["content"]).hexdigest() != r["content_hash"]:
                    fail("FILE_CHANGED_SINCE_SCAN", f"{r['relative_path']} changed since the scan.")
                else:
                    try:
                        got = read_file(r["id"], r["content"].decode("utf-8", "replace"), r["language"])
                    except Exception as e:  # one file's trouble is its own
                        fail("PARSER_FAILED", f"{r['relative_path']}: {type(e).__name__}")
                        continue
                    out.append((r["id"], "parsed", "{}"))
                    out += [(r["id"], name, json.dumps(x)) for name, rows in got.items() for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], names=["file_id", "section", "body"])

    raw = checkpointed(mine.mapInArrow(run, "file_id string, section string, body string"))
    table = lambda name: raw.where(F.col("section") == name).select(F.from_json("body", _SECTIONS[name]).alias("r")).select("r.*")
    parsed = mine.select(F.col("id").alias("file_id"), "relative_path", "language", "content_hash").join(raw.where("section = 'parsed'").select("file_id"), "file_id", "left_semi")
    failures = table("failures")
    counts = files.agg(F.count(F.lit(1)).alias("scanned_file_count")).join(parsed.agg(F.count(F.lit(1)).alias("parsed_file_count"))).join(failures.agg(F.count(F.lit(1)).alias("failed_file_count")))
    meta = counts.withColumn("skipped_file_count", F.col("scanned_file_count") - F.col("parsed_file_count") - F.col("failed_file_count"))
    return Analysis(checkpointed(parsed), table("symbols"), table("imports"), table("exports"), table("diagnostics"), failures, meta)
