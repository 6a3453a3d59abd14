"""A tolerant tokenizer for JavaScript and TypeScript, with JSX.

It never fails: what it can't read becomes a problem with a place, and reading goes on. Offsets are in characters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*.*?\*/)+", re.S)
_NAME = re.compile(r"[#@]?[A-Za-z_$\u0080-\U0010ffff][\w$‌‍]*|@")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?\.?")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.|\\\n)*"|\'(?:[^\'\\\n]|\\.|\\\n)*\'', re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.(?!\d)|[-+*/%&|^!=<>?]=+|\*\*=?|\+\+|--|&&=?|\|\|=?|\?\?=?|[{}()\[\];,.:?=<>+\-*/%&|^!~]")
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "do", "else", "instanceof", "yield", "await", "default", "extends"}
_CLOSE = {")": "(", "]": "[", "}": "{"}


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, template, regex, jsx, punct
    text: str
    start: int
    end: int
    line_before: bool
    mate: int = -1  # of a bracket: the index of its other half


class Source:
    """The tokens of a text, its problems (message, start, end), and places as line and column."""

    def __init__(self, text: str, jsx: bool = False) -> None:
        self.text, self.jsx = text, jsx
        self.tokens: list[Token] = []
        self.problems: list[tuple[str, int, int]] = []
        self.lines = [0, *[m.end() for m in re.finditer(r"\r\n|\n|\r", text)]]
        self._read()
        self._pair()

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at) - 1
        return line + 1, at - self.lines[line]

    def span(self, start: int, end: int) -> tuple[int, int, int, int]:
        return (*self.place(start), *self.place(end))

    def _value_next(self) -> bool:
        """Whether a value may start here, so that `/` opens a regular expression and `<` an element."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "name":
            return t.text in _BEFORE_VALUE
        return t.kind == "punct" and t.text not in (")", "]", "}", "++", "--")

    def _read(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        if text.startswith("#!"):
            at = text.find("\n") if "\n" in text else n
        while at < n:
            m = _SPACE.match(text, at)
            fresh = not self.tokens
            if m:
                fresh = fresh or "\n" in m[0] or "\r" in m[0]
                at = m.end()
                if at >= n:
                    break
            c, kind, m = text[at], "", None
            if c in "\"'":
                kind, m = "string", _STRING.match(text, at)
                if not m:
                    stop = text.find("\n", at)
                    self.problems.append(("Unterminated string.", at, n if stop < 0 else stop))
                    at = n if stop < 0 else stop
                    continue
            elif c == "`":
                end = self._template(at)
                self.tokens.append(Token("template", text[at:end], at, end, fresh))
                at = end
                continue
            elif text.startswith("/*", at):
                self.problems.append(("Unterminated comment.", at, n))
                return
            elif c == "/" and self._value_next() and (m := _REGEX.match(text, at)):
                kind = "regex"
            elif c == "<" and self.jsx and self._value_next() and re.match(r"<(?:>|[A-Za-z_$][\w$.:-]*(?!\s*(?:,|extends\b)))", text[at : at + 200]):
                end = self._element(at)
                if end:
                    self.tokens.append(Token("jsx", text[at:end], at, end, fresh))
                    at = end
                    continue
            if not m:
                for kind, pattern in (("number", _NUMBER if c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit()) else None), ("name", _NAME), ("punct", _PUNCT)):
                    m = pattern.match(text, at) if pattern else None
                    if m:
                        break
            if not m:
                self.problems.append(("Unexpected character.", at, at + 1))
                at += 1
                continue
            self.tokens.append(Token(kind, m[0], at, m.end(), fresh))
            at = m.end()

    def _template(self, at: int) -> int:
        text, i, n = self.text, at + 1, len(self.text)
        while i < n:
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                i = self._braces(i + 1)
            else:
                i += 1
        self.problems.append(("Unterminated template.", at, n))
        return n

    def _braces(self, at: int) -> int:
        """End of a braced expression that starts at a `{`."""
        text, i, n, depth = self.text, at, len(self.text), 0
        while i < n:
            c = text[i]
            if c in "\"'" and (m := _STRING.match(text, i)):
                i = m.end()
                continue
            if c == "`":
                i = self._template(i)
                continue
            if text.startswith(("//", "/*"), i) and (m := _SPACE.match(text, i)):
                i = m.end()
                continue
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return i + 1
            i += 1
        return n

    def _element(self, at: int) -> int | None:
        """End of an element that starts at a `<`, or None if it is none."""
        text, i, n = self.text, at, len(self.text)
        depth = 0
        while i < n:
            if text.startswith("</", i):
                end = text.find(">", i)
                if end < 0:
                    return None
                depth, i = depth - 1, end + 1
            elif text[i] == "<":
                i += 1
                while i < n and text[i] != ">" and not text.startswith("/>", i):
                    if text[i] in "\"'":
                        end = text.find(text[i], i + 1)
                        if end < 0:
                            return None
                        i = end + 1
                    elif text[i] == "{":
                        i = self._braces(i)
                    else:
                        i += 1
                if i >= n:
                    return None
                if text[i] == ">":
                    depth, i = depth + 1, i + 1
                else:
                    i += 2
            elif text[i] == "{":
                i = self._braces(i)
            else:
                i += 1
                continue
            if depth <= 0:
                return i
        return None

    def _pair(self) -> None:
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in ("(", "[", "{"):
                stack.append(i)
            elif t.text in _CLOSE:
                if stack and self.tokens[stack[-1]].text == _CLOSE[t.text]:
                    j = stack.pop()
                    self.tokens[j].mate, t.mate = i, j
                else:
                    self.problems.append(("Unmatched bracket.", t.start, t.end))
        self.problems += [("Unmatched bracket.", self.tokens[i].start, self.tokens[i].end) for i in stack]
        for i, t in enumerate(self.tokens[1:], 1):
            before = self.tokens[i - 1]
            if before.kind == "punct" and before.text == "=" and t.kind == "punct" and t.text in (";", ")", "]", "}", ","):
                self.problems.append(("A value is missing.", before.start, t.end))
