"""Source files to chunks and call sites.

Python is parsed by the standard library's `ast`; languages with braces by a
scan for declarations and matching braces (strings and comments are blanked first);
Markdown by headings; JSON and YAML by their key-value pairs.  SQL has no chunk by its
registry entry.  This is less than a full grammar: what it can't read it skips, and a
file that doesn't parse gives nothing.  A `Module` adds a language or replaces the parser
of one.  Every parser takes time in proportion to the file, but for the sorting of
what it finds.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .languages import EXTENSIONS

CHUNK_SCHEMA = "file_path string, start_byte int, end_byte int, start_line int, end_line int, text string, symbol_path string, kind string"
CALL_SCHEMA = "file_path string, line int, name string"

_DECLARATIONS = {
    "rust": [(r"\bfn\s+(\w+)", "function"), (r"\b(?:struct|enum|trait)\s+(\w+)", "type"), (r"\bimpl(?:<[^>{]*>)?\s+(?:\w+\s+for\s+)?(\w+)", "impl"), (r"\bmod\s+(\w+)", "other")],
    "go": [(r"\bfunc\s+(\w+)", "function"), (r"\bfunc\s+\([^)]*\)\s+(\w+)", "method"), (r"\btype\s+(\w+)", "type")],
    "swift": [(r"\bfunc\s+(\w+)", "function"), (r"\b(?:class|struct|enum|protocol)\s+(\w+)", "type"), (r"\bextension\s+(\w+)", "container")],
    "javascript": [(r"\bfunction\s*\*?\s*(\w+)", "function"), (r"\bclass\s+(\w+)", "type"), (r"^\s+(?:async\s+|static\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b)(\w+)\s*\([^;{]*\)\s*(?=\{)", "method")],
    "java": [(r"\b(?:class|interface|enum)\s+(\w+)", "type"), (r"^\s+(?:[\w<>\[\],@]+\s+)+(\w+)\s*\([^;{]*\)\s*(?:throws\s[\w,\s]+)?(?=\{)", "method")],
    "php": [(r"\bfunction\s+(\w+)", "function"), (r"\b(?:class|interface|trait)\s+(\w+)", "type")],
    "bash": [(r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*(?=\{)", "function")],
    "c": [(r"^(?!\s*(?:if|for|while|switch|return|else)\b)[\w\s\*]+?\b(\w+)\s*\([^;{]*\)\s*(?=\{)", "function"), (r"\b(?:struct|enum)\s+(\w+)\s*(?=\{)", "type")],
}
_DECLARATIONS |= {"typescript": _DECLARATIONS["javascript"], "tsx": _DECLARATIONS["javascript"], "csharp": _DECLARATIONS["java"], "cpp": [*_DECLARATIONS["c"], (r"\bclass\s+(\w+)[^;{]*(?=\{)", "type"), (r"\bnamespace\s+(\w+)\s*(?=\{)", "other")]}
_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)


@dataclass(frozen=True)
class Module:
    """A language of its own: extensions, and a parser that gives (chunks, call sites) of (path, text).

    A chunk is (start, end, symbol path, kind) in characters; a call site (start, name).
    """

    name: str
    extensions: tuple[str, ...]
    parse: Callable[[str, str], tuple[list[tuple[int, int, str, str]], list[tuple[int, str]]]]


class _Places:
    """Lines and UTF-8 bytes of the characters of a text."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        if text.isascii():
            self.bytes = None
        else:
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.bytes = np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at)

    def byte(self, at: int) -> int:
        return at if self.bytes is None else int(self.bytes[at])

    def row(self, a: int, b: int, name: str, kind: str) -> tuple:
        return (self.path, self.byte(a), self.byte(b), self.line(a), self.line(b), self.text[a:b], name, kind)


def _python(path: str, text: str) -> tuple[list, list]:
    lines, places = text.split("\n"), _Places(path, text)
    begin = [0]
    for x in lines:
        begin.append(begin[-1] + len(x) + 1)
    at = lambda line, col: begin[line - 1] + len(lines[line - 1].encode()[:col].decode(errors="ignore"))
    rows, calls = [], []

    def visit(node: ast.AST, above: str) -> None:
        for x in ast.iter_child_nodes(node):
            inner = above
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{above}.{x.name}" if above else x.name
                a, b = at(x.lineno, x.col_offset), at(x.end_lineno, x.end_col_offset)
                if x.decorator_list:
                    d = x.decorator_list[0]
                    rows.append(places.row(at(d.lineno, d.col_offset) - 1, b, inner, "other"))
                rows.append(places.row(a, b, inner, "type" if isinstance(x, ast.ClassDef) else "function"))
            elif isinstance(x, ast.Call):
                f = x.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name:
                    calls.append((path, x.lineno - 1, name))
            visit(x, inner)

    visit(ast.parse(text), "")
    return rows, calls


def _braces(path: str, text: str, language: str) -> tuple[list, list]:
    places = _Places(path, text)
    plain = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    close, stack = {}, []
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.end()
    found, declared = [], set()
    marks = [m.start() for m in re.finditer(r"[{};]", plain)]
    for pattern, kind in _DECLARATIONS[language]:
        for m in re.finditer(pattern, plain, re.M):
            k = bisect_left(marks, m.end())
            if k == len(marks) or plain[marks[k]] != "{":
                continue
            brace = marks[k]
            declared.add(m.start(1))
            a = m.start() + len(m[0]) - len(m[0].lstrip())
            name = f"impl {m[1]}" if kind == "impl" else m[1]
            found.append((a, close.get(brace, len(text)), name, "other" if kind == "impl" else kind))
    found.sort(key=lambda x: (x[0], -x[1]))
    rows, seen, open_ = [], set(), []
    for a, b, name, kind in found:
        if (a, name) in seen:
            continue
        seen.add((a, name))
        open_ = [o for o in open_ if o[0] > a]
        path_ = ".".join([o[1] for o in open_] + [name])
        open_.append((b, name))
        if kind != "container":
            rows.append(places.row(a, b, path_, kind))
    calls = []
    for m in re.finditer(r"([A-Za-z_][\w.]*)\s*\(", plain):
        name = m[1].rsplit(".", 1)[-1]
        if name and m.end(1) - len(name) not in declared and name not in {"if", "for", "while", "switch", "return", "catch", "func", "fn", "function", "match"}:
            calls.append((path, places.line(m.start()), name))
    return rows, calls


def _markdown(path: str, text: str) -> tuple[list, list]:
    places, rows, open_ = _Places(path, text), [], []
    heads = [(m.start(), len(m[1]), m[2].strip()) for m in re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M)]
    for a, level, name in [*heads, (len(text), 0, "")]:
        while open_ and open_[-1][1] >= level:
            begin, _, full = open_.pop()
            rows.append(places.row(begin, a, full, "other"))
        open_.append((a, level, f"{open_[-1][2]}.{name}" if open_ else name))
    return sorted(rows, key=lambda r: r[1]), []


_JSON = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|[{}\[\],:]|[^\s{}\[\],:"/]+', re.S)


def _json(path: str, text: str) -> tuple[list, list]:
    """A chunk for each pair of an object, named as a pair has no name: by its kind."""
    places, rows = _Places(path, text), []
    stack: list[list] = []  # [bracket, start of the open pair]
    last = 0  # end of the token before, comments apart
    string = None
    for m in _JSON.finditer(text):
        t = m[0]
        if t.startswith(("//", "/*")):
            continue
        if t == ":" and stack and stack[-1][0] == "{" and string is not None:
            stack[-1][1] = string
        elif t in "{[":
            stack.append([t, None])
        elif t in ",}]" and stack:
            if stack[-1][1] is not None:
                rows.append(places.row(stack[-1][1], last, "pair", "other"))
                stack[-1][1] = None
            if t != ",":
                stack.pop()
        string = m.start() if t[0] == '"' else None
        last = m.end()
    return sorted(rows, key=lambda r: (r[1], -r[2])), []


def _yaml(path: str, text: str) -> tuple[list, list]:
    """A chunk for each block mapping pair: its line and the deeper ones after it."""
    places, rows, open_, at, end = _Places(path, text), [], [], 0, 0
    key = re.compile(r"""((?:[ ]*-[ ]+)*[ ]*)("(?:\\.|[^"\\])*"|'[^']*'|[^\s#'"\-\[{&*!|>%@`][^#\n]*?|-[^\s#][^#\n]*?)[ ]*:(?=\s|$)""")
    block = None  # indentation of the key whose block scalar goes on
    for line in [*text.split("\n"), None]:
        bare = "" if line is None else line.strip()
        indent = -1 if line is None else len(line) - len(line.lstrip(" "))
        if line is None or bare and not bare.startswith("#") and not (block is not None and indent > block):
            block = None
            m = None if line is None or bare in ("---", "...") else key.match(line)
            column = len(m[1]) if m else indent if line is not None and bare not in ("---", "...") else -1
            dash = line is not None and line.lstrip(" ").startswith("- ")
            while open_ and (open_[-1][1] >= column or dash and open_[-1][1] > indent):
                begin, _ = open_.pop()
                rows.append(places.row(begin, end, "block_mapping_pair", "other"))
            if m:
                open_.append((at + column, column))
                if re.search(r":[ ]+[|>][+\-0-9]*[ ]*(#.*)?$", line):
                    block = column
        if bare and (block is not None and indent > block or not bare.startswith("#")):
            end = at + len(line.rstrip())
        at += 0 if line is None else len(line) + 1
    return sorted(rows, key=lambda r: (r[1], -r[2])), []


_PARSERS = {"python": _python, "markdown": _markdown, "json": _json, "yaml": _yaml}


def parse(path: str, text: str | None, modules: Sequence[Module] = ()) -> tuple[list, list]:
    """(chunks, call sites) of one file; nothing where it can't be read."""
    end = path.rsplit(".", 1)[-1].lower() if path and "." in path else None
    own = next((m for m in modules if end in m.extensions), None)
    language = EXTENSIONS.get(end)
    try:
        if text is None or own is None and language is None:
            return [], []
        if own:
            places = _Places(path, text)
            found, calls = own.parse(path, text)
            return [places.row(*x) for x in found], [(path, places.line(at), name) for at, name in calls]
        if language in _PARSERS:
            return _PARSERS[language](path, text)
        return _braces(path, text, language) if language in _DECLARATIONS else ([], [])
    except (SyntaxError, ValueError, RecursionError):
        return [], []


def _run(files: DataFrame, which: int, schema: str, modules: Sequence[Module]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, t in zip(pdf["file_path"], pdf["content"]) for r in parse(p, t, modules)[which]], columns=names)

    return files.select("file_path", "content").mapInPandas(run, schema)


def chunks(files: DataFrame, modules: Sequence[Module] = ()) -> DataFrame:
    """The chunks of files (file_path, content); nested ones overlap."""
    return _run(files, 0, CHUNK_SCHEMA, modules)


def calls(files: DataFrame, modules: Sequence[Module] = ()) -> DataFrame:
    """The call sites: file_path, line and the name after the last dot."""
    return _run(files, 1, CALL_SCHEMA, modules)
