"""Declarations, imports, references and complexity of sources: of Python by the language's own parser, of others by operators.declare.

Each file is parsed once; the result is one row with arrays, to be exploded. Python that does not parse gives nulls.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lexing import language_of
from . import declare

_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case, ast.comprehension)
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a body without those of functions in it."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, _DEF):
            yield child
            yield from _own(child)


def complexity(node: ast.AST) -> int:
    """One, and one for each branch, loop, handler, case, comprehension part, condition in it and short-circuit operator; nested functions count for themselves."""
    n = 1
    for x in _own(node):
        n += isinstance(x, _BRANCH)
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
        n += len(x.ifs) if isinstance(x, ast.comprehension) else 0
        n += 1 if isinstance(x, ast.Assert) else 0
    return n


def _header(lines: list[str], node: ast.AST) -> str:
    first = node.body[0]
    end = first.lineno - 1 if first.lineno > node.lineno else node.lineno
    taken = lines[node.lineno - 1 : end]
    while taken and not taken[-1].rstrip().endswith(":") and len(taken) > 1:
        taken.pop()
    return "\n".join(x[node.col_offset :] if x[: node.col_offset].strip() == "" else x for x in taken).strip()


def parse(text: str) -> dict | None:
    try:
        tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = text.split("\n")
    exported = next((tuple(e.value for e in n.value.elts if isinstance(e, ast.Constant)) for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple))), None)
    visible = lambda name: 4 if (name in exported if exported is not None else not name.startswith("_")) else 2
    declarations: list[dict] = []
    functions: list[dict] = []

    def declare(node: ast.AST, name: str, kind: str, parent: int | None, container: str | None, header: str, first: int, marks: list[str]) -> int:
        declarations.append({"idx": len(declarations), "name": name, "kind": kind, "header_line": first, "line": node.lineno, "end_line": node.end_lineno, "container": container, "parent": parent, "header": header, "annotations": marks, "visibility": visible(name)})
        return len(declarations) - 1

    def visit(body: list, parent: int | None, container: str | None, path: str, in_class: bool, in_function: bool) -> None:
        for n in body:
            if isinstance(n, (*_DEF, ast.ClassDef)):
                cls = isinstance(n, ast.ClassDef)
                marks = ["@" + ast.unparse(x) for x in n.decorator_list]
                first = min([n.lineno, *(x.lineno for x in n.decorator_list)])
                me = declare(n, n.name, "class" if cls else "method" if in_class else "function", parent, container if in_class else None, _header(lines, n), first, marks)
                name = f"{path}{n.name}"
                if not cls:
                    functions.append({"name": name.replace("/", "."), "start_line": n.lineno, "end_line": n.end_lineno, "complexity": complexity(n)})
                visit(n.body, me, n.name if cls else container, name + ("::" if cls else "."), cls, not cls)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and not in_function:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and not any(d["name"] == t.id and d["line"] == n.lineno for d in declarations):
                        declare(n, t.id, "property", parent, container if in_class else None, lines[n.lineno - 1].strip(), n.lineno, [])
            else:
                for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                    inner = getattr(n, field, None)
                    if isinstance(inner, list):
                        for x in inner:
                            visit(x.body if isinstance(x, (ast.ExceptHandler, ast.match_case)) else [x], parent, container, path, in_class, in_function)

    visit(tree.body, None, None, "", False, False)
    imports, references = [], []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [{"module": a.name, "symbol": None, "line": n.lineno, "end_line": n.end_lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports += [{"module": "." * n.level + (n.module or ""), "symbol": a.name, "line": n.lineno, "end_line": n.end_lineno} for a in n.names if a.name != "*"]
        elif isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                references.append({"name": n.func.id, "line": n.func.lineno, "shape": "Free", "receiver": None})
            elif isinstance(n.func, ast.Attribute):
                references.append({"name": n.func.attr, "line": n.func.end_lineno, "shape": "Member", "receiver": ast.unparse(n.func.value)})
    return {"declarations": declarations, "functions": functions, "imports": imports, "references": references}


_RESULT = (
    "declarations array<struct<idx: int, name: string, kind: string, header_line: int, line: int, end_line: int, container: string, parent: int, header: string, annotations: array<string>, visibility: int>>,"
    "functions array<struct<name: string, start_line: int, end_line: int, complexity: int>>, imports array<struct<module: string, symbol: string, line: int, end_line: int>>, references array<struct<name: string, line: int, shape: string, receiver: string>>"
)
_INT, _STR = pa.int32(), pa.string()
_TYPES = {
    "declarations": pa.struct([("idx", _INT), ("name", _STR), ("kind", _STR), ("header_line", _INT), ("line", _INT), ("end_line", _INT), ("container", _STR), ("parent", _INT), ("header", _STR), ("annotations", pa.list_(_STR)), ("visibility", _INT)]),
    "functions": pa.struct([("name", _STR), ("start_line", _INT), ("end_line", _INT), ("complexity", _INT)]),
    "imports": pa.struct([("module", _STR), ("symbol", _STR), ("line", _INT), ("end_line", _INT)]),
    "references": pa.struct([("name", _STR), ("line", _INT), ("shape", _STR), ("receiver", _STR)]),
}


def extracted(files: DataFrame, keys: list[str], content: str = "content", language: str | None = None, path: str | None = None) -> DataFrame:
    """keys, declarations, functions, imports, references of each file. Null contents are left out.

    language and path name columns; without them all files are taken as Python. A null language follows from the path's
    ending. All four are null where Python does not parse.
    """
    rows = files.where(F.col(content).isNotNull()).select(*keys, content, (F.col(language) if language else F.lit("python")).alias("_language"), (F.col(path) if path else F.lit("")).alias("_path"))
    ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t, lang, where in zip(*(batch.column(at + k).to_pylist() for k in range(3))):
                lang = language_of(lang, where)
                got.append(parse(t) if lang == "python" else declare.parse(t, lang, where or ""))
            parts = [pa.array([g and g[c] for g in got], pa.list_(t)) for c, t in _TYPES.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *parts], names=[*keys, *_TYPES])

    return rows.mapInArrow(run, f"{ddl}, {_RESULT}")


def measured(files: DataFrame, keys: list[str], content: str = "content", language: str = "language", path: str = "path") -> DataFrame:
    """keys, lines, code and complexity of each file by its text. Null contents are left out; an empty text has zeros."""
    rows = files.where(F.col(content).isNotNull()).select(*keys, F.col(content).alias("_content"), F.col(language).alias("_language"), F.col(path).alias("_path"))
    ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [declare.measure(t, language_of(lang, where)) for t, lang, where in zip(*(batch.column(at + k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array([g[c] for g in got], pa.int32()) for c in ("lines", "code", "complexity"))], names=[*keys, "lines", "code", "complexity"])

    return rows.mapInArrow(run, f"{ddl}, lines int, code int, complexity int")


def relation(parsed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One of the four relations as rows."""
    return parsed.select(*keys, F.explode(name).alias("_r")).select(*keys, "_r.*")
