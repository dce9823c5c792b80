"""Functions paired with their documentation.

A scanner that knows the strings and comments of each language goes once over each file. Headers are found as text, since
line numbers may come from another revision; braces, indentation or `end` outside strings and comments delimit the body;
and the comment that ends directly above the header (in Python the string that opens the body) is the documentation. Files and their declarations meet in one row,
so a file is parsed once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lexing import Bare, language_of

def words_of_name(name: str) -> set[str]:
    """The words that make up an identifier, in lower case."""
    return {w.lower() for part in re.split(r"[^A-Za-z0-9]+", name or "") for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", part)}


_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//+!?|#+(?!\[)|--+)?\s*")
_TODO = re.compile(r"(?:@?\b(?:todo|fixme|xxx|tbd|hack|wip)\b)", re.I)
#: How comments address tools instead of readers.
_TOOL = re.compile(
    r"^(?:eslint\b|tslint:|jshint\b|jslint\b|jscs:|prettier-|istanbul ignore|c8 ignore|v8 ignore|rubocop:|standard:|reek:|noinspection\b|pylint:|noqa\b|flake8[:-]|isort:|mypy:|pyright:|ruff:|fmt:|yapf:|type:\s*ignore|pragma\b|nosonar|nosec\b|nolint|golint|go:\w|\+build|lint:|"
    r"clippy::|rustfmt\b|phpcs:|phpstan|psalm-|phan-|checkstyle[:.]|suppress(?:warnings)?[:(]|spotless:|codecov|coverage:|sonar|ts-(?:ignore|expect|check|nocheck)|deno-|biome-|stylelint-|webpack[A-Z]|shellcheck \w+=|language=|vim:|frozen_string_literal:|encoding:|endregion\b)",
    re.I,
)
_REGION = re.compile(r"^\s*(?:[/*]+\s*)?#(?:end)?region\b")
_INHERIT = re.compile(r"\{?@?\b(?:inheritdoc|inherit-?docs?|inherited)\b\}?", re.I)
_CODE = re.compile(
    r"[{}]\s*$|^\w+;\s*$|^(?=.*[()=\[\]$])[^.]*;\s*$"
    r"|^[$@]?[\w.\[\]>-]+(?:\s*,\s*[$\w.]+)*\s*(?::=|[-+*/|&]?=)(?!=)\s*\S"
    r"|^(?:if|for|foreach|while|switch|else if|elif)\s*\(.*\)\s*[{:;]?\s*$"
    r"|^(?:return|raise|throw|yield|await)\s+[\w$.]+(?:\(.*\)\s*;?|;)\s*$"
    r"|^(?:const|let|var|val|auto|final|int|string|bool|def|fn|func|function|import|use|require|from)\s+\S+\s*(?:=|\(|;|\{|import\b)"
    r"|^[$\w]+(?:(?:\.|->|::)[\w$]+)*\([^)]*\)\s*;?\s*$"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def prose_words(lines: list[str], name: str) -> list[str]:
    """Words of prose in the lines of a comment or doc string.

    Comment marks, lines that start with @ or :, to-do notes (to the end of their paragraph), directives for tools,
    markers of inheritance, commented-out code and the words of the name do not count.
    """
    own, out, note = words_of_name(name), [], False
    for raw in lines:
        line = _MARK.sub("", raw, count=1).strip()
        line = re.sub(r"\*+/\s*$", "", line).strip()
        if not line:
            note = False
            continue
        if line[0] in "@:" and not _INHERIT.match(line):
            note = bool(_TODO.match(line))
            continue
        if _TODO.match(line):
            note = True
            continue
        if note or _TOOL.match(line) or _REGION.match(raw):
            continue
        line = _INHERIT.sub(" ", line)
        if _CODE.search(line):
            continue
        out += [w for w in _WORD.findall(line) if w.lower() not in own]
    return out


class Source(Bare):
    """A scanned file: its lines and which of them are comments only."""

    def __init__(self, content: str, language: str):
        super().__init__(content.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n"), language)
        self.comment = bytearray(len(self.lines))
        for start, stop in self.comments:
            a = self.line_of(start)
            if self.text[self.offset[a] : start].strip():
                continue  # code comes first on the line
            b = self.line_of(max(start, stop - 1))
            if self.text[stop : self.offset[b + 1] - 1].strip() and self.text.startswith("/*", start):
                continue  # code follows the comment
            for i in range(a, b + 1):
                self.comment[i] = 1
        self.at: dict[str, list[int]] | None = None

    def find(self, header: str) -> int:
        """The first line of the header, -1 if it is not there. Indentation and what follows on its last line do not matter."""
        want = [x.strip() for x in header.replace("\r\n", "\n").split("\n")]
        if self.at is None:
            self.at = {}
            for i, line in enumerate(self.lines):
                self.at.setdefault(line.strip(), []).append(i)
        for i in self.at.get(want[0], ()):
            if all(i + k < len(self.lines) and self.lines[i + k].strip() == w for k, w in enumerate(want)) and not self.comment[i]:
                return i
        for i, line in enumerate(self.lines):
            if want[0] in line and not self.comment[i] and all(i + k < len(self.lines) and self.lines[i + k].strip().startswith(w) for k, w in enumerate(want) if k):
                return i
        return -1

    def above(self, line: int, annotations: list[str]) -> tuple[int, list[str]]:
        """First line of the declaration with its annotations, and the comment lines that end directly above it."""
        known = {x.strip() for a in annotations for x in (a or "").split("\n")}
        i = line - 1
        while i >= 0 and not self.comment[i]:
            s = self.lines[i].strip()
            if not s:
                break
            if not (s in known or s.startswith(("@", "#["))):
                # the last line of an annotation over several lines, however many
                first = self.first_line(i) if s.endswith((")", "]")) else i
                if first == i or not self.lines[first].strip().startswith(("@", "#[")):
                    break
                i = first
            i -= 1
        first, end = i + 1, i + 1
        while i >= 0 and self.comment[i]:
            i -= 1
        return first, self.lines[i + 1 : end]

    def docstring(self, line: int, span: int) -> list[str]:
        """Python: the lines of the string that is the first statement of the body."""
        i = line + span
        while i < len(self.lines) and (not self.lines[i].strip() or self.comment[i]):
            i += 1
        if i >= len(self.lines):
            return []
        if len(self.lines[i]) - len(self.lines[i].lstrip()) <= len(self.lines[line]) - len(self.lines[line].lstrip()):
            return []
        m = re.compile(r'\s*[rRuU]?("""|\'\'\'|"|\')((?:\\[\s\S]|(?!\1)[\s\S])*?)\1[ \t]*;?[ \t]*(?:\#[^\n]*)?(?=\n|\Z)').match(self.text, self.offset[i])
        if not m or len(m.group(1)) == 1 and "\n" in m.group(2):
            return []
        return m.group(2).split("\n")


def pair(content: str, language: str, declarations: list[dict]) -> Iterator[tuple[int, str, list[str]]]:
    """(place in declarations, code, documentation lines) of each declaration whose header is found."""
    source = Source(content, language)
    for k, d in enumerate(declarations):
        header = d["header"]
        if not header or not header.strip():
            continue
        line = source.find(header)
        if line < 0:
            continue
        span = header.count("\n") + 1
        if language == "python":
            doc = source.docstring(line, span)
        else:
            _, doc = source.above(line, d["annotations"] or [])
        yield k, "\n".join(source.lines[line : source.end(line, span) + 1]), doc


RESULT = "repo string, path string, idx int, name string, kind string, header string, documentation string, prose_words int, code string"


def function_pairs(files: DataFrame, declarations: DataFrame, least_words: int = 4, columns: list[str] | None = None) -> DataFrame:
    """Code and documentation of every function and method whose documentation has at least least_words words of prose.

    files: repo, path, language, content; declarations: repo, path, idx, name, kind, header, annotations. Repeated rows
    count once: of several contents of a file the greatest is taken, of several rows of a declaration any with
    annotations. Files without content, headers that are null or not in the file, and null idx give nothing; a null
    language follows from the file's ending; empty tables give no rows; other columns are ignored. `columns` restricts
    the result before it leaves Python.
    """
    code = files.where("content is not null and repo is not null and path is not null").groupBy("repo", "path").agg(F.max(F.struct("content", "language")).alias("f"))
    wanted = declarations.where("kind in ('function', 'method') and idx is not null and header is not null")
    one = wanted.groupBy("repo", "path", "idx").agg(F.max(F.struct("header", "name", "kind", "annotations")).alias("d"))
    # the declarations of a file lie in that file, so a list of them is bounded by the content beside it
    listed = one.groupBy("repo", "path").agg(F.collect_list(F.struct("idx", "d.header", "d.name", "d.kind", "d.annotations")).alias("ds"))
    rows = code.join(listed, ["repo", "path"]).select("repo", "path", "f.content", "f.language", "ds")
    names = columns or [c.split()[0] for c in RESULT.split(", ")]
    ddl = ", ".join(c for c in RESULT.split(", ") if c.split()[0] in names)
    order = [c.split()[0] for c in ddl.split(", ")]
    types = {"idx": pa.int32(), "prose_words": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                for k, body, doc in pair(r["content"], language_of(r["language"], r["path"]), r["ds"]):
                    d = r["ds"][k]
                    n = len(prose_words(doc, d["name"]))
                    if n >= least_words:
                        out.append({"repo": r["repo"], "path": r["path"], "idx": d["idx"], "name": d["name"], "kind": d["kind"], "header": d["header"], "documentation": "\n".join(doc), "prose_words": n, "code": body})
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], types.get(c, pa.string())) for c in order], names=order)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], types.get(c, pa.string())) for c in order], names=order)

    return rows.mapInArrow(run, ddl)
