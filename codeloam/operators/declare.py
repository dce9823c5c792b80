"""Declarations, imports, references and complexity of sources in brace and `end` languages.

No grammar is used: the scanner of functions.lexing takes comments and strings out of the text, patterns find what may be
the head of a declaration in the rest, and brackets, `end` or indentation tell how far it reaches. What lies within a
function is a statement, so heads without a keyword of their own (methods, C functions) count only outside of functions.
Results have the form of operators.extract.parse.
"""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions.lexing import Bare, blanked

_JS_HEAD = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?"
_ACCESS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|readonly|override|synchronized|default|native|strictfp|transient|volatile|get|set|declare)\s+)*"
_NOT_CALLED = r"(?!(?:if|for|while|switch|catch|return|function|new|else|do|try|throw|typeof|await|delete|foreach|elseif|sizeof|assert|super|this|using|lock|synchronized|case)\b)"

#: Of each language, (kind, pattern) of the heads of declarations; the name is the group n, a container named in the head c.
#: A kind with a star is looked for outside of functions only.
_HEADS: dict[str, list[tuple[str, str]]] = {
    "javascript": [
        ("class", _JS_HEAD + r"class\s+(?P<n>[\w$]+)"), ("interface", _JS_HEAD + r"interface\s+(?P<n>[\w$]+)"), ("enum", _JS_HEAD + r"(?:const\s+)?enum\s+(?P<n>[\w$]+)"),
        ("module", _JS_HEAD + r"(?:namespace|module)\s+(?P<n>[\w.$]+)(?=\s*\{)"), ("type", _JS_HEAD + r"type\s+(?P<n>[\w$]+)(?=\s*(?:<[^=\n]*>)?\s*=)"),
        ("function", _JS_HEAD + r"(?:async\s+)?function\b\s*\*?\s*(?P<n>[\w$]+)"), ("function", _JS_HEAD + r"(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^()\n]*\)|[\w$]+)\s*(?::[^=\n]+)?=>)"),
        ("method*", _ACCESS + r"[*#]?" + _NOT_CALLED + r"(?P<n>[\w$]+)\s*\??\s*(?:<[^>\n]*>)?(?=\()"),
    ],
    "php": [
        ("class", r"(?:(?:abstract|final|readonly)\s+)*class\s+(?P<n>\w+)"), ("interface", r"interface\s+(?P<n>\w+)"), ("trait", r"trait\s+(?P<n>\w+)"), ("enum", r"enum\s+(?P<n>\w+)(?=\s*[:{]|\s+implements)"),
        ("function", r"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*(?P<n>\w+)"),
    ],
    "java": [
        ("class", _ACCESS + r"(?:class|record)\s+(?P<n>\w+)"), ("interface", _ACCESS + r"@?interface\s+(?P<n>\w+)"), ("enum", _ACCESS + r"enum\s+(?P<n>\w+)"),
        ("method*", _ACCESS + r"(?:<[^>\n]*>\s*)?" + _NOT_CALLED + r"(?:[\w.]+(?:<[^()\n]*>)?(?:\[\])*\s+)?(?<![.\w])" + _NOT_CALLED + r"(?P<n>\w+)\s*(?=\()"),
    ],
    "go": [
        ("struct", r"type\s+(?P<n>\w+)(?:\[[^\]\n]*\])?\s+struct\b"), ("interface", r"type\s+(?P<n>\w+)(?:\[[^\]\n]*\])?\s+interface\b"), ("type", r"type\s+(?P<n>\w+)\s+(?!struct\b|interface\b)=?\s*[\w\[\]*.(]"),
        ("method", r"func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<c>\w+)(?:\[[^\]\n]*\])?\s*\)\s*(?P<n>\w+)"), ("function", r"func\s+(?P<n>\w+)"),
    ],
    "rust": [
        ("struct", r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:struct|union)\s+(?P<n>\w+)"), ("enum", r"(?:pub(?:\s*\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"), ("trait", r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)"),
        ("module", r"(?:pub(?:\s*\([^)]*\))?\s+)?mod\s+(?P<n>\w+)(?=\s*\{)"), ("type", r"(?:pub(?:\s*\([^)]*\))?\s+)?type\s+(?P<n>\w+)"),
        ("impl", r"(?:unsafe\s+)?impl\b(?:\s*<[^{\n]*?>)?\s+(?:!?[\w:]+(?:<[^{\n]*?>)?\s+for\s+)?(?:&\s*)?(?:[\w]+::)*(?P<n>\w+)"),
        ("function", r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+(?P<n>\w+)"),
    ],
    "ruby": [("class", r"class\s+(?:\w+::)*(?P<n>[A-Z]\w*)"), ("module", r"module\s+(?:\w+::)*(?P<n>[A-Z]\w*)"), ("function", r"(?:(?:private|protected|public|module_function)\s+)?def\s+(?:self\.|[A-Z]\w*\.)?(?P<n>[\w]+[?!=]?|[^\w\s(]+)")],
    "c": [
        ("struct", r"(?:typedef\s+)?(?:static\s+)?struct\s+(?P<n>\w+)(?=\s*\{)"), ("enum", r"(?:typedef\s+)?(?:static\s+)?enum\s+(?P<n>\w+)(?=\s*\{)"), ("union", r"(?:typedef\s+)?union\s+(?P<n>\w+)(?=\s*\{)"),
        ("function*", r"(?!(?:typedef|return|else|case|goto|define|if|while|for|switch)\b)(?:[A-Za-z_]\w*[\s*]+)+?(?P<n>[A-Za-z_]\w*)\s*(?=\([^;]*?\)\s*(?:__\w+\S*\s*)*\{)"),
    ],
    "bash": [("function", r"(?:function\s+)?(?P<n>[\w:.-]+)\s*\(\s*\)"), ("function", r"function\s+(?P<n>[\w:.-]+)(?=\s*\{)")],
    "lua": [("function", r"(?:local\s+)?function\s+(?:(?P<c>[\w.]+)[.:])?(?P<n>\w+)"), ("function", r"(?:local\s+)?(?:(?P<c>[\w.]+)\.)?(?P<n>\w+)\s*=\s*function\b")],
    "": [("class", r"(?:\w+\s+)*(?:class|struct|trait|object|protocol)\s+(?P<n>\w+)"), ("interface", r"(?:\w+\s+)*interface\s+(?P<n>\w+)"), ("enum", r"(?:\w+\s+)*enum\s+(?P<n>\w+)"), ("module", r"(?:\w+\s+)*(?:module|namespace|package)\s+(?P<n>[\w.]+)"), ("function", r"(?:\w+\s+)*(?:def|fn|fun|func|function|sub|proc)\s+(?P<n>\w+)")],
}
_ALIKE = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "shell": "bash", "sh": "bash"}
TYPES = ("class", "interface", "enum", "struct", "union", "trait", "impl", "module")

#: Of each language, what adds a path through a function.
_BRANCHES = {
    "javascript": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|\?(?![.?:])(?=[^;\n]*:)",
    "php": r"\b(?:if|elseif|for|foreach|while|case|catch|and|or|xor)\b|&&|\|\||\?\?|\?(?![?>:-])(?=[^;\n]*:)",
    "java": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![>,])(?=[^;\n]*:)",
    "go": r"\b(?:if|for|case)\b|&&|\|\|",
    "rust": r"\b(?:if|for|while|loop)\b|=>|&&|\|\|(?!\s*\{)",
    "ruby": r"\b(?:if|elsif|unless|while|until|for|when|rescue|and|or)\b|&&|\|\||\s\?\s",
    "c": r"\b(?:if|for|while|case)\b|&&|\|\||\?(?=[^;\n]*:)",
    "bash": r"\b(?:if|elif|for|while|until)\b|;;|&&|\|\|",
    "lua": r"\b(?:if|elseif|for|while|repeat|and|or)\b",
    "python": r"\b(?:if|elif|for|while|except|and|or|assert)\b",
    "": r"\b(?:if|elif|elsif|elseif|unless|for|foreach|while|until|case|when|catch|rescue|except)\b|&&|\|\|",
}
_CALL = re.compile(r"(?:(?P<new>\bnew\s+)|(?P<r>(?:\$?[A-Za-z_][\w$]*|\)|\])(?:(?:\?\.|\.|->|::)\$?[A-Za-z_][\w$]*)*?)(?P<by>\?\.|\.|->|::)\s*)?(?P<n>[A-Za-z_][\w$]*[!?]?)\s*(?:::<[^>\n]*>)?\((?!\s*\*\w+\s*\)\()")
_WORDS = frozenset("if for while switch catch return function elseif foreach fn def func sizeof typeof match when unless until and or not in new else do try throw await super print echo isset unset empty array list require include".split())
_TYPE_NAME = re.compile(r"^[A-Z]")


@lru_cache(maxsize=None)
def _heads(language: str) -> list[tuple[str, bool, re.Pattern]]:
    return [(kind.rstrip("*"), kind.endswith("*"), re.compile(r"^[ \t]*(?P<head>" + pattern + ")", re.M)) for kind, pattern in _HEADS[language]]


def _opening(bare: Bare, at: int) -> tuple[int | None, int]:
    """From a head on, where its body opens, if it has one, and where the head ends."""
    stops = re.compile(r"[{}();\[]")
    while True:
        m = stops.search(bare.code, at)
        if m is None:
            return None, len(bare.code)
        c, at = m.group(), m.end()
        if c in "([":
            close = bare.partner(m.start())
            at = at if close is None else close + 1
        elif c == "{":
            close = bare.partner(m.start())
            if close is not None and bare.line_of(close) == bare.line_of(m.start()):
                rest = bare.code[close + 1 : bare.offset[bare.line_of(close) + 1] - 1]
                if "{" in rest and re.match(r"\s*[^\s;)}]", rest):
                    at = close + 1  # a type in braces within the head
                    continue
            return m.start(), at
        else:
            return None, m.start()


def _spelled(bare: Bare, first: int, last: int) -> str:
    """The lines of a head without the indentation of its first."""
    indent = len(bare.lines[first]) - len(bare.lines[first].lstrip())
    return "\n".join((x[indent:] if not x[:indent].strip() else x.lstrip()).rstrip() for x in bare.lines[first : last + 1])


def _marks(bare: Bare, line: int, commented: set[int]) -> tuple[int, list[str]]:
    """First line of the annotations directly above a head, and the annotations."""
    out: list[str] = []
    i = line - 1
    while i >= 0 and i not in commented:
        s = bare.lines[i].strip()
        first = i
        if s and not s.startswith(("@", "#[")) and s.endswith((")", "]")):
            first = bare.first_line(i)
        if not s or not bare.lines[first].strip().startswith(("@", "#[")):
            break
        out.insert(0, "\n".join(x.strip() for x in bare.lines[first : i + 1]))
        i = first - 1
    return i + 1, out


def _visible(language: str, d: dict, path: str, exported: set[str], section: int | None, holder: dict | None) -> int:
    """0 in its file, 1 to subclasses, 2 within its package or crate, 4 everywhere."""
    head = d["header"]
    has = lambda word: re.search(rf"(?:^|\s){word}\b", head.split("(")[0])
    if language == "go":
        mine = 4 if d["name"][:1].isupper() else 2
        return min(mine, 4 if (d["container"] or "A")[:1].isupper() else 2)
    if language == "rust":
        if d["kind"] == "impl":
            return 4
        m = re.match(r"pub\s*(\(\s*(\w+))?", head)
        if m is None:
            return 4 if holder is not None and holder["kind"] == "trait" else holder["visibility"] if holder is not None and holder.get("for") else 0
        return 4 if m.group(1) is None else 0 if m.group(2) == "self" else 2
    if language == "c":
        return (2 if path.lower().endswith(".h") else 0) if has("static") else 4
    if language == "ruby":
        return 1 if d["kind"] in ("function", "method") and (section == 1 or re.match(r"(?:private|protected)\s+def\b", head)) else 4
    if language in ("java", "php"):
        if has("private"):
            return 0
        if has("protected"):
            return 1
        return 4 if language == "php" or has("public") or holder is not None and holder["kind"] == "interface" else 2
    if language == "javascript":
        if holder is not None and d["kind"] == "method":
            return 0 if has("private") or "#" in head.split("(")[0] else 1 if has("protected") else 4
        return 4 if has("export") or d["name"] in exported else 0
    return 4 if language != "lua" or not has("local") else 0


def declarations(bare: Bare, language: str, path: str = "") -> list[dict]:
    """The declarations of a text in order of their lines."""
    language = _ALIKE.get(language, language)
    language = language if language in _HEADS else ""
    met: dict[int, tuple[str, bool, re.Match]] = {}
    for kind, outside, pattern in _heads(language):
        for m in pattern.finditer(bare.code):
            met.setdefault(m.start("head"), (kind, outside, m))
    commented = {i for a, b in bare.comments for i in range(bare.line_of(a), bare.line_of(max(a, b - 1)) + 1) if not bare.bare[i].strip()}
    exported = {x.strip().split(" as ")[0].strip() for m in re.finditer(r"\bexport\s*\{([^}]*)\}(?!\s*from)", bare.code) for x in m.group(1).split(",")}
    exported |= {m.group(1) for m in re.finditer(r"\bexport\s+default\s+(\w+)\s*;?\s*$", bare.code, re.M)}
    out: list[dict] = []
    open_: list[dict] = []  # the declarations around the place
    sections: dict[int | None, int] = {}
    private = [(m.start(), m.group(1)) for m in re.finditer(r"^[ \t]*(private|protected|public)[ \t]*$", bare.code, re.M)] if language == "ruby" else []
    for place in sorted(met):
        kind, outside, m = met[place]
        line = bare.line_of(place)
        if bare.held(line) and language not in ("",):
            continue
        while open_ and line > open_[-1]["end_line"] - 1:
            open_.pop()
        while private and private[0][0] < place:
            at, word = private.pop(0)
            inside = [d for d in open_ if d["line"] - 1 < bare.line_of(at) < d["end_line"]]
            sections[inside[-1]["idx"] if inside else None] = 0 if word == "public" else 1
        holder = next((d for d in reversed(open_) if d["kind"] in TYPES), None)
        within = open_[-1] if open_ else None
        if outside and within is not None and within["kind"] in ("function", "method"):
            continue
        if outside and kind == "method" and within is None and language == "java":
            kind = "function"  # a method without a type around it
        if outside and kind == "method" and (within is None or within["kind"] not in TYPES or within["kind"] == "enum" and language != "java"):
            continue
        opens = None
        if language in ("ruby", "lua"):
            after = m.end("head")
            p = re.compile(r"[ \t]*\(").match(bare.code, after)
            close = bare.partner(p.end() - 1) if p else None
            last = bare.line_of(close if close is not None else after)
            end = bare.end(line, last - line + 1)
        else:
            opens, stop = _opening(bare, m.end("head"))
            if kind == "function" and outside and language == "java" and opens is None:
                continue
            if kind == "method" and outside and opens is None and (language == "javascript" and holder is not None and holder["kind"] != "interface" and not re.search(r"\babstract\b", m.group("head")) or bare.code[m.end("head") : stop].strip()[-1:] not in (")", ">", "]") and not re.search(r"\)\s*(?::|throws\b|;?$)", bare.code[m.end("head") : stop])):
                continue
            last = bare.line_of(opens if opens is not None else max(place, min(stop, len(bare.code) - 1)))
            if opens is not None and last > line and not bare.bare[last][: opens - bare.offset[last]].strip():
                last -= 1  # a bracket on a line of its own is no part of the head
            if opens is None and kind in ("module",):
                continue
            closes = bare.partner(opens) if opens is not None else None
            end = bare.line_of(closes) if closes is not None else (len(bare.lines) - 1 if opens is not None else last)
        first, marks = _marks(bare, line, commented)
        name = m.group("n")
        container = m.groupdict().get("c")
        if kind == "function" and holder is not None and within is holder and holder["kind"] != "module" or kind == "function" and language == "ruby" and holder is not None and within is holder:
            kind = "method"
        if container is None and holder is not None and within is holder:
            container = holder["name"]
        parent = within["idx"] if within is not None else None
        d = {"idx": len(out), "name": name, "kind": kind, "header_line": first + 1, "line": line + 1, "end_line": max(end, last) + 1, "container": container, "parent": parent, "header": _spelled(bare, line, last), "annotations": marks, "visibility": 4}
        d["for"] = kind == "impl" and " for " in d["header"]
        d["visibility"] = _visible(language, d, path, exported, sections.get(parent), holder)
        out.append(d)
        if d["end_line"] > d["line"] or opens is not None:
            open_.append(d)
    named = {d["name"]: d["idx"] for d in reversed(out) if d["kind"] in ("struct", "interface", "type")}
    for d in out:
        if language == "go" and d["container"] and d["parent"] is None:
            d["parent"] = named.get(d["container"])
            if d["parent"] is None:  # its type is declared elsewhere
                d["kind"] = "function"
        d.pop("for")
    return out


def _use_tree(text: str, before: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The paths of a Rust use tree, parts as written."""
    text = text.strip()
    if text.startswith("{"):
        out, depth, at = [], 0, 1
        for i, c in enumerate(text):
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 1 or depth == 0:
                if text[at:i].strip():
                    out += _use_tree(text[at:i], before)
                at = i + 1
        return out
    head, sep, rest = text.partition("::")
    if sep and "{" not in head:
        return _use_tree(rest, (*before, head.strip()))
    return [(*before, re.split(r"\s+as\s+", text)[0].strip())]


def imports(bare: Bare, language: str) -> list[dict]:
    """Import rows: module, symbol (null where the whole module is meant), line and end_line."""
    language = _ALIKE.get(language, language)
    text = blanked(bare.text, bare.comments)
    out: list[dict] = []

    def add(m: re.Match, module: str, symbol: str | None) -> None:
        out.append({"module": module, "symbol": symbol, "line": bare.line_of(m.start()) + 1, "end_line": bare.line_of(max(m.start(), m.end() - 1)) + 1})

    if language == "javascript":
        for m in re.finditer(r"^[ \t]*import\s+(?:type\s+)?([\w$*{][^;'\"]*?)\s+from\s+['\"]([^'\"\n]+)['\"]|^[ \t]*import\s+['\"]([^'\"\n]+)['\"]|^[ \t]*export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s+['\"]([^'\"\n]+)['\"]|\b(?:require|import)\s*\(\s*['\"]([^'\"\n]+)['\"]\s*\)", text, re.M):
            clause, whole = m.group(1), m.group(3) or m.group(4) or m.group(5)
            if whole:
                add(m, whole, None)
                continue
            braces = re.search(r"\{([^}]*)\}", clause)
            rest = re.sub(r"\{[^}]*\}", "", clause).strip(" ,\n\t")
            names = [re.split(r"\s+as\s+", re.sub(r"^type\s+", "", x.strip()))[0] for x in (braces.group(1).split(",") if braces else []) if x.strip()]
            if rest and not rest.startswith("*"):
                names.insert(0, rest.split(",")[0].strip())
            for x in names or [None]:
                add(m, m.group(2), x)
    elif language == "php":
        for m in re.finditer(r"^[ \t]*use\s+(?!function\b|const\b|\()([\w\\]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w\\]+(?:\s+as\s+\w+)?)*|[\w\\]+\\\s*\{[^}]*\})\s*;", text, re.M):
            inside = next((d for d in re.finditer(r"\{", m.group(1))), None)
            prefix = m.group(1)[: inside.start()].strip().rstrip("\\") + "\\" if inside else ""
            for x in (m.group(1)[inside.end() :].rstrip("} \n\t") if inside else m.group(1)).split(","):
                if x.strip():
                    module, _, symbol = (prefix + x.split()[0]).lstrip("\\").rpartition("\\")
                    add(m, module or symbol, symbol if module else None)
    elif language == "go":
        for m in re.finditer(r"^[ \t]*import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"|^[ \t]*import\s*\(([^)]*)\)", text, re.M):
            if m.group(1):
                add(m, m.group(1), m.group(1).rsplit("/", 1)[-1])
            else:
                for x in re.compile(r"\"([^\"\n]+)\"").finditer(text, m.start(2), m.end(2)):
                    add(x, x.group(1), x.group(1).rsplit("/", 1)[-1])
    elif language == "java":
        for m in re.finditer(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", text, re.M):
            module, _, symbol = (m.group(1), "", None) if m.group(2) else m.group(1).rpartition(".")
            add(m, module or m.group(1), symbol if module else None)
    elif language == "ruby":
        for m in re.finditer(r"^[ \t]*require(?:_relative)?[ (]\s*['\"]([^'\"\n]+)['\"]", text, re.M):
            add(m, m.group(1), None)
    elif language == "rust":
        for m in re.finditer(r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?use\s+([^;]+);", text, re.M):
            for parts in _use_tree(m.group(1)):
                *module, last = [p for p in parts if p]
                if last == "self" and module:
                    *module, last = module
                add(m, "::".join(module) or last, None if last == "*" or not module else last)
    elif language == "c":
        for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", text, re.M):
            add(m, m.group(1), None)
    elif language == "lua":
        for m in re.finditer(r"\brequire\s*\(?\s*['\"]([^'\"\n]+)['\"]", text):
            add(m, m.group(1), None)
    elif language == "bash":
        for m in re.finditer(r"^[ \t]*(?:source|\.)[ \t]+([^\s;&|]+)", text, re.M):
            add(m, m.group(1).strip("'\""), None)
    return out


def references(bare: Bare, declared: list[dict]) -> list[dict]:
    """Calls: of a bare name (Free), of a member with its receiver (Member), of a type or its member (Static)."""
    heads = {(d["line"], d["name"]) for d in declared}
    out = []
    for m in _CALL.finditer(bare.code):
        name, line = m.group("n"), bare.line_of(m.start("n")) + 1
        if name in _WORDS or (line, name) in heads and not m.group("by"):
            continue
        receiver = m.group("r")
        if m.group("new"):
            shape, receiver = "Static", name
        elif receiver is None:
            shape = "Free"
        else:
            shape = "Static" if m.group("by") == "::" and _TYPE_NAME.match(receiver.rsplit("::", 1)[-1]) else "Member"
        out.append({"name": name, "line": line, "shape": shape, "receiver": receiver})
    return out


def functions(bare: Bare, declared: list[dict], language: str) -> list[dict]:
    """Functions and methods by qualified name with their complexity; those within count for themselves."""
    pattern = re.compile(_BRANCHES.get(_ALIKE.get(language, language), _BRANCHES[""]))
    mine = [d for d in declared if d["kind"] in ("function", "method")]
    branches = [bare.line_of(m.start()) + 1 for m in pattern.finditer(bare.code)]
    count = {d["idx"]: 1 for d in mine}
    owner: list[int | None] = [None] * (len(bare.lines) + 2)
    for d in mine:  # in order of lines, so what lies within comes later
        for i in range(d["line"], min(d["end_line"], len(bare.lines)) + 1):
            owner[i] = d["idx"]
    for i in branches:
        if owner[i] is not None:
            count[owner[i]] += 1
    by_idx = {d["idx"]: d for d in declared}

    def qualified(d: dict) -> str:
        above = by_idx.get(d["parent"])
        if above is None:
            return f"{d['container']}::{d['name']}" if d["container"] else d["name"]
        return f"{qualified(above)}{'::' if above['kind'] in TYPES else '.'}{d['name']}"

    return [{"name": qualified(d), "start_line": d["line"], "end_line": d["end_line"], "complexity": count[d["idx"]]} for d in mine]


def measure(text: str, language: str) -> dict:
    """lines, code (lines that are neither blank nor comment alone) and complexity (branches) of a file."""
    bare = Bare(text.lstrip("﻿").replace("\r\n", "\n"), language)
    in_string = {i for a, b in bare.strings for i in range(bare.line_of(a), bare.line_of(max(a, b - 1)) + 1)}
    n = len(bare.lines) - (1 if not bare.lines[-1] else 0)
    code = sum(1 for i in range(n) if bare.bare[i].strip() or i in in_string and bare.lines[i].strip())
    return {"lines": n, "code": code, "complexity": len(re.findall(_BRANCHES.get(_ALIKE.get(language, language), _BRANCHES[""]), bare.code))}


def parse(text: str, language: str, path: str = "") -> dict:
    bare = Bare(text.lstrip("﻿").replace("\r\n", "\n"), language)
    declared = declarations(bare, language, path)
    return {"declarations": declared, "functions": functions(bare, declared, language), "imports": imports(bare, language), "references": references(bare, declared)}
