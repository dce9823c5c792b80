"""A scanner for source texts of many languages: where comments and strings lie, and the text without them.

One pass over a text, from token to token. It knows nested comments, raw and long strings, here-documents, regular
expressions as literals and templates with code in them, so that a bracket or an `end` within a string delimits nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

#: Languages of file endings, for files whose language is not given.
ENDINGS = {"py": "python", "rb": "ruby", "php": "php", "go": "go", "rs": "rust", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c", "sh": "bash", "bash": "bash", "lua": "lua"}


def language_of(language: str | None, path: str | None) -> str:
    """The language in lower case; where it is not given, that of the file's ending, and without one C-like."""
    return (language or ENDINGS.get((path or "").rsplit(".", 1)[-1].lower(), "java")).lower()


_SLASHES = r"(?P<line>//[^\n]*)|(?P<block>/\*)"
_DOUBLE, _SINGLE = r'"(?:\\[\s\S]|[^"\\\n])*"?', r"'(?:\\[\s\S]|[^'\\\n])*'?"
_DOUBLE_LONG, _SINGLE_LONG = r'"(?:\\[\s\S]|[^"\\])*"?', r"'(?:\\[\s\S]|[^'\\])*'?"

#: Of each language, what begins a comment, a string or something that only looks like one. Group names choose what follows.
_TOKENS = {
    "python": r"(?P<line>\#[^\n]*)|(?P<string>" + r'"""(?:\\[\s\S]|[^\\])*?(?:"""|\Z)' + r"|'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|" + _DOUBLE + "|" + _SINGLE + ")",
    "ruby": r"(?P<line>(?<![\w$?])\#[^\n]*|^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z))|(?P<heredoc><<[~-]?(?P<q>[\"'`]?)(?P<tag>[A-Z_]\w*)(?P=q))|(?P<filled>[\"`])|(?P<string>'(?:\\[\s\S]|[^'\\])*'?)|(?P<percent>(?<![\w)\]])%[wWiIqQr]?[\[({<|!])|(?P<regex>/)|(?P<skip>\?[\"'\#](?!\w))",
    "bash": r"(?P<line>(?:(?<=\s)|(?<=;)|^)\#[^\n]*)|(?P<heredoc><<(?!<)-?[ \t]*(?P<q>[\"']?)\\?(?P<tag>\w+)(?P=q))|(?P<skip>\\[\s\S]|\$\#|\$\{\#|<<<)|(?P<string>\$?" + _DOUBLE_LONG + "|'[^']*'?)",
    "lua": r"(?P<line>--(?!\[=*\[)[^\n]*|--\[(?P<lc>=*)\[[\s\S]*?(?:\](?P=lc)\]|\Z))|(?P<string>\[(?P<ls>=*)\[[\s\S]*?(?:\](?P=ls)\]|\Z)|" + _DOUBLE + "|" + _SINGLE + ")",
    "php": _SLASHES + r"|(?P<hash>\#(?!\[)[^\n]*)|(?P<heredoc><<<[ \t]*(?P<q>[\"']?)(?P<tag>\w+)(?P=q))|(?P<string>" + _DOUBLE_LONG + "|" + _SINGLE_LONG + ")",
    "go": _SLASHES + r"|(?P<string>" + _DOUBLE + r"|`[^`]*`?|'(?:\\[^\n]+?|[^'\\\n])')",
    "rust": _SLASHES + r"|(?P<string>\bb?r(?P<rs>\#*)\"[\s\S]*?(?:\"(?P=rs)|\Z)|" + _DOUBLE_LONG + r"|'(?:\\[^\n']+|[^'\\\n])')|(?P<skip>'\w+)",
    "java": _SLASHES + r'|(?P<string>"""(?:\\[\s\S]|[^\\])*?(?:"""|\Z)|' + _DOUBLE + "|" + _SINGLE + ")",
    "c": _SLASHES + r"|(?P<string>" + _DOUBLE + "|" + _SINGLE + ")",
    "javascript": _SLASHES + r"|(?P<string>" + _DOUBLE + "|" + _SINGLE + ")|(?P<filled>`)|(?P<regex>/)",
}
_ALIKE = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "shell": "bash", "sh": "bash"}
_NESTED = re.compile(r"/\*|\*/")
_JS_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:[(,=:\[!&|?{};+\-*%~^]|=>|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await|if|unless|when|while|until|and|or|not|then|puts))\s*\Z|\A\s*\Z|\n\s*\Z")
_CLOSES = {"[": "]", "(": ")", "{": "}", "<": ">"}


@lru_cache(maxsize=None)
def _tokens(language: str) -> re.Pattern:
    return re.compile(_TOKENS.get(_ALIKE.get(language, language), _TOKENS["java"]), re.M)


@lru_cache(maxsize=None)
def _stops(quote: str, opens: str) -> re.Pattern:
    return re.compile(rf"\\|{re.escape(quote)}" + (f"|{re.escape(opens)}" if opens else ""))


_INNER = re.compile(r"[\"'`{}]|/\*")


def _filled(text: str, i: int, quote: str, opens: str) -> int:
    """End of a string that begins at i and may hold code between `opens` and a closing brace, with strings of its own."""
    n, i, stops = len(text), i + 1, _stops(quote, opens)
    while m := stops.search(text, i):
        c, i = m.group(), m.end()
        if c == "\\":
            i += 1
        elif c == quote:
            return i
        else:
            depth = 1
            while depth:
                m = _INNER.search(text, i)
                if m is None:
                    return n
                c, i = m.group(), m.end()
                if c in "\"'`":
                    i = _filled(text, m.start(), c, opens if c == "`" or opens == "#{" and c == '"' else "")
                elif c == "/*":
                    end = text.find("*/", i)
                    i = (n if end < 0 else end + 2) if opens == "${" else i
                else:
                    depth += 1 if c == "{" else -1
    return n


def scan(text: str, language: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of the comments and of the strings, both in order. What does not end runs to the end of the text or line."""
    language = _ALIKE.get(language, language)
    comments: list[tuple[int, int]] = []
    strings: list[tuple[int, int]] = []
    pattern, pos, n = _tokens(language), 0, len(text)
    resume: tuple[int, int] | None = None  # the line end after which here-documents begin, and where they end
    while True:
        m = pattern.search(text, pos)
        if resume and (m is None or m.start() > resume[0]):
            pos, resume = resume[1], None
            continue
        if m is None:
            return comments, strings
        a, pos, kind = m.start(), m.end(), m.lastgroup
        if kind in ("q", "tag", "lc", "ls", "rs"):
            kind = next(k for k in ("heredoc", "line", "string") if k in m.groupdict() and m.group(k) is not None)
        if kind in ("line", "hash"):
            comments.append((a, pos))
        elif kind == "block":
            if language == "rust":
                depth = 1
                while depth:
                    x = _NESTED.search(text, pos)
                    if x is None:
                        pos = n
                        break
                    depth, pos = depth + (1 if x.group() == "/*" else -1), x.end()
            else:
                end = text.find("*/", pos)
                pos = n if end < 0 else end + 2
            comments.append((a, pos))
        elif kind == "string":
            strings.append((a, pos))
        elif kind == "filled":
            pos = _filled(text, a, text[a], "${" if language == "javascript" else "#{")
            strings.append((a, pos))
        elif kind == "regex":
            if _BEFORE_REGEX.search(text, max(0, a - 40), a) and (language != "ruby" or text[a + 1 : a + 2] not in (" ", "=", "")):
                x = _JS_REGEX.match(text, a)
                if x:
                    pos = x.end()
                    strings.append((a, pos))
        elif kind == "percent":
            opens = text[pos - 1]
            closes, depth = _CLOSES.get(opens, opens), 1
            while pos < n and depth:
                c = text[pos]
                if c == "\\":
                    pos += 1
                elif c == closes:
                    depth -= 1
                elif c == opens:
                    depth += 1
                pos += 1
            strings.append((a, min(pos, n)))
        elif kind == "heredoc":
            line_end = text.find("\n", pos)
            if line_end < 0:
                continue
            start = resume[1] if resume else line_end + 1
            indent = r"[ \t]*" if language == "php" or "~" in m.group() or "-" in m.group() else ""
            x = re.compile(rf"^{indent}{re.escape(m.group('tag'))}" + (r"\b" if language == "php" else r"[ \t]*$"), re.M).search(text, start)
            if x is None:
                continue  # a shift, not a document
            resume = (line_end, x.end())
            strings.append((start, x.end()))


_NOT_BREAK = re.compile(r"[^\n]")


def blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with blanks in the spans; places and lines stay."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        out += [text[at:a], _NOT_BREAK.sub(" ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


_RUBY_WORD = re.compile(r"(?<![.:@$\w])((?:class|module)(?=\s+(?:[A-Z:]|<<))|def|begin|case|for|do|if|unless|while|until|end)(?![\w?!:=]|:)")
_RUBY_HEAD = re.compile(r"(?:[=(,;\[{|&]|\b(?:then|else|do|and|or|not))\s*\Z|\A\s*\Z")
_ENDLESS = re.compile(r"def\s+[\w.?!]+(?:\([^()\n]*\))?\s*=(?![=~>])")
_LUA_WORD = re.compile(r"(?<![.:\w])(function|if|do|repeat|end|until)\b")


class Bare:
    """A text without its comments and strings: what brackets and keywords say of its extents."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, _ALIKE.get(language, language)
        self.comments, self.strings = scan(text, language)
        self.code = blanked(text, self.comments + self.strings)
        self.lines, self.bare = text.split("\n"), self.code.split("\n")
        self.offset = [0]
        for line in self.lines:
            self.offset.append(self.offset[-1] + len(line) + 1)
        self._partner: dict[int, int] | None = None
        self._opener: dict[int, int] | None = None
        self._held: bytearray | None = None

    def line_of(self, place: int) -> int:
        return bisect_right(self.offset, place) - 1

    def partner(self, place: int) -> int | None:
        """Where the bracket at a place closes."""
        if self._partner is None:
            self._partner, open_ = {}, []
            for m in re.finditer(r"[{}()\[\]]", self.code):
                if m.group() in "{([":
                    open_.append((m.group(), m.start()))
                    continue
                want = {"}": "{", ")": "(", "]": "["}[m.group()]
                # a bracket that fits nothing open is passed over, as are open ones within a closed pair
                k = len(open_) - 1
                while k >= 0 and open_[k][0] != want:
                    k -= 1
                if k >= 0 and (k == len(open_) - 1 or want == "{"):
                    self._partner[open_[k][1]] = m.start()
                    del open_[k:]
        return self._partner.get(place)

    def first_line(self, line: int) -> int:
        """The line on which the bracket opens that closes at the end of the line; the line itself if none does."""
        place = self.offset[line] + len(self.bare[line].rstrip()) - 1
        self.partner(-1)
        if self._opener is None:
            self._opener = {b: a for a, b in self._partner.items()}
        a = self._opener.get(place)
        return line if a is None else self.line_of(a)

    def held(self, line: int) -> bool:
        """Does the line begin within a string or an open bracket?"""
        if self._held is None:
            self._held = bytearray(len(self.lines) + 1)
            for a, b in self.strings:
                for i in range(self.line_of(a) + 1, self.line_of(max(a, b - 1)) + 1):
                    self._held[i] = 1
            self.partner(-1)
            for a, b in (self._partner or {}).items():
                if self.code[a] != "{" or self.language == "python":
                    for i in range(self.line_of(a) + 1, self.line_of(b) + 1):
                        self._held[i] = 1
        return bool(self._held[line])

    def end(self, line: int, span: int) -> int:
        """Last line of what a header of `span` lines at `line` opens; its own last line if it opens nothing."""
        last = line + span - 1
        if self.language == "python":
            return self._by_indentation(line, last)
        if self.language in ("ruby", "lua"):
            return self._by_words(line, last)
        stop = self.offset[min(last + 2, len(self.lines))]
        at, paren = self.offset[line], 0
        while True:
            m = re.compile(r"[{}();]").search(self.code, at, stop)
            if m is None or m.group() == "}" and not paren or m.group() == ";" and not paren:
                return last  # a header without a body
            c, at = m.group(), m.end()
            if c == "(":
                close = self.partner(m.start())
                at = close + 1 if close is not None else at
                stop = max(stop, self.offset[min(self.line_of(at) + 2, len(self.lines))])
            elif c == "{":
                close = self.partner(m.start())
                if close is None:
                    return len(self.lines) - 1
                rest = self.code[close + 1 : self.offset[self.line_of(close) + 1] - 1]
                if self.line_of(close) <= last and re.match(r"\s*[^\s;)]", rest) and "{" in rest and self.language not in ("go", "bash"):
                    at = close + 1  # a type or a default in braces within the header
                    continue
                return max(last, self.line_of(close))

    def _by_indentation(self, line: int, last: int) -> int:
        indent = len(self.lines[line]) - len(self.lines[line].lstrip())
        end = last
        for i in range(last + 1, len(self.lines)):
            if self.held(i):
                if self.lines[i].strip():
                    end = i
                continue
            if not self.bare[i].strip() and not self._string_on(i):
                if self.lines[i].strip() and len(self.lines[i]) - len(self.lines[i].lstrip()) > indent:
                    end = i  # a comment of the body
                continue
            if len(self.lines[i]) - len(self.lines[i].lstrip()) <= indent:
                return end
            end = i
        return end

    def _string_on(self, i: int) -> bool:
        k = bisect_right(self.strings, (self.offset[i + 1] - 1, -1)) - 1
        return k >= 0 and self.strings[k][0] >= self.offset[i]

    def _by_words(self, line: int, last: int) -> int:
        depth, at = 0, self.offset[line]
        ruby = self.language == "ruby"
        if ruby and _ENDLESS.match(self.code, at + len(self.lines[line]) - len(self.lines[line].lstrip())):
            return last
        looped = -1  # the line of a loop whose `do` opens nothing of its own
        for m in (_RUBY_WORD if ruby else _LUA_WORD).finditer(self.code, at):
            word, i = m.group(1), self.line_of(m.start())
            if word in ("end", "until") and not (ruby and word == "until"):
                depth -= 1
                if depth <= 0:
                    return max(last, i)
                continue
            if ruby:
                head = self.code[self.offset[i] : m.start()]
                if word in ("if", "unless", "while", "until") and not _RUBY_HEAD.search(head):
                    continue
                if word in ("class", "module") and head.strip() and not head.rstrip().endswith(";"):
                    continue
                if word == "do" and looped == i:
                    looped = -1
                    continue
                if word in ("while", "until", "for"):
                    looped = i
                if word == "def" and _ENDLESS.match(self.code, m.start()):
                    continue
            depth += 1
            if i > last and depth == 1:
                return last  # the header opened nothing
        return len(self.lines) - 1 if depth > 0 else last
