"""Keyword-stuffed pages, link lists and tag lists.

Lines are cut into segments as sentences end, and each segment is reduced to a shape: counts of words, capitals, separators
and links, in steps, with how it begins and ends. The shape tells a sentence from an entry of a list, whatever the language:
there is no list of words. A segment of sentence shape whose words keep coming back (a phrase at least twice in fifteen words
of the segments it stands in, or half of a long segment's words) counts as a repeated shape. Code and log entries are
content. A page is flagged if most of its text lies in segments of other shapes than sentences and few of these shapes
hold most of it.

A page is judged alone and in one pass, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2028\u2029\u2060\ufeff]")
_LINK = re.compile(r"<a\b[^>]*>[\s\S]*?</a>|!?\[[^\]\n]*\]\([^)\n]*\)|<https?://[^>\s]*>|https?://\S+|\bwww\.\S+", re.I)
_META = re.compile(r"<meta\b[^>]*?content\s*=\s*\"([^\"]*)\"[^>]*>?", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_LOG = re.compile(r"^\W*(?:\d{4}[-/]\d\d?[-/]\d\d?[T ]\d\d?:\d\d|\d\d?:\d\d:\d\d|\[?\d\d?/\w{3}/\d{4}|(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b)")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:[)\]}]|//|/\*|\*/|#!|<\?php|\$ )|[\w\])]\s*(?::=|[-+*/]?=|==|!=|->|=>)\s*\S|\w\([^()]*\)\s*[:{;]?\s*$|^\s*(?:def|class|fn|func|function|public|private|protected|const|let|var|if|for|else|while|module)\b(?=.*[(){}=;:$])(?!.*[.!?]\s*$)|^\s*(?:return|import|from|require|use|package|end|else|break)\b(?:\s+\S+){0,2}\s*$|^\s*(?:from\s+\S+\s+import\b|return\b(?!.*[.!?]\s*$))")
_TRAIL = re.compile(r"^\W*\w[\w' -]*(?:[>»›→][\w' -]*\w[\w' -]*){2,}(?:\(\d+\))?$")
_HASHTAGS = re.compile(r"(?:^|\s)#\w")
_SEGMENT_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\s+—\s+|\s*\|\s*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SEPARATORS = re.compile(r"[,|;·•>»/#]|\s[-–—]\s")


def _step(n: int) -> int:
    """0, 1, 2, 3-4, 5-8, 9-16 ..."""
    return n if n < 3 else (n - 1).bit_length() + 1


def shape(words: list[str], separators: int, links: int, mark: str = "") -> tuple[int, int, int, int, str]:
    """Steps of the counts, and what else tells segments apart: links, trail, tags, list, repeated or sentence."""
    return _step(len(words)), _step(sum(w[0].isupper() for w in words)), _step(separators), _step(links), mark


def is_sentence(words: list[str], separators: int, part: str) -> bool:
    """Is this the shape of a sentence? Four words or more, at most one separator to four words and half of the words with a capital; below seven words it begins with a capital or a number or ends like one."""
    n = len(words)
    if n < 4 or n < 7 and not (part[0].isupper() or part[0].isdigit() or part[-1] in ".!?:"):
        return False
    capitals = sum(w[0].isupper() for w in words) if not part.isupper() else 1
    return 4 * separators <= n and 2 * capitals <= n + 1


def repeated(segments: list[list[str]]) -> list[bool]:
    """Which segments of sentence shape are made of phrases that keep coming back.

    A phrase of three words is one if it stands there four times and twice in fifteen words of the segments that have it; a
    segment is if more than two fifths of its words lie in such phrases, or, from 16 words on, if half of its words have
    been there before.
    """
    seen, room = Counter(), Counter()
    phrases = [list(zip(w, w[1:], w[2:])) for w in segments]
    for words, own in zip(segments, phrases):
        seen.update(own)
        for p in set(own):
            room[p] += len(words)
    stuffed = {p for p, n in seen.items() if n >= 4 and 15 * n >= 2 * room[p]}
    out = []
    for words, own in zip(segments, phrases):
        covered = {i + k for i, p in enumerate(own) if p in stuffed for k in range(3)} if stuffed else ()
        out.append(5 * len(covered) > 2 * len(words) or len(words) >= 16 and 2 * len(set(words)) <= len(words))
    return out


_PREFIX = re.compile(r"(>)[> ]*|(#) +(?=\S)")


def _unwrapped(text: str) -> Iterator[str]:
    """Lines without blank ones; lines that follow each other with a mark of quotation or comment before them are one text. A single one may be a heading."""
    held: list[str] = []
    mark, fenced = "", False
    for line in [*text.splitlines(), ""]:
        line = line.strip()
        fenced = fenced != line.startswith(("```", "~~~"))
        m = None if fenced else _PREFIX.match(line)
        now = (m.group(1) or m.group(2)) if m else ""
        if held and now != mark:
            heading = mark == "#" and len(held) == 1 and held[0][:1].isupper() and held[0][-1:] not in ".!?"
            yield f"# {held[0]}" if heading else " ".join(held)
            held = []
        mark = now
        if now:
            held.append(line[m.end() :].strip())
        elif line:
            yield line


def weigh(text: str) -> tuple[int, Counter]:
    """Characters of content, and of all other segments by shape."""
    text = _HIDDEN.sub("", html.unescape(text)).replace("\u00a0", " ")
    content, shapes = 0, Counter()
    segments: list[tuple[list[str], str]] = []
    fenced = commented = False
    for line in _unwrapped(text):
        if line.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if line.startswith("/*"):
            commented = True
        if fenced or commented or _LOG.match(line):
            content += len(line)
            commented = commented and "*/" not in line
            continue
        size = len(line)
        if "<" in line:
            line = _META.sub(r" \1 ", line)
        links = 0
        if "http" in line or "](" in line or "<a" in line or "www." in line or "HTTP" in line:
            links = len(_LINK.findall(line))
            if links:
                rest = _TAG.sub(" ", _LINK.sub(" ", line))
                words = _WORD.findall(rest)
                if len(words) < 4 * links:  # an entry; sentences beside a run of links stay content
                    kept = sum(len(x) for x in _SEGMENT_END.split(rest) if is_sentence(_WORD.findall(x), len(_SEPARATORS.findall(x)), x.strip() or " "))
                    kept = min(size, kept)
                    content += kept
                    shapes[shape(words[:4], min(links, 2), min(links, 3), "links")] += size - kept
                    continue
                line = rest
        if "<" in line:
            line = _TAG.sub(" ", line)
        if line.startswith("#") and line.lstrip("#")[:1] == " ":
            continue  # headings count on neither side
        if _TRAIL.match(line):
            shapes[shape([], 3, 0, "trail")] += size
            continue
        if len(_HASHTAGS.findall(line)) >= 2 or re.match(r"#\w+\s", line) and not line.endswith((".", "!")):
            shapes[shape([], 2, 0, "tags")] += size
            continue
        if _CODE.search(line) and not links:
            content += size
            continue
        for part in _SEGMENT_END.split(line):
            part = part.strip()
            words = _WORD.findall(part)
            if "{" in part or "}" in part or "`" in part and len(_SEPARATORS.findall(part)) < 4:
                content += len(part)
            elif words:
                segments.append((words, part))
    told: list[tuple[list[str], str, int]] = []
    for words, part in segments:
        separators = len(_SEPARATORS.findall(part))
        if is_sentence(words, separators, part):
            told.append((words, part, separators))
        else:
            shapes[shape(words, separators, 0, "list")] += len(part)
    for (words, part, separators), stuffed in zip(told, repeated([[w.lower() for w in words] for words, _, _ in told])):
        if stuffed:
            shapes[shape(words, separators, 0, "repeated")] += len(part)
        else:
            content += len(part)
    return content, shapes


RESULT = "content_chars int, list_chars int, shapes int, top_share double, spam boolean"


def spam_pages(documents: DataFrame, id_: str = "doc_id", text: str = "text", most: float = 0.5, few: int = 6, least_chars: int = 120) -> DataFrame:
    """Per document: characters of content and of other segments, number of shapes among the latter, the share of the `few` largest, and the verdict.

    spam: more than `most` of the text is no content, that is at least least_chars characters, and the `few` largest
    shapes hold at least half of it. Null and empty texts are not spam and have zeros; repeated documents are judged each
    for itself; texts of any length are read whole; other columns are ignored.
    """
    rows = documents.select(id_, text)
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for t in batch.column(1).to_pylist():
                content, shapes = weigh(t) if t else (0, Counter())
                other = sum(shapes.values())
                top = sum(n for _, n in shapes.most_common(few)) / other if other else 0.0
                for column, v in zip(out, (content, other, len(shapes), top, other >= least_chars and other > most * (content + other) and top >= 0.5)):
                    column.append(v)
            types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, types))], names=[id_, "content_chars", "list_chars", "shapes", "top_share", "spam"])

    return rows.mapInArrow(run, f"`{id_}` {kind}, {RESULT}")
