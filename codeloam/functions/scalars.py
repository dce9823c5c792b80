"""Scalar functions on paths, names, dates and texts: Column to Column, built from JVM expressions only.

A null argument gives null unless stated otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Ordered enums: visibility and confidence (the lower confidence is the stronger).
VISIBILITY = ("FileLocal", "Protected", "Internal", "Unknown", "Public")
CONFIDENCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def line_count(text: Column | str) -> Column:
    """Lines of a text; a final line break opens no further line, and an empty text has none."""
    t = _c(text)
    return F.size(F.split(t, "\n", -1)) - F.when(t.endswith("\n") | (t == ""), 1).otherwise(0)


def directory_of(path: Column | str) -> Column:
    """The folder with its slash; './' for files at the root."""
    p = _c(path)
    return F.when(p.contains("/"), F.regexp_extract(p, "^(.*/)", 1)).otherwise(F.when(p.isNotNull(), F.lit("./")))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), "[^/]*$", 0)


def stem(path: Column | str) -> Column:
    """The file's name without its last ending."""
    return F.regexp_replace(base_name(path), "\\.[^.]*$", "")


def ending(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), "\\.([^./]+)$", 1)


def tail(module: Column | str) -> Column:
    """What follows the last dot, slash or colon."""
    return F.regexp_extract(_c(module), "[^./:]*$", 0)


def file_to_module(path: Column | str, language: Column | str) -> Column:
    """The path without its ending; dotted for Python."""
    bare = F.regexp_replace(_c(path), "\\.[^./]*$", "")
    return F.when(F.lower(_c(language)) == "python", F.replace(bare, F.lit("/"), F.lit("."))).otherwise(bare)


def symbol_id(path: Column | str, language: Column | str, name: Column | str) -> Column:
    return F.concat(file_to_module(path, language), F.lit("::"), _c(name))


def qualifier(name: Column | str) -> Column:
    """Of Class::m, Class.m or module.f the part before the last '::', else before the last dot; empty if there is none."""
    n = _c(name)
    return F.when(n.contains("::"), F.regexp_extract(n, "^(.*)::", 1)).otherwise(F.regexp_extract(n, "^(.*)\\.", 1))


def unqualified(name: Column | str) -> Column:
    n = _c(name)
    return F.when(n.contains("::"), F.regexp_extract(n, "::((?:(?!::).)*)$", 1)).otherwise(F.regexp_extract(n, "[^.]*$", 0))


def normalized_path(path: Column | str) -> Column:
    """Folds '.' and '..'; null for a path that leaves the root."""
    parts = F.filter(F.split(_c(path), "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("up"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up, n = acc["up"], F.size(acc["up"])
        return F.when(part != "..", F.struct(F.concat(up, F.array(part)).alias("up"), acc["out"].alias("out"))).otherwise(
            F.struct(F.slice(up, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("up"), (acc["out"] | (n == 0)).alias("out"))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(~acc["out"], F.array_join(acc["up"], "/")))


def clean_path(path: Column | str) -> Column:
    """Backslashes become slashes and one leading './' goes."""
    return F.regexp_replace(F.translate(_c(path), "\\", "/"), "^\\./", "")


def depth(path: Column | str) -> Column:
    return F.size(F.split(_c(path), "/"))


def under(path: Column | str, scope: str) -> Column:
    """Is the path the scope itself or below it? An empty scope holds everything."""
    p = _c(path)
    return F.lit(True) if scope in ("", ".") else (p == scope) | p.startswith(scope.rstrip("/") + "/")


def weaker(a: Column | str, b: Column | str) -> Column:
    """The weaker of two confidences."""
    return F.greatest(_c(a), _c(b))


def same_name(a: Column | str, b: Column | str, language: Column | str) -> Column:
    """Equal names; PHP does not tell the case of ASCII letters."""
    lower = lambda x: F.translate(_c(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.lower(_c(language)) == "php", lower(a) == lower(b)).otherwise(_c(a) == _c(b))


def rank_bucket(complexity: Column | str) -> Column:
    c = _c(complexity)
    return F.when(c < 10, "low").when(c < 30, "medium").when(c < 80, "high").when(c.isNotNull(), "critical")


def age(date: Column | str, as_of: str) -> Column:
    """How long ago: today, yesterday, days up to 13, weeks up to 59 days, months up to 364, then years; the future is today."""
    d = F.greatest(F.datediff(F.lit(as_of).cast("date"), _c(date)), F.lit(0))
    unit = lambda n, word: F.concat(F.floor(n).cast("string"), F.lit(f" {word}"), F.when(F.floor(n) == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(_c(date).isNull(), None).when(d == 0, "today").when(d == 1, "yesterday").when(d < 14, unit(d, "day")).when(d < 60, unit(d / 7, "week")).when(d < 365, unit(d / 30, "month")).otherwise(unit(d / 365, "year"))


def humanize_seconds(seconds: Column | str) -> Column:
    """A span in its largest whole unit: s, m, h, d, mo, y."""
    s = F.greatest(_c(seconds), F.lit(0))
    steps = ((60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h"), (30 * 86400, 86400, "d"), (365 * 86400, 30 * 86400, "mo"))
    out = None
    for below, unit, word in steps:
        value = F.concat(F.floor(s / unit).cast("string"), F.lit(word))
        out = F.when(s < below, value) if out is None else out.when(s < below, value)
    return F.when(_c(seconds).isNotNull(), out.otherwise(F.concat(F.floor(s / (365 * 86400)).cast("string"), F.lit("y"))))


def clip(text: Column | str, n: int) -> Column:
    """At most n characters; a cut text ends in an ellipsis, without blanks before it. One that fits stays as it is."""
    t = _c(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…")))


def format_size(n: Column | str) -> Column:
    """Bytes in the largest unit of 1024: B without, K, M and G with one decimal, halves to even."""
    b = _c(n)
    unit = lambda size, word: F.format_string(f"%.1f{word}", F.bround(b / float(size), 1))
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit("B"))).when(b < 1 << 20, unit(1 << 10, "K")).when(b < 1 << 30, unit(1 << 20, "M")).when(b.isNotNull(), unit(1 << 30, "G"))


def first_sentence(text: Column | str) -> Column:
    return F.regexp_extract(_c(text), "^\\s*([\\s\\S]*?[.!?])(?:\\s|$)", 1)


def modifiers(header: Column | str) -> Column:
    """The words before the last word that precedes the first bracket."""
    words = F.split(F.trim(F.regexp_extract(_c(header), "^[^({]*", 0)), "\\s+")
    return F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def utf16_width(text: Column | str) -> Column:
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("int")


def content_key(version: str, content: Column | str, path: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(version), _c(content), _c(path)), 256)


def line_hashes(text: Column | str) -> Column:
    """The first eight hex digits of each line's hash."""
    return F.transform(F.split(_c(text), "\n", -1), lambda x: F.substring(F.sha2(x, 256), 1, 8))


def civil_date(seconds: Column | str) -> Column:
    """The UTC date of seconds since 1970, in a session of any zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_c(seconds) / 86400).cast("int"))


def date_in_name(path: Column | str) -> Column:
    """The date in a file's name, with dashes or as eight digits, not as part of a longer number; null for none or an impossible one."""
    part = lambda k: F.nullif(F.regexp_extract(base_name(path), "(?:^|[^0-9])(\\d{4})-?(\\d{2})-?(\\d{2})(?:[^0-9]|$)", k), F.lit(""))
    return F.try_make_timestamp_ntz(part(1).cast("int"), part(2).cast("int"), part(3).cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def status_label(status: Column | str) -> Column:
    s = F.substring(_c(status), 1, 1)
    return F.when(s == "A", "added").when(s == "D", "deleted").when(s == "R", "renamed").when(s == "C", "copied").when(s == "M", "modified").when(s == "T", "type changed").otherwise(F.when(s.isNotNull(), "unknown"))


def porcelain_state(xy: Column | str) -> Column:
    """Of the two status letters: renamed or copied before untracked, added, deleted and modified."""
    s = _c(xy)
    return F.when(s.rlike("[RC]"), "renamed").when(s.contains("?"), "untracked").when(s.contains("A"), "added").when(s.contains("D"), "deleted").when(s.isNotNull(), "modified")


def staging_word(xy: Column | str) -> Column:
    """staged, unstaged or both, by which of the two letters is set."""
    s = _c(xy)
    x, y = F.substring(s, 1, 1), F.substring(s, 2, 1)
    return F.when(s.startswith("?"), None).when((x != " ") & (y != " "), "both").when(x != " ", "staged").when(y != " ", "unstaged")


def hunk_range(text: Column | str) -> Column:
    """Of '+a,b' or '-a,b' the lines a .. a + b - 1 as a struct; b is 1 if not given, and a range of 0 lines ends before it starts."""
    t = _c(text)
    a = F.regexp_extract(t, "^[+-](\\d+)", 1).cast("int")
    b = F.coalesce(F.nullif(F.regexp_extract(t, "^[+-]\\d+,(\\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return F.struct(a.alias("first"), (a + b - 1).alias("last"))


#: The forms of time that log lines open with. Syslog names no year.
_ISO = "(\\d{4})[-/](\\d{2})[-/](\\d{2})[T ](\\d{2}):(\\d{2}):(\\d{2})"
_ACCESS_LOG = "(\\d{2})/([A-Za-z]{3})/(\\d{4}):(\\d{2}):(\\d{2}):(\\d{2})"
_PHP_LOG = "(\\d{1,2})-([A-Za-z]{3})-(\\d{4})[ :](\\d{2}):(\\d{2}):(\\d{2})"
_SYSLOG = "^([A-Za-z]{3})\\s+(\\d{1,2})\\s+(\\d{2}):(\\d{2}):(\\d{2})"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def _time_in(text: Column) -> Column:
    part = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    i = lambda p, k: part(p, k).cast("int")
    month = lambda p, k: F.nullif(F.element_at(F.map_from_arrays(F.array(*[F.lit(m) for m in _MONTHS.split()]), F.array(*[F.lit(n) for n in range(1, 13)])), F.lower(part(p, k))), F.lit(0))
    make = F.try_make_timestamp_ntz
    return F.coalesce(
        make(i(_ISO, 1), i(_ISO, 2), i(_ISO, 3), i(_ISO, 4), i(_ISO, 5), i(_ISO, 6)),
        *(make(i(p, 3), month(p, 2), i(p, 1), i(p, 4), i(p, 5), i(p, 6)) for p in (_ACCESS_LOG, _PHP_LOG)),
        make(F.when(part(_SYSLOG, 1).isNotNull(), 1970), month(_SYSLOG, 1), i(_SYSLOG, 2), i(_SYSLOG, 3), i(_SYSLOG, 4), i(_SYSLOG, 5)),
    )


def stamp(line: Column | str) -> Column:
    """The wall-clock time a log line opens with, as a time without zone, or null.

    ISO, access log, bracketed PHP and syslog forms within the first 64 characters; of a line that is a JSON object
    anywhere in it. Syslog names no year; it is read as of 1970 and carried forward by the caller. Impossible dates give
    null.
    """
    t = _c(line)
    return F.when(t.rlike("\\d{2}:\\d{2}:\\d{2}"), F.coalesce(_time_in(F.substring(t, 1, 64)), F.when(is_object(t), _time_in(t))))


def is_object(line: Column | str) -> Column:
    """Is the line a JSON object? It opens a log entry of its own, with or without a time."""
    return F.ltrim(_c(line)).startswith("{")


def window_bound(value: str, anchor: str, end: bool = False) -> str | None:
    """A bound of a window of time as 'YYYY-MM-DD HH:MM:SS', from a date, a time or both; null if it is neither.

    A time alone is one of the anchor's date. A bound that ends a window runs to the end of its minute or day.
    """
    m = re.fullmatch(r"(?:(\d{4}-\d{2}-\d{2}))?\s*(?:(\d{1,2}):(\d{2})(?::(\d{2}))?)?", value.strip())
    if m is None or not (m.group(1) or m.group(2)):
        return None
    day = m.group(1) or anchor
    if not (1 <= int(day[5:7]) <= 12 and 1 <= int(day[8:10]) <= 31):
        return None
    last = "59" if end else "00"
    return f"{day} {int(m.group(2)):02d}:{m.group(3)}:{m.group(4) or last}" if m.group(2) else f"{day} {'23:59:59' if end else '00:00:00'}"


def bare_name(text: Column | str) -> Column:
    """Is the text one name, so that it can be looked up among the declarations?"""
    return _c(text).rlike("^[A-Za-z_][A-Za-z0-9_]+$")


#: What stands beside a file's name in a tree for its rank.
MARKERS = {"low": "·", "medium": "•", "high": "●", "critical": "⚠"}


def rank_marker(rank: Column | str) -> Column:
    """The sign of a rank, '?' for none."""
    out = F.lit("?")
    for name, sign in MARKERS.items():
        out = F.when(_c(rank) == name, sign).otherwise(out)
    return out


def confidence_label(confidence: Column | str) -> Column:
    c = _c(confidence)
    return F.when(c == 0, CONFIDENCE[0]).when(c == 1, CONFIDENCE[1]).when(c == 2, CONFIDENCE[2])


def format_time(stamp_: Column | str) -> Column:
    """A time to the minute, as listings show it."""
    return F.date_format(_c(stamp_), "yyyy-MM-dd HH:mm")
