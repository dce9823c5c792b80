from codeloam.llm.funcdoc import Source, function_pairs, pair, prose_words

JAVA = """﻿/* licence text that is long enough to be prose */\r
\r
public class A {\r
    /** Opens the file and reads it whole. */\r
    @Override\r
    public int open(String s) {\r
        String t = "} // not a comment {";\r
        return 1; // }\r
    }\r
\r
    // Never blocks, whatever the caller does.\r
\r
    int gap() { return 2; }\r
    /* one more comment above the header */\r
    int wrapped(\r
        int a,\r
        int b\r
    ) {\r
        return a;\r
    }\r
}\r
"""

PYTHON = '''# Never counted: a comment above a function.
def first(a, b):
    """Adds the two numbers and gives the sum."""
    return a + b


class K:
    def second(
        self,
        x,
    ):
        # a remark
        r\'\'\'Keeps order
        among equal values always.\'\'\'
        return x

    def third(self):
        x = 1
        """Not the first statement of this body."""

    def fourth(self): pass
'''


def found(text, language, *headers):
    ds = [{"header": h, "annotations": None} for h in headers]
    return {headers[k]: (code, len(prose_words(doc, headers[k].split("(")[0].split()[-1]))) for k, code, doc in pair(text, language, ds)}


def test_java():
    got = found(JAVA, "java", "public int open(String s) {", "int gap() { return 2; }", "int wrapped(\n    int a,\n    int b\n) {", "int absent() {")
    assert got["public int open(String s) {"][1] == 7 and got["public int open(String s) {"][0].endswith("return 1; // }\n    }")
    assert got["int gap() { return 2; }"][1] == 0
    assert got["int wrapped(\n    int a,\n    int b\n) {"][1] == 6
    assert "int absent() {" not in got


def test_python():
    got = found(PYTHON, "python", "def first(a, b):", "def second(\n    self,\n    x,\n):", "def third(self):", "def fourth(self): pass")
    assert [n for _, n in got.values()] == [8, 6, 0, 0]
    assert got["def first(a, b):"][0].endswith("return a + b")


def test_other_languages():
    assert found("# Gives back the whole list at once.\ndef list_all\n  x\nend\n\ndef other\nend", "ruby", "def list_all")["def list_all"] == ("def list_all\n  x\nend", 6)
    assert found("/// Sends the frame to every peer.\n#[inline]\nfn send(&self) {\n  let c = '{';\n}", "rust", "fn send(&self) {")["fn send(&self) {"][1] == 6
    assert found("// first part of it and\n/* the second part */\n#[Pure]\nfunction f() { }", "php", "function f() { }")["function f() { }"][1] == 8


def test_comment_in_a_string_is_no_comment():
    s = Source("const a = `\n// not a comment at all here\n`;\nfunction f() {\n}", "javascript")
    assert not any(s.comment)


def test_what_is_no_prose():
    none = ["TODO: write this down for the next release", "@param x the first of all values", ":param x: the first of all values", "eslint-disable-next-line no-unused-vars, no-shadow", "{@inheritDoc}", "x = call_something(y, z)", "return foo(bar);", "-----", "TBD", "noinspection PhpUnused", "rubocop:disable Metrics/AbcSize, Style/Documentation", "if (a > b) {", "for (x in xs)", "let x = 1", "from a import b", "a.b(c, d)", "#region helpers of the whole class"]
    for line in none:
        assert prose_words([f"// {line}"], "f") == [], line
    for line in ["region may wrap at most one engine", "if the locale is unknown; beyond that it waits", "Please verify the wrapper first;", "coverage of the file is kept", "for all values (at most ten) it waits"]:
        assert len(prose_words([f"// {line}"], "f")) >= 4, line
    assert len(prose_words(["/** Open the stream. */"], "openStream")) == 1
    assert len(prose_words(["// todo(me): describe", "// and go on here", "//", "// Real prose comes after that."], "f")) == 5


def test_tables(spark):
    files = spark.createDataFrame([("r", "a.py", None, PYTHON, 1), ("r", "a.py", None, PYTHON, 1), ("r", "b.py", "python", None, 1), ("r", "c.py", "python", "", 1), (None, "d.py", "python", PYTHON, 1)], "repo string, path string, language string, content string, idx int")
    rows = [("r", "a.py", 0, "first", "function", "def first(a, b):", None), ("r", "a.py", 0, "first", "function", "def first(a, b):", None), ("r", "a.py", 1, "third", "method", "def third(self):", []), ("r", "a.py", 2, "K", "class", "class K:", None), ("r", "b.py", 0, "f", "function", "def f():", None), ("r", "c.py", 0, "f", "function", "def f():", None), ("r", "a.py", None, "first", "function", "def first(a, b):", None), ("r", "a.py", 5, "first", "function", None, None)]
    decl = spark.createDataFrame(rows, "repo string, path string, idx int, name string, kind string, header string, annotations array<string>")
    got = function_pairs(files, decl).collect()
    assert [(r.path, r.idx, r.prose_words) for r in got] == [("a.py", 0, 8)]
    assert function_pairs(files.limit(0), decl).count() == 0 == function_pairs(files, decl.limit(0)).count()
    long_ = spark.createDataFrame([("r", "x.java", "java", "int x;\n" * 200_000 + "// A comment of five words.\nvoid f() {\n}")], "repo string, path string, language string, content string")
    one = spark.createDataFrame([("r", "x.java", 0, "f", "function", "void f() {", None)], decl.schema)
    assert function_pairs(long_, one, columns=["idx"]).count() == 1
