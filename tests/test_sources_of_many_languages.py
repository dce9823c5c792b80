import pytest

from codeloam.functions.lexing import Bare, scan
from codeloam.operators import declare, modules as M
from codeloam.operators.extract import extracted, measured, relation

#: (language, text, head, last line of what it opens): strings, comments and patterns hold what would end it.
ENDS = [
    ("python", 'def f():\n    x = """\ntext at column 0\n"""\n    return x\n\ndef g():\n    pass\n', "def f():", 4),
    ("python", "def f(a,\n      b):\n    return (a,\nb)\n\n# c\ndef g():\n  pass\n", "def f(a,\n      b):", 3),
    ("ruby", "def f\n  x = <<~EOS\nend\n  EOS\n  x\nend\n\ndef g\nend\n", "def f", 5),
    ("ruby", 'def f\n  s = "#{a["}"]} end"\n  y = 1 if x\n  z = if q\n    1\n  end\n  while a do\n    b\n  end\n  l.each do |x|\n  end\nend\ndef g\nend\n', "def f", 11),
    ("ruby", "def f(module)\n  module = 1\n  %w[end if]\nend\n", "def f(module)", 3),
    ("lua", "function f()\n  local s = [[\nend\n]]\n  if x then\n  end\n  return s\nend\nfunction g()\nend\n", "function f()", 7),
    ("rust", "fn f() {\n  /* a /* } */ } */\n  let c = '}';\n  let r = r#\"}\"#;\n  g::<'a>(x)\n}\nfn g() {\n}\n", "fn f() {", 5),
    ("bash", 'f() {\n  cat <<EOF\n}\nEOF\n  echo "${x#y}" # }\n}\ng() {\n}\n', "f() {", 5),
    ("javascript", "function f() {\n  const r = /[{]\\/{/;\n  return `a ${g({x: `}`})} {`;\n}\nfunction g() {\n}\n", "function f() {", 3),
    ("php", "<?php\nfunction f() {\n  $x = <<<EOT\n  { {\n  EOT;\n  return $x;\n}\nfunction g() {\n}\n", "function f() {", 6),
    ("java", 'int f(\n  int a\n) {\n  String s = """\n  }\n  """;\n  char c = \'}\';\n}\nint g() {\n}\n', "int f(\n  int a\n) {", 7),
    ("go", "func f(a struct{ x int }) (r struct{ y int }) {\n\tx := `}`\n}\nfunc g() {\n}\n", "func f(a struct{ x int }) (r struct{ y int }) {", 2),
    ("typescript", "f(a: { x: number } = {}): { y: number } {\n  return a;\n}\ng() {\n}\n", "f(a: { x: number } = {}): { y: number } {", 2),
    ("c", "int f(void);\nint g(void) {\n  return 1;\n}\n", "int f(void);", 0),
]


@pytest.mark.parametrize("language, text, head, last", ENDS)
def test_ends(language, text, head, last):
    first = next(i for i, x in enumerate(text.split("\n")) if x == head.split("\n")[0])
    assert Bare(text, language).end(first, head.count("\n") + 1) == last


def test_scanner_stops_nowhere():
    for language in ("python", "ruby", "bash", "lua", "php", "go", "rust", "java", "c", "javascript", "unknown"):
        for text in ("", '"', "'", "`${", "/*", "<<EOS\n", '"""', "%w[", "r#\"", "[[", "#", "\\", "x" * 10):
            comments, strings = scan(text, language)
            assert all(0 <= a <= b <= len(text) for a, b in comments + strings)


SOURCES = {
    "a.ts": ("export class A {\n  @bound\n  private go(x: number): void {\n    if (x && y) {\n      b.run();\n    }\n  }\n}\nfunction f() {}\nexport const g = async (a) => a;\nimport { one as two, three } from './b';\nimport four from 'c';\n", [("A", "class", None, 4), ("go", "method", "A", 0), ("f", "function", None, 0), ("g", "function", None, 4)], [("./b", "one"), ("./b", "three"), ("c", "four")]),
    "a.php": ("<?php\nuse A\\B\\C;\nuse D\\{E, F as G};\nclass K extends L {\n  protected function m() { return $this->n(); }\n}\n", [("K", "class", None, 4), ("m", "method", "K", 1)], [("A\\B", "C"), ("D", "E"), ("D", "F")]),
    "a.go": ('package a\nimport (\n\t"x/y"\n\t"z"\n)\ntype S struct {\n\ta int\n}\nfunc (s *S) Up() {}\nfunc low() {}\n', [("S", "struct", None, 4), ("Up", "method", "S", 4), ("low", "function", None, 2)], [("x/y", "y"), ("z", "z")]),
    "a.rs": ("use crate::a::{b, c::D};\npub struct S;\nimpl S {\n    pub(crate) fn m(&self) {}\n}\nfn f() { S::m(); }\n", [("S", "struct", None, 4), ("S", "impl", None, 4), ("m", "method", "S", 2), ("f", "function", None, 0)], [("crate::a", "b"), ("crate::a::c", "D")]),
    "a.java": ("import a.b.C;\nimport d.*;\npublic class K {\n  int n;\n  K() {}\n  protected int m(int a) {\n    return a > 1 ? 2 : 3;\n  }\n}\n", [("K", "class", None, 4), ("K", "method", "K", 2), ("m", "method", "K", 1)], [("a.b", "C"), ("d", None)]),
    "a.rb": ("require 'x/y'\nmodule M\n  class K\n    def a\n    end\n    private\n    def b\n    end\n  end\nend\ndef c; end\n", [("M", "module", None, 4), ("K", "class", "M", 4), ("a", "method", "K", 4), ("b", "method", "K", 1), ("c", "function", None, 4)], [("x/y", None)]),
    "a.c": ('#include <stdio.h>\n#include "b.h"\nstruct P {\n  int x;\n};\nstatic int f(int a) {\n  return a ? 1 : 0;\n}\nint g(void);\n', [("P", "struct", None, 4), ("f", "function", None, 0)], [("stdio.h", None), ("b.h", None)]),
    "a.lua": ("local m = require 'q'\nlocal function f() end\nfunction m.g()\n  if x then end\nend\n", [("f", "function", None, 0), ("g", "function", "m", 4)], [("q", None)]),
    "a.sh": ("source ./lib.sh\nf() {\n  if true; then echo; fi\n}\n", [("f", "function", None, 4)], [("./lib.sh", None)]),
}


def test_declarations_and_imports(spark):
    df = spark.createDataFrame([(p, t, None) for p, (t, _, _) in SOURCES.items()] + [("n.ts", None, None), ("e.ts", "", None)], "path string, content string, language string")
    got = extracted(df, ["path"], language="language", path="path").collect()
    for r in got:
        _, declared, imported = SOURCES.get(r.path, ("", [], []))
        assert [(d.name, d.kind, d.container, d.visibility) for d in r.declarations] == declared, r.path
        assert [(i.module, i.symbol) for i in r.imports] == imported, r.path
    functions = {(r.path, r.name): r.complexity for r in relation(extracted(df, ["path"], language="language", path="path"), ["path"], "functions").collect()}
    assert functions["a.ts", "A::go"] == 3 and functions["a.java", "K::m"] == 2 and functions["a.lua", "m::g"] == 2 and functions["a.c", "f"] == 2
    shapes = {(r.path, r.name): (r.shape, r.receiver) for r in relation(extracted(df, ["path"], language="language", path="path"), ["path"], "references").collect()}
    assert shapes["a.ts", "run"] == ("Member", "b") and shapes["a.rs", "m"] == ("Static", "S") and shapes["a.php", "n"] == ("Member", "$this")
    lines = {r.path: (r.lines, r.code) for r in measured(df, ["path"]).collect()}
    assert lines["e.ts"] == (0, 0) and lines["a.c"] == (9, 9)
    assert declare.measure("// a\n\nint x; // b\n", "c") == {"lines": 3, "code": 1, "complexity": 0}


def test_imports_to_files(spark):
    files = [("r", p, lang) for p, lang in (("app/a.py", "python"), ("app/b.py", "python"), ("app/sub/__init__.py", "python"), ("lib/x.ts", "typescript"), ("lib/y/index.ts", "typescript"), ("lib/App/Model/User.php", "php"), ("src/geo/point.rs", "rust"), ("src/main.rs", "rust"), ("one/util.rb", "ruby"), ("two/util.rb", "ruby"), ("k/Deep.java", "java"), ("k/Use.java", "java"))]
    imports = [
        ("r", "app/a.py", "python", ".b", "f"), ("r", "app/a.py", "python", "app", "sub"), ("r", "app/sub/__init__.py", "python", "..b", None), ("r", "app/a.py", "python", "....z", None), ("r", "lib/x.ts", "typescript", "./y", "t"),
        ("r", "lib/y/index.ts", "typescript", "../x", None), ("r", "lib/x.ts", "typescript", "react", None), ("r", "src/x.php", "php", "App\\Model", "User"), ("r", "src/main.rs", "rust", "crate::geo::point", "Point"),
        ("r", "z.rb", "ruby", "util", None), ("r", "k/Use.java", "java", "no.such", "Deep"), ("r", "k/Use.java", "java", None, "Deep"), ("r", "k/Use.java", None, "k", "Deep"),
    ]
    declared = [("r", "app/b.py", "python", "f"), ("r", "k/Deep.java", "java", "Deep"), ("r", "src/geo/point.rs", "rust", "Point"), ("r", "x.go", "go", "f")]
    got = M.resolved(spark.createDataFrame(imports + imports[:2], "repo string, path string, language string, module string, symbol string"), spark.createDataFrame(files, "repo string, path string, language string"), spark.createDataFrame(declared, "repo string, path string, language string, name string"))
    found = {(r.path, r.module, r.symbol, r.target_path): (r.confidence, r.named) for r in got.collect()}
    assert found == {
        ("app/a.py", ".b", "f", "app/b.py"): (0, "f"), ("app/a.py", "app", "sub", "app/sub/__init__.py"): (0, None), ("app/sub/__init__.py", "..b", None, "app/b.py"): (0, None), ("lib/x.ts", "./y", "t", "lib/y/index.ts"): (0, None),
        ("lib/y/index.ts", "../x", None, "lib/x.ts"): (0, None), ("src/x.php", "App\\Model", "User", "lib/App/Model/User.php"): (0, None), ("src/main.rs", "crate::geo::point", "Point", "src/geo/point.rs"): (0, "Point"),
        ("z.rb", "util", None, "one/util.rb"): (2, None), ("z.rb", "util", None, "two/util.rb"): (2, None), ("k/Use.java", "no.such", "Deep", "k/Deep.java"): (1, "Deep"),
    }
