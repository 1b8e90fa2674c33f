"""Files read by the Arrow function beside the same rules as expressions."""

import random

import pytest

from corpusmill.operators import declarations as D, reading

FRAGMENTS = (
    '"', "'", '"""', "'''", "`", "/*", "*/", "//", "#", "{", "}", "(", ")", "[", "]", ";", "\n", "\\", "\r\n", "\r", "@", "@A(1)", " class X {",
    "\nclass Y(B, c=1):\n", "type (", "\ntype T struct {\n", "import (", ")\n", "func (a *T) B(x int) {", "func F()", "/", " / ", "= /a[/]b/g", "\t",
    "    ", "é", " ", "\x85", "package a.b;", "package p\n", "import a.b;", "import x from 'y'", "from a import (b,\nc)", "interface I {",
    "enum E {A}", "record R(int a) {", "@interface Q {", "def f(a, b=1) -> int:\n", "async def g():\n", "extends A implements B<C,D>, E", "struct{}",
    "interface {}", "X, Y int\n", ",", "<T>", "=", "\U0001f600", "/** c */\n", "// c\n", "# c\n", "function q(a) {", "constructor(", "get z() {",
    "int a = 1, b;", "void f(int a) throws X {", "return /x/", "public static ", "'''doc'''\n", "\x01", "export default class W {", "if (a) {", "\x0b",
)
WHOLE = (
    ("a/Kiln.java", "package org.mill;\n/** Keeps\n * pots. */\n@Shelf(value = \"a{b\", /* why */ sizes = {1, 2})\nclass Kiln extends Oven implements A<B, C>, D {\n"
                    "  int a, b = f(1, 2);\n  void heat(Map<String, int[]> x) throws E { if (a > 0) { b++; } }\n  enum Kind { SOFT; Kind next() { return this; } }\n}\n"),
    ("p/a.go", "package p\nimport (\n\t\"os\"\n\tx \"y/z\"\n)\n// Oven it is.\ntype (\n\tA struct{}\n\tB interface { Go() }\n)\ntype D struct { X, Y int; z *A }\n"
               "func (a *A) One() {}\nfunc (w *Lost) Two() {}\nfunc main(n int) { }\n"),
    ("w/one.ts", "import a from 'b';\nexport class One extends Two implements I { a() { return /[{/]}/.test(x) } static async *b(x = {y: 1}): P<T> { } }\n@Dec({ a: [1] })\nclass T { constructor() {} }\n"),
    ("w/two.js", "const x = 1 / 2 / 3;\nfunction f(a, b) { return x; }\nasync function* g() { }\n"),
    ("a/far.py", "import os\n@known(\n  1,\n)\nclass Far(Base, metaclass=M):\n    r'''Doc \\''' more.'''\n    class In:\n        def go(self): pass\n    async def _out(self, a=(1,\n      2)) -> int: return a\ndef free(): pass\n"),
    ("f/loose.py", "def first():\n    return 1\ndef second(a, b=2):\n    return a * b"), ("x/forge.rb", "class Anvil\n  def strike(force); end\nend\ndef ring (x)\n"),
    ("x/calc.rs", "fn calc(x: i32) -> i32 { x }\n"), ("e/empty.py", ""), ("e/Empty.java", ""),
)


def odd_files(n: int, seed: int = 5):
    r = random.Random(seed)
    extensions = ("java", "py", "go", "js", "ts", "tsx", "rb")
    out = [*WHOLE, *WHOLE]
    for i in range(n):
        if i % 2:
            text = "".join(r.choice(FRAGMENTS) for _ in range(r.randrange(50)))
        else:
            whole = list(r.choice(WHOLE)[1])
            for _ in range(r.randrange(6)):
                at = r.randrange(len(whole) + 1)
                whole[at:at + r.choice((0, 0, 1, 3))] = [r.choice(FRAGMENTS)]
            text = "".join(whole)
        out.append((f"src/f{i}.{r.choice(extensions)}", text))
    return out


@pytest.mark.parametrize("table", D.Declared._fields)
def test_read_as_by_expressions(files, table):
    df = files(*odd_files(120))
    told = lambda t: sorted(map(repr, getattr(t, table).collect()))
    assert told(D.declarations(df)) == told(D.tables(D.resolve(D.declaring(df)))) == told(D.tables(D.resolved(df)))


def test_statements_are_no_arrays_of_the_plan(files):
    df = files(("a/A.java", "class A { int n; void f() { } }"))
    for table in (*D.declarations(df), D.resolved(df)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan


def test_rows_leave_in_pieces(spark, files, monkeypatch):
    monkeypatch.setattr(reading, "ROWS", 3)
    d = D.declarations(files(*[(f"a/A{i}.java", f"class A{i} {{ void f() {{ }} void g() {{ }} }}") for i in range(40)]))
    assert d.functions.count() == 80 and d.types.select("name").distinct().count() == 40


def test_a_file_without_text_declares_nothing(spark):
    df = spark.createDataFrame([("a.py", "python", None), ("b.py", None, "class B\n"), ("c.py", "python", "class C: pass\n")], "relative_path string, language string, content string")
    assert sorted(r.name for r in D.declarations(df).types.collect()) == ["B", "C"]


@pytest.mark.parametrize("limit", [6, 25, 60])
def test_cut_by_running_sums_as_by_pieces(files, limit):
    """The Arrow function beside expressions that measure every piece as a text."""
    from corpusmill.functions.tokens import TokenMeasure, word_symbol_measure
    from corpusmill.operators import chunking
    from corpusmill.options import Options

    by_line = word_symbol_measure()
    df = files(*odd_files(80, 7), ("t/twice.py", "class A:\n    def f(self): pass\n" * 9), ("t/twice.py", "class A:\n    def g(self): pass\n" * 9))
    spans = D.file_spans(df)
    joined = df.join(spans, "relative_path", "left").withColumn("spans", chunking.F.coalesce("spans", chunking.F.expr(chunking.NO_SPANS)))
    by_sums, by_pieces = (
        chunking.cut(joined, Options(max_tokens=limit, header_min_tokens=4, measure=m)).select(*chunking.CHUNK_COLUMNS)
        for m in (by_line, TokenMeasure(by_line.of_text, by_line.of_each))
    )
    assert sorted(map(repr, by_sums.collect())) == sorted(map(repr, by_pieces.collect()))
    assert "MapInArrow" in by_sums._jdf.queryExecution().optimizedPlan().toString()


def test_packages_are_guessed_as_by_expressions(spark):
    from corpusmill.functions import texts

    paths = ["a/b.py", "src/x.py", "src/a/x.py", "java/x", "a/java/src/b/c.go", "src/java/x.js", "src/src/a/b", "", "/", "lib//a/b", "x/lib/", "internal/a/pkg/b/c", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", texts.guess_package(D.F.col("p")).alias("g")).collect()
    assert [(r.p, reading.guess_package(r.p)) for r in got] == [(r.p, r.g) for r in got]


def test_spans_as_from_resolved_statements(files):
    df = files(*odd_files(80, 9))
    told = lambda d: sorted(map(repr, d.collect()))
    assert told(D.file_spans(df)) == told(D.spans(D.resolve(D.declaring(df)))) == told(D.spans(D.resolved(df)))
