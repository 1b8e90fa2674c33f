import itertools

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import texts
from corpusmill.operators import rollups, routing
from corpusmill.options import Options

CASES = [
    ("src/A.java", "public class A {}", "source", None),
    ("src/A.py", "class A: pass", "source", None),
    ("cmd/main.go", "package main", "source", None),
    ("src/A.js", "class A {}", "source", None),
    ("src/A.TS", "class A {}", "source", None),
    ("pom.xml", "<root/>", "config", None),
    ("config.yaml", "key: value", "config", None),
    ("package.json", '{"key": 1}', "config", None),
    ("app.properties", "key=value", "config", None),
    ("schema.sql", "SELECT * FROM users;", "config", None),
    ("lib/x.rs", "fn main() {}", "config", None),
    ("noext", "text", "config", None),
    ("src/gen/Foo.java", "// Auto-generated by codegen. Do not edit.\nclass Foo {}", "skipped", "generated"),
    ("src/Late.java", "\n" * 10 + "// do not edit", "source", None),
    ("Foo.class", "PK", "skipped", "skip_extension"),
    ("yarn.lock", "@generated", "skipped", "skip_extension"),
    ("sub/Dockerfile", "FROM x", "skipped", "skip_filename"),
    ("web/tsconfig.json", "{}", "skipped", "skip_filename"),
    ("a.min.js", "x" * 6000, "skipped", "minified"),
    ("b.js", "x" * 5000, "source", None),
    ("c.js", "\x01\x02" * 40 + "abc", "skipped", "binary_content"),
    ("d.js", "\x01" * 30 + "a" * 70, "source", None),
    ("dir.d/file", "x", "config", None),
    ("e.py", "", "source", None),
]


def test_first_rule_gives_the_reason(files):
    routed = routing.route(files(*[(p, t) for p, t, _, _ in CASES]))
    got = {r.relative_path: (r.category, r.skip_reason) for r in routed.collect()}
    assert got == {p: (c, s) for p, _, c, s in CASES}


def test_not_source_or_config(files):
    # Known language, but an extension outside both lists.
    o = Options(source_extensions=(".py",))
    got = routing.route(files(("a.java", "class A {}")), o).first()
    assert (got.category, got.skip_reason) == ("skipped", "not_source_or_config")


def test_skip_counts_and_totals(files):
    routed = routing.route(files(*[(p, t) for p, t, _, _ in CASES]))
    counts = {r.skip_reason: r.files for r in rollups.skip_reasons(routed).collect()}
    assert counts == {"generated": 1, "skip_extension": 2, "skip_filename": 2, "minified": 1, "binary_content": 1}
    totals = {r.category: r.files for r in rollups.category_totals(routed).collect()}
    assert totals["total"] == len(CASES) == sum(v for k, v in totals.items() if k != "total")


@pytest.mark.parametrize("head, expected", [
    ("// Auto-generated code\nclass A {}", True), ("// Generated by protobuf", True),
    ("# This file is generated by setup.py", True), ("// @generated\n// DO NOT MODIFY", True),
    ("def hello():\n    return 'world'", False), ("", False),
])
def test_generated_markers(spark, head, expected):
    assert spark.createDataFrame([(head,)], "t string").select(texts.is_generated(F.col("t"))).first()[0] is expected


def slow_clean(text: str) -> str:
    kept, blanks = [], 0
    for line in text.split("\n"):
        blanks = 0 if line.strip() else blanks + 1
        if blanks <= 2:
            kept.append(line.rstrip())
    return "\n".join(kept)


def test_clean_text_equals_a_plain_walk_over_lines(spark):
    texts_ = ["".join(t) for n in range(8) for t in itertools.product("\na ", repeat=n)]
    texts_ += ["a\x1c\x1f\n\x85 \nb", "x 　\n\n\n\n\ny\t", "\n" * 9, " \n \n \n \n", "a" + "\n" * 400 + "b" + " " * 400]
    df = spark.createDataFrame([(t,) for t in texts_], "t string")
    for t, got, again in df.select("t", texts.clean_text(F.col("t")), texts.clean_text(texts.clean_text(F.col("t")))).collect():
        assert got == slow_clean(t) == again, repr(t)


def test_cleaned_recounts_source_rows_only(files):
    dirty = "a  \n\n\n\n\nb\n"
    rows = {r.relative_path: r for r in routing.cleaned(routing.route(files(("a.py", dirty), ("a.md", dirty)))).collect()}
    assert rows["a.py"].content == "a\n\n\nb\n" and rows["a.py"].line_count == 4 and rows["a.py"].size_bytes == len(dirty)
    assert rows["a.md"].content == dirty and rows["a.md"].line_count == 6 and rows["a.md"].clean_hash is None
    assert rows["a.py"].content_hash == rows["a.md"].content_hash


def test_path_functions(spark):
    rows = [("a.b/file", ".b/file", "unknown", ""), ("src/main/java/com/x/A.Java", ".java", "java", "com.x"),
            (".java", ".java", "unknown", ""), ("x/src/A.kt", ".kt", "java", ""), ("lib/a/b.jsx", ".jsx", "jsx", "a"),
            ("python/src/p/q.py", ".py", "python", "src.p"), ("noext", "", "unknown", ""), ("java/A.java", ".java", "java", "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string")
    got = df.select("p", texts.extension(F.col("p")), texts.language_of(F.col("p")), texts.guess_package(F.col("p"))).collect()
    assert [tuple(r) for r in got] == rows


def test_line_count_names_and_visibility(spark):
    df = spark.createDataFrame([("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1)], "t string, n long")
    assert all(r[0] == r[1] for r in df.select("n", texts.line_count(F.col("t"))).collect())
    names = spark.createDataFrame([("java", "class A{\n interface B extends C\nenum D(x)\n// class 9x of\nclass E class F")], "l string, t string")
    assert names.select(texts.class_names(F.col("t"), F.col("l"))).first()[0] == ["A", "B", "D", "E"]
    vis = spark.createDataFrame([(["private"], "a", False), (["public"], "_a", True), ([], "_a", False), ([], "a", True)], "m array<string>, n string, e boolean")
    assert all(r[0] == r[1] for r in vis.select("e", texts.is_public(F.col("m"), F.col("n"))).collect())


def test_cleaning_trims_a_text_once(spark):
    """The branches of clean_text share the trimmed text; the whole job spent most of its routing on making it again."""
    df = spark.createDataFrame([("a \nb\n\n\n\n\nc \n",), ("\n\n\n",), ("",), (None,)], "t string")
    cleaned = df.select(texts.clean_text(F.col("t")).alias("t"))
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?=\n|\z)") == 1
    assert [r.t for r in cleaned.collect()] == ["a\nb\n\n\nc\n", "\n", "", None]


def test_trimming_is_looked_for_at_line_feeds(spark):
    """Every blank before a line feed or at the end is found, and a text without one is what it was."""
    import re

    from corpusmill.functions import texts
    from pyspark.sql import functions as F

    blanks = "\t\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    given = [f"a{x}b\nc" for x in blanks] + [f"a{x}\nb" for x in blanks] + [f"a\nb{x}" for x in blanks] + ["", "\n", " ", " \n", "\n\n\n", "x", "a \n\n\n\n\nb"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    got = {r.t: r.c for r in df.select("t", texts.clean_text(F.col("t")).alias("c")).collect()}
    for t in given:
        want = re.sub(rf"[{blanks}]+(?=\n|\Z)", "", t)
        if "\n\n\n" not in want and want.strip("\n"):
            assert got[t] == want
    assert (got["\n\n\n"], got[" \n"], got[" "], got["a \n\n\n\n\nb"]) == ("\n", "\n", "", "a\n\n\nb")
    plan = df.select(texts.clean_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") >= 2


def test_paths_are_counted_without_their_texts(spark, monkeypatch):
    """Which paths repeat is told by the paths alone."""
    from corpusmill.sources import files as fs

    counted = []
    real = fs.cut_lineage
    monkeypatch.setattr(fs, "cut_lineage", lambda df: counted.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "w")], "relative_path string, content string")
    assert {(r.relative_path, r.content) for r in fs.distinct_paths(rows).select("relative_path", "content").collect()} <= {("a", "x"), ("a", "w"), ("b", "y")}
    assert "octet_length" not in counted[0]
