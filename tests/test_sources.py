import hashlib
import json

from pyspark.sql import functions as F

from corpusmill.options import Options
from corpusmill.plans import pipeline
from corpusmill.sources import files as fs
from corpusmill.sources import report as rp


def write(root, path, data):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan_files(spark, tmp_path):
    root = tmp_path / "my repo"
    kept = {
        "src/A.java": "class A {}\r\nx\ry\n", "pkg/__init__.py": "x = 1", "pkg/_private/mod.py": "y = 2\n",
        ".github/w.yml": "k: é", "README.md": "# r\n", "a/b/c/d.rs": "fn x() {}",
    }
    for p, t in kept.items():
        write(root, p, t)
    for p, t in {
        "node_modules/x.js": "a", "src/build/y.py": "b", ".git/z.json": "{}", "pkg/__pycache__/q.py": "c", "_a/vendor/r.go": "d",
        "empty.py": "", "big.py": "x" * 600, "bad.py": b"\xff\xfe\xfa", "_bad.py": b"\xc3\x28", "photo.png": "p", "UPPER.PY": "u",
    }.items():
        write(root, p, t)
    o = Options(max_file_bytes=500)
    shown = {r.relative_path for r in fs.scan_files(spark, str(root), o).collect()}
    assert shown == {p for p in kept if not any(x.startswith(("_", ".")) for x in p.split("/"))}
    listed = [(f"file://{p}", p.stat().st_size) for p in root.rglob("*") if p.is_file()]
    rows = {r.relative_path: r for r in fs.scan_inventory(spark.createDataFrame(listed, "path string, length long"), str(root), o, 100).collect()}
    assert set(rows) - {"UPPER.PY"} == set(kept)
    assert rows["src/A.java"].content == "class A {}\nx\ny\n" and rows["src/A.java"].line_count == 3
    assert rows["src/A.java"].size_bytes == len(kept["src/A.java"])
    assert rows[".github/w.yml"].language == "unknown" and rows[".github/w.yml"].size_bytes == 5
    assert rows["pkg/__init__.py"].language == "python"


def test_scan_pushes_the_size_filter(spark, tmp_path):
    write(tmp_path, "a.py", "x")
    shown = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length", "content")
    plan = fs.eligible(shown, str(tmp_path), Options(max_file_bytes=500_000))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(length,1)" in plan and "LessThanOrEqual(length,500000)" in plan


def test_distinct_paths_and_directories(files):
    df = files(("a/x.py", "1"), ("a/x.py", "1"), ("a/build/x.py", "2"), ("builds/x.py", "3"))
    assert sorted(r.relative_path for r in fs.exclude_dirs(fs.distinct_paths(df)).collect()) == ["a/x.py", "builds/x.py"]
    assert [r.relative_path for r in fs.ordered(fs.distinct_paths(df)).collect()] == ["a/build/x.py", "a/x.py", "builds/x.py"]


def test_whole_job_and_report(spark, files, tmp_path):
    df = files(
        ("src/main/java/com/é/A.java", "package com.shop;\npublic class AController {\n  void m() { if (x) { } }\n}\n"),
        ("tool.py", "def f(a):\n    return a\n"), ("pom.xml", "<x/>"), ("x.png", "p"),
    )
    a = pipeline.analyse_corpus(df, str(tmp_path / "store"))
    s = a.summary.first()
    assert (s.total_discovered, s.source_files, s.config_files, s.skipped, s.total_lines, s.chunks, s.batches, s.calls) == (4, 2, 1, 1, 6, 2, 1, 0)
    assert (s.languages, s.skip_reasons) == ({"java": 1, "python": 1}, {"skip_extension": 1})
    m = a.metrics.first()
    assert (m.total_files, m.total_classes, m.total_functions) == (2, 2, 2)
    rp.write_report(pipeline.report(a, {"codebase": "t"}), str(tmp_path / "out"), pipeline.report_tables(a))
    (part,) = (p for p in (tmp_path / "out" / "report").glob("part-*") if p.stat().st_size)
    text = part.read_text()
    doc = json.loads(text)
    assert text.isascii() and text.count("\n") > 10
    assert doc["_metadata"]["source_files"] == 2 and doc["_pipeline"] == {"codebase": "t"}
    assert doc["key_classes"][0]["name"] == "AController" and doc["key_classes"][0]["methods"][0]["name"] == "m"
    assert spark.read.json(str(tmp_path / "out" / "file_scores")).count() == 2


def test_paths_that_repeat_are_one_file(spark, files):
    df = files(("a.py", "x = 1"), ("a.py", "y = 2"), ("a.py", "x = 1"), ("b.py", "z = 3"))
    kept = [sorted((r.relative_path, r.content) for r in fs.usable(d, Options()).collect()) for d in (df, df.repartition(4), df.orderBy(F.desc("content")))]
    assert len(kept[0]) == 2 and kept[0] == kept[1] == kept[2]


def test_repeated_paths_are_dealt_to_tasks_by_their_bytes(spark, monkeypatch):
    """More bytes under repeated paths make more tasks, and a path with more than a task's bytes is right as well."""
    monkeypatch.setattr(fs, "TASK_BYTES", 400)
    rows = [(f"p{k % 60}", f"text {k // 60} of {k % 60} " + "x" * 20) for k in range(180)]
    rows += [("heavy", f"heavy {k} " + "y" * 50) for k in range(40)] + [(None, "a"), (None, "b"), ("single", "s"), ("equal", "e"), ("equal", "e")]
    df = spark.createDataFrame(rows, "relative_path string, content string").withColumn("size_bytes", F.octet_length("content"))
    out = fs.distinct_paths(df)
    best = {}
    for p, t in rows:
        key = hashlib.sha256(t.encode()).hexdigest()
        best[p] = min(best.get(p, (key, t)), (key, t))
    assert sorted((r.relative_path or "", r.content) for r in out.collect()) == sorted((p or "", t) for p, (_, t) in best.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [relative_path#" in plan
