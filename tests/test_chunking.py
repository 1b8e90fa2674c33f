import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.tokens import encoder_measure, token_count
from corpusmill.operators import blocks, chunking, packing
from corpusmill.options import Options


def count(text):
    return max(len(re.findall(r"[^\W\d_]+|\d+|[^\s\w]|_", text)), 1 if text else 0)


def crate(n):
    """A Java class of ``n`` functions of two lines each, the first on line 6."""
    steps = "\n".join(f"  static int step{i}(int[] load)\n  {{ return load.length + {i}; }}" for i in range(n))
    return f"package depot;\n\n/** Steps. */\nfinal class Crate extends Box\n{{\n{steps}\n}}"


def test_token_count(spark):
    df = spark.createDataFrame([("Hello, world!", 4), ("", 0), (" \n ", 1), ("añb 12_x", 4)], "t string, n int")
    assert all(r[0] == r[1] for r in df.select("n", token_count(F.col("t"))).collect())


def test_small_file_is_one_chunk(files):
    (c,) = chunking.chunk(files(("depot/Lid.java", "final class Lid { }"))).collect()
    assert (c.chunk_id, c.class_names, c.token_count, c.level) == ("depot/Lid.java:full", ["Lid"], 5, "file")


def covered(code, rows):
    """Lines of a file that lie in some chunk, by their text in order."""
    return [x for r in rows for x in r.content.split("\n")]


def test_large_type_becomes_function_groups(files):
    code = crate(24)
    rows = sorted(chunking.chunk(files(("depot/Crate.java", code)), Options(max_tokens=150)).collect(), key=lambda r: r.ordinal)
    groups = [r for r in rows if r.level == "functions"]
    assert [n for r in groups for n in r.function_names] == [f"step{i}" for i in range(24)]
    assert groups[0].chunk_id == f"depot/Crate.java:Crate:step0-{groups[0].function_names[-1]}"
    lines = code.split("\n")
    fits = 150 // count("\n".join(lines[5:7]))
    assert len(groups[0].function_names) == fits and groups[0].content == "\n".join(lines[5 : 5 + 2 * fits])
    assert [x for x in covered(code, rows) if x.strip()] == [x for x in lines if x.strip()]


@pytest.mark.parametrize("path, code", [
    ("depot/lift.py", "import os\n\nSPEED = 3\n\nclass Lift(Base):\n    floors = 4\n" + "\n".join(f"    def to{i}(self, who):\n        self.go({i}, who)\n" for i in range(25)) + "\nprint(Lift())"),
    ("depot/ramp.go", "package depot\n\ntype Ramp struct { angle int }\n\nvar steep = 9\n" + "\n".join(f"func (r Ramp) Roll{i}(box int) int {{\n\treturn box * {i}\n}}" for i in range(25)) + "\nvar flat = 0"),
    ("depot/belt.js", "const speed = 2;\nclass Belt {\n" + "\n".join(f"  pass{i}(box) {{ return box + {i}; }}" for i in range(25)) + "\n}\nexport const belt = new Belt();"),
])
def test_every_line_lands_in_a_chunk(files, path, code):
    for limit in (25, 60, 150):
        rows = sorted(chunking.chunk(files((path, code)), Options(max_tokens=limit)).collect(), key=lambda r: r.ordinal)
        assert all(r.chunk_id.startswith(path) for r in rows) and len({r.chunk_id for r in rows}) == len(rows)
        assert [x for x in covered(code, rows) if x.strip()] == [x for x in code.split("\n") if x.strip()]


def test_oversize_function_is_cut_by_lines(files):
    body = "\n".join(f"        step{i}(a, b, c, {i});" for i in range(60))
    code = f"public class Big {{\n    void small() {{ }}\n    void huge(int a) {{\n{body}\n    }}\n}}\n"
    rows = sorted(chunking.chunk(files(("B.java", code)), Options(max_tokens=100)).collect(), key=lambda r: r.ordinal)
    assert [r.level for r in rows][:3] == ["rest", "functions", "function_part"]
    parts = [r for r in rows if r.level == "function_part"]
    assert "\n".join(p.content for p in parts) == "\n".join(code.split("\n")[2:64])
    assert [p.chunk_id for p in parts] == [f"B.java:Big:huge:f{i}" for i in range(len(parts))]
    assert all(p.token_count <= 100 for p in parts)


def test_line_chunks_equal_a_plain_walk(files):
    rng = random.Random(5)
    pairs = [(f"d{i}.json", "\n".join("w " * rng.choice([0, 1, 5, 40, 90]) for _ in range(rng.randrange(1, 60)))) for i in range(30)]
    rows = chunking.line_chunks(files(*pairs), Options(max_tokens=50)).collect()
    for path, text in pairs:
        bins, total = [], None
        for line in text.split("\n"):
            cost = count(line + "\n")
            if total is None or total + cost > 50:
                bins.append([])
                total = 0
            bins[-1].append(line)
            total += cost
        got = sorted((r for r in rows if r.relative_path == path), key=lambda r: r.ordinal)
        assert [r.content for r in got] == ["\n".join(b) for b in bins]


def test_pluggable_measure(files):
    o = Options(max_tokens=10, measure=encoder_measure(lambda t: list(t)))
    rows = sorted(chunking.chunk(files(("a.md", "12345\n6789\nabcdefghijklm\nz")), o).collect(), key=lambda r: r.ordinal)
    assert [(r.content, r.token_count) for r in rows] == [("12345", 6), ("6789", 5), ("abcdefghijklm", 14), ("z", 2)]


@pytest.mark.parametrize("seed, n, top, limit, groups, n_blocks", [
    (1, 400, 7, 20, 1, 7), (2, 900, 9, 9, 3, 13), (3, 900, 1, 50, 2, 16), (4, 900, 40, 20, 30, 5), (5, 20, 5, 1000, 1, 6), (6, 600, 1, 1, 1, 4),
])
def test_next_fit_over_blocks_equals_one_walk(spark, seed, n, top, limit, groups, n_blocks):
    rng = random.Random(seed)
    # One group holds most of the rows and so spans several blocks.
    rows = [(f"g{rng.randrange(groups)}" if rng.random() < 0.5 else "g0", i, rng.randint(0, top)) for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "i", "c"]))
    got = {r.i: r.pack for r in packing.next_fit(df, "c", limit, "g", ["i"], n_blocks).collect()}
    walks, expected = {}, {}
    for g, i, c in sorted(rows):
        cost = min(max(c, 1), limit + 1)
        total, first = walks.get(g, (None, None))
        walks[g] = (cost, (g, i)) if total is None or total + cost > limit else (total + cost, first)
        expected[i] = walks[g][1]
    assert len(got) == n
    packs = {(got[i], expected[i]) for i in got}
    assert len(packs) == len(set(got.values())) == len(set(expected.values()))


def test_batches_merge_small_chunks(files):
    pairs = [(f"C{i:02}.java", f"public class C{i} {{ public void m() {{}} }}") for i in range(20)] + [("D.java", "x " * 30)]
    o = Options(max_tokens=50, blocks=3)
    chunks = chunking.whole_file_chunks(files(*pairs), o)
    rows = sorted(chunking.batched(chunks, None, o).collect(), key=lambda r: r.relative_path)
    assert [f for r in rows for f in r.source_files] == [p for p, _ in pairs]
    assert rows[-1].chunk_id == "D.java:full" and rows[0].chunk_id == "batch_C00.java:full"
    assert rows[0].content.startswith("### File: C00.java\n### Language: java\n### Classes: C0\n---\npublic class C0 {")
    assert rows[0].members == 3 and rows[0].token_count == count(rows[0].content)


def test_numbering_and_prefix_sums(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.lpad("id", 4, "0")).alias("k"), (F.col("id") % 5).alias("v"))
    got = {r.k: (r.ordinal,) for r in blocks.numbered(df, ["k"], blocks=6).collect()}
    assert got == {f"k{i:04}": (i,) for i in range(500)}
    sums = {r.k: r.s for r in blocks.prefix_sum(df, F.col("v"), ["k"], "s", 6).collect()}
    total = 0
    for i in range(500):
        total += i % 5
        assert sums[f"k{i:04}"] == total


def test_lines_are_counted_once_for_all_pieces(files):
    from corpusmill.functions.tokens import WORD_SYMBOL_PATTERN
    from corpusmill.operators import chunking, declarations
    from corpusmill.options import Options

    table = files(("a/A.java", "class A {\n  void f() {\n    go(1, 2);\n  }\n\n  void g() { }\n}\n \n"))
    o = Options(max_tokens=6)
    spans = declarations.file_spans(table)
    chunks = chunking.cut(table.join(spans, "relative_path"), o)
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count(WORD_SYMBOL_PATTERN) == 1
    for c in chunks.collect():
        assert c["token_count"] == sum(max(1, n) for n in _counts(c)) or c["token_count"] == sum(_counts(c))


def _counts(chunk):
    import re

    return [len(re.findall(r"[^\W\d_]+|\d+|[^\s\w]|_", x)) for x in chunk["content"].split("\n")]
