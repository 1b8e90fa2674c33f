import json
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.jsonfix import parse_typed, repair_json
from corpusmill.operators import chunking, inference, rollups
from corpusmill.operators.inference import admit
from corpusmill.options import Options
from corpusmill.sources import store as st

REPAIRS = [
    ('{"a": 1}', {"a": 1}),
    ('  ```json\n{"a": 1}\n```', {"a": 1}),
    ('Here:\n```\n{"a": [1, 2,], }\n```\nbye', {"a": [1, 2]}),
    ('{"a": 1, // note\n "b": 2}', {"a": 1, "b": 2}),
    ('text {"a": {"b": 1}} more', {"a": {"b": 1}}),
    ('{"a": {"b": 1', {"a": {"b": 1}}),
    ('{"u": "http://x/y"}', {"u": "http://x/y"}),
    ("", None), ("nothing", None), (None, None), ("[1, 2]", None), ("7", None), ("null", None),
    ('{"a": 1} {"b": 2}', None), ("{}", {}),
    ('{"u": "http://x/y", "v": "a,]", }', {"u": "http://x/y", "v": "a,]"}),
    ('so: {"a": "x // y", // note, with } and ]\n "b": [1, /* two */ 2,],}', {"a": "x // y", "b": [1, 2]}),
    ('{"a": "say \\"hi, }\\"", "b": ["open', {"a": 'say "hi, }"', "b": ["open"]}),
    ('use {x} here: {"a": 2}!', {"a": 2}),
]


def test_repair_json(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPAIRS)], "i int, raw string")
    got = {r.i: r.j for r in df.select("i", repair_json(F.col("raw")).alias("j")).collect()}
    for i, (raw, expected) in enumerate(REPAIRS):
        assert (None if got[i] is None else json.loads(got[i])) == expected, raw


def test_parse_typed_defaults_extras_and_quoted_numbers(spark):
    rows = [('{"complexity_score": "7", "extra": 1, "key_methods": [{"name": "m", "complexity": 3.0}]}', 7, False, [("m", 3)]),
            ('{"summary": "s"}', 0, False, []), ('{"complexity_score": "high"}', 0, True, [])]
    df = spark.createDataFrame([(r[0],) for r in rows], "j string").select(parse_typed(F.col("j")).alias("a")).select("a.*")
    for got, (_, score, corrupt, methods) in zip(df.collect(), rows):
        assert (got.complexity_score, got._corrupt, [(m["name"], m["complexity"]) for m in got.key_methods]) == (score, corrupt, methods)
        assert got.file_path == "" and got.dependencies == []


@pytest.fixture
def answer():
    def by_text(system, user):  # nested, so that it travels to the workers by value
        if "fail" in user:
            raise ValueError("refused")
        return "prose only" if "prose" in user else '```json\n{"complexity_score": 4,}\n```'

    return by_text


@pytest.fixture
def chunks(files):
    return chunking.whole_file_chunks(files(("a.py", "x = 1"), ("b.py", "fail"), ("c.py", "prose"), ("d.py", "y = 2")))


def statuses(df):
    return {r.relative_path: (r.status, r.error) for r in df.collect()}


def test_second_run_answers_from_the_store(spark, chunks, answer, tmp_path):
    path = str(tmp_path / "store")
    first = statuses(inference.analyse(chunks, path, answer))
    assert first == {"a.py": ("fresh", None), "b.py": ("error", "refused"), "c.py": ("error", "parse failed"), "d.py": ("fresh", None)}
    second = inference.analyse(chunks, path, answer)
    assert statuses(second) == {**first, "a.py": ("cached", None), "d.py": ("cached", None)}
    typed = inference.typed_analyses(second)
    assert {(r.file_path, r.complexity_score) for r in typed.collect()} == {("a.py", 4), ("d.py", 4)}


def test_budget_is_a_prefix_of_the_order(spark, chunks, answer, tmp_path):
    o = Options(max_cost=Decimal("0.00002"), blocks=2)
    got = statuses(inference.analyse(chunks, str(tmp_path / "s"), answer, o))
    refused = [p for p, (_, e) in sorted(got.items()) if e == "budget exceeded"]
    assert refused and refused == sorted(got)[-len(refused):]


def test_admission_is_strict(spark):
    df = spark.createDataFrame([(i, Decimal(1)) for i in range(10)], "i int, c decimal(24,10)")
    got = inference.admit(df, F.col("c"), Decimal(4), ["i"], blocks=3)
    assert {r.i for r in got.filter("admitted").collect()} == {0, 1, 2}


def test_store_newest_wins_and_unreadable_is_a_miss(spark, tmp_path):
    path = str(tmp_path / "store")
    assert st.read_store(spark, path).count() == 0
    for payload in ('{"v":1}', '{"v":2}', "{}"):
        st.append_store(spark.createDataFrame([("k", payload), ("z", "{cut")], "cache_key string, payload string"), path)
    assert [(r.cache_key, r.payload) for r in st.read_store(spark, path).collect()] == [("k", '{"v":2}')]


def test_empty_payload_is_a_miss(spark):
    keyed = spark.createDataFrame([("k",), ("e",), ("m",)], "cache_key string")
    store = spark.createDataFrame([("k", '{"a":1}'), ("e", "{ }")], "cache_key string, payload string")
    looked = inference.lookup(keyed, store)
    assert inference.cache_stats(looked).first().asDict() == {"hits": 1, "misses": 2, "hit_rate": "33%"}
    assert {r.cache_key for r in inference.misses(keyed, store).collect()} == {"e", "m"}


def test_every_text_has_its_contexts(spark):
    df = spark.createDataFrame([(i, "x" * (i % 5 * 9)) for i in range(20)], "i int, t string")
    got = {r.i: (r.first_context, r.last_context) for r in inference.context_numbers(df, "t", 20, ["i"], blocks=3).collect()}
    at = 0
    for i in range(20):
        n = i % 5 * 9 + 1
        assert got[i] == (at // 20, (at + n - 1) // 20)
        at += n


def test_without_a_function_misses_are_missing(spark, chunks, tmp_path):
    got = inference.analyse(chunks, str(tmp_path / "none"))
    assert statuses(got) == {p: ("missing", None) for p in ("a.py", "b.py", "c.py", "d.py")}
    assert all(r.est_tokens > 0 for r in got.collect())


def test_another_version_finds_nothing(spark, chunks, answer, tmp_path):
    path = str(tmp_path / "store")
    inference.analyse(chunks, path, answer, version=("m1",)).collect()
    assert statuses(inference.analyse(chunks, path, version=("m1",)))["a.py"][0] == "cached"
    assert statuses(inference.analyse(chunks, path, version=("m2",)))["a.py"][0] == "missing"


def test_branch_scores(files):
    code = "class A {\n" + "if (Foo.x() && y) { }\n" * 20 + "iff = elseif; } // été_if \u00e9for"
    row = rollups.branch_scores(files(("A.java", code))).first()
    assert (row.branches, row.score) == (40, 14)


def test_a_store_of_many_runs(spark, tmp_path):
    """Its files are bounded, its newest entries stay, and a compaction that is lost on the way changes nothing."""
    path = str(tmp_path / "store")
    schema = "cache_key string, payload string"
    content = lambda: {r.cache_key: r.payload for r in st.read_store(spark, path).collect()}
    most = 0
    for run in range(14):
        st.append_store(spark.createDataFrame([(f"a{run % 3}", f'{{"v":{run}}}'), (f"b{run}", "{}"), ("zz", "{cut")], schema).coalesce(1), path, runs=4)
        most = max(most, len(list((tmp_path / "store").rglob("*.parquet"))))
    assert content() == {"a0": '{"v":12}', "a1": '{"v":13}', "a2": '{"v":11}'} and most < 40
    before = st.manifest(spark, path)
    other = st.next_slot(before.slot)
    st._write(spark.createDataFrame([("a0", "{}")], schema).withColumn("written_at", F.current_timestamp()), st.folder(path, other), "overwrite")
    assert st.manifest(spark, path) == before and content()["a0"] == '{"v":12}'
    st.compact_store(spark, path)
    assert st.manifest(spark, path).slot == other and content() == {"a0": '{"v":12}', "a1": '{"v":13}', "a2": '{"v":11}'}


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from corpusmill.operators.inference import infer
spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000").getOrCreate())
folder = {folder!r}

def fn(system, user):
    with open(folder + "/calls", "a") as f:
        f.write(user + "\\n")
    if user == "u40" and not os.path.exists(folder + "/died"):
        open(folder + "/died", "w").close()
        os._exit(1)
    return "answer to " + user

rows = spark.range(60).selectExpr("concat('k', id) as cache_key", "'s' as system", "concat('u', id) as user").coalesce(1)
got = {{r.cache_key: r.raw for r in infer(rows, fn, ["cache_key"], folder + "/log").collect()}}
assert got == {{f"k{{i}}": f"answer to u{{i}}" for i in range(60)}}, got
"""


def test_a_task_that_dies_doesn_t_ask_again(tmp_path):
    """The worker dies at the 41st call: the task that is run again asks only for what it hadn't logged."""
    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", KILLED.format(root=root, folder=str(tmp_path))], check=True, timeout=300, capture_output=True)
    calls = (tmp_path / "calls").read_text().split()
    assert (tmp_path / "died").exists() and 61 <= len(calls) <= 60 + 16


def test_ceilings_of_groups(spark):
    """Sums begin anew in each group, also where a group spreads over many blocks."""
    rows = [(f"g{0 if i % 3 else i % 7}", i, 1) for i in range(400)] + [(None, i, 1) for i in range(400, 420)]
    df = spark.createDataFrame(rows, "g string, i int, cost int").repartition(4)
    ceiling = F.when(F.col("g") == "g0", F.lit(50)).when(F.col("g").isNotNull(), F.lit(3)).when(F.col("i") < 410, F.lit(5))
    got = {(r.g, r.i): r.admitted for r in admit(df, F.col("cost"), ceiling, ["i"], blocks=6, group_key="g").collect()}
    so_far = {}
    for g, i, _ in sorted(rows, key=lambda r: r[1]):
        so_far[g] = so_far.get(g, 0) + 1
        limit = 50 if g == "g0" else 3 if g else 5 if i < 410 else None
        assert got[g, i] == (limit is None or so_far[g] < limit)
