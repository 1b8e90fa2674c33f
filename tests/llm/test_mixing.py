import random
from bisect import bisect_right
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing
from corpusmill.llm.mixing import mix, mixed_documents


def wanted(sizes):
    """Targets by repeated sharing, the slow way; sizes by source in the order of code points, null last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / max(1, sum(weight[f] for f in free)) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return full | share
        full |= over


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    rows = [(i, " ".join("w" * r.randrange(0, 60)), r.choice(["a", "a", "a", "b", "c", "ü", None, "z"])) for i in range(400)]
    rows += [(1000, "x", "tiny"), (1001, "", "empty"), (1002, "y " * 5000, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_every_source_gets_its_target(corpus, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    m = mix(corpus, block=16)
    sizes = {r["source"]: r["source_size"] for r in m.sources.collect()}
    targets = {r["source"]: r["target"] for r in m.sources.collect()}
    assert targets == pytest.approx(wanted(sizes))
    taken = m.schedule.groupBy("_rank").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    goals = {r["_rank"]: r["goal"] for r in m.sources.collect() if r["goal"]}
    assert {r["_rank"]: r["n"] for r in taken.collect()} == goals
    by_row = m.schedule.groupBy("_row").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    assert m.rows.join(by_row, "_row").where("n > 3 * _size").count() == 0


def test_blocks_are_full_and_slots_interleave(corpus):
    m = mix(corpus, block=16)
    blocks = m.schedule.groupBy("slot", "_rank", "block").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()
    assert len({b["slot"] for b in blocks}) == len(blocks)
    last = {}
    for b in blocks:
        last[b["_rank"]] = max(last.get(b["_rank"], 0), b["block"])
    assert all(b["n"] == 16 for b in blocks if b["block"] < last[b["_rank"]])
    total = len(blocks)
    share = {r: sum(b["_rank"] == r for b in blocks) / total for r in last}
    for cut in (total // 4, total // 2):  # any stretch from the start has nearly the whole's shares
        head = [b for b in blocks if b["slot"] < cut]
        assert all(abs(sum(b["_rank"] == r for b in head) - share[r] * cut) <= 6 for r in share)


def test_reruns_agree_and_the_seed_matters(corpus):
    as_set = lambda m: {tuple(r) for r in m.rows.join(m.schedule, "_row").select("doc_id", "slot", "pass", "start", "end").collect()}
    first = as_set(mix(corpus))
    assert first == as_set(mix(corpus.repartition(5)))
    assert first != as_set(mix(corpus, seed=2))


def test_all_kinds_of_rows(hostile, nothing):
    m = mix(hostile)
    assert m.rows.count() == hostile.count()
    sizes = {r["source"]: r["source_size"] for r in m.sources.collect()}
    targets = {r["source"]: r["target"] for r in m.sources.collect()}
    assert targets == pytest.approx(wanted(sizes))
    out = mixed_documents(hostile)
    assert out.columns == hostile.columns
    assert mixed_documents(nothing).count() == 0
    assert mix(nothing).schedule.count() == 0


def test_any_number_of_sources(spark):
    """More sources than fit in a plan: each has its goal, and a slot's source is the one in whose stretch its point lies."""
    docs = spark.range(10_500).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 7 + if(id = 5, 9000, 0)))").alias("text"), F.format_string("s%05d", "id").alias("source"))
    m = mix(docs, block=4)
    sources = sorted(m.sources.collect(), key=lambda s: s["_rank"])
    assert len(sources) == 10_500
    slots = {r["slot"]: r["_rank"] for r in m.schedule.select("slot", "_rank").distinct().collect()}
    taken = {r["_rank"]: r["n"] for r in m.schedule.groupBy("_rank").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    assert taken == {s["_rank"]: s["goal"] for s in sources if s["goal"]}
    words, total = sum(s["goal"] for s in sources), sum(-(-s["goal"] // 4) for s in sources)
    ends = [x / words for x in accumulate(s["goal"] for s in sources)]
    for slot, rank in slots.items():
        if slot < total:
            assert rank == bisect_right(ends, (slot * mixing._GOLDEN % mixing._SPAN + 0.5) / mixing._SPAN)
