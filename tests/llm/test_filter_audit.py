import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.filter_audit import COUNTS, Filter, audit, cells, failures, text_filters


def brute(rows, labels):
    """{(part, order, step): counts}, walking every document through every order."""
    least = {}
    for i, t, _ in rows:
        k = float("inf") if i is None else i
        least[t or ""] = min(least.get(t or "", k), k)
    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)
    out = {(p or "", "".join(o), s): dict.fromkeys(COUNTS, 0) for _, _, p in rows for o in permutations("ABCDE") for s in range(1, 6)}
    shapley = {}
    for i, t, p in rows:
        t, p = t or "", p or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(ws) < 50,
            "B": 100 * len(set(ws)) < 65 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": (float("inf") if i is None else i) > least[t],
        }
        good, toxic = marks.get(i, (False, False)) if i is not None else (False, False)
        for o in permutations("ABCDE"):
            gone = False
            for s, x in enumerate(o, 1):
                c = out[p, "".join(o), s]
                c["kept"] += not gone and not fails[x]
                c["removed"] += fails[x] and not gone
                c["redundant"] += fails[x] and gone
                c["unique_fails"] += fails[x] and sum(fails.values()) == 1
                c["good_lost"] += fails[x] and not gone and good
                c["toxic_lost"] += fails[x] and not gone and toxic
                shapley[p, x] = shapley.get((p, x), 0) + (fails[x] and not gone)
                gone = gone or fails[x]
    return {k: (*v.values(), shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(docs, labels):
    rows = audit(cells(failures(docs, text_filters(), "E"), labels), "ABCDE").collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*COUNTS, "shapley")) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows, columns: spark.createDataFrame(rows, columns).repartition(3)


def test_against_a_walk_of_every_document(table):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(200)] + ["Big", "CAPS", "a#", "50%"]
    texts = [" ".join(r.choice(vocab[: r.choice([20, 200, 204])]) for _ in range(r.choice([0, 3, 49, 50, 51, 120]))) for _ in range(90)]
    rows = [(i // 2, r.choice(texts), r.choice(["a", "b", None, ""])) for i in range(240)] + [(500, None, "a"), (501, "", "c"), (None, texts[0], "a"), (None, None, None)]
    labels = [(r.randrange(150), r.choice([0, 1, None]), r.choice([0, 1])) for _ in range(100)] + [(None, 1, 1)]
    docs = table(rows, "doc_id long, text string, source string")
    assert found(docs, table(labels, "doc_id long, quality int, toxic int")) == brute(rows, labels)


def test_a_hot_text_and_a_hot_part(table):
    rows = [(i, "one text that everyone has", "hot") for i in range(400)] + [(i, f"text {i}", "hot" if i % 3 else "cold") for i in range(400, 600)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 600, 5)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    docs = table(rows, "doc_id long, text string, source string")
    assert found(docs, table(labels, "doc_id long, quality int, toxic int")) == brute(rows, labels)


def test_other_filters_and_their_letters(table):
    docs = table([(1, "x", "p"), (2, "xy", "p"), (3, "x", "p")], "doc_id long, text string, source string")
    failed = failures(docs, [Filter("L", F.length("text") > 1), Filter("N", F.lit(None).cast("boolean"))], "R")
    assert {(r["id"], r["mask"]) for r in failed.collect()} == {(1, 0), (2, 1), (3, 4)}
    rows = audit(cells(failed, table([(2, 1, 0)], "doc_id long, quality int, toxic int")), "LNR").collect()
    assert len(rows) == 6 * 3 and {r["shapley"] for r in rows if r["filter_order"][r["step"] - 1] == "N"} == {0}
    with pytest.raises(ValueError):
        failures(docs, [Filter("R", F.lit(True))], "R")


def test_all_kinds_of_rows(hostile, nothing, table):
    labels = table([(1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in hostile.collect()]
    assert found(hostile, labels) == brute(rows, [(1, 1, 0), (7, 0, 1)])
    assert found(nothing, labels) == {}
    assert found(hostile, labels.limit(0)) == brute(rows, [])
