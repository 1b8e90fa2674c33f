import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm.queries import op10_multiple_instance, table
from corpusmill.llm.toxicity import fit, score_text, toxicity, train, with_labels

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of clean sentences; the toxic ones have one sentence with a bad word somewhere."""
    r = random.Random(6)
    clean = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        sentences = [" ".join(r.sample(clean, 6)) for _ in range(r.randrange(1, 30))]
        toxic = i % 6 == 0
        if toxic:
            k = r.randrange(len(sentences))
            sentences[k] += " " + r.choice(["scumbag", "moron", "trashy"])
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)


def test_document_labels_find_the_sentence(planted):
    model = train(planted.where("doc_id < 400"))
    found = toxicity(planted, model).where("doc_id >= 400").collect()
    assert all((x["tox"]["score"] >= 0.5) == bool(x["toxic"]) for x in found)
    for x in found:
        pieces = [x["text"][s["start"] : s["end"]] for s in x["tox"]["sentences"]]
        bad = [p.strip() for p in x["text"].split(".") if any(w in p for w in ("scumbag", "moron", "trashy"))]
        assert [p.strip() for p in pieces] == bad


def test_noisy_or_of_sentences():
    model = {"bias": 0.0, "leak": 0.1, "weights": {"bad": 1.0}}
    p = 1 / (1 + 2.718281828459045**-1)
    assert score_text("bad. fine. bad", model)[0] == pytest.approx(1 - 0.9 * (1 - p) ** 2)
    assert score_text("", model) == (pytest.approx(0.1), [])


def likelihood(x, docs, y, silent):
    """Mean log-likelihood of documents under the noisy-or, document by document; x: weights, bias, leak's log odds."""
    leak = 1 / (1 + math.exp(-x[-1]))
    total = silent[0] * math.log(1 - leak) + silent[1] * math.log(leak)
    for bags, label in zip(docs, y, strict=True):
        clean = 1 - leak
        for bag in bags:
            clean *= 1 - 1 / (1 + math.exp(-(x[-2] + sum(x[w] for w in bag))))
        total += math.log(1 - clean) if label else math.log(clean)
    return total / (len(docs) + sum(silent))


def test_the_fit_is_the_likelihoods_maximum():
    """Nothing near the fitted numbers is likelier, by a plain count of the documents."""
    r = random.Random(2)
    docs = [[sorted(r.sample(range(4), r.randrange(1, 4))) for _ in range(r.randrange(1, 5))] for _ in range(150)]
    y = [int(any((0 in bag) or (r.random() < 0.15) for bag in bags) and r.random() < 0.9) for bags in docs]
    silent = [40, 3]
    model = fit(docs, np.array(y, float), silent, list("abcd"), steps=3000, decay=0.0)
    x = [*(model["weights"][w] for w in "abcd"), model["bias"], math.log(model["leak"] / (1 - model["leak"]))]
    best = likelihood(x, docs, y, silent)
    for k in range(len(x)):
        for step in (0.2, -0.2):
            assert likelihood([v + step * (i == k) for i, v in enumerate(x)], docs, y, silent) < best + 1e-5


def test_scores_of_a_whole_table_against_plain_python(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    model = train(with_labels(docs, labels, F.expr("true")))
    for r in toxicity(docs.select("doc_id", "text"), model).collect():
        clean = 1 - model["leak"]
        for piece in re.split(r"[.!?\n。！？]+", r["text"] or ""):
            words = set(re.findall(r"\w+", piece.lower()))
            known = [w for w in words | {w[:5] + "-" for w in words if len(w) > 5} if w in model["weights"]]
            if known:
                clean *= 1 - 1 / (1 + math.exp(-(model["bias"] + sum(model["weights"][w] for w in known))))
        assert r["tox"]["score"] == pytest.approx(1 - clean, abs=1e-9)


def test_held_out_accuracy(spark):
    found = op10_multiple_instance(spark, SF).join(table(spark, SF, "labels").select("doc_id", "toxic"), "doc_id").where("held_out")
    n, right, caught, toxic = found.agg(
        F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.sum(F.col("predicted") * F.col("toxic")), F.sum("toxic")
    ).first()
    assert right / n > 0.97 and caught / toxic > 0.85


def test_all_kinds_of_rows(spark, hostile, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    known = with_labels(hostile, labels, F.lit(True))
    assert sorted((x["doc_id"], x["toxic"]) for x in known.collect()) == [(1, 1), (7, 0), (7, 0), (7, 0)]
    for model in (train(known), train(nothing.withColumn("toxic", F.lit(1))), train(known.where("toxic = 0"))):
        out = toxicity(hostile, model)
        assert out.columns == [*hostile.columns, "_tox"]
        assert out.count() == hostile.count()
        assert all(0 <= x["_tox"]["score"] <= 1 for x in out.collect())
    assert toxicity(nothing, model).count() == 0
