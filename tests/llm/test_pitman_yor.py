import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import blocks, pitman_yor
from corpusmill.llm.blocks import spread, squeezed, steps
from corpusmill.llm.pitman_yor import _mix, _pair_hash, pitman_yor_scores, seated, uniforms

END = None


def h(w):
    return 0x5EED if w is END else xxhash.xxh3_64_intdigest(w)


def key(u, w):
    return _pair_hash(np.array([h(u)], np.uint64), _mix(np.array([h(w)], np.uint64)))


def ways(n, d):
    """Generalised Stirling numbers of n customers by their recursion, exactly."""
    d, row = Fraction(d), {1: Fraction(1)}
    for i in range(1, n):
        row = {t: row.get(t - 1, 0) + max(0, i - d * t) * row.get(t, 0) for t in range(1, i + 2)}
    return row


def drawn(k, sweep, n, rate, d):
    """The number of tables where the sum of the weights passes the dish's number in (0, 1)."""
    weights = [float(w) * rate**t for t, w in ways(n, d).items()]
    x, total = uniforms(k, sweep)[0][0] * sum(weights), 0.0
    for t, w in enumerate(weights, 1):
        total += w
        if total >= x:
            return t
    return n


def brute(docs, sweeps=3, samples=2, theta=0.5):
    """The same model in dictionaries: probability of a word after a context, averaged over the last states."""
    train = [t for t, out in docs if not out]
    tokens = [[*t, END] for t in train]
    c1 = Counter(w for t in tokens for w in t)
    c2 = Counter(p for t in tokens for p in zip([END, *t[:-1]], t, strict=True))
    d = lambda ns: min(0.95, max(0.05, sum(n == 1 for n in ns) / max(1, sum(n == 1 for n in ns) + 2 * sum(n == 2 for n in ns))))
    tables = {p: 1 for p in c2}
    v = len(c1)
    first = Counter(w for _, w in c2)
    d2, d1 = d(c2.values()), d(first.values())
    own = {w: 1 for w in first}
    states = []

    def state():
        dish, ctx = Counter(), Counter()
        for (u, w), t in tables.items():
            dish[w] += t
            ctx[u] += t
        return dish, ctx

    def parent(s, w):
        dish, own, _, _ = s
        base = (theta + d1 * sum(own.values())) / (v + 1)
        return (dish.get(w, 0) - d1 * own.get(w, 0) + base) / (theta + sum(dish.values()))

    dish, ctx = state()
    states.append((dish, own, ctx, dict(tables)))
    for k in range(sweeps):
        s = states[-1]
        for (u, w), n in c2.items():
            rate = (theta + d2 * s[2][u]) * parent(s, w)
            tables[u, w] = drawn(key(u, w), k, n, rate, d2)
        dish, ctx = state()
        base = (theta + d1 * sum(s[1].values())) / (v + 1)
        own = {w: drawn(np.array([h(w)], np.uint64), k + 500, n, base, d1) for w, n in dish.items()}
        states.append((dish, own, ctx, dict(tables)))

    def p(u, w):
        out = 0
        for s in states[-samples:]:
            out += (c2.get((u, w), 0) - d2 * s[3].get((u, w), 0) + (theta + d2 * s[2].get(u, 0)) * parent(s, w)) / (theta + c1.get(u, 0))
        return out / samples

    return p, c1


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    return [([r.choice(vocabulary[: r.choice([4, 20, 60])]) for _ in range(r.randrange(0, 80))], i % 5 == 2) for i in range(60)]


def test_a_context_s_probabilities_sum_to_one(corpus):
    p, c1 = brute(corpus)
    for u in (END, b"w1", b"never"):
        assert sum(p(u, w) for w in c1) + p(u, b"unknown") == pytest.approx(1)


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_scores_against_dictionaries(spark, corpus, monkeypatch, size):
    """In blocks and ranges of any size the scores are those of the whole model."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    monkeypatch.setattr(pitman_yor, "PAIR_BYTES", 2 * size)
    monkeypatch.setattr(pitman_yor, "WORD_BYTES", 5 * size)
    rows = [(i, b" ".join(t).decode().upper(), out) for i, (t, out) in enumerate(corpus)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean").repartition(3)
    found = pitman_yor_scores(df, F.col("out")).collect()
    p, c1 = brute(corpus)
    n, v = sum(c1.values()), len(c1)
    assert len(found) == len(corpus)
    for x in found:
        t, out = corpus[x["doc_id"]]
        t = [*t, END]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (out, len(t), sum(c1[w] > 0 for w in t), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t))
        assert x["score"] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip([END, *t[:-1]], t, strict=True)))


@pytest.mark.parametrize(("n", "rate", "discount"), [(2, 0.3, 0.4), (3, 1.0, 0.5), (10, 1.0, 0.7), (20, 3.0, 0.8), (40, 0.02, 0.2), (300, 30.0, 0.6)])
def test_tables_have_their_conditional_weights(n, rate, discount):
    keys = _mix(np.arange(200_000, dtype=np.uint64))
    got = seated(keys, 1, np.full(len(keys), n), np.full(len(keys), rate), discount)
    weights = {t: w * Fraction(rate) ** t for t, w in ways(n, discount).items()}
    share = {t: float(w / sum(weights.values())) for t, w in weights.items()}
    assert got.mean() == pytest.approx(sum(t * p for t, p in share.items()), rel=0.01)
    found = Counter(got.astype(int).tolist())
    assert sum(abs(found[t] / len(keys) - p) for t, p in share.items()) < 0.03


@pytest.mark.parametrize(("n", "rate", "discount"), [(700, 5.0, 0.6), (2_000, 0.05, 0.3), (2_000, 40.0, 0.5), (2_000, 400.0, 0.8)])
def test_tables_of_many_customers(n, rate, discount):
    """Beyond the exact weights the mean and the spread are theirs within a few hundredths."""
    keys = _mix(np.arange(40_000, dtype=np.uint64))
    got = seated(keys, 1, np.full(len(keys), n), np.full(len(keys), rate), discount)
    row = np.array([0.0])
    for i in range(1, n):  # logarithms, by the recursion
        t = np.arange(1, len(row) + 1)
        row = np.logaddexp(np.append(row + np.log(i - discount * t), -np.inf), np.append(-np.inf, row))
    t = np.arange(1, n + 1)
    p = np.exp(row + t * np.log(rate) - (row + t * np.log(rate)).max())
    p /= p.sum()
    mean = (t * p).sum()
    assert got.mean() == pytest.approx(mean, rel=0.03)
    assert got.std() == pytest.approx(math.sqrt((t * t * p).sum() - mean**2), rel=0.15, abs=0.05)
    assert (got >= 1).all() and (got <= n).all()


def test_all_kinds_of_rows(hostile, nothing):
    found = pitman_yor_scores(hostile, F.lit(False)).collect()
    assert sorted(str(x["doc_id"]) for x in found) == sorted(str(x["doc_id"]) for x in hostile.collect())
    assert all(x["n_tokens"] >= 1 and math.isfinite(x["score"]) and x["score"] < 0 for x in found)
    unlearned = pitman_yor_scores(hostile, F.lit(True)).collect()
    assert all(x["score"] == 0 and x["train_tokens"] == 0 for x in unlearned)  # one unknown word has all the probability
    assert pitman_yor_scores(nothing, F.lit(False)).count() == 0


def test_counts_of_a_corpus_beyond_32_bits():
    """Totals, tallies and states of 2**31 and more arrive as they are."""
    keys, many = np.array([3, 1 << 40], np.uint64), 3 << 30
    tallies = pd.DataFrame([("tally", 0, b, squeezed(steps(keys), *np.array([[many, 1], [many, 2]], "<u4"))) for b in ("0-0", "0-1")], columns=pitman_yor._COLUMNS)
    begin = pitman_yor._word_state(tallies)
    assert [x.tolist() for x in spread(begin["blob"].iloc[0], "<u8", *pitman_yor._STATE)[1:]] == [[2 * many, 2], [1, 1], [2 * many, 4]]
    more = pd.DataFrame([("more", 0, "0-0", squeezed(steps(keys), *np.array([[1 << 33, 0], [5, 1 << 34]], "<u8")))], columns=pitman_yor._COLUMNS)
    model = pitman_yor._Model(2, 0.5, 0.5, 0.5)
    model.totals.append((2 * many + 2, 2))
    after = pitman_yor._next_state(model, 0)(begin[begin["kind"] == "state"], more)
    _, dish, own, table = spread(after["blob"].iloc[0], "<u8", *pitman_yor._STATE)
    assert (dish.tolist(), table.tolist()) == ([2 * many + (1 << 33), 2], [2 * many + 5, 4 + (1 << 34)])
    assert spread(after["blob"].iloc[1], "<i8")[0].tolist()[:2] == [int(dish.sum()), int(own.sum())]
    rows = [("pair", 0, b, squeezed(steps(keys), np.array([many, 2], "<u4"))) for b in ("0-0", "0-1")]
    answers = pitman_yor._count(pd.DataFrame(rows, columns=pitman_yor._COLUMNS))
    for block, home in (("0-0", [1, 1]), ("0-1", [0, 0])):
        total, at_home = pitman_yor._joined(answers[answers["block"] == block], "pair", *pitman_yor._COUNT)
        assert (total.tolist(), at_home.tolist()) == ([2 * many, 4], home)
