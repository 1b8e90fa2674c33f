"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is logistic in its distinct words; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only documents have labels, so the gradient reaches a sentence through the noisy-or: the
sentences that can explain a label take it up. The trained model then points at the offending sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, fresh, written

_SENTENCE = re.compile(r"[.!?\n。！？]+")
_WORD = re.compile(r"\w+")
#: Bound of the training sample: labelled documents.
SAMPLE_DOCS = 20_000
#: A word is a feature if it is in so many documents of the sample and so far above chance in toxic ones.
MIN_DOCS = 5
MIN_Z = 5.0
#: The start of a longer word is a feature too, so that forms unseen in training count.
STEM = 5
#: Features at most, the clearest; one is a word and a number.
MAX_FEATURES = 50_000

SCORE = "score double, sentences array<struct<start:long,end:long,p:double>>"


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-cased words and their first STEM letters) of each piece that has a word."""
    start = 0
    for m in _SENTENCE.finditer(text):
        if found := _evidence(text[start : m.start()]):
            yield start, m.start(), found
        start = m.end()
    if found := _evidence(text[start:]):
        yield start, len(text), found


def _evidence(piece: str) -> set[str]:
    found = set(_WORD.findall(piece.lower()))
    return found | {w[:STEM] + "-" for w in found if len(w) > STEM}


def _sample(labelled: DataFrame, id_col: str, text: str, label: str, docs: int) -> DataFrame:
    """(at, text, label) of about ``docs`` labelled rows, by the hash of their id; copies of a text with its label once."""
    rows = labelled.where(F.col(label).isNotNull()).select(
        F.xxhash64(F.col(id_col).cast("string"), F.lit(17)).alias("at"), as_bytes(text).alias("text"), (F.col(label) != 0).cast("int").alias("label")
    )
    n = rows.count()
    # A share of the hash range that holds about ``docs`` rows: no sort and no limit over all texts.
    if n > docs:
        rows = rows.where(F.pmod("at", F.lit(1 << 20)) < int((1 << 20) * docs / n))
    return rows.groupBy(F.md5("text").alias("key"), "label").agg(F.first("text").alias("text"))


def _bags(t: bytes) -> list[set[str]]:
    return [w for _, _, w in sentences(t.decode("utf-8", "replace"))]


def _features(sample: DataFrame, n: int, rate: float) -> list[str]:
    """Words whose documents are toxic more often than chance allows, by MIN_Z standard errors; the clearest first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs, toxic = Counter(), Counter()
            for t, label in zip(b["text"], b["label"], strict=True):
                seen = set().union(*_bags(t))
                docs.update(seen)
                if label:
                    toxic.update(seen)
            yield pd.DataFrame([(w, k, toxic[w]) for w, k in docs.items()], columns=["word", "docs", "toxic"])

    counts = sample.mapInPandas(count, "word string, docs long, toxic long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    above = (F.col("toxic") - F.col("docs") * rate) / F.sqrt(F.col("docs") * rate * (1 - rate))
    best = counts.where((F.col("docs") >= MIN_DOCS) & (above > MIN_Z)).orderBy(above.desc(), "word").limit(MAX_FEATURES)
    return sorted(r["word"] for r in best.select("word").collect())


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = SAMPLE_DOCS, steps: int = 300) -> dict:
    """{"bias", "leak", "weights": {word: weight}} fitted on a bounded sample of rows with a label.

    The sample is the only bound: about ``sample_docs`` documents, chosen by a hash of their id, each used whole.
    Null labels are left out, any label but 0 counts as 1, copies of a text with the same label count once. Without
    a labelled row, or with one label only, no word has a weight and every document scores the share of toxic
    labels (0 without any). The driver gets the features and, for each sentence with one, their numbers.
    """
    sample = written(_sample(labelled, id_col, text, label, sample_docs), "toxicity-sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n, toxic = sum(counts.values()), counts.get(1, 0)
    if not 0 < toxic < n:
        return {"bias": 0.0, "leak": toxic / n if n else 0.0, "weights": {}}
    words = _features(sample, n, toxic / n)
    place = {w: i for i, w in enumerate(words)}

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bags = [[sorted(place[w] for w in bag & place.keys()) for bag in _bags(t)] for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "label": b["label"], "bags": [[x for x in doc if x] for doc in bags]})

    rows = sample.mapInPandas(known, "key string, label int, bags array<array<int>>").where(F.size("bags") > 0).collect()
    rows = sorted(rows, key=lambda r: (r["key"], r["label"]))
    bags, labels = [r["bags"] for r in rows], [r["label"] for r in rows]
    silent = [n - toxic - labels.count(0), toxic - labels.count(1)]  # documents without any feature, by label
    return fit(bags, np.array(labels, float), silent, words, steps)


def fit(bags: list[list[list[int]]], y: np.ndarray, silent: list[int], words: list[str], steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> dict:
    """Maximum likelihood of the noisy-or with Adam, over whole documents.

    A sentence without any feature is no evidence. What labels say beyond the sentences goes into ``leak``, the
    noisy-or's chance that a document is labelled toxic without an offending sentence, whatever its length.
    """
    f = np.array([w for doc in bags for bag in doc for w in bag], np.int64)
    s = np.repeat(np.arange(sum(map(len, bags))), [len(bag) for doc in bags for bag in doc])
    d = np.repeat(np.arange(len(bags)), [len(doc) for doc in bags])
    n_s, n_d, n_f, n = len(d), len(bags), len(words), len(bags) + sum(silent)
    x = np.concatenate((np.full(n_f, 1.0), [-1.0, -3.0]))  # weights, bias, log odds of the leak
    m, v = np.zeros(n_f + 2), np.zeros(n_f + 2)
    for step in range(1, steps + 1):
        z = np.clip(x[n_f] + np.bincount(s, x[f], n_s), -30, 30)
        p, leak = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-x[-1]))
        clean = np.log1p(-leak) + np.bincount(d, -np.logaddexp(0, z), n_d)  # log of the chance that nothing is toxic
        pull = np.where(y > 0, np.exp(clean) / np.clip(-np.expm1(clean), 1e-12, None), -1.0)
        g_s = -p * pull[d]
        leaks = leak * (pull.sum() - silent[0] + silent[1] * (1 - leak) / max(leak, 1e-12))
        g = np.concatenate((np.bincount(f, g_s[s], n_f), [g_s.sum(), -leaks])) / n + decay * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"bias": float(x[n_f]), "leak": float(1 / (1 + np.exp(-x[-1]))), "weights": {w: float(x[i]) for i, w in enumerate(words)}}


def score_text(text: str, model: dict) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's probability, and each sentence of one half or more with its place."""
    bias, weights = model["bias"], model["weights"]
    clean, found = float(np.log1p(-model["leak"])), []
    for start, end, ws in sentences(text):
        if known := weights.keys() & ws:
            z = min(30.0, max(-30.0, bias + sum(sorted(weights[w] for w in known))))
            clean -= float(np.logaddexp(0.0, z))
            if z >= 0:
                found.append((start, end, float(1 / (1 + np.exp(-z)))))
    return float(-np.expm1(clean)), found


def _scorer(sent):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [score_text(t.decode("utf-8", "replace"), sent.value) for t in texts]
            yield pd.DataFrame(rows, columns=["score", "sentences"])

    return F.pandas_udf(run, SCORE).asNondeterministic()


def toxicity(docs: DataFrame, model: dict, text: str = "text", into: str = "tox") -> DataFrame:
    """``docs`` with a struct column ``into``: score (0 to 1), sentences (offending ones: start, end, p).

    Every row stays, once, with its columns; ``into`` gets an underscore while a column has that name. Null and
    empty texts, and texts without a word, have no sentence and score the model's leak. Places count code points.
    """
    into = fresh(docs, into)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    return docs.withColumn(into, _scorer(sent)(as_bytes(text)))


def with_labels(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", label: str = "toxic", text: str = "text") -> DataFrame:
    """(id, text, label) of the documents that have a label; of several labels for an id the highest counts."""
    known = labels.where(where & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias(label))
    return docs.select(id_col, text).join(known, id_col)
