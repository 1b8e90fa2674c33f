"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams (one to three letters, words padded with a blank) by
rank. A document's own ranked list is compared with each profile by the out-of-place distance: the sum, over the
document's n-grams, of how far their ranks lie apart, at most the profile's length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, fresh

#: n-grams of a profile and of a document's list.
PROFILE = 400
#: Languages that one broadcast may hold: ranks of 400 n-grams each.
MAX_LANGUAGES = 2_000
_BITS = 21  # a code point
_BLANK = 32


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a task."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of the lower-cased text's words as packed code points; a blank stands only at a gram's ends, and is a
    code point of its own, so that a word's beginning differs from its inside."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    chars = np.concatenate(([_BLANK], np.where(_letters()[chars], chars, _BLANK), [_BLANK])).astype(np.int64)
    chars = chars[(chars != _BLANK) | np.append(True, chars[:-1] != _BLANK)]  # one blank between words
    if len(chars) < 3:
        return np.empty(0, np.int64)
    one = chars[chars != _BLANK]
    two = (chars[:-1] << _BITS) | chars[1:]
    three = ((chars[:-2] << _BITS | chars[1:-1]) << _BITS | chars[2:])[chars[1:-1] != _BLANK]
    return np.concatenate((one, two, three))


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams; equally frequent ones in the order of their code."""
    return codes[np.lexsort((codes, -counts))[:top]]


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", top: int = PROFILE) -> dict[str, list[int]]:
    """{language: n-grams by rank}, from counts over all rows that have a language.

    Rows without a language or a letter add nothing; repeated rows count as often as they come; equal counts are
    ranked by code. Counts are summed in each task first, so only a language's distinct n-grams are shuffled, and
    just ``top`` rows a language reach the driver. An empty table gives no profiles.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, texts in b.groupby("lang")["text"]:
                got = [np.unique(grams(t.decode("utf-8", "replace")), return_counts=True) for t in texts]
                codes, at = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
                n = np.bincount(at, np.concatenate([k for _, k in got]), len(codes))
                yield pd.DataFrame({"lang": name, "gram": codes, "n": n.astype(np.int64)})

    slim = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), as_bytes(text).alias("text"))
    counted = slim.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counted.withColumn("place", place).where(F.col("place") <= top)
    rows = best.limit(MAX_LANGUAGES * top + 1).collect()
    if len(rows) > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: clean the column {lang} first")
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """The profiles as one table of ranks: a row for each language, a column for each n-gram of any."""

    def __init__(self, by_lang: dict[str, list[int]], top: int) -> None:
        self.top = top
        self.langs = sorted(by_lang)
        self.codes = np.unique(np.array([g for x in by_lang.values() for g in x], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, name in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, by_lang[name])] = np.arange(len(by_lang[name]))

    def predict(self, text: str) -> tuple[str, float]:
        codes, counts = np.unique(grams(text), return_counts=True)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranked(codes, counts, self.top)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.top, np.minimum(np.abs(ranks - np.arange(len(own))), self.top)).sum(axis=1)
        best = int(far.argmin())  # of equally near languages the first by name
        others = np.delete(far, best)
        worst = others.min() if len(others) else self.top * len(own)
        return self.langs[best], float(1 - far[best] / worst) if worst else 0.0


def _predictor(sent, top: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Profiles(sent.value, top)
        for texts in batches:
            yield pd.DataFrame([model.predict(t.decode("utf-8", "replace")) for t in texts], columns=["lang", "score"])

    return F.pandas_udf(run, "lang string, score double").asNondeterministic()


def language(docs: DataFrame, by_lang: dict[str, list[int]], text: str = "text", into: str = "language", top: int = PROFILE) -> DataFrame:
    """``docs`` with a struct column ``into``: lang, score (0 to 1: how much nearer the best profile is than the next).

    Every row stays, once, with its columns; ``into`` gets an underscore while a column has that name. A null or
    empty text, or one without a letter, is ``und`` with score 0; so is every text without any profile.
    """
    into = fresh(docs, into)
    sent = docs.sparkSession.sparkContext.broadcast(by_lang)  # bounded: MAX_LANGUAGES times top numbers
    return docs.withColumn(into, _predictor(sent, top)(as_bytes(text)))
