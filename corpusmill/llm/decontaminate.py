"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the benchmark's word windows. For each pattern length there is a block shift table (how far the
scan may jump when it sees a pair of words), and buckets that the last pair selects; a pattern in a bucket is
confirmed by comparing its words. A scan therefore looks at about one word in ``window - 1`` of a clean text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, fresh, written

#: A word character is every byte of UTF-8 above 0x7F, a digit or a letter; A-Z are lower-cased, the rest parts words.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
#: Patterns in one broadcast table: about 200 bytes each, so 50 MB at most.
BLOCK_PATTERNS = 200_000

#: spans: start and end of each span of hit words, one after the other.
RESULT = "n_words long, n_hit long, spans array<long>, items array<string>"


def item_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text in UTF-8."""
    return text.translate(_TABLE).split()


class WuManber:
    """Patterns of one length: shifts by the block that ends the window, buckets by the patterns' last block."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set[str]]] = {}

    def add(self, pattern: tuple, item: str | None) -> None:
        for end in range(self.block, self.length + 1):
            block = pattern[end - self.block : end]
            self.shift[block] = min(self.shift.get(block, self.far), self.length - end)
        items = self.buckets.setdefault(pattern[-self.block :], {}).setdefault(pattern, set())
        if item is not None:
            items.add(item)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, items) of each occurrence, from left to right."""
        length, far, shift, i, n = self.length, self.far, self.shift, self.length, len(text)
        if self.block == 1:
            for i, w in enumerate(text):
                if found := self.buckets.get((w,)):
                    yield i, i + 1, found[(w,)]
            return
        while i <= n:
            block = (text[i - 2], text[i - 1])
            step = shift.get(block, far)
            if step:
                i += step
                continue
            items = self.buckets[block].get(tuple(text[i - length : i]))
            if items is not None:
                yield i - length, i, items
            i += 1


def _tables(rows: list) -> list[WuManber]:
    by_length: dict[int, WuManber] = {}
    for item, joined in rows:
        pattern = tuple(joined.split(b" "))
        by_length.setdefault(len(pattern), WuManber(len(pattern))).add(pattern, item)
    return [by_length[k] for k in sorted(by_length)]


def find(text: bytes, spans, items, tables: list[WuManber]) -> tuple[int, int, list[int], list[str]]:
    """Words, hit words, ends of the merged spans and sorted items; ``spans`` and ``items`` are what earlier tables found."""
    ws = item_words(text)
    hits, named = list(zip(spans[::2], spans[1::2], strict=True)), set(items)
    for t in tables:
        for start, end, found in t.search(ws):
            named |= found
            hits.append((start, end))
    merged: list[int] = []
    for start, end in sorted(hits):
        if merged and start <= merged[-1]:
            merged[-1] = max(end, merged[-1])
        else:
            merged += (start, end)
    return len(ws), sum(merged[1::2]) - sum(merged[::2]), merged, sorted(named)


def patterns(benchmark: DataFrame, window: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, pattern): the distinct windows of each item; an item of fewer words, but not none, is one window."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, t in zip(b["item"], b["text"], strict=True):
                ws = item_words(t)
                rows += [(name, p) for p in {b" ".join(ws[i : i + window]) for i in range(max(1, len(ws) - window + 1))} if p]
            yield pd.DataFrame(rows, columns=["item", "pattern"])

    slim = benchmark.select(F.col(item).cast("string").alias("item"), as_bytes(text).alias("text"))
    return slim.mapInPandas(cut, "item string, pattern binary").distinct()


def _scanner(sent):
    """The search as a function of (text, spans, items); not deterministic for Spark, so that no filter runs it twice."""

    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tables = _tables(sent.value)
        for batch in batches:
            rows = [find(*row, tables) for row in zip(*batch, strict=True)]
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "items"])

    return F.pandas_udf(scan, RESULT).asNondeterministic()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    into: str = "leak",
    block_patterns: int = BLOCK_PATTERNS,
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, spans (word positions, start and
    end one after the other, half open), items, contaminated.

    Every row of ``docs`` stays, once, with its columns; ``into`` gets an underscore while a column has that name.
    A null or empty text has no words and no hits; a null item text or one without words has no pattern; an item
    without an id marks words but isn't named. Repeated items and ties change nothing. An empty benchmark hits nothing.

    The patterns are the stated query set. They are counted first and sent in tables of at most
    ``block_patterns``; with more than one table, what each pass found is written before the next pass.
    """
    spark = docs.sparkSession
    into = fresh(docs, into)
    found = written(patterns(benchmark, window, item, item_text), "patterns")
    n_blocks = max(1, -(-found.count() // block_patterns))
    dealt = found.withColumn("_block", F.pmod(F.xxhash64("pattern", "item"), F.lit(n_blocks)))
    out = docs
    for k in range(n_blocks):
        rows = dealt.where(F.col("_block") == k).collect()
        sent = spark.sparkContext.broadcast([(r["item"], bytes(r["pattern"])) for r in rows])

        before = (F.col(into)["spans"], F.col(into)["items"]) if k else (F.array().cast("array<long>"), F.array().cast("array<string>"))
        out = out.withColumn(into, _scanner(sent)(as_bytes(text), *before))
        if k < n_blocks - 1:
            out = written(out, "decontaminate")
    found = F.col(into)
    return out.withColumn(into, found.withField("contaminated", F.size(found["spans"]) > 0))
