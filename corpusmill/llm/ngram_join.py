"""N-gram Jaccard join by trees of MinHash prefixes of one length.

Each tree has a signature of several MinHash values for every document; documents that share a prefix of it meet. How
far the prefix may be shortened is computed once, from the threshold and the target recall, not tree by tree from the
rows: that is a forest cut at one depth, so the prefixes are grouped by equality and no trie is kept. Documents that
meet are gathered in components; inside these, every pair is compared exactly, in blocks, and only counts and one link
per document leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, written
from corpusmill.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
TARGET = 0.9999
#: Distinct texts of a component that are compared in one task; larger components are compared block against block.
BLOCK = 512
#: Distinct texts of small components that share a task.
BIN = 1_000
_CACHE = 100_000
_COLUMNS = 2_048


class _Hashes(dict):
    """64-bit hashes of words, each computed once while it is in use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, width: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words, but not none, are one run."""
    ws = text.split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    size = min(width, len(ws))
    out = np.full(len(ws) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(ws) - size + 1 + i]
        out ^= out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def recall(similarity: float, depth: int, trees: int) -> float:
    """Chance that two documents share a prefix of ``depth`` values in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float, depth: int, trees: int, target: float) -> int:
    """The longest prefix, at most ``depth``, that meets the target recall at the threshold itself; 1 at least."""
    while depth > 1 and recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


def _signatures(width: int, trees: int, depth: int):
    random = np.random.default_rng(20_240_229)
    a = random.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = random.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def run(batches: Iterator[tuple[pd.Series]]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for texts in batches:
            rows = []
            for t in texts:
                x = shingles(t, width, hashes)
                if not len(x):
                    rows.append((None, 0, []))
                    continue
                least = np.full(trees * depth, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(x), 2_048):
                    np.minimum(least, (a[:, None] * x[i : i + 2_048] + b[:, None]).min(axis=1), out=least)
                values = (least >> np.uint64(32)).astype("<u4").reshape(trees, depth)
                prefixes = [xxhash.xxh3_64_intdigest(bytes([i]) + v.tobytes()) - (1 << 63) for i, v in enumerate(values)]
                rows.append((xxhash.xxh3_128_digest(x.tobytes()), len(x), prefixes))
            yield pd.DataFrame(rows, columns=["set", "n", "prefixes"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "set binary, n int, prefixes array<long>").asNondeterministic()


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each set of ``left`` (places in ``sets``) is similar to each of ``right``, by exact counts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(left) * len(right) <= 16:
        shared = np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    else:
        places = np.concatenate([left, right[~np.isin(right, left)]])
        values, column, n = np.unique(np.concatenate([sets[i] for i in places]), return_inverse=True, return_counts=True)
        row = np.repeat(places, sizes[places])
        common = n[column] > 1
        renumbered = np.cumsum(n > 1) - 1
        row, column = row[common], renumbered[column[common]]
        at = np.full(len(sets), -1)
        at[places] = np.arange(len(places))
        shared = np.zeros((len(left), len(right)))
        order = np.argsort(column, kind="stable")
        row, column = at[row[order]], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
            first, last = np.searchsorted(column, [lo, lo + _COLUMNS])
            x = np.zeros((len(places), _COLUMNS), np.float32)
            x[row[first:last], column[first:last] - lo] = 1
            shared += x[at[left]] @ x[at[right]].T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    return shared >= threshold * union - 1e-9


def _verify(width: int, threshold: float):
    """All pairs of each component in the group (or of two blocks of one): (set, links, root) for each text."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes, out = _Hashes(), []
        for _, part in group.groupby("component", sort=False):
            part = part.drop_duplicates("set")
            keys, side = part["set"].tolist(), part["side"].to_numpy()
            sets, weight = [shingles(t, width, hashes) for t in part["text"]], part["weight"].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            within = not len(right)
            linked = _similar(sets, left, left if within else right, threshold)
            if within:
                np.fill_diagonal(linked, False)
                right = left
            links = np.zeros(len(keys), np.int64)
            links[left] = linked @ weight[right]
            if not within:
                links[right] = linked.T @ weight[left]
            root = list(range(len(keys)))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in np.argwhere(linked):
                a, b = top(left[i]), top(right[j])
                if a != b:
                    low, high = (a, b) if keys[a] < keys[b] else (b, a)
                    root[high] = low
            out += [(k, int(n), keys[top(i)]) for i, (k, n) in enumerate(zip(keys, links, strict=True))]
        return pd.DataFrame(out, columns=["set", "links", "root"])

    return run


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    target: float = TARGET,
    block: int = BLOCK,
) -> DataFrame:
    """(id, text_key, n_shingles, class_id, class_key, n_links) for each row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of ``width`` consecutive words is ``threshold``
    or more. Words are runs of characters other than space and \\x09-\\x0D; a text of fewer than ``width`` words is one
    shingle; a text without words (null, empty, blank) has no links and is its own class. A class is a component of
    linked documents; its first one has the smallest id, of equal ids the smallest md5 of the text, and class_id and
    class_key are that id (null if none has one) and md5. text_key is the own text's md5. n_links counts a document's
    linked documents, copies and repeated rows too. Other columns aren't read.

    Documents with equal sets are one text with a weight from the signatures on, so copies are never compared.
    A prefix of ``prefix_depth`` values is common to all pairs at the threshold in some tree with the target recall,
    and pairs above it with more; no count of partners or candidates is limited.
    """
    spark = docs.sparkSession
    used = prefix_depth(threshold, depth, trees, target)
    ided = docs.select(F.col(id_col).alias("id"), as_bytes(text).alias("text"))
    signed = ided.withColumn("s", _signatures(width, trees, used)("text"))
    rows = written(signed.select("id", F.md5("text").alias("text_key"), F.col("s.set").alias("set"), F.col("s.n").alias("n"), F.col("s.prefixes").alias("prefixes")), "signatures")
    known = rows.where(F.col("set").isNotNull())
    texts = written(
        known.groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("first"), F.count(F.lit(1)).alias("weight"), F.first("prefixes").alias("prefixes")),
        "texts",
    )
    branches = texts.select("set", F.explode("prefixes").alias("prefix"))
    shared = branches.groupBy("prefix").agg(F.min("set").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    meeting = written(components(branches.join(shared, "prefix").select(F.col("set").alias("a"), F.col("root").alias("b"))), "meeting")
    sized = meeting.join(meeting.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root").select(F.col("v").alias("set"), F.col("root").alias("component"), "size")
    members = written(sized.join(texts.select("set", "first", "weight"), "set"), "members")

    n_members = members.count()
    keyed = docs.select(F.col(id_col).cast("string").alias("_id"), as_bytes(text).alias("text")).select(
        F.concat_ws(":", F.md5("text"), "_id").alias("at"), "text"
    )
    wanted = members.select(
        F.concat_ws(":", F.col("first.text_key"), F.col("first.id").cast("string")).alias("at"), "set", "component", "size", "weight"
    )
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("set"), blocks).cast("int")
    bins = max(1, n_members // BIN)
    # A small component goes whole to one of the bins. A text of a large one goes to its block's task with each block.
    here = wanted.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    bin_of = F.concat(F.lit("b"), F.pmod(F.xxhash64("component"), F.lit(bins)).cast("string"))
    pair = F.concat_ws(":", F.hex("component"), F.least("own", "other"), F.greatest("own", "other"))
    dealt = here.select("at", "set", "component", "weight", F.when(F.col("blocks") == 1, bin_of).otherwise(pair).alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    compared = keyed.join(dealt, "at").drop("at").groupBy("task").applyInPandas(_verify(width, threshold), "set binary, links long, root binary")
    found = written(compared, "links")

    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("set").alias("a"), F.col("root").alias("b"))).select(F.col("v").alias("set"), "root")
    of_text = texts.select("set", "first", "weight").join(links, "set", "left").join(classes, "set", "left").withColumn("root", F.coalesce("root", "set"))
    of_text = written(of_text, "text-classes")
    least = of_text.groupBy("root").agg(F.min("first").alias("least"))
    answer = of_text.join(least, "root").select("set", F.col("least.id").alias("class_id"), F.col("least.text_key").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    with_words = known.join(answer, "set").select("id", "text_key", F.col("n").alias("n_shingles"), "class_id", "class_key", "n_links")
    without = rows.where(F.col("set").isNull()).select("id", "text_key", F.lit(0).alias("n_shingles"), F.col("id").alias("class_id"), F.col("text_key").alias("class_key"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(without).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, of equal ids the smallest text key;
    one without an id comes last.

    Rows with the same id and the same text are one document. Texts without words stay.
    """
    found = jaccard_classes(docs, id_col, text, **options)
    key = lambda k, i: F.concat_ws(":", k, i.cast("string"))
    first = F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    dropped = found.where(~first).select(key(F.col("text_key"), F.col(id_col)).alias("_at")).distinct()
    at = "_at"
    while at in docs.columns:
        at = "_" + at
    kept = docs.withColumn(at, key(F.md5(as_bytes(text)), F.col(id_col))).join(dropped.withColumnRenamed("_at", at), at, "left_anti")
    return kept.dropDuplicates([at]).select(*docs.columns)
