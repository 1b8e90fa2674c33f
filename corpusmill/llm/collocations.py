"""Phrases of two to four words by how often their parts stand together, counted from windows of the longest order.

Each word of a text begins one window: itself and the next three words as lead columns, padded with nulls after the end
of its piece. Only these windows are counted; ``ROLLUP`` over the columns then sums them to all shorter prefixes, and
the prefixes of length m of the windows are just the phrases of m words. No shorter phrase is ever listed.

Most windows are rare, so they are padded from where they cannot count any more: a block of texts asks the owners of
hash ranges which of its prefixes occur often enough in all blocks together, in packed arrays of a few bytes for each,
and gets a bit for each. A prefix that shares its hash with another may stay in; it is counted exactly later. Windows
move in the same way: packed texts of a block, each to the one owner that sums it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.blocks import blocks, bucket_of, each, from_steps, slices, spread, squeezed, steps, unpacked
from corpusmill.llm.common import fresh, written

ORDER = 4
COLUMNS = [f"w{k}" for k in range(1, ORDER + 1)]
#: Bytes of text for which one range of hashes is made.
RANGE_BYTES = 8 << 20
#: Bits of a prefix's place in its range. A range of RANGE_BYTES has some 3 million prefixes, so that few share a place;
#: more bits would only move more bytes.
PLACE_BITS = 24
#: Best phrases of a group are chosen among those of so many parts.
PARTS = 64

_BREAK = b"."
_ENDS = b".,;:!?\n\x0b\x0c\r"
_SMALL = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + _BREAK * len(_ENDS))
ROWS = "bucket int, block string, blob binary"
PACKED = "bucket int, counts binary, lines binary"
WINDOWS = "group_key long, w1 string, w2 string, w3 string, w4 string, n long"


# --- in tasks -----------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Numbers(dict):
    """Words by number, in the order in which they come; -1 ends a piece."""

    def __init__(self, before: int) -> None:
        super().__init__({_BREAK: -1})
        self.before = before

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.before + len(self)
        return n


class _Prefixes:
    """A block's words, those of each group by themselves, and the hashes of all prefixes of its windows."""

    def __init__(self, row) -> None:
        keys, _, texts = unpacked(row)
        self.words: list[bytes] = []
        groups, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        ids: list[int] = []
        for key in np.unique(keys):
            known = _Numbers(len(self.words) - 1)
            for t in np.flatnonzero(keys == key):
                tokens = (texts[t].translate(_SMALL).replace(_BREAK, b" . ") + b" .").split()
                ids.extend(map(known.__getitem__, tokens))
            words = list(known)[1:]
            self.words += words
            groups.append(np.full(len(words), key, np.int64))
            seed = int(key) & (2**64 - 1)
            hashes.append(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words)))
        self.group, word = np.concatenate(groups), np.concatenate(hashes)
        self.ids = np.array(ids, np.int64)
        self.at = np.flatnonzero(self.ids >= 0)
        # ``whole``: places whose first k words stand in one piece, for each k; ``of`` finds the hash of each in ``hashes``.
        mixed, whole, prefix = _mix(word), np.ones(len(self.at), bool), np.zeros(len(self.at), np.uint64)
        self.whole, found = [], []
        for k in range(ORDER):
            w = self.ids[np.minimum(self.at + k, len(self.ids) - 1)]
            whole = whole & (w >= 0)
            prefix = _mix(prefix * np.uint64(0x9E3779B97F4A7C15) + (mixed[w] if len(mixed) else prefix))
            self.whole.append(whole)
            found.append(prefix[whole])
        self.hashes, self.of, self.counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)

    def depth(self, often: np.ndarray) -> np.ndarray:
        """How many words of each place's window stay, if ``often`` tells it for each hash."""
        depth, ok, begin = np.zeros(len(self.at), np.int64), np.ones(len(self.at), bool), 0
        for whole in self.whole:
            here = np.zeros(len(self.at), bool)
            n = np.count_nonzero(whole)
            here[whole] = often[self.of[begin : begin + n]]
            begin += n
            ok &= here
            depth += ok
        return depth


def _ask(owners: int, bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in each(f):
                c = _Prefixes(row)
                bucket, places = bucket_of(c.hashes, owners)
                places = (places >> np.uint64(40 - bits)).astype("<u4")
                counts = c.counts.astype("<u4")
                out = [(b, row.block, squeezed(steps(places[x:y]), counts[x:y])) for b, x, y in slices(bucket)]
                yield pd.DataFrame(out, columns=["bucket", "block", "blob"])

    return run


def _tell(at_least: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """A bit for each prefix that a range was asked about: whether all blocks together have it often enough."""
        parts = [spread(b, "<u4", "<u4") for b in frame["blob"]]
        places = np.concatenate([from_steps(p) for p, _ in parts])
        _, of = np.unique(places, return_inverse=True)
        often = np.bincount(of, np.concatenate([n for _, n in parts]))[of] >= at_least
        ends = np.cumsum([0, *[len(p) for p, _ in parts]])
        blobs = [squeezed(np.packbits(often[a:b])) + int(b - a).to_bytes(8, "little") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pd.DataFrame({"bucket": frame["bucket"], "block": frame["block"], "blob": blobs})

    return run


def _told(answers: pd.DataFrame) -> np.ndarray:
    bits = [np.unpackbits(spread(b[:-8], "u1")[0])[: int.from_bytes(b[-8:], "little")] for b in answers.sort_values("bucket")["blob"]]
    return np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)


def _led(owners: int):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Windows of a block with their numbers, packed by owner: one line for each, its words parted by a blank."""
        out = []
        for row in each(block):
            c = _Prefixes(row)
            if not len(c.at):
                continue
            depth = c.depth(_told(answers))
            columns = [np.where(depth > k, c.ids[np.minimum(c.at + k, len(c.ids) - 1)], -1) for k in range(ORDER)]
            group = c.group[c.ids[c.at]]
            _, code = np.unique(group, return_inverse=True)
            for w in columns:  # numbers stay below places x words of the block
                code = np.unique(code, return_inverse=True)[1] * (len(c.words) + 1) + w + 1
            _, first, counts = np.unique(code, return_index=True, return_counts=True)
            keys, depth = group[first], depth[first].tolist()
            words = zip(*(w[first].tolist() for w in columns), strict=True)
            lines = [b" ".join([c.words[i] for i in ids[:d]]) for ids, d in zip(words, depth, strict=True)]
            seeds = keys.view(np.uint64).tolist()
            bucket = np.array([xxhash.xxh3_64_intdigest(x, seed) % owners for x, seed in zip(lines, seeds, strict=True)], np.int64)
            order = np.argsort(bucket, kind="stable")
            for b, x, y in slices(bucket[order]):
                of = order[x:y]
                out.append((b, squeezed(keys[of], counts[of].astype("<u4")), _pressed(b"\n".join([lines[i] for i in of.tolist()]))))
        return pd.DataFrame(out, columns=["bucket", "counts", "lines"])

    return run


def _pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """Each window that an owner was sent, once, with its number in all blocks."""
    total: dict[tuple[int, bytes], int] = {}
    for blob, pressed in zip(frame["counts"], frame["lines"], strict=True):
        keys, counts = spread(blob, "<i8", "<u4")
        raw = pa.decompress(pressed[8:], decompressed_size=int.from_bytes(pressed[:8], "little"), codec="zstd", asbytes=True)
        for window, n in zip(zip(keys.tolist(), raw.split(b"\n"), strict=True), counts.tolist(), strict=True):
            total[window] = total.get(window, 0) + n
    none = [None] * ORDER
    words = [[*x.decode("utf-8", "replace").split(" "), *none][:ORDER] if x else none for _, x in total]
    out = pd.DataFrame(words, columns=COLUMNS, dtype=object)
    out.insert(0, "group_key", np.fromiter((key for key, _ in total), np.int64, len(total)))
    out["n"] = np.fromiter(total.values(), np.int64, len(total))
    return out


# --- on tables ----------------------------------------------------------------------------------


def grouped(docs: DataFrame, text: str, group: str) -> tuple[DataFrame, DataFrame]:
    """The texts in blocks under a key of their group, and the groups' names by key."""
    name, key = fresh(docs, "group_name"), fresh(docs, "group_key")
    named = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias(name), F.col(text))
    keyed = named.withColumn(key, F.xxhash64(name))
    names = keyed.groupBy(F.col(key).alias("group_key"), F.col(name).alias("group")).agg(F.count(F.lit(1)).alias("texts")).drop("texts")
    return blocks(keyed, key, text), names


def windows(held: DataFrame, at_least: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(group_key, w1..w4, n): windows that begin at a word of the blocks' texts, padded with nulls from where their first
    words occur less than ``at_least`` times in the group; equal windows are one row."""
    total = held.agg(F.sum("size")).first()[0] or 0
    owners = max(1, -(-total // range_bytes))
    asked = held.mapInPandas(_ask(owners, PLACE_BITS), ROWS)
    told = asked.groupBy("bucket").applyInPandas(_tell(at_least), ROWS)
    packed = held.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_led(owners), PACKED)
    return packed.groupBy("bucket").applyInPandas(_summed, WINDOWS)


def phrase_counts(wins: DataFrame, at_least: int) -> DataFrame:
    """(group_key, m, phrase, f) of phrases of m words found ``at_least`` times; the row of m = 0 has all words of a group."""
    sums = wins.rollup("group_key", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("left"))
    # The columns that a level summed over are the set low bits of ``left``.
    m = F.lit(ORDER) - F.length(F.regexp_replace(F.bin("left"), "0", ""))
    of_words = F.array_compact(F.array(*COLUMNS))
    whole = (F.size("words") == F.col("m")) & ((F.col("m") == 0) | (F.col("f") >= at_least)) & F.col("group_key").isNotNull()
    found = sums.select("group_key", m.cast("int").alias("m"), of_words.alias("words"), "f").where(whole)
    return found.select("group_key", "m", F.array_join("words", " ").alias("phrase"), "f")


def _part(words: Column, begin: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def _times(n: int, c: str) -> Column:
    """Exact product: a long times a small number may pass 64 bits."""
    return F.lit(n).cast("decimal(10,0)") * F.col(c).cast("decimal(20,0)")


def candidates(counts: DataFrame) -> DataFrame:
    """(group_key, m, phrase, a) of the phrases of two words or more."""
    return counts.where("m >= 2").select("group_key", "m", "phrase", F.col("f").alias("a"))


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(group_key, m, phrase, a, l, r, score) of each phrase, with its lowest-scoring cut."""
    cuts = phrases.withColumn("words", F.split("phrase", " ")).select("group_key", "m", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "group_key", "m", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("head"), _part(F.col("words"), F.col("k") + 1, F.col("m")).alias("tail")
    )
    short = counts.where((F.col("m") >= 1) & (F.col("m") < ORDER))
    heads = short.select("group_key", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = short.select("group_key", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cut = cuts.join(heads, ["group_key", "head"]).join(tails, ["group_key", "tail"])
    both = "(cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    score = F.expr(f"cast((cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div {both} as bigint)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cut.groupBy("group_key", "m", "phrase", "a").agg(best).select("group_key", "m", "phrase", "a", "cut.l", "cut.r", "cut.score")


def not_inside(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """``phrases`` without those that stand inside a longer one that is ``percent`` of 100 times as frequent, or more."""
    longer = phrases.where("m > 2").select("group_key", "a", "m", F.split("phrase", " ").alias("words"))
    spans = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda i: _part(F.col("words"), i, n)))
    )
    inside = longer.select("group_key", F.explode(spans).alias("phrase"), "a").groupBy("group_key", "phrase").agg(F.max("a").alias("around"))
    kept = F.col("around").isNull() | (_times(100, "around") < _times(percent, "a"))
    return phrases.join(inside, ["group_key", "phrase"], "left").where(kept).drop("around")


def best_of(phrases: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each group by score, frequency and phrase with their ``rank``; the best of parts first, so that
    a group of any size is ranked from at most PARTS * k rows."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("group_key", "part").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("group_key").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def collocations(docs: DataFrame, at_least: int = 30, k: int = 2_000, text: str = "text", group: str = "lang", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): the first ``k`` phrases of each group.

    A-Z count as small letters; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. A phrase occurs at
    least ``at_least`` times (a); l and r are the frequencies of its parts at the cut that scores lowest, n all words of
    the group. Null texts are empty; a null group is ``und`` and one with a group of that name. A group without phrases
    has no rows. Groups are told apart by a 64-bit hash of their name. The texts and the phrases' counts are written once.
    """
    held, names = grouped(docs, text, group)
    counts = written(phrase_counts(windows(held, at_least, range_bytes), at_least), "phrase-counts")
    best = best_of(scored(not_inside(candidates(counts)), counts), k)
    totals = counts.where("m = 0").select("group_key", F.col("f").alias("n"))
    rows = best.join(totals, "group_key").join(names, "group_key")
    return rows.select("group", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
