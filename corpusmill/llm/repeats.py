"""Removal of repeated passages by previous factors in suffix order.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. In suffix order
such a string's earlier copies are among the neighbours with which it has ``length`` bytes in common: the previous
or the next one of a smaller document, if there is any, is its longest previous factor. Only whether that factor reaches
``length`` is asked, which the least document of a run of neighbours tells; the arrays of lengths are not kept.

The suffixes of a whole corpus can't be sorted in one place, so the texts are cut around anchors: of the k-grams in
each window of ``length`` bytes the one with the least hash. Two documents that share such a window share its
anchor. An anchor's context holds all windows over it; equal contexts of different documents are one string with
its first document, and where an anchor has several contexts, their suffixes are sorted and compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.blocks import NO_ID, blocks, bucket_of, each, from_steps, slices, spread, squeezed, steps, unpacked
from corpusmill.llm.common import released, written

LENGTH = 50
#: Bytes of an anchor. Longer anchors have fewer chance meetings, shorter ones are sparser.
GRAM = 20
#: Bytes of text for which one range of hashes is made.
BUCKET_BYTES = 16 << 20
#: Contexts of one anchor that are sorted together; a more common anchor's windows are dealt out one by one.
HOT = 100_000
_SEGMENT = 1 << 20
_NOTHING, _COPY, _COMPARE, _SPREAD = range(4)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """32-bit hash of the k bytes from each place on, by doubling."""
    n = len(b) - k + 1
    power, base = 0x9E3779B1, 1 << 32
    level, size, h, done = _mix(np.arange(256, dtype=np.uint64)).astype(np.uint32)[b], 1, None, 0
    while True:
        if k & size:
            part = level[done : done + n]
            h = part.copy() if h is None else h * np.uint32(pow(power, size, base)) + part
            done += size
        if done == k:
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            return h ^ (h >> np.uint32(13))
        level = level[:-size] * np.uint32(pow(power, size, base)) + level[size:]
        size *= 2


def _word_hash(rows: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    h = np.full(len(rows), seed, np.uint64)
    for word in padded.view(np.uint64).T:
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return _mix(h)


class _Anchored:
    """A block's texts side by side, by id, with zeros between; their anchors: place, text, hashes of the surroundings.

    ``gram``: the anchor; ``left`` and ``right``: with half the margin before or after it; ``context``: with all of
    both margins and where the text ends in them. A string of ``length`` bytes over an anchor has ``left`` or ``right``.
    """

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int, gram: int) -> None:
        self.length, self.size, self.margin = length, gram, length - gram
        self.by_id = np.argsort(ids, kind="stable")
        self.ids, texts = ids[self.by_id], [texts[i] for i in self.by_id]
        sizes = np.array([len(t) for t in texts], np.int64)
        gap = bytes(length)
        self.buf = np.frombuffer(gap + b"".join(x for t in texts for x in (t, gap)) + gap, np.uint8)
        self.starts = length + np.cumsum(sizes + length) - sizes - length
        self.ends = self.starts + sizes
        self.places = self._places()
        self.doc = np.searchsorted(self.starts, self.places, "right") - 1
        parts = [self._hashes(np.arange(i, min(len(self.places), i + 65_536))) for i in range(0, len(self.places), 65_536)]
        self.gram, self.left, self.right, self.context = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint64) for k in range(4))

    def _places(self) -> np.ndarray:
        """For each window of a text the place of the least gram hash, the leftmost of equal ones."""
        w, found = self.margin + 1, []
        for lo in range(0, max(0, len(self.buf) - self.length + 1), _SEGMENT):
            h = _gram_hashes(self.buf[lo : lo + _SEGMENT + self.length - 1], self.size)
            least = h.astype(np.uint64) << np.uint64(32)
            least |= np.arange(len(h), dtype=np.uint64)
            size = 1
            while 2 * size <= w:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < w:
                least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
            change = np.zeros(len(least) + 1, np.int32)
            inside = (self.ends - self.starts >= self.length) & (self.ends - self.length >= lo) & (self.starts < lo + len(least))
            np.add.at(change, np.clip(self.starts[inside] - lo, 0, len(least)), 1)
            np.add.at(change, np.clip(self.ends[inside] - self.length + 1 - lo, 0, len(least)), -1)
            picked = np.zeros(len(h), bool)
            picked[(least[np.cumsum(change[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
            found.append(np.flatnonzero(picked) + lo)
        if len(found) > 1:
            return np.unique(np.concatenate(found))
        return found[0] if found else np.empty(0, np.int64)

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts as rows of bytes, and where in them the text begins and ends; outside they are zero."""
        size = self.length + self.margin
        first = self.places[which] - self.margin
        rows = np.lib.stride_tricks.sliding_window_view(self.buf, size)[first]
        lo = np.maximum(self.starts[self.doc[which]] - first, 0)
        return rows, lo, np.minimum(self.ends[self.doc[which]] - first, size)

    def _hashes(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        rows, lo, hi = self.strings(which)
        m, half, end = self.margin, self.margin // 2, self.margin + self.size
        gram = _word_hash(rows[:, m:end], 1)
        left = _mix(gram + _word_hash(rows[:, m - half : m], 2))
        right = _mix(gram + _word_hash(rows[:, end : end + half], 3))
        outer = _word_hash(rows[:, : m - half], 4) + np.uint64(3) * _word_hash(rows[:, end + half :], 5)
        return gram, left, right, _mix(_mix(left + outer) + right + (lo * 1_000_003 + hi).astype(np.uint64))


class _Entries:
    """A block's distinct contexts with their first text's id, in the order of their gram's hash."""

    def __init__(self, a: _Anchored) -> None:
        _, first, of = np.unique(a.context, return_index=True, return_inverse=True)  # the first has the smallest id
        order = np.argsort(a.gram[first])
        first = first[order]
        self.gram, self.left, self.right, self.context = a.gram[first], a.left[first], a.right[first], a.context[first]
        self.first = a.ids[a.doc[first]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of = place[of]  # each anchor's entry


#: Gram (steps of its place in the range), context, left, right, first id; hashes are cut to what tells a range's entries apart.
_ENTRY = ("<u4", "<u4", "<u2", "<u2", "u1", "<u2", "u1", "<i8")


def _packed(e: _Entries, place: np.ndarray, x: int, y: int) -> bytes:
    c, left, right = e.context[x:y], e.left[x:y], e.right[x:y]
    cut = lambda h: (h.astype("<u2"), (h >> np.uint64(16)).astype("u1"))
    return squeezed(steps(place[x:y].astype("<u4")), c.astype("<u4"), (c >> np.uint64(32)).astype("<u2"), *cut(left), *cut(right), e.first[x:y])


def _ask(length: int, gram: int, buckets: int):
    def run(frames):
        for f in frames:
            for row in each(f):
                ids, _, texts = unpacked(row)
                e = _Entries(_Anchored(ids, texts, length, gram))
                bucket, place = bucket_of(e.gram, buckets)
                place >>= np.uint64(8)
                out = [(b, row.block, _packed(e, place, x, y)) for b, x, y in slices(bucket)]
                yield pd.DataFrame(out, columns=["bucket", "block", "blob"])

    return run


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each row is in."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.cumsum(np.append(False, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def _met(*keys: np.ndarray) -> np.ndarray:
    """Whether another row has the same keys."""
    order = np.lexsort(keys)
    run = _runs(*[k[order] for k in keys])
    out = np.empty(len(order), bool)
    out[order] = np.bincount(run)[run] > 1 if len(run) else run
    return out


def _answer(hot: int):
    """For each entry of a range: nothing, a copy of an earlier text's context, or a context to compare."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [spread(b, *_ENTRY) for b in frame["blob"]]
        column = [np.concatenate([p[k] for p in parts]) for k in range(len(_ENTRY))]
        join = lambda low, high, bits: column[low].astype(np.uint64) | (column[high].astype(np.uint64) << np.uint64(bits))
        gram = np.concatenate([from_steps(p[0]) for p in parts])
        context, left, right, doc = join(1, 2, 32), join(3, 4, 16), join(5, 6, 16), column[7]
        order = np.lexsort((doc, context, gram))
        g, c, d = gram[order], context[order], doc[order]
        same = _runs(g, c)
        first = np.append(True, same[1:] != same[:-1])
        flag = np.where(d > d[first][same], _COPY, _NOTHING).astype(np.uint8)
        one = order[first]  # of each context its first entry
        many = np.bincount(_runs(gram[one]))[_runs(gram[one])]
        some = np.flatnonzero(many > 1)
        meets = _met(left[one[some]], gram[one[some]]) | _met(right[one[some]], gram[one[some]])
        need = np.full(len(one), _NOTHING, np.uint8)
        need[some[meets]] = np.where(many[some[meets]] > hot, _SPREAD, _COMPARE)
        flags = np.empty(len(order), np.uint8)
        flags[order] = np.where(flag == _COPY, flag, need[same])
        sizes = np.cumsum([0, *[len(p[0]) for p in parts]])
        blobs = [squeezed(flags[a:b]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "blob": blobs})

    return run


def _covered(length: int, gram: int, buckets: int):
    """What the answers settle, as intervals, and the contexts that must be compared, each to its range's owner."""

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in each(block):
            ids, _, texts = unpacked(row)
            a = _Anchored(ids, texts, length, gram)
            if not len(a.places):
                continue
            e = _Entries(a)
            flags = np.concatenate([spread(b, "u1")[0] for b in answers.sort_values("bucket")["blob"]])
            flag, later = flags[e.of], a.ids[a.doc] > e.first[e.of]
            begin = np.maximum(a.places - a.margin, a.starts[a.doc]) - a.starts[a.doc]
            end = np.minimum(a.places + length, a.ends[a.doc]) - a.starts[a.doc]
            copy = (flag == _COPY) | later
            own = a.by_id[a.doc]  # the text's number in the block
            out.append((-1, row.block, _merged(own[copy], begin[copy], end[copy])))
            for which, single in ((np.flatnonzero((flag == _COMPARE) & ~copy), False), (np.flatnonzero((flag == _SPREAD) & ~copy), True)):
                if not len(which):
                    continue
                rows, lo, hi = a.strings(which)
                owner, place, doc = a.gram[which], begin[which], a.doc[which]
                if single:  # each window on its own, dealt by its content
                    starts = [np.arange(x, y - length + 1) for x, y in zip(lo, hi, strict=True)]
                    at, first = np.repeat(np.arange(len(which)), [len(x) for x in starts]), np.concatenate(starts)
                    place, doc = place[at] + first - lo[at], doc[at]
                    rows = np.lib.stride_tricks.sliding_window_view(a.buf, length)[a.starts[doc] + place]
                    lo, hi, owner = np.zeros(len(at), np.int64), np.full(len(at), length), _word_hash(rows, 6)
                order = np.argsort(owner)
                for b, x, y in slices(bucket_of(owner[order], buckets)[0]):
                    some = order[x:y]
                    text = b"".join(rows[i, lo[i] : hi[i]].tobytes() for i in some)
                    head = squeezed(owner[some].astype("<u4"), a.ids[doc[some]], a.by_id[doc[some]], place[some], (hi - lo)[some].astype("<u1"))
                    out.append((b, row.block, len(head).to_bytes(8, "little") + head + squeezed(np.frombuffer(text, np.uint8))))
        return pd.DataFrame(out, columns=["bucket", "block", "blob"])

    return run


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """The intervals, those of a text that touch made one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if len(doc):
        reach = np.maximum.accumulate(end + doc * (1 << 40))  # ends so far, over the texts in a row
        new = np.append(True, begin[1:] + doc[1:] * (1 << 40) > reach[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
        doc, begin, end = doc[new], begin[new], reach[last] - doc[last] * (1 << 40)
    return squeezed(doc.astype("<i8"), begin.astype("<i8"), end.astype("<i8"))


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes' first ``length`` symbols, rank of each place); symbol 0 ends a string.

    Prefix doubling: ranks of seven symbols from packed numbers, then of twice as many from pairs of ranks.
    """
    n = len(text)
    size = min(7, length)
    padded = np.append(text.astype(np.int64), np.zeros(length, np.int64))
    key = np.zeros(n, np.int64)
    for i in range(size):
        key = (key << 9) | padded[i : n + i]
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = _runs(key[order])
        if size == length:
            return order, rank
        step = min(size, length - size)
        key = (rank + 1) * (n + 2) + np.append(rank[step:] + 1, np.zeros(step, np.int64))
        size += step


def has_previous(text: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor of each place reaches ``length``: a copy of so many symbols in a smaller document.

    In suffix order, places with ``length`` symbols in common are neighbours. The previous or next smaller one of
    such a run exists for every place but those of the run's smallest document.
    """
    order, rank = suffix_order(text, length)
    run = rank[order]
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    least = np.minimum.reduceat(doc[order], starts)
    out = np.empty(len(text), bool)
    out[order] = least[run] < doc[order]
    return out


#: Contexts that are sorted at once, those of one anchor together.
_AT_ONCE = 20_000


def _compare(length: int):
    """Contexts of one range of anchors to the intervals that earlier documents cover."""

    def previous(ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, first, last): the first and last place with a previous factor, of the contexts that have one."""
        ends = np.cumsum(sizes)
        text = np.insert(raw.astype(np.int16) + 1, ends, 0)  # a symbol that ends each context
        starts = ends - sizes + np.arange(len(sizes))
        found = has_previous(text, np.repeat(ids, sizes + 1), length)
        found &= np.arange(len(text)) - np.repeat(starts, sizes + 1) <= np.repeat(sizes, sizes + 1) - length
        hit = np.flatnonzero(np.add.reduceat(found, starts, dtype=np.int64))
        at = np.flatnonzero(found)
        return hit, at[np.searchsorted(at, starts[hit])] - starts[hit], at[np.searchsorted(at, starts[hit] + sizes[hit]) - 1] - starts[hit]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        heads, texts = [], []
        for blob in frame["blob"]:
            size = int.from_bytes(blob[:8], "little")
            heads.append(spread(blob[8 : 8 + size], "<u4", "<i8", "<i8", "<i8", "<u1"))
            texts.append(spread(blob[8 + size :], "u1")[0])
        owner, ids, doc, place, sizes = (np.concatenate([h[k] for h in heads]) for k in range(5))
        sizes = sizes.astype(np.int64)
        row = np.repeat(np.arange(len(frame)), [len(h[0]) for h in heads])
        raw = np.concatenate(texts)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(owner, kind="stable")
        bounds = np.append(np.flatnonzero(np.append(True, np.diff(owner[order].astype(np.int64)) != 0)), len(order))
        out: list[list[np.ndarray]] = [[] for _ in range(len(frame))]
        lo = 0
        while lo < len(order):
            hi = int(bounds[max(np.searchsorted(bounds, lo + _AT_ONCE, "right") - 1, np.searchsorted(bounds, lo, "right"))])
            some = order[lo:hi]
            bytes_of = np.repeat(starts[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(sizes[some].sum())
            hit, first, last = previous(ids[some], sizes[some], raw[bytes_of])
            some = some[hit]
            found = np.stack([doc[some], place[some] + first, place[some] + last + length])
            for i in np.unique(row[some]):
                out[i].append(found[:, row[some] == i])
            lo = hi
        merged = [(block, _merged(*np.concatenate(parts, axis=1))) for block, parts in zip(frame["block"], out, strict=True) if parts]
        return pd.DataFrame(merged, columns=["block", "blob"])

    return run


def _cut(with_text: bool):
    """Each text of a block without its covered bytes."""

    def run(block: pd.DataFrame, intervals: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in each(block):
            ids, _, texts = unpacked(row)
            parts = [spread(b, "<i8", "<i8", "<i8") for b in intervals["blob"]] or [[np.empty(0, np.int64)] * 3]
            doc, begin, end = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((begin, doc))
            doc, begin, end = doc[order], begin[order], end[order]
            edges = np.searchsorted(doc, np.arange(len(texts) + 1))
            for i, text in enumerate(texts):
                spans: list[list[int]] = []
                for b, e in zip(begin[edges[i] : edges[i + 1]].tolist(), end[edges[i] : edges[i + 1]].tolist(), strict=True):
                    if spans and b <= spans[-1][1]:
                        spans[-1][1] = max(e, spans[-1][1])
                    else:
                        spans.append([b, e])
                kept = b"".join(text[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(text)], strict=True))
                one = (int(ids[i]), len(text), len(text) - len(kept), [x for s in spans for x in s], hashlib.sha256(kept).hexdigest())
                out.append((*one, kept) if with_text else one)
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "spans", "kept_sha256", *(["kept"] if with_text else [])])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) for each row, and ``kept`` (bytes) with ``with_text``.

    Texts are UTF-8 bytes, null an empty one; a text under ``length`` bytes keeps all. The id must be a whole number;
    rows with the same id never take from each other, and a row without an id counts as the last: it loses what any
    other has and takes from none. ``spans``: begin and end of each maximal removed run, one after the other. Other
    columns aren't read. An empty table gives no rows. A kept text may begin or end inside a character.
    """
    held = blocks(docs, id_col, text)
    total = held.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    asked = held.mapInPandas(_ask(length, gram, buckets), "bucket int, block string, blob binary")
    answers = asked.groupBy("bucket").applyInPandas(_answer(hot), "block string, bucket int, blob binary")
    settled = held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_covered(length, gram, buckets), "bucket int, block string, blob binary")
    settled = written(settled, "repeats", "uncompressed")
    del asked, answers
    released(docs.sparkSession)
    compared = settled.where("bucket >= 0").groupBy("bucket").applyInPandas(_compare(length), "block string, blob binary")
    intervals = settled.where("bucket < 0").select("block", "blob").unionByName(compared)
    schema = "id long, n_bytes long, n_removed long, spans array<long>, kept_sha256 string" + (", kept binary" if with_text else "")
    out = held.groupBy("block").cogroup(intervals.groupBy("block")).applyInPandas(_cut(with_text), schema)
    back = F.when(F.col("id") != NO_ID, F.col("id")).cast(docs.schema[id_col].dataType)
    return out.withColumn("id", back).withColumnRenamed("id", id_col)
