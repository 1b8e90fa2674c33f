"""Line deduplication by pairwise alignment.

Documents meet by hashes of runs of lines: the shortest runs with words enough to go, which are far rarer than single
lines. A document is aligned with the earlier holders of its runs, by patience diff: lines that are unique in
both and lie in the same order anchor the alignment, runs of equal lines grow from them, and the gaps between are aligned
in the same way. Aligned runs go from the later document. What goes is what goes beside any earlier holder, however many
there are; the earliest comes first, and others only for runs of which a line stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, fresh, written

#: Words of a run that is removed at least: shorter common lines are no copy.
MIN_WORDS = 5
#: Lines without a partner, in what one text shows of another: no pair needs to know how many or which.
_GAP = "~"
#: Texts of a run see its holders by lines that one pair in so many shares.
_WIDE = 16


def _rising(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
        back[i] = piles[k - 1] if k else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in ``a``, in ``b``), ascending in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        both = [(i, at_b[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at_b]
        anchors = [both[k] for k in _rising([j for _, j in both])]
        found += anchors
        for (i, j), (m, n) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors and i + 1 < m and j + 1 < n:
                todo.append((i + 1, m, j + 1, n))
    return sorted(found)


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes and words of each text's lines that have a word; blank lines are never aligned."""
    for b in batches:
        rows = []
        for key, order, text in zip(b["key"], b["order"], b["text"], strict=True):
            lines = text.split(b"\n")
            kept = [(i, xxhash.xxh3_64_intdigest(x.strip()) - (1 << 63), len(x.split())) for i, x in enumerate(lines) if x.split()]
            at, hashes, words = zip(*kept, strict=True) if kept else ((), (), ())
            rows.append((key, order, len(lines), list(at), list(hashes), list(words)))
        yield pd.DataFrame(rows, columns=["key", "order", "n_lines", "at", "hashes", "words"])


def _runs(min_words: int):
    """Each text's shortest runs with ``min_words`` words, from each line on and up to each line, by hash, each once.

    Every longer run is covered by those within it. Of texts with lines that are ``gone``, only runs of which a line stays.
    """
    least = max(1, min_words)

    def of_text(hashes: np.ndarray, words: np.ndarray, gone: np.ndarray | None = None) -> np.ndarray:
        n = len(words)
        sums = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
        lo = np.append(np.arange(n), np.searchsorted(sums, sums[1:] - least, "right") - 1)
        hi = np.append(np.searchsorted(sums, sums[:-1] + least) - 1, np.arange(n))
        inside = (lo >= 0) & (hi < n)
        lo, hi = lo[inside], hi[inside]
        if gone is not None:
            left = np.concatenate(([0], np.cumsum(~gone)))
            stays = left[hi + 1] > left[lo]
            lo, hi = lo[stays], hi[stays]
        line, h, k = hashes.astype(np.int64).view(np.uint64), np.zeros(len(lo), np.uint64), 0
        left = np.arange(len(lo))
        while len(left):
            x = (h[left] + line[lo[left] + k]) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h[left] = x ^ (x >> np.uint64(32))
            k += 1
            left = left[lo[left] + k <= hi[left]]
        return np.unique(h).view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = zip(b["hashes"], b["words"], strict=True)
            if "gone" in b:
                found = [of_text(h, w, np.isin(at, g)) for (h, w), at, g in zip(of, b["at"], b["gone"], strict=True)]
            else:
                found = [of_text(h, w) for h, w in of]
            places = np.repeat(b["place"].to_numpy(), [len(f) for f in found])
            yield pd.DataFrame({"place": places, "hash": np.concatenate(found) if found else np.empty(0, np.int64)})

    return run


def _aligned(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, at, a, words, other in zip(b["later"], b["at"], b["hashes"], b["words"], b["others"], strict=True):
                other = [None if x == _GAP else int(x) for x in other.split(",")] if isinstance(other, str) else other.tolist()
                pairs, runs = patience(a.tolist(), other), []
                for i, j in pairs:
                    if runs and runs[-1][-1] == (i - 1, j - 1):
                        runs[-1].append((i, j))
                    else:
                        runs.append([(i, j)])
                gone = [int(at[i]) for r in runs if sum(int(words[i]) for i, _ in r) >= min_words for i, _ in r]
                if gone:
                    out.append((key, gone))
            yield pd.DataFrame(out, columns=["place", "gone"])

    return run


def _removals(texts: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """(place, gone): lines of each later text that are aligned with the earlier one, for each pair that has some."""
    mine = texts.select(F.col("place").alias("later"), "at", "hashes", "words")
    others = texts.select(F.col("place").alias("earlier"), F.col("hashes").alias("others"))
    aligned = pairs.join(others, "earlier").join(mine, "later").select("later", "at", "hashes", "words", "others")
    return aligned.mapInPandas(_aligned(min_words), "place long, gone array<int>")


def _open_runs(texts: DataFrame, runs: DataFrame, places: DataFrame, gone: DataFrame, min_words: int) -> DataFrame:
    """(later, hash) of the runs in texts of ``places`` that an earlier text has and of which a line stays."""
    lost = gone.groupBy("place").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    partly = texts.join(places, "place").join(lost, "place", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    staying = partly.select("place", "at", "hashes", "words", "gone").mapInPandas(_runs(min_words), "place long, hash long")
    first = runs.groupBy("hash").agg(F.min("place").alias("first"))
    return staying.join(first, "hash").where(F.col("first") < F.col("place")).select(F.col("place").alias("later"), "hash")


def _shown() -> Column:
    """The lines ``s`` (i, line) of a text of ``n`` lines, in order, and where others stand between."""
    before = lambda k: F.when(k > 0, F.get("s", k - 1)["i"]).otherwise(-1)
    marks = F.transform("s", lambda x, k: F.concat(F.when(x["i"] > before(k) + 1, f"{_GAP},").otherwise(""), x["line"].cast("string")))
    end = F.when(F.element_at("s", -1)["i"] < F.col("n") - 1, f",{_GAP}").otherwise("")
    return F.concat(F.array_join(marks, ","), end)


def _partners(texts: DataFrame, holders: DataFrame) -> DataFrame:
    """(hash, shared, earlier): the holders of each run, one for all that other texts align with alike, and their number
    of shared lines.

    They are told apart by the lines that a second holder has too, in order, and by where others stand between: no text
    can align with anything else of theirs. The first of them stands for all.
    """
    lines = texts.join(holders.select("place").distinct(), "place").select("place", F.size("hashes").alias("n"), F.posexplode("hashes").alias("i", "line"))
    both = lines.groupBy("line").agg(F.min("place").alias("_a"), F.max("place").alias("_b")).where("_a < _b").select("line")
    of_text = lines.join(both, "line").groupBy("place").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("s"))
    kinds = of_text.select("place", F.size("s").alias("shared"), F.md5(_shown()).alias("kind"))
    first = kinds.groupBy("kind").agg(F.min("place").alias("earlier"))
    return holders.join(kinds.join(first, "kind"), "place").select("hash", "shared", "earlier").distinct()


def _simplest(open_runs: DataFrame, partners: DataFrame) -> DataFrame:
    """(later, earlier): for each open run the earlier holder with fewest shared lines, which cross least."""
    asks = open_runs.select("hash", F.col("later").alias("place"), F.lit(None).cast("struct<shared:int,earlier:bigint>").alias("p"))
    rows = asks.unionByName(partners.select("hash", F.col("earlier").alias("place"), F.struct("shared", "earlier").alias("p")))
    before = Window.partitionBy("hash").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    best = rows.withColumn("best", F.min("p").over(before)).where("p is null and best is not null")
    return best.select(F.col("place").alias("later"), F.col("best.earlier").alias("earlier")).distinct()


def _views(texts: DataFrame, left: DataFrame, holders: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """What settles the runs that are ``left`` (later, hash) with their ``holders`` (hash, earlier): (later, view), each
    what some earlier holders show of themselves to a text, once however many they are; and (hash, later, earlier), the
    pairs that no view stands for.

    A run's wide lines are those that most pairs of its texts and holders share, its own among them. Of its wide lines
    a text has some; what a holder shows of these, and where other lines stand between, is all that the text can align
    with, unless the two share a narrow line. Pairs with a narrow line meet by it. A view counts for a text if more
    earlier holders show it than those that share a narrow line with the text.
    """
    of_texts = texts.join(left.select(F.col("later").alias("place")).distinct(), "place").select(F.col("place").alias("later"), F.explode(F.array_distinct("hashes")).alias("line"))
    mine = written(left.join(of_texts, "later").select("hash", "later", "line"), "line-asking")
    lines = texts.join(holders.select(F.col("earlier").alias("place")).distinct(), "place").select(
        F.col("place").alias("earlier"), F.size("hashes").alias("n"), F.posexplode("hashes").alias("i", "line")
    )
    spots = lines.join(mine.select("line").distinct(), "line").groupBy("earlier", "line").agg(F.max("n").alias("n"), F.collect_list("i").alias("spots"))
    theirs = written(holders.join(spots, "earlier").select("hash", "earlier", "line", "n", "spots"), "line-answering")

    by_line = mine.groupBy("hash", "line").agg(F.count(F.lit(1)).alias("t")).join(theirs.groupBy("hash", "line").agg(F.count(F.lit(1)).alias("e")), ["hash", "line"])
    of_run = left.groupBy("hash").agg(F.count(F.lit(1)).alias("all_t")).join(holders.groupBy("hash").agg(F.count(F.lit(1)).alias("all_e")), "hash")
    often = by_line.join(of_run, "hash").where(F.col("t") * F.col("e") * _WIDE >= F.col("all_t") * F.col("all_e"))
    most = often.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct((F.col("t") * F.col("e")).alias("pairs"), "line")), asc=False).alias("lines"))
    # A shortest run has min_words lines at most.
    wide = written(most.select("hash", F.explode(F.slice("lines", 1, max(1, min_words) + 3)).alias("x")).select("hash", "x.line"), "line-wide")
    narrow = mine.join(wide, ["hash", "line"], "left_anti").join(theirs.join(wide, ["hash", "line"], "left_anti").drop("n", "spots"), ["hash", "line"])
    further = written(narrow.where(F.col("earlier") < F.col("later")).select("hash", "later", "earlier").distinct(), "line-further-pairs")

    asking = written(mine.join(wide, ["hash", "line"]).groupBy("hash", "later").agg(F.array_sort(F.collect_list("line")).alias("by")), "line-wide-of-texts")
    sets = asking.select("hash", "by").distinct().select("hash", "by", F.explode("by").alias("line"))
    shows = sets.join(theirs, ["hash", "line"]).groupBy("hash", "by", "earlier").agg(
        F.max("n").alias("n"), F.array_sort(F.flatten(F.collect_list(F.transform("spots", lambda i: F.struct(i.alias("i"), F.col("line").alias("line")))))).alias("s")
    )
    shows = written(shows.select("hash", "by", "earlier", _shown().alias("view")), "line-shows")
    # How many earlier holders show a view is a running count; the texts that ask stand among them by their places.
    asks = asking.join(shows.select("hash", "by", "view").distinct(), ["hash", "by"]).select("hash", "by", "view", F.col("later").alias("place"), F.lit(0).alias("one"))
    rows = asks.unionByName(shows.select("hash", "by", "view", F.col("earlier").alias("place"), F.lit(1).alias("one")))
    before = Window.partitionBy("hash", "by", "view").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("before", F.sum("one").over(before)).where("one = 0 and before > 0").select("hash", F.col("place").alias("later"), "view", "before")
    met = further.join(asking, ["hash", "later"]).join(shows, ["hash", "by", "earlier"]).groupBy("hash", "later", "view").agg(F.count(F.lit(1)).alias("met"))
    sure = counted.join(met, ["hash", "later", "view"], "left").where(F.col("before") > F.coalesce("met", F.lit(0)))
    return sure.select("later", "view").distinct(), further


def _settled(texts: DataFrame, runs: DataFrame, pairs: DataFrame, gone: DataFrame, min_words: int) -> DataFrame:
    """``gone`` of ``pairs``, and of the further pairs that settle each run of which a line stays: with the simplest
    partner of each first, then with all partners of what still stays: by what these show, and beside each that shows more."""
    tried = pairs.select(F.col("later").alias("place")).distinct()
    open_runs = written(_open_runs(texts, runs, tried, gone, min_words), "line-open-runs")
    holders = runs.join(open_runs.select("hash").distinct(), "hash").select("place", "hash")
    partners = written(_partners(texts, written(holders, "line-holders")), "line-partners")
    second = written(_simplest(open_runs, partners).join(pairs, ["later", "earlier"], "left_anti"), "line-second-pairs")
    gone = written(gone.unionByName(_removals(texts, second, min_words)), "line-gone-second")
    left = written(_open_runs(texts, runs, open_runs.select(F.col("later").alias("place")).distinct(), gone, min_words), "line-left-runs")
    views, further = _views(texts, left, partners.join(left.select("hash").distinct(), "hash").select("hash", "earlier"), min_words)
    mine = texts.select(F.col("place").alias("later"), "at", "hashes", "words")
    aligned = views.join(mine, "later").select("later", "at", "hashes", "words", F.col("view").alias("others"))
    gone = written(gone.unionByName(aligned.mapInPandas(_aligned(min_words), "place long, gone array<int>")), "line-gone-views")
    still = _open_runs(texts, runs, left.select(F.col("later").alias("place")).distinct(), gone, min_words)
    met = further.join(still, ["later", "hash"]).select("later", "earlier").distinct()
    third = written(met.join(pairs.unionByName(second), ["later", "earlier"], "left_anti"), "line-third-pairs")
    return gone.unionByName(_removals(texts, third, min_words))


def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts without the lines of these numbers."""
    gone = [set(r.tolist()) for r in removed]
    rows = zip(texts, gone, strict=True)
    return pd.Series([b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in g).decode("utf-8", "replace") if g else "" for t, g in rows], dtype=object)


def without_aligned_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", into: str = "lines", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_lines, removed (line numbers from 0), kept (the text without them).

    Of two documents the later has the larger id, of equal ids the larger md5 of the text; null ids come last. Rows
    with the same id and text are one document, treated alike and never aligned with each other. Lines are parted by
    \\n and compared without white space at their ends. A run of aligned lines goes if it has ``min_words`` words or
    more. Null texts stay null with no line; empty texts have one line. Every row stays, once, with its columns;
    ``into`` gets an underscore while a column has that name.

    Exact copies need no alignment: all lines of a later copy are aligned with the first one's, and only the first
    takes part, with its weight of one text. Of a group of texts that share a run, each later one loses what is aligned
    with any earlier one, whatever their number; a run that patience leaves out beside each of them stays.
    """
    into = fresh(docs, into)
    at = fresh(docs, "_at")
    key = F.concat_ws(":", F.md5(as_bytes(text)), F.col(id_col).cast("string"))
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.md5(as_bytes(text)).alias("text_key"))
    named = docs.where(F.col(text).isNotNull()).select(key.alias("key"), order.alias("order"), as_bytes(text).alias("text"))
    kind = named.schema["order"].dataType.simpleString()
    schema = f"key string, `order` {kind}, n_lines int, at array<int>, hashes array<long>, words array<int>"
    rows = written(named.mapInPandas(_measured, schema), "lines")
    keys = written(rows.groupBy("key").agg(F.first("order").alias("order")), "line-keys")
    firsts = keys.groupBy("order.text_key").agg(F.min("order").alias("order"))
    one = firsts.select("order").join(rows, "order").dropDuplicates(["key"])
    # Places ascend in the order of the texts, so that slim rows can tell the earliest.
    texts = written(one.orderBy("order").withColumn("place", F.monotonically_increasing_id()), "line-texts")

    runs = written(texts.select("place", "hashes", "words").mapInPandas(_runs(min_words), "place long, hash long"), "line-runs")
    firsts_of = runs.groupBy("hash").agg(F.min("place").alias("earlier"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = runs.join(firsts_of, "hash").where(F.col("earlier") < F.col("place"))
    pairs = written(met.select(F.col("place").alias("later"), "earlier").distinct(), "line-pairs")
    gone = written(_removals(texts, pairs, min_words), "line-gone")
    gone = _settled(texts, runs, pairs, gone, min_words).select("place", F.explode("gone").alias("line"))
    found = gone.groupBy("place").agg(F.array_sort(F.collect_set("line")).alias("removed")).join(texts.select("place", "key"), "place").select("key", "removed")

    # A later copy loses every line that has a word, if they have words enough.
    copies = keys.join(firsts.select("order", F.lit(True).alias("_first")), "order", "left").where("_first is null").select("key")
    whole = rows.join(copies, "key").where(F.aggregate("words", F.lit(0), lambda a, w: a + w) >= min_words)
    removed = written(found.unionByName(whole.select("key", F.col("at").alias("removed")).dropDuplicates(["key"])), "line-removals")

    keyed = docs.withColumn(at, F.when(F.col(text).isNotNull(), key))
    out = keyed.join(removed.withColumnsRenamed({"key": at, "removed": "_removed_" + at}), at, "left")
    numbers = F.coalesce(F.col("_removed_" + at), F.array().cast("array<int>"))
    lines = F.size(F.split(F.col(text).cast("string"), "\n"))
    n_lines = F.when(F.col(text).isNotNull(), lines).otherwise(F.lit(0)).cast("long")
    kept = F.when(F.size(numbers) > 0, F.pandas_udf(_without, "string")(as_bytes(text), numbers)).otherwise(F.col(text).cast("string"))
    return out.withColumn(into, F.struct(n_lines.alias("n_lines"), numbers.alias("removed"), kept.alias("kept"))).drop(at, "_removed_" + at)
