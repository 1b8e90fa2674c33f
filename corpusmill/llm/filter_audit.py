"""Filter interaction audit: what each filter removes at each place of each order of the filters.

A document is reduced to a mask of the filters that it fails; documents of one part with the same mask and labels are
one cell with a count. Each cell is folded across the array of all orders, a constant of the plan, with ``transform``
and ``aggregate``: one struct for each order and step, weighted with the cell's count. A part's cells are merged by
sums element by element, so no row exists for a document and an order.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, let, words, written

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: A row without an id comes after all others.
NO_ID = (1 << 63) - 1


class Filter(NamedTuple):
    letter: str
    fails: Column


def text_filters(text: str = "text") -> list[Filter]:
    """A: under 50 words; B: under 65 distinct words of 100; C: over 5 capitals A-Z of 100 code points; D: a symbol."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = let(words(text), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("distinct")))
    few = let(w, lambda x: F.struct((x["n"] < 50).alias("A"), (100 * x["distinct"].cast("long") < 65 * x["n"].cast("long")).alias("B")))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long")
    return [
        Filter("A", few["A"]),
        Filter("B", few["B"]),
        Filter("C", 100 * capitals > 5 * F.length(t).cast("long")),
        Filter("D", F.rlike(t, F.lit("[#$%&*|]"))),
    ]


def failures(docs: DataFrame, filters: Sequence[Filter], repeated: str, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) of each row of ``docs``; bit k of ``mask`` is set if the row fails the k-th filter.

    The last bit, named ``repeated``, is for texts that a smaller id has too, in whatever part. Texts are compared by
    SHA-256; null is the empty text, a null part the empty string. A null id is larger than all others; rows that share
    the smallest id of a text all pass. A filter that is null for a row lets it pass.
    """
    if repeated in [f.letter for f in filters]:
        raise ValueError(f"{repeated} is the letter of another filter")
    bits = [F.when(f.fails, F.lit(1 << k)).otherwise(0) for k, f in enumerate(filters)]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    slim = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(as_bytes(text), 256)).alias("key"),
        mask.alias("mask"),
    )
    rows = written(slim, "audit-rows")  # the texts are read once
    # Joined on the text and the id: however many rows share a text, each is matched on its own.
    first = rows.groupBy("key").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    later = F.when(F.col("_first").isNull(), F.lit(1 << len(bits))).otherwise(0)
    return rows.join(first, ["key", "id"], "left").select("id", "part", (F.col("mask") + later).cast("int").alias("mask"))


def cells(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): rows of ``failures`` counted; ``labels`` has quality and toxic of some ids.

    A document without labels is neither good nor toxic; one that is labelled twice is each if any label says so.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    said = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return failed.join(known, "id", "left").select("part", "mask", *said).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of ``letters`` and step: COUNTS, and the filter's removals summed over all orders.

    ``letters`` names the bits of ``mask``, the lowest first. A part has at most 4 cells a mask, so its cells fit a row.
    No parts, no rows; a part has all its rows, zeros included.
    """
    orders = ["".join(o) for o in permutations(sorted(letters))]
    as_bits = "array(" + ",".join("array(" + ",".join(str(1 << letters.index(x)) for x in o) + ")" for o in orders) + ")"
    spots = "array(" + ",".join(f"named_struct('filter_order','{o}','step',{i + 1},'letter','{x}')" for o in orders for i, x in enumerate(o)) + ")"
    long = lambda test: f"if({test}, c.n, 0L)"
    fails, gone = "(c.mask & bit) <> 0", "(c.mask & s.before) <> 0"
    counted = {
        "kept": long(f"not ({gone}) and not ({fails})"),
        "removed": long(f"{fails} and not ({gone})"),
        "redundant": long(f"{fails} and {gone}"),
        "unique_fails": long("c.mask = bit"),
        "good_lost": long(f"{fails} and not ({gone}) and c.good = 1"),
        "toxic_lost": long(f"{fails} and not ({gone}) and c.toxic = 1"),
    }
    none = "named_struct(" + ",".join(f"'{k}',0L" for k in COUNTS) + ")"
    one = "named_struct(" + ",".join(f"'{k}',{counted[k]}" for k in COUNTS) + ")"
    both = "named_struct(" + ",".join(f"'{k}',x.{k}+y.{k}" for k in COUNTS) + ")"
    along = f"""aggregate(o, named_struct('before', 0, 'steps', slice(array({none}), 1, 0)),
        (s, bit) -> named_struct('before', s.before | bit, 'steps', concat(s.steps, array({one}))), s -> s.steps)"""
    folded = f"flatten(transform({as_bits}, o -> {along}))"
    merged = f"aggregate(cells, array_repeat({none}, {len(orders) * len(letters)}), (sums, c) -> zip_with(sums, {folded}, (x, y) -> {both}))"
    total = lambda x: f"aggregate(zip_with({spots}, sums, (p, x) -> if(p.letter = '{x}', x.removed, 0L)), 0L, (a, v) -> a + v)"
    shapley = "map(" + ",".join(f"'{x}',{total(x)}" for x in letters) + ")"
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    summed = by_part.select("part", F.expr(merged).alias("sums"))
    shared = summed.select("part", "sums", F.expr(shapley).alias("shapley"))
    rows = shared.select("part", "shapley", F.inline(F.expr(f"zip_with({spots}, sums, (p, x) -> named_struct('spot', p, 'x', x))")))
    return rows.select("part", "spot.filter_order", "spot.step", *[f"x.{k}" for k in COUNTS], F.expr("shapley[spot.letter]").alias("shapley"))
