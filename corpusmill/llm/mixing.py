"""Mixing sources to target weights by a low-discrepancy schedule, in built-in expressions only.

Points of the golden-ratio sequence fall on the cumulative weights: each names the source of one slot, so that any
stretch of the schedule has nearly the wanted shares. A source's k-th slot takes its k-th block of equally many
words from its documents in shuffled order, anew shuffled for each pass. Ranks and running sums are built from
sums over small ranges, so a source that holds most of the rows is not in one task.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, n_words, written

#: Words of a block.
BLOCK = 256
#: Parts of the unit interval at least; points and cumulative weights meet in them.
PARTS = 4_096
#: Rows of a range that is summed or ranked as a whole.
RANGE_ROWS = 50_000
_SPAN = 1 << 31
_GOLDEN = 1_327_217_885  # 2**31 over the golden ratio, made odd: i * _GOLDEN mod 2**31 visits every point once


class Mix(NamedTuple):
    """``rows``: the documents with _row, _size; ``sources``: target and goal of each source; ``schedule``: what each slot takes."""

    rows: DataFrame
    sources: DataFrame
    schedule: DataFrame


def cycling_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the 0-based rank of the source."""
    return (rank % 3 + 1).cast("long")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """``sizes`` (source, weight, source_size) with target: shares of the total by weight, at most ``most`` sizes each.

    What a source can't take is shared among the others by weight until none is above its limit. In the order of
    limit per weight, the limited sources come first, and the level of the rest follows from the sums before them.
    """
    limit = most * F.col("source_size")
    by = Window.orderBy(limit / F.col("weight"), "_rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = sizes.select("*", limit.alias("_limit"), F.row_number().over(by).alias("_at"), (left / weight_left).alias("_level"))
    free = F.when(F.col("_limit") / F.col("weight") > F.col("_level"), F.struct("_at", "_level"))
    level = F.min(free).over(every)
    target = F.when(level.isNull() | (F.col("_at") < level["_at"]), F.col("_limit").cast("double")).otherwise(level["_level"] * F.col("weight"))
    return levels.withColumn("target", target).drop("_limit", "_at", "_level")


def _before(df: DataFrame, value: Column, group: list[str], range_col: str) -> DataFrame:
    """(group, range, _before): sum of ``value`` over the group's earlier ranges; a row for each range."""
    sums = df.groupBy(*group, range_col).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, range_col, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))


def _points(sources: DataFrame, total: int, words: int, parts: int) -> DataFrame:
    """(slot, _rank): the source in whose stretch of the cumulative weights each slot's point lies.

    Stretches are cut at the borders of equal parts of the unit interval. In each part the stretches' beginnings and the
    points are sorted together, and a point takes the last beginning before it, so no part has a product of the two.
    """
    reach = F.sum("goal").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    stretches = sources.where("goal > 0").select("_rank", ((reach - F.col("goal")) / F.lit(words)).alias("_begin"), (reach / F.lit(words)).alias("_end"))
    last_part = F.least(F.ceil(F.col("_end") * parts) - 1, F.lit(parts - 1))
    cut = stretches.select("_rank", "_begin", F.explode(F.sequence(F.floor(F.col("_begin") * parts), F.greatest(F.floor(F.col("_begin") * parts), last_part))).alias("_part"))
    begins = cut.select("_part", F.greatest("_begin", F.col("_part") / F.lit(parts)).alias("_at"), F.lit(None).cast("long").alias("slot"), "_rank")
    point = (F.col("id") % _SPAN * _GOLDEN % _SPAN + 0.5) / _SPAN
    points = sources.sparkSession.range(total).select(F.floor(point * parts).alias("_part"), point.alias("_at"), F.col("id").alias("slot"), F.lit(None).cast("int").alias("_rank"))
    order = Window.partitionBy("_part").orderBy("_at", F.col("slot").asc_nulls_first(), F.col("_rank").asc())
    filled = begins.unionByName(points).withColumn("_rank", F.last("_rank", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.where(F.col("slot").isNotNull()).select("slot", "_rank")


def _slots(sources: DataFrame, block: int, total: int, words: int, n_sources: int) -> DataFrame:
    """(slot, _rank, block): the schedule, each source's slots ranked from 0."""
    quota = sources.select("_rank", F.expr(f"(goal + {block - 1}) div {block}").alias("_quota"))
    parts = 1 << (max(PARTS, n_sources, total // RANGE_ROWS) - 1).bit_length()  # a power of two: borders are exact
    points = _points(sources, total, max(1, words), parts).withColumn("_range", F.expr(f"slot div {RANGE_ROWS}"))
    within = F.row_number().over(Window.partitionBy("_rank", "_range").orderBy("slot"))
    ranked = points.withColumn("_n", within).join(_before(points, F.lit(1), ["_rank"], "_range"), ["_rank", "_range"])
    ranked = ranked.select("slot", "_rank", (F.col("_before") + F.col("_n") - 1).alias("block"))
    # The sequence gives a source a few slots more or less than its words need: the surplus goes, the rest comes last.
    got = points.groupBy("_rank").agg(F.count(F.lit(1)).alias("_got"))
    short = quota.join(got, "_rank", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).where(F.col("_got") < F.col("_quota"))
    missing = short.select("_rank", F.explode(F.sequence("_got", F.col("_quota") - 1)).alias("block"))
    last = F.lit(total) + F.row_number().over(Window.orderBy("block", "_rank")) - 1
    kept = ranked.join(quota, "_rank").where(F.col("block") < F.col("_quota")).drop("_quota")
    return kept.unionByName(missing.select(last.alias("slot"), "_rank", "block"))


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", size: Column | None = None, text: str = "text", seed: int = 1, block: int = BLOCK, most: int = 3, keep: bool = False) -> Mix:
    """A schedule of the documents' words in which each source has its target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A source's goal is its target rounded to whole words,
    and its slots take just that many: the last one is cut. Documents are shuffled by md5 of seed, pass and id; rows
    with the same id follow by size. A document comes once in each pass, so at most ``most`` times. Null text and texts
    without words have size 0 and are never scheduled; an empty table gives an empty schedule. Every row counts, also
    repeated ones; other columns are kept in ``rows`` with ``keep``, else only id and source are.

    ``schedule``: slot, block, _rank (the source's), _row, pass, start and end (words of the document, half open).
    """
    sized = docs if keep else docs.select(id_col, source, *([text] if size is None else []))
    sized = sized.withColumn("_size", F.coalesce(size if size is not None else n_words(text), F.lit(0)).cast("long"))
    sized = sized if keep or size is not None else sized.drop(text)
    rows = written(sized.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    per_source = rows.groupBy(F.col(source).cast("string").alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    # One row for each source from here on.
    ranked = per_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = targets(ranked.withColumn("weight", cycling_weight(F.col("_rank"))), most)
    sources = written(weighed.withColumn("goal", F.round("target").cast("long")), "mix-sources")
    sums = [F.count(F.lit(1)), F.sum("n_rows"), F.sum("goal"), F.sum(F.expr(f"(goal + {block - 1}) div {block}"))]
    n_sources, n_rows, words, total = (x or 0 for x in sources.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first())
    slim = rows.select("_row", F.col(id_col).cast("string").alias("_id"), F.col(source).cast("string").alias("source"), "_size").where("_size > 0")
    known = sources.select(F.col("source").alias("_source"), "_rank", "source_size", "goal").where("goal > 0")
    passes = slim.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_row", "_id", "_size", "_rank", "source_size", "goal", F.explode(F.expr("sequence(0, cast((goal - 1) div source_size as int))")).alias("pass")
    )
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), "pass", F.coalesce("_id", F.lit(""))).cast("binary"))
    digits = max(2, math.ceil(math.log(max(1, n_rows / RANGE_ROWS), 16)))
    placed = passes.withColumn("_key", shuffled).withColumn("_range", F.substring("_key", 1, digits))
    group = ["_rank", "pass"]
    inside = Window.partitionBy(*group, "_range").orderBy("_key", "_size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("pass") * F.col("source_size") + F.col("_before") + F.sum("_size").over(inside)
    runs = (
        placed.join(_before(placed, F.col("_size"), group, "_range"), [*group, "_range"])
        .withColumn("_end", end)
        .withColumn("_start", F.col("_end") - F.col("_size"))
        .withColumn("_stop", F.least("_end", "goal"))
        .where(F.col("_start") < F.col("_stop"))
    )
    pieces = runs.select("_row", "_rank", "pass", "_start", "_stop", F.explode(F.expr(f"sequence(_start div {block}, (_stop - 1) div {block})")).alias("block"))
    start = F.greatest(F.col("block") * block, F.col("_start")) - F.col("_start")
    stop = F.least((F.col("block") + 1) * block, F.col("_stop")) - F.col("_start")
    schedule = pieces.select("_row", "_rank", "pass", "block", start.alias("start"), stop.alias("end")).join(_slots(sources, block, total, words, n_sources), ["_rank", "block"])
    return Mix(rows, sources, schedule.select("slot", "block", "_rank", "_row", "pass", "start", "end"))


def mixed_documents(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """``docs`` as the mix takes them: a document's row once for each pass that takes its first word, with its columns."""
    columns = docs.columns
    clash = [c for c in columns if c in ("_row", "_size")]
    named = docs.withColumnsRenamed({c: fresh(docs, c) for c in clash})
    m = mix(named, source, id_col, None, text, seed, keep=True)
    times = m.schedule.where("start = 0").groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    back = {fresh(docs, c): c for c in clash}
    out = m.rows.join(times, "_row").withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).drop("_row", "_size", "_times", "_time")
    return out.withColumnsRenamed(back).select(*columns)
