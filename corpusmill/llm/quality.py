"""Quality rules as a short-circuit cascade, in built-in expressions only.

What a rule costs and how much it rejects are estimated on a bounded sample; the rules are then tried in the order
of rejections per cost, and a text that one rule rejects is not looked at by the rest. The order changes the time a
run takes and which rule is named for a text that several reject, never whether the text is kept.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACE, fresh, let, words, written

SYMBOLS = "#*$%&|<>"
#: Rows of the sample; at most so many are read for the estimates.
SAMPLE_ROWS = 1_000


class Rule(NamedTuple):
    name: str
    rejects: Column


def repeated_words(ws: Column, window: int = 8) -> Column:
    """Words of the array that lie in windows found twice or more, the first find included.

    Windows are compared by 64-bit hash. Their sorted (hash, place) pairs put equal ones side by side; the places
    are then sorted again and their overlaps counted once: n log n for a text of n words.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(o: Column) -> Column:
            same = lambda x, k: (F.get(o, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(o, k + 1)["h"].eqNullSafe(x["h"]))
            return F.sort_array(F.filter(F.transform(o, lambda x, k: F.when(same(x, k), x["i"])), lambda i: i.isNotNull()))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            F.aggregate(let(pairs, places), start, step)["n"]
        )

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    windows = lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs) - window + 1), lambda i: F.xxhash64(F.slice(hs, i, window)))
    return F.when(F.size(ws) > window, let(let(hashed, windows), covered)).otherwise(F.lit(0).cast("long"))


def measures(text: str = "text") -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; null counts as the empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
    of_words = let(words(text), lambda ws: F.struct(F.size(ws).alias("n"), repeated_words(ws).alias("repeat")))
    chars = F.length(F.regexp_replace(t, SPACE, ""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n"].cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            m["l"]["n"].cast("long").alias("n_lines"),
            m["l"]["dup"].cast("long").alias("n_dup_lines"),
            m["w"]["repeat"].alias("n_repeat_words"),
        ),
    )


def base_failed(m: str) -> Column:
    """Under 20 words, or over 30 of 100 words in repeated windows."""
    return (F.col(m)["n_words"] < 20) | (100 * F.col(m)["n_repeat_words"] > 30 * F.col(m)["n_words"])


def default_rules(m: str, text: str = "text") -> list[Rule]:
    """Rules over a text and its measures ``m``. They reject what no prose has, in whatever language."""
    c, t = F.col(m), F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))
    stops = F.length(t) - F.length(F.regexp_replace(t, r"[.!?。！？]", ""))
    distinct = let(F.transform(words(text), F.lower), lambda ws: F.size(F.array_distinct(ws))).cast("long")
    # A text's vocabulary grows with the root of its length, a tenth of its words up to 1,000 of them.
    few = let(distinct, lambda d: (10 * d < c["n_words"]) & (d * d < 10 * c["n_words"]))
    stutter = let(words(text), lambda ws: F.size(F.filter(F.transform(ws, lambda w, i: w == F.get(ws, i - 1)), lambda same: same)))
    return [
        Rule("stutter", stutter > 0.3 * c["n_words"]),
        Rule("symbols", c["n_symbols"] > 0.1 * c["n_words"]),
        Rule("word_length", (c["word_chars"] < 2.5 * c["n_words"]) | (c["word_chars"] > 12 * c["n_words"])),
        Rule("duplicate_lines", 2 * c["n_dup_lines"] > c["n_lines"]),
        Rule("letters", letters < 0.7 * c["word_chars"]),
        Rule("capitals", 2 * upper > letters),
        Rule("sentences", stops > 0.5 * c["n_words"]),
        Rule("few_distinct", few),
    ]


def ordered(sample: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds) by rejections per second on ``sample``, best first; ties by name."""

    def seconds(*cols: Column) -> float:
        began = time.perf_counter()
        sample.agg(*[F.sum(c.cast("int")) for c in cols], F.count(F.lit(1))).collect()
        return time.perf_counter() - began

    seconds()
    least = seconds()
    rates = sample.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(r.rejects, F.lit(False)).cast("int")).alias(f"_{i}") for i, r in enumerate(rules)]).first()
    found = [(r, (rates[f"_{i}"] or 0) / max(1, rates["_n"]), max(1e-3, seconds(r.rejects) - least)) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def sampled(df: DataFrame, rows: int, id_col: str | None) -> DataFrame:
    """Up to ``rows`` rows: those with the least hashes of their id, or without an id column the first ones."""
    if id_col is None or id_col not in df.columns:
        return df.limit(rows)
    order = F.xxhash64(F.col(id_col).cast("string"))
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(order, id_col).limit(rows).collect()
    # As values, so that the filter comes before whatever the columns are computed from.
    return df.where(F.col(id_col).isin([r[0] for r in ids])).limit(rows)


def cascade(
    df: DataFrame, rules: Sequence[Rule], first: Rule | None = None, into: str = "rejected_by", sample_rows: int = SAMPLE_ROWS, id_col: str | None = "doc_id"
) -> DataFrame:
    """``df`` with ``into``: the first rule in the estimated order that rejects the row, null for a row that is kept.

    Every row stays, once, with its columns; ``into`` gets an underscore while a column has that name. A rule that is
    null for a row doesn't reject it. ``first`` comes before all others whatever it costs. The sample is at most
    ``sample_rows`` rows of the table, whole, those with the least hashes of ``id_col``; an empty table leaves the rules
    in the order of their names.
    """
    into = fresh(df, into)
    sample = sampled(df, sample_rows, id_col)
    if first is not None:
        sample = sample.where(~F.coalesce(first.rejects, F.lit(False)))
    chain = [*([first] if first else []), *[r for r, _, _ in ordered(written(sample, "quality-sample"), rules)]]
    verdict = F.when(F.lit(False), F.lit(""))
    for r in chain:
        verdict = verdict.when(r.rejects, F.lit(r.name))
    return df.withColumn(into, verdict)
