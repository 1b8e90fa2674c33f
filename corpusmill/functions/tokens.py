"""Token measures. A measure prices one text column and, element by element, an array of texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SYMBOL_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


@dataclass(frozen=True)
class TokenMeasure:
    """``of_text``: string -> int. ``of_each``: array<string> -> array<int>.

    Both must be 0 for the empty text and at least 1 for any other, as every
    subword tokenizer is; packing relies on it to bound the size of a pack.

    ``of_line``, where tokens never cross a line feed: what a line adds to its text, string -> int. A text has the sum
    over its lines, but 1 at least unless it is empty; lines are then counted once for all pieces that hold them.
    """

    of_text: Callable[[Column], Column]
    of_each: Callable[[Column], Column]
    of_line: Callable[[Column], Column] | None = None


def word_symbol_measure() -> TokenMeasure:
    """Runs of letters, runs of digits and single symbols; stays in the JVM."""

    def found(text: Column) -> Column:
        return F.regexp_count(text, F.lit(WORD_SYMBOL_PATTERN))

    def count(text: Column) -> Column:
        return F.greatest(found(text), F.least(F.octet_length(text), F.lit(1))).cast("int")

    return TokenMeasure(count, lambda texts: F.transform(texts, count), found)


def encoder_measure(encode: Callable[[str], list]) -> TokenMeasure:
    """Wrap a caller's tokenizer (for example a BPE encoder's ``encode``) as Arrow-batched functions."""

    @F.pandas_udf("int")
    def of_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(encode(t)))

    @F.pandas_udf("array<int>")
    def of_each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: None if ts is None else [len(encode(t)) for t in ts])

    # Not because counting is random: Spark never copies a nondeterministic column into the array
    # functions that use it (where a Python function could not run) nor evaluates it twice for a filter.
    return TokenMeasure(of_text.asNondeterministic(), of_each.asNondeterministic())


def token_count(text: Column, measure: TokenMeasure | None = None) -> Column:
    return (measure or word_symbol_measure()).of_text(text)
