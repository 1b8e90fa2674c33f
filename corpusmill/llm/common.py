"""Small helpers of the operators: names that don't clash, written tables, split tests, word columns."""

from __future__ import annotations

import gc
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import scratch_path

#: Words of the contracts: runs of characters other than space and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextmanager
def batches_of(spark, rows: int):
    """Jobs begun inside hand Python at most ``rows`` rows at a time; the session's own bound comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, codec: str = "zstd", batch: int = 2_000) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir``: every later read, also by a retried task, sees the same rows.

    Python work in it gets ``batch`` rows at a time, texts of a few megabytes, so that workers stay small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with batches_of(spark, batch):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % mod


def held_out(id_col: str | Column, mod: int, value: int) -> Column:
    """True where the remainder is ``value``; a row without an id is never held out."""
    return F.coalesce(remainder(id_col, mod) == value, F.lit(False))


def as_bytes(text: str | Column) -> Column:
    """The text as UTF-8 bytes, null as no bytes."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


def words(text: str | Column) -> Column:
    """Array of the text's words; null as no words."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    """Number of words without building them: starts of runs."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    A plain column used inside a lambda is put in place of its name by the optimizer and then
    computed again for each element; a lambda's own argument never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def released(spark) -> None:
    """Let go of shuffle files of passes whose results are written.

    Spark deletes them once the driver's collector has found that nothing refers to them, which takes two rounds:
    the first frees what Python held. Passes over a whole corpus leave files as large as the corpus.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
