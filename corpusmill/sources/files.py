"""Files as rows: from a directory tree or from a table that already holds texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import texts
from corpusmill.options import Options
from corpusmill.session import cut_lineage

FILE_COLUMNS = ("path", "relative_path", "language", "content", "content_hash", "size_bytes", "line_count")


def with_measures(df: DataFrame) -> DataFrame:
    """Language, hash and line count of rows with ``relative_path``, ``content`` and ``size_bytes``."""
    return df.select(
        "path",
        "relative_path",
        texts.language_of(F.col("relative_path")).alias("language"),
        "content",
        texts.content_hash(F.col("content")).alias("content_hash"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
        texts.line_count(F.col("content")).alias("line_count"),
    )


def scan_table(df: DataFrame, text: str | Column, path_expr: str | Column) -> DataFrame:
    """The file columns over an existing table of texts; ``path_expr`` names each text."""
    path = F.expr(path_expr) if isinstance(path_expr, str) else path_expr
    content = F.col(text) if isinstance(text, str) else text
    return with_measures(
        df.select(
            path.alias("path"),
            path.alias("relative_path"),
            content.alias("content"),
            F.octet_length(content).alias("size_bytes"),
        )
    )


def with_relpath(files: DataFrame, root: str) -> DataFrame:
    """``relative_path``: ``path`` without its root (and scheme), backslashes as slashes."""
    bare_root = root.split("://", 1)[1] if "://" in root else root.removeprefix("file:")
    bare_root = "/" + bare_root.replace("\\", "/").strip("/") + "/"
    bare = F.regexp_replace(F.translate(F.col("path"), "\\", "/"), r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    return files.withColumn(
        "relative_path",
        F.when(F.startswith(bare, F.lit(bare_root)), F.substr(bare, F.lit(len(bare_root) + 1))).otherwise(bare),
    )


def exclude_dirs(files: DataFrame, names: Iterable[str] = Options().skip_dirs) -> DataFrame:
    """Drop a file when any component of its path is one of ``names``."""
    excluded = F.array(*[F.lit(n) for n in names])
    return files.filter(~F.arrays_overlap(F.split(F.col("relative_path"), "/", -1), excluded))


def size_between(files: DataFrame, lo: int, hi: int, column: str = "size_bytes") -> DataFrame:
    return files.filter(F.col(column).between(lo, hi))


def valid_text(files: DataFrame) -> DataFrame:
    """Keep rows whose binary ``content`` is UTF-8; read it with LF line ends."""
    decoded = F.col("content").cast("string")
    return files.filter(F.is_valid_utf8(decoded)).withColumn(
        "content", F.regexp_replace(decoded, "\r\n?", "\n")
    )


#: Repeated paths are sent to every task up to so many, and joined by a shuffle beyond.
BROADCAST_PATHS = 100_000
#: Bytes of texts under repeated paths for which one task is made.
TASK_BYTES = 32 << 20


def distinct_paths(files: DataFrame) -> DataFrame:
    """One row for each path: of several the one with the smallest hash of its text, whatever order they come in.

    The paths alone tell which of them repeat; that is counted here, once, and nothing else of a file is read or made for
    it. Only the rows of those are measured and shuffled with their texts, the others pass by. Their bytes tell to how many tasks they are dealt, so that a task sorts about TASK_BYTES
    however many there are; a path with more than that is first reduced where its rows are read.
    """
    row, order = F.struct(*files.columns), F.struct(F.sha2("content", 256), F.struct(*[c for c in files.columns if c != "content"]))
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content")
    counted = files.groupBy("relative_path").agg(F.count(F.lit(1)).alias("_n"))
    paths = cut_lineage(counted.filter("_n > 1").select(F.col("relative_path").alias("_repeated")))
    some = paths.count()
    if some == 0:
        return files
    few = F.broadcast if some <= BROADCAST_PATHS else lambda df: df
    same = F.col("relative_path").eqNullSafe(F.col("_repeated"))
    measured = files.join(few(paths), same).groupBy("_repeated").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_bytes"))
    repeated = cut_lineage(measured.select("_repeated", (F.col("_bytes") > TASK_BYTES).alias("_heavy"), "_bytes"))
    total, heavy = repeated.agg(F.sum("_bytes"), F.count_if("_heavy")).first()
    known = few(repeated.select("_repeated", "_heavy"))
    spark = files.sparkSession
    tasks = -(-total // TASK_BYTES)

    def reduced(rows: DataFrame) -> DataFrame:
        return rows.groupBy("relative_path").agg(F.min_by(row, order).alias("_row")).select("_row.*")

    once = files.join(known, same, "left_anti")
    many = files.join(known, same).select(*files.columns, "_heavy")
    light = many.filter(~F.col("_heavy")).select(*files.columns)
    more = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = once.unionByName(reduced(light.repartition(tasks, "relative_path") if more else light))
    return out.unionByName(reduced(many.filter("_heavy").select(*files.columns))) if heavy else out


def ordered(files: DataFrame) -> DataFrame:
    return files.orderBy("relative_path")


def scan_files(spark: SparkSession, root: str, o: Options | None = None) -> DataFrame:
    """Files under ``root`` with a known suffix and a fitting size, outside the excluded directories.

    Spark lists and reads them; it leaves out names that begin with ``_`` or ``.``, and what is below such a
    directory. Where these matter, name them in an inventory and use ``scan_inventory``.
    """
    o = o or Options()
    glob = "*.{" + ",".join(o.discovered_suffixes) + "}"
    shown = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length", "content")
    )
    return with_measures(valid_text(eligible(shown, root, o).withColumnRenamed("length", "size_bytes")))


def scan_inventory(inventory: DataFrame, root: str, o: Options | None = None, task_bytes: int = 128 << 20) -> DataFrame:
    """The files that a table (path, length) names, whatever their names: known suffixes, fitting sizes, outside the
    excluded directories. Paths are dealt to tasks of about ``task_bytes``, which read one file after the other."""
    o = o or Options()
    known = F.lower(F.substring_index("path", ".", -1)).isin(*o.discovered_suffixes)
    wanted = eligible(inventory.filter(known).select("path", "length"), root, o)
    total = wanted.agg(F.sum("length")).first()[0] or 0
    dealt = wanted.repartition(max(1, -(-total // task_bytes)), F.xxhash64("path"))
    read = dealt.mapInPandas(_read_files, "path string, length long, relative_path string, content binary")
    return with_measures(valid_text(read.withColumnRenamed("length", "size_bytes")))


def eligible(listed: DataFrame, root: str, o: Options) -> DataFrame:
    return exclude_dirs(with_relpath(fitting(listed, o, "length"), root), o.skip_dirs)


def fitting(files: DataFrame, o: Options, column: str = "size_bytes") -> DataFrame:
    """Files that aren't too small, nor too large if the options say what that is."""
    big_enough = files.filter(F.col(column) >= o.min_file_bytes)
    return big_enough if o.max_file_bytes is None else big_enough.filter(F.col(column) <= o.max_file_bytes)


def usable(files: DataFrame, o: Options) -> DataFrame:
    """What a directory scan keeps, of a table of files: outside the excluded directories, fitting, one row a path."""
    return distinct_paths(fitting(exclude_dirs(files, o.skip_dirs), o))


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            system, inner = file_system(row.path)
            with system.open_input_stream(inner) as stream:
                yield pd.DataFrame(
                    [(row.path, row.length, row.relative_path, stream.read())],
                    columns=["path", "length", "relative_path", "content"],
                )


def file_system(path: str):
    """The file system of a path and the path within it."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))
