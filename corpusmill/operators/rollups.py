"""Counts, totals, top lists and metrics over the tables of the other operators.

Every aggregate here combines before its shuffle, and every top list is an
``orderBy().limit()`` that Spark keeps as a bounded heap per task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import texts
from corpusmill.operators.blocks import numbered
from corpusmill.operators.routing import CONFIG, SKIPPED, SOURCE


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row: a union and an aggregate, no join."""
    columns = [c for f in one_row_frames for c in f.columns]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames)
    return union.agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def skip_reasons(routed: DataFrame) -> DataFrame:
    return (
        routed.filter(F.col("skip_reason").isNotNull())
        .groupBy("skip_reason")
        .agg(F.count("*").alias("files"))
        .orderBy(F.desc("files"), "skip_reason")
    )


def category_totals(routed: DataFrame) -> DataFrame:
    """Files and lines per category, and a grand total under ``total``."""
    return (
        routed.rollup("category")
        .agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.sum("size_bytes").alias("bytes"),
             F.grouping("category").alias("g"))
        .select(F.when(F.col("g") == 1, "total").otherwise(F.col("category")).alias("category"), "files", "lines", "bytes")
    )


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Texts held by more than one file, by their whole hash; shown are its first characters, the number of files
    and the first path. No list of members is built."""
    return (
        files.groupBy(F.sha2("content", 256).alias("sha"))
        .agg(F.first("content_hash").alias("content_hash"), F.count("*").alias("copies"), F.min("relative_path").alias("first_path"))
        .filter("copies > 1")
        .drop("sha")
    )


def top_k(df: DataFrame, score: str | Column, ties: list[str], k: int, by: str | None = None) -> DataFrame:
    """The ``k`` rows with the highest score, ties broken by ``ties``; per value of ``by`` if given.

    The grouped form first keeps ``k`` rows per value and input partition, so that one value with a
    very large share of the rows sends few rows to its final task.
    """
    score = F.col(score) if isinstance(score, str) else score
    order = [score.desc(), *[F.col(t).asc() for t in ties]]
    if by is None:
        return df.orderBy(*order).limit(k)
    local = Window.partitionBy(by, "_part").orderBy(*order)
    final = Window.partitionBy(by).orderBy(*order)
    # The key is split in two steps: (value, salt) groups first, whole values after.
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*ties), F.lit(256)))
    first = salted.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= k)
    return (
        first.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).drop("_part", "_rank")
    )


def largest_files(files: DataFrame, k: int) -> DataFrame:
    return top_k(files.select("relative_path", "line_count"), "line_count", ["relative_path"], k)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    tokens = F.sum("token_count")
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.floor(tokens / F.greatest(F.count("*"), F.lit(1))), F.lit(0)).cast("long").alias("avg_tokens"),
        F.coalesce(F.max("token_count"), F.lit(0)).cast("long").alias("max_tokens"),
    )


def dependency_degree(analyses: DataFrame) -> DataFrame:
    """Distinct dependency names with the number of analysed files that name them."""
    return (
        analyses.select("file_path", F.explode(F.array_distinct("dependencies")).alias("dependency"))
        .groupBy("dependency")
        .agg(F.countDistinct("file_path").alias("files"))
    )


def average_complexity(analyses: DataFrame) -> DataFrame:
    return analyses.agg(F.coalesce(F.avg("complexity_score"), F.lit(0.0)).alias("average_complexity"))


def most_complex_files(analyses: DataFrame, k: int) -> DataFrame:
    rows = analyses.select(
        "file_path", F.col("complexity_score").alias("score"), F.col("complexity_notes").alias("notes")
    )
    return top_k(rows, "score", ["file_path"], k)


def key_methods(analyses: DataFrame, k: int) -> DataFrame:
    rows = analyses.select("file_path", F.inline("key_methods"))
    return top_k(rows, "complexity", ["file_path", "name", "signature"], k)


def branch_scores(files: DataFrame) -> DataFrame:
    """Branches of each file and the score they give; every file has a row."""
    branches = texts.branch_count(F.col("content"))
    return files.select("relative_path", branches.alias("branches"), texts.branch_score(branches).alias("score"))


def _running():
    @F.pandas_udf("array<long>")
    def running(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: np.concatenate(([0], np.cumsum(c))))

    return running


def branches_within(files: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (relative_path, start_line, end_line, ...) with the branches of their lines; one join by path.

    A file's spans meet it as one list, and its branches are counted once, running from line to line: a span costs two
    look-ups and carries no text.
    """
    columns = [c for c in spans.columns if c != "relative_path"]
    by_file = spans.groupBy("relative_path").agg(F.collect_list(F.struct(*columns)).alias("_spans"))
    counts = F.transform(texts.lines_of(F.col("content")), texts.branch_count)
    met = files.select("relative_path", counts.alias("_counts")).join(by_file, "relative_path").withColumn("_running", _running()("_counts"))

    def counted(s: Column) -> Column:
        upto = lambda line: F.get("_running", F.greatest(F.lit(0), F.least(line, F.size("_running") - 1)))
        first = upto(s["start_line"] - 1)
        return F.struct(*[s[c].alias(c) for c in columns], F.greatest(upto(s["end_line"]) - first, F.lit(0)).cast("long").alias("branches"))

    return met.select("relative_path", F.inline(F.transform("_spans", counted)))


def complex_types(files: DataFrame, types: DataFrame, k: int) -> DataFrame:
    """The ``k`` types with most branches between their first and last line."""
    counted = branches_within(files, types.select("relative_path", "type_no", "name", "start_line", "end_line"))
    return top_k(counted.select("relative_path", "type_no", "name", "branches"), "branches", ["relative_path", "type_no"], k)


def complex_functions(files: DataFrame, functions: DataFrame, k: int) -> DataFrame:
    """The ``k`` functions with most branches."""
    counted = branches_within(files, functions.select("relative_path", "owner", "name", "start_line", "end_line"))
    return top_k(counted.select("relative_path", "owner", "name", "start_line", "branches"), "branches", ["relative_path", "start_line", "name"], k)


def import_degree(imports: DataFrame) -> DataFrame:
    """What files import, with the number of files that do."""
    return imports.groupBy(F.col("import_text").alias("dependency")).agg(F.countDistinct("relative_path").alias("files"))


def complexity_metrics(files: DataFrame, types: DataFrame, functions: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of totals and means over the tables; ``scores`` has a row for each file."""
    f = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"))
    t = types.agg(F.count("*").alias("total_classes"))
    m = functions.agg(F.count("*").alias("total_functions"))
    a = scores.agg(F.count("*").alias("scored_files"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_complexity_score"))
    return side_by_side(f, t, m, a).withColumn(
        "avg_methods_per_class", F.col("total_functions") / F.greatest(F.col("total_classes"), F.lit(1))
    )


def _as_map(counts: DataFrame, key: str, name: str) -> DataFrame:
    """Counts by a key of few values (a language, a reason) as one row with a map, in the order of the key."""
    entries = F.sort_array(F.collect_list(F.struct(key, "files")))
    return counts.agg(F.map_from_entries(entries).alias(name))


def run_summary(routed: DataFrame, chunks: DataFrame, batches: DataFrame, usage: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: discovered, kept and skipped files by language and reason, lines, chunks before and after packing,
    calls, tokens a call, hit rate and cost."""
    r = routed.agg(
        F.count("*").alias("total_discovered"),
        F.count_if(F.col("category") == SOURCE).alias("source_files"),
        F.count_if(F.col("category") == CONFIG).alias("config_files"),
        F.count_if(F.col("category") == SKIPPED).alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("category") == SOURCE, F.col("line_count"))), F.lit(0)).alias("total_lines"),
    )
    c = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("chunk_tokens"))
    b = batches.agg(F.count("*").alias("batches"))
    languages = _as_map(language_counts(routed.filter(F.col("category") == SOURCE)), "language", "languages")
    reasons = _as_map(skip_reasons(routed), "skip_reason", "skip_reasons")
    whole = side_by_side(r, c, b, usage, hits, languages, reasons)
    per_call = F.floor(F.col("input_tokens") / F.greatest(F.col("calls"), F.lit(1))).cast("long")
    return whole.withColumn("tokens_per_call", per_call)


# --- types, their roles and endpoints -----------------------------------------------------------

ROLES = {
    "controller": r"Controller$|Resource$",
    "service": r"Service(?:Impl)?$",
    "repository": r"Repository$|Dao$",
    "security": r"Security|Auth",
    "exception": r"Exception|Error",
}
ROLE_ANNOTATIONS = {
    "controller": "@RestController|@Controller",
    "service": "@Service",
    "repository": "@Repository",
    "security": "@EnableWebSecurity|@PreAuthorize",
    "exception": "@ControllerAdvice|@RestControllerAdvice|@ExceptionHandler",
}
MAPPING = r"^@(Get|Post|Put|Delete|Patch|Request)Mapping\b"
MAPPED_PATH = r'^@\w+Mapping\([^"]*"([^"]*)"'


def role_of(name: Column, decorators: Column) -> Column:
    """The role a type's name ends in, else the one its annotations tell, else ''."""
    noted = F.array_join(decorators, "\n")
    case = F
    for role, pattern in ROLES.items():
        case = case.when(F.rlike(name, F.lit(pattern)), role)
    for role, pattern in ROLE_ANNOTATIONS.items():
        case = case.when(F.rlike(noted, F.lit(rf"(?m)^(?:{pattern})\b")), role)
    return case.otherwise("")


def _mapping(decorators: Column) -> Column:
    return F.get(F.filter(decorators, lambda d: F.rlike(d, F.lit(MAPPING))), F.lit(0))


def endpoints(types: DataFrame, functions: DataFrame) -> DataFrame:
    """HTTP method, path and handler of mapped functions, the type's own path in front."""
    mapped = functions.withColumn("mapping", _mapping(F.col("decorators"))).filter("mapping IS NOT NULL")
    owners = types.select(
        "relative_path", "type_no", "package", F.regexp_extract(F.coalesce(_mapping(F.col("decorators")), F.lit("")), MAPPED_PATH, 1).alias("prefix")
    )
    verb = F.upper(F.regexp_extract("mapping", MAPPING, 1))
    return mapped.join(owners, ["relative_path", "type_no"]).select(
        "relative_path", "package",
        F.when(verb == "REQUEST", "").otherwise(verb).alias("method"),
        F.concat("prefix", F.regexp_extract("mapping", MAPPED_PATH, 1)).alias("path"),
        F.concat("owner", F.lit("."), "name").alias("handler"),
    )


def service_of(package: Column) -> Column:
    return F.substring_index(package, ".", -1)


def services(types: DataFrame, endpoint_rows: DataFrame) -> DataFrame:
    """Classes and endpoints per service, the last segment of the package. Members stay rows of
    ``types`` and ``endpoints``: a service may hold any share of them, so no list is collected."""
    t = types.groupBy(service_of(F.col("package")).alias("service_name")).agg(F.count("*").alias("classes"))
    e = endpoint_rows.groupBy(service_of(F.col("package")).alias("service_name")).agg(F.count("*").alias("endpoints"))
    return t.join(e, "service_name", "left").fillna(0, ["endpoints"])


#: Members that one page of a service holds at most.
PAGE = 1_000


def service_members(types: DataFrame, endpoint_rows: DataFrame, page_size: int = PAGE, blocks: int | None = None) -> DataFrame:
    """(service_name, page, members): the types and endpoints of each service, complete, in numbered pages.

    Members are numbered within their service over range blocks, so that a service of any size spreads over tasks and no
    list is longer than ``page_size``.
    """
    t = types.select(
        service_of(F.col("package")).alias("service_name"), F.lit("type").alias("member"), "relative_path", F.col("fqn").alias("item"),
    )
    called = F.concat_ws(" ", F.nullif("method", F.lit("")), "path", "handler")
    e = endpoint_rows.select(service_of(F.col("package")).alias("service_name"), F.lit("endpoint").alias("member"), "relative_path", called.alias("item"))
    placed = numbered(t.unionByName(e), ["member", "relative_path", "item"], "place", blocks, ["service_name"])
    page = F.floor(F.col("place") / page_size).cast("long").alias("page")
    listed = placed.groupBy("service_name", page).agg(F.sort_array(F.collect_list(F.struct("place", "member", "relative_path", "item"))).alias("members"))
    return listed.select("service_name", "page", F.transform("members", lambda m: F.struct(m["member"], m["relative_path"], m["item"])).alias("members"))


def key_classes(types: DataFrame, functions: DataFrame, k: int) -> DataFrame:
    """The ``k`` types with most functions, each with its function list (bounded by its file)."""
    key = ["relative_path", "type_no"]
    counted = functions.groupBy(*key).agg(F.count("*").alias("n_methods"))
    ranked = types.join(counted, key, "left").withColumn("n_methods", F.coalesce("n_methods", F.lit(0)))
    best = top_k(
        ranked.select(*key, "name", "n_methods", role_of(F.col("name"), F.col("decorators")).alias("role")),
        "n_methods", ["relative_path", "type_no"], k,
    )
    # ``best`` holds k rows, so it may be sent to every task.
    listed = functions.join(F.broadcast(best.select(*key)), key).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("start_line", "name", "return_type", "parameters"))).alias("methods")
    )
    return best.join(F.broadcast(listed), key, "left")
