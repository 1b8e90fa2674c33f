"""The whole job: files in, routed, cleaned, chunked, packed, analysed and rolled up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import chunking, declarations, inference, rollups, routing
from corpusmill.options import Options
from corpusmill.session import scratch_path
from corpusmill.sources import files as fs
from corpusmill.sources import report as rp


class Analysis(NamedTuple):
    routed: DataFrame
    source: DataFrame
    chunks: DataFrame
    batches: DataFrame
    results: DataFrame
    analyses: DataFrame
    declared: declarations.Declared
    scores: DataFrame
    metrics: DataFrame
    summary: DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later jobs read to the shared folder, and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def declared_tables(files: DataFrame) -> declarations.Declared:
    """The declarations for jobs that use several of the tables: the resolved lines they share are
    slim, the texts are gone by then, so they are written once."""
    return declarations.tables(written(declarations.resolved(files), "declared"))


def analyse_corpus(
    files: DataFrame, store_path: str, fn: Callable[[str, str], str] | None = None, o: Options | None = None,
    group_key: str | None = None, version: Sequence[str] = (),
) -> Analysis:
    """All stages over a table of files. Measures are taken from files and their declarations; packs of chunks are
    only what a user's ``fn`` is asked about, so nothing depends on whether there is one."""
    o = o or Options()
    # Written once: a filter on a derived column is pushed below it and computes it again, so every
    # later filter on category, text or size would repeat the routing and cleaning of all texts.
    cleaned = routing.cleaned(routing.route(fs.usable(files, o), o))
    tokens = F.when(F.col("category") == routing.SOURCE, o.measure.of_text(F.col("content"))).cast("long")
    counted = written(cleaned.withColumn("tokens", tokens), "routed")
    routed = counted.drop("tokens")
    source = counted.filter(F.col("category") == routing.SOURCE).drop("category", "skip_reason")
    resolved = written(declarations.resolved(source), "declared")
    declared = declarations.tables(resolved)
    # Packing reads the chunks twice, once for their sizes and once for their texts.
    chunks = written(chunking.chunk(source, o), "chunks")
    batches = written(chunking.batched(chunks, group_key, o), "batches")
    results = inference.analyse(batches, store_path, fn, o, version=version)
    analyses = inference.typed_analyses(results)
    scores = rollups.branch_scores(source)
    metrics = rollups.complexity_metrics(source, declared.types, declared.functions, scores)
    usage = inference.usage_report(results.filter("status NOT IN ('cached', 'missing')"), o)
    hits = inference.cache_stats(results.withColumn("is_hit", F.col("status") == "cached"))
    summary = rollups.run_summary(routed, chunks, batches, usage, hits)
    return Analysis(routed, source, chunks, batches, results, analyses, declared, scores, metrics, summary)


def report(a: Analysis, pipeline: dict[str, str], k: int = 20) -> DataFrame:
    """The one-row nested report of an analysis; every list in it is a top list of ``k`` rows."""
    types, functions = a.declared.types, a.declared.functions
    ends = rollups.endpoints(types, functions)
    roles = types.groupBy(rollups.role_of(F.col("name"), F.col("decorators")).alias("role")).agg(F.count("*").alias("types"))
    lists = {
        "key_classes": (rollups.key_classes(types, functions, k), "n_methods", ["relative_path", "type_no"]),
        "key_methods": (rollups.complex_functions(a.source, functions, k), "branches", ["relative_path", "start_line", "name"]),
        "complex_files": (rollups.top_k(a.scores, "score", ["relative_path"], k), "score", ["relative_path"]),
        "complex_classes": (rollups.complex_types(a.source, types, k), "branches", ["relative_path", "type_no"]),
        "largest_files": (rollups.largest_files(a.routed, k), "line_count", ["relative_path"]),
        "services": (rollups.top_k(rollups.services(types, ends), "classes", ["service_name"], k), "classes", ["service_name"]),
        "endpoints": (rollups.top_k(ends.withColumn("n", F.lit(1)), "n", ["path", "handler"], k), "n", ["path", "handler"]),
        "dependencies": (rollups.top_k(rollups.import_degree(a.declared.imports), "files", ["dependency"], k), "files", ["dependency"]),
        "roles": (roles, "types", ["role"]),
    }
    return rp.report_row(a.summary, a.metrics, {n: rp.ranked(*parts) for n, parts in lists.items()}, pipeline)


def report_tables(a: Analysis) -> dict[str, DataFrame]:
    """Whole tables to write beside the report, of which it shows the top."""
    ends = rollups.endpoints(a.declared.types, a.declared.functions)
    return {
        "chunk_analyses": a.analyses,
        "file_scores": a.scores,
        "endpoints": ends,
        "services": rollups.services(a.declared.types, ends),
        "dependencies": rollups.import_degree(a.declared.imports),
    }
