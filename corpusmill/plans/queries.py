"""Registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import texts
from corpusmill.functions.jsonfix import parse_typed, repair_json
from corpusmill.functions.tokens import token_count
from corpusmill.operators import blocks, chunking, declarations, inference, packing, rollups, routing
from corpusmill.options import Options
from corpusmill.plans import pipeline
from corpusmill.session import scratch_path
from corpusmill.sources import derived, files as fs, store as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- scans, sources -----------------------------------------------------------------------------


@query
def file_inventory(spark, sf):
    both = derived.document_files(spark, sf).unionByName(derived.code_files(spark, sf))
    return both.select("relative_path", "language", "content_hash", "size_bytes", "line_count")


@query
def dir_and_size_filter(spark, sf):
    kept = fs.exclude_dirs(derived.routed_files(spark, sf))
    return fs.size_between(kept, 1000, 20_000).select("relative_path", "size_bytes")


@query
def text_validity(spark, sf):
    docs = derived.table(spark, sf, "documents")
    raw = F.replace(F.col("text"), F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r"))
    bytes_ = F.concat(F.to_binary(raw, F.lit("utf-8")), F.when(F.col("doc_id") % 9 == 0, F.unhex(F.lit("C328"))).otherwise(F.unhex(F.lit(""))))
    rows = docs.select("doc_id", bytes_.alias("content")).withColumn("size_bytes", F.octet_length("content"))
    return fs.valid_text(rows).select(
        "doc_id", "size_bytes", texts.content_hash(F.col("content")).alias("content_hash"),
        texts.line_count(F.col("content")).alias("line_count"),
    )


@query
def distinct_paths(spark, sf):
    files = derived.document_files(spark, sf)
    again = files.filter(F.col("line_count") % 2 == 0)
    return fs.distinct_paths(files.unionByName(again)).select("relative_path", "content_hash", "size_bytes")


@query
def relative_paths(spark, sf):
    pages = derived.table(spark, sf, "pages").select(
        F.concat(F.lit("file:/data/corpus/"), F.replace(F.regexp_replace("url", r"^https?://", ""), F.lit("/"), F.lit("\\"))).alias("path"), "page_id"
    )
    return fs.with_relpath(pages, "/data/corpus").select("page_id", "relative_path")


# --- routing and cleaning -----------------------------------------------------------------------


def _routed(spark, sf):
    return routing.route(derived.routed_files(spark, sf))


@query
def routed_files(spark, sf):
    return _routed(spark, sf).select("relative_path", "language", "category", "skip_reason")


@query
def skip_reasons(spark, sf):
    return rollups.skip_reasons(_routed(spark, sf))


@query
def category_totals(spark, sf):
    return rollups.category_totals(_routed(spark, sf))


@query
def language_counts(spark, sf):
    return rollups.language_counts(_routed(spark, sf).filter(F.col("category") == routing.SOURCE))


@query
def clean_text(spark, sf):
    docs = derived.table(spark, sf, "documents")
    dirty = derived.dirty_text(F.col("text"), F.col("doc_id"))
    return docs.select("doc_id", texts.clean_text(dirty).alias("text")).select(
        "doc_id", F.sha2("text", 256).alias("clean_sha"), texts.line_count(F.col("text")).alias("line_count")
    )


@query
def cleaned_files(spark, sf):
    docs = derived.table(spark, sf, "documents")
    dirty = derived.dirty_text(F.col("text"), F.col("doc_id"))
    path = "concat(source, '/doc_', doc_id, if(doc_id % 2 = 0, '.py', '.md'))"
    files = fs.scan_table(docs, dirty, path)
    return routing.cleaned(routing.route(files)).select(
        "relative_path", "category", "content_hash", "clean_hash", "size_bytes", "line_count"
    )


# --- measures and rollups -----------------------------------------------------------------------


@query
def token_stats(spark, sf):
    docs = derived.table(spark, sf, "documents")
    return rollups.chunk_stats(docs.select(token_count(F.col("text")).alias("token_count")))


@query
def token_counts(spark, sf):
    docs = derived.table(spark, sf, "documents")
    return docs.select("doc_id", token_count(F.col("text")).alias("tokens"))


@query
def duplicate_groups(spark, sf):
    return rollups.duplicate_groups(derived.document_files(spark, sf))


@query
def largest_files(spark, sf):
    return rollups.largest_files(derived.document_files(spark, sf), 20)


@query
def guess_package(spark, sf):
    files = derived.code_files(spark, sf)
    return files.select("relative_path", texts.guess_package(F.col("relative_path")).alias("package"))


@query
def class_names(spark, sf):
    files = derived.code_files(spark, sf)
    named = files.select("relative_path", texts.class_names(F.col("content"), F.col("language")).alias("names"))
    return named.select("relative_path", F.array_join("names", ",").alias("names"), F.size("names").alias("n"))


@query
def display_names(spark, sf):
    files = derived.document_files(spark, sf)
    return files.select(
        "relative_path", texts.basename(F.col("relative_path")).alias("name"),
        texts.extension(F.col("relative_path")).alias("ext"),
        F.md5(texts.prefix(F.col("content"), 80)).alias("head_md5"),
        F.md5(F.substr("content", F.lit(81))).alias("rest_md5"),
    )


# --- chunks and packs ---------------------------------------------------------------------------


@query
def file_order(spark, sf):
    files = derived.document_files(spark, sf).select("relative_path", "line_count")
    return blocks.numbered(files, ["relative_path"]).select("relative_path", "ordinal")


@query
def whole_file_chunks(spark, sf):
    chunks = chunking.whole_file_chunks(derived.code_files(spark, sf), Options(max_tokens=300))
    return chunks.select("chunk_id", "token_count", F.sha2("content", 256).alias("sha"), F.array_join("class_names", ",").alias("names"))


@query
def line_chunks(spark, sf):
    chunks = chunking.line_chunks(derived.document_files(spark, sf), Options(max_tokens=200))
    return chunks.select("chunk_id", "ordinal", "token_count", F.sha2("content", 256).alias("sha"))


@query
def chunk_stats(spark, sf):
    return rollups.chunk_stats(chunking.line_chunks(derived.document_files(spark, sf), Options(max_tokens=200)))


def _document_chunks(spark, sf, o):
    return chunking.whole_file_chunks(derived.document_files(spark, sf), o).unionByName(
        chunking.line_chunks(chunking.oversize(derived.document_files(spark, sf), o).drop("tokens"), o)
    )


PACK = Options(max_tokens=1000)


@query
def batch_packs(spark, sf):
    chunks = _document_chunks(spark, sf, PACK).withColumn("source", F.split_part("relative_path", F.lit("/"), F.lit(1)))
    packed = packing.assign_packs(chunks, "source", PACK)
    first = packed.groupBy("pack").agg(F.min_by("chunk_id", F.struct("relative_path", "ordinal")).alias("first_chunk"))
    return packed.join(first, "pack").select("chunk_id", "first_chunk")


@query
def batch_packs_one_sequence(spark, sf):
    packed = packing.assign_packs(_document_chunks(spark, sf, PACK), None, PACK)
    return packed.groupBy("pack").agg(
        F.min_by("chunk_id", F.struct("relative_path", "ordinal")).alias("first_chunk"),
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"),
    ).drop("pack")


@query
def merged_batches(spark, sf):
    o = PACK
    chunks = _document_chunks(spark, sf, o)
    merged = chunking.merge_packs(packing.assign_packs(chunks, None, o), chunks, o)
    return merged.select("chunk_id", "token_count", "members", F.sha2("content", 256).alias("sha"),
                         F.array_join("source_files", ",").alias("source_files"))


# --- store, requests, cost, inference, JSON -----------------------------------------------------


def _keyed(spark, sf):
    return inference.with_cache_key(derived.document_chunks(spark, sf))


def _looked_up(spark, sf):
    keyed = _keyed(spark, sf)
    store = st.latest(derived.store_entries(keyed))
    return inference.lookup(keyed, store)


@query
def cache_keys(spark, sf):
    return _keyed(spark, sf).select("chunk_id", inference.chunk_hash(F.col("content")).alias("chunk_hash"), "cache_key")


@query
def cache_hits(spark, sf):
    return _looked_up(spark, sf).filter("is_hit").select("chunk_id", F.get_json_object("payload", "$.complexity_score").alias("score"))


@query
def cache_misses(spark, sf):
    keyed = _keyed(spark, sf)
    return inference.misses(keyed, st.latest(derived.store_entries(keyed))).select("chunk_id")


@query
def cache_stats(spark, sf):
    return inference.cache_stats(_looked_up(spark, sf))


@query
def request_texts(spark, sf):
    asked = inference.estimate(inference.render_requests(derived.document_chunks(spark, sf)))
    return asked.select("chunk_id", "est_tokens", F.sha2(F.concat("system", "user"), 256).alias("sha"))


@query
def prompt_texts(spark, sf):
    c = derived.document_chunks(spark, sf)
    text = texts.prompt_text(*[F.col(x) for x in ("source_files", "language", "class_names", "function_names", "content")])
    return c.select("chunk_id", F.sha2(text, 256).alias("sha"))


@query
def budget_admission(spark, sf):
    chunks = derived.document_chunks(spark, sf).withColumnRenamed("token_count", "est_tokens")
    cost = inference.call_cost(F.col("est_tokens"), F.lit(0))
    decided = inference.admit(chunks.select("source", "doc_id", "est_tokens"), cost, Decimal("0.04"), ["source", "doc_id"])
    return decided.select("source", "doc_id", "admitted")


@query
def budget_by_source(spark, sf):
    """A ceiling for each source, and none for one of them."""
    chunks = derived.document_chunks(spark, sf).withColumnRenamed("token_count", "est_tokens")
    cost = inference.call_cost(F.col("est_tokens"), F.lit(0))
    ceiling = F.when(F.col("source") == "src0", F.lit(Decimal("0.01"))).when(F.col("source") != "src1", F.lit(Decimal("0.002")))
    decided = inference.admit(chunks.select("source", "doc_id", "est_tokens"), cost, ceiling, ["doc_id"], group_key="source")
    return decided.select("source", "doc_id", "admitted")


@query
def usage_report(spark, sf):
    called = derived.document_chunks(spark, sf).select(
        F.col("token_count").alias("est_tokens"), (F.col("n_chars") % 100).alias("out_tokens"),
        F.when(F.col("doc_id") % 7 == 0, "failed").alias("error"),
    )
    return inference.usage_report(called)


def _answers(spark, sf, keyed):
    """Answers for the chunks, by their key: the events' mangled JSON, none for every eleventh event."""
    raw = derived.raw_responses(spark, sf).filter("event_id % 11 <> 0")
    answered = keyed.join(raw, keyed["doc_id"] == raw["event_id"]).select("cache_key", "raw")
    return answered.withColumn("error", F.lit(None).cast("string"))


@query
def inference_results(spark, sf):
    keyed = _keyed(spark, sf)
    called = inference.given(keyed.select("doc_id", "cache_key"), _answers(spark, sf, keyed))
    return inference.parsed(called).select("doc_id", "status", "error", F.get_json_object("payload", "$.k").alias("k"))


def _analysed(spark, sf, runs: int):
    chunks = derived.document_chunks(spark, sf)
    path = scratch_path(spark, "store")
    keyed = inference.with_cache_key(chunks)
    derived.store_entries(keyed).withColumn(st.PREFIX, st.prefix_of(F.col("cache_key"))).write.partitionBy(st.PREFIX).parquet(path)
    for _ in range(runs):
        o = Options(max_cost=Decimal("0.03"))
        result = inference.analyse(chunks.drop("token_count"), path, None, o, answers=_answers(spark, sf, keyed))
    return result


@query
def analysis_results(spark, sf):
    score = F.coalesce(F.get_json_object("payload", "$.complexity_score"), F.get_json_object("payload", "$.k"))
    return _analysed(spark, sf, 1).select("chunk_id", "status", "error", score.alias("score"))


@query
def analysis_second_run(spark, sf):
    return _analysed(spark, sf, 2).groupBy("status", "error").agg(F.count("*").alias("chunks"))


@query
def prompt_version_miss(spark, sf):
    """A store filled under one prompt version, looked up under the same one and under another."""
    chunks = derived.document_chunks(spark, sf)
    path = scratch_path(spark, "store")
    first = inference.with_cache_key(chunks, F.lit("v1"))
    st.append_store(first.filter("doc_id % 3 = 0").select("cache_key", F.lit('{"k":1}').alias("payload")), path)
    found = [
        inference.lookup(keyed, st.read_store(spark, path, keyed.select("cache_key"))).select(F.lit(v).alias("version"), "is_hit")
        for v, keyed in (("v1", first), ("v2", inference.with_cache_key(chunks, F.lit("v2"))))
    ]
    return found[0].unionByName(found[1]).groupBy("version").agg(F.count_if("is_hit").alias("hits"), F.count("*").alias("chunks"))


@query
def json_repair(spark, sf):
    raw = derived.raw_responses(spark, sf)
    return raw.select("event_id", F.get_json_object(repair_json(F.col("raw")), "$.k").alias("k"))


@query
def typed_analysis(spark, sf):
    typed = derived.analysis_texts(spark, sf).select("doc_id", parse_typed(F.col("payload")).alias("a"))
    return typed.select(
        "doc_id", "a.file_path", "a.summary", "a.purpose", F.size("a.key_methods").alias("methods"),
        F.get("a.key_methods", F.lit(0))["complexity"].alias("first_complexity"),
        F.array_join("a.dependencies", ",").alias("dependencies"), "a.complexity_score", "a._corrupt",
    )


@query
def context_numbers(spark, sf):
    chunks = derived.document_chunks(spark, sf).select("source", "doc_id", "content")
    return inference.context_numbers(chunks, "content", 80_000, ["source", "doc_id"]).drop("content")


@query
def branch_scores(spark, sf):
    return rollups.branch_scores(derived.code_files(spark, sf))


def _analyses(spark, sf):
    typed = derived.analysis_texts(spark, sf).select("doc_id", parse_typed(F.col("payload")).alias("a"))
    return typed.select("doc_id", "a.*")


@query
def dependency_degree(spark, sf):
    return rollups.dependency_degree(_analyses(spark, sf))


@query
def most_complex_files(spark, sf):
    return rollups.most_complex_files(_analyses(spark, sf), 25)


@query
def key_methods(spark, sf):
    return rollups.key_methods(_analyses(spark, sf), 20).select("file_path", "name", "complexity")


@query
def average_complexity(spark, sf):
    return rollups.average_complexity(_analyses(spark, sf))


@query
def top_files_per_source(spark, sf):
    docs = derived.table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return rollups.top_k(docs, "n_chars", ["doc_id"], 3, by="source")


# --- declarations -------------------------------------------------------------------------------


def _declared(spark, sf):
    return declarations.declarations(derived.code_files(spark, sf))


@query
def exploded_lines(spark, sf):
    lines = declarations.explode_lines(derived.code_files(spark, sf))
    return lines.groupBy("relative_path").agg(
        F.count("*").alias("lines"), F.sum(F.length("raw")).alias("raw_chars"), F.sum(F.length("code")).alias("code_chars"),
        F.sum("line_no").alias("line_no_sum"),
    )


@query
def declared_types(spark, sf):
    t = _declared(spark, sf).types
    return t.select(
        "relative_path", "name", "kind", "fqn", "superclass", F.array_join("interfaces", "|").alias("interfaces"),
        F.array_join("decorators", "|").alias("decorators"), "start_line", "end_line",
    )


@query
def docstrings(spark, sf):
    return _declared(spark, sf).types.filter("docstring <> ''").select("relative_path", "name", "docstring")


@query
def declared_functions(spark, sf):
    f = _declared(spark, sf).functions
    return f.select(
        "relative_path", "owner", "name", "return_type", F.array_join("parameters", "|").alias("parameters"),
        F.array_join("decorators", "|").alias("decorators"), "is_public", "start_line", "end_line",
    )


@query
def methods_per_class(spark, sf):
    f = _declared(spark, sf).functions
    return f.groupBy("relative_path", "owner").agg(F.count("*").alias("methods"))


@query
def imports_by_file(spark, sf):
    return _declared(spark, sf).imports.select("relative_path", "line_no", "import_text")


@query
def fields_table(spark, sf):
    return _declared(spark, sf).fields.select("relative_path", "owner", "name", "type", "line_no")


@query
def regex_literals(spark, sf):
    d = declarations.declarations(derived.regex_files(spark, sf))
    t = d.types.select("relative_path", F.col("name").alias("owner"), F.lit("").alias("name"), "start_line", "end_line")
    return t.unionByName(d.functions.select("relative_path", "owner", "name", "start_line", "end_line"))


@query
def module_and_generic_types(spark, sf):
    t = declarations.declarations(derived.script_files(spark, sf)).types
    return t.select("relative_path", "name", "kind", "package", "start_line", "end_line")


@query
def module_and_generic_functions(spark, sf):
    f = declarations.declarations(derived.script_files(spark, sf)).functions
    return f.select("relative_path", "owner", "name", "start_line", "end_line")


def _nested(spark, sf):
    return declarations.declarations(derived.nested_files(spark, sf))


@query
def nested_types(spark, sf):
    t = _nested(spark, sf).types
    return t.select(
        "relative_path", "name", "kind", "outer", "fqn", "docstring", F.array_join("decorators", "|").alias("decorators"),
        rollups.role_of(F.col("name"), F.col("decorators")).alias("role"), "start_line", "end_line",
    )


@query
def nested_functions(spark, sf):
    f = _nested(spark, sf).functions
    return f.select(
        "relative_path", "owner", "name", "return_type", F.array_join("parameters", "|").alias("parameters"),
        F.array_join("decorators", "|").alias("decorators"), "start_line", "end_line",
    )


@query
def nested_fields(spark, sf):
    return _nested(spark, sf).fields.select("relative_path", "owner", "name", "type", "line_no")


@query
def nested_endpoints(spark, sf):
    d = pipeline.declared_tables(derived.nested_files(spark, sf))
    return rollups.endpoints(d.types, d.functions).select("relative_path", "package", "method", "path", "handler")


@query
def service_pages(spark, sf):
    d = pipeline.declared_tables(derived.nested_files(spark, sf))
    pages = rollups.service_members(d.types, rollups.endpoints(d.types, d.functions), 25)
    return pages.select("service_name", "page", F.inline("members")).select("service_name", "page", "member", "relative_path", "item")


@query
def long_docstrings(spark, sf):
    t = declarations.declarations(derived.long_docstring_files(spark, sf)).types
    lines = F.size(F.split("docstring", "\n")).cast("long").alias("lines")
    return t.select("relative_path", "name", lines, F.sha2("docstring", 256).alias("sha"), F.array_join("decorators", "|").alias("decorators"), "start_line", "end_line")


# --- chunks along declarations ------------------------------------------------------------------


def _code_table(spark, sf):
    """The code corpus as a written table, the form in which a job finds its files."""
    return pipeline.written(derived.code_files(spark, sf), "code")


def _typed_chunks(spark, sf, max_tokens: int):
    o = Options(max_tokens=max_tokens)
    files = _code_table(spark, sf)
    chunks = chunking.typed_chunks(files, declarations.file_spans(chunking.oversize(files, o)), o)
    return chunks.select("chunk_id", "level", "token_count", F.sha2("content", 256).alias("sha"),
                         F.array_join("class_names", ",").alias("class_names"), F.array_join("function_names", ",").alias("function_names"))


@query
def type_chunks(spark, sf):
    return _typed_chunks(spark, sf, 110).filter("level = 'type'")


@query
def header_chunks(spark, sf):
    return _typed_chunks(spark, sf, 110).filter("level = 'header'")


@query
def function_groups(spark, sf):
    return _typed_chunks(spark, sf, 110).filter("level = 'functions'")


@query
def split_functions(spark, sf):
    return _typed_chunks(spark, sf, 40).filter("level = 'function_part'")


@query
def rest_chunks(spark, sf):
    return _typed_chunks(spark, sf, 110).filter("level = 'rest'")


@query
def chunk_coverage(spark, sf):
    """Lines of each file as its chunks hold them: every line that isn't blank is in one."""
    chunks = chunking.chunk(_code_table(spark, sf), Options(max_tokens=60))
    lines = chunks.select("relative_path", F.explode(texts.lines_of(F.col("content"))).alias("line")).filter(F.rlike("line", F.lit(r"\S")))
    return lines.groupBy("relative_path").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query
def chunk_pipeline(spark, sf):
    o = Options(max_tokens=200)
    chunks = chunking.chunk(_code_table(spark, sf), o)
    return chunks.groupBy("language", "level").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


# --- rollups over declarations, reports, the whole job ------------------------------------------


@query
def type_roles(spark, sf):
    t = _declared(spark, sf).types
    return t.groupBy(rollups.role_of(F.col("name"), F.col("decorators")).alias("role")).agg(F.count("*").alias("types"))


@query
def endpoint_table(spark, sf):
    d = pipeline.declared_tables(derived.code_files(spark, sf))
    return rollups.endpoints(d.types, d.functions).select("relative_path", "method", "path", "handler")


@query
def services(spark, sf):
    d = pipeline.declared_tables(derived.code_files(spark, sf))
    return rollups.services(d.types, rollups.endpoints(d.types, d.functions))


@query
def key_classes(spark, sf):
    d = pipeline.declared_tables(derived.code_files(spark, sf))
    best = rollups.key_classes(d.types, d.functions, 8)
    return best.select("relative_path", "name", "role", "n_methods", F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods"))


@query
def complexity_metrics(spark, sf):
    files = _code_table(spark, sf)
    d = pipeline.declared_tables(files)
    return rollups.complexity_metrics(files, d.types, d.functions, rollups.branch_scores(files))


@query
def complex_types(spark, sf):
    files = _code_table(spark, sf)
    return rollups.complex_types(files, pipeline.declared_tables(files).types, 25).drop("type_no")


@query
def complex_functions(spark, sf):
    files = _code_table(spark, sf)
    return rollups.complex_functions(files, pipeline.declared_tables(files).functions, 25)


@query
def repeated_paths(spark, sf):
    """Documents under paths that repeat with other texts: packs hold each path once, with one text."""
    files = derived.document_files(spark, sf)
    again = fs.scan_table(derived.table(spark, sf, "documents"), F.concat(F.lit("again "), "text"), "concat(source, '/', lang, '/doc_', doc_id, '.txt')")
    o = Options(max_tokens=1000)
    kept = pipeline.written(fs.usable(files.unionByName(again).unionByName(files), o), "kept")
    small = chunking.whole_file_chunks(kept, o)
    batches = chunking.batched(pipeline.written(small, "small"), None, o)
    members = batches.select(F.explode("source_files").alias("relative_path"), "members", F.size("source_files").alias("paths"))
    # Hashed before the join, so that no text is sorted for it.
    hashed = kept.select("relative_path", F.sha2("content", 256).alias("sha"))
    return members.join(hashed, "relative_path").select("relative_path", (F.col("members") == F.col("paths")).alias("once"), "sha")


@query
def scan_directory(spark, sf):
    """Documents written as text files below one directory per language, then scanned from disk."""
    root = scratch_path(spark, "tree")
    docs = derived.table(spark, sf, "documents")
    docs.select("lang", "text").write.partitionBy("lang").option("maxRecordsPerFile", 50).text(root)
    files = fs.scan_files(spark, root, Options())
    return files.groupBy(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("top")).agg(
        F.sum("line_count").alias("lines"), F.sum("size_bytes").alias("bytes")
    )


def _all_files(spark, sf):
    return derived.code_files(spark, sf).unionByName(derived.script_files(spark, sf)).unionByName(derived.routed_files(spark, sf))


def _counted(column: str):
    """A map of counts as text."""
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias(column)


@query
def run_summary(spark, sf):
    files = derived.script_files(spark, sf).unionByName(derived.routed_files(spark, sf))
    a = pipeline.analyse_corpus(files, scratch_path(spark, "store"), None, Options(max_tokens=1000))
    return a.summary.withColumns({c: _counted(c) for c in ("languages", "skip_reasons")})


@query
def corpus_analysis(spark, sf):
    """The flagship: the whole job over code, scripts and documents, as one row."""
    a = pipeline.analyse_corpus(_all_files(spark, sf), scratch_path(spark, "store"))
    # How many packs the chunks make is compared in run_summary: a walk over all of them is beyond plain SQL here.
    summary = a.summary.withColumns({c: _counted(c) for c in ("languages", "skip_reasons")})
    return rollups.side_by_side(a.metrics, summary.drop("total_lines", "batches", "misses"))


REPORT_LISTS = {
    "key_classes": ("relative_path string, name string, n_methods long", lambda x: (x["relative_path"], x["name"], x["n_methods"])),
    "key_methods": ("relative_path string, name string, branches long", lambda x: (x["relative_path"], x["name"], x["branches"])),
    "complex_files": ("relative_path string, score long", lambda x: (x["relative_path"], x["score"])),
    "complex_classes": ("relative_path string, name string, branches long", lambda x: (x["relative_path"], x["name"], x["branches"])),
    "largest_files": ("relative_path string, line_count long", lambda x: (x["relative_path"], x["line_count"])),
    "services": ("service_name string, classes long, endpoints long", lambda x: (x["service_name"], x["classes"], x["endpoints"])),
    "endpoints": ("path string, handler string", lambda x: (x["path"], x["handler"])),
    "dependencies": ("dependency string, files long", lambda x: (x["dependency"], x["files"])),
    "roles": ("role string, types long", lambda x: (x["role"], x["types"])),
}


@query
def report_document(spark, sf):
    """The report as written, read back: its numbers and every list of it."""
    from corpusmill.sources import report as rp

    files = derived.code_files(spark, sf).unionByName(derived.script_files(spark, sf))
    a = pipeline.analyse_corpus(files, scratch_path(spark, "store"))
    path = scratch_path(spark, "report")
    rp.write_report(pipeline.report(a, {"codebase": "corpus", "mode": "measured"}), path, pipeline.report_tables(a))
    text = spark.read.text(f"{path}/report", wholetext=True).filter("length(value) > 0")

    def listed(name: str):
        schema, parts = REPORT_LISTS[name]
        rows = F.from_json(F.get_json_object("value", f"$.{name}"), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))
        return F.array_join(F.transform(rows, lambda x: F.concat_ws("|", *parts(x))), ";").alias(name)

    return text.select(
        F.get_json_object("value", "$._metadata.total_discovered").cast("long").alias("total_discovered"),
        F.get_json_object("value", "$._metadata.languages.java").cast("long").alias("java_files"),
        F.get_json_object("value", "$.complexity_metrics.total_files").cast("long").alias("total_files"),
        F.get_json_object("value", "$.complexity_metrics.scored_files").cast("long").alias("scored_files"),
        F.get_json_object("value", "$._pipeline.mode").alias("mode"),
        *[listed(name) for name in REPORT_LISTS],
    )
