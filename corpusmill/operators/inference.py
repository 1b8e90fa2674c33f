"""Batch analysis of chunks: store lookup, cost ceiling, the user's function, results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import fixed_values as fv
from corpusmill.functions import texts
from corpusmill.functions.jsonfix import parse_typed, repair_json
from corpusmill.operators.blocks import prefix_sum
from corpusmill.options import Options
from corpusmill.session import cut_lineage, scratch_path
from corpusmill.sources.files import file_system
from corpusmill.sources.store import append_store, read_store

COST_TYPE = "decimal(24,10)"
KEY = ["relative_path", "ordinal"]


# --- store --------------------------------------------------------------------------------------


def chunk_hash(content: Column) -> Column:
    return texts.content_hash(content)


def cache_key(*parts: Column) -> Column:
    """Key of one analysis; by default from the chunk's hash and id, plus whatever else must match
    (a model name, a prompt version)."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, fv.KEY_CHARS)


def with_cache_key(chunks: DataFrame, *extra: Column) -> DataFrame:
    return chunks.withColumn("cache_key", cache_key(chunk_hash(F.col("content")), F.col("chunk_id"), *extra))


def usable(store: DataFrame) -> DataFrame:
    """Entries that count as hits; an empty object does not."""
    return store.filter(F.col("payload").isNotNull() & (F.regexp_replace("payload", r"\s", "") != "{}"))


def lookup(keyed: DataFrame, store: DataFrame) -> DataFrame:
    """All chunks, with ``payload`` (null on a miss) and ``is_hit``."""
    found = usable(store).select("cache_key", "payload")
    return keyed.join(found, "cache_key", "left").withColumn("is_hit", F.col("payload").isNotNull())


def misses(keyed: DataFrame, store: DataFrame) -> DataFrame:
    return keyed.join(usable(store).select("cache_key"), "cache_key", "left_anti")


def cache_stats(looked_up: DataFrame) -> DataFrame:
    hits, total = F.count_if("is_hit"), F.count("*")
    rate = F.bround(100 * hits / F.greatest(total, F.lit(1))).cast("int")
    return looked_up.agg(
        hits.alias("hits"), (total - hits).alias("misses"), F.concat(rate.cast("string"), F.lit("%")).alias("hit_rate")
    )


# --- requests -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """Texts with ``{language} {files} {classes} {functions} {code}`` to fill in."""

    system: str = "You read {language} source code and answer with one JSON object and nothing else."
    user: str = (
        "Files: {files}\nLanguage: {language}\nClasses: {classes}\nFunctions: {functions}\n\n{code}\n\n"
        "Describe this code as JSON with the keys file_path, summary, purpose, key_methods "
        "(name, signature, description, complexity), dependencies, complexity_score (1 to 10) and complexity_notes."
    )


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def render_requests(chunks: DataFrame, template: Template = Template()) -> DataFrame:
    """Add ``system`` and ``user`` texts."""

    def listed(names: Column) -> Column:
        return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("N/A")

    values = {
        "language": F.col("language"),
        "files": F.array_join("source_files", ", "),
        "classes": listed(F.col("class_names")),
        "functions": listed(F.col("function_names")),
        "code": F.col("content"),
    }
    return chunks.withColumn("system", _filled(template.system, values)).withColumn("user", _filled(template.user, values))


def estimate(requests: DataFrame, o: Options | None = None) -> DataFrame:
    o = o or Options()
    return requests.withColumn("est_tokens", o.measure.of_text(F.concat("system", "user")).cast("long"))


# --- cost ---------------------------------------------------------------------------------------


def call_cost(input_tokens: Column, output_tokens: Column, o: Options | None = None) -> Column:
    o = o or Options()
    rate_in, rate_out = F.lit(o.input_cost_per_1k / 1000), F.lit(o.output_cost_per_1k / 1000)
    return (
        input_tokens.cast("decimal(12,0)") * rate_in + output_tokens.cast("decimal(12,0)") * rate_out
    ).cast(COST_TYPE)


def admit(
    df: DataFrame, cost: Column, ceiling: Decimal | Column, order: list[str] = KEY, blocks: int | None = None, group_key: str | None = None
) -> DataFrame:
    """Add ``admitted``: the costs of all earlier rows plus this one's stay below the ceiling.

    ``order`` must be unique. Costs cannot be negative, so what is admitted is a prefix of the order
    and does not depend on which call would finish first. With ``group_key`` each of its values has sums of its own;
    ``ceiling`` may then be a column, and a null one refuses nothing.
    """
    group = [] if group_key is None else [group_key]
    limit = ceiling if isinstance(ceiling, Column) else F.lit(ceiling)
    keys = [*order, *[c for c in group if c not in order]]
    slim = df.select(*keys, cost.cast(COST_TYPE).alias("_cost"), limit.cast(COST_TYPE).alias("_ceiling"))
    summed = prefix_sum(slim, F.col("_cost"), order, "_so_far", blocks, group)
    flags = summed.select(*order, F.coalesce(F.col("_so_far") < F.col("_ceiling"), F.col("_ceiling").isNull()).alias("admitted"))
    return df.join(flags, order)


def usage_report(results: DataFrame, o: Options | None = None) -> DataFrame:
    """Totals over parsed calls: ``est_tokens`` in, ``out_tokens`` out, ``error`` null."""
    done = results.filter(F.col("error").isNull())
    cost = call_cost(F.col("est_tokens"), F.col("out_tokens"), o)
    return done.agg(
        F.coalesce(F.sum("est_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("output_tokens"),
        F.count("*").alias("calls"),
        F.coalesce(F.round(F.sum(cost), 6), F.lit(0)).cast("decimal(24,6)").alias("cost_usd"),
    )


# --- the user's function ------------------------------------------------------------------------


#: Answers that a task holds before it logs them.
LOGGED = 16


def infer(requests: DataFrame, fn: Callable[[str, str], str], keep: list[str], log: str | None = None) -> DataFrame:
    """Call ``fn(system, user)`` per row: columns ``keep`` plus ``raw`` and ``error``.

    A failing row gets its error text and the others go on. Concurrency is the number of partitions. With ``log``, a
    folder that every executor can reach, a task writes its answers there as they come, LOGGED at a time under their
    ``cache_key``; when it is run again, after a lost executor or as a speculative copy, it takes those it finds and
    calls for the rest. The folder belongs to one run.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answers = CallLog(log)
        for batch in batches:
            raws: list[str | None] = []
            errors: list[str | None] = []
            keys = batch["cache_key"] if log else [None] * len(batch)
            for key, system, user in zip(keys, batch["system"], batch["user"]):
                try:
                    raw = answers.known.get(key)
                    if raw is None:
                        raw = fn(system, user)
                        answers.add(key, raw)
                    raws.append(raw)
                    errors.append(None)
                except Exception as e:  # the row reports it
                    raws.append(None)
                    errors.append(str(e) or type(e).__name__)
            answers.flush()
            yield batch[keep].assign(raw=pd.Series(raws, dtype="object", index=batch.index),
                                     error=pd.Series(errors, dtype="object", index=batch.index))

    schema = requests.select(*keep).schema.add("raw", "string").add("error", "string")
    columns = [*keep, "system", "user", *(["cache_key"] if log and "cache_key" not in keep else [])]
    return requests.select(*columns).mapInPandas(call, schema)


class CallLog:
    """Answers of a task, kept in files below the folder of its partition; without a folder nothing is kept."""

    def __init__(self, folder: str | None) -> None:
        self.known: dict[str, str] = {}
        self.new: list[tuple[str, str]] = []
        self.folder, self.written = None, 0
        if folder is None:
            return
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        self.system, self.folder = file_system(f"{folder}/part-{task.partitionId()}")
        self.attempt = task.taskAttemptId()
        for found in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            with self.system.open_input_stream(found.path) as stream:
                lines = stream.read().decode().split("\n")
            for line in lines[:-1]:  # a line without its end was cut off
                key, raw = json.loads(line)
                self.known[key] = raw

    def add(self, key: str | None, raw: str) -> None:
        if self.folder is not None and isinstance(raw, str):
            self.new.append((key, raw))
            if len(self.new) >= LOGGED:
                self.flush()

    def flush(self) -> None:
        if not self.new:
            return
        self.system.create_dir(self.folder)
        with self.system.open_output_stream(f"{self.folder}/{self.attempt}-{self.written}.jsonl") as stream:
            stream.write("".join(json.dumps(pair) + "\n" for pair in self.new).encode())
        self.new, self.written = [], self.written + 1


def given(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with their answers from a table (cache_key, raw, error); one without a row has no answer."""
    found = requests.join(answers.select("cache_key", "raw", "error"), "cache_key", "left")
    return found.withColumn("error", F.coalesce("error", F.when(F.col("raw").isNull(), F.lit("no answer"))))


# --- results ------------------------------------------------------------------------------------

RESULT_TYPES = {
    "relative_path": "string", "ordinal": "long", "chunk_id": "string", "cache_key": "string", "status": "string",
    "payload": "string", "error": "string", "est_tokens": "long", "out_tokens": "long",
}
RESULT_COLUMNS = list(RESULT_TYPES)


def parsed(called: DataFrame, o: Options | None = None) -> DataFrame:
    """Repaired payloads of called rows; a text without an object, or with an empty one, is an error."""
    o = o or Options()
    repaired = called.withColumn("payload", F.nullif(repair_json(F.col("raw")), F.lit("{}")))
    return (
        repaired.withColumn(
            "error", F.coalesce("error", F.when(F.col("payload").isNull(), F.lit("parse failed")))
        )
        .withColumn("out_tokens", F.when(F.col("error").isNull(), o.measure.of_text(F.col("raw"))).cast("long"))
        .withColumn("status", F.when(F.col("error").isNull(), "fresh").otherwise("error"))
    )


def assemble(cached: DataFrame, fresh: DataFrame, rest: DataFrame) -> DataFrame:
    """One row per chunk: hits, called rows and the rest (refused for cost, or not asked). Order by (relative_path, ordinal)."""
    none = F.lit(None)
    hits = cached.select(
        *KEY, "chunk_id", "cache_key", F.lit("cached").alias("status"), "payload", none.cast("string").alias("error"),
        none.cast("long").alias("est_tokens"), none.cast("long").alias("out_tokens"),
    )
    left = rest.select(
        *KEY, "chunk_id", "cache_key", "status", none.cast("string").alias("payload"), "error", "est_tokens",
        none.cast("long").alias("out_tokens"),
    )
    return hits.unionByName(fresh.select(*RESULT_COLUMNS)).unionByName(left)


def analyse(
    chunks: DataFrame, store_path: str, fn: Callable[[str, str], str] | None = None, o: Options | None = None,
    template: Template = Template(), version: Sequence[str] = (), answers: DataFrame | None = None,
) -> DataFrame:
    """Look up, admit, call, repair, store, assemble; with neither ``fn`` nor ``answers`` nothing is asked and misses
    say ``missing``. ``answers`` (cache_key, raw, error) are those of a service that takes its requests as a table.

    ``version`` is what else an answer depends on (a model's name, a prompt's version): with another one, old
    entries aren't found. Token estimates and admissions are written once, without texts; texts are joined to them
    only where a ceiling refuses some. Answers are written before they are used for the store and for the result.
    """
    o = o or Options()
    spark = chunks.sparkSession
    keyed = with_cache_key(chunks, *[F.lit(v) for v in version])
    # This run's entries, read once, before the run appends to the store.
    store = cut_lineage(read_store(spark, store_path, keyed.select("cache_key")))
    hits = lookup(keyed, store).filter("is_hit")
    missing = misses(keyed, store)
    asked = estimate(render_requests(missing, template), o)
    slim = asked.select(*KEY, "chunk_id", "cache_key", "est_tokens")
    if fn is None and answers is None:
        rest = slim.withColumn("status", F.lit("missing")).withColumn("error", F.lit(None).cast("string"))
        return assemble(hits, slim.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in RESULT_TYPES.items()]), rest)
    keep = [*KEY, "chunk_id", "cache_key", "est_tokens"]
    if o.max_cost is None:
        wanted, refused = asked, slim.limit(0)
    else:
        path = scratch_path(spark, "admitted")
        admit(slim, call_cost(F.col("est_tokens"), F.lit(0), o), o.max_cost, KEY, o.blocks).write.parquet(path)
        decided = spark.read.parquet(path)
        wanted = asked.join(decided.filter("admitted").select(*KEY), KEY, "left_semi")
        refused = decided.filter("not admitted")
    results_path = scratch_path(spark, "called")
    called = given(wanted.select(*keep), answers) if fn is None else infer(wanted, fn, keep, scratch_path(spark, "calls"))
    answered = parsed(called, o).select(*RESULT_COLUMNS)
    answered.write.parquet(results_path)
    fresh = spark.read.schema(answered.schema).parquet(results_path)
    append_store(fresh.filter("status = 'fresh'"), store_path)
    rest = refused.withColumn("status", F.lit("error")).withColumn("error", F.lit("budget exceeded"))
    return assemble(hits, fresh, rest)


def typed_analyses(results: DataFrame) -> DataFrame:
    """Typed analyses of rows with a payload; ``file_path`` falls back to the chunk's path."""
    typed = results.filter(F.col("payload").isNotNull()).withColumn("a", parse_typed(F.col("payload")))
    return typed.select(*KEY, "chunk_id", "a.*").withColumn(
        "file_path", F.coalesce(F.nullif("file_path", F.lit("")), "relative_path")
    )


def context_numbers(df: DataFrame, text: str, limit: int, order: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` with the first and last context its text falls in, when all texts, each with one more character for a
    separator, are laid end to end in ``order`` and cut into contexts of ``limit`` characters."""
    slim = df.select(*order, (F.length(text) + 1).cast("long").alias("_chars"))
    summed = prefix_sum(slim, F.col("_chars"), order, "_end", blocks)
    first, last = F.floor((F.col("_end") - F.col("_chars")) / limit), F.floor((F.col("_end") - 1) / limit)
    numbers = summed.select(*order, first.cast("long").alias("first_context"), last.cast("long").alias("last_context"))
    return df.join(numbers, order)
