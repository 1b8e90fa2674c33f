"""The operators' registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.bpe import decoded, encoded, vocabulary
from corpusmill.llm.collocations import collocations
from corpusmill.llm.common import held_out, written
from corpusmill.llm.decontaminate import decontaminate
from corpusmill.llm.filter_audit import audit, cells, failures, text_filters
from corpusmill.llm.language import language, profiles
from corpusmill.llm.line_align import without_aligned_lines
from corpusmill.llm.mixing import mix
from corpusmill.llm.ngram_join import jaccard_classes
from corpusmill.llm.pitman_yor import pitman_yor_scores
from corpusmill.llm.quality import Rule, base_failed, cascade, default_rules, measures
from corpusmill.llm.repeats import without_repeats
from corpusmill.llm.token_shards import read_slots, write_shards
from corpusmill.llm.toxicity import toxicity, train, with_labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_sequences(docs: DataFrame) -> DataFrame:
    """The documents as shards, and for each slot what the manifest says and the hash of what its record holds."""
    shards = write_shards(docs)
    held = read_slots(docs.sparkSession, shards).select("slot", F.sha2("tokens", 256).alias("tokens_sha256"))
    doc_ids = F.transform("docs", lambda d: d["doc"]).alias("doc_ids")
    return shards.manifest.join(held, "slot").select("slot", "shard", "offset", "n_tokens", doc_ids, "docs", "tokens_sha256")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key", "class_key")


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("m", measures())
    base = Rule("base", base_failed("m"))
    judged = cascade(docs, default_rules("m"), first=base, into="rejected_by")
    m = [F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *m, base.rejects.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op4_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    taken = m.schedule.groupBy("_row").agg(F.sum(F.col("end") - F.col("start")).alias("taken"))
    known = m.sources.select(F.col("source").alias("_source"), "source_size", "target")  # a row for each source
    rows = m.rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).join(taken, "_row", "left")
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out("doc_id", 7, 2))


def op6_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_spans = (F.size("spans") / 2).cast("long").alias("n_spans")
    return cut.select("doc_id", "n_bytes", "n_removed", n_spans, "kept_sha256")


def op7_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_aligned_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), into="lines")
    return cut.select("doc_id", "lines.n_lines", "lines.removed", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), into="leak")
    items = F.col("leak.items")
    return found.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        "leak.contaminated",
    )


def op9_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 5, 0)
    found = language(docs.select("doc_id", "text"), profiles(docs.where(~out)), into="found")
    return found.select("doc_id", out.alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score")


def op10_multiple_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = held_out("doc_id", 5, 0)
    found = toxicity(docs, train(with_labels(docs, labels, ~out)), into="tox")
    predicted = (F.col("tox.score") >= 0.5).cast("int")
    return found.select("doc_id", out.alias("held_out"), "tox.score", predicted.alias("predicted"), "tox.sentences")


def op11_bpe_automaton(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    v = vocabulary(path)
    done = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), v), v)
    as_text = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(as_text.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    return written(digests, "bpe-digests", batch=500)


def op12_rollup_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang")).withColumnRenamed("group", "lang")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    failed = failures(docs, text_filters(), repeated="E")
    return audit(cells(failed, table(spark, sf_dir, "labels")), "ABCDE")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_jaccard_forest": op2_jaccard_forest,
    "op3_quality_cascade": op3_quality_cascade,
    "op4_golden_mix": op4_golden_mix,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_previous_factors": op6_previous_factors,
    "op7_patience_lines": op7_patience_lines,
    "op8_wu_manber": op8_wu_manber,
    "op9_rank_order": op9_rank_order,
    "op10_multiple_instance": op10_multiple_instance,
    "op11_bpe_automaton": op11_bpe_automaton,
    "op12_rollup_phrases": op12_rollup_phrases,
    "op13_filter_audit": op13_filter_audit,
}
