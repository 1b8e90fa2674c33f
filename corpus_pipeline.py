"""The corpus pipeline: documents in, training-ordered token shards out, five stages of the operators in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import held_out, written
from corpusmill.llm.decontaminate import decontaminate
from corpusmill.llm.mixing import mixed_documents
from corpusmill.llm.ngram_join import one_of_each
from corpusmill.llm.queries import stored_sequences, table
from corpusmill.llm.toxicity import toxicity, train, with_labels


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is under one half; trained on the labelled ones outside the held-out fold."""
    model = train(with_labels(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0)))
    return _passing(docs, toxicity(docs, model), lambda into: into["score"] < 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return _passing(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")), lambda into: ~into["contaminated"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; returns what each slot holds."""
    return stored_sequences(docs)


def _passing(docs: DataFrame, judged: DataFrame, test) -> DataFrame:
    """``docs``' columns of the rows whose verdict, the one column that ``judged`` has besides, passes ``test``."""
    return judged.where(test(F.col(judged.columns[-1]))).select(*docs.columns)


STAGES = [
    ("toxicity", keep_civil),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("token_shards", to_tokens),
]

#: Trained scores, shuffled passes and shards are beyond SQL; the tests run the stages beside plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
