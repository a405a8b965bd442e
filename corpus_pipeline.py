"""A corpus pipeline: documents in, token files of a clean, deduplicated, decontaminated mix out.

run() applies STAGES in order; each takes the rows its predecessor kept, written as Parquet.

Null and empty texts pass the first three stages, are kept once by the mix, and end as documents of the end id alone. Rows with a NULL
doc_id have no component and can't be reported as contaminated: they stay. Repeated rows are one group of copies by their doc_id: all of
them stay, as the row with the group's smallest doc_id does. NULL sources are a source of their own. Extra columns stay until the token files,
whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import decontaminate, mixing, ngram_join, tokens, toxicity
from evalspark.llm.common import fresh, shared_path, table, written
from evalspark.llm.queries import token_report


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, fitted on the labelled ones, scores below 0.7."""
    model = toxicity.fit_rows(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    score = fresh(docs, "_toxicity")
    return toxicity.score_toxicity(docs, model, out=score).where(F.col(score) < 0.7).drop(score)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of near copies."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window like a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns, from them, each document's place, length and checksum."""
    path = shared_path(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path)
    return token_report(spark, path)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("tokens", token_files),
]

#: SQL can't express the toxicity model and the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
