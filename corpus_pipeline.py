"""A training corpus from ``documents``: language, toxicity, near duplicates, benchmark passages, token ids.

Every stage is a function of (spark, docs, sf_dir) and works on all that the stage before it kept. What a stage returns is
written to the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, language, minhash, toxicity
from ledgerloom.llm.common import landed, table
from ledgerloom.llm.queries import vocabulary_file

COLUMNS = ("text", "lang", "source", "n_chars")
#: share of the letters that the main language of a kept document has at least
LEAST_LANGUAGE_SHARE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no language has the main share of."""
    model = language.train(docs.where(~language.held_out("doc_id")), "text", "lang", "doc_id")
    labelled = language.label_spans(docs, "doc_id", "text", model, carry=COLUMNS)
    kept = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SHARE)
    return labelled.where(kept).select("doc_id", *COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted to be toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=COLUMNS)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("doc_id", *COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    dropped = minhash.near_duplicates(docs, percent=85).where(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select("doc_id", *COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select("doc_id", *COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept document, with digests of the ids and of the text they decode to."""
    return bpe.digests(docs, "doc_id", "text", vocabulary_file())


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: language and toxicity models and the tokenizer are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
