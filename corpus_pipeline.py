"""A corpus pipeline over documents: each stage calls one operator on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents; the last adds copy_no.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import contamination, lines, mixing, near, toxicity
from strandflow.llm.common import load, materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the classifier learns from the labelled documents of the training folds.

    Null and empty texts score as a sentence without known words does and stay; null ids are judged like others; rows that repeat
    or tie are judged alike; without labels nothing is known to be toxic and all rows stay; no rows give no rows.
    """
    model = toxicity.train(*toxicity.training_sample(docs, load(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that an earlier one has; n_chars is that of the text that is left.

    Null and empty texts stay as they are; rows that repeat one id and text are one document and get one result; a text of which
    nothing is left is empty; any further columns stay as they are; no rows give no rows.
    """
    return lines.kept_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least id, null ids last.

    Null texts are empty; texts without words are near only to equal ones, so one of them stays; of rows that repeat the chosen one
    a single row stays; any further columns stay as they are; no rows give no rows.
    """
    return near.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold nothing and stay, as do all rows if there are no items; a row is judged by its text, so rows that
    repeat go or stay together, whatever their ids; items that are null or empty are held by nothing; no rows give no rows.
    """
    return contamination.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their target weights: each document as often as it is taken, with copy_no.

    Null sources are one source, the last; null and empty texts have no words; rows that agree in id, text and source share what
    they take; a column of the input that is called copy_no stays, and the new one gets an underscore; no rows give no rows.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL can't express the trained classifier, so there is none for run()'s rows; tests compare it with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
