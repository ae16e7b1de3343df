"""A training-data pipeline over the documents table, in five stages.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. Rejected documents are gone
for good; personal data are masked in the text that is packed. What a stage stages, and what it read, is dropped
once its own result is written; the last result goes with the session.

Nulls: documents with a null text count as empty: they pass all stages and are packed as their end mark. Those with a null id
can't be labelled or be copies of others; they pass these stages, are judged by their text in the others, and are packed with a null id.
Ties: of equal or near copies the smallest id stays; rows of a repeated id stay or go together, but for the toxicity of each one's text.
An empty table gives an empty result of the same columns. Extra columns stay up to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import decontaminate, jaccard, packing, pii, toxicity
from lexispark.llm.common import Staged, read, staging


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels that aren't held out, doesn't call toxic."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask_personal(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal),
    ("packing", pack),
]

#: SQL can't express the trained models and the tokeniser; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    return run_over(spark, read(spark, sf_dir, "documents"), sf_dir)


def run_over(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over docs; labels and benchmark are those of the folder."""
    last = None
    for name, stage in STAGES:
        with staging():
            new = Staged.of(stage(spark, docs, sf_dir), f"stage-{name}")
            new.keep()
        if last is not None:
            last.drop()
        last, docs = new, new.df
    return docs
