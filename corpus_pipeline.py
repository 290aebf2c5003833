"""Preparation of a training corpus: toxic documents, near duplicates, repeated passages and leaked test items go, the
rest is packed into sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.  All stages but the last
return the columns of ``documents``, whatever further columns the table has.

Defined results, for all stages: null and empty texts pass the filters unchanged and are packed as empty documents; an empty
table gives an empty table; a table without toxic or without clean labels rejects nothing, and so does an empty benchmark.
Rows that repeat an id are judged one by one, but for near duplicates: of rows of one id one stays there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import decontamination, minhash, packing, substrings, toxicity
from lexiforge.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic evidence beyond the calibrated threshold; the model is fitted on ``labels``.

    Rows of one id are judged each by its own text; null texts stay.
    """
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates, and one row of each id; rows without an id
    stay all."""
    return minhash.keep_first(docs.select(*COLUMNS))


def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that a document of smaller id holds too; a text that goes whole takes its row along."""
    return substrings.strip_repeats(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; repeated rows are judged each, items without id or text count for nothing."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", strip_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No stage can be stated in SQL with the same rows; tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
