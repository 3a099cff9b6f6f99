"""The corpus pipeline: operators of taxolyte.llm one after the other over documents.

Every stage works on the rows that the one before has kept, and its decisions take effect: a filtering
stage drops rows, redaction changes texts, packing returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.llm.common import lean, materialize, table
from taxolyte.llm.decontamination import without_leaks
from taxolyte.llm.near_dedup import one_of_each
from taxolyte.llm.packing import pack
from taxolyte.llm.pii import Selector, redact
from taxolyte.llm.quality_classifier import keep_good
from taxolyte.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, with all columns.

    Null texts are empty, null sources and languages are sites of their own, repeated rows are judged alike; an empty
    table stays empty, and without labels all are kept.
    """
    lean(spark)
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, with all columns.

    Texts without words (null, empty, blank) are no duplicates; of rows that share a doc_id one stays, rows with a null doc_id
    all stay; an empty table stays empty.
    """
    lean(spark)
    return one_of_each(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, with all columns.

    Null texts and null doc_ids stay, rows that share a doc_id with a leaking text go too; an empty table, or
    benchmark, changes nothing.
    """
    lean(spark)
    return without_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced; n_chars is that of the new text.

    Null texts stay null (so does their n_chars), all rows and other columns stay as they are.
    """
    out = redact(docs, Selector(spark, docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids in sequences of at most 2048 tokens.

    Null texts are empty (their end id alone), repeated rows and null doc_ids are documents of their own, other columns are
    left out; an empty table gives no rows.
    """
    lean(spark)
    return pack(spark, docs, default_tokenizer(), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("personal data", redact_pii),
    ("packing", packing),
]

#: Trained models and tokenization are part of the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, each to what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
