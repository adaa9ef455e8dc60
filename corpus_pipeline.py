"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and, but for the last, returns
documents with all their columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontam, exact, neardup, packing, quality
from lexmill.llm.runtime import checkpoint_dir, cut, remove


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on ``labels``, accepts.

    Null and empty texts are scored by their metadata and structure alone, null metadata are
    a value of their own, very long texts are scored whole; equal rows, repeated ones among
    them, stay or go together.  Without usable labels all stay; an empty table stays one.
    All columns stay, whatever further ones are called.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one of the least id, of equal ids the first in the scan.

    Rows with a null text all stay, of empty texts and of repeated rows one does; a null id
    comes after all others; texts of any length are compared whole.  An empty table stays
    one.  All columns stay, whatever further ones are called.
    """
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id, of equal ids the first in the scan.

    Null, empty and wordless texts all stay, as they have no shingles; of repeated rows one
    does; a null id comes after all others; very long texts are compared whole.  An empty
    table stays one.  All columns stay, whatever further ones are called.
    """
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``.

    Null, empty and wordless texts stay, repeated rows stay or go together, very long texts
    are searched whole; null or wordless items are in no document, and of several items in
    one document each is enough.  Without documents or items nothing goes.  All columns
    stay, whatever further ones are called.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, bin_id): where each piece of each document goes.

    Null and empty texts have no piece, very long ones are cut into full pieces and a
    remainder; each repeated row is packed, a null id is kept, and a hash of the ids decides
    between documents of one length.  An empty table gives no rows; further columns
    aren't read, whatever they are called.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_neardup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The trained, approximate and packing stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``.

    Tables between stages go to the shared folder and are deleted once they have been read;
    the stages say what they do with nulls, empty and very long texts, ties, repeated rows,
    empty tables and further columns.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    packed = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, folder)
    return packed


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
