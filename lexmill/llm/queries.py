"""Registered queries of the operators, and their DuckDB SQL where it can say the same."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread
from . import decontam, exact, langid, licenses, neardup, packing, quality, repeats, tokens, warc
from .runtime import checkpoint_dir, cut, remove
from .text import WORD_RE

#: Of a public byte-level BPE; ``LEXMILL_VOCABULARY`` names another file.
VOCABULARY = os.environ.get("LEXMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for operators that don't number rows by their places in the scan."""
    return spread(_table(spark, sf_dir, "documents"), "doc_id")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_spread(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, keep_id
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents) AS g
WHERE doc_id <> keep_id
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(_spread(spark, sf_dir))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, read member by member from the rewriting of files of one gzip stream each."""
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = cut(warc.write_monolithic(_table(spark, sf_dir, "pages"), f"{folder}/whole"))
    index = warc.normalise(files, f"{folder}/members")
    remove(spark, f"{folder}/whole")
    return warc.read_pages(index).withColumn("page_id", F.col("page_id").cast("long"))


OP4_SQL = """
SELECT page_id, url, html, CAST(strlen(html) AS BIGINT) AS content_length FROM pages
"""


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_spans(_spread(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(_table(spark, sf_dir, "documents"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_tokens(_spread(spark, sf_dir), VOCABULARY)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_spread(spark, sf_dir))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_spread(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD_RE}') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), {decontam.N}) AS m FROM b WHERE len(w) > 0),
isets AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS s
  FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS k FROM i) AS x
),
dsets AS (
  SELECT DISTINCT doc_id, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS s
  FROM (
    SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS k
    FROM d, (SELECT DISTINCT m FROM i) AS ms WHERE len(w) >= m
  ) AS y
),
sizes AS (SELECT item_id, count(*) AS q FROM isets GROUP BY item_id),
hits AS (
  SELECT dsets.doc_id, isets.item_id, count(*) AS c
  FROM dsets JOIN isets ON dsets.s = isets.s AND dsets.m = isets.m GROUP BY dsets.doc_id, isets.item_id
)
SELECT hits.doc_id, hits.item_id, hits.c / sizes.q AS containment
FROM hits JOIN sizes ON hits.item_id = sizes.item_id
WHERE hits.c / sizes.q >= {decontam.THRESHOLD}
"""


def queries() -> dict:
    return {
        "op1_quality_fm": op1_quality_fm,
        "op10_decontamination": op10_decontamination,
        "op3_license_scan": op3_license_scan,
        "op4_warc_normaliser": op4_warc_normaliser,
        "op5_language_crf": op5_language_crf,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_token_packing": op7_token_packing,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_minhash_neardup": op9_minhash_neardup,
        "op2_exact_dedup": op2_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op4_warc_normaliser": OP4_SQL,
        "op10_decontamination": OP10_SQL,
    }
