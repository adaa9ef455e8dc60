"""Exact duplicates by distributed MSD radix partitioning.

The sort key of a document is its UTF-8 bytes behind an eight-byte length, most
significant byte first.  Round r splits every group by its members' next digit, a
run of bytes; members alone in their group leave, groups whose bytes have ended
are sets of equal documents, the others go to round r+1.  Digits are compared as
they are, so equality rests on the bytes and on no digest.  Only digits are
shuffled in the first round, and from then on only documents that still have
company, so unique documents (nearly all of a corpus) pay for 64 bytes each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, free_name, small

FIRST_DIGIT = 64
GROWTH = 4


def _length(text: str):
    return F.octet_length(text).cast("long")


def _digit(text: str, at: int, width: int):
    return F.substring(F.encode(F.col(text), "UTF-8"), at + 1, width)


def equal_groups(
    docs: DataFrame, row: str, text: str, first_digit: int = FIRST_DIGIT, growth: int = GROWTH
) -> DataFrame | None:
    """(row, group) of every row whose text another row has too; group = least row.

    ``row`` must identify rows; null texts are in no group, empty texts are equal.
    None if no two texts agree in length and first digit.
    """
    docs = docs.select(F.col(row).alias("r"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    key = docs.select("r", _length("t").alias("n"), _digit("t", 0, first_digit).alias("d"))
    company = cut(
        key.groupBy("n", "d").agg(F.count("*").alias("c"), F.min("r").alias("g")).filter("c > 1")
        .select("n", "d", "g")
    )
    groups = company.count()
    if groups == 0:
        return None
    at = first_digit
    live = docs.withColumns({"n": _length("t"), "d": _digit("t", 0, first_digit)}).join(
        small(company, groups, first_digit + 48), ["n", "d"]
    )
    # members that end here need no text any more
    live = cut(live.select("r", "g", "n", F.when(F.col("n") > at, F.col("t")).alias("t")))
    found = live.filter(F.col("n") <= at).select("r", "g")
    width = first_digit * (growth - 1)
    live = live.filter(F.col("n") > at)
    while not live.isEmpty():
        digit = live.withColumn("d", _digit("t", at, width))
        split = cut(
            digit.groupBy("g", "d").agg(F.count("*").alias("c"), F.min("r").alias("h"))
            .filter("c > 1").select("g", "d", "h")
        )
        at += width
        width = at * (growth - 1)
        count = split.count()
        live = digit.join(small(split, count, at + 48), ["g", "d"]).select(
            "r", F.col("h").alias("g"), "n", F.when(F.col("n") > at, F.col("t")).alias("t")
        )
        live = cut(live)
        found = found.unionByName(live.filter(F.col("n") <= at).select("r", "g"))
        live = live.filter(F.col("n") > at)
    return found.select(F.col("r").alias("row"), F.col("g").alias("group"))


def _numbered(docs: DataFrame, doc_id: str) -> tuple[DataFrame, str]:
    """docs with a struct that orders and identifies its rows: id, then place in the scan."""
    row = free_name(docs, "row")
    key = F.struct(
        F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("v"), F.monotonically_increasing_id().alias("k")
    )
    return docs.withColumn(row, key), row


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **digits) -> DataFrame:
    """(doc_id, keep_id) of every document that repeats another's text.

    Of equal texts the one with the least id stays (of equal ids the first in the
    scan, a null id only if all are null); each other row gives one result row.
    Texts are compared byte by byte; empty texts equal one another, a null text
    equals nothing; texts of any length are compared to their ends.  Repeated rows are
    duplicates of the first.  Other columns, whatever their names, are not looked at.  No
    rows for an empty table.  The rounds are jobs that run before this returns.
    """
    rows, row = _numbered(docs.select(doc_id, text), doc_id)
    groups = equal_groups(rows, row, text, **digits)
    if groups is None:
        return docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).alias("keep_id")).limit(0)
    return groups.filter("row.k <> group.k").select(
        F.col("row.v").alias("doc_id"), F.col("group.v").alias("keep_id")
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **digits) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` names; all columns stay.

    Rows with a null text all stay, an empty table stays one, and further columns may have
    any names.  ``docs`` must give its rows in the same order each time it is computed (a
    file scan does).
    """
    rows, row = _numbered(docs, doc_id)
    groups = equal_groups(rows, row, text, **digits)
    if groups is None:
        return docs
    gone = cut(groups.filter("row.k <> group.k").select(F.col("row.k").alias(row)))
    kept = rows.withColumn(row, F.col(row)["k"])
    return kept.join(small(gone, gone.count(), 16), row, "left_anti").drop(row)
