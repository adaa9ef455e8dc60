"""Text in: files as documents, lines and fields.  Text out: terms, matches, tables, pages."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import tokens

STDIN = "<stdin>"


def documents(spark: SparkSession, paths: str | list[str], skip_bad: bool = True) -> DataFrame:
    """(doc_id, text): a row for each file; those that can't be read are left out if ``skip_bad``."""
    reader = spark.read.option("ignoreCorruptFiles", skip_bad).option("ignoreMissingFiles", skip_bad)
    return reader.text(paths, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def raw_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, content): the bytes of each file."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("doc_id"), "content")


def from_text(spark: SparkSession, text: str, doc_id: str = STDIN) -> DataFrame:
    """One document of a text at hand."""
    return spark.createDataFrame([(doc_id, text)], "doc_id string, text string")


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns but ``text``, with a row (line_no, line) for each line, line_no from 1.

    A last line without its line end counts; a null or empty text has no lines.
    """
    body = F.regexp_replace(text, r"\n\z", "")
    split = F.when(F.length(text) > 0, F.split(body, "\n", -1))
    others = [c for c in df.columns if c not in (text, "line_no", "line")]
    return df.select(*others, F.posexplode(split).alias("k", "line")).select(
        *others, (F.col("k") + 1).cast("bigint").alias("line_no"), "line"
    )


def columns(df: DataFrame, delim: str = "\t", line: str = "line") -> DataFrame:
    """``df`` with the array ``fields`` of each line's parts between delimiters."""
    return df.withColumn("fields", F.split(line, f"\\Q{delim}\\E", -1))


def render_terms(rows: DataFrame, doc_id: str = "doc_id", term: str = "term", separator: bool = True) -> DataFrame:
    """(doc_id, text): a document's terms a line each in their order, with a page end behind if ``separator``."""
    listed = rows.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(term).alias("t")))).alias("l"))
    body = F.concat(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n\f\n" if separator else "\n"))
    return listed.select(doc_id, body.alias("text"))


def render_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: bool = True) -> DataFrame:
    """(doc_id, text): as ``render_terms`` of the terms of each text, a row for each row that has any; local to a row."""
    found = df.select(doc_id, tokens(text).alias("t")).filter(F.size("t") > 0)
    return found.select(doc_id, F.concat(F.array_join("t", "\n"), F.lit("\n\f\n" if separator else "\n")).alias("text"))


def render_matches(report: DataFrame, counts: bool = True) -> DataFrame:
    """(value): the rows of a match report as lines with tabs."""
    cols = ["label", F.col("n").cast("string"), "doc_id"] if counts else ["label", "doc_id"]
    return report.select(F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).alias("value"))


def render_distances(rows: DataFrame) -> DataFrame:
    """(value): pairs and their distance as lines with tabs; a thousand and more is a plus sign."""
    return rows.select(F.concat_ws("\t", "a", "b", F.when(F.col("d") >= 1000, "+").otherwise(F.col("d").cast("string"))).alias("value"))


def render_score(score: str = "score") -> F.Column:
    """A score with six digits."""
    return F.format_string("%.6f", F.col(score).cast("double"))


def render_hits(rate: DataFrame, source: str = STDIN) -> DataFrame:
    """(value): of (hits, total, pct) the line ``hits``, source, hits by total and the rate with two digits; 0.00 of none."""
    share = F.format_string("%d/%d", "hits", "total")
    return rate.select(F.concat_ws("\t", F.lit("hits"), F.lit(source), share, F.format_string("%.2f%%", F.coalesce("pct", F.lit(0.0)))).alias("value"))


def render_id(number: str = "id") -> F.Column:
    """An id as digits."""
    return F.col(number).cast("string")


def render_profile(profile: DataFrame) -> DataFrame:
    """(value): a line for each bucket of a letter profile: size and bucket, its share, its grams, the most frequent first."""
    grams = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "gram")))
    one = profile.groupBy("n", "bucket").agg(F.sum("pct").alias("pct"), grams.alias("g"))
    code = F.lpad(F.lower(F.hex("bucket")), F.col("n") + 1, F.lit("0"))
    names = F.array_join(F.transform("g", lambda x: x["gram"]), " ")
    line = F.concat(F.col("n").cast("string"), F.lit(":"), code, F.format_string("\t%.6f%%\t ", "pct"), names)
    return one.select(line.alias("value"))


def pipe_pages(pages: DataFrame, command: list[str], text: str = "text") -> DataFrame:
    """``pages`` with each non-empty page replaced by what ``command`` makes of it.

    The command runs once a page with the page as its input; rows and their other
    columns stay.  Raises if a command fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                subprocess.run(command, input=t.encode(), stdout=subprocess.PIPE, check=True).stdout.decode("utf-8", "replace") if t else t
                for t in b.column(text).to_pylist()
            ]
            k = b.schema.get_field_index(text)
            yield b.set_column(k, b.schema.field(k), pa.array(out, b.schema.field(k).type))

    return pages.mapInArrow(run, pages.schema)


def joined_pages(pages: DataFrame, key: str = "doc_id", sep: str = "\f\n", text: str = "text") -> DataFrame:
    """(key, text): the pages of a document in the order of their ``page_no`` with ``sep`` between, as many as there are numbers.

    Of pages that were left out as empty the separators stay, up to the last page there is.
    A document is one row, as a file is; its pages meet in one task.
    """
    listed = F.sort_array(F.collect_list(F.struct("page_no", F.col(text).alias("t"))))
    step = lambda a, x: F.struct(F.concat(a["t"], F.repeat(F.lit(sep), x["page_no"] - a["n"]), x["t"]).alias("t"), x["page_no"].alias("n"))
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("n"))
    return pages.groupBy(key).agg(F.aggregate(listed, start, step)["t"].alias(text))
