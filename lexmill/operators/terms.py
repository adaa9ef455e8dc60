"""Terms, n-grams and their frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import fast_tokens, tokens
from ..runtime import cut, free_name, numbered


def _rows(df: DataFrame, array, name: str) -> DataFrame:
    drop = {name.lower(), "pos"}
    return df.select(*[c for c in df.columns if c.lower() not in drop], F.posexplode(array).alias("pos", name))


def terms(df: DataFrame, text: str = "text", unicode: str = "full", normal: bool = False) -> DataFrame:
    """df's columns but ``text``, with a row (pos, term) for each term, pos from 0; row-local, so also for streams."""
    return _rows(df, tokens(text, unicode, normal), "term").drop(text)


def fast_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """As ``terms``, by ASCII classes only."""
    return _rows(df, fast_tokens(text), "term").drop(text)


def ngrams(df: DataFrame, n: int, text: str = "text", unicode: str = "full", normal: bool = False) -> DataFrame:
    """A row (pos, ngram) for every run of n terms of a document; documents with fewer give none.

    Row-local: terms have no blank inside, so the runs are cut from the joined terms by one
    pattern, and nothing is shuffled.
    """
    joined = F.array_join(tokens(text, unicode, normal), " ")
    runs = F.regexp_extract_all(joined, F.lit(f"(?<![^ ])(?=({' '.join(['[^ ]++'] * n)}))"), F.lit(1))
    return _rows(df, runs, "ngram").drop(text)


def term_freq(rows: DataFrame, term: str = "term") -> DataFrame:
    """(term, n): how often each term occurs; partial counts meet in one shuffle."""
    return rows.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("n"))


def doc_freq(rows: DataFrame, doc_id: str = "doc_id", term: str = "term") -> DataFrame:
    """(term, n): how many documents have each term."""
    return rows.groupBy(F.col(term).alias("term")).agg(F.countDistinct(doc_id).alias("n"))


def doc_freq_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text", unicode: str = "full", normal: bool = False) -> DataFrame:
    """``doc_freq`` of the terms of texts: each text gives its distinct terms, so that a task holds terms and not pairs.

    Only of ids that several rows have are the pairs counted; a null id counts as none.
    """
    each = df.select(F.col(doc_id).alias("doc_id"), F.array_distinct(tokens(text, unicode, normal)).alias("t"))
    ids = df.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    several = cut(ids.agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    single, pairs = each, None
    if not several.isEmpty():
        single = each.join(several, "doc_id", "left_anti")
        pairs = each.join(several, "doc_id", "left_semi").select("doc_id", F.explode("t").alias("term")).distinct()
    rows = single.select("doc_id", F.explode("t").alias("term"))
    rows = rows if pairs is None else rows.unionByName(pairs)
    return rows.groupBy("term").agg(F.count("doc_id").alias("n"))


def tf_ratio(tf: DataFrame, corpus: DataFrame, digits: int = 6) -> DataFrame:
    """(term, ratio) of the terms that both (term, n) tables have: n here by n there."""
    c = corpus.select("term", F.col("n").alias("corpus_n"))
    return tf.join(c, "term").select("term", F.round(F.col("n") / F.col("corpus_n"), digits).alias("ratio"))


def in_order(rows: DataFrame, *order: str, descending: bool = False) -> DataFrame:
    """``rows`` sorted by the columns ``order``, with their ``place`` from 1; strings by their bytes, nulls first.

    ``descending`` turns the first column, a number, alone; ties are in the order of the
    others.  Sorted by ranges: no task sees all rows, and partitions follow each other.
    """
    key = free_name(rows, "key")
    keyed = rows.withColumn(key, -F.col(order[0]) if descending else F.col(order[0]))
    return numbered(keyed, [key, *order[1:]], "place").drop(key)
