"""Letter n-gram profiles of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letter_grams(text: Column | str, n: int) -> Column:
    """Array of all runs of n ASCII letters."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(f"(?=([A-Za-z]{{{n}}}))"), F.lit(1))


def bucket(gram: Column | str, n: int) -> Column:
    """Hash of a gram to 5n bits: its letters' codes as digits to the base 32, carries and all."""
    c = F.col(gram) if isinstance(gram, str) else gram
    code = F.lit(0)
    for k in range(1, n + 1):
        code = code * 32 + F.ascii(F.substring(c, k, 1))
    return code.bitwiseAND((1 << (5 * n)) - 1)


def letter_profile(df: DataFrame, sizes: tuple[int, ...] = (2, 3), least: float = 0.1, text: str = "text") -> DataFrame:
    """(n, gram, bucket, cnt, pct): the grams that make up ``least`` per cent or more of all of their size."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), letter_grams(text, n).alias("g")) for n in sizes])
    grams = df.select(F.explode(each).alias("x")).select("x.n", F.explode("x.g").alias("gram"))
    counts = grams.groupBy("n", "gram").agg(F.count("*").alias("cnt"))
    totals = counts.groupBy("n").agg(F.sum("cnt").alias("total"))
    code = F.coalesce(*[F.when(F.col("n") == n, bucket("gram", n)) for n in sizes])
    # a row for each size of gram
    return (
        counts.join(F.broadcast(totals), "n").withColumn("pct", 100 * F.col("cnt") / F.col("total")).filter(F.col("pct") >= least)
        .select("n", "gram", code.cast("int").alias("bucket"), "cnt", "pct")
    )
