"""Bloom filters as tables: k partitions of m bits, in words of 64."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, cut, free_name

HEADER = 512
PAGE = 4096
DEFAULT_BYTES = 2 << 20
DEFAULT_K = 11


def _suffixed(value: str | float, base: int) -> float:
    if not isinstance(value, str):
        return float(value)
    value = value.strip()
    powers = {"K": 1, "M": 2, "G": 3}
    unit = powers.get(value[-1:].upper(), 0)
    return float(value[:-1] if unit else value) * base**unit


@dataclass(frozen=True)
class BloomParams:
    """``size`` bytes with their header, ``k`` hashes, ``m`` bits for each."""

    size: int
    k: int
    capacity: int
    p: float

    @property
    def m(self) -> int:
        return (self.size - HEADER) * 8 // self.k


def bloom_params(
    capacity: str | float | None = None, p: str | float | None = None, size: str | float | None = None, k: int | None = None
) -> BloomParams:
    """Sizes from any two of capacity (``10K``: thousands), error rate (``1%``) and bytes (``2M``: 1024s).

    Without any two, the bytes are two megabytes; k is what is best for them, or 11 if
    nothing is given.
    """
    n = None if capacity is None else _suffixed(capacity, 1000)
    rate = None if p is None else float(p[:-1]) / 100 if isinstance(p, str) and p.endswith("%") else float(p)
    held = None if size is None else _suffixed(size, 1024)
    if rate is not None and not 0 < rate < 1:
        raise ValueError("the error rate is between 0 and 1")
    ln2 = math.log(2)
    if n and rate and held is None:
        held = math.ceil(math.ceil(-n * math.log(rate) / ln2**2) / 8) + HEADER
    held = DEFAULT_BYTES if held is None else held
    held = max(PAGE, math.ceil(held / PAGE) * PAGE)
    bits = (held - HEADER) * 8
    if n is None:
        rate = rate or 2.0 ** -(k or DEFAULT_K)
        n = -bits / math.log(rate) * ln2**2
    elif rate is None:
        rate = math.exp(-bits / n * ln2**2)
    k = k or max(1, round(ln2 * bits / n))
    return BloomParams(int(held), int(k), int(n), rate)


@dataclass(frozen=True)
class BloomFilter:
    """``words``: (part INT, word BIGINT, bits BIGINT), words without bits left out; ``count``: distinct keys added."""

    params: BloomParams
    words: DataFrame
    count: int


def _hashes(key: Column) -> tuple[Column, Column]:
    text = key.cast("string")
    return F.xxhash64(text, F.lit(0)), F.xxhash64(text, F.lit(1))


def _positions(key: Column, p: BloomParams) -> Column:
    """Array of (part, bit): two hashes make all k, each within its own partition."""
    h1, h2 = _hashes(key)
    m = F.lit(p.m).cast("bigint")
    base, stride = F.pmod(h1, m), F.pmod(h2, F.lit(p.m - 1).cast("bigint")) + 1
    return F.array(*[F.struct(F.lit(i).alias("part"), F.pmod(base + stride * i, m).alias("bit")) for i in range(p.k)])


def _words(keys: DataFrame, p: BloomParams) -> DataFrame:
    at = keys.select(F.explode(_positions(F.col("key"), p)).alias("x")).select("x.part", "x.bit")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    return at.groupBy("part", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _keys(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).cast("string").alias("key")).filter("key IS NOT NULL").distinct()


def bloom_build(df: DataFrame, col: str, params: BloomParams) -> BloomFilter:
    """A filter of the distinct non-null values of ``col``."""
    keys = cut(_keys(df, col))
    return BloomFilter(params, cut(_words(keys, params)), keys.count())


def bloom_sized(df: DataFrame, col: str, p: str | float, k: int | None = None) -> BloomFilter:
    """``bloom_build`` with the size that the counted distinct values need for the error rate ``p``."""
    keys = cut(_keys(df, col))
    n = keys.count()
    params = bloom_params(capacity=max(n, 1), p=p, k=k)
    return BloomFilter(params, cut(_words(keys, params)), n)


def _same(a: BloomFilter, b: BloomFilter) -> None:
    if (a.params.size, a.params.k) != (b.params.size, b.params.k):
        raise ValueError("filters of different sizes don't merge")


def bloom_merge(a: BloomFilter, b: BloomFilter) -> BloomFilter:
    """Both filters' keys; ``count`` is the sum, which counts keys of both twice."""
    _same(a, b)
    words = a.words.unionByName(b.words).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    return BloomFilter(a.params, cut(words), a.count + b.count)


def bloom_lacks(df: DataFrame, col: str, f: BloomFilter) -> DataFrame:
    """(col): the distinct values of ``col``, as strings, that the filter doesn't seem to have."""
    return bloom_has(_keys(df, col).withColumnRenamed("key", col), col, f, keep=False)


def bloom_add(f: BloomFilter, df: DataFrame, col: str) -> BloomFilter:
    """``f`` with the values of ``col``; ``count`` grows by the distinct ones that it didn't seem to have."""
    new = bloom_build(bloom_lacks(df, col, f), col, f.params)
    return replace(bloom_merge(f, new), count=f.count + new.count)


def bloom_probe(df: DataFrame, col: str, f: BloomFilter, hit: str = "hit", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the column ``hit``: may the value be in the filter?  False for null.

    A filter of at most ``limit`` bytes is broadcast as an array of bits; hashes come
    from the JVM, only the bits are looked up in Arrow batches.  A larger one is joined
    word by word to the distinct values.
    """
    p = f.params
    key = F.col(col).cast("string")
    if p.size <= limit:
        part, per = f.words.toArrow(), -(-p.m // 64)
        bits = np.zeros(p.k * per, np.int64)
        bits[part.column("part").to_numpy().astype(np.int64) * per + part.column("word").to_numpy()] = part.column("bits").to_numpy()
        shared = df.sparkSession.sparkContext.broadcast(bits)

        def look(h1: pa.Array, h2: pa.Array) -> pa.Array:
            words = shared.value
            a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (h1, h2))
            base, stride = a % p.m, b % (p.m - 1) + 1
            ok = np.ones(len(a), bool)
            for i in range(p.k):
                bit = (base + stride * i) % p.m
                ok &= (words[i * per + (bit >> 6)] >> (bit & 63)) & 1 == 1
            return pa.array(ok)

        h1, h2 = _hashes(key)
        return df.withColumn(hit, F.col(col).isNotNull() & F.arrow_udf(look, "boolean")(h1, h2))
    k = free_name(df, "key")
    keys = df.select(key.alias("key")).filter("key IS NOT NULL").distinct()
    at = keys.select("key", F.explode(_positions(F.col("key"), p)).alias("x")).select(
        "key", "x.part", F.shiftright("x.bit", 6).alias("word"), (F.col("x.bit") % 64).cast("int").alias("b")
    )
    there = at.join(f.words, ["part", "word"]).filter("getbit(bits, b) = 1")
    found = there.groupBy(F.col("key").alias(k)).agg(F.count("*").alias("c")).filter(F.col("c") == p.k).select(k, F.lit(True).alias(hit))
    return df.drop(hit).withColumn(k, key).join(found, k, "left").withColumn(hit, F.coalesce(hit, F.lit(False))).drop(k)


def bloom_has(df: DataFrame, col: str, f: BloomFilter, keep: bool = True, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``df`` whose value the filter may have; with ``keep=False`` those it can't have."""
    hit = free_name(df, "hit")
    return bloom_probe(df, col, f, hit, limit).filter(F.col(hit) == keep).drop(hit)


def bloom_hit_rate(df: DataFrame, col: str, f: BloomFilter) -> DataFrame:
    """One row (hits, total, pct)."""
    hit = free_name(df, "hit")
    counted = bloom_probe(df, col, f, hit).agg(F.coalesce(F.sum(F.col(hit).cast("bigint")), F.lit(0)).alias("hits"), F.count("*").alias("total"))
    return counted.withColumn("pct", F.when(F.col("total") > 0, 100 * F.col("hits") / F.col("total")))


def bloom_info(f: BloomFilter) -> DataFrame:
    """One row (k, size, m, count)."""
    return f.words.sparkSession.createDataFrame([(f.params.k, f.params.size, f.params.m, f.count)], "k int, size bigint, m bigint, count bigint")
