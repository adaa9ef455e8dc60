"""Dictionaries and Bloom filters kept as Parquet folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bloom import BloomFilter, BloomParams
from ..operators.enumerate import new_state
from .versions import VersionedTable


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary (term, id) of a folder; an empty one if there is none."""
    return _newest(spark, path) or new_state(spark)


def save_dictionary(state: DataFrame, path: str) -> bool:
    """Write a dictionary, if it isn't what the folder has; did it?

    It becomes a version of its own, which counts once it is whole; the one before stays, as
    ``state`` may be read from it.  A loss at any time leaves one of the two.
    """
    spark = state.sparkSession
    old = _newest(spark, path)
    rows = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("term", "id").cast("decimal(38,0)"))).first())
    if old is not None and rows(old) == rows(state):
        return False
    _write(state.select("term", "id"), path)
    return True


def _newest(spark: SparkSession, path: str) -> DataFrame | None:
    return VersionedTable(spark, path).read()


def _write(df: DataFrame, path: str) -> None:
    held = VersionedTable(df.sparkSession, path)
    held.write(df, held.last() + 1)


def save_bloom(f: BloomFilter, path: str) -> None:
    """Write a filter's words and what describes it, as one version of the folder."""
    p = f.params
    about = json.dumps({"size": p.size, "k": p.k, "capacity": p.capacity, "p": p.p, "count": f.count})
    head = f.words.sparkSession.createDataFrame([(about,)], "about string").coalesce(1)
    _write(f.words.unionByName(head, allowMissingColumns=True), path)


def load_bloom(spark: SparkSession, path: str) -> BloomFilter:
    """The filter of a folder; ValueError if there is none."""
    held = _newest(spark, path)
    if held is None:
        raise ValueError(f"no filter in {path}")
    about = json.loads(held.filter("about IS NOT NULL").first().about)
    count = about.pop("count")
    return BloomFilter(BloomParams(**about), held.filter("about IS NULL").drop("about"), count)
