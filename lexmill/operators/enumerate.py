"""Stable whole-number ids for terms, in order of their first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, cut, free_name, numbered

#: A term of so large a share of all rows is looked up without a shuffle.
SHARE = 1e-4
#: Beside these the most frequent terms are, up to so many bytes.
FREQUENT_BYTES = 16 << 20
#: Of a pair of whole numbers held as one, the second has so many bits.
PAIR_BITS = 24
#: Stands for whole numbers that aren't held as one; before all that are.
UNFIT = -(1 << 63)


def new_state(spark) -> DataFrame:
    """An empty dictionary (term, id)."""
    return spark.createDataFrame([], "term string, id bigint")


def _as_one(df: DataFrame, order: list[str]) -> Column | None:
    """The columns ``order``, one or two of whole numbers, as one in the same order; UNFIT where they don't fit, None for others.

    The first row of a term is then found by hashing; a struct would have all rows sorted.
    """
    kinds = [kind for _, kind in df.select(*order).dtypes]
    if len(order) > 2 or any(k not in ("tinyint", "smallint", "int", "bigint") for k in kinds):
        return None
    a, *b = [F.col(c).cast("bigint") for c in order]
    if not b:
        return F.coalesce(a, F.lit(UNFIT))
    most = 1 << (63 - PAIR_BITS)
    fit = a.between(1 - most, most - 1) & b[0].between(0, (1 << PAIR_BITS) - 1)
    return F.when(fit, F.shiftleft(a, PAIR_BITS).bitwiseOR(b[0])).otherwise(F.lit(UNFIT))


def _entries(df: DataFrame, order: list[str], term: str, state: DataFrame | None) -> DataFrame:
    """(term, id, n) of the terms of ``df`` that aren't in the dictionary, with their rows in ``df``; kept in the shared folder."""
    rows = df.filter(F.col(term).isNotNull()).groupBy(F.col(term).alias("term"))
    start = 1 if state is None else (state.agg(F.max("id")).first()[0] or 0) + 1

    def placed(first: Column) -> DataFrame:
        found = rows.agg(F.min(first).alias("first"), F.count("*").alias("n"))
        if state is not None:
            found = found.join(state.select("term"), "term", "left_anti")
        return numbered(found, ["first", "term"], "id", start)

    one = _as_one(df, order)
    got = None if one is None else placed(one)
    if got is None or not got.filter(F.col("first") == UNFIT).isEmpty():
        got = placed(F.struct(*order))
    return got.select("term", "id", "n")


def new_entries(df: DataFrame, order: list[str], term: str = "term", state: DataFrame | None = None) -> DataFrame:
    """(term, id) of the terms of ``df`` that aren't in the dictionary; their ids follow its greatest.

    Null terms get no id.  One shuffle finds where terms first appear; numbering is by
    ranges, so no task sees the whole dictionary.
    """
    return _entries(df, order, term, state).select("term", "id")


def extend_state(df: DataFrame, order: list[str], term: str = "term", state: DataFrame | None = None) -> DataFrame:
    """The dictionary (term, id) after all of ``df``: known terms keep their ids, new ones follow the greatest."""
    added = new_entries(df, order, term, state)
    return added if state is None else state.select("term", "id").unionByName(added)


def look_up(df: DataFrame, state: DataFrame, term: str = "term", missing: int | None = 0, counted: bool = False) -> DataFrame:
    """``df`` with the ids of its terms; unknown terms get ``missing``.

    A dictionary that is checked to be small is broadcast, and rows stay where they are.
    For a larger one the frequent terms, which would fill a task each and are nearly all rows,
    get their ids from a broadcast table of their own, and only the others are shuffled, and
    once the entries of these.  ``counted``: the dictionary has the rows of ``df`` by term as n.
    """
    known = state.select("term", "id", *["n"] * counted)
    rows = df.drop("id")
    entry = lambda entries, name="id": entries.select(F.col("term").alias(term), F.col("id").alias(name))
    size = known.agg(F.coalesce(F.sum(_bytes("term")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        got = rows.join(F.broadcast(entry(known)), term, "left")
    else:
        if not counted:
            n = rows.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("n"))
            known = cut(known.join(n, "term"))
        least = _least(known)
        often = free_name(rows, "often")
        marked = rows.join(F.broadcast(entry(_frequent(known, least), often)), term, "left")
        local = F.col(often).isNotNull() | F.col(term).isNull()
        rest = marked.filter(~local).drop(often).join(entry(known.filter(F.col("n") < least)), term, "left")
        got = marked.filter(local).withColumnRenamed(often, "id").unionByName(rest)
    return got if missing is None else got.withColumn("id", F.coalesce("id", F.lit(missing).cast("bigint")))


def _bytes(term: str) -> Column:
    return F.octet_length(term) + 24


def _least(counts: DataFrame) -> float:
    """The least n of the frequent terms of (term, n): those with a share of SHARE of all rows, 1 / SHARE at most, and the next as long as all take FREQUENT_BYTES.

    Only sums for each step of n, a few hundred, meet on the driver.
    """
    step = F.floor(F.log2("n") * 8)
    steps = counts.filter(F.col("term").isNotNull()).groupBy(step.alias("step")).agg(
        F.min("n").alias("least"), F.sum(_bytes("term")).alias("bytes"), F.sum("n").alias("n")
    ).orderBy(F.desc("step")).collect()
    least, held = max(sum(s["n"] for s in steps) * SHARE, 1), 0
    for s in steps:
        held += s["bytes"]
        if held > min(FREQUENT_BYTES, BROADCAST_BYTES):
            break
        least = min(least, s["least"])
    return least


def _frequent(counts: DataFrame, least: float | None = None) -> DataFrame:
    """The frequent terms of (term, n)."""
    return counts.filter(F.col("n") >= (_least(counts) if least is None else least))


def enumerate_terms(
    df: DataFrame, order: list[str], term: str = "term", state: DataFrame | None = None, extend: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(df with ids, dictionary after it); without ``extend`` unknown terms get 0 and the dictionary stays."""
    if not extend:
        state = new_state(df.sparkSession) if state is None else state
        return look_up(df, state, term), state
    if state is None:
        entries = _entries(df, order, term, None)
        state = entries.select("term", "id")
        return look_up(df, entries, term, counted=True), state
    state = cut(extend_state(df, order, term, state))
    return look_up(df, state, term), state


def distinct_ids(df: DataFrame, term: str = "term") -> DataFrame:
    """(term, id): distinct terms numbered in their own order."""
    return numbered(df.select(F.col(term).alias("term")).filter("term IS NOT NULL").distinct(), ["term"], "id").select("term", "id")
