"""Best-fit packing of documents into fixed-size sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the plan is made from their
histogram alone, on the driver, whatever the number of documents: large lengths are
put into groups of equal cardinality and rounded up to their group's largest; the
few sizes left are packed by configurations that a column-generation linear program
chooses; the k-th document of a group takes the k-th slot of its size.  The gaps
that the actual lengths leave are counted by size again, and small documents go to
the smallest gap that holds them, longest first.  Ranks within a size are the only
thing that the rows themselves have to be sorted for, in as many tasks as the size has
rows for; full pieces fill bins of their own and are only counted.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, small, small_batches
from .text import doc_chunks, string_buffers

CAPACITY = 2048
GROUPS = 32
#: Documents up to this share of the capacity are small.
SMALL = 1 / 8
#: Documents of one size that a task ranks, about.
RANK_ROWS = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def count_words(texts: pa.Array) -> np.ndarray:
    """Runs of bytes that aren't ASCII white space, in each text; 0 for null."""
    buf, offs = string_buffers(pc.fill_null(texts, ""))
    if not len(buf):
        return np.zeros(len(offs) - 1, np.int64)
    word = ~_SPACE[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    at = offs[:-1][np.diff(offs) > 0]
    start[at] = word[at]
    return np.diff(np.searchsorted(np.flatnonzero(start), offs))


def _lengths(texts):
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [count_words(c.column(0)) for c in doc_chunks(batch, "text")]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())


def word_count(text) -> F.Column:
    return F.arrow_udf(_lengths, "long")(text)


# The plan, from counts


def patterns_for(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (items of each size) and how many bins take each.

    Together they hold exactly ``demand``.  The linear program's solution is rounded
    down and the remainder is packed by best fit, longest first.
    """
    g = len(sizes)
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // size).astype(float)
    for _ in range(50 * g + 50):
        price = np.linalg.solve(basis.T, np.ones(g))
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            fit = size <= c
            if fit.any():
                value = np.where(fit, best[np.maximum(c - size, 0)] + price, -1)
                k = int(value.argmax())
                if value[k] > best[c] + 1e-12:
                    best[c], take[c] = value[k], k
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(g), capacity
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                column[take[c]] += 1
                c -= sizes[take[c]]
        x, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.floor(np.linalg.solve(basis, need) + 1e-6).astype(int)
    left = np.array(demand)
    out = []
    for k in range(g):
        col = basis[:, k].astype(int)
        n = max(0, min([int(x[k]), *(left[i] // col[i] for i in range(g) if col[i])]))
        if n:
            out.append((col.tolist(), int(n)))
            left = left - n * col
    rest: dict[tuple[int, ...], int] = {}
    while left.any():
        items, room = np.zeros(g, int), capacity
        for i in np.argsort(-size, kind="stable"):
            k = min(int(left[i]), room // sizes[i])
            items[i] += k
            room -= k * sizes[i]
        n = min(int(left[i] // items[i]) for i in range(g) if items[i])
        rest[tuple(items.tolist())] = rest.get(tuple(items.tolist()), 0) + n
        left = left - n * items
    return out + [(list(p), n) for p, n in rest.items()]


@dataclass
class Plan:
    """Rank intervals of each length: a document's bin is base + (shift + rank - start) // per."""

    length: list[int]
    start: list[int]
    base: list[int]
    shift: list[int]
    per: list[int]
    source: list[int]
    bins: int


def plan_large(counts: dict[int, int], capacity: int, groups: int, first_bin: int = 0) -> Plan:
    """Bins for all documents of the given lengths, by linear grouping."""
    plan = Plan([], [], [], [], [], [], first_bin)
    total = sum(counts.values())
    if not total:
        return plan
    each = -(-total // groups)
    spans: list[list[tuple[int, int, int]]] = []  # of each group: (length, first rank, documents)
    room = 0
    for length in sorted(counts, reverse=True):
        at, n = 0, counts[length]
        while n:
            if not room:
                spans.append([])
                room = each
            k = min(n, room)
            spans[-1].append((length, at, k))
            at, n, room = at + k, n - k, room - k
    merged: dict[int, list[tuple[int, int, int]]] = {}
    for s in spans:  # groups of one rounded size are one
        merged.setdefault(s[0][0], []).extend(s)
    sizes = sorted(merged, reverse=True)
    demand = [sum(k for _, _, k in merged[s]) for s in sizes]
    slots: dict[int, list[tuple[int, int, int]]] = {s: [] for s in sizes}  # (slots, first bin, slots in a bin)
    for pattern, n in patterns_for(sizes, demand, capacity):
        for s, a in zip(sizes, pattern):
            if a:
                slots[s].append((a * n, plan.bins, a))
        plan.bins += n
    for s in sizes:
        queue = iter(slots[s])
        left, base, per = next(queue)
        used = 0
        for length, at, k in merged[s]:
            while k:
                if used == left:
                    (left, base, per), used = next(queue), 0
                n = min(k, left - used)
                for name, value in zip(("length", "start", "base", "shift", "per", "source"), (length, at, base, used, per, -1)):
                    getattr(plan, name).append(value)
                at, k, used = at + n, k - n, used + n
    return plan


def plan_small(counts: dict[int, int], gaps: dict[int, int], capacity: int, first_bin: int) -> Plan:
    """Best fit, longest first, of small documents into gaps, {size: how many bins}.

    ``source`` is the gap class whose bins (by rank, from ``base``) an interval goes
    to, or -1 for new bins, whose numbers ``base`` then is.
    """
    plan = Plan([], [], [], [], [], [], first_bin)
    blocks: dict[int, list[tuple[int, int, int]]] = {}  # gap now -> (source, first, bins)
    rooms: list[int] = []

    def put(gap: int, source: int, first: int, n: int) -> None:
        if gap <= 0 or not n:
            return
        if gap not in blocks:
            blocks[gap] = []
            insort(rooms, gap)
        heapq.heappush(blocks[gap], (source, first, n))

    for gap, n in gaps.items():
        put(gap, gap, 0, n)
    for length in sorted(counts, reverse=True):
        at, n = 0, counts[length]
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                per = capacity // length
                bins = -(-n // per)
                put(capacity, -1, plan.bins, bins)
                plan.bins += bins
                continue
            gap = rooms[k]
            source, first, bins = heapq.heappop(blocks[gap])
            if not blocks[gap]:
                del blocks[gap], rooms[k]
            per = gap // length
            take = min(n, bins * per)
            full, part = divmod(take, per)
            for name, value in zip(("length", "start", "base", "shift", "per", "source"), (length, at, first, 0, per, source)):
                getattr(plan, name).append(value)
            put(gap - per * length, source, first, full)
            if part:
                put(gap - part * length, source, first + full, 1)
            rest = bins - full - bool(part)
            put(gap, source, first + full + bool(part), rest)
            at, n = at + take, n - take
    return plan


def _look_up(spark, plan: Plan):
    """Column function (length, rank) -> struct(source, bin) by the plan's intervals."""
    order = np.lexsort((plan.start, plan.length))
    cols = [np.array(x, np.int64)[order] for x in (plan.length, plan.start, plan.base, plan.shift, plan.per, plan.source)]
    shared = spark.sparkContext.broadcast(cols)

    def find(lengths, ranks):
        length, start, base, shift, per, source = shared.value
        x, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(length, x, "left"), np.searchsorted(length, x, "right")
        while (high - low > 1).any():  # binary search within each row's length
            mid = (low + high) // 2
            right = start[np.minimum(mid, len(start) - 1)] <= r
            low, high = np.where((high - low > 1) & right, mid, low), np.where((high - low > 1) & ~right, mid, high)
        bins = base[low] + (shift[low] + r - start[low]) // per[low]
        return pa.StructArray.from_arrays([pa.array(source[low]), pa.array(bins)], ["source", "bin"])

    return F.arrow_udf(find, "source long, bin long")


def _ranked(df: DataFrame, key: str, order: list[str], counts: dict[int, int], rows: int) -> DataFrame:
    """``df`` with the 0-based ``rank`` of each row among those of its key, of which there are ``counts``."""
    # as many rows as the capacity at most
    parts = df.sparkSession.createDataFrame([(k, -(-n // rows)) for k, n in counts.items()], f"{key} long, parts long")
    salted = df.join(F.broadcast(parts), key).withColumn("part", F.pmod(F.xxhash64(*order), "parts")).drop("parts")
    sizes = salted.groupBy(key, "part").agg(F.count("*").alias("c"))
    before = sizes.select(
        key, "part", (F.sum("c").over(Window.partitionBy(key).orderBy("part")) - F.col("c")).alias("before")
    )
    before = cut(before)
    rank = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1
    return (
        salted.withColumn("rank", rank.cast("long")).join(small(before, before.count(), 48), [key, "part"])
        .withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    )


def _own_bins(pieces: DataFrame, first: int) -> DataFrame:
    """Every row in a bin of its own, numbered from ``first`` by the sizes of the partitions; ``pieces`` is kept in the shared folder."""
    at = pieces.withColumn("k", F.monotonically_increasing_id())
    part = F.shiftright("k", 33)
    offsets = []
    for p, n in sorted((r[0], r[1]) for r in at.groupBy(part).count().collect()):  # a row for each partition
        offsets.append((p, first))
        first += n
    table = pieces.sparkSession.createDataFrame(offsets, "p long, base long")
    within = F.col("k").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("p", part).join(F.broadcast(table), "p").withColumn("bin_id", F.col("base") + within).drop("k", "p", "base")


def _histogram(df: DataFrame, key: str) -> dict[int, int]:
    """{value: rows}; at most as many entries as the capacity."""
    return {r[0]: r[1] for r in df.groupBy(key).count().collect()}


def pack(
    docs: DataFrame, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", length=None,
    groups: int = GROUPS, small_share: float = SMALL, rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """(doc_id, piece, start, length, bin_id): where every part of every document goes.

    A document longer than ``capacity`` is cut into full pieces and a remainder;
    the pieces of a bin are at most ``capacity`` long together.  Lengths are words
    between ASCII white space unless ``length`` (a Column) gives other ones; null
    or zero lengths (null and empty texts) have no piece.  Each repeated row is
    packed; which of several documents of equal length gets which place follows
    from a hash of their ids.  A null id is kept, and so is the ids' type.  A text of any
    length is counted whole.  Bins are numbered from 0 without holes.  An empty table gives
    no rows, and columns that aren't named are not read, so theirs may have any names.
    The plan is made at once, by several jobs.
    """
    docs = small_batches(docs)
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (word_count(F.col(text)) if length is None else length.cast("long")).alias("n")
    )
    n = F.col("n")
    pieces = (
        rows.filter(n > 0)
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / F.lit(capacity)))))
        .withColumn("start", F.col("piece") * capacity)
        .withColumn("length", F.least(n - F.col("start"), F.lit(capacity).cast("long"))).drop("n")
    )
    ids = ["doc_id", "piece", "start"]
    pieces = cut(pieces)
    counts = _histogram(pieces, "length")
    whole = counts.pop(capacity, 0)
    ranked = cut(_ranked(pieces.filter(F.col("length") < capacity), "length", ids, counts, rank_rows))
    limit = max(int(capacity * small_share), 1)
    large = plan_large({k: v for k, v in counts.items() if k > limit}, capacity, groups)
    out = ["doc_id", "piece", "start", "length"]
    placed = ranked.filter(F.col("length") > limit)
    if large.length:
        placed = placed.withColumn("at", _look_up(spark, large)("length", "rank")).select(*out, F.col("at.bin").alias("bin_id"))
    else:
        placed = placed.select(*out, F.lit(None).cast("long").alias("bin_id"))
    placed = cut(placed)
    gaps = placed.groupBy("bin_id").agg((F.lit(capacity) - F.sum("length")).cast("long").alias("gap")).filter("gap > 0")
    gaps = cut(gaps)
    room = _histogram(gaps, "gap")
    tiny = plan_small({k: v for k, v in counts.items() if k <= limit}, room, capacity, large.bins)
    if whole:
        full = pieces.filter(F.col("length") == capacity).select(*out)
        placed = placed.unionByName(_own_bins(full, tiny.bins))
    if not tiny.length:
        return placed
    rest = ranked.filter(F.col("length") <= limit).withColumn("at", _look_up(spark, tiny)("length", "rank"))
    rest = rest.select(*out, "at.source", "at.bin")
    fresh = rest.filter("source = -1").select(*out, F.col("bin").alias("bin_id"))
    gaps = _ranked(gaps, "gap", ["bin_id"], room, rank_rows)
    filled = rest.filter("source >= 0").join(
        gaps.select(F.col("gap").alias("source"), F.col("rank").alias("bin"), "bin_id"), ["source", "bin"]
    ).select(*out, "bin_id")
    return placed.unionByName(fresh).unionByName(filled)
