"""MinHash near duplicates with an LSH forest.

Every document has a MinHash signature of its 3-word shingles.  Each tree of the
forest has its own slots of the signature and sorts the documents by them; those that
share its first ``MIN_DEPTH`` slots are a region, and the documents of a region are
compared with each other.  In a region of more than ``REGION`` documents the order goes
``DEPTH`` slots deep: neighbours, which have the longest prefix in common, are compared
first, and what they link is one cluster, however large, at a cost that is linear in
it.  Such a region is then split into blocks of about ``REGION`` documents, a large
cluster into blocks of its own, and every two blocks meet in a part of their own,
unless they are of one cluster.  So dense regions spread over tasks, a group of copies
costs nothing among itself, and no pair that could join two groups is left out.
Comparisons use the low bytes of all ``SLOTS`` slots; pairs that are not clearly above
or below the threshold by them are verified on their sets of shingles, which are sent
only for documents in such pairs.  Links are joined to groups by pointer jumping.  The
groups depend neither on the number of partitions nor on ``REGION``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, free_name, small, small_batches
from .text import doc_chunks, shingles, split_words

N = 3
THRESHOLD = 0.6
#: Standard deviations of an estimate; a pair that is nearer to the threshold is compared by its sets of shingles.
DOUBT = 3.5
SLOTS = 128
TREES = 10
DEPTH = 8
MIN_DEPTH = 2
#: Rows of a block; the results don't depend on it.
REGION = 4096

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have words, their SLOTS minima)."""
    s, sp = shingles(h, ptr, n)
    docs = np.flatnonzero(np.diff(sp) > 0)
    out = np.empty((len(docs), SLOTS), np.uint32)
    if len(docs):
        x, starts = (s >> np.uint64(32)).astype(np.uint32), sp[:-1][docs]
        tmp = np.empty_like(x)
        for k in range(SLOTS):
            np.bitwise_xor(x, _XOR[k], out=tmp)
            np.multiply(tmp, _MUL[k], out=tmp)
            out[:, k] = np.minimum.reduceat(tmp, starts)
    return docs, out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    width = rows.shape[1]
    offs = np.arange(0, width * len(rows) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(rows.tobytes())])


def _matrix(col: pa.Array, width: int, kind) -> np.ndarray:
    data = b"".join(col.to_pylist()) if col.null_count else None
    if data is None:
        offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].tobytes()
    return np.frombuffer(data, kind).reshape(len(col), width)


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in doc_chunks(batch, "text"):
                words = split_words(chunk.column("text"))
                docs, sig = signatures(words.hashes(), words.ptr, n)
                if len(docs):
                    yield pa.RecordBatch.from_arrays(
                        [chunk.column("row").take(pa.array(docs)), _binary(sig), _binary(sig.astype(np.uint8))],
                        ["row", "sig", "low"],
                    )

    return run


def _similarity(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 17):
        same = (low[a[at : at + (1 << 17)]] == low[b[at : at + (1 << 17)]]).sum(1, dtype=np.int32)
        out[at : at + (1 << 17)] = (same / SLOTS - 1 / 256) / (255 / 256)
    return out


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of one group, of groups that lie together; where a group has two sides, those across."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(group))
    ones = np.concatenate([[0], np.cumsum(side)])
    two = ones[end] - ones[start] if len(group) else start
    across = (two > 0) & (two < end - start)
    last = np.repeat(np.where(across, start, end), end - start)
    at, k = np.arange(len(group)), 0
    while len(at):
        k += 1
        at = at[at + k < last[at]]
        if len(at):
            yield at, at + k
    for g in np.flatnonzero(across):
        rows = np.arange(start[g], end[g])
        left, right = rows[side[rows] == 0], rows[side[rows] == 1]
        per = max(1, (1 << 17) // len(right))
        for i in range(0, len(left), per):
            part = left[i : i + per]
            yield np.repeat(part, len(right)), np.tile(right, len(part))


def links(
    tree: np.ndarray, label: np.ndarray, low: np.ndarray, least: float, part: np.ndarray | None = None, side: np.ndarray | None = None,
    cluster: np.ndarray | None = None, close: bool = False,
) -> tuple[np.ndarray, ...]:
    """Pairs of places, of rows sorted by (tree, label, part), that are similar enough; with ``close`` also how similar.

    Rows of one ``cluster`` aren't compared.
    """
    n = len(tree)
    new = np.ones(n, bool)
    new[1:] = (tree[1:] != tree[:-1]) | (label[1:, :MIN_DEPTH] != label[:-1, :MIN_DEPTH]).any(axis=1)
    if part is not None:
        new[1:] |= part[1:] != part[:-1]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a, b in _pairs(np.cumsum(new), np.zeros(n, np.int8) if side is None else side):
        if cluster is not None:
            apart = cluster[a] != cluster[b]
            a, b = a[apart], b[apart]
        like = _similarity(low, a, b)
        ok = like >= least
        if ok.any():
            found.append((a[ok], b[ok], like[ok]))
    return tuple(np.concatenate(c) for c in zip(*found))[: 3 if close else 2]


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, root) of the components of the links a-b; the root is the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    lab = np.arange(len(nodes))
    while True:
        before = lab.copy()
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        while True:
            jumped = lab[lab]
            if np.array_equal(jumped, lab):
                break
            lab = jumped
        if np.array_equal(lab, before):
            break
    child = np.flatnonzero(lab != np.arange(len(nodes)))
    return nodes[child], nodes[lab[child]]


def _edges(child: np.ndarray, parent: np.ndarray, place: np.ndarray | None = None) -> pa.RecordBatch:
    where = pa.nulls(len(child), pa.int64()) if place is None else pa.array(place)
    return pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent), where], ["child", "parent", "place"])


def _root(rows: np.ndarray, child: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The roots of rows; ``child`` is sorted, a row that isn't in it is its own."""
    at = np.minimum(np.searchsorted(child, rows), len(child) - 1)
    return np.where(child[at] == rows, root[at], rows)


def _search(least: float, sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(tree, label, part, side, row, cluster, low):
            a, b, close = links(tree, label, low, least, part, side, cluster, True)
            clear = close >= sure
            child, root = contract(row[a[clear]], row[b[clear]])
            if len(child):
                yield _edges(child, root)
            # pairs that clear links join already need no look at their texts
            a, b = a[~clear], b[~clear]
            x, y = row[a], row[b]
            if len(child):
                apart = _root(x, child, root) != _root(y, child, root)
                a, x, y = a[apart], x[apart], y[apart]
            place = (label[a, 0].astype(np.int64) << 31) ^ label[a, 1] ^ (tree[a].astype(np.int64) << 58) ^ (part[a] * 0x9E3779B1)
            for at in range(0, len(a), 1 << 16):
                cols = (np.maximum(x, y), np.minimum(x, y), place)
                yield _edges(*(c[at : at + (1 << 16)] for c in cols))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((
                batch.column("tree").to_numpy(zero_copy_only=False),
                _matrix(batch.column("label"), MIN_DEPTH, np.uint32),
                batch.column("part").to_numpy(zero_copy_only=False),
                batch.column("side").to_numpy(zero_copy_only=False),
                batch.column("row").to_numpy(zero_copy_only=False),
                batch.column("cluster").to_numpy(zero_copy_only=False),
                _matrix(batch.column("low"), SLOTS, np.uint8),
            ))
            # a region may go on in the next batch: process up to where the last one starts
            tree, label, part = held[-1][:3]
            key = np.concatenate([tree[:, None].astype(np.int64), label.astype(np.int64), part[:, None]], axis=1)
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            if len(other) and sum(len(x[0]) for x in held) >= 20000:
                cols = [np.concatenate(c) for c in zip(*held)]
                end = len(cols[0]) - (len(tree) - other[-1] - 1)
                yield from done(*(c[:end] for c in cols))
                held = [tuple(c[end:] for c in cols)]
        if held:
            yield from done(*(np.concatenate(c) for c in zip(*held)))

    return run


def _neighbours(sure: float):
    """Links of neighbours of one region that are clearly similar, of rows in order of (tree, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [
                batch.column("tree").to_numpy(zero_copy_only=False), _matrix(batch.column("path"), DEPTH, np.uint32),
                batch.column("row").to_numpy(zero_copy_only=False), _matrix(batch.column("low"), SLOTS, np.uint8),
            ]
            if held:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            held = [c[-1:] for c in cols]
            tree, path, row, low = cols
            at = np.flatnonzero((tree[1:] == tree[:-1]) & (path[1:, :MIN_DEPTH] == path[:-1, :MIN_DEPTH]).all(axis=1))
            at = at[_similarity(low, at, at + 1) >= sure]
            if len(at):
                child, root = contract(row[at], row[at + 1])
                yield _edges(child, root).select(["child", "parent"])

    return run


def _clusters(hot: DataFrame, sure: float) -> tuple[DataFrame, DataFrame]:
    """(hot with the column cluster, the links that made the clusters), of rows (tree, label, path, row, low) of dense regions."""
    order = hot.select("tree", "path", "row", "low").repartitionByRange("tree", "path", "row").sortWithinPartitions("tree", "path", "row")
    made = cut(components(order.mapInArrow(_neighbours(sure), "child long, parent long")))
    joined = hot.join(small(made, made.count(), 16).withColumnRenamed("child", "row"), "row", "left")
    return joined.select("tree", "label", "row", "low", F.coalesce("root", "row").alias("cluster")), made.withColumnRenamed("root", "parent")


def _parts(entries: DataFrame, sure: float) -> tuple[DataFrame, DataFrame | None]:
    """(tree, label, part, side, row, cluster, low), and links (child, parent) that are clear from the start.

    A region is one part; one of more than REGION rows has a part for each two of its
    blocks, but for two blocks of one cluster.
    """
    dense = cut(entries.groupBy("tree", "label").agg(F.count("*").alias("c")).filter(F.col("c") > REGION))
    regions = dense.count()
    whole = (
        F.lit(0).cast("long").alias("part"), F.lit(0).cast("byte").alias("side"), F.col("row"), F.col("row").alias("cluster"), F.col("low")
    )
    if not regions:
        return entries.select("tree", "label", *whole), None
    there = small(dense, regions, 64)
    hot, made = _clusters(cut(entries.join(there, ["tree", "label"]).drop("c")), sure)
    hot = cut(hot)
    # a large cluster of a region has blocks of its own, before those of all other rows
    region = Window.partitionBy("tree", "label")
    large = hot.groupBy("tree", "label", "cluster").agg(F.count("*").alias("n")).filter(F.col("n") > REGION)
    large = cut(
        large.withColumn("blocks", F.ceil(F.col("n") / REGION))
        .withColumn("first", F.sum("blocks").over(region.orderBy("cluster")) - F.col("blocks"))
    )
    taken = large.groupBy("tree", "label").agg(F.sum("n").alias("n"), F.sum("blocks").alias("before"))
    layout = cut(
        dense.join(taken, ["tree", "label"], "left")
        .withColumn("before", F.coalesce("before", F.lit(0))).withColumn("others", F.ceil((F.col("c") - F.coalesce("n", F.lit(0))) / REGION))
        .select("tree", "label", "before", "others")
    )
    large = large.select("tree", "label", "cluster", "blocks", "first")
    placed = hot.join(small(layout, regions, 96), ["tree", "label"]).join(small(large, large.count(), 96), ["tree", "label", "cluster"], "left")
    placed = placed.select(
        "tree", "label", "row", "cluster", "low", (F.col("before") + F.col("others")).alias("all"),
        (F.coalesce("first", "before") + F.pmod(F.xxhash64("row"), F.coalesce("blocks", "others"))).alias("block"),
        F.coalesce("first", F.lit(-1)).alias("from"), F.coalesce(F.col("first") + F.col("blocks"), F.lit(-1)).alias("to"),
    )
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1))).filter((F.col("other") < F.col("from")) | (F.col("other") >= F.col("to")))
    blocks = met.select(
        "tree", "label", (F.least("block", "other") * F.col("all") + F.greatest("block", "other")).alias("part"),
        (F.col("block") > F.col("other")).cast("byte").alias("side"), "row", "cluster", "low",
    )
    return entries.join(there, ["tree", "label"], "left_anti").select("tree", "label", *whole).unionByName(blocks), made


def components(edges: DataFrame) -> DataFrame:
    """(child, root) from (child, parent) with parent < child; roots have no row.

    Each round hangs the other parents of a child below its least one and lets
    every parent be replaced by its own least parent, until nothing changes.
    """
    edges = cut(edges.distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select("child", F.col("parent").alias("root"))
        state = now
        least = edges.groupBy("child").agg(F.min("parent").alias("least"))
        hung = edges.join(least, "child").select(
            F.explode(
                F.array(
                    F.struct(F.col("child").alias("c"), F.col("least").alias("p")),
                    F.struct(F.col("parent").alias("c"), F.col("least").alias("p")),
                )
            ).alias("e")
        ).select("e.c", "e.p").filter("c <> p").distinct()
        up = least.select(F.col("child").alias("p"), F.col("least").alias("up"))
        edges = cut(hung.join(up, "p", "left").select(F.col("c").alias("child"), F.coalesce("up", "p").alias("parent")).distinct())


def near_groups(docs: DataFrame, row: str, text: str, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(child, root) of the rows that are near duplicates; ``row`` is a long that identifies rows."""
    docs = small_batches(docs)
    sign = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(
        _sign(n), "row long, sig binary, low binary"
    )
    sign = cut(sign)
    # equal signatures are linked outright; one row of each goes into the forest
    groups = cut(sign.groupBy("sig", "low").agg(F.min("row").alias("row"), F.count("*").alias("c")))
    same = groups.filter("c > 1").select("sig", "low", F.col("row").alias("parent"))
    twins = sign.join(small(same, same.count(), 5 * SLOTS + 64), ["sig", "low"]).filter("row <> parent").select(
        F.col("row").alias("child"), "parent"
    )
    entries = groups.select(
        "row", "low", "sig", F.explode(F.array(*[F.lit(t) for t in range(TREES)])).alias("tree")
    )
    path = lambda depth: F.substring("sig", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * depth))
    entries = entries.select("tree", path(MIN_DEPTH).alias("label"), path(DEPTH).alias("path"), "row", "low")
    doubt = DOUBT * (threshold * (1 - threshold) / SLOTS) ** 0.5
    parts, made = _parts(entries, threshold + doubt)
    order = parts.repartition("tree", "label", "part").sortWithinPartitions("tree", "label", "part")
    found = cut(order.mapInArrow(_search(threshold - doubt, threshold + doubt), "child long, parent long, place long"))
    clear = found.filter("place IS NULL").select("child", "parent")
    clear = clear if made is None else clear.unionByName(made)
    return components(twins.unionByName(clear).unionByName(_verified(docs, row, text, n, threshold, found.filter("place IS NOT NULL"))))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in doc_chunks(batch, "text"):
                words = split_words(chunk.column("text"))
                s, ptr = shingles(words.hashes(), words.ptr, n)
                sets = [np.unique(s[ptr[k] : ptr[k + 1]]).tobytes() for k in range(chunk.num_rows)]
                yield pa.RecordBatch.from_arrays([chunk.column("row"), pa.array(sets, pa.binary())], ["row", "shingles"])

    return run


def _compare(threshold: float):
    """(child, parent) of the pairs of J >= threshold; in each place its rows' sets come first, then its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sets, up = None, {}, {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for batch in batches:
            out = []
            column = batch.column("shingles")
            for k, (place, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "child", "parent")))):
                if place != here:
                    here, sets, up = place, {}, {}
                if b is None:
                    sets[a] = np.frombuffer(column[k].as_buffer(), np.uint64).copy()
                    continue
                s, t = sets[a], sets[b]
                if min(len(s), len(t)) < threshold * max(len(s), len(t)) or (x := top(a)) == (y := top(b)):
                    continue
                if len(s) > len(t):
                    s, t = t, s
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                if both >= threshold * (len(s) + len(t) - both):
                    up[max(x, y)] = min(x, y)
                    out.append((a, b))
            if out:
                child, parent = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(parent, pa.int64())], ["child", "parent"])

    return run


def _verified(docs: DataFrame, row: str, text: str, n: int, threshold: float, pairs: DataFrame) -> DataFrame:
    """(child, parent) of the pairs (child, parent, place) whose sets of shingles have a J of ``threshold`` at least."""
    pairs = cut(pairs.groupBy("child", "parent").agg(F.min("place").alias("place")))
    needed = cut(pairs.select(F.explode(F.array("child", "parent")).alias("row"), "place").distinct())
    rows = needed.select("row").distinct()
    texts = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).join(small(rows, needed.count(), 16), "row", "left_semi")
    sets = needed.join(texts.mapInArrow(_sets(n), "row long, shingles binary"), "row").select(
        "place", F.col("row").alias("child"), F.lit(None).cast("long").alias("parent"), "shingles"
    )
    both = sets.unionByName(pairs.withColumn("shingles", F.lit(None).cast("binary")).select("place", "child", "parent", "shingles"))
    order = both.repartition("place").sortWithinPartitions("place", F.col("parent").asc_nulls_first())
    return order.mapInArrow(_compare(threshold), "child long, parent long")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, keep_id) of every document that goes because its group keeps another.

    Documents are linked if the Jaccard similarity of their sets of n-word
    shingles reaches ``threshold``; where SLOTS minima leave it in doubt, the
    sets are compared.  Groups are the
    connected components, and the least id of a group stays (a null id last, of
    equal ids the first in the scan).  A document of fewer than n words counts as
    one shingle of all its words; null, empty and wordless texts are in no group.
    Repeated rows are near duplicates of each other; texts of any length are read whole.
    Other columns are not read, so theirs may have any names, and an empty table gives no
    rows.  Several jobs run before it returns.  ``docs`` must give its rows in the same order each
    time it is computed (a file scan does).
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _kept(rows, near_groups(rows, "row", "text", n, threshold)).select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id")
    )


def _kept(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(row, id, keep) of the rows that go, of rows (row, id) in groups (child, root)."""
    member = groups.select(F.col("child").alias("row"), "root").unionByName(
        groups.select(F.col("root").alias("row"), "root").distinct()
    )
    member = cut(rows.select("row", "id").join(small(member, member.count(), 32), "row"))
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("v"), F.col("row").alias("k"))
    keep = member.groupBy("root").agg(F.min(order).alias("keep"))
    return member.join(keep, "root").filter(F.col("row") != F.col("keep.k")).select("row", "id", F.col("keep.v").alias("keep"))


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` names; all columns stay.

    Null, empty and wordless texts stay, and so does one of each group, ties and repeated
    rows included; an empty table stays one, and further columns may have any names.
    """
    row = free_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    rows = numbered.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(row).alias("row"))
    gone = cut(_kept(rows, near_groups(rows, "row", "text", n, threshold)).select(F.col("row").alias(row)))
    return numbered.join(small(gone, gone.count(), 16), row, "left_anti").drop(row)
