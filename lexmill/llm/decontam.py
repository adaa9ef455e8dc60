"""Benchmark decontamination by size-partitioned MinHash containment search.

Documents are partitioned by size (octaves of their number of shingles) and carry
a one-permutation MinHash whose number of bins grows with the partition's upper
size, so that a short item keeps its chance of sharing a minimum with a document a
thousand times its length.  Items are split into classes by the number of
shingles that a match must share; the fewer these are, the more bins: each class
and partition gets the bins that make the chance of missing a qualifying pair at
most ``MISS``.  A shared minimum makes a candidate, which is then verified by the
exact containment of the item's shingle set in the document's.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_BYTES, cut, free_name, may_broadcast, small_batches
from .text import doc_chunks, shingles, split_words

N = 5
THRESHOLD = 0.6
#: Chance that a pair at the threshold shares no minimum.
MISS = 0.005
#: At so few shingles per bin, bins would spare next to nothing: all shingles are compared, and nothing is missed.
ALONE = 0.25
#: Least numbers of shared shingles of the item classes.
CLASSES = (1, 2, 3, 5, 8, 12, 20, 40, 80)

_RESULT = "containment double"


def item_class(size: int, threshold: float) -> int:
    """Index into CLASSES of an item with ``size`` distinct shingles."""
    need = max(1, int(np.ceil(threshold * size - 1e-9)))
    return int(np.searchsorted(CLASSES, need, side="right") - 1)


@functools.cache
def load(cls: int) -> float:
    """Shingles per bin at which ``CLASSES[cls]`` shared ones are missed with chance MISS."""
    p = 1 - MISS ** (1 / CLASSES[cls])
    low, high = 1e-4, 64.0
    for _ in range(60):  # (1 - e^-x) / x falls with x
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - np.exp(-mid)) / mid > p else (low, mid)
    return low


def bins(part: int, cls: int) -> int:
    """Bins of a class in a partition; 0, every shingle is a minimum, where most would be alone in their bin."""
    return 0 if load(cls) <= ALONE else max(1, int(np.ceil((1 << part) / load(cls))))


def partition_of(sizes: np.ndarray) -> np.ndarray:
    """Octave of each size: the least p with size <= 2^p."""
    return np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)


def bin_of(values: np.ndarray, n_bins: int) -> np.ndarray:
    """Order-keeping bin of 64-bit hashes, so a bin's minimum is its first in sorted order."""
    return (values >> np.uint64(32)) * np.uint64(n_bins) >> np.uint64(32)


def bin_minima(sorted_values: np.ndarray, ptr: np.ndarray, n_bins: int) -> np.ndarray:
    """Positions of the least value of every bin of every set."""
    if not len(sorted_values) or not n_bins:
        return np.arange(len(sorted_values))
    b = bin_of(sorted_values, n_bins)
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    starts = ptr[:-1][np.diff(ptr) > 0]
    first[starts] = True
    return np.flatnonzero(first)


def shingle_sets(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct n-shingles, sorted, and their pointers."""
    s, sp = shingles(h, ptr, n, short=False)
    if not len(s):
        return s, sp
    doc = np.repeat(np.arange(len(sp) - 1), np.diff(sp))
    for a, b in zip(sp[:-1], sp[1:]):
        s[a:b].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    return s, np.searchsorted(doc, np.arange(len(sp)))


class Items:
    """Items' shingle sets, and their minima for the partitions asked for."""

    def __init__(self, ids: list, texts: list, n: int, threshold: float):
        words = split_words(pa.array(texts, pa.large_string()))
        h, lens = words.hashes(), np.diff(words.ptr)
        self.threshold = threshold
        self.ids, self.sets, self.width, self.cls = [], [], [], []
        for m in sorted({min(n, int(x)) for x in lens if x}):
            s, sp = shingle_sets(h, words.ptr, m)
            for i in np.flatnonzero(np.minimum(lens, n) == m):
                self.ids.append(ids[i])
                self.sets.append(s[sp[i] : sp[i + 1]])
                self.width.append(m)
                self.cls.append(item_class(len(self.sets[-1]), threshold))
        self._index: dict = {}

    def kinds(self) -> list[tuple[int, int]]:
        """(shingle length, class) pairs that occur."""
        return sorted(set(zip(self.width, self.cls)))

    def index(self, m: int, cls: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted minima of the items of that kind in that partition, and their items."""
        key = (m, cls, part)
        if key not in self._index:
            k, values, items = bins(part, cls), [], []
            for i, s in enumerate(self.sets):
                if self.width[i] == m and self.cls[i] == cls:
                    v = s[bin_minima(s, np.array([0, len(s)]), k)]
                    values.append(v)
                    items.append(np.full(len(v), i))
            v, it = np.concatenate(values), np.concatenate(items)
            order = np.argsort(v, kind="stable")
            self._index[key] = v[order], it[order]
        return self._index[key]


def _matches(words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, containment) of all verified pairs of a chunk."""
    h = words.hashes()
    out = []
    kinds = items.kinds()
    for m in sorted({k[0] for k in kinds}):
        s, sp = shingle_sets(h, words.ptr, m)
        if not len(s):
            continue
        size = np.diff(sp)
        part = partition_of(size)
        owner = np.repeat(np.arange(len(size)), size)
        pairs = set()
        for p in np.unique(part[size > 0]):
            docs = (part == p) & (size > 0)
            inside = np.repeat(docs, size)
            sub, own = s[inside], owner[inside]
            sub_ptr = np.concatenate([[0], np.cumsum(size[docs])])
            for cls in [c for w, c in kinds if w == m]:
                values, of = items.index(m, cls, int(p))
                at = bin_minima(sub, sub_ptr, bins(int(p), cls))
                low = np.searchsorted(values, sub[at], side="left")
                hit = np.flatnonzero((low < len(values)) & (values[np.minimum(low, len(values) - 1)] == sub[at]))
                for j in hit:
                    k = low[j]
                    while k < len(values) and values[k] == sub[at[j]]:
                        pairs.add((int(own[at[j]]), int(of[k])))
                        k += 1
        for d, i in sorted(pairs):
            mine, want = s[sp[d] : sp[d + 1]], items.sets[i]
            pos = np.minimum(np.searchsorted(mine, want), len(mine) - 1)
            share = float((mine[pos] == want).sum()) / len(want)
            if share >= items.threshold:
                out.append((d, i, share))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    d, i, c = zip(*out)
    return np.array(d), np.array(i), np.array(c)


def _schema_of(df: DataFrame, names: dict[str, str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{new} {kinds[old]}" for old, new in names.items())


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = N,
    threshold: float = THRESHOLD,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """(doc_id, item_id, containment) where a document holds an item.

    Containment is the share of the item's distinct n-word shingles that the
    document has too; an item of fewer than n words counts as one shingle of all
    its words.  Pairs of at least ``threshold`` are returned.  A null or wordless
    text is in no pair, nor is one of fewer words than the item's shingle; texts of any
    length are searched whole; repeated rows on either side give repeated result rows, and
    of equal shares all are returned; ids keep their types, null ids are kept as they are;
    an empty table gives no rows.  Columns other than those named are not read, so theirs
    may have any names.  The items are broadcast if they are checked
    to take at most ``broadcast_bytes``, else minima are joined by a shuffle.
    """
    d = small_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    b = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    size = b.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if not may_broadcast(size, 4, limit):
        return _by_shuffle(d, b, n, threshold)
    rows = b.toArrow().combine_chunks()
    items = Items(list(range(rows.num_rows)), rows.column("text").to_pylist(), n, threshold)
    schema = _schema_of(d, {"doc_id": "doc_id"}) + ", " + _schema_of(b, {"item_id": "item_id"}) + ", " + _RESULT
    if not items.sets:
        return d.sparkSession.createDataFrame([], schema)
    shared = d.sparkSession.sparkContext.broadcast((items, rows.column("item_id").combine_chunks()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its, ids = shared.value
        item_ids = ids.take(pa.array(its.ids))
        for batch in batches:
            for chunk in doc_chunks(batch, "text"):
                at, it, share = _matches(split_words(chunk.column("text")), its)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [chunk.column("doc_id").take(pa.array(at)), item_ids.take(pa.array(it)), pa.array(share)],
                        ["doc_id", "item_id", "containment"],
                    )

    return d.mapInArrow(search, schema)


def _by_shuffle(d: DataFrame, b: DataFrame, n: int, threshold: float) -> DataFrame:
    """As ``contained_items``, with both sides' minima joined by a shuffle."""
    d = d.withColumn("dk", F.monotonically_increasing_id())
    b = cut(b.withColumn("bk", F.monotonically_increasing_id()))

    def item_rows(batches):
        for batch in batches:
            keys = batch.column("bk").to_pylist()
            its = Items(keys, batch.column("text").to_pylist(), n, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(its.ids, pa.int64()), pa.array(its.width, pa.int32()), pa.array(its.cls, pa.int32()),
                 pa.array([s.view(np.int64) for s in its.sets], pa.list_(pa.int64()))],
                ["bk", "m", "cls", "shingles"],
            )

    items = cut(b.select("bk", "text").mapInArrow(item_rows, "bk long, m int, cls int, shingles array<long>"))
    kinds = [(r.m, r.cls) for r in items.select("m", "cls").distinct().collect()]

    def doc_minima(batches):
        for batch in batches:
            for chunk in doc_chunks(batch, "text"):
                words = split_words(chunk.column("text"))
                h, keys = words.hashes(), chunk.column("dk").to_numpy(zero_copy_only=False)
                for m in sorted({k[0] for k in kinds}):
                    s, sp = shingle_sets(h, words.ptr, m)
                    size = np.diff(sp)
                    part = partition_of(size)
                    owner = np.repeat(np.arange(len(size)), size)
                    for p in np.unique(part[size > 0]):
                        docs = (part == p) & (size > 0)
                        inside = np.repeat(docs, size)
                        ptr = np.concatenate([[0], np.cumsum(size[docs])])
                        for cls in [c for w, c in kinds if w == m]:
                            at = np.flatnonzero(inside)[bin_minima(s[inside], ptr, bins(int(p), cls))]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(keys[owner[at]], pa.int64()), pa.array(np.full(len(at), m, np.int32)),
                                 pa.array(np.full(len(at), cls, np.int32)), pa.array(np.full(len(at), p, np.int32)),
                                 pa.array(s[at].view(np.int64))],
                                ["dk", "m", "cls", "part", "v"],
                            )

    minima = d.select("dk", "text").mapInArrow(doc_minima, "dk long, m int, cls int, part int, v long")

    def item_minima(batches):
        for batch in batches:
            cols = batch.to_pydict()
            for bk, m, cls, sh, parts in zip(cols["bk"], cols["m"], cols["cls"], cols["shingles"], cols["parts"]):
                s = np.array(sh, np.int64).view(np.uint64)
                for p in parts:
                    v = s[bin_minima(s, np.array([0, len(s)]), bins(p, cls))].view(np.int64)
                    k = len(v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bk] * k, pa.int64()), pa.array([m] * k, pa.int32()), pa.array([cls] * k, pa.int32()),
                         pa.array([p] * k, pa.int32()), pa.array(v)],
                        ["bk", "m", "cls", "part", "v"],
                    )

    top = d.agg(F.max(F.octet_length("text"))).first()[0] or 1
    parts = F.sequence(F.lit(0), F.lit(int(np.ceil(np.log2(top + 1)))))
    wanted = items.withColumn("parts", parts).mapInArrow(
        item_minima, "bk long, m int, cls int, part int, v long"
    )
    pairs = minima.join(wanted, ["m", "cls", "part", "v"]).select("dk", "bk").distinct()
    found = pairs.join(items, "bk").join(b.select("bk", "item_id"), "bk").join(d, "dk")

    def verify(batches):
        for batch in batches:
            share = []
            for text, m, sh in zip(batch.column("text"), batch.column("m"), batch.column("shingles")):
                w = split_words(pa.array([text.as_py()], pa.large_string()))
                mine, _ = shingle_sets(w.hashes(), w.ptr, m.as_py())
                want = np.array(sh.as_py(), np.int64).view(np.uint64)
                share.append(float(np.isin(want, mine).sum()) / len(want))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(share, pa.float64())],
                ["doc_id", "item_id", "containment"],
            )

    schema = _schema_of(d, {"doc_id": "doc_id"}) + ", " + _schema_of(b, {"item_id": "item_id"}) + ", " + _RESULT
    return (
        found.select("doc_id", "item_id", "text", "m", "shingles").mapInArrow(verify, schema)
        .filter(F.col("containment") >= threshold)
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N, threshold: float = THRESHOLD, **names
) -> DataFrame:
    """``docs`` without the rows that hold an item of ``benchmark``; all columns stay.

    Rows with a null or wordless text stay, repeated rows stay or go together, and an
    empty table of either kind drops nothing.  ``docs`` must give its rows in the same
    order each time it is computed (a file scan does).
    """
    row = free_name(docs, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    gone = cut(
        contained_items(rows, benchmark, n, threshold, text, row, **names).select(F.col("doc_id").alias(row)).distinct()
    )
    if may_broadcast(gone.count(), 16):
        gone = F.broadcast(gone)
    return rows.join(gone, row, "left_anti").drop(row)
