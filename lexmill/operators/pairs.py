"""Distances between all lines of two tables, and lines that others contain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pairs import osa_distance
from ..runtime import BROADCAST_BYTES, checked_broadcast, cut

#: Bits of the filter of keys for each key, as long as they fit, and hashes of each.
FILTER_BITS = 32
FILTER_HASHES = 7
#: Bytes of snippets that are sent together.
CHUNK_BYTES = 4 << 20


def trimmed(df: DataFrame, line: str, name: str) -> DataFrame:
    """(name): the lines that aren't blank, without white space in front."""
    return df.select(F.regexp_replace(line, r"^[ \t\n\x0b\f\r]+", "").alias(name)).filter(F.col(name) != "")


def distance_matrix(
    left: DataFrame, right: DataFrame, left_line: str = "line", right_line: str = "line", trnsp: int = 1, subst: int = 1, insdel: int = 1,
    max_len: int | None = None,
) -> DataFrame:
    """(a, b, d) of every line of ``left`` with every line of ``right``.

    The right side is broadcast if its size is checked to be small.  Pairs whose second
    line is over ``max_len`` bytes are left out.
    """
    a, b = trimmed(left, left_line, "a"), cut(trimmed(right, right_line, "b"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("b") + 32), F.lit(0))).first()[0]
    pairs = a.crossJoin(checked_broadcast(b, size))
    if max_len is not None:
        pairs = pairs.filter(F.octet_length("b") <= max_len)
    return pairs.select("a", "b", osa_distance("a", "b", trnsp, subst, insdel).alias("d"))


def _bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of texts without nulls."""
    arr = lines.cast(pa.large_binary())
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    buf = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    """An invertible scramble."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """``x`` from place ``by`` on, with zeros behind the end."""
    return np.append(x[by:], np.zeros(min(by, len(x)), x.dtype))


def _windows(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hash of the ``width`` bytes from each place on) for the powers of two; up to 8 bytes the hash is invertible."""
    width, value = 1, buf.astype(np.uint64)
    while True:
        yield width, _mixed(value + np.uint64(width)) if width <= 8 else value
        if width < 8:
            value = value | (_shifted(value, width) << np.uint64(8 * width))
        else:
            value = _mixed(value * np.uint64(0xD6E8FEB86659FD93) + (_shifted(value, width) ^ np.uint64(width)))
        width *= 2


def _kinds(n: np.ndarray) -> np.ndarray:
    """The greatest power of two within each length."""
    return np.left_shift(1, np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1)


def line_keys(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, key, bytes) of each line, none empty: the greatest power of two within its length, and the hash of so many first bytes."""
    buf, offs = _bytes(lines)
    n = np.diff(offs)
    kind, key = _kinds(n), np.zeros(len(n), np.uint64)
    most = int(kind.max()) if len(n) else 0
    for width, value in _windows(buf):
        if width > most:
            break
        at = kind == width
        key[at] = value[offs[:-1][at]]
    return kind, key.view(np.int64), n


def _place(key: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The place of each key by the ``k``-th hash in a filter of 2 ** ``bits`` bits."""
    x = key.view(np.uint64)
    stride = (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (((x >> np.uint64(32)) + stride * np.uint64(k)) & np.uint64((1 << bits) - 1)).view(np.int64)


def _there(held: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Indices of the keys that the filter may have."""
    bits = len(held).bit_length() + 2
    at = np.arange(len(key))
    for k in range(FILTER_HASHES):
        place = _place(key[at], k, bits)
        at = at[((held[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)]
    return at


def _key_filter(keys: DataFrame, size: int) -> np.ndarray:
    """A filter of ``size`` bytes, a power of two, of (key); built in pieces, so that the driver gets its bytes and no more."""
    bits = size.bit_length() + 2
    piece = min(size, 1 << 16)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([_place(b.column("key").to_numpy(), k, bits) for k in range(FILTER_HASHES)])
            yield pa.RecordBatch.from_arrays([pa.array(at // (8 * piece)), pa.array(at % (8 * piece))], ["part", "bit"])

    def build(table: pa.Table) -> pa.Table:
        held = np.zeros(8 * piece, bool)
        held[table.column("bit").to_numpy()] = True
        return pa.table({"part": table.column("part")[:1], "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    parts = keys.mapInArrow(places, "part long, bit long").groupBy("part").applyInArrow(build, "part long, held binary").toArrow()
    for part, held in zip(parts.column("part").to_pylist(), parts.column("held").to_pylist()):
        out[part * piece : (part + 1) * piece] = np.frombuffer(held, np.uint8)
    return out


def snippets(lines: pa.Array, kinds: list[int], wanted: np.ndarray | None, shared: np.ndarray | None) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(kind, keys, snippets): from where a shorter line may begin, up to twice its kind of bytes.

    Where the line itself begins, its last byte is left out, so that what begins there is
    shorter.  ``wanted`` is a filter of all keys, ``shared`` of those that several lines have.
    A snippet that another one of the same key begins with needn't be sent.
    """
    buf, offs = _bytes(lines)
    raw, n = buf.tobytes(), np.diff(offs)
    own = np.repeat(np.arange(len(n)), n)
    left = offs[1:][own] - np.arange(len(buf))
    begins = left == n[own]
    mine = _kinds(n)[own]
    windows = _windows(buf)
    for kind in kinds:
        width, value = next(windows)
        while width < kind:
            width, value = next(windows)
        at = np.flatnonzero((left >= kind) & (n[own] > kind))
        key = value[at].view(np.int64)
        if wanted is not None:
            ok = _there(wanted, key)
            at, key = at[ok], key[ok]
            whole = begins[at] & (mine[at] == kind)
            if whole.any():
                fine = ~whole
                at_whole = np.flatnonzero(whole)
                fine[at_whole[_there(shared, key[at_whole])]] = True
                at, key = at[fine], key[fine]
        if not len(at):
            continue
        end = np.minimum(at + 2 * kind, offs[1:][own[at]]) - (begins[at] & (left[at] <= 2 * kind))
        if kind <= 4:  # the bytes as a number, with their count
            word = np.zeros(len(at), np.uint64)
            for k in range(2 * kind):
                there = at + k < end
                word[there] |= buf[at[there] + k].astype(np.uint64) << np.uint64(8 * k)
            once = np.unique(np.stack([word, (end - at).astype(np.uint64)]), axis=1, return_index=True)[1]
            at, key, end = at[once], key[once], end[once]
        first: dict[int, bytes] = {}
        seen: set[bytes] = set()
        keys, out, size = [], [], 0
        for p, q, k in zip(at.tolist(), end.tolist(), key.tolist()):
            s = raw[p:q]
            before = first.get(k)
            if before is not None and (before.startswith(s) or s in seen):
                continue
            if before is None or len(s) > len(before):
                first[k] = s
            seen.add(s)
            keys.append(k)
            out.append(s)
            size += len(s) + 16
            if size > CHUNK_BYTES:
                yield kind, keys, out
                keys, out, size = [], [], 0
                seen.clear()
        if out:
            yield kind, keys, out


def _slices(batch: pa.RecordBatch, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of lines."""
    total = np.cumsum(pc.binary_length(batch.column("line")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def drop_infixes(lines: DataFrame, order: list[str], line: str = "line", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(line, first): the distinct lines that no other line contains, with the least ``order`` of each.

    Of a line of 2^k to 2^(k+1) - 1 bytes the first 2^k are its key.  Where a line has the key
    of another inside, it sends the 2^(k+1) bytes from there on; these are cut to the lengths that
    lines with this key have, and a line that equals such a part goes.  So nothing is sent
    for pairs of lines: what is sent grows with the places where a line's first half stands.
    Places are thinned out by a broadcast filter of keys of at most ``limit`` bytes, or not at all
    if that is 0.  Empty and null lines never stay.
    """
    distinct = lines.filter(F.length(line) > 0).groupBy(F.col(line).alias("line")).agg(F.min(F.struct(*order)).alias("first"))
    distinct = cut(distinct)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                kind, key, n = line_keys(b.column("line"))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(n)], ["kind", "key", "n"])

    each = distinct.select("line").mapInArrow(own, "kind long, key long, n long")
    keys = cut(each.groupBy("kind", "key").agg(F.count("*").alias("lines"), F.collect_set("n").alias("lengths")))
    kinds = {r[0]: r[1] for r in keys.groupBy("kind").count().collect()}
    if not kinds:
        return distinct
    wanted = shared = None
    if limit:
        size = 1 << (min(max(sum(kinds.values()) * FILTER_BITS // 8, 128), limit).bit_length() - 1)
        make = lambda df: lines.sparkSession.sparkContext.broadcast(_key_filter(df.select("key"), size))
        wanted, shared = make(keys), make(keys.filter("lines > 1"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = (None, None) if wanted is None else (wanted.value, shared.value)
        for batch in batches:
            for b in _slices(batch):
                for kind, key, out in snippets(b.column("line"), sorted(kinds), *filters):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), kind)), pa.array(key, pa.int64()), pa.array(out, pa.binary())], ["kind", "key", "part"]
                    )

    held = distinct.select("line").mapInArrow(hold, "kind long, key long, part binary")
    parts = held.join(keys.select("kind", "key", "lengths"), ["kind", "key"]).select("part", F.explode("lengths").alias("n"))
    inside = parts.filter("n <= octet_length(part)").select(F.substring("part", F.lit(1), F.col("n").cast("int")).alias("part")).distinct()
    return distinct.join(inside, F.col("line").cast("binary") == F.col("part"), "left_anti")
