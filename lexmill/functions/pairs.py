"""Scores of string pairs, a whole Arrow batch of pairs at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import in_slices

_PAIRS = 4096


def osa_batch(a: list[bytes], b: list[bytes], trnsp: int = 1, subst: int = 1, insdel: int = 1) -> np.ndarray:
    """Optimal string alignment distances of pairs: edits of bytes and swaps of neighbours, none touched twice.

    Pairs of like length run together; each step fills one cell of all their tables.
    """
    out = np.zeros(len(a), np.int64)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    order = np.lexsort((lb, la))
    at = 0
    while at < len(order):
        rows = order[at : at + _PAIRS]
        # tables of a chunk stay within some megabytes, also for long strings
        while len(rows) > 1 and len(rows) * (lb[rows].max() + 1) > 1 << 22:
            rows = rows[: len(rows) // 2]
        at += len(rows)
        wa, wb = int(la[rows].max()), int(lb[rows].max())
        x, y = np.zeros((wa, len(rows)), np.uint8), np.zeros((wb, len(rows)), np.uint8)
        for k, r in enumerate(rows):
            x[: la[r], k] = np.frombuffer(a[r], np.uint8)
            y[: lb[r], k] = np.frombuffer(b[r], np.uint8)
        before = two = None
        line = np.repeat(np.arange(wb + 1)[:, None] * insdel, len(rows), axis=1)
        where = np.arange(len(rows))
        done = la[rows] == 0
        out[rows[done]] = line[lb[rows[done]], where[done]]
        for i in range(1, wa + 1):
            two, before = before, line
            line = np.empty_like(before)
            line[0] = i * insdel
            differ = (x[i - 1] != y) * subst
            for j in range(1, wb + 1):
                d = np.minimum(np.minimum(before[j], line[j - 1]) + insdel, before[j - 1] + differ[j - 1])
                if i > 1 and j > 1:
                    swap = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                    d = np.where(swap, np.minimum(d, two[j - 2] + trnsp), d)
                line[j] = d
            done = la[rows] == i
            out[rows[done]] = line[lb[rows[done]], where[done]]
    return out


def osa_distance(a: Column | str, b: Column | str, trnsp: int = 1, subst: int = 1, insdel: int = 1, max_len: int | None = None) -> Column:
    """INT column of the distances in bytes of UTF-8; null if either side is null or b is longer than ``max_len``."""

    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        xs, ys = x.to_pylist(), y.to_pylist()
        fine = [p is not None and q is not None for p, q in zip(xs, ys)]
        left = [(p or "").encode() if ok else b"" for p, ok in zip(xs, fine)]
        right = [(q or "").encode() if ok else b"" for q, ok in zip(ys, fine)]
        if max_len is not None:
            fine = [ok and len(q) <= max_len for ok, q in zip(fine, right)]
            left = [p if ok else b"" for p, ok in zip(left, fine)]
            right = [q if ok else b"" for q, ok in zip(right, fine)]
        d = osa_batch(left, right, trnsp, subst, insdel)
        return pa.array(d, pa.int32(), mask=~np.array(fine, bool))

    cols = [F.col(c) if isinstance(c, str) else c for c in (a, b)]
    return F.arrow_udf(lambda x, y: in_slices(distance, x, y), "int")(*cols)


_FOLD = np.zeros(256, np.int64)
for _k in range(26):
    _FOLD[65 + _k] = _FOLD[97 + _k] = _k + 1
for _c, _like in zip(b"012456789", "OIZASGTBQ"):
    _FOLD[_c] = ord(_like) - 64
_FOLD[ord("3")] = 27
_FOLD[[32, 45, 95]] = 28

_PLAIN = np.zeros(256, np.int64)
_PLAIN[32:96] = np.arange(64)
_PLAIN[96:128] = np.arange(32, 64)


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; null is empty."""
    arr = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8), offs - offs[0]


def _hashes(buf: np.ndarray, offs: np.ndarray, q: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the gram at each place of the ``rows`` that has ``q`` bytes before the end of its text."""
    n = np.diff(offs)
    own = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(rows[own] & (offs[1:][own] - np.arange(len(buf)) >= q))
    if q == 2:
        c = _PLAIN[buf]
        return own[at], (c[at] << 4) ^ c[at + 1]
    code = _FOLD[buf]
    before = np.append(0, np.cumsum(code != 0))  # bytes with a code before each place
    code = code[code != 0]
    first, last = before[at], before[offs[1:]][own[at]]
    out = np.zeros(len(at), np.int64)
    for k in range(5):
        there = first + k < last
        out[there] = (out[there] << 3) ^ code[first[there] + k]
    return own[at], out


def qgram_batch(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of each pair the share of b's grams whose hash is among a's, of the grams of the shorter text (so it may exceed 1); FLOAT."""
    (x, xo), (y, yo) = _raw(a), _raw(b)
    least = np.minimum(np.diff(xo), np.diff(yo))
    shared = np.zeros(len(a), np.int64)
    for q, rows in ((2, (least >= 2) & (least < 5)), (5, least >= 5)):
        if rows.any():
            mine, theirs = ((row << 20) | h for row, h in (_hashes(x, xo, q, rows), _hashes(y, yo, q, rows)))
            shared += np.bincount(theirs[np.isin(theirs, mine, kind="sort")] >> 20, minlength=len(a))
    grams = np.where(least < 5, least - 1, least - 4)
    return np.where(least < 2, np.float32(0), shared.astype(np.float32) / np.maximum(grams, 1).astype(np.float32))


def qgram_similarity(a: bytes, b: bytes) -> float:
    """``qgram_batch`` of one pair."""
    return float(qgram_batch(pa.array([a], pa.binary()), pa.array([b], pa.binary()))[0])


def qgram_score(a: Column | str, b: Column | str) -> Column:
    """FLOAT column of hashed q-gram scores of (a, b): 2-grams if either has under five bytes, else 5-grams.

    Not symmetric.  Null if either side is null.
    """

    def score(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(qgram_batch(x, y), pa.float32(), mask=pc.or_(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False))

    cols = [F.col(c) if isinstance(c, str) else c for c in (a, b)]
    return F.arrow_udf(lambda x, y: in_slices(score, x, y), "float")(*cols)
