"""Vectorised word splitting and hashing over Arrow string arrays.

A word is a maximal run of ``[0-9a-z]`` and non-ASCII characters of the
lower-cased text; U+0080-00BF, U+2000-207F and U+3000-303F separate, and
every character of U+3040-9FFF is a word of its own.  ``WORD_RE`` says the
same as a regular expression that both Java and RE2 accept.  Nothing here
loops over characters or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = (
    r"[0-9a-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{A000}-\x{10FFFF}]+|[\x{3040}-\x{9FFF}]"
)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[0x80:] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INV)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that spans are hashed in at a time.
HASH_BYTES = 1 << 18


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] for each span, by prefix sums.

    Spans are in order of their starts.  They are hashed in groups that start within
    HASH_BYTES, so that memory doesn't grow with the text.
    """
    if len(buf) <= HASH_BYTES or not len(starts):
        return _hash_spans(buf, starts, ends)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + HASH_BYTES)))
        out[at:to] = _hash_spans(buf[base : int(ends[at:to].max())], starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def _hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(buf)
    pw, inv = _power_tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a run of documents; document i has words ptr[i]:ptr[i+1]."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)

    def word(self, i: int) -> str:
        return self.buf[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets start at 0."""
    arr = arr.cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def word_mask(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(word bytes, first bytes of characters that are words alone or None)."""
    mask = _IS_WORD[buf]
    single = None
    if len(buf) and buf.max() >= 0xC2:
        c2 = np.flatnonzero(buf == 0xC2)
        for at in (c2, c2 + 1):
            mask[at[at < len(buf)]] = False
        wide = np.flatnonzero((buf == 0xE2) | (buf == 0xE3))
        if len(wide):
            wide = wide[wide + 2 < len(buf)]
            second = buf[wide + 1]
            cut = wide[
                ((buf[wide] == 0xE2) & ((second == 0x80) | (second == 0x81)))
                | ((buf[wide] == 0xE3) & (second == 0x80))
            ]
            for k in range(3):
                mask[cut + k] = False
        if buf.max() >= 0xE3:
            lead = (buf >= 0xE3) & (buf <= 0xE9) & mask
            if lead.any():
                single = lead
    return mask, single


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words of a string array; a null text has none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    buf, offs = string_buffers(texts)
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, np.zeros(len(offs), np.int64))
    mask, single = word_mask(buf)
    # a document's first byte starts a word even if the previous one ended in a word
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    at = offs[:-1][np.diff(offs) > 0]
    start[at] = mask[at]
    if single is not None:
        start |= single
        after = np.flatnonzero(single) + 3
        after = after[after < n]
        start[after] = mask[after]
    starts = np.flatnonzero(start)
    stop = mask.copy()
    stop[:-1] &= ~(mask[1:] & ~start[1:])
    ends = np.flatnonzero(stop) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offs))


def shingles(h: np.ndarray, ptr: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a document, and their pointers.

    A document of 1 to n-1 words has one shingle, of all its words, or with
    ``short=False`` none.
    """
    lens = np.diff(ptr)
    out_len = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1) if short else 0)
    out_ptr = np.zeros(len(ptr), np.int64)
    np.cumsum(out_len, out=out_ptr[1:])
    total = len(h)
    if out_ptr[-1] == 0:
        return np.zeros(0, np.uint64), out_ptr
    acc = np.zeros(total, np.uint64)
    mult = np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([h, np.zeros(n - 1, np.uint64)])
    for k in range(n):
        acc = acc * mult + padded[k : k + total]
    acc = mix(acc)
    keep = np.arange(out_ptr[-1]) + np.repeat(ptr[:-1] - out_ptr[:-1], out_len)
    res = acc[keep]
    if short:
        for d in np.flatnonzero((lens > 0) & (lens < n)):
            v = int(lens[d])
            for x in h[ptr[d] : ptr[d + 1]]:
                v = (v * int(mult) + int(x)) & 0xFFFFFFFFFFFFFFFF
            res[out_ptr[d]] = mix(np.array([v], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))[0]
    return res, out_ptr


def doc_chunks(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.binary_length(pc.cast(batch.column(column), pa.large_string()))
    total = np.cumsum(np.nan_to_num(size.to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < n:
        base = total[at - 1] if at else 0.0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
