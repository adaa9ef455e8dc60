"""Token ids in fixed-width bit packing.

Every id takes the bits that the vocabulary needs at least, the lowest first, in
little-endian 64-bit words.  A block is a multiple of 64 ids, so it starts on a word;
block offsets make any range of ids readable by unpacking only its blocks, which is
done by whole-array shifts.  A shard is a run of documents' ids in one payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import replacing
from .runtime import small_batches

#: Ids of a block; a multiple of 64.
BLOCK = 4096
#: A shard is closed once it holds so many ids.
SHARD_TOKENS = 1 << 20
#: The published splitting rule of the byte-level BPE that the default vocabulary belongs to.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHARD = (
    "doc_ids array<{id}>, doc_starts array<long>, n_tokens long, bits int, block_tokens int, "
    "block_offsets array<long>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary, 1 at least."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words that hold the ids; the last 64 are filled up with zeros."""
    rows = -(-len(ids) // 64)
    v = np.zeros(rows * 64, np.uint64)
    v[: len(ids)] = ids
    v = v.reshape(rows, 64)
    out = np.zeros((rows, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack_bits(words: np.ndarray, bits: int) -> np.ndarray:
    """The ids in whole groups of 64, as ``pack_bits`` filled them up."""
    w = words.reshape(-1, bits)
    out = np.empty((len(w), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = w[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (w[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)


class Shard:
    """A packed run of documents."""

    MAGIC = b"LXTK\x02\0\0\0"

    def __init__(self, doc_ids, doc_starts, n_tokens, bits, block_tokens, block_offsets, payload):
        self.doc_ids, self.doc_starts = list(doc_ids), np.asarray(doc_starts, np.int64)
        self.n_tokens, self.bits, self.block_tokens = int(n_tokens), int(bits), int(block_tokens)
        self.block_offsets, self.payload = np.asarray(block_offsets, np.int64), payload

    @classmethod
    def pack(cls, doc_ids: list, ids: list[np.ndarray], bits: int, block: int = BLOCK) -> Shard:
        if block % 64:
            raise ValueError("a block is a multiple of 64 ids")
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if len(flat) and int(flat.max()) >> bits:
            raise ValueError(f"id {int(flat.max())} doesn't fit in {bits} bits")
        payload = pack_bits(flat, bits).astype("<u8").tobytes()
        offsets = np.arange(-(-len(flat) // block)) * (block // 64 * bits * 8)
        return cls(doc_ids, starts, len(flat), bits, block, offsets, payload)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start:stop, of whose blocks alone the payload is read."""
        start, stop = max(start, 0), min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_tokens, (stop - 1) // self.block_tokens
        low = int(self.block_offsets[first])
        high = int(self.block_offsets[last + 1]) if last + 1 < len(self.block_offsets) else len(self.payload)
        words = np.frombuffer(self.payload, "<u8", (high - low) // 8, low).astype(np.uint64)
        base = first * self.block_tokens
        return unpack_bits(words, self.bits)[start - base : stop - base].astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.doc_starts[k]), int(self.doc_starts[k + 1]))

    def to_bytes(self) -> bytes:
        """File form: magic, counts, kind of ids, ids (with a byte each that says if it is null), starts, offsets, payload.

        Ids are whole numbers of 64 bits, strings or bytes, all of one kind; others raise TypeError.
        """
        there = {type(i) for i in self.doc_ids if i is not None}
        kinds = [k for k, t in enumerate((int, str, bytes)) if there <= {t}]
        if not kinds:
            raise TypeError(f"ids of {sorted(t.__name__ for t in there)} have no file form")
        null = np.array([i is None for i in self.doc_ids], np.uint8)
        if kinds[0] == 0:
            ids = np.array([0 if i is None else i for i in self.doc_ids], "<i8").tobytes()
        else:
            raw = [b"" if i is None else i.encode() if kinds[0] == 1 else i for i in self.doc_ids]
            ids = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype("<i8").tobytes() + b"".join(raw)
        head = struct.pack("<QQQQQQQ", len(self.doc_ids), self.n_tokens, self.bits, self.block_tokens, len(self.block_offsets), kinds[0], len(ids))
        parts = [self.MAGIC, head, ids, null.tobytes(), self.doc_starts.astype("<i8").tobytes()]
        return b"".join([*parts, self.block_offsets.astype("<i8").tobytes(), bytes(self.payload)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:8] != cls.MAGIC:
            raise ValueError("not a token shard")
        docs, n, bits, block, blocks, kind, size = struct.unpack_from("<QQQQQQQ", data, 8)
        at = 64
        if kind:
            cuts = np.frombuffer(data, "<i8", docs + 1, at)
            base = at + 8 * (docs + 1)
            ids: list = [data[base + a : base + b] for a, b in zip(cuts[:-1], cuts[1:])]
            if kind == 1:
                ids = [x.decode() for x in ids]
        else:
            ids = np.frombuffer(data, "<i8", docs, at).tolist()
        at += size
        null = np.frombuffer(data, np.uint8, docs, at)
        at += docs
        starts = np.frombuffer(data, "<i8", docs + 1, at)
        at += 8 * (docs + 1)
        offsets = np.frombuffer(data, "<i8", blocks, at)
        return cls([None if z else i for i, z in zip(ids, null)], starts, n, bits, block, offsets, data[at + 8 * blocks :])


_encoders: dict[bytes, object] = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The byte-level BPE of a file of base64 tokens and ranks, one for each process."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def pack_tokens(
    docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", pattern: str = PATTERN,
    block: int = BLOCK, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Shards (doc_ids, doc_starts, n_tokens, bits, block_tokens, block_offsets, payload) of all of ``docs``.

    ``vocabulary`` is the path, on the driver, of a tiktoken file of ranks.  Document k
    of a shard has ids doc_starts[k]:doc_starts[k+1]; a null or empty text has none,
    but its id is listed; a null id is kept as null, a repeated row is packed each
    time.  A document isn't split between shards, however long.  An empty table gives
    no shard.  Ids keep the type of their column.  Columns that aren't named are not read.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    bits = bits_for(1 + max(int(line.split()[1]) for line in ranks.splitlines() if line.strip()))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # of the vocabulary's size, whatever the corpus
    rows = small_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(shared.value, pattern)
        ids, parts, held, id_type = [], [], 0, None
        for batch in batches:
            id_type = batch.column("id").type
            for i, t in zip(batch.column("id"), batch.column("text")):
                t = t.as_py()
                got = np.array(code.encode_ordinary(t) if t else [], np.uint32)
                ids.append(i.as_py())
                parts.append(got)
                held += len(got)
                if held >= shard_tokens:
                    yield _row(Shard.pack(ids, parts, bits, block), id_type)
                    ids, parts, held = [], [], 0
        if ids:
            yield _row(Shard.pack(ids, parts, bits, block), id_type)

    return rows.mapInArrow(run, SHARD.format(id=kind))


def _row(s: Shard, id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([s.doc_ids], pa.list_(id_type)), pa.array([s.doc_starts], pa.list_(pa.int64())), pa.array([s.n_tokens]),
         pa.array([s.bits], pa.int32()), pa.array([s.block_tokens], pa.int32()),
         pa.array([s.block_offsets], pa.list_(pa.int64())), pa.array([s.payload], pa.binary())],
        ["doc_ids", "doc_starts", "n_tokens", "bits", "block_tokens", "block_offsets", "payload"],
    )


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """(file, docs, n_tokens) of the files, one for each shard, that it writes when it is computed.

    A file's name is a hash of its content, so a task that runs twice leaves one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                s = Shard(*(r[c] for c in ("doc_ids", "doc_starts", "n_tokens", "bits", "block_tokens", "block_offsets", "payload")))
                data = s.to_bytes()
                path = f"{folder}/{hashlib.sha256(data).hexdigest()[:32]}.tok"
                with replacing(path) as out:
                    out.write(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([len(s.doc_ids)]), pa.array([s.n_tokens])], ["file", "docs", "n_tokens"]
                )

    return shards.mapInArrow(run, "file string, docs long, n_tokens long")
