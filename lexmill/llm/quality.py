"""Quality classifier: a factorisation machine over words, structure and metadata.

Features of a document are its distinct hashed words and word beginnings, binned
structure statistics and its metadata fields, each once.  The score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if y_i)^2 - sum_i v_if^2 y_i^2)

which takes time linear in the features.  The words of a document together weigh
about as much as a field (y = 1 / sqrt(words) in the pairwise part, x = y^LINEAR in
the linear one), so that long documents don't drown the other fields.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches
from .text import Words, doc_chunks, hash_spans, mix, split_words, string_buffers

#: Labelled rows that the model is fitted on at most, taken in order of a hash of their id.
TRAIN_ROWS = 20000
BUCKETS = 1 << 17
RANK = 6
EPOCHS = 10
STEM = 4
#: Words' values in the linear part, as a power of those in the pairwise part.
LINEAR = 0.5
KEEP_AT = 0.8

_SHARES = np.array([1e-9, 0.002, 0.005, 0.01, 0.02, 0.035, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8])
_EDGES = {
    "words": 2.0 ** np.arange(0, 20),
    "word_length": np.array([1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14, 20]),
    "longest_word": np.array([4, 8, 12, 16, 20, 25, 30, 40, 60, 100, 300]),
    "distinct": np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97]),
    "repeats": _SHARES,
    "upper": _SHARES,
    "digits": _SHARES,
    "marks": _SHARES,
    "bars": _SHARES,
    "bangs": _SHARES,
    "breaks": _SHARES,
    "wide": _SHARES,
    "spaces": _SHARES,
}
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in b"#$%&*+<=>@[\\]^_{}~/\"'`();:":
    _CLASS[_c] = 3
_CLASS[ord("|")] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("\n")] = 6
_CLASS[0x80:] = 7
_CLASS[ord(" ")] = 8
_NAMES = ("upper", "digits", "marks", "bars", "bangs", "breaks", "wide", "spaces")


def statistics(texts: pa.Array, words: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """Structure statistics of each document."""
    buf, offs = string_buffers(texts)
    size = np.maximum(np.diff(offs), 1)
    n = np.diff(words.ptr)
    kind = _CLASS[buf]
    out = {}
    for k, name in enumerate(_NAMES, 1):
        at = np.flatnonzero(kind == k)
        out[name] = np.diff(np.searchsorted(at, offs)) / size
    length = words.ends - words.starts
    total = np.concatenate([[0], np.cumsum(length)])
    some = np.maximum(n, 1)
    again = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        again[2:] = np.cumsum(h[1:] == h[:-1])
    inner = np.maximum(words.ptr[:-1] + 1, 0)
    out["repeats"] = np.where(n > 1, again[words.ptr[1:]] - again[np.minimum(inner, len(h))], 0) / some
    out["words"] = n.astype(float)
    out["word_length"] = np.diff(total[words.ptr]) / some
    longest = np.zeros(len(n))
    if (n > 0).any():
        longest[n > 0] = np.maximum.reduceat(length, words.ptr[:-1][n > 0])
    out["longest_word"] = longest
    return out


@dataclass
class Features:
    """Feature ids of each document: words at ptr, then fields as a matrix."""

    words: np.ndarray
    ptr: np.ndarray
    fields: np.ndarray


def features(texts: pa.Array, meta: list[pa.Array]) -> Features:
    texts = pc.fill_null(texts, "")
    w = split_words(texts)
    h = w.hashes()
    stems = hash_spans(w.buf, w.starts, np.minimum(w.ends, w.starts + STEM)) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    mask = np.uint64(BUCKETS - 1)
    both = np.empty((len(h), 2), np.int32)
    both[:, 0] = h & mask
    both[:, 1] = mix(stems) & mask
    ids, ptr = both.reshape(-1), w.ptr * 2
    n_docs = len(ptr) - 1
    for a, b in zip(ptr[:-1], ptr[1:]):
        ids[a:b].sort()
    keep = np.ones(len(ids), bool)
    keep[1:] = ids[1:] != ids[:-1]
    keep[ptr[:-1][np.diff(ptr) > 0]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    n = np.maximum(np.diff(w.ptr), 1)
    stats = statistics(texts, w, h)
    stats["distinct"] = np.diff(before[ptr]) / (2 * n)
    cols = []
    for k, (name, edges) in enumerate(_EDGES.items()):
        bin_ = np.searchsorted(edges, stats[name], side="right")
        cols.append(mix((bin_ + 100 * (k + 1)).astype(np.uint64)) & mask)
    for k, m in enumerate(meta):
        col = pc.fill_null(m.cast(pa.string()), "\0null")
        buf, offs = string_buffers(col)
        cols.append(mix(hash_spans(buf, offs[:-1], offs[1:]) + np.uint64(7919 * (k + 1))) & mask)
    fields = np.stack(cols, axis=1).astype(np.int32) if n_docs else np.zeros((0, len(_EDGES) + len(meta)), np.int32)
    return Features(ids[keep], before[ptr], fields)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def parts(self, f: Features) -> tuple[np.ndarray, ...]:
        """Score, and what the gradient needs of it."""
        n = np.diff(f.ptr)
        y = 1 / np.sqrt(np.maximum(n, 1)).astype(np.float32)
        z = y**LINEAR
        linear, q = np.zeros(len(n), np.float32), np.zeros((len(n), self.v.shape[1]), np.float32)
        sq = np.zeros_like(q)
        some = np.flatnonzero(n)
        if len(some):
            at = f.ptr[:-1][some]
            vw = self.v[f.words]
            linear[some] = np.add.reduceat(self.w[f.words], at) * z[some]
            q[some] = np.add.reduceat(vw, at, axis=0) * y[some, None]
            sq[some] = np.add.reduceat(vw * vw, at, axis=0) * (y * y)[some, None]
        vf = self.v[f.fields]
        q += vf.sum(1)
        sq += (vf * vf).sum(1)
        score = self.w0 + linear + self.w[f.fields].sum(1) + 0.5 * (q * q - sq).sum(1)
        return score, q, y

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(f)[0].astype(np.float64), -40, 40)))


def _take(f: Features, rows: np.ndarray) -> Features:
    n = np.diff(f.ptr)[rows]
    ptr = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(f.ptr[:-1][rows] - ptr[:-1], n) + np.arange(ptr[-1])
    return Features(f.words[at], ptr, f.fields[rows])


def fit(f: Features, good: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, rate: float = 1.0, decay: float = 2e-5) -> Machine:
    """Logistic loss by AdaGrad on small batches; the same rows give the same machine."""
    rng = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(BUCKETS, np.float32), rng.normal(0, 0.03, (BUCKETS, rank)).astype(np.float32))
    gw, gv, g0 = np.full(BUCKETS, 1e-3, np.float32), np.full((BUCKETS, rank), 1e-2, np.float32), 1e-3
    target = good.astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            b = _take(f, rows)
            score, q, y = m.parts(b)
            err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target[rows]).astype(np.float32) / len(rows)
            n = np.diff(b.ptr)
            ids = np.concatenate([b.words, b.fields.reshape(-1)])
            doc = np.concatenate([np.repeat(np.arange(len(rows)), n), np.repeat(np.arange(len(rows)), b.fields.shape[1])])
            x = np.concatenate([np.repeat(y, n), np.ones(b.fields.size, np.float32)])
            z = np.concatenate([np.repeat(y**LINEAR, n), np.ones(b.fields.size, np.float32)])
            uniq, inv = np.unique(ids, return_inverse=True)
            dw = np.bincount(inv, err[doc] * z, len(uniq)).astype(np.float32) + decay * m.w[uniq]
            e = err[doc] * x
            vi = m.v[ids]
            each = e[:, None] * (q[doc] - vi * x[:, None])
            dv = np.stack([np.bincount(inv, each[:, k], len(uniq)) for k in range(rank)], axis=1).astype(np.float32)
            dv += decay * m.v[uniq]
            gw[uniq] += dw * dw
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            gv[uniq] += dv * dv
            m.v[uniq] -= 0.5 * rate * dv / np.sqrt(gv[uniq])
            d0 = float(err.sum())
            g0 += d0 * d0
            m.w0 -= rate * d0 / np.sqrt(g0)
    return m


def _stack(parts: list[Features]) -> Features:
    sizes = np.concatenate([np.diff(p.ptr) for p in parts])
    return Features(
        np.concatenate([p.words for p in parts]), np.concatenate([[0], np.cumsum(sizes)]),
        np.concatenate([p.fields for p in parts]),
    )


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", meta: tuple[str, ...] = ("lang", "source"),
    good: str = "quality = 1 AND toxic = 0", max_rows: int = TRAIN_ROWS,
) -> Machine | None:
    """A machine fitted on at most ``max_rows`` labelled documents, None if there are none.

    ``good`` is SQL over ``labels``; rows where it is null aren't used, nor are
    labels without a document.  If only one class is there, the machine says that.
    Labels are taken in order of a hash of their id; if their ids stand in more than
    ``max_rows`` rows, these are taken in order of a hash of all their columns.  A row that is
    repeated as a whole is one.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.expr(f"CAST({good} AS int)").alias("good"))
        .filter("id IS NOT NULL AND good IS NOT NULL")
        .orderBy(F.xxhash64("id"), "id", "good").limit(max_rows)
    )
    docs = small_batches(docs)
    fields = [F.col(c).alias(f"m{k}") for k, c in enumerate(meta)]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *fields)
    # an id may stand in any number of rows: of all that have a chosen one, so many are taken
    order = F.xxhash64("id", "text", *[f"m{k}" for k in range(len(meta))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in doc_chunks(batch, "text"):
                f = features(b.column("text"), [b.column(f"m{k}") for k in range(len(meta))])
                lists = pa.ListArray.from_arrays(pa.array(f.ptr.astype(np.int32)), pa.array(f.words))
                fields = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, f.fields.size + 1, f.fields.shape[1], dtype=np.int32)), pa.array(f.fields.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays([b.column("order"), b.column("good"), lists, fields], ["id", "good", "words", "fields"])

    # the chosen labels are max_rows pairs of numbers at most, so they are broadcast
    found = rows.join(F.broadcast(chosen), "id").withColumn("order", order)
    bound = found.select("order").distinct().orderBy("order").limit(max_rows).agg(F.max("order")).first()[0]
    if bound is None:
        return None
    one = found.filter(F.col("order") <= bound).dropDuplicates(["order", "good"])
    got = (
        one.mapInArrow(run, "id long, good int, words array<int>, fields array<int>")
        .toArrow().combine_chunks().sort_by([("id", "ascending"), ("good", "ascending")]).slice(0, max_rows)
    )
    words, fields = got.column("words").combine_chunks(), got.column("fields").combine_chunks()
    ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
    f = Features(words.flatten().to_numpy(), ptr, fields.flatten().to_numpy().reshape(got.num_rows, -1))
    return fit(f, got.column("good").to_numpy())


def score_column(machine: Machine | None, spark, text, *meta):
    """Column of the score of (text, metadata...); 1.0 if there is no machine."""
    if machine is None:
        return F.lit(1.0)
    shared = spark.sparkContext.broadcast(machine)

    def score(texts: pa.Array, *fields: pa.Array) -> pa.Array:
        out, m = [], shared.value
        batch = pa.RecordBatch.from_arrays([texts, *fields], ["text", *[f"m{k}" for k in range(len(fields))]])
        for c in doc_chunks(batch, "text"):
            out.append(m.score(features(c.column(0), list(c.columns[1:]))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    score.__annotations__ = {}
    return F.arrow_udf(score, "double")(text, *meta)


def quality_scores(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", meta: tuple[str, ...] = ("lang", "source"),
    keep_at: float = KEEP_AT, **training,
) -> DataFrame:
    """(doc_id, score, keep) of every row of ``docs``.

    ``keep`` says that the score, the chance that the document is good, reaches
    ``keep_at``.  Null and empty texts are scored by their fields alone, null
    metadata are a value of their own, equal rows get equal scores, a repeated row
    is scored each time, a text of any length whole.  Without usable labels every score is 1.  An empty table
    gives no rows; columns that aren't named are not read.
    """
    docs = small_batches(docs)
    machine = train(docs, labels, text, doc_id, meta, **training)
    score = score_column(machine, docs.sparkSession, F.col(text), *[F.col(c) for c in meta])
    scored = docs.select(F.col(doc_id).alias("doc_id"), score.alias("score"))
    return scored.withColumn("keep", F.col("score") >= keep_at)


def keep_good(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", meta: tuple[str, ...] = ("lang", "source"),
    keep_at: float = KEEP_AT, **training,
) -> DataFrame:
    """The rows of ``docs`` whose ``quality_scores`` say keep, with all their columns.

    Nulls, empty and long texts, ties, repeated rows and empty tables are as there; further
    columns stay, whatever their names.
    """
    docs = small_batches(docs)
    machine = train(docs, labels, text, doc_id, meta, **training)
    return docs.filter(score_column(machine, docs.sparkSession, F.col(text), *[F.col(c) for c in meta]) >= keep_at)
