"""Language identification word by word with a linear-chain conditional random field.

A word's features are the word itself, its first and last one to four bytes, the
three- and four-byte runs of the word between its borders (all hashed), and the
languages of whose lexicon it is part.  Their weights give the word a score in each
language; transitions between the languages of neighbouring words are learned along
with them, on sequences that switch between the languages of labelled documents.
Forward-backward gives every word's chance of each language.  It runs over all
documents of a batch as one chain that starts anew at each of them, in blocks of
which all take a step at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import small_batches
from .text import Words, doc_chunks, hash_spans, mix, split_words

#: Labelled documents that the field is trained on at most, as many of each language.
TRAIN_DOCS = 1500
#: Words of a document that it is trained on at most, in windows drawn from all of it.
TRAIN_WORDS = 4096
#: Training sequences that are drawn from them, and words of each.
SEQUENCES = 6000
LENGTH = 32
EPOCHS = 4
BUCKETS = 1 << 16
AFFIX = 4
GRAMS = (3, 4)
#: A word is in a language's lexicon if so large a share of its documents are in it, and so many.
LEXICON_SHARE = 0.9
LEXICON_DOCS = 3


@dataclass
class WordFeatures:
    """Hashed feature ids of distinct words; word i has ids ptr[i]:ptr[i+1]."""

    ids: np.ndarray
    ptr: np.ndarray


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> WordFeatures:
    """Affixes and n-grams of the words buf[start:end], of which h are the hashes."""
    n = len(starts)
    size = ends - starts
    width = size + 2
    offs = np.concatenate([[0], np.cumsum(width)])
    own = np.repeat(np.arange(n), width)
    inner = np.arange(offs[-1]) - offs[:-1][own]
    text = np.where(inner == 0, 1, 2).astype(np.uint8)
    mid = (inner > 0) & (inner <= size[own])
    text[mid] = buf[(starts[own] + inner - 1)[mid]]
    word, value = [np.arange(n)], [mix(h + np.uint64(11))]
    lo, hi = offs[:-1], offs[1:]
    for k in range(1, AFFIX + 1):
        some = np.flatnonzero(size >= k)
        word += [some, some]
        value += [
            mix(hash_spans(text, lo[some], lo[some] + k + 1) + np.uint64(101)),
            mix(hash_spans(text, hi[some] - k - 1, hi[some]) + np.uint64(211)),
        ]
    for k in GRAMS:
        at = np.flatnonzero(inner + k <= width[own])
        word.append(own[at])
        value.append(mix(hash_spans(text, at, at + k) + np.uint64(307 * k)))
    word, value = np.concatenate(word), np.concatenate(value)
    order = np.argsort(word, kind="stable")
    ids = (value[order] & np.uint64(BUCKETS - 1)).astype(np.int64)
    return WordFeatures(ids, np.searchsorted(word[order], np.arange(n + 1)))


@dataclass
class Field:
    """Weights of a trained field; ``lexicon`` has the hashes of its words in order, ``member`` their languages."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    lexical: np.ndarray

    def emissions(self, f: WordFeatures, h: np.ndarray) -> np.ndarray:
        """Score of each distinct word in each language."""
        n = np.diff(f.ptr)
        out = np.add.reduceat(self.weights[f.ids], f.ptr[:-1], axis=0) / np.sqrt(n)[:, None] if len(n) else np.zeros((0, len(self.languages)))
        return out + self.bias + self.lexicon_rows(h) @ self.lexical

    def lexicon_rows(self, h: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(h), len(self.languages)))
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where((self.lexicon[at] == h)[:, None], self.member[at], 0.0)

    def posteriors(self, w: Words) -> np.ndarray:
        """Chance of each language for every word."""
        if not len(w.starts):
            return np.zeros((0, len(self.languages)))
        h = w.hashes()
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        e = self.emissions(word_features(w.buf, w.starts[at], w.ends[at], uniq), uniq)
        first = np.zeros(len(h), bool)
        first[w.ptr[:-1][np.diff(w.ptr) > 0]] = True
        return forward_backward(e[inv], first, self.transitions, self.start)


def _scan(y: np.ndarray, anew: np.ndarray, a: np.ndarray, start: np.ndarray, back: bool) -> np.ndarray:
    """Vectors of the recursion over all words up to a factor, from a uniform one.

    Forward v_t = (v_{t-1} a) y_t, or start y_t where the chain begins ``anew``; ``back``
    v_t = a (v_{t-1} y_t), or ones there.  The chain is cut into about sqrt(n) blocks:
    the products within blocks, then the vectors at their edges, then all others.
    """
    n, k = y.shape
    block = max(1, int(np.sqrt(n)))
    count = -(-n // block)
    place = np.arange(count) * block

    def step(v: np.ndarray, t: int) -> np.ndarray:
        inside = place + t < n
        at = np.minimum(place + t, n - 1)
        now = y[at][:, None, :]
        out = (v * now) @ a.T if back else (v @ a) * now
        new = anew[at]
        if new.any():
            out[new] = v[new].sum(axis=2, keepdims=True) * (1.0 if back else start * now[new])
        out = np.where(inside[:, None, None], out, v)
        return out / out.sum(axis=(1, 2), keepdims=True)

    product = np.broadcast_to(np.eye(k), (count, k, k))
    for t in range(block):
        product = step(product, t)
    edge = np.empty((count, 1, k))
    v = np.full(k, 1.0 / k)
    for b in range(count):
        edge[b, 0] = v
        v = v @ product[b]
        v = v / v.sum()
    out = np.empty((count, block, k))
    for t in range(block):
        edge = step(edge, t)
        out[:, t] = edge[:, 0]
    return out.reshape(-1, k)[:n]


def forward_backward(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posteriors of a chain of words with scores ``e`` that starts anew wherever ``first`` says."""
    x = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-30
    a = np.exp(transitions - transitions.max())
    s = np.exp(start - start.max())
    forward = _scan(x, first, a, s, False)
    later = np.concatenate([np.ones((1, len(s))), x[:0:-1]])  # scores of the word behind each, last word first
    p = forward * _scan(later, np.append(first[1:], True)[::-1], a, s, True)[::-1]
    return p / p.sum(axis=1, keepdims=True)


def _sequences(words: np.ndarray, ptr: np.ndarray, lang: np.ndarray, k: int, count: int, length: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) of sequences that switch between documents: half of them do, every few words."""
    by = [np.flatnonzero((lang == c) & (np.diff(ptr) > 0)) for c in range(k)]
    there = [c for c in range(k) if len(by[c])]
    x, y = np.empty((count, length), np.int64), np.empty((count, length), np.int64)
    for i in range(count):
        at = 0
        switch = rng.random() < 0.5
        while at < length:
            c = there[rng.integers(len(there))]
            d = by[c][rng.integers(len(by[c]))]
            n = min(length - at, int(rng.integers(3, 13)) if switch else length, int(ptr[d + 1] - ptr[d]))
            a = int(rng.integers(ptr[d], ptr[d + 1] - n + 1))
            x[i, at : at + n] = words[a : a + n]
            y[i, at : at + n] = c
            at += n
    return x, y


def fit(w: Words, lang: np.ndarray, languages: list[str], sequences: int = SEQUENCES, length: int = LENGTH, epochs: int = EPOCHS, rate: float = 0.3) -> Field:
    """Likelihood of the languages of drawn sequences by AdaGrad; the same documents give the same field."""
    rng = np.random.default_rng(11)
    k = len(languages)
    h = w.hashes()
    uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
    feats = word_features(w.buf, w.starts[at], w.ends[at], uniq)
    doc = np.repeat(np.arange(len(lang)), np.diff(w.ptr))
    pairs = np.unique(inv * len(lang) + doc)  # each word once a document
    docs_of = np.stack([np.bincount((pairs // len(lang))[lang[pairs % len(lang)] == c], minlength=len(uniq)) for c in range(k)], axis=1)
    per = np.maximum(np.bincount(lang, minlength=k), 1)
    rate_of = docs_of / per  # so that a language of many documents doesn't claim all words
    share = rate_of / np.maximum(rate_of.sum(axis=1, keepdims=True), 1e-12)
    member = (share >= LEXICON_SHARE) & (docs_of >= LEXICON_DOCS)
    chosen = member.any(axis=1)
    m = Field(languages, np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k)), np.zeros(k), uniq[chosen], member[chosen].astype(float), np.zeros((k, k)))
    x, y = _sequences(inv, w.ptr, lang, k, sequences, length, rng)
    lexical = m.lexicon_rows(uniq)
    grads = [np.full(p.shape, 1e-4) for p in (m.weights, m.bias, m.transitions, m.start, m.lexical)]
    batch = 64
    first = np.zeros((batch, length), bool)
    first[:, 0] = True

    def step(which: int, param: np.ndarray, g: np.ndarray, rows=slice(None)) -> None:
        grads[which][rows] += g * g
        param[rows] -= rate * g / np.sqrt(grads[which][rows])

    for _ in range(epochs):
        order = rng.permutation(len(x))
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            n = len(rows)
            words, pos = np.unique(x[rows].reshape(-1), return_inverse=True)
            count = np.diff(feats.ptr)[words]
            own = np.repeat(np.arange(len(words)), count)
            ids = feats.ids[np.repeat(feats.ptr[:-1][words] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            f = WordFeatures(ids, np.concatenate([[0], np.cumsum(count)]))
            e = m.emissions(f, uniq[words])[pos].reshape(n, length, k)
            p, pair = _chances(e, m.transitions, m.start)
            gold = y[rows]
            err = p.copy()
            np.put_along_axis(err, gold[:, :, None], np.take_along_axis(err, gold[:, :, None], 2) - 1, 2)
            err /= n
            flat = err.reshape(-1, k)
            per_word = np.stack([np.bincount(pos, flat[:, c], len(words)) for c in range(k)], axis=1)
            move = pair.sum(axis=(0, 1))
            np.add.at(move, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), -1.0)
            each = (per_word / np.sqrt(count)[:, None])[own]
            used, back = np.unique(ids, return_inverse=True)
            step(0, m.weights, np.stack([np.bincount(back, each[:, c], len(used)) for c in range(k)], axis=1), used)
            step(1, m.bias, flat.sum(axis=0))
            step(2, m.transitions, move / n)
            step(3, m.start, err[:, 0].sum(axis=0))
            step(4, m.lexical, lexical[words].T @ per_word)
    return m


def _chances(e: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of words and of neighbouring pairs, for sequences of one length."""
    n, length, k = e.shape
    x = np.exp(e - e.max(axis=2, keepdims=True)) + 1e-30
    a = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(x), np.ones_like(x)
    alpha[:, 0] = np.exp(start - start.max()) * x[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        alpha[:, t] = (alpha[:, t - 1] @ a) * x[:, t]
        alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        beta[:, t] = (x[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (x * beta)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return p, pair


def _windows(max_words: int, length: int):
    """Texts of over ``max_words`` words become that many words of them, in windows drawn from the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in doc_chunks(batch, "text"):
                w = split_words(chunk.column("text"))
                out = chunk.column("text").to_pylist()
                seeds = chunk.column("order").to_numpy(zero_copy_only=False)
                for d in np.flatnonzero(np.diff(w.ptr) > max_words):
                    a, n = int(w.ptr[d]), int(w.ptr[d + 1] - w.ptr[d])
                    rng = np.random.default_rng(int(seeds[d]) & 0xFFFFFFFF)
                    first = a + np.sort(rng.choice(n - length + 1, max_words // length, replace=False))
                    out[d] = b" ".join(w.buf[w.starts[k] : w.ends[k + length - 1]].tobytes() for k in first).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([chunk.column("order"), chunk.column("lang"), pa.array(out, pa.string())], ["order", "lang", "text"])

    return run


def train(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", max_docs: int = TRAIN_DOCS,
    max_words: int = TRAIN_WORDS, **fitting,
) -> Field | None:
    """A field fitted on at most ``max_docs`` documents that have a language, None if there are none.

    Every language has about the same number of them, one at least (if there are more
    languages than ``max_docs``, so many have one), in order of a hash of id and text.  Of a
    document of more than ``max_words`` words so many are trained on, in windows drawn from
    all of it.  A repeated row is one; null ids count, null texts and wordless ones don't.
    """
    docs = small_batches(docs)
    named = docs.select(F.xxhash64(doc_id, text).alias("order"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull()
    )
    languages = docs.select(F.col(lang).cast("string").alias("lang")).filter("lang <> ''").distinct().count()
    if not languages:
        return None
    # each task hands on so many rows of a language at most
    each = min(1000, -(-max_docs // languages))
    ranked = named.select("lang", "order").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order")))
    chosen = ranked.filter(F.col("rank") <= each).orderBy("rank", "lang").limit(max_docs).select("lang", "order").distinct()
    # max_docs rows at most, so they are broadcast
    taken = named.join(F.broadcast(chosen), ["lang", "order"]).dropDuplicates(["lang", "order"]).select("order", "lang", "text")
    got = taken.mapInArrow(_windows(max(max_words, LENGTH), LENGTH), "order long, lang string, text string").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("order", "ascending")])
    w = split_words(got.column("text").combine_chunks())
    if not len(w.starts):
        return None
    languages = sorted(set(got.column("lang").to_pylist()))
    code = np.array([languages.index(c) for c in got.column("lang").to_pylist()])
    return fit(w, code, languages, **fitting)


_SPANS = "array<struct<start_word: bigint, end_word: bigint, lang: string, chance: double>>"
_RESULT = f"lang string, chance double, words bigint, spans {_SPANS}"


def label_batch(texts: pa.Array, m: Field) -> list[pa.Array]:
    """The columns of ``_RESULT`` for a batch of texts."""
    w = split_words(texts)
    p = m.posteriors(w)
    best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
    n = np.diff(w.ptr)
    total = np.concatenate([np.zeros((1, len(m.languages))), np.cumsum(p, axis=0)]) if len(p) else np.zeros((1, len(m.languages)))
    share = (total[w.ptr[1:]] - total[w.ptr[:-1]]) / np.maximum(n, 1)[:, None]
    top = share.argmax(axis=1)
    names = pa.array(m.languages, pa.string())
    none = n == 0
    doc = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(best))
    sure = np.concatenate([[0.0], np.cumsum(p[np.arange(len(best)), best])]) if len(best) else np.zeros(1)
    of = doc[first] if len(first) else np.zeros(0, np.int64)
    kinds = pa.StructArray.from_arrays(
        [
            pa.array(first - w.ptr[of]), pa.array(last[: len(first)] - w.ptr[of]), names.take(pa.array(best[first])),
            pa.array(np.round((sure[last[: len(first)]] - sure[first]) / np.maximum(last[: len(first)] - first, 1), 6)),
        ],
        ["start_word", "end_word", "lang", "chance"],
    )
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)), kinds)
    return [
        pa.array(np.asarray(names.take(pa.array(top)).to_pylist(), object), pa.string(), mask=none),
        pa.array(np.round(share[np.arange(len(n)), top], 6), mask=none), pa.array(n.astype(np.int64)), spans,
    ]


def language_spans(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", field: Field | None = None, **training
) -> DataFrame:
    """(doc_id, lang, chance, words, spans) of every row of ``docs``.

    ``spans`` are the runs of words (start_word, end_word, lang, chance) that are most
    likely in one language, with the mean chance of their words; ``lang`` is the
    language of the largest expected share of words and ``chance`` that share.  Without
    a ``field`` one is trained on the documents whose column ``lang`` is filled.  Null,
    empty and wordless texts have no language, no words and no spans, as have all if
    there is nothing to train on.  Chances have six digits, so equal texts get equal results, repeated rows are
    labelled each, of equal chances the language first in order is taken.  An empty
    table gives no rows; texts of any length are labelled whole; columns that aren't named
    are not read, so theirs may have any names.
    """
    docs = small_batches(docs)
    field = field or train(docs, text, doc_id, lang, **training)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, {_RESULT}"
    if field is None:
        return rows.select(
            "doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("chance"),
            F.lit(0).cast("bigint").alias("words"), F.array().cast(_SPANS).alias("spans"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for chunk in doc_chunks(batch, "text"):
                texts = pc.fill_null(chunk.column("text"), "")
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *label_batch(texts, m)], ["doc_id", "lang", "chance", "words", "spans"])

    return rows.mapInArrow(run, schema)
