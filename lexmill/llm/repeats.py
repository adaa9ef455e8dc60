"""Substring dedup: matching statistics against suffix automata of reference shards.

A word of a document goes if it lies in a run of ``MIN_WORDS`` words or more that
an earlier document has too.  Every window of ``MIN_WORDS`` words belongs to the
least of its ``GRAM``-word hashes, its minimizer, so equal windows meet wherever
they stand; neighbouring windows of one minimizer make a stretch.  Minimizers
that a single document has are dropped, and stretches that are equal throughout
are settled by grouping.  The others are the reference: they are dealt to shards
by their minimizer, each shard's task builds the suffix automaton of its shard,
and the stretches are streamed through it for their matching statistics.  A shard
is sent to its own task only: sending all of them to all would make the work
quadratic.  A state of the automaton knows the first document that has its runs,
so that only earlier documents match.  A minimizer with more reference words than fit
a shard, as of a phrase in very many surroundings, isn't dealt to one: its windows are
grouped one by one, which any number of tasks share.  Lastly the runs of a document are
joined to maximal spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .runtime import checkpoint_dir, cut, free_name, remove, small, small_batches
from .text import Words, doc_chunks, shingles, split_words, string_buffers

MIN_WORDS = 50
GRAM = 12
#: Words of reference text that a shard holds on average; a minimizer that has more than half as many has no shard.
SHARD_WORDS = 100_000


def stretches(h: np.ndarray, ptr: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, minimizer, first word, end) of each stretch; first and end within the document."""
    grams, gp = shingles(h, ptr, gram, short=False)
    w = min_words - gram + 1
    none = np.zeros(0, np.int64)
    if len(grams) < w:
        return none, np.zeros(0, np.uint64), none, none
    least = grams
    width = 1
    while width < w:  # minimum of w by doubling
        step = min(width, w - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(gp))
    at = np.flatnonzero(doc[: len(least)] == doc[w - 1 :])
    if not len(at):
        return none, np.zeros(0, np.uint64), none, none
    value, of = least[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return of[first], value[first], at[first] - gp[of[first]], at[last] - gp[of[last]] + min_words


def _minimizers(min_words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in doc_chunks(batch, "text"):
                w = split_words(chunk.column("text"))
                doc, value, first, end = stretches(w.hashes(), w.ptr, min_words, gram)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [chunk.column("row").take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (value.view(np.int64), first, end))],
                        ["row", "mini", "first", "end"],
                    )

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words, as 32 bits each, of the stretches listed with every document."""
    for batch in batches:
        for chunk in doc_chunks(batch, "text"):
            w = split_words(chunk.column("text"))
            h = (w.hashes() >> np.uint64(32)).astype(np.uint32)
            lists = chunk.column("at")
            count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            mini, first, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            doc = np.repeat(np.arange(chunk.num_rows), count)
            base = w.ptr[:-1][doc]
            # a stretch list may be long: hand on some megabytes at a time
            size = np.cumsum(end - first)
            cuts = np.searchsorted(size, np.arange(1 << 20, (size[-1] if len(size) else 0) + (1 << 20), 1 << 20), side="left") + 1
            a = 0
            for b in np.minimum(cuts, len(doc)):
                if b > a:
                    body = [h[base[k] + first[k] : base[k] + end[k]].tobytes() for k in range(a, b)]
                    rows = pa.array(doc[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [
                            chunk.column("row").take(rows), chunk.column("id").take(rows), pa.array(mini[a:b]), pa.array(first[a:b]),
                            pa.array(end[a:b]), pa.array(body, pa.binary()),
                        ],
                        ["row", "id", "mini", "first", "end", "body"],
                    )
                a = max(a, b)


def matched_runs(sequence, automaton: SuffixAutomaton, owner: list[int], doc: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, first document) of the longest runs that documents before ``doc`` have."""
    size, link, step = automaton.size, automaton.link, automaton.next
    state = length = 0
    out = []
    for k, c in enumerate(sequence):
        before = (state, length)
        to = step[state].get(c)
        while (to is None or owner[to] >= doc) and state:
            state = link[state]
            length = size[state]
            to = step[state].get(c)
        if to is None or owner[to] >= doc:
            state = length = 0
        else:
            state, length = to, length + 1
        if before[1] >= least and length <= before[1]:
            out.append((k - before[1], k, owner[before[0]]))
    if length >= least:
        out.append((len(sequence) - length, len(sequence), owner[state]))
    return out


def _shard(min_words: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("idn", "ascending"), ("id", "ascending"), ("row", "ascending"), ("first", "ascending")])
        row = t.column("row").to_numpy()
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        doc = np.cumsum(new) - 1
        place = np.flatnonzero(new)
        body, first = t.column("body"), t.column("first").to_numpy()
        automaton, owner = SuffixAutomaton(), [-1]
        at, start, end, by = [], [], [], []
        for i in range(t.num_rows):
            seq = np.frombuffer(body[i].as_buffer(), np.uint32).tolist()
            d = int(doc[i])
            for a, b, o in matched_runs(seq, automaton, owner, d, min_words):
                at.append(i)
                start.append(int(first[i]) + a)
                end.append(int(first[i]) + b)
                by.append(int(place[o]))
            automaton.add(seq, owner, d)
        mine, theirs = pa.array(at, pa.int64()), pa.array(by, pa.int64())
        return pa.table({
            "row": t.column("row").take(mine), "id": t.column("id").take(mine), "first": pa.array(start, pa.int64()),
            "end": pa.array(end, pa.int64()), "kn": t.column("idn").take(theirs), "kv": t.column("id").take(theirs), "kr": t.column("row").take(theirs),
        })

    return run


def _windows(min_words: int):
    """Each window of the stretches with a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False) // 4
            total = np.cumsum(size)
            at = 0
            while at < batch.num_rows:  # about 2^16 windows at a time, of one stretch at least
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 16), side="right")))
                some = batch.slice(at, end - at)
                words = np.frombuffer(b"".join(some.column("body").to_pylist()), np.uint32).astype(np.uint64)
                ptr = np.concatenate([[0], np.cumsum(size[at:end])])
                value, wp = shingles(words, ptr, min_words, short=False)
                own = np.repeat(np.arange(end - at), np.diff(wp))
                first = some.column("first").to_numpy(zero_copy_only=False)[own] + np.arange(len(own)) - wp[:-1][own]
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c).take(rows) for c in ("mini", "idn", "id", "row")), pa.array(first), pa.array(value.view(np.int64))],
                    ["mini", "idn", "id", "row", "first", "digest"],
                )
                at = end

    return run


def _grouped(hot: DataFrame, min_words: int, kind: str) -> DataFrame:
    """The windows of stretches (mini, idn, id, row, first, body) that an earlier document has, with the first of these."""
    windows = hot.mapInArrow(_windows(min_words), f"mini long, idn boolean, id {kind}, row long, first long, digest long")
    windows = cut(windows)
    lead = windows.groupBy("mini", "digest").agg(F.min(F.struct("idn", "id", "row")).alias("lead"), F.count("*").alias("c")).filter("c > 1")
    return windows.join(lead, ["mini", "digest"]).filter("row <> lead.row").select(
        "row", "id", "first", (F.col("first") + min_words).alias("end"),
        F.col("lead.idn").alias("kn"), F.col("lead.id").alias("kv"), F.col("lead.row").alias("kr"),
    )


def _spans(docs: DataFrame, row: str, text: str, doc_id: str, min_words: int, gram: int, shard_words: int) -> DataFrame:
    """(row, id, start_word, end_word, keep) of the maximal repeated spans."""
    if not 1 <= gram <= min_words:
        raise ValueError("gram must be from 1 to min_words")
    kind = dict(docs.dtypes)[doc_id]
    docs = small_batches(docs).select(F.col(row).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = cut(docs.select("row", "text").mapInArrow(_minimizers(min_words, gram), "row long, mini long, first long, end long"))
    shared = cut(found.groupBy("mini").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a <> b").select("mini"))
    lists = cut(
        found.join(small(shared, shared.count(), 24), "mini", "left_semi")
        .groupBy("row").agg(F.collect_list(F.struct("mini", "first", "end")).alias("at"))
    )
    n, stretches_ = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    listed = docs.join(small(lists, n * 40 + stretches_ * 28, 1), "row").select("row", "id", "text", "at")
    path = f"{checkpoint_dir(docs.sparkSession)}/repeats-{uuid.uuid4().hex}"
    listed.mapInArrow(_contents, f"row long, id {kind}, mini long, first long, end long, body binary").withColumn(
        "digest", F.xxhash64("body")
    ).write.parquet(path)
    # a folder of columns, of which the grouping reads all but the words
    parts = docs.sparkSession.read.parquet(path).withColumn("idn", F.col("id").isNull())
    order = F.struct("idn", "id", "row", "first")
    groups = cut(parts.groupBy("mini", "digest").agg(F.min(order).alias("lead"), F.count("*").alias("c")))
    copies = parts.drop("body").join(groups.filter("c > 1"), ["mini", "digest"]).filter("row <> lead.row").select(
        "row", "id", "first", "end", F.col("lead.idn").alias("kn"), F.col("lead.id").alias("kv"), F.col("lead.row").alias("kr")
    )
    varied = groups.groupBy("mini").agg(F.count("*").alias("k")).filter("k > 1").select("mini")
    leads = groups.join(varied, "mini", "left_semi").select("mini", "digest", F.col("lead.row").alias("row"))
    reference = cut(parts.join(leads, ["mini", "digest", "row"]).select("mini", "idn", "id", "row", "first", "body"))
    load = cut(reference.groupBy("mini").agg((F.sum(F.octet_length("body")) / 4).cast("long").alias("words")))
    much = F.col("words") > shard_words // 2
    words, hot = load.agg(F.coalesce(F.sum(F.when(~much, F.col("words"))), F.lit(0)), F.coalesce(F.sum(much.cast("long")), F.lit(0))).first()
    shards = int(words // shard_words) + 1
    copies = cut(copies)
    remove(docs.sparkSession, path)
    if hot:
        loaded = small(load.filter(much).select("mini"), hot, 24)
        copies = copies.unionByName(_grouped(reference.join(loaded, "mini", "left_semi"), min_words, kind))
        reference = reference.join(loaded, "mini", "left_anti")
    runs = (
        reference.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards)).cast("int"))
        .repartition(shards, "shard").groupBy("shard")
        .applyInArrow(_shard(min_words), f"row long, id {kind}, first long, end long, kn boolean, kv {kind}, kr long")
    )
    every = copies.unionByName(runs)
    seen = Window.partitionBy("row").orderBy("first", "end")
    joined = (
        every.withColumn("reach", F.max("end").over(seen.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("span", F.sum(F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return joined.groupBy("row", "span").agg(
        F.first("id").alias("id"), F.min("first").alias("start_word"), F.max("end").alias("end_word"),
        F.min(F.struct("kn", "kv", "kr")).alias("keep"),
    ).drop("span")


def repeated_spans(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(doc_id, start_word, end_word, keep_id) of every maximal span that goes.

    A word goes if a run of ``min_words`` words or more around it also stands in an
    earlier document (by id, a null id last, equal ids by place in the scan); the
    words that go make up the spans, and keep_id is the first of the documents that
    keep a part of one.  Words are compared in lower case and without what stands
    between them.  Repeats within one document stay.  Null, empty and shorter texts
    have no spans, texts of any length are compared whole; a repeated row of
    ``min_words`` words is a span from end to end.  Ids keep their type.
    An empty table gives no rows; columns that aren't named are not read, so theirs may
    have any names.  Several jobs run before it returns.  ``docs``
    must give its rows in the same order each time (a file scan does).
    """
    row = free_name(docs.select(text, doc_id), "row")
    rows = docs.select(text, doc_id).withColumn(row, F.monotonically_increasing_id())
    return _spans(rows, row, text, doc_id, min_words, gram, shard_words).select(
        F.col("id").alias("doc_id"), "start_word", "end_word", F.col("keep.kv").alias("keep_id")
    )


def _ascii_lower(texts: pa.Array) -> Words:
    """Words of the texts, at their places in the texts as they are."""
    buf, offs = string_buffers(texts)
    low = buf.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    arr = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(low)])
    return split_words(arr.cast(pa.large_string()), lower=False)


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = texts.to_pylist()
    spans = spans.to_pylist()
    for k in [k for k, s in enumerate(spans) if s and out[k] is not None]:
        raw = out[k].encode()
        w = _ascii_lower(pa.array([out[k]], pa.large_string()))
        kept, at = [], 0
        for s in sorted(spans[k], key=lambda s: s["start_word"]):
            kept.append(raw[at : w.starts[s["start_word"]]])
            at = w.starts[s["end_word"]] if s["end_word"] < len(w.starts) else len(raw)
        out[k] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(out, pa.string())


def remove_repeated_spans(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``docs`` with the spans of ``repeated_spans`` cut out of their texts.

    A cut goes from a span's first word to the word behind it, or to the end of
    the text if there is none.  All rows and columns stay; a text that is one span is
    what stands before its first word, often empty.  Nulls, empty texts, ties and repeated
    rows are as ``repeated_spans`` says; an empty table stays one.
    """
    row = free_name(docs, "row")
    spans = free_name(docs, "spans")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = _spans(numbered, row, text, doc_id, min_words, gram, shard_words)
    lists = cut(found.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans)))
    size = lists.agg(F.coalesce(F.sum(F.size(spans) * 16 + 40), F.lit(0))).first()[0]

    def without(texts: pa.Array, at: pa.Array) -> pa.Array:
        return _without(texts, at)

    cleaned = F.arrow_udf(without, "string")(F.col(text), F.col(spans))
    both = small_batches(numbered).join(small(lists, size, 1), row, "left")
    return both.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(cleaned)).drop(row, spans)
