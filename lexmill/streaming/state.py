"""Streams: row-local operators as they are, dictionaries and filters batch by batch, line state by document."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bloom import BloomFilter, BloomParams, bloom_build, bloom_lacks
from ..operators.enumerate import new_entries, new_state
from ..operators.layout import common_gaps, fields, gaps, unwrap_step
from ..operators.terms import term_freq, terms
from ..runtime import shared_dir
from ..sources.versions import DeltaTable


def dictionary_table(spark: SparkSession, path: str) -> DeltaTable:
    """The dictionary (term, id) that ``enumerate_batches`` keeps."""
    return DeltaTable(spark, path)


def enumerate_batches(path: str, order: list[str], term: str = "term") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: extends the dictionary (term, id) at ``path`` by the batch's terms; only new ones are written."""

    def run(batch: DataFrame, number: int) -> None:
        held = dictionary_table(batch.sparkSession, path)
        state = held.read(number)
        held.write(new_entries(batch, order, term, new_state(batch.sparkSession) if state is None else state), number)

    return run


def _merged_words(rows: DataFrame) -> DataFrame:
    """Words with their bits together; the row of part -1 has the count of keys."""
    bits = F.when(F.col("part") < 0, F.sum("bits")).otherwise(F.bit_or("bits"))
    return rows.groupBy("part", "word").agg(bits.alias("bits"))


def bloom_table(spark: SparkSession, path: str) -> DeltaTable:
    return DeltaTable(spark, path, _merged_words)


def stream_bloom(spark: SparkSession, path: str, params: BloomParams, before: int | None = None) -> BloomFilter | None:
    """The filter that ``bloom_batches`` keeps; None if there is none yet."""
    rows = bloom_table(spark, path).read(before)
    if rows is None:
        return None
    count = rows.filter("part < 0").agg(F.coalesce(F.sum("bits"), F.lit(0))).first()[0]
    return BloomFilter(params, rows.filter("part >= 0"), count)


def bloom_batches(path: str, col: str, params: BloomParams) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds the batch's values to the filter at ``path``; only the words of new keys are written."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = stream_bloom(spark, path, params, number)
        added = bloom_build(batch if old is None else bloom_lacks(batch, col, old), col, params)
        count = spark.createDataFrame([(-1, 0, added.count)], "part int, word long, bits long")
        bloom_table(spark, path).write(added.words.unionByName(count), number)

    return run


def _by_document(lines: DataFrame, doc_id: str, output: str, step, end, timeout_ms: int | None = None) -> DataFrame:
    """Stateful per document: lines of a micro-batch in order of line_no, state as JSON.

    A row whose line is null ends its document, as does ``timeout_ms`` of processing time
    without lines: ``end`` says what is still to come out, and the state goes.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else [0, None]
        out: list = []
        if state.hasTimedOut:
            out, held = end(*held), None
        else:
            rows = pd.concat(list(frames)).sort_values("line_no", kind="stable")
            for no, line in zip(rows["line_no"], rows["line"]):
                held = [0, None] if held is None else held
                if line is None:
                    out += end(*held)
                    held = None
                else:
                    more, kept = step([(no, line)], held[1])
                    out += more
                    held = [int(no), kept]
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[doc_id, *[c.split()[0] for c in output.split(", ")]])

    kind = dict(lines.dtypes)[doc_id]
    waits = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return lines.groupBy(doc_id).applyInPandasWithState(run, f"{doc_id} {kind}, {output}", "state string", "append", waits)


def unwrap_stream(lines: DataFrame, doc_id: str = "doc_id", timeout_ms: int | None = None) -> DataFrame:
    """(doc_id, line_no, line) of unwrapped lines of a stream (doc_id, line_no, line).

    The open paragraph of a document waits in the state for its end; line_no is that of
    the line that closed it.  A row with a null line ends a document and brings out what is
    open, with the number of its last line, as does ``timeout_ms`` without lines.  A
    document's lines must arrive in order over the batches.
    """

    def step(rows, held):
        out, held = [], held or ""
        for no, line in rows:
            more, held = unwrap_step(line, held)
            out += [(no, x) for x in more]
        return out, held

    def end(no, held):
        return [(no, held)] if held else []

    return _by_document(lines, doc_id, "line_no long, line string", step, end, timeout_ms)


def columns_stream(lines: DataFrame, delim: str = " ", joiner: str = "\t", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, line): each line cut at the gaps common to it and all before it, joined by ``joiner``.

    A row with a null line ends a document; the next line begins anew.
    """

    def step(rows, held):
        cuts = [tuple(x) for x in held or []]
        out = []
        for no, line in rows:
            cuts = common_gaps(cuts, gaps(line, delim))
            out.append((no, joiner.join(fields(line, cuts, delim))))
        return out, cuts

    return _by_document(lines, doc_id, "line_no long, line string", step, lambda no, held: [])


def _stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file, which a source takes by its folder only."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def count_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds the batch's (term, n), counted, to the frequencies at ``path``."""

    def run(batch: DataFrame, number: int) -> None:
        DeltaTable(batch.sparkSession, path, _counts).write(term_freq(batch), number)

    return run


def streamed(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row-local ``transform`` of the Parquet files at ``path``, read as a stream up to what is there now."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = transform(_stream(spark, path, spark.read.parquet(path).schema))
    query = (
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def stream_term_freq(spark: SparkSession, path: str) -> DataFrame:
    """(term, n) of documents read as a stream: each batch is counted, and the counts are summed."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = terms(_stream(spark, path, spark.read.parquet(path).schema).select("doc_id", "text"))
    query = (
        rows.writeStream.foreachBatch(count_batches(f"{folder}/counts")).option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    counts = DeltaTable(spark, f"{folder}/counts", _counts).read()
    return spark.createDataFrame([], "term string, n long") if counts is None else counts
