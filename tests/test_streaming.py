from lexmill.operators.bloom import bloom_has, bloom_params
from lexmill.sources.versions import DeltaTable
from lexmill.streaming import state


def run(spark, rows, schema, tmp_path, action, batches=2):
    """A stream of a few files, one a batch, through ``action``."""
    for k in range(batches):
        part = [r for i, r in enumerate(rows) if i * batches // len(rows) == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = action(stream).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_dictionary_and_filter_over_batches(spark, tmp_path):
    rows = [(1, "b"), (2, "a"), (3, "b"), (4, "c"), (5, "a")]
    run(spark, rows, "k long, term string", tmp_path, lambda s: s.writeStream.foreachBatch(state.enumerate_batches(str(tmp_path / "dict"), ["k"])))
    held = state.dictionary_table(spark, str(tmp_path / "dict"))
    first = {r.term: r.id for r in held.read().collect()}
    assert sorted(first.values()) == [1, 2, 3] and set(first) == {"a", "b", "c"}
    # a batch that is run again changes nothing
    again = spark.createDataFrame(rows, "k long, term string")
    state.enumerate_batches(str(tmp_path / "dict"), ["k"])(again, 2)
    assert {r.term: r.id for r in held.read().collect()} == first
    add = state.bloom_batches(str(tmp_path / "bloom"), "term", bloom_params("1K", "1%"))
    add(again.filter("k < 3"), 0)
    add(again, 1)
    add(again, 1)
    f = state.stream_bloom(spark, str(tmp_path / "bloom"), bloom_params("1K", "1%"))
    assert f.count == 3
    probe = spark.createDataFrame([("a",), ("c",), ("zz",)], "term string")
    assert sorted(r.term for r in bloom_has(probe, "term", f).collect()) == ["a", "c"]


def test_growing_tables_merge_and_replay(spark, tmp_path):
    held = DeltaTable(spark, str(tmp_path / "t"), state._counts, compact=3)
    add = lambda k, n: held.write(spark.createDataFrame([("a", 1), (f"b{k}", n)], "term string, n long"), k)
    for k in range(9):
        add(k, k)
        add(k, k)  # a batch that is run again changes nothing
        assert {tuple(r) for r in held.read().collect()} == {("a", k + 1), *((f"b{i}", i) for i in range(k + 1))}
        assert {tuple(r) for r in (held.read(k) or spark.createDataFrame([], "term string, n long")).collect()} == ({("a", k), *((f"b{i}", i) for i in range(k))} if k else set())
    assert len(list((tmp_path / "t").iterdir())) < 9


def test_lines_of_documents_keep_their_state(spark, tmp_path):
    long = "w" * 65
    rows = [(1, 1, long), (2, 1, "A  B"), (1, 2, "end."), (2, 2, "c  d e")]
    schema = "doc_id long, line_no long, line string"
    out = tmp_path / "out"
    run(spark, rows, schema, tmp_path, lambda s: state.unwrap_stream(s).writeStream.format("parquet").option("path", str(out)))
    got = {tuple(r) for r in spark.read.parquet(str(out)).collect()}
    assert got == {(1, 2, f"{long} end."), (2, 1, "A  B"), (2, 2, "c  d e")}


def test_the_end_of_a_document_brings_out_its_open_paragraph(spark, tmp_path):
    long = "w" * 65
    rows = [(1, 1, long), (2, 1, "A  B"), (1, 2, None), (2, 2, None)]
    out = tmp_path / "out"
    run(spark, rows, "doc_id long, line_no long, line string", tmp_path, lambda s: state.unwrap_stream(s).writeStream.format("parquet").option("path", str(out)))
    assert {tuple(r) for r in spark.read.parquet(str(out)).collect()} == {(1, 1, f"{long} "), (2, 1, "A  B")}


def test_columns_of_documents_keep_their_state(spark, tmp_path):
    rows = [(1, 1, "A   B"), (1, 2, "cc  d e")]
    schema = "doc_id long, line_no long, line string"
    out = tmp_path / "out"
    run(spark, rows, schema, tmp_path, lambda s: state.columns_stream(s).writeStream.format("parquet").option("path", str(out)))
    assert {tuple(r) for r in spark.read.parquet(str(out)).collect()} == {(1, 1, "A\tB"), (1, 2, "cc\td e")}
