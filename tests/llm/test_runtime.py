import random

import pytest

from lexmill.llm import decontam, exact, neardup, packing, repeats, runtime

from .test_neardup import corpus

SCHEMA = "doc_id long, text string"


def both_ways(monkeypatch, run):
    """Results with every side broadcast, and with none."""
    out = []
    for limit in (64 << 20, -1):
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", limit)
        out.append(sorted((tuple(r) for r in run().collect()), key=str))
    return out


def test_small_says_what_is_broadcast(spark, monkeypatch):
    df, big = spark.range(10), spark.range(10)
    plan = lambda side: big.join(side, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(runtime.small(df, 10, 8)).lower()
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 79)
    assert "broadcast" not in plan(runtime.small(df, 10, 8)).lower()
    assert runtime.may_broadcast(9, 8) and not runtime.may_broadcast(10, 8)


def test_without_broadcasts_the_results_are_the_same(spark, monkeypatch):
    rows = corpus(11, 60)
    r = random.Random(3)
    rows += [(900 + i, rows[r.randrange(60)][1]) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(1, " ".join(rows[5][1].split()[:8])), (2, "nothing of it here at all")], "item_id long, text string")
    for run in (
        lambda: exact.drop_exact_duplicates(df),
        lambda: neardup.drop_near_duplicates(df),
        lambda: decontam.drop_contaminated(df, items),
        lambda: repeats.remove_repeated_spans(df, min_words=20, gram=6, shard_words=2000),
        lambda: packing.pack(df, capacity=64, groups=4),
    ):
        one, other = both_ways(monkeypatch, run)
        assert one and one == other


def test_operators_leave_the_session_as_it_is(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    df = spark.createDataFrame([(1, "a b c")], SCHEMA)
    mine = runtime.small_batches(df)
    assert mine.sparkSession.conf.get(name) == f"{runtime.BATCH_BYTES}b" and spark.conf.get(name) == before
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert runtime.small_batches(df).sparkSession.conf.get("spark.sql.shuffle.partitions") == "5"
        assert runtime.small_batches(mine).sparkSession is mine.sparkSession
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert mine.join(df, "doc_id").count() == 1


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        runtime.checkpoint_dir(Session())
