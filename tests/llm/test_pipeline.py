import corpus_pipeline
from lexmill.llm import packing

from .test_decontam import brute as contaminated
from .test_exact import brute as exact_brute
from .test_neardup import jaccard, shingle_set

SF = "/root/testdata/sf0.001"


def words(text):
    from .test_decontam import WORD

    return " ".join(WORD.findall((text or "").lower()))


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, SF)
        got.write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "best_fit_packing":
            fill, seen = {}, {}
            for r in got.collect():
                fill[r.bin_id] = fill.get(r.bin_id, 0) + r.length
                seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
            assert max(fill.values()) <= packing.CAPACITY
            assert seen == {i: len(t.encode().split()) for i, t in before.items() if t.split()}
            break
        assert got.columns == columns
        kept = {r.doc_id for r in got.collect()}
        gone = set(before) - kept
        assert kept <= set(before)
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
            good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
            assert len(good & kept) >= 0.95 * len(good)
            assert gone
        if name == "exact_dedup":
            assert gone == {i for i, _ in exact_brute(sorted(before.items()))}
        if name == "minhash_neardup":
            sets = {i: shingle_set(words(t), 3) for i, t in before.items()}
            sets = {i: s for i, s in sets.items() if s}
            best = {i: max((jaccard(s, sets[j]) for j in kept if j in sets), default=0) for i, s in sets.items() if i in gone}
            assert all(v > 0.4 for v in best.values())
            near = [(a, b) for a in kept & set(sets) for b in kept & set(sets) if a < b and jaccard(sets[a], sets[b]) >= 0.65]
            assert len(near) <= 0.1 * max(1, len(gone))
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert gone == {i for i, _, _ in contaminated(sorted(before.items()), items, 5, 0.6)}
        docs = got


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "bin_id"]
    assert rows.count() > 50


def fixture(spark, folder, rows):
    """Tables with columns that have the names which stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, Row2 string, keep string, id long, label string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows[:1]] + [(None, None, None)] * bool(rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "the quick brown fox jumps over the lazy dog today"), (None, None), (3, "")] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    more = (100, 7, "a", "b", 9, "c")
    prose = " ".join(f"word{k}" for k in range(300))
    rows = [
        (1, prose, "en", "s", *more), (2, prose, None, None, *more), (2, prose, "en", "s", *more), (3, None, None, None, *[None] * 6),
        (None, "", "en", "s", *more), (None, None, "en", None, *more), (4, prose + " tail", "en", "s", *more), (5, "solo", "en", "s", *more),
        (6, "ah The quick brown fox jumps over the lazy dog today!", "en", "s", *more), (7, "very long " * 200_000, "en", "s", *more),
    ]
    folder = fixture(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        got.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        assert docs.count() >= 3, name
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(str(i) for i, _ in kept) == ["1", "3", "5", "7", "None", "None"]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in packed) == 300 + 1 + 400_000


def test_empty_tables(spark, tmp_path):
    folder = fixture(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
