import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import quality

SF = "/root/testdata/sf0.1"


def small_features(texts):
    return quality.features(pa.array(texts), [pa.array(["en"] * len(texts), pa.string())])


def test_linear_time_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.BUCKETS).astype(np.float32), rng.normal(size=(quality.BUCKETS, 4)).astype(np.float32))
    f = small_features(["one two three", "", None, "a b a b c " * 3])
    got = m.parts(f)[0]
    for d in range(4):
        words = f.words[f.ptr[d] : f.ptr[d + 1]]
        ids = np.concatenate([words, f.fields[d]])
        y = np.concatenate([np.full(len(words), 1 / np.sqrt(max(len(words), 1))), np.ones(f.fields.shape[1])])
        x = np.concatenate([y[: len(words)] ** quality.LINEAR, np.ones(f.fields.shape[1])])
        want = m.w0 + (m.w[ids] * x).sum()
        for i in range(len(ids)):
            for j in range(i):
                want += float(m.v[ids[i]] @ m.v[ids[j]]) * y[i] * y[j]
        assert got[d] == pytest.approx(want, rel=1e-3, abs=1e-2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.quality_scores(docs, labels, max_rows=2500)
    used = {r.id for r in labels.selectExpr("doc_id AS id").orderBy(quality.F.xxhash64("id"), "id").limit(2500).collect()}
    rows = [r for r in scored.join(labels, "doc_id").collect() if r.doc_id not in used]
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    low = [r for r in rows if r.quality == 0]
    assert len(good) > 500 and len(low) > 50
    assert sum(r.keep for r in good) >= 0.97 * len(good)
    assert sum(not r.keep for r in low) >= 0.9 * len(low)


def test_nulls_empties_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, score int, good string"
    long = "good words in a long text " * 40000
    rows = [(1, None, "en", "s", 1, "x"), (2, "", None, None, None, None), (3, "fine words here", "en", "s", 2, ""),
            (3, "fine words here", "en", "s", 2, ""), (None, "bad ### %%%", "en", "s", 3, ""), (4, long, "en", "s", 0, "")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (99, 0, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    kept = quality.keep_good(docs, labels, keep_at=0.0)
    assert kept.columns == docs.columns and kept.count() == 6
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {1.0}
