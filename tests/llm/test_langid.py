import itertools

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import langid
from lexmill.llm.text import split_words

DOCS = "/root/testdata/sf0.01/documents.parquet"


def chain_by_enumeration(e, transitions, start):
    """Posteriors by summing over all labellings."""
    n, k = e.shape
    p = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        s = start[path[0]] + sum(e[t, c] for t, c in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:]))
        for t, c in enumerate(path):
            p[t, c] += np.exp(s)
    return p / p.sum(axis=1, keepdims=True)


def test_forward_backward_is_exact_and_documents_do_not_touch():
    rng = np.random.default_rng(3)
    transitions, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = [1, 5, 2, 7, 1]
    e = rng.normal(size=(sum(lengths), 3))
    first = np.zeros(len(e), bool)
    at, expected = 0, []
    for n in lengths:
        first[at] = True
        expected.append(chain_by_enumeration(e[at : at + n], transitions, start))
        at += n
    got = langid.forward_backward(e, first, transitions, start)
    np.testing.assert_allclose(got, np.concatenate(expected), rtol=1e-9)
    p, _ = langid._chances(e[None, 1:6], transitions, start)
    np.testing.assert_allclose(p[0], expected[1], rtol=1e-9)


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.read.parquet(DOCS).filter("doc_id % 2 = 0")
    return langid.train(docs, max_docs=300, sequences=1500, epochs=3)


def test_held_out_documents_and_switches(spark, field):
    held = spark.read.parquet(DOCS).filter("doc_id % 2 = 1")
    got = held.select("doc_id", F_lang := "lang").join(
        langid.language_spans(held, field=field).withColumnRenamed("lang", "found"), "doc_id"
    ).collect()
    assert F_lang == "lang" and len(got) == held.count()
    long = [r for r in got if r.words >= 20]
    assert sum(r.lang == r.found for r in long) >= 0.95 * len(long)

    rows = [r for r in held.select("text", "lang").collect() if len(r.text.split()) > 60]
    rng = np.random.default_rng(5)
    texts, gold = [], []
    for _ in range(60):
        words, lab = [], []
        for _ in range(4):
            r = rows[rng.integers(len(rows))]
            w = split_words(pa.array([r.text]))
            a = int(rng.integers(0, len(w.starts) - 12))
            words += [w.word(a + j) for j in range(12)]
            lab += [r.lang] * 12
        texts.append(" ".join(words))
        gold.append(lab)
    spans = langid.label_batch(pa.array(texts), field)[3].to_pylist()
    right = total = 0
    for s, lab in zip(spans, gold):
        out = [x["lang"] for x in s for _ in range(x["end_word"] - x["start_word"])]
        assert len(out) == len(lab)
        right += sum(a == b for a, b in zip(out, lab))
        total += len(lab)
    assert right >= 0.85 * total


def test_edges(spark, field):
    schema = "doc_id long, text string, lang string, spans int"
    rows = [(1, None, "en", 1), (2, "", None, 2), (3, "?!", "en", 3), (None, "the and of", None, 4), (4, "the and of", "en", 5), (4, "the and of", "en", 5)]
    got = langid.language_spans(spark.createDataFrame(rows, schema), field=field).collect()
    assert [(r.doc_id, r.words) for r in got] == [(1, 0), (2, 0), (3, 0), (None, 3), (4, 3), (4, 3)]
    assert all(r.lang is None and r.chance is None and r.spans == [] for r in got[:3])
    assert got[3][1:] == got[4][1:] == got[5][1:]
    nothing = spark.createDataFrame([(1, "a b", None, 0)], schema)
    assert langid.language_spans(nothing).first()[1:] == (None, None, 0, [])
    assert langid.language_spans(spark.createDataFrame([], schema)).count() == 0
    one = langid.language_spans(spark.createDataFrame([(1, "a b c", "xx", 0)], schema), sequences=10).first()
    assert one.lang == "xx" and one.words == 3


def test_a_very_long_text(field):
    text = pa.array(["the of and " * 200_000, "le la les"])
    lang, _, words, spans = langid.label_batch(text, field)
    assert words.to_pylist() == [600_000, 3] and lang.to_pylist() == ["en", "fr"]
    assert spans.to_pylist()[0][0]["end_word"] == 600_000


def test_training_takes_long_texts_rare_languages_and_repeated_rows(spark):
    rows = [(i, " ".join(f"aa{(i * 7 + k * k) % 97}" for k in range(30000)), "aa") for i in range(3)]
    rows += [(i, " ".join(f"bb{(i * 5 + k * k) % 89}" for k in range(30000)), "bb") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.language_spans(df, sequences=200, epochs=2).collect()
    assert {r.doc_id: 0 for r in got} and sorted(r.lang for r in got) == ["aa"] * 3 + ["bb"] * 3
    # one document in a language of its own, among many of another
    many = [(i, f"xx{i} yy{i % 7} zz the and of to in", "en") for i in range(400)] + [(999, "kuq lorp mabd kuq senf", "qq")]
    some = langid.train(spark.createDataFrame(many, "doc_id long, text string, lang string"), max_docs=20, sequences=50, epochs=1)
    assert some.languages == ["en", "qq"]
    # one id over and over
    same = spark.createDataFrame([(1, "one two three", "en")] * 300 + [(1, f"four five {k}", "en") for k in range(200)], "doc_id long, text string, lang string")
    assert langid.train(same, max_docs=5, sequences=10, epochs=1) is not None


def test_windows_come_from_the_whole_text():
    text = " ".join(f"w{k}" for k in range(20000))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array(["x", "y"]), pa.array([text, "a b"])], ["order", "lang", "text"])
    out = next(iter(langid._windows(640, 32)(iter([batch])))).column("text").to_pylist()
    words = [int(w[1:]) for w in out[0].split()]
    assert len(words) == 640 and out[1] == "a b"
    assert min(words) < 5000 and max(words) > 15000
