import random

import pyarrow as pa
import pytest

from lexmill.llm import repeats

SCHEMA = "doc_id long, text string"


def brute(rows, least):
    """{(place, word)} of the words that go, by looking up every window in all earlier documents."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, gone = set(), set()
    for k in order:
        w = (rows[k][1] or "").lower().split()
        windows = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        for i, x in enumerate(windows):
            if x in seen:
                gone |= {(rows[k][0], k, i + j) for j in range(least)}
        seen |= set(windows)
    return gone


def corpus(seed, docs=60):
    r = random.Random(seed)
    fresh = lambda n: r.choices([f"w{k}" for k in range(500)], k=n)
    passages = [fresh(r.choice([10, 19, 20, 21, 45, 120])) for _ in range(12)]
    out = []
    for i in range(docs):
        words = fresh(r.choice([0, 3, 30, 100]))
        for _ in range(r.choice([0, 1, 2, 3])):
            p = list(r.choice(passages))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "edited"
            if r.random() < 0.3:
                p = p[r.randrange(10) :]
            words += p + fresh(r.choice([0, 5, 40]))
        out.append((i, " ".join(words)))
    out += [(docs, out[3][1]), (docs + 1, out[3][1]), (docs + 2, "z " * 200), (docs + 3, "z " * 300), (docs + 4, None), (docs + 5, "")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,shard_words", [(1, 10**6), (2, 300), (3, 5000), (4, 50)])
def test_spans_are_those_of_brute_force(spark, seed, shard_words):
    rows = corpus(seed)
    least = 20
    got = repeats.repeated_spans(spark.createDataFrame(rows, SCHEMA), min_words=least, gram=6, shard_words=shard_words).collect()
    words = {(r.doc_id, w) for r in got for w in range(r.start_word, r.end_word)}
    expected = {(i, w) for i, _, w in brute(rows, least)}
    assert expected and words == expected
    spans = sorted((r.doc_id, r.start_word, r.end_word) for r in got)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))
    assert all(r.keep_id < r.doc_id for r in got)


def test_removed_text_and_what_stays(spark):
    passage = " ".join(f"P{k}," for k in range(60))
    rows = [(1, f"Été one. {passage} tail.", "a"), (2, f"Two: {passage}", "b"), (3, f"{passage} Three!", None), (4, "clean", "c"), (None, f"{passage}", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").coalesce(1)
    got = {r.doc_id: (r.text, r.row) for r in repeats.remove_repeated_spans(docs).collect()}
    assert got == {1: (rows[0][1], "a"), 2: ("Two: ", "b"), 3: ("Three!", None), 4: ("clean", "c"), None: ("", "d")}


def test_edges(spark):
    assert repeats.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repeats.remove_repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    inner = " ".join(f"a{k}" for k in range(60))
    within = spark.createDataFrame([(1, f"{inner} x {inner}"), (2, None), (3, " "), (4, "short")], SCHEMA)
    assert repeats.repeated_spans(within).count() == 0
    same = spark.createDataFrame([(7, inner), (7, inner)], SCHEMA)
    assert [tuple(r) for r in repeats.repeated_spans(same).collect()] == [(7, 0, 60, 7)]
    with pytest.raises(ValueError):
        repeats.repeated_spans(same, min_words=5, gram=6)


def test_a_phrase_in_many_surroundings_and_very_long_texts(spark, monkeypatch):
    # every document has one phrase that gives all windows about it their minimizer
    monkeypatch.setattr(repeats, "small", lambda df, *_: df)
    r = random.Random(6)
    phrase = [f"p{k}" for k in range(14)]
    words = lambda n: [f"w{r.randrange(40)}" for _ in range(n)]
    rows = []
    for i in range(120):
        left, right = r.choice([words(15), ["l"] * 15]), r.choice([words(15), ["r"] * 15])
        rows.append((i, " ".join(left + phrase + right)))
    long = [f"x{k}" for k in range(70000)]
    rows += [(500, " ".join(long)), (501, " ".join(words(100) + long[20000:60000]))]
    got = repeats.repeated_spans(spark.createDataFrame(rows, SCHEMA), min_words=20, gram=6, shard_words=400).collect()
    assert {(x.doc_id, w) for x in got for w in range(x.start_word, x.end_word)} == {(i, w) for i, _, w in brute(rows, 20)}


def test_the_query_marks_the_documents_that_a_look_up_of_all_windows_finds(spark):
    from lexmill.llm import queries
    from lexmill.llm.text import split_words

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    seen, want = set(), set()
    for r in rows:
        w = split_words(pa.array([r.text]))
        words = [w.word(k) for k in range(len(w.starts))]
        windows = {tuple(words[k : k + repeats.MIN_WORDS]) for k in range(len(words) - repeats.MIN_WORDS + 1)}
        if windows & seen:
            want.add(r.doc_id)
        seen |= windows
    got = {r.doc_id for r in queries.op6_substring_dedup(spark, sf).select("doc_id").distinct().collect()}
    assert len(want) > 50 and got == want
