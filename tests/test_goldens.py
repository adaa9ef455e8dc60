"""Small cases with known results, of each command line's kind."""

import pytest

from lexmill.functions.pairs import osa_distance, qgram_score
from lexmill.functions.tokens import tokens
from lexmill.operators import bloom, layout, match, pairs, profile
from lexmill.operators import enumerate as ids
from lexmill.operators import terms as terms_
from lexmill.sources import text as source
from lexmill.sources.patterns import parse_patterns


def counts(spark, text, patterns, **how):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r.label: r.n for r in match.match_report(docs, parse_patterns(patterns), **how).collect()}


@pytest.mark.parametrize("line", ["is foo bar\n", "foo is bar\n"])
@pytest.mark.parametrize("how", [{}, {"expressions": 0}, {"expressions": 0, "words": False}, {"mode": "scan"}])
def test_every_line_of_a_text_of_many_buffers_counts(spark, line, how):
    assert counts(spark, line * 1500, '"foo" -> x\n"bar" -> y', **how) == {"foo": 1500, "bar": 1500}


@pytest.mark.parametrize("how", [{}, {"expressions": 0}])
def test_short_patterns_and_parts_of_words(spark, how):
    text = "The list is his island."
    assert [counts(spark, text, f'"{p}"', **how) for p in ("is*", "*is", "*is*", "is")] == [{"is": 2}, {"is": 2}, {"is": 4}, {"is": 1}]
    assert counts(spark, "A eG or EG is it a eg?", '"eg"i\n"a"i', **how) == {"eg": 3, "a": 2}
    assert counts(spark, "Der Verlust ist gigantisch.", '"verlust*"i -> "loss"', **how) == {"loss": 1}
    assert counts(spark, "w1 atilman w2", '"tilman"i', **how) == {} and counts(spark, "w1 atilman w2", '"*tilman"i', **how) == {"tilman": 1}
    assert counts(spark, "Der Verlust´ ist", '"Verlust"', **how) == {}
    assert counts(spark, "Der Verlust´ ist", '"Verlust"', non_ascii_wordsep=True, **how) == {"Verlust": 1}


def test_distance_matrix_and_scores(spark):
    a = spark.createDataFrame([("kitten",), ("heuristic",), ("orthogonal",)], "line string")
    b = spark.createDataFrame([("sitting",), ("algorithm",), ("rectangular",)], "line string")
    got = {(r.a, r.b): r.d for r in pairs.distance_matrix(a, b).collect()}
    names = [[r[0] for r in x.collect()] for x in (a, b)]
    assert [got[x, y] for x in names[0] for y in names[1]] == [3, 8, 9, 7, 7, 10, 8, 9, 8]
    row = spark.createDataFrame([("abcdef", "abcdef", 12)], "x string, y string, d int")
    assert row.select(qgram_score("x", "y").alias("s")).select(source.render_score("s")).first()[0] == "1.000000"
    assert row.select(osa_distance("x", "y")).first()[0] == 0


def test_terms_with_signs_inside(spark):
    text = "At K+S we're going out with AT&T, and Kloeckner+Co.KG. Vectron-Aktien: 21.12.2000 15:21"
    want = ["At", "K+S", "we're", "going", "out", "with", "AT&T", "and", "Kloeckner+Co.KG", "Vectron", "Aktien", "21.12.2000", "15:21"]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert df.select(tokens("text")).first()[0] == want
    two = [r.ngram for r in terms_.ngrams(df, 2).orderBy("pos").collect()]
    assert two[-1] == "21.12.2000 15:21" and len(two) == len(want) - 1


TABLE = [
    "CODE  MIC   NUMBER        FULL NAME             PRICE UNIT   ",
    "      ABCD  XX0000000001  SOMME GROUP 10/17      0.750  % ",
    "QQNJ  ABCD  XX0000000002  THE EQUITIES           0.090 EUR",
]


def test_columns_of_a_table(spark):
    df = spark.createDataFrame([(1, "\n".join(TABLE))], "doc_id long, text string")
    rows = [r.fields for r in layout.split_columns(df).orderBy("line_no").collect()]
    assert rows[0] == ["CODE", "MIC", "NUMBER", "FULL", "NAME", "PRICE", "UNIT"]
    assert rows[1] == ["", "ABCD", "XX0000000001", "SOMME GROUP 10/17", "0.750  %"]
    assert rows[2] == ["QQNJ", "ABCD", "XX0000000002", "THE EQUITIES", "0.090 EUR"]
    joined = layout.joined_fields(layout.split_columns(df), ";").orderBy("line_no").collect()
    assert joined[2].line == "QQNJ;ABCD;XX0000000002;THE EQUITIES;0.090 EUR"
    dots = spark.createDataFrame([(1, "a..b.c\nd..e.f")], "doc_id long, text string")
    assert [r.fields for r in layout.split_columns(dots, ".").orderBy("line_no").collect()] == [["a", "b", "c"], ["d", "e", "f"]]
    # in bytes the second column of the second line begins one place later
    wide = spark.createDataFrame([(1, "aa  bb\néé cc")], "doc_id long, text string")
    assert layout.split_columns(wide).orderBy("line_no").collect()[1].fields == ["éé", "cc"]
    assert layout.split_columns(wide, by_bytes=True).orderBy("line_no").collect()[0].fields == ["aa", "bb"]


def test_pages_go_through_a_command_and_back(spark):
    text = "\f\nb\na\n\f\n\f\nd\nc\n"
    docs = spark.createDataFrame([(1, text), (2, "y\nx\n")], "doc_id long, text string")
    out = source.joined_pages(source.pipe_pages(layout.pages(docs), ["sort"]))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "\f\na\nb\n\f\n\f\nc\nd\n", 2: "x\ny\n"}
    assert {r.doc_id: r.text for r in source.joined_pages(source.pipe_pages(layout.pages(docs), ["cat"])).collect()}[1] == text


def test_ids_of_a_suffix_or_of_the_reversed_input(spark):
    rows = [(i, t) for i, t in enumerate("a b c a d b e".split())]
    df = spark.createDataFrame(rows, "k int, term string")
    got, state = ids.enumerate_terms(df, ["k"])
    first = {r.k: r.id for r in got.collect()}
    assert [first[k] for k in range(7)] == [1, 2, 3, 1, 4, 2, 5]
    back = spark.createDataFrame([(10 - i, t) for i, t in rows], "k int, term string")
    again, same = ids.enumerate_terms(back, ["k"], state=state)
    assert {10 - r.k: r.id for r in again.collect()} == first and same.count() == 5
    assert {r.term: r.id for r in ids.enumerate_terms(df.filter("k > 4"), ["k"], state=state, extend=False)[0].collect()} == {"b": 2, "e": 5}


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_ids_are_looked_up_without_a_broadcast_dictionary(spark, monkeypatch, limit):
    monkeypatch.setattr(ids, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(ids, "SHARE", 0.2)
    rows = [(i, "hot" if i % 2 else f"t{i}") for i in range(60)] + [(99, None)]
    got, _ = ids.enumerate_terms(spark.createDataFrame(rows, "k int, term string"), ["k"])
    found = {r.k: r.id for r in got.collect()}
    assert len(found) == 61 and found[99] == 0 and {found[k] for k in range(1, 60, 2)} == {2} and found[0] == 1 and found[2] == 3


def test_rendered_lines(spark):
    f = bloom.bloom_build(spark.createDataFrame([("a",), ("b",)], "k string"), "k", bloom.bloom_params("1K", "1%"))
    probe = spark.createDataFrame([("a",), ("zz",), ("b",)], "k string")
    assert source.render_hits(bloom.bloom_hit_rate(probe, "k", f)).first()[0] == "hits\t<stdin>\t2/3\t66.67%"
    assert source.render_hits(bloom.bloom_hit_rate(probe.limit(0), "k", f)).first()[0] == "hits\t<stdin>\t0/0\t0.00%"
    lines = sorted(r[0] for r in source.render_profile(profile.letter_profile(spark.createDataFrame([("abab",)], "text string"))).collect())
    assert lines[0] == "2:082\t66.666667%\t ab" and lines[1] == "2:0a1\t33.333333%\t ba"


def test_order_of_results(spark):
    df = spark.createDataFrame([("b", 2.0), ("é", 2.0), ("a", 5.0), ("Z", 1.0)], "term string, ratio double")
    assert [r.term for r in terms_.in_order(df, "term").orderBy("place").collect()] == ["Z", "a", "b", "é"]
    assert [r.term for r in terms_.in_order(df, "ratio", "term", descending=True).orderBy("place").collect()] == ["a", "b", "é", "Z"]
    assert terms_.in_order(df.limit(0), "term").count() == 0
