import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions.tokens import fast_tokens, normal_form, tokens
from lexmill.operators import terms

INNER = set("!#$%&'*+,./:=?@\\^_`|")


def model(text):
    """The rule by hand: characters one at a time."""
    out, cur = [], ""
    for ch in text + " ":
        if ch.isalnum():
            cur += ch
        elif cur and ch in INNER:
            cur += ch
        else:
            cur = cur.rstrip("".join(INNER))
            out += [cur] if cur else []
            cur = ""
    return out


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()[0]


def test_terms(spark):
    text = 'On 3.4.2001, 15:21 the K+S-share ("AT&T") rose. \\Foo\\ isn\'t_a{b}'
    assert one(spark, text, tokens("text")) == ["On", "3.4.2001", "15:21", "the", "K+S", "share", "AT&T", "rose", "Foo", "isn't_a", "b"]
    assert one(spark, None, tokens("text")) is None
    assert one(spark, "", tokens("text")) == []
    assert one(spark, "a�b", tokens("text")) == ["a", "b"]
    assert one(spark, "漢字 나 x𝒳", tokens("text", "compat")) == ["x"]
    assert len(one(spark, "漢字 나 x𝒳", tokens("text"))) == 3
    with pytest.raises(ValueError):
        tokens("text", "some")


def test_long_tokens_do_not_exhaust_the_stack(spark):
    text = "a." * 300_000 + "b"
    assert one(spark, text, F.size(tokens("text"))) == 1
    assert one(spark, text, F.size(fast_tokens("text"))) == 1


def test_terms_equal_the_model(spark):
    @settings(max_examples=30, deadline=None)
    @given(st.lists(st.text(alphabet="aB9é ß.,-+!'(\\|\n\f", max_size=30), min_size=1, max_size=20))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        assert [r[0] for r in df.select(tokens("text")).collect()] == [model(t) for t in texts]

    check()


def fast_model(text):
    n, a, p = r"[^\x00-\x7f]", "[A-Za-z0-9]", "[!#$%&'*+,./:=?@\\\\^_`|]"
    w = f"{n}*{a}(?:{a}|{n})*"
    return re.findall(f"{w}(?:{p}+{w})*", text)


def test_fast_terms_equal_the_model(spark):
    assert one(spark, "food bar café é.a x.é y", fast_tokens("text")) == ["food bar", "café", "a", "x", "y"]

    @settings(max_examples=30, deadline=None)
    @given(st.lists(st.text(alphabet="a9é.-( ß ", max_size=20), min_size=1, max_size=20))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        assert [r[0] for r in df.select(fast_tokens("text")).collect()] == [fast_model(t) for t in texts]

    check()


def test_normal_form(spark):
    got = one(spark, "Foo AG 1990 K+S Äpfel ÄÖ bAR", F.transform(F.split("text", " "), normal_form))
    assert got == ["foo", "AG", "1990", "K+S", "äpfel", "ÄÖ", "bar"]


def test_ngrams_stay_in_their_document(spark):
    df = spark.createDataFrame([(1, "a b c", 0), (2, "d", 0), (3, None, 0), (4, "e, f", 0)], "doc_id long, text string, Pos int")
    got = [(r.doc_id, r.pos, r.ngram) for r in terms.ngrams(df, 2).collect()]
    assert got == [(1, 0, "a b"), (1, 1, "b c"), (4, 0, "e f")]
    assert [r.ngram for r in terms.ngrams(df, 1).collect()] == list("abcdef")
    with pytest.raises(ValueError):
        terms.ngrams(df, 0)


def test_frequencies(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "a c")], "doc_id long, text string")
    rows = terms.terms(df)
    assert {tuple(r) for r in terms.term_freq(rows).collect()} == {("a", 3), ("b", 1), ("c", 1)}
    assert {tuple(r) for r in terms.doc_freq(rows).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    other = terms.term_freq(terms.terms(df.filter("doc_id = 1")))
    assert {tuple(r) for r in terms.tf_ratio(other, terms.term_freq(rows)).collect()} == {("a", 0.666667), ("b", 1.0)}
