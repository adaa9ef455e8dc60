import random
import re

import numpy as np
import pytest

from lexmill.operators import bloom, enumerate as ids, layout, match, pairs, profile
from lexmill.sources import text as source
from lexmill.sources.patterns import Pattern, parse_patterns, select_patterns


def test_pattern_language():
    text = '# words\n"foo"i -> "x"\n"*bar" "baz*" -> unquoted\n"a\\"b*" \\\n -> "y" -> "z"\n"foo"\n"last\\*"'
    got = [(p.idx, p.pattern, p.ci, p.left, p.right, p.label) for p in parse_patterns(text)]
    assert got == [(0, "foo", False, False, False, None), (1, "baz", False, False, True, None), (2, 'a"b', False, False, True, "z"), (3, "last*", False, False, False, None)]
    assert [p.idx for p in select_patterns(parse_patterns(text), lambda p: p.right)] == [1, 2]
    for bad in ('"open', '"two\nlines"', "", "no patterns", '"*"'):
        with pytest.raises(ValueError):
            parse_patterns(bad)


def slow_count(p, text, wide):
    """Every place, by hand."""
    seps = set(map(chr, range(0x23))) | set("'(),-.:;?`")
    sep = lambda c: c in seps or (wide and ord(c) > 127)
    fold = (lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)) if p.ci else (lambda s: s)
    n, w = 0, p.pattern
    for i in range(len(text) - len(w) + 1):
        if fold(text[i : i + len(w)]) == fold(w):
            n += (p.left or i == 0 or sep(text[i - 1])) and (p.right or i + len(w) == len(text) or sep(text[i + len(w)]))
    return n


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("expressions", [0, 50])
def test_counts_equal_the_rule(spark, wide, expressions):
    r = random.Random(3)
    patterns = parse_patterns('"ab"\n"*a*"\n"aa*"i\n"*ba"\n"a b"\n"é"\n"A\\\\E"\n"aba"i -> "x"')
    texts = ["".join(r.choices(["a", "b", "A", " ", "é", ".", "\n", "#"], k=r.randrange(25))) for _ in range(80)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.idx): x.n for x in match.match_counts(docs, patterns, non_ascii_wordsep=wide, expressions=expressions).collect()}
    want = {(d, p.idx): n for d, t in enumerate(texts) for p in patterns if (n := slow_count(p, t or "", wide))}
    assert got == want


def test_report_scan_and_edges(spark):
    patterns = parse_patterns('"foo" -> "x"\n"x"\n"bar" -> "x"\n"foo bar"')
    docs = spark.createDataFrame([(1, "foo bar x"), (2, "foobar"), (3, None), (4, "a\\Eb" * 3)], "doc_id long, text string")
    report = {(r.doc_id, r.label, r.n, r.first_idx) for r in match.match_report(docs, patterns).collect()}
    assert report == {(1, "x", 2, 0), (1, "x", 1, 1), (1, "foo bar", 1, 3)}
    assert {r.doc_id for r in match.match_report(docs, patterns, invert=True).collect()} == {2, 3, 4}
    assert match.match_report(docs, patterns, invert=True, include_matches=True).count() == 6
    scan = {(r.pattern, r.n) for r in match.match_counts(docs, patterns, mode="scan").collect()}
    assert scan == {("foo bar", 1), ("x", 1)}
    assert match.match_counts(docs.limit(0), patterns).count() == 0
    odd = parse_patterns('"*\\\\E*"')
    odd[0] = odd[0].__class__(0, "\\E", False, True, True)
    assert match.match_counts(docs, odd).select("n").collect() == [(3,)]
    with pytest.raises(ValueError):
        match.match_counts(docs, patterns, mode="other")


def test_ids_are_stable(spark):
    rows = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (2, 0, "c"), (2, 1, None)], "d long, p int, term string")
    got, state = ids.enumerate_terms(rows.filter("d = 1"), ["d", "p"])
    assert [(r.p, r.id) for r in got.orderBy("p").collect()] == [(0, 1), (1, 2), (2, 1)]
    again, state2 = ids.enumerate_terms(rows, ["d", "p"], state=state)
    assert {(r.term, r.id) for r in again.collect()} == {("b", 1), ("a", 2), ("c", 3), (None, 0)}
    _, same = ids.enumerate_terms(rows, ["d", "p"], state=state2, extend=False)
    assert same.count() == 3
    none, _ = ids.enumerate_terms(rows, ["d", "p"], extend=False)
    assert {r.id for r in none.collect()} == {0}
    assert ids.enumerate_terms(rows.limit(0), ["d", "p"])[0].count() == 0
    assert [tuple(r) for r in ids.distinct_ids(rows).orderBy("id").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_bloom(spark):
    p = bloom.bloom_params("1K", "1%")
    assert p.size % bloom.PAGE == 0 and p.capacity == 1000
    assert bloom.bloom_params().k == 11 and bloom.bloom_params().size == 2 << 20
    assert bloom.bloom_params(size="1M", capacity=10**5).p < 1e-10
    df = spark.range(1000).selectExpr("CAST(id AS string) AS k")
    f = bloom.bloom_build(df, "k", p)
    assert f.count == 1000 and bloom.bloom_has(df, "k", f).count() == 1000
    other = spark.range(1000, 6000).selectExpr("CAST(id AS string) AS k").union(spark.sql("SELECT CAST(NULL AS string)"))
    hits = bloom.bloom_has(other, "k", f).count()
    assert hits < 150
    assert bloom.bloom_has(other, "k", f, limit=0).count() == hits
    both = bloom.bloom_add(f, other, "k")
    assert both.count == 6000 - hits and bloom.bloom_has(other, "k", both).count() == 5000
    rate = bloom.bloom_hit_rate(df, "k", both).first()
    assert (rate.hits, rate.total, rate.pct) == (1000, 1000, 100.0)
    assert bloom.bloom_hit_rate(df.limit(0), "k", both).first()[1:] == (0, None)
    with pytest.raises(ValueError):
        bloom.bloom_merge(f, bloom.bloom_build(df, "k", bloom.bloom_params("9K", "1%")))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_contained_lines_equal_brute_force(spark, limit):
    r = random.Random(4)
    lines = ["".join(r.choices("abé", k=r.randrange(14))) for _ in range(120)] + ["longer line " * 3, "er line lo", None, ""]
    base = "".join(r.choices("abcdefg é", k=400))
    for _ in range(80):
        i = r.randrange(len(base))
        lines.append(base[i : i + r.choice([7, 8, 9, 15, 16, 17, 31, 40, 64, 100])])
    df = spark.createDataFrame(list(enumerate(lines)), "k long, line string")
    got = {(x.line, x["first"].k) for x in pairs.drop_infixes(df, ["k"], limit=limit).collect()}
    kept = {a for a in lines if a and not any(b and a != b and a in b for b in lines)}
    assert got == {(a, lines.index(a)) for a in kept}
    assert pairs.drop_infixes(df.limit(0), ["k"]).count() == 0


def test_lines_of_few_words_send_little():
    """Lines that share their grams but not their first halves meet at no place: what is sent doesn't grow with pairs of lines."""
    import pyarrow as pa

    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=9)) for _ in range(20)]
    lines = pa.array(sorted({" ".join(r.choices(words, k=r.randrange(8, 40))) for _ in range(3000)} | {"z" * 3000}))
    kind, key, n = pairs.line_keys(lines)
    assert ((kind <= n) & (n < 2 * kind)).all()
    held = np.zeros(1 << 17, np.uint8)
    for k in range(pairs.FILTER_HASHES):
        at = pairs._place(key, k, 20)
        np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    none = np.zeros(1 << 17, np.uint8)
    sent = [len(s) for _, _, out in pairs.snippets(lines, sorted(set(kind.tolist())), held, none) for s in out]
    assert sum(sent) < 0.2 * n.sum()


def test_distance_matrix_leaves_out_blank_lines(spark):
    a = spark.createDataFrame([("  kitten",), (" \t",)], "line string")
    b = spark.createDataFrame([("sitting",), ("",), ("kit ",)], "line string")
    got = {tuple(r) for r in pairs.distance_matrix(a, b).collect()}
    assert got == {("kitten", "sitting", 3), ("kitten", "kit ", 3)}


def test_unwrap():
    long = "x" * 70
    assert layout.unwrapped([f" {long}", " and more.", "", "short"]) == [f"{long} and more.", "", "short"]
    assert layout.unwrapped([long, "    indented ", long, "y" * 81 + " ", "z"]) == [f"{long} ", "    indented ", f"{long} ", "y" * 81 + " ", "z"]
    assert layout.unwrapped([long]) == [f"{long} "]
    assert layout.text_lines("a\n\nb\n") == ["a", "", "b"] and layout.text_lines("a\nb") == ["a", "b"] and layout.text_lines(None) == []


def test_columns():
    lines = ["ID   NAME        PRICE ", "     some thing  1.0", "A1   other       20.5  "]
    assert layout.column_fields(lines) == [["ID", "NAME", "PRICE"], ["", "some thing", "1.0"], ["A1", "other", "20.5"]]
    assert layout.column_fields(["a  b c", "d  e  f"], mode="global") == [["a", "b", "c"], ["d", "e", "f"]]
    assert layout.column_fields([]) == [] and layout.column_fields([""]) == [[""]]
    assert layout.gaps("a  b ", " ") == [(1, 3)]
    assert layout.common_gaps([(1, 4)], [(2, 5)]) == [(2, 4)] and layout.common_gaps([], [(2, 5)]) == [(2, 5)]
    with pytest.raises(ValueError):
        layout.column_fields(["a"], mode="other")


def test_document_frequencies_of_texts(spark):
    from lexmill.operators import terms

    df = spark.createDataFrame([(1, "a a b"), (2, "a c"), (2, "c d"), (2, "c d"), (None, "e a"), (3, None)], "doc_id long, text string")
    got = terms.doc_freq_of(df)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in terms.doc_freq(terms.terms(df)).collect()} == {("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 0)}
    plan = terms.doc_freq_of(df.filter("doc_id < 2"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # no pairs of term and document


def test_rendered_texts_are_local_to_a_row(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c, d!"), (2, "!"), (3, None)], "doc_id long, text string")
    got = source.render_texts(df)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a\nb\n\f\n"), (1, "c\nd\n\f\n")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_ngrams_are_cut_by_one_pattern(spark):
    from lexmill.operators import terms

    df = spark.createDataFrame([(1, "a b, c a b"), (2, "d"), (3, None), (4, "")], "doc_id long, text string")
    for n, want in ((1, ["a", "b", "c", "a", "b", "d"]), (2, ["a b", "b c", "c a", "a b"]), (5, ["a b c a b"]), (6, [])):
        got = terms.ngrams(df, n)
        assert [r.ngram for r in got.orderBy("doc_id", "pos").collect()] == want
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_taken_apart_in_slices():
    import pyarrow as pa

    from lexmill.runtime import in_slices

    seen = []
    run = lambda a, b: seen.append(len(a)) or pa.array([(x or "") + (y or "") for x, y in zip(a.to_pylist(), b.to_pylist())])
    a, b = pa.array(["x" * 40, None, "y", "z" * 500, ""]), pa.array([None, "é", "", "q", "w"])
    want = [(x or "") + (y or "") for x, y in zip(a.to_pylist(), b.to_pylist())]
    assert in_slices(run, a, b, limit=50).to_pylist() == want and seen == [3, 1, 1]
    assert in_slices(run, a[1:], b[1:]).to_pylist() == want[1:] and len(in_slices(run, a[:0], b[:0])) == 0


def test_pages_lines_and_output(spark):
    docs = spark.createDataFrame([(1, "\fone\f\ntwo\f\f"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.page_no, r.text) for r in layout.pages(docs).collect()] == [(2, "one"), (3, "two")]
    assert layout.pages(docs, keep_empty=True).count() == 6
    assert layout.unescaped("\\f\\x") == "\f\\x"
    piped = source.pipe_pages(layout.pages(docs), ["tr", "a-z", "A-Z"])
    assert [r.text for r in piped.collect()] == ["ONE", "TWO"]
    got = source.lines(spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, None)], "doc_id long, text string")).collect()
    assert [(r.line_no, r.line) for r in got] == [(1, "a"), (2, ""), (3, "b")]
    assert layout.unwrap(docs).filter("text IS NULL").count() == 1
    fields = layout.split_columns(spark.createDataFrame([(1, "a  b\nc  d"), (2, None)], "doc_id long, text string"))
    assert [r.line for r in layout.joined_fields(fields).collect()] == ["a\tb", "c\td"]
    report = spark.createDataFrame([("x", 2, "d")], "label string, n long, doc_id string")
    assert source.render_matches(report).first()[0] == "x\t2\td" and source.render_matches(report, False).first()[0] == "x\td"
    far = spark.createDataFrame([("a", "b", 1000)], "a string, b string, d int")
    assert source.render_distances(far).first()[0] == "a\tb\t+"


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "p.pat").write_text('"x" -> "y"\n')
    assert source.documents(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo\n"
    assert bytes(source.raw_documents(spark, str(tmp_path / "a.txt")).first().content) == b"one\ntwo\n"
    assert source.from_text(spark, "z").first().doc_id == source.STDIN
    from lexmill.sources.patterns import read_patterns

    assert read_patterns(spark, str(tmp_path / "p.pat"))[0].label == "y"


def test_profile(spark):
    df = spark.createDataFrame([("abAB c1de", ), (None,)], "text string")
    got = {(r.n, r.gram, r.cnt) for r in profile.letter_profile(df).collect()}
    assert got == {(2, "ab", 1), (2, "bA", 1), (2, "AB", 1), (2, "de", 1), (3, "abA", 1), (3, "bAB", 1)}
    assert {r.bucket for r in profile.letter_profile(df).filter("lower(gram) = 'ab'").collect()} == {(97 * 32 + 98) % 1024, (65 * 32 + 66) % 1024}


def test_state_is_kept(spark, tmp_path):
    from lexmill.sources import state

    path = str(tmp_path / "dict")
    assert state.load_dictionary(spark, path).count() == 0
    rows = spark.createDataFrame([(1, "b"), (2, "a")], "k long, term string")
    _, held = ids.enumerate_terms(rows, ["k"], state=state.load_dictionary(spark, path))
    assert state.save_dictionary(held, path) and not state.save_dictionary(held, path)
    more = rows.union(spark.createDataFrame([(0, "c")], "k long, term string"))
    _, grown = ids.enumerate_terms(more, ["k"], state=state.load_dictionary(spark, path))
    assert state.save_dictionary(grown, path)
    assert {tuple(r) for r in state.load_dictionary(spark, path).collect()} == {("b", 1), ("a", 2), ("c", 3)}
    f = bloom.bloom_build(rows, "term", bloom.bloom_params("1K", "1%"))
    with pytest.raises(ValueError):
        state.load_bloom(spark, str(tmp_path / "bloom"))
    state.save_bloom(f, str(tmp_path / "bloom"))
    again = state.load_bloom(spark, str(tmp_path / "bloom"))
    assert again.params == f.params and again.count == 2 and bloom.bloom_has(rows, "term", again).count() == 2


def test_bloom_queries_size_their_filters_by_the_terms(spark, tmp_path, monkeypatch):
    from lexmill.plans import matching

    spark.createDataFrame([(1, "a b c d"), (2, "c d e")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    asked, make = [], bloom.bloom_params
    monkeypatch.setattr(bloom, "bloom_params", lambda **how: asked.append(how["capacity"]) or make(**how))
    d = str(tmp_path)
    assert [r.term for r in matching.f13_bloom_has(spark, d).collect()] == ["e"]
    assert [r.term for r in matching.j6_bloom_join_probe(spark, d).collect()] == ["e"]
    assert matching.a10_bloom_hit_rate(spark, d).first().hits == 1
    assert tuple(matching.a6_bloom_merge(spark, d).first()) == (30, 7)
    assert asked == [5, 5, 5, 7]


def test_first_rows_are_found_by_hashing(spark, monkeypatch):
    rows = [(d, p, f"t{(d * 7 + p * 3) % 11}") for d in range(-6, 6) for p in range(9)]
    far = [(1 << 50, 0, "far"), (None, 1, "t3"), (2, 1 << 25, "late"), (1 << 50, 1, "t4")]
    for extra in ([], far[:1], far[1:2], far[2:3], far):
        df = spark.createDataFrame(rows + extra, "d long, p int, term string")
        key = lambda r: tuple((x is not None, x or 0) for x in r[:2])
        want = {t: k for k, t in enumerate(dict.fromkeys(r[2] for r in sorted(rows + extra, key=key)), 1)}
        assert {r.term: r.id for r in ids.extend_state(df, ["d", "p"]).collect()} == want
    planned = []
    monkeypatch.setattr(ids, "numbered", lambda df, *_: planned.append(df._jdf.queryExecution().executedPlan().toString()) or df.withColumn("id", df["n"]))
    ids.extend_state(spark.createDataFrame(rows, "d long, p int, term string"), ["d", "p"])
    assert len(planned) == 1 and "SortAggregate" not in planned[0]


def test_most_rows_are_looked_up_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ids, "BROADCAST_BYTES", 400)
    rows = [(k, f"w{n:02}") for n in range(40) for k in range(n * n * 10, n * n * 10 + (40 - n) * 2)]
    df = spark.createDataFrame(rows, "k int, term string")
    counts = df.groupBy("term").count().withColumnRenamed("count", "n")
    monkeypatch.setattr(ids, "SHARE", 1.0)
    often = {r.term for r in ids._frequent(counts).collect()}
    assert 5 <= len(often) <= 400 // 27 and often == {f"w{n:02}" for n in range(len(often))}
    got, state = ids.enumerate_terms(df, ["k"])
    known = {r.term: r.id for r in state.collect()}
    assert sorted(tuple(r) for r in got.select("k", "term", "id").collect()) == sorted((k, t, known[t]) for k, t in rows)
    monkeypatch.setattr(ids, "SHARE", 1e-9)
    assert ids._frequent(counts).count() == 40


def test_whole_words_are_counted_row_by_row(spark):
    texts = ["The the, the;THE", None, "", "été the été! x" * 3, "nothing", "a\x00the\"the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = [Pattern(5, "the"), Pattern(3, "THE", True), Pattern(9, "the", True), Pattern(4, "été"), Pattern(7, "absent"), Pattern(8, "the")]
    for wide in (False, True):
        got = match.match_counts(docs, patterns, expressions=0, non_ascii_wordsep=wide)
        want = {(d, p.idx): n for d, t in enumerate(texts) for p in patterns if (n := slow_count(p, t or "", wide))}
        assert {(r.doc_id, r.idx): r.n for r in got.collect()} == want and (0, 9) in want
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_ids_are_rendered_without_another_count_of_the_rows(spark, monkeypatch):
    from lexmill.operators import terms

    monkeypatch.setattr(ids, "BROADCAST_BYTES", 60)
    monkeypatch.setattr(ids, "cut", None)
    df = terms.terms(spark.createDataFrame([(2, "c a d"), (1, "a a b a"), (3, None)], "doc_id long, text string"))
    got, _ = ids.enumerate_terms(df, ["doc_id", "pos"])
    values = {(r.doc_id, r.pos): r.value for r in got.select("doc_id", "pos", source.render_id().alias("value")).collect()}
    assert values == {(1, 0): "1", (1, 1): "1", (1, 2): "2", (1, 3): "1", (2, 0): "3", (2, 1): "1", (2, 2): "4"}


def test_only_seldom_terms_and_their_entries_are_shuffled_to_look_up_ids(spark, monkeypatch):
    monkeypatch.setattr(ids, "BROADCAST_BYTES", 60)
    monkeypatch.setattr(ids, "SHARE", 0.25)
    rows = [(k, None if k % 4 == 3 else "hot" if k % 2 else f"t{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "k int, term string")
    want = {t: k for k, t in enumerate(dict.fromkeys(t for _, t in rows if t), 1)} | {None: 0}
    got, state = ids.enumerate_terms(df, ["k"])
    again, _ = ids.enumerate_terms(df, ["k"], state=state, extend=False)
    for looked in (got, again):
        assert sorted((r.k, r.id) for r in looked.collect()) == [(k, want[t]) for k, t in rows]
        plan = looked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 2
    first = state.filter("id > 5")
    some, _ = ids.enumerate_terms(df, ["k"], state=first, extend=False)
    assert sorted((r.k, r.id) for r in some.collect()) == [(k, want[t] if want[t] > 5 else 0) for k, t in rows]


def test_rows_to_number_carry_no_column_for_what_fits(spark, monkeypatch):
    rows = [(-(1 << 39), 0, "least"), (1, 0, "b"), (1, 1, "a"), (None, 5, "none"), (2, 0, "a")]
    planned = []
    whole = ids.numbered
    monkeypatch.setattr(ids, "numbered", lambda df, *how: planned.append(df.columns) or whole(df, *how))
    for some, passes in ((rows, 2), (rows[1:3], 1), (rows[:1], 2), (rows[3:4], 2)):
        planned.clear()
        got = ids.extend_state(spark.createDataFrame(some, "d long, p int, term string"), ["d", "p"])
        key = lambda r: tuple((x is not None, x or 0) for x in r[:2])
        assert {r.term: r.id for r in got.collect()} == {t: k for k, t in enumerate(dict.fromkeys(r[2] for r in sorted(some, key=key)), 1)}
        assert planned == [["term", "first", "n"]] * passes
    edge = spark.createDataFrame([(-(1 << 63), "x"), (5, "y"), (None, "z")], "d long, term string")
    assert {r.term: r.id for r in ids.extend_state(edge, ["d"]).collect()} == {"z": 1, "x": 2, "y": 3}
