import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import licenses
from lexmill.llm.automaton import SuffixAutomaton
from lexmill.llm.text import split_words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=12), max_size=4), st.text("abcd", max_size=20))
def test_matching_statistics_are_the_longest_suffixes(sequences, text):
    a = SuffixAutomaton()
    for s in sequences:
        a.add(s)
    runs = {s[i:j] for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for k, (_, n) in enumerate(a.matching(text)):
        assert n == max((m for m in range(k + 2) if not m or text[k + 1 - m : k + 1] in runs), default=0)


def brute_matches(doc, words, least):
    """(first word, first template word, words) of the equal runs that can't be made longer to either side."""
    out = set()
    for i in range(len(doc)):
        for j in range(len(words)):
            if i and j and doc[i - 1] == words[j - 1]:
                continue
            n = 0
            while i + n < len(doc) and j + n < len(words) and doc[i + n] == words[j + n]:
                n += 1
            if n >= least:
                out.add((i, j, n))
    return out


def test_streamed_matches_against_brute_force():
    r = random.Random(4)
    for size in (3, 5, 12):
        vocab = [f"w{k}" for k in range(size)]
        for _ in range(60):
            templates = [r.choices(vocab, k=r.randrange(3, 15)) for _ in range(4)]
            templates.append(templates[0][1:5] + templates[1])
            doc = r.choices([*vocab, "other"], k=40) + templates[1] + r.choices(vocab, k=3)
            t = licenses.Templates([(str(i), " ".join(x)) for i, x in enumerate(templates)], 3)
            got = t.matches(split_words(pa.array([" ".join(doc)])).hashes())
            for k, x in enumerate(templates):
                assert sorted(got.get(k, [])) == sorted(brute_matches(doc, x, 3))


def all_chains(matches, max_gap):
    """(start, end, covered) of every chain."""
    out = []

    def go_on(last, start, covered):
        d, t, n = last
        out.append((start, d + n, covered))
        for m in matches:
            if m[0] > d and m[1] > t and m[0] + m[2] > d + n and m[1] + m[2] > t + n and m[0] - d - n <= max_gap and m[1] - t - n <= max_gap:
                go_on(m, start, covered + m[2] - max(0, d + n - m[0], t + n - m[1]))

    for m in matches:
        go_on(m, m[0], m[2])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 12), st.integers(3, 6)), max_size=9, unique=True), st.integers(0, 6))
def test_chains_against_brute_force(matches, max_gap):
    every = all_chains(matches, max_gap)
    taken = []
    for start, end, covered in licenses.chains(matches, max_gap):
        free = [c for c in every if all(c[1] <= a or c[0] >= b for a, b in taken)]
        best = max(c[2] for c in free)
        assert covered == best and (start, end, covered) in free
        taken.append((start, end))
    assert all(any(m[0] < b and m[0] + m[2] > a for a, b in taken) for m in matches)


def test_chaining_stays_near_linear():
    def took(n):
        phrase = "released under the mit license here".split()
        h = split_words(pa.array([" ".join(phrase * n)])).hashes()
        t = licenses.Templates([("MIT", " ".join(phrase[:5])), ("MIT", licenses.TEMPLATES[1][1])])
        began = time.process_time()
        assert len(licenses.best_spans(licenses.spans(h, t, 0.6, 12))) == n
        return time.process_time() - began

    took(100)
    assert took(4000) < 16 * took(500) + 0.5


def found(df):
    return sorted((r.doc_id, r.license, r.start_word, r.end_word, round(r.coverage, 2)) for r in df.collect())


def test_spans_in_documents(spark):
    mit = licenses.TEMPLATES[0][1]
    words = mit.split()
    broken = " ".join(words[:40] + ["oddly", "added"] + words[40:70] + words[73:])
    rows = [
        (1, "intro text here. " + mit + " the end"), (2, "x " * 30000 + broken), (3, "Released under the MIT License."),
        (4, "under the same conditions as before, free of charge"), (5, None), (6, ""),
        (7, "Licensed under CC BY-NC 4.0. and again: licensed under cc by-nc 4.0"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS license")
    got = found(licenses.license_spans(df))
    n = len(split_words(pa.array([mit])).starts)
    assert got[0] == (1, "MIT", 3, 3 + n, 1.0)
    assert got[1][:3] == (2, "MIT", 30000) and got[1][4] > 0.9
    assert got[2:] == [(3, "MIT", 0, 5, 1.0), (7, "CC-BY-NC-4.0", 0, 7, 1.0), (7, "CC-BY-NC-4.0", 9, 16, 1.0)]
    assert found(licenses.license_spans(df, automaton_words=60)) == got
    assert licenses.license_spans(df.limit(0)).count() == 0
    assert licenses.license_spans(df, templates=[]).count() == 0
    twice = df.filter("doc_id = 3").union(df.filter("doc_id = 3"))
    assert len(found(licenses.license_spans(twice))) == 2


def test_every_template_is_found_once_and_whole(spark):
    rows = [(k, "before it stands this. " + t + ". after it, that") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    got = found(licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    want = [(k, name, 4, 4 + len(t.split()), 1.0) for k, (name, t) in enumerate(licenses.TEMPLATES)]
    assert got == want
    names = {}
    for name, t in licenses.TEMPLATES:  # none is a text twice over, none has two names
        w = t.split()
        assert w[: len(w) // 2] != w[len(w) // 2 :]
        assert names.setdefault(t, name) == name


GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public
License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"""


def test_standard_notices(spark):
    cases = [
        ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("CC-BY-ND-3.0", "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License."),
        ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("CC-BY-NC-SA-4.0", "licensed under CC BY-NC-SA 4.0"),
        ("GPL-3.0", GNU.format("program", "", 3)), ("AGPL-3.0", GNU.format("program", "Affero", 3)), ("GPL-2.0", GNU.format("program", "", 2)),
        ("LGPL-3.0", GNU.format("library", "Lesser", 3)), ("LGPL-2.1", GNU.format("library", "Lesser", 2.1)), ("LGPL-3.0", GNU.format("program", "Lesser", 3)),
        # a short notice that goes on as a longer template does, but not to its end
        ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"). See the file.'),
    ]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    assert [(x[0], x[1], x[4]) for x in found(licenses.license_spans(df))] == [(k, name, 1.0) for k, (name, _) in enumerate(cases)]


def test_what_is_added_costs_coverage(spark):
    rows = [(1, "This work is licensed under a Creative Commons Attribution-Frobnicate 4.0 International License.")]
    (got,) = licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got.license == "CC-BY-4.0" and got.coverage < 0.95
    with pytest.raises(ValueError):
        licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string"), templates=[("X", "one two")])


def test_chains_skip_gaps_but_not_too_long_ones():
    assert licenses.chains([(0, 0, 5), (7, 6, 5)], 3) == [(0, 12, 10)]
    assert licenses.chains([(0, 0, 5), (50, 6, 5)], 3) == [(0, 5, 5), (50, 55, 5)]
    assert licenses.chains([(0, 0, 5), (4, 4, 5)], 3) == [(0, 9, 9)]
    assert licenses.chains([(0, 0, 5), (5, 20, 9), (14, 6, 5)], 20) == [(0, 14, 14), (14, 19, 5)]
    assert np.array(licenses.chains([], 3)).size == 0
