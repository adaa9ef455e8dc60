import random

import pytest

from lexmill.functions.pairs import osa_batch, osa_distance, qgram_score, qgram_similarity
from lexmill.functions.stem import porter, stem


def osa(a, b, trnsp=1, subst=1, insdel=1):
    d = {(i, 0): i * insdel for i in range(len(a) + 1)} | {(0, j): j * insdel for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x = min(d[i - 1, j] + insdel, d[i, j - 1] + insdel, d[i - 1, j - 1] + (subst if a[i - 1] != b[j - 1] else 0))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, d[i - 2, j - 2] + trnsp)
            d[i, j] = x
    return d[len(a), len(b)]


@pytest.mark.parametrize("weights", [(1, 1, 1), (1, 2, 1), (3, 2, 1)])
def test_distances_equal_the_table(weights):
    r = random.Random(1)
    words = ["", "kitten", "sitting", "ca", "abc", "été", *("".join(r.choices("abcd", k=r.randrange(12))) for _ in range(60))]
    a, b = [r.choice(words).encode() for _ in range(500)], [r.choice(words).encode() for _ in range(500)]
    assert osa_batch(a, b, *weights).tolist() == [osa(x, y, *weights) for x, y in zip(a, b)]


def test_distance_column(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("ab", "ba"), (None, "x"), ("", ""), ("a", "b" * 600)], "a string, b string")
    assert [r[0] for r in df.select(osa_distance("a", "b")).collect()] == [3, 1, None, 0, 600]
    assert [r[0] for r in df.select(osa_distance("a", "b", max_len=511)).collect()] == [3, 1, None, 0, None]
    assert df.limit(0).select(osa_distance("a", "b")).count() == 0


def slow_qgram(a, b):
    fold = {ord(c): k for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1)} | {ord(c): k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1)}
    fold |= {ord(c): ord(x) - 64 for c, x in zip("012456789", "OIZASGTBQ")} | {ord("3"): 27, 32: 28, 45: 28, 95: 28}

    def h2(s):
        code = [0 if c < 32 or c >= 128 else c - 64 if c >= 96 else c - 32 for c in s[:2]]
        return code[0] << 4 ^ code[1]

    def h5(s):
        out = 0
        for c in [fold[c] for c in s if c in fold][:5]:
            out = out << 3 ^ c
        return out

    least = min(len(a), len(b))
    if least < 2:
        return 0.0
    q, h = (2, h2) if least < 5 else (5, h5)
    mine = {h(a[i:]) for i in range(len(a) - q + 1)}
    return sum(h(b[i:]) in mine for i in range(len(b) - q + 1)) / (least - q + 1)


def test_qgram_scores_equal_the_rule(spark):
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choices("abAB 01_-é\t", k=r.randrange(14))).encode() for _ in range(2))
        assert qgram_similarity(a, b) == pytest.approx(slow_qgram(a, b), rel=1e-6)
    df = spark.createDataFrame([("hello world", "HELLO WORLD"), ("a", "abc"), (None, "abc")], "a string, b string")
    assert [r[0] for r in df.select(qgram_score("a", "b")).collect()] == [1.0, 0.0, None]


def test_stems(spark):
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
        "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
        "relational": "relat", "conditional": "condit", "digitizer": "digit", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv",
        "adjustable": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate", "cease": "ceas", "is": "is", "As": "as", "geology": "geologi", "archaeology": "archaeolog",
        "possibly": "possibl", "Running": "run", "": "",
    }
    assert {w: porter(w) for w in known} == known
    df = spark.createDataFrame([("cats",), (None,), ("cats",)], "w string")
    assert [r[0] for r in df.select(stem("w")).collect()] == ["cat", None, "cat"]


def test_qgram_scores_of_a_batch():
    import pyarrow as pa

    from lexmill.functions.pairs import qgram_batch

    r = random.Random(8)
    a, b = (["".join(r.choices("ab1 O0-é.", k=r.randrange(12))) for _ in range(300)] for _ in range(2))
    got = qgram_batch(pa.array(["skipped", *a])[1:], pa.array(b))
    assert got.tolist() == pytest.approx([slow_qgram(x.encode(), y.encode()) for x, y in zip(a, b)], rel=1e-6)
