from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexmill.llm import exact

SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = {}
    for i, t in rows:
        if t is not None:
            groups.setdefault(t, []).append(i)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda x: (x is None, x))
        out += [(i, ids[0]) for i in ids[1:]]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_nulls_empties_repeats_and_long(spark):
    long = "x" * 70000
    rows = [
        (1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, None), (5, ""), (6, ""),
        (7, long + "p"), (8, long + "q"), (9, long + "q"), (10, "é" * 40), (11, "é" * 40), (12, "é" * 39 + "e1"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(exact.exact_duplicates(df)) == brute(rows)
    assert exact.drop_exact_duplicates(df).count() == len(rows) - len(brute(rows))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 50), st.text("ab", max_size=9)), max_size=40))
def test_random_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(exact.exact_duplicates(df, first_digit=2, growth=2)) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame(
        [(1, "a", 5, "z"), (2, "a", None, "y"), (3, "b", 5, None)], "doc_id long, text string, row int, d string"
    )
    kept = exact.drop_exact_duplicates(wide)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert exact.drop_exact_duplicates(wide.limit(0)).count() == 0


def test_shuffle_path_gives_the_same(spark, monkeypatch):
    from lexmill.llm import runtime

    rows = [(i, f"text {i % 7}" * 30) for i in range(50)]
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    assert got(exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
