import random
import re

from lexmill.llm import decontam

WORD = re.compile(r"[0-9a-zÀ-῿]+")


def brute(docs, items, n, threshold):
    out = []
    for di, dt in docs:
        dw = WORD.findall((dt or "").lower())
        for ii, it in items:
            iw = WORD.findall((it or "").lower())
            m = min(n, len(iw))
            if not m:
                continue
            want = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)}
            have = {tuple(dw[k : k + m]) for k in range(len(dw) - m + 1)}
            c = len(want & have) / len(want)
            if c >= threshold:
                out.append((di, ii, round(c, 9)))
    return sorted(out, key=str)


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 2, 4, 6, 12, 30, 90])))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "..."), (63, items[5][1]), (None, "alone here now")]
    docs = []
    for i in range(120):
        words = r.choices(vocab, k=r.choice([0, 3, 40, 400, 5000]))
        for _ in range(r.choice([0, 1, 2])):
            w = (r.choice(items)[1] or "").split()
            if w and r.random() < 0.5:
                w[r.randrange(len(w))] = "changed"
            at = r.randrange(len(words) + 1)
            words[at:at] = w
        docs.append((i, ", ".join(words).upper()))
    docs += [(200, None), (201, ""), (None, items[10][1]), (7, docs[7][1])]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def got(df):
    return sorted(((r.doc_id, r.item_id, round(r.containment, 9)) for r in df.collect()), key=str)


def test_against_brute_force_both_ways(spark):
    docs, items = corpus()
    d, b = frames(spark, docs, items)
    want = brute(docs, items, decontam.N, decontam.THRESHOLD)
    assert len(want) > 60
    for limit in (None, 0):
        found = got(decontam.contained_items(d, b, broadcast_bytes=limit))
        assert set(found) <= set(want)
        assert len(found) >= 0.97 * len(want)


def test_the_bins_grow_with_size_and_shrink_with_need():
    assert decontam.bins(10, 5) > decontam.bins(9, 5)
    assert decontam.bins(10, 2) > decontam.bins(10, 6)


def test_drop_keeps_columns_and_clean_rows(spark):
    docs = [(1, "one two three four five six", "x"), (2, "seven eight nine", None), (3, None, "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(1, "two three four five six")], "item_id long, text string")
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontam.drop_contaminated(d, b.limit(0)).count() == 3
    assert decontam.drop_contaminated(d.limit(0), b).count() == 0


def test_ids_of_any_type_and_very_long_texts(spark):
    long = " ".join(f"z{k}" for k in range(60000)) + " two three four five six " + "y " * 60000
    for kind, ids in (("int", [3, None]), ("smallint", [3, None]), ("string", ["x", None])):
        b = spark.createDataFrame([(str(i) if kind == "string" and i else i, "two three four five six") for i in ids], f"item_id {'string' if kind == 'string' else 'int'}, text string")
        b = b.selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text", "1 AS doc_id")
        d = spark.createDataFrame([(7, long, 0), (7, long, 0), (None, "none", 0)], "doc_id int, text string, item_id int").selectExpr("CAST(doc_id AS smallint) AS doc_id", "text", "item_id")
        for limit in (None, 0):
            out = decontam.contained_items(d, b, broadcast_bytes=limit)
            assert dict(out.dtypes) == {"doc_id": "smallint", "item_id": kind, "containment": "double"}
            assert got(out) == sorted([(7, i, 1.0) for i in ids for _ in range(2)], key=str)
            assert decontam.contained_items(d.limit(0), b, broadcast_bytes=limit).count() == 0
            assert decontam.contained_items(d, b.limit(0), broadcast_bytes=limit).count() == 0
