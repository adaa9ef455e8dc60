import random

import numpy as np
import pytest

from lexmill.llm import neardup

SCHEMA = "doc_id long, text string"


def shingle_set(text, n):
    w = (text or "").split()
    if not w:
        return None
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def corpus(seed, docs, vocab=3000):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(vocab)]
    out = []
    for i in range(docs):
        base = r.choices(words, k=r.choice([1, 2, 30, 200, 800]))
        out.append(base)
        for _ in range(r.choice([0, 0, 1, 3])):
            rate = r.choice([0.0, 0.01, 0.04, 0.08, 0.3])
            out.append([r.choice(words) if r.random() < rate else w for w in base])
    r.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_recall_and_precision_against_brute_force(spark):
    rows = corpus(1, 150)
    found = {r.doc_id: r.keep_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {i: shingle_set(t, neardup.N) for i, t in rows}
    root = lambda i: found.get(i, i)
    near = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= neardup.THRESHOLD]
    assert len(near) > 50
    assert sum(root(a) == root(b) for a, b in near) >= 0.9 * len(near)
    for i, k in found.items():
        assert k < i and root(k) == k
        assert max(jaccard(sets[i], sets[j]) for j in sets if j != i) > neardup.THRESHOLD - 0.2


@pytest.mark.parametrize("region", [4, 256])
def test_dense_regions_stay_whole(spark, monkeypatch, region):
    monkeypatch.setattr(neardup, "REGION", region)
    r = random.Random(5)
    base = [f"v{k}" for k in range(400)]
    rows = [(i, " ".join(w if r.random() > 0.01 else f"x{r.random()}" for w in base)) for i in range(300)]
    sign, _ = zip(*rows)
    h = neardup.split_words(neardup.pa.array([t for _, t in rows]))
    _, sig = neardup.signatures(h.hashes(), h.ptr, neardup.N)
    pairs = []
    for t in range(neardup.TREES):
        label = sig[:, t * neardup.DEPTH : (t + 1) * neardup.DEPTH]
        order = np.lexsort(label.T[::-1])
        a, b = neardup.links(np.full(300, t), label[order], sig[order].astype(np.uint8), 0.57)
        pairs.append((order[a], order[b]))
    child, root = neardup.contract(*(np.concatenate(p) for p in zip(*pairs)))
    assert len(child) == 299 and set(root) == {0}


def shared_passage(seed, docs, pairs, words=200, shared=120):
    """Documents with one passage and own words, J about 0.43; each of the first ``pairs`` has a copy with some words changed, J about 0.61."""
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(shared)]
    out = [passage + [f"d{i}x{k}" for k in range(words - shared)] for i in range(docs)]
    for i in range(pairs):
        out.append(passage + out[i][shared : shared + 32] + [f"c{i}x{k}" for k in range(words - shared - 32)])
    rows = [(i, " ".join(t)) for i, t in enumerate(out)]
    r.shuffle(rows)
    return rows


def test_isolated_pairs_in_dense_regions_are_compared():
    docs, pairs = 4000, 300
    texts = [t for _, t in sorted(shared_passage(3, docs, pairs))]
    w = neardup.split_words(neardup.pa.array(texts))
    _, sig = neardup.signatures(w.hashes(), w.ptr, neardup.N)
    found = set()
    for t in range(neardup.TREES):
        label = sig[:, t * neardup.DEPTH : (t + 1) * neardup.DEPTH]
        order = np.lexsort(label.T[::-1])
        a, b = neardup.links(np.full(len(order), t), label[order], sig[order].astype(np.uint8), 0.45)
        found |= set(zip(order[a].tolist(), order[b].tolist()))
    assert sum((i, docs + i) in found or (docs + i, i) in found for i in range(pairs)) >= 0.93 * pairs


def test_documents_below_the_threshold_dont_chain(spark):
    # J of 0.5 between any two
    rows = shared_passage(4, 600, 0, shared=134)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 0


def test_pairs_about_the_threshold_are_told_by_their_sets(spark):
    docs, pairs = 600, 60
    rows = shared_passage(5, docs, pairs)
    found = {(r.keep_id, r.doc_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(i, docs + i) for i in range(pairs)}
    assert found <= want and len(found) >= 0.9 * pairs


def test_blocks_of_a_dense_region_meet_each_other_but_those_of_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 8)
    r = np.random.default_rng(1)
    sig = r.integers(0, 1 << 32, (160, neardup.SLOTS), dtype=np.uint32)
    sig[:, : neardup.MIN_DEPTH] = 7  # tree 0 has one region
    sig[40:] = sig[40]  # a cluster, far larger than a block
    label, path = sig[:, : neardup.MIN_DEPTH], sig[:, : neardup.DEPTH]
    rows = [(0, label[i].tobytes(), path[i].tobytes(), i, sig[i].astype(np.uint8).tobytes()) for i in range(160)]
    rows += [(1, b"x" * 8, bytes(32), i, bytes([i]) * neardup.SLOTS) for i in range(5)]
    parts, made = neardup._parts(spark.createDataFrame(rows, "tree int, label binary, path binary, row long, low binary"), 0.9)
    assert {tuple(x) for x in made.collect()} == {(i, 40) for i in range(41, 160)}
    p = parts.orderBy("tree", "label", "part", "row").toPandas()
    assert p.groupby(["tree", "part"]).size().max() < 60
    labels = np.stack([np.frombuffer(x, np.uint32) for x in p.label])
    lows = np.zeros((len(p), neardup.SLOTS), np.uint8)
    a, b = neardup.links(p.tree.to_numpy(), labels, lows, 0.5, p.part.to_numpy(), p.side.to_numpy(), p.cluster.to_numpy())
    row, tree = p.row.to_numpy(), p.tree.to_numpy()
    got = {(int(tree[x]), *sorted((int(row[x]), int(row[y])))) for x, y in zip(a, b)}
    want = {(0, i, j) for j in range(160) for i in range(j) if i < 40} | {(1, i, j) for j in range(5) for i in range(j)}
    assert got == want
    # of the cluster's rows each meets the blocks of the others alone
    assert len(p[(p.tree == 0) & (p.row >= 40)]) == 120 * 5


def test_groups_depend_on_neither_partitions_nor_blocks(spark, monkeypatch):
    rows = corpus(7, 120) + [(1000 + i, t) for i, t in shared_passage(8, 150, 20)]
    r = random.Random(9)
    base = [f"v{k}" for k in range(300)]
    rows += [(2000 + i, " ".join(w if r.random() > 0.02 else f"x{r.random()}" for w in base)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in names}
    got = []
    try:
        for partitions, adaptive, region in ((1, "false", 4096), (200, "false", 4096), (8, "true", 8)):
            monkeypatch.setattr(neardup, "REGION", region)
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got.append(sorted(tuple(x) for x in neardup.near_duplicates(df).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got[0]) > 250 and all(g == got[0] for g in got)


def test_components_of_a_long_chain(spark):
    edges = [(i + 1, i) for i in range(60)] + [(101, 100), (105, 101), (105, 103)]
    df = spark.createDataFrame(edges, "child long, parent long")
    got = {r.child: r.root for r in neardup.components(df).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 103: 100, 105: 100}


def test_nulls_empties_ties_and_clashing_columns(spark):
    long = " ".join(f"z{k}" for k in range(50000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (6, long), (7, long + " end")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 4), (5, 4), (None, 4), (7, 6)], key=str)
    wide = df.selectExpr("doc_id", "text", "doc_id AS row", "1 AS sig", "2 AS keep")
    kept = neardup.drop_near_duplicates(wide)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.drop_near_duplicates(wide.limit(0)).count() == 0
