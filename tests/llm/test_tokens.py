import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 33), st.lists(st.integers(0, 2**33 - 1), max_size=300))
def test_bits_round_trip(bits, ids):
    v = np.array(ids, np.uint64) & np.uint64((1 << bits) - 1)
    words = tokens.pack_bits(v, bits)
    assert len(words) == -(-len(v) // 64) * bits
    assert (tokens.unpack_bits(words, bits)[: len(v)] == v).all()


def test_words_are_what_shifting_one_by_one_gives():
    v = [5, 30000, 1, 2, 32767] * 30
    whole = sum(x << (15 * k) for k, x in enumerate(v))
    assert tokens.pack_bits(np.array(v), 15).astype("<u8").tobytes().rstrip(b"\0") == whole.to_bytes(2000, "little").rstrip(b"\0")


@pytest.mark.parametrize("n, bits", [(2, 1), (32000, 15), (49408, 16), (65536, 16), (65537, 17), (1, 1)])
def test_minimum_bits(n, bits):
    assert tokens.bits_for(n) == bits


def test_random_access_and_file_form():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 32000, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 500, 0, 9)]
    s = tokens.Shard.pack([1, None, 3, 4, 5, 6, 7, 8], docs, 15, block=128)
    s = tokens.Shard.from_bytes(s.to_bytes())
    flat = np.concatenate(docs)
    assert s.doc_ids[1] is None and s.n_tokens == len(flat)
    for k, d in enumerate(docs):
        assert (s.document(k) == d).all()
    for a, b in [(0, 1), (127, 129), (100, 600), (650, 10**6), (5, 5)]:
        assert (s.tokens(a, b) == flat[a:b]).all()
    with pytest.raises(ValueError):
        tokens.Shard.pack([1], [np.array([32768], np.uint32)], 15)


def test_documents_round_trip(spark, tmp_path):
    rows = [(1, "Hello, wörld! <|endoftext|> 日本"), (2, None), (3, ""), (4, "a b " * 40000), (None, "x"), (1, "again"), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS bits", "'p' AS payload").coalesce(1)
    out = tokens.pack_tokens(df, VOCABULARY, shard_tokens=1000)
    code = tokens.encoder(open(VOCABULARY, "rb").read())
    got = []
    for r in out.collect():
        s = tokens.Shard(*r)
        assert r.bits == 16
        got += [(i, code.decode(s.document(k).tolist())) for k, i in enumerate(s.doc_ids)]
    assert sorted(got, key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    files = tokens.write_shards(out, str(tmp_path)).collect()
    assert sum(f.docs for f in files) == len(rows)
    back = [tokens.Shard.from_bytes(open(f.file, "rb").read()) for f in files]
    assert sorted(i or 0 for s in back for i in s.doc_ids) == sorted(i or 0 for i, _ in rows)
    assert tokens.pack_tokens(df.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("kind, ids", [("smallint", [3, None, 5]), ("int", [3, None, 5]), ("string", ["12", "7", None]), ("binary", [b"\xff", b"", None]), ("date", None)])
def test_ids_keep_their_type(spark, kind, ids):
    df = spark.createDataFrame([("3", "a b"), (None, "c"), ("5", None)], "k string, text string").coalesce(1)
    df = df.selectExpr("DATE'2020-01-01' AS doc_id", "text") if ids is None else spark.createDataFrame(list(zip(ids, ["a b", "c", None])), f"doc_id {'int' if kind == 'smallint' else kind}, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text").coalesce(1)
    out = tokens.pack_tokens(df, VOCABULARY)
    assert dict(out.dtypes)["doc_ids"] == f"array<{kind}>"
    s = tokens.Shard(*out.collect()[0])
    if ids is None:
        with pytest.raises(TypeError):
            s.to_bytes()
    else:
        assert [bytes(i) if isinstance(i, bytearray) else i for i in s.doc_ids] == ids
        s.doc_ids = ids
        assert tokens.Shard.from_bytes(s.to_bytes()).doc_ids == ids
