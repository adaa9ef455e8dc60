"""Queries of terms, n-grams, frequencies, ids and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.tokens import term_hash
from ..operators import enumerate as ids
from ..operators import layout, profile, terms
from ..runtime import spread
from ..sources import text as source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


_INNER = r"!#$%&''*+,./:=?@\\^_`|"
TERM = rf"[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}{_INNER}]*[\p{{L}}\p{{N}}])?"
_FAST = rf"[^\x00-\x7f]*[A-Za-z0-9][A-Za-z0-9\x{{80}}-\x{{10ffff}}]*(?:[{_INNER}]+[^\x00-\x7f]*[A-Za-z0-9][A-Za-z0-9\x{{80}}-\x{{10ffff}}]*)*"


def _tokens(source: str, key: str, regex: str = TERM) -> str:
    return f"SELECT {key}, regexp_extract_all(text, '{regex}') AS t FROM {source}"


def _rows(source: str = "documents", key: str = "doc_id", regex: str = TERM) -> str:
    return f"SELECT {key}, unnest(t) AS term, CAST(unnest(range(len(t))) AS INTEGER) AS pos FROM ({_tokens(source, key, regex)}) AS x"


_NORMAL = r"CASE WHEN regexp_matches(term, '[\p{Ll}\p{Lm}\p{Lo}]') THEN lower(term) ELSE term END"
_ENUM = f"""
WITH rows AS ({_rows()}), firsts AS (SELECT term, min((doc_id, pos)) AS f FROM rows GROUP BY term),
dict AS (SELECT term, CAST(row_number() OVER (ORDER BY f) AS BIGINT) AS id FROM firsts)
"""


def t1_terms(spark, d):
    return terms.terms(docs(spark, d)).select("doc_id", "pos", "term")


def t1_terms_freq(spark, d):
    return terms.term_freq(terms.terms(docs(spark, d)))


#: Behind every text: ideographs, Hangul and letters beyond the basic plane, alone and inside words.
_WIDE_TAIL = " 漢字 abc한글def \U00010414x y\U00020000 z"


def _with_tail(spark, d):
    return docs(spark, d).withColumn("text", F.concat("text", F.lit(_WIDE_TAIL)))


def t1_terms_compat_freq(spark, d):
    return terms.term_freq(terms.terms(_with_tail(spark, d), unicode="compat"))


def t1_terms_full_freq(spark, d):
    return terms.term_freq(terms.terms(_with_tail(spark, d)))


def _tail_freq(words: list[str]) -> str:
    """SQL of the frequencies with those of the tail's terms."""
    tail = ", ".join(f"('{w}')" for w in words)
    return f"""SELECT term, count(*) AS n FROM (SELECT term FROM ({_rows()}) AS r
    UNION ALL SELECT t.w FROM documents, (VALUES {tail}) AS t(w) WHERE text IS NOT NULL) AS x GROUP BY term"""


def t2_normal_freq(spark, d):
    return terms.term_freq(terms.terms(docs(spark, d), normal=True))


def t3_fast_freq(spark, d):
    return terms.term_freq(terms.fast_terms(docs(spark, d)))


def _ngrams(n: int):
    def query(spark, d):
        return terms.term_freq(terms.ngrams(docs(spark, d), n), "ngram").withColumnRenamed("term", "ngram")

    return query, f"""
SELECT ngram, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(list_slice(t, i, i + {n - 1}), ' '))) AS ngram
  FROM ({_tokens("documents", "doc_id")}) AS x WHERE len(t) >= {n}
) AS y GROUP BY ngram"""


def a3_doc_freq(spark, d):
    return terms.doc_freq_of(docs(spark, d))


def o1_sorted_doc_freq(spark, d):
    return terms.in_order(terms.doc_freq_of(docs(spark, d)), "term").select("place", "term", "n")


def o2_sorted_ratio(spark, d):
    return terms.in_order(a4_tf_ratio(spark, d), "ratio", "term", descending=True).select("place", "term", "ratio")


def a4_tf_ratio(spark, d):
    tf = terms.term_freq(terms.terms(items(spark, d)))
    return terms.tf_ratio(tf, terms.term_freq(terms.terms(docs(spark, d))))


def a5_distinct_ids(spark, d):
    return ids.distinct_ids(terms.terms(docs(spark, d)))


def w2_enum(spark, d):
    return ids.extend_state(terms.terms(docs(spark, d)), ["doc_id", "pos"])


def w2_enum_rows(spark, d):
    got, _ = ids.enumerate_terms(terms.terms(docs(spark, d)), ["doc_id", "pos"])
    return got.select("doc_id", "pos", "term", "id")


def f17_lookup_no_extend(spark, d):
    state = ids.extend_state(terms.terms(docs(spark, d)), ["doc_id", "pos"])
    got, _ = ids.enumerate_terms(terms.terms(items(spark, d)), ["item_id", "pos"], state=state, extend=False)
    return got.select("item_id", "pos", "term", "id")


def st2_enum_resume(spark, d):
    state = ids.extend_state(terms.terms(docs(spark, d)), ["doc_id", "pos"])
    return ids.extend_state(terms.terms(items(spark, d)), ["item_id", "pos"], state=state)


def t4_stem_freq(spark, d):
    counted = terms.term_freq(terms.terms(docs(spark, d), normal=True))
    return counted.select(stem("term").alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


def t12_term_hash(spark, d):
    return terms.terms(docs(spark, d)).select("term").distinct().select("term", term_hash("term").alias("hash"))


def t6_unwrap(spark, d):
    return layout.unwrap(docs(spark, d))


def t7_pages(spark, d):
    return layout.pages(docs(spark, d), sep="\n").select("doc_id", "page_no", "text")


def t7_pages_formfeed(spark, d):
    broken = docs(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\f\n")))
    return layout.pages(broken).select("doc_id", "page_no", "text")


def w4_columns(spark, d):
    return layout.split_columns(docs(spark, d)).select("doc_id", "line_no", F.array_join("fields", "\t").alias("line"))


def w4_columns_global(spark, d):
    return layout.split_columns(docs(spark, d), mode="global").select("doc_id", "line_no", F.array_join("fields", "\t").alias("line"))


def s5_lines(spark, d):
    return source.lines(docs(spark, d)).select("doc_id", "line_no", "line")


def s6_columns(spark, d):
    return source.columns(source.lines(docs(spark, d)), ". ").select("doc_id", "line_no", F.posexplode("fields").alias("k", "field"))


def k1_render_terms(spark, d):
    return source.render_texts(docs(spark, d))


def k4_render_ids(spark, d):
    got, _ = ids.enumerate_terms(terms.terms(docs(spark, d)), ["doc_id", "pos"])
    return got.select("doc_id", "pos", source.render_id().alias("value"))


def k4_render_profile(spark, d):
    return source.render_profile(profile.letter_profile(docs(spark, d)))


def a12_profile(spark, d):
    return profile.letter_profile(docs(spark, d)).withColumn("pct", F.round("pct", 9))


_PROFILE = """
WITH runs AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS r FROM documents),
grams AS (
  SELECT 2 AS n, substr(r, i, 2) AS gram FROM (SELECT r, unnest(range(1, length(r))) AS i FROM runs) AS x
  UNION ALL SELECT 3, substr(r, i, 3) FROM (SELECT r, unnest(range(1, length(r) - 1)) AS i FROM runs WHERE length(r) > 2) AS x
),
c AS (SELECT n, gram, count(*) AS cnt FROM grams GROUP BY n, gram),
p AS (SELECT *, 100.0 * cnt / CAST(sum(cnt) OVER (PARTITION BY n) AS DOUBLE) AS pct FROM c)
SELECT n, gram, CAST(CASE n WHEN 2 THEN ((ascii(gram) * 32) + ascii(substr(gram, 2, 1))) & 1023
  ELSE ((ascii(gram) * 32 + ascii(substr(gram, 2, 1))) * 32 + ascii(substr(gram, 3, 1))) & 32767 END AS INTEGER) AS bucket,
  cnt, round(pct, 9) AS pct FROM p WHERE pct >= 0.1"""

_LINES = """SELECT doc_id, unnest(l) AS line, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line_no FROM (
  SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS l FROM documents WHERE length(text) > 0) AS x"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UNWRAP = f"""
WITH RECURSIVE l AS ({_LINES}),
cut AS (SELECT doc_id, line_no, line, ltrim(line, {_BLANKS}) AS body, trim(line, {_BLANKS}) AS bare, length(line) - length(ltrim(line, {_BLANKS})) AS indent FROM l),
step AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS line_no, '' AS held, '' AS out FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT s.doc_id, c.line_no,
    CASE WHEN goes AND bare NOT LIKE '%.' THEN held || bare || ' ' ELSE '' END,
    out || CASE WHEN goes AND bare LIKE '%.' THEN held || bare || chr(10) WHEN goes THEN ''
      ELSE CASE WHEN held <> '' THEN held || chr(10) ELSE '' END
        || CASE WHEN bare = '' THEN '' WHEN length(bare) <= 80 AND indent >= 4 THEN line ELSE body END || chr(10) END
  FROM step AS s JOIN cut AS c ON c.doc_id = s.doc_id AND c.line_no = s.line_no + 1,
    LATERAL (SELECT length(bare) <= 80 AND indent < 4 AND ((bare <> '' AND held <> '') OR length(bare) >= 60) AS goes) AS g
)
SELECT doc_id, arg_max(out || CASE WHEN held <> '' THEN held || chr(10) ELSE '' END, line_no) AS text FROM step GROUP BY doc_id
UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL"""

# two gaps that overlap give one if neither side has a later gap that begins within the other's
_COLUMNS = f"""
WITH RECURSIVE l AS ({_LINES}),
marks AS (
  SELECT doc_id, line_no, line, list_filter(range(1, length(line) + 1), lambda i: line[i] = ' ' AND (i = 1 OR line[i - 1] <> ' ')) AS b,
    list_filter(range(1, length(line) + 1), lambda i: line[i] = ' ' AND (i = length(line) OR line[i + 1] <> ' ')) AS e FROM l
),
found AS (
  SELECT doc_id, line_no, line, list_transform(range(1, len(b) + CASE WHEN e[len(e)] = length(line) THEN 0 ELSE 1 END),
    lambda k: {{'lo': b[k] - 1, 'hi': e[k], 'nx': CASE WHEN k < len(b) - CASE WHEN e[len(e)] = length(line) THEN 1 ELSE 0 END THEN b[k + 1] - 1 ELSE 1000000000 END}}) AS y FROM marks
),
state AS (
  SELECT doc_id, line_no, line, y AS g FROM found WHERE line_no = 1
  UNION ALL
  SELECT f.doc_id, f.line_no, f.line, CASE WHEN len(shared) > 0 THEN list_transform(range(1, len(shared) + 1),
    lambda k: {{'lo': shared[k].lo, 'hi': shared[k].hi, 'nx': coalesce(shared[k + 1].lo, 1000000000)}}) ELSE y END
  FROM state AS s JOIN found AS f ON f.doc_id = s.doc_id AND f.line_no = s.line_no + 1, LATERAL (SELECT
    flatten(list_transform(s.g, lambda p: list_transform(list_filter(f.y, lambda q: greatest(p.lo, q.lo) < least(p.hi, q.hi) AND p.nx >= q.hi AND q.nx >= p.hi),
      lambda q: {{'lo': greatest(p.lo, q.lo), 'hi': least(p.hi, q.hi)}}))) AS shared) AS c
)
SELECT doc_id, line_no, array_to_string(list_transform(range(0, len(g) + 1), lambda k: trim(substr(line,
  CASE WHEN k = 0 THEN 1 ELSE g[k].hi + 1 END, greatest(0, CASE WHEN k = len(g) THEN length(line) ELSE g[k + 1].lo END - CASE WHEN k = 0 THEN 0 ELSE g[k].hi END)), ' ')), chr(9)) AS line
FROM """

# the steps of suffix stripping on (w, s): the word and its shape, c and v for its letters
_SHAPE = """list_reduce(list_prepend('', string_split({w}, '')), lambda a, x: a || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') THEN 'v'
  WHEN x = 'y' THEN CASE WHEN a = '' OR a LIKE '%v' THEN 'c' ELSE 'v' END WHEN x = '' THEN '' ELSE 'c' END)"""


def _stem_sql() -> str:
    """SQL (term, n) -> (term, stem): each step is a table of its own, over the distinct terms."""
    part = lambda k: f"substr(s, 1, length(w) - {k})"
    measure = lambda shape: f"len(regexp_extract_all({shape}, 'v+c+'))"
    closed = lambda k: f"({part(k)} LIKE '%cvc' AND substr(w, length(w) - {k}, 1) NOT IN ('w', 'x', 'y'))"

    def table(rules: list[tuple[str, str]], least: int) -> str:
        whens = [f"WHEN w LIKE '%{a}' THEN CASE WHEN {measure(part(len(a)))} >= {least} THEN substr(w, 1, length(w) - {len(a)}) || '{b}' ELSE w END" for a, b in sorted(rules, key=lambda r: -len(r[0]))]
        return f"CASE {' '.join(whens)} ELSE w END"

    two = "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
    three = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    four = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
    whens = [f"WHEN w LIKE '%{e}' THEN CASE WHEN {measure(part(len(e)))} > 1" + (" AND (w LIKE '%sion' OR w LIKE '%tion')" if e == "ion" else "") + f" THEN substr(w, 1, length(w) - {len(e)}) ELSE w END" for e in sorted(four, key=lambda e: -len(e))]
    chop = lambda k: f"substr(w, 1, length(w) - {k})"
    steps = [
        f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {chop(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {chop(1)} ELSE w END, false",
        f"""CASE WHEN w LIKE '%eed' THEN CASE WHEN {measure(part(3))} > 0 THEN {chop(1)} ELSE w END
          WHEN w LIKE '%ed' AND contains({part(2)}, 'v') THEN {chop(2)} WHEN w LIKE '%ing' AND contains({part(3)}, 'v') THEN {chop(3)} ELSE w END,
          w NOT LIKE '%eed' AND ((w LIKE '%ed' AND contains({part(2)}, 'v')) OR (w LIKE '%ing' AND contains({part(3)}, 'v')))""",
        f"""CASE WHEN NOT f THEN w WHEN w LIKE '%at' OR w LIKE '%bl' OR w LIKE '%iz' THEN w || 'e'
          WHEN length(w) > 1 AND right(w, 1) = substr(w, length(w) - 1, 1) AND s LIKE '%c' AND right(w, 1) NOT IN ('l', 's', 'z') THEN {chop(1)}
          WHEN {measure('s')} = 1 AND s LIKE '%cvc' AND right(w, 1) NOT IN ('w', 'x', 'y') THEN w || 'e' ELSE w END, false""",
        f"CASE WHEN w LIKE '%y' AND contains({part(1)}, 'v') THEN {chop(1)} || 'i' ELSE w END, false",
        table(list(zip(two[::2], two[1::2])), 1) + ", false",
        table(three, 1) + ", false",
        f"CASE {' '.join(whens)} ELSE w END, false",
        f"CASE WHEN w LIKE '%e' AND ({measure(part(1))} > 1 OR ({measure(part(1))} = 1 AND NOT {closed(1)})) THEN {chop(1)} ELSE w END, false",
        f"CASE WHEN w LIKE '%ll' AND {measure(part(1))} > 1 THEN {chop(1)} ELSE w END, false",
    ]
    lower = "translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"s0 AS (SELECT term, {lower} AS w, false AS f FROM counted WHERE length(term) > 2)"]
    for k, step in enumerate(steps):
        word, flag = step.rsplit(", ", 1) if step.endswith(", false") else step.split(",\n", 1)
        sql.append(f"s{k + 1} AS (SELECT term, {word} AS w, {flag} AS f FROM (SELECT *, {_SHAPE.format(w='w')} AS s FROM s{k}) AS x)")
    return ", ".join(sql) + f", stems AS (SELECT term, w AS stem FROM s{len(steps)} UNION ALL SELECT term, {lower} FROM counted WHERE length(term) <= 2)"


_STEMS = f"""WITH counted AS (SELECT {_NORMAL} AS term, count(*) AS n FROM ({_rows()}) AS r GROUP BY 1), {_stem_sql()}
SELECT stem, CAST(sum(n) AS BIGINT) AS n, count(*) AS forms FROM stems JOIN counted ON stems.term = counted.term GROUP BY stem"""

QUERIES = {
    "t1_terms_freq": (t1_terms_freq, f"SELECT term, count(*) AS n FROM ({_rows()}) AS r GROUP BY term"),
    "t1_terms": (t1_terms, _rows()),
    "t1a_terms_compat_freq": (t1_terms_compat_freq, _tail_freq(["abc", "def", "x", "y", "z"])),
    "t1a_terms_full_freq": (t1_terms_full_freq, _tail_freq(["漢字", "abc한글def", "\U00010414x", "y\U00020000", "z"])),
    "t2_normal_freq": (t2_normal_freq, f"SELECT {_NORMAL} AS term, count(*) AS n FROM ({_rows()}) AS r GROUP BY 1"),
    "t3_fast_freq": (t3_fast_freq, f"SELECT term, count(*) AS n FROM ({_rows(regex=_FAST)}) AS r GROUP BY term"),
    "t4_stem_freq": (t4_stem_freq, _STEMS),
    "t6_unwrap": (t6_unwrap, _UNWRAP),
    "t7_pages": (
        t7_pages,
        """SELECT * FROM (SELECT doc_id, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS page_no, unnest(p) AS text
        FROM (SELECT doc_id, string_split_regex(text, '\\n\\n?') AS p FROM documents) AS x) AS y WHERE text <> ''""",
    ),
    "t7_pages_formfeed": (
        t7_pages_formfeed,
        """SELECT * FROM (SELECT doc_id, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS page_no, unnest(p) AS text
        FROM (SELECT doc_id, string_split_regex(replace(text, '. ', '.' || chr(12) || chr(10)), '\\x0c\\n?') AS p FROM documents) AS x) AS y WHERE text <> ''""",
    ),
    "t12_term_hash": (t12_term_hash, None),
    "w1_ngram2": _ngrams(2),
    "w1_ngram3": _ngrams(3),
    "w2_enum": (w2_enum, f"{_ENUM} SELECT term, id FROM dict"),
    "w2_enum_rows": (w2_enum_rows, f"{_ENUM} SELECT doc_id, pos, rows.term, id FROM rows JOIN dict ON rows.term = dict.term"),
    "w4_columns": (w4_columns, f"{_COLUMNS} state"),
    "w4_columns_global": (w4_columns_global, f"{_COLUMNS} (SELECT doc_id, line_no, line, last_value(g) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g FROM state) AS last"),
    "f17_lookup_no_extend": (
        f17_lookup_no_extend,
        f"{_ENUM} SELECT item_id, pos, b.term, coalesce(id, 0) AS id FROM ({_rows('benchmark', 'item_id')}) AS b LEFT JOIN dict ON b.term = dict.term",
    ),
    "st2_enum_resume": (
        st2_enum_resume,
        f"""{_ENUM}, new AS (SELECT term, min((item_id, pos)) AS f FROM ({_rows('benchmark', 'item_id')}) AS b
        WHERE term NOT IN (SELECT term FROM dict) GROUP BY term)
        SELECT term, id FROM dict UNION ALL
        SELECT term, CAST((SELECT count(*) FROM dict) + row_number() OVER (ORDER BY f) AS BIGINT) AS id FROM new""",
    ),
    "s5_lines": (s5_lines, f"SELECT doc_id, line_no, line FROM ({_LINES}) AS y"),
    "s6_columns": (
        s6_columns,
        f"""SELECT doc_id, line_no, CAST(unnest(range(len(f))) AS INTEGER) AS k, unnest(f) AS field
        FROM (SELECT doc_id, line_no, string_split(line, '. ') AS f FROM ({_LINES}) AS y) AS z""",
    ),
    "k1_render_terms": (
        k1_render_terms,
        f"SELECT doc_id, array_to_string(t, chr(10)) || chr(10) || chr(12) || chr(10) AS text FROM ({_tokens('documents', 'doc_id')}) AS x WHERE len(t) > 0",
    ),
    "a3_doc_freq": (a3_doc_freq, f"SELECT term, count(DISTINCT doc_id) AS n FROM ({_rows()}) AS r GROUP BY term"),
    "a4_tf_ratio": (
        a4_tf_ratio,
        f"""SELECT a.term, round(a.n / b.n, 6) AS ratio FROM (SELECT term, count(*) AS n FROM ({_rows('benchmark', 'item_id')}) AS r GROUP BY term) AS a
        JOIN (SELECT term, count(*) AS n FROM ({_rows()}) AS r GROUP BY term) AS b ON a.term = b.term""",
    ),
    "o1_sorted_doc_freq": (
        o1_sorted_doc_freq,
        f"""SELECT row_number() OVER (ORDER BY encode(term)) AS place, term, n FROM
        (SELECT term, count(DISTINCT doc_id) AS n FROM ({_rows()}) AS r GROUP BY term) AS f""",
    ),
    "o2_sorted_ratio": (
        o2_sorted_ratio,
        f"""SELECT row_number() OVER (ORDER BY ratio DESC, encode(term)) AS place, term, ratio FROM
        (SELECT a.term, round(a.n / b.n, 6) AS ratio FROM (SELECT term, count(*) AS n FROM ({_rows('benchmark', 'item_id')}) AS r GROUP BY term) AS a
        JOIN (SELECT term, count(*) AS n FROM ({_rows()}) AS r GROUP BY term) AS b ON a.term = b.term) AS f""",
    ),
    "a5_distinct_ids": (
        a5_distinct_ids,
        f"SELECT term, CAST(row_number() OVER (ORDER BY encode(term)) AS BIGINT) AS id FROM (SELECT DISTINCT term FROM ({_rows()}) AS r) AS x",
    ),
    "a12_profile": (a12_profile, _PROFILE),
    "k4_render_ids": (
        k4_render_ids,
        f"{_ENUM} SELECT doc_id, pos, CAST(id AS VARCHAR) AS value FROM rows JOIN dict ON rows.term = dict.term",
    ),
    "k4_render_profile": (
        k4_render_profile,
        f"""SELECT n || ':' || lpad(lower(to_hex(bucket)), n + 1, '0') || chr(9) || format('{{:.6f}}', sum(pct)) || '%' || chr(9) || ' '
        || string_agg(gram, ' ' ORDER BY cnt DESC, gram) AS value FROM ({_PROFILE}) AS p GROUP BY n, bucket""",
    ),
}
