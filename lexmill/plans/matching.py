"""Queries of matching, Bloom filters, pairs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pairs import osa_distance, qgram_score
from ..operators import bloom, match, pairs, terms
from ..runtime import cut
from ..sources import text as source
from ..sources.patterns import Pattern, parse_patterns, patterns_df
from ..streaming import state as streams
from .text import _FAST, _LINES, _rows, docs, items, table

PATTERNS = r'''
# function words of four languages and some word parts
"the"i -> "en"   "The" -> "en"
"and" -> "en"
"le"i -> "fr"
"la" -> "fr,es"
"und"i -> "de"
"der" -> "de"
"los" -> "es"
"tion*" -> "part"
"*ment"i -> "part"
"*heit*"
"of"
'''
_S = r"[\x00-\x22''()\-,.:;?`]"
_WIDE = r"[\x00-\x22''()\-,.:;?`\x{80}-\x{10ffff}]"


def _sql_count(p: Pattern, sep: str = _S) -> str:
    """Every separator is doubled, so that neighbouring hits don't share one."""
    flag = "(?i)" if p.ci else ""
    left = "" if p.left else f"(?:^|{sep})"
    right = "" if p.right else f"(?:{sep}|$)"
    return f"len(regexp_extract_all(regexp_replace(text, '({sep})', '\\1\\1', 'g'), '{flag}{left}{p.pattern}{right}'))"


def _sql_counts(patterns: list[Pattern], sep: str = _S) -> str:
    parts = [
        f"SELECT doc_id, {p.idx} AS idx, '{p.pattern}' AS pattern, {repr(p.label) if p.label else 'CAST(NULL AS VARCHAR)'} AS yield, {_sql_count(p, sep)} AS n FROM documents"
        for p in patterns
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS u WHERE n > 0"


def _one(pattern: str, **how):
    p = parse_patterns(pattern)

    def query(spark, d):
        return match.match_counts(docs(spark, d), p, **how).select("doc_id", "n")

    return query, f"SELECT doc_id, n FROM ({_sql_counts(p, _WIDE if how.get('non_ascii_wordsep') else _S)}) AS m"


def f1_match_counts(spark, d):
    return match.match_counts(docs(spark, d), parse_patterns(PATTERNS))


def f1_match_automaton(spark, d):
    return match.match_counts(docs(spark, d), parse_patterns(PATTERNS), expressions=0)


def _many(spark, d) -> list[Pattern]:
    """Every word of the benchmark, a table of fixed size, as a whole-word pattern."""
    words = items(spark, d).select(F.explode(F.split("text", _S.replace("''", "'"))).alias("w")).filter("w <> ''").distinct()
    return [Pattern(k, r[0]) for k, r in enumerate(words.orderBy("w").collect())]


def f1_match_many(spark, d):
    return match.match_counts(docs(spark, d), _many(spark, d), expressions=0).select("doc_id", "pattern", "n")


def f8_match_scan(spark, d):
    return match.match_counts(docs(spark, d), parse_patterns(PATTERNS), mode="scan")


def f7_short_overlaps(spark, d):
    return match.match_counts(docs(spark, d), parse_patterns('"*éé*"\n"*nn*"')).select("doc_id", "pattern", "n")


def a2_label_rollup(spark, d):
    return match.match_report(docs(spark, d), parse_patterns(PATTERNS))


def f10_show_patterns(spark, d):
    return match.match_report(docs(spark, d), parse_patterns(PATTERNS), show_patterns=True)


def f11_invert(spark, d):
    return match.match_report(docs(spark, d), parse_patterns('"the"i -> "en"\n"le"i'), invert=True)


def k3_report_lines(spark, d):
    return source.render_matches(a2_label_rollup(spark, d))


def p1_patterns(spark, d):
    return patterns_df(spark, parse_patterns(PATTERNS))


#: A word twice, a label without quotes, several words and labels, a line that goes on, escapes.
ODD = r'''"foo"i -> "a"
"*bar" -> unquoted
"one" "two" -> "x" -> "y"
"a\"b*" \
 -> "z"
"foo" -> "b"
"*mid*"i
"star\*"'''


def p9_patterns_odd(spark, d):
    return patterns_df(spark, parse_patterns(ODD))


_COUNTS = _sql_counts(parse_patterns(PATTERNS))
_REPORT = f"""SELECT doc_id, coalesce(yield, pattern) AS label, CAST(sum(n) AS BIGINT) AS n, CAST(min(idx) AS INTEGER) AS first_idx
FROM ({_COUNTS}) AS c GROUP BY doc_id, yield IS NOT NULL, coalesce(yield, pattern)"""


# hits of each pattern by their places, then along each text the first that begins where the last one ended or later
_SCAN = f"""
WITH RECURSIVE p(idx, pattern, body, yield, ci, l, r) AS (VALUES {", ".join(
    f"({p.idx}, '{p.pattern}', '{p.pattern.lower() if p.ci else p.pattern}', {repr(p.label) if p.label else 'NULL'}, {p.ci}, {p.left}, {p.right})"
    for p in parse_patterns(PATTERNS))}),
t AS (SELECT doc_id, idx, body, yield, p.pattern, l, r, CASE WHEN ci THEN lower(text) ELSE text END AS text FROM documents, p),
parts AS (SELECT *, string_split(text, body) AS s FROM t WHERE contains(text, body)),
places AS (
  SELECT doc_id, idx, pattern, yield, l, r, text, length(body) AS n, unnest(range(1, len(s))) AS k, unnest(list_transform(range(1, len(s)),
    lambda k: list_sum(list_transform(list_slice(s, 1, k), lambda x: length(x))) + (k - 1) * length(body) + 1)) AS start FROM parts
),
hits AS (
  SELECT doc_id, idx, pattern, yield, start, n FROM places WHERE (l OR start = 1 OR regexp_matches(substr(text, CAST(start - 1 AS BIGINT), 1), '{_S}'))
  AND (r OR start + n > length(text) OR regexp_matches(substr(text, CAST(start + n AS BIGINT), 1), '{_S}'))
),
long AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, idx DESC) AS k FROM hits WHERE n > 2),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS free, -1 AS idx FROM (SELECT DISTINCT doc_id FROM long) AS d
  UNION ALL
  SELECT w.doc_id, x.k, CASE WHEN x.start >= w.free THEN CAST(x.start + x.n AS BIGINT) ELSE w.free END, CASE WHEN x.start >= w.free THEN x.idx ELSE -1 END
  FROM walk AS w JOIN long AS x ON x.doc_id = w.doc_id AND x.k = w.k + 1
),
counted AS (
  SELECT doc_id, idx, count(*) AS n FROM walk WHERE idx >= 0 GROUP BY doc_id, idx
  UNION ALL SELECT doc_id, idx, count(*) FROM hits WHERE n <= 2 GROUP BY doc_id, idx
)
SELECT doc_id, counted.idx, pattern, yield, n FROM counted JOIN p ON p.idx = counted.idx"""


_P, _K = 1e-9, 30


def _dictionary(spark, d):
    return bloom.bloom_sized(terms.terms(docs(spark, d)), "term", _P, _K)


def f13_bloom_has(spark, d):
    return bloom.bloom_has(terms.terms(items(spark, d)).select("term").distinct(), "term", _dictionary(spark, d))


def j6_bloom_join_probe(spark, d):
    return bloom.bloom_has(terms.terms(items(spark, d)).select("term").distinct(), "term", _dictionary(spark, d), limit=0)


def a10_bloom_hit_rate(spark, d):
    return bloom.bloom_hit_rate(terms.terms(items(spark, d)), "term", _dictionary(spark, d)).withColumn("pct", F.round("pct", 9))


def k4_render_hits(spark, d):
    return source.render_hits(bloom.bloom_hit_rate(terms.terms(items(spark, d)), "term", _dictionary(spark, d)))


def o4_ordered_report(spark, d):
    return terms.in_order(a2_label_rollup(spark, d), "doc_id", "first_idx", "label").select("place", "doc_id", "label", "n")


def a11_bloom_info(spark, d):
    return bloom.bloom_info(_dictionary(spark, d)).select("k", "count")


def a6_bloom_merge(spark, d):
    rows, more = (cut(terms.terms(t).select("term").distinct()) for t in (items(spark, d), docs(spark, d)))
    params = bloom.bloom_params(capacity=max(rows.union(more).distinct().count(), 1), p=_P, k=_K)
    both = bloom.bloom_add(bloom.bloom_build(rows, "term", params), more, "term")
    return bloom.bloom_info(both).select("k", "count")


def st1_stream_match(spark, d):
    return streams.streamed(spark, f"{d}/documents.parquet", lambda df: match.match_counts(df.select("doc_id", "text"), parse_patterns(PATTERNS)))


def st1_stream_fast_terms(spark, d):
    return streams.streamed(spark, f"{d}/documents.parquet", lambda df: terms.fast_terms(df.select("doc_id", "text")))


def st1_stream_qgram(spark, d):
    score = F.round(qgram_score("p_name", "p_type").cast("double"), 5).alias("score")
    return streams.streamed(spark, f"{d}/part.parquet", lambda df: df.select("p_partkey", score))


def j1_distance_regions(spark, d):
    n, r = table(spark, d, "nation").select("n_name"), table(spark, d, "region").select("r_name")
    return pairs.distance_matrix(n, r, "n_name", "r_name")


def j1_distance_parts(spark, d):
    p = table(spark, d, "part")
    return pairs.distance_matrix(p.select("p_name").distinct(), p.select("p_brand").distinct(), "p_name", "p_brand")


def t5_distance_pairs(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", osa_distance("p_name", "p_type").alias("d"))


def t8_qgram_score(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(qgram_score("p_name", "p_type").cast("double"), 5).alias("score"))


def j3_infix_lines(spark, d):
    return pairs.drop_infixes(source.lines(docs(spark, d)), ["doc_id", "line_no"]).select("line", "first.doc_id", "first.line_no")


def _names(spark, d):
    p = table(spark, d, "part")
    cols = [p.select(F.col(c).alias("line"), "p_partkey") for c in ("p_name", "p_type", "p_brand")]
    words = p.select(F.explode(F.split("p_name", " ")).alias("line"), "p_partkey")
    return cols[0].unionByName(cols[1]).unionByName(cols[2]).unionByName(words)


def j3_infix_names(spark, d):
    return pairs.drop_infixes(_names(spark, d), ["p_partkey"]).select("line", "first.p_partkey")


_CODES = "list_transform(string_split(upper({c}), ''), lambda x: CASE WHEN x = ' ' THEN 28 ELSE ascii(x) - 64 END)"
_HASHES = "list_transform(range(1, len({c}) - 3), lambda i: xor(xor(xor(xor({c}[i] << 12, {c}[i + 1] << 9), {c}[i + 2] << 6), {c}[i + 3] << 3), {c}[i + 4]))"

_QGRAM = f"""WITH c AS (SELECT p_partkey, {_CODES.format(c='p_name')} AS a, {_CODES.format(c='p_type')} AS b FROM part),
        h AS (SELECT p_partkey, {_HASHES.format(c='a')} AS x, {_HASHES.format(c='b')} AS y, least(len(a), len(b)) - 4 AS m FROM c)
        SELECT p_partkey, round(CAST(CAST(len(list_filter(y, lambda g: list_contains(x, g))) AS FLOAT) / CAST(m AS FLOAT) AS DOUBLE), 5) AS score FROM h"""

QUERIES = {
    # written out by hand
    "p1_patterns": (
        p1_patterns,
        """SELECT CAST(idx AS INTEGER) AS idx, pattern, ci, "left", "right", yield FROM (VALUES
        (0, 'the', true, false, false, 'en'), (1, 'and', false, false, false, 'en'), (2, 'le', true, false, false, 'fr'),
        (3, 'la', false, false, false, 'fr,es'), (4, 'und', true, false, false, 'de'), (5, 'der', false, false, false, 'de'),
        (6, 'los', false, false, false, 'es'), (7, 'tion', false, false, true, 'part'), (8, 'ment', true, true, false, 'part'),
        (9, 'heit', false, true, true, NULL), (10, 'of', false, false, false, NULL)
        ) AS v(idx, pattern, ci, "left", "right", yield)""",
    ),
    "p9_patterns_odd": (
        p9_patterns_odd,
        """SELECT CAST(idx AS INTEGER) AS idx, pattern, ci, "left", "right", yield FROM (VALUES
        (0, 'foo', false, false, false, 'b'), (1, 'bar', false, true, false, NULL), (2, 'two', false, false, false, 'y'),
        (3, 'a"b', false, false, true, 'z'), (4, 'mid', true, true, true, NULL), (5, 'star*', false, false, false, NULL)
        ) AS v(idx, pattern, ci, "left", "right", yield)""",
    ),
    "k4_render_hits": (
        k4_render_hits,
        f"""SELECT 'hits' || chr(9) || '<stdin>' || chr(9) || count(*) FILTER (hit) || '/' || count(*) || chr(9)
        || format('{{:.2f}}', 100.0 * count(*) FILTER (hit) / CAST(count(*) AS DOUBLE)) || '%' AS value FROM
        (SELECT term IN (SELECT term FROM ({_rows()}) AS r) AS hit FROM ({_rows('benchmark', 'item_id')}) AS b) AS x""",
    ),
    "o4_ordered_report": (
        o4_ordered_report,
        f"""SELECT row_number() OVER (ORDER BY doc_id, first_idx, label) AS place, doc_id, label, n FROM ({_REPORT}) AS r""",
    ),
    "f1_match_counts": (f1_match_counts, _COUNTS),
    "f1_match_automaton": (f1_match_automaton, _COUNTS),
    "f1_match_many": (
        f1_match_many,
        f"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '{_S}')) AS pattern FROM benchmark),
        t AS (SELECT doc_id, unnest(string_split_regex(text, '{_S}')) AS pattern FROM documents)
        SELECT t.doc_id, t.pattern, count(*) AS n FROM t JOIN w ON t.pattern = w.pattern WHERE t.pattern <> '' GROUP BY t.doc_id, t.pattern""",
    ),
    "f3_wide_separators": _one('"une"', non_ascii_wordsep=True),
    "f4_match_whole_ci": _one('"the"i'),
    "f5_match_prefix": _one('"th*"'),
    "f5_match_suffix": _one('"*tion"'),
    "f5_match_infix": _one('"*tion*"'),
    "f7_short_overlaps": (
        f7_short_overlaps,
        """SELECT doc_id, pattern, n FROM (SELECT doc_id, pattern, len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = pattern)) AS n
        FROM documents, (VALUES ('éé'), ('nn')) AS p(pattern)) AS x WHERE n > 0""",
    ),
    "f8_match_scan": (f8_match_scan, _SCAN),
    "a2_label_rollup": (a2_label_rollup, _REPORT),
    "f10_show_patterns": (
        f10_show_patterns,
        f"SELECT doc_id, pattern AS label, CAST(sum(n) AS BIGINT) AS n, CAST(min(idx) AS INTEGER) AS first_idx FROM ({_COUNTS}) AS c GROUP BY doc_id, pattern",
    ),
    "f11_invert": (
        f11_invert,
        f"""SELECT doc_id, CAST(NULL AS VARCHAR) AS label, CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS first_idx FROM documents
        WHERE {_sql_count(Pattern(0, 'the', True))} = 0 AND {_sql_count(Pattern(0, 'le', True))} = 0""",
    ),
    "k3_report_lines": (k3_report_lines, f"SELECT label || chr(9) || n || chr(9) || doc_id AS value FROM ({_REPORT}) AS r"),
    "f13_bloom_has": (
        f13_bloom_has,
        f"SELECT DISTINCT term FROM ({_rows('benchmark', 'item_id')}) AS b WHERE term IN (SELECT term FROM ({_rows()}) AS r)",
    ),
    "j6_bloom_join_probe": (
        j6_bloom_join_probe,
        f"SELECT DISTINCT term FROM ({_rows('benchmark', 'item_id')}) AS b WHERE term IN (SELECT term FROM ({_rows()}) AS r)",
    ),
    "a6_bloom_merge": (
        a6_bloom_merge,
        f"SELECT CAST(30 AS INTEGER) AS k, count(*) AS count FROM (SELECT term FROM ({_rows()}) AS r UNION SELECT term FROM ({_rows('benchmark', 'item_id')}) AS b) AS x",
    ),
    "a10_bloom_hit_rate": (
        a10_bloom_hit_rate,
        f"""SELECT count(*) FILTER (hit) AS hits, count(*) AS total, round(100.0 * count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 9) AS pct FROM
        (SELECT term IN (SELECT term FROM ({_rows()}) AS r) AS hit FROM ({_rows('benchmark', 'item_id')}) AS b) AS x""",
    ),
    "a11_bloom_info": (a11_bloom_info, f"SELECT CAST(30 AS INTEGER) AS k, count(DISTINCT term) AS count FROM ({_rows()}) AS r"),
    "j1_distance_regions": (
        j1_distance_regions,
        "SELECT n_name AS a, r_name AS b, CAST(damerau_levenshtein(n_name, r_name) AS INTEGER) AS d FROM nation, region",
    ),
    "j1_distance_parts": (
        j1_distance_parts,
        """SELECT a, b, CAST(damerau_levenshtein(a, b) AS INTEGER) AS d FROM (SELECT DISTINCT p_name AS a FROM part) AS x,
        (SELECT DISTINCT p_brand AS b FROM part) AS y""",
    ),
    "t5_distance_pairs": (t5_distance_pairs, "SELECT p_partkey, CAST(damerau_levenshtein(p_name, p_type) AS INTEGER) AS d FROM part"),
    "t8_qgram_score": (
        t8_qgram_score,
        _QGRAM,
    ),
    "j3_infix_names": (
        j3_infix_names,
        """WITH l AS (SELECT p_name AS line, p_partkey FROM part UNION ALL SELECT p_type, p_partkey FROM part UNION ALL SELECT p_brand, p_partkey FROM part
        UNION ALL SELECT unnest(string_split(p_name, ' ')), p_partkey FROM part),
        s AS (SELECT line, min(p_partkey) AS p_partkey FROM l WHERE length(line) > 0 GROUP BY line)
        SELECT line, p_partkey FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.line <> s.line AND contains(o.line, s.line))""",
    ),
    "j3_infix_lines": (
        j3_infix_lines,
        f"""WITH s AS (SELECT line, min((doc_id, line_no)) AS f FROM ({_LINES}) AS l WHERE length(line) > 0 GROUP BY line)
        SELECT line, f[1] AS doc_id, f[2] AS line_no FROM s
        WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE length(o.line) > length(s.line) AND contains(o.line, s.line))""",
    ),
    "st1_stream_match": (st1_stream_match, _COUNTS),
    "st1_stream_fast_terms": (st1_stream_fast_terms, _rows(regex=_FAST)),
    "st1_stream_qgram": (st1_stream_qgram, _QGRAM),
    "st1_stream_terms": (
        lambda spark, d: streams.stream_term_freq(spark, f"{d}/documents.parquet"),
        f"SELECT term, count(*) AS n FROM ({_rows()}) AS r GROUP BY term",
    ),
}
