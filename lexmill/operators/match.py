"""Multi-pattern matching with word boundaries.

Every pattern is counted for itself: each place where it stands with the boundaries
it asks for, overlaps included.  A few patterns become regular expressions inside
the JVM.  Of many, those that are one whole word are looked for among the words of the
text, and the others become one automaton that goes through the text once, both in Arrow
batches.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, checked_broadcast, in_slices
from ..sources.patterns import Pattern

#: Patterns that become expressions; more go to the automaton.
EXPRESSIONS = 50

_SEPARATORS = frozenset(range(0x23)) | frozenset(b"'(),-.:;?`")
_WORD = r"[^\x00-\x22'()\-,.:;?`]"
_ASCII_WORD = r"[\x23-\x26*+/0-9<=>@A-Z\[\\\]^_a-z{|}~\x7f]"


def pattern_regex(p: Pattern, non_ascii_wordsep: bool = False) -> str:
    """A regular expression that matches emptily at every place where the pattern stands."""
    word = _ASCII_WORD if non_ascii_wordsep else _WORD
    left = "" if p.left else f"(?<!{word})"
    right = "" if p.right else f"(?!{word})"
    body = "\\Q" + p.pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    # what is seldom there comes first: the word, then what is before it
    return f"(?={'(?i)' if p.ci else ''}{body}{right}){left}"


class Matcher:
    """Counts all patterns of a text in one pass: compile once, then ``count`` texts."""

    def __init__(self, patterns: list[Pattern], non_ascii_wordsep: bool = False, mode: str = "independent"):
        self.mode, self.patterns = mode, patterns
        self.wide = non_ascii_wordsep
        self.exact, self.folded = self._automaton(False), self._automaton(True)

    def _automaton(self, ci: bool):
        a = ahocorasick.Automaton()
        by: dict[str, list] = {}
        for p in self.patterns:
            if p.ci == ci:
                raw = p.pattern.encode()
                by.setdefault((raw.lower() if ci else raw).decode("latin-1"), []).append((p.idx, p.left, p.right, len(raw)))
        for key, found in by.items():
            a.add_word(key, found)
        if by:
            a.make_automaton()
        return a if by else None

    def _separates(self, c: str) -> bool:
        return ord(c) in _SEPARATORS or (self.wide and ord(c) >= 0x80)

    def hits(self, text: str):
        """(first byte, bytes, idx) of everything found."""
        raw = text.encode()
        for automaton, body in ((self.exact, raw), (self.folded, raw.lower())):
            if automaton is None:
                continue
            s = body.decode("latin-1")
            for end, found in automaton.iter(s):
                for idx, left, right, n in found:
                    start = end - n + 1
                    if (left or start == 0 or self._separates(s[start - 1])) and (right or end + 1 == len(s) or self._separates(s[end + 1])):
                        yield start, n, idx

    def count(self, text: str | None) -> dict[int, int]:
        """Hits by idx.  In mode 'scan' patterns of over two bytes hide what their hits cover."""
        out: dict[int, int] = {}
        if not text:
            return out
        long = []
        for start, n, idx in self.hits(text):
            if self.mode == "scan" and n > 2:
                long.append((start, -idx, n))
            else:
                out[idx] = out.get(idx, 0) + 1
        free = 0
        for start, minus, n in sorted(long):
            if start >= free:
                out[-minus] = out.get(-minus, 0) + 1
                free = start + n
        return out


_HITS = "array<struct<idx: int, n: bigint>>"


def _by_expressions(text: Column, patterns: list[Pattern], wide: bool) -> Column:
    each = [
        F.struct(F.lit(p.idx).alias("idx"), F.regexp_count(text, F.lit(pattern_regex(p, wide))).cast("bigint").alias("n")) for p in patterns
    ]
    return F.filter(F.array(*each), lambda x: x["n"] > 0)


def _by_automaton(text: Column, patterns: list[Pattern], wide: bool, mode: str) -> Column:
    held: list[Matcher] = []

    def count(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Matcher(patterns, wide, mode))
        rows = [[{"idx": k, "n": n} for k, n in sorted(held[0].count(t).items())] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("idx", pa.int32()), ("n", pa.int64())])))

    return F.arrow_udf(lambda texts: in_slices(count, texts), _HITS)(text)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"[\x00-\x22'()\-,.:;?`]+"
_SPLIT_WIDE = r"[\x00-\x22'()\-,.:;?`\x{80}-\x{10ffff}]+"


def is_word(p: Pattern, non_ascii_wordsep: bool) -> bool:
    """Is it one whole word, without separators inside?"""
    return not (p.left or p.right) and not any(ord(c) in _SEPARATORS or (non_ascii_wordsep and ord(c) >= 0x80) for c in p.pattern)


def _by_words(text: Column, patterns: list[Pattern], wide: bool) -> Column:
    """Hits of whole words, local to a row: the texts of a slice are split at once and their words looked up at once."""
    tables = []
    for ci in (False, True):
        by: dict[str, list[int]] = {}
        for p in patterns:
            if p.ci == ci and p.pattern:
                by.setdefault(p.pattern.translate(str.maketrans(_UPPER, _LOWER)) if ci else p.pattern, []).append(p.idx)
        if by:
            sizes = np.array([len(x) for x in by.values()])
            tables.append((ci, list(by), sizes, np.cumsum(sizes) - sizes, np.array([k for x in by.values() for k in x], "int32")))
    split = _SPLIT_WIDE if wide else _SPLIT

    def count(texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern_regex(pc.fill_null(texts, ""), split)
        row, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
        found = [(np.empty(0, "int64"), np.empty(0, "int32"), np.empty(0, "int64"))]
        for ci, keys, sizes, starts, idx in tables:
            code = pc.index_in(pc.ascii_lower(words) if ci else words, value_set=pa.array(keys, words.type))
            there = pc.is_valid(code)
            pairs = row.filter(there).to_numpy().astype("int64") * len(keys) + code.filter(there).to_numpy()
            pairs, n = np.unique(pairs, return_counts=True)
            r, c = np.divmod(pairs, len(keys))
            each = sizes[c]  # a word may be that of several patterns
            at = np.repeat(starts[c] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            found.append((np.repeat(r, each), idx[at], np.repeat(n, each)))
        r, idx, n = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((idx, r))
        ends = np.concatenate([[0], np.bincount(r, minlength=len(texts)).cumsum()]).astype("int32")
        hits = pa.StructArray.from_arrays([pa.array(idx[order], pa.int32()), pa.array(n[order], pa.int64())], ["idx", "n"])
        return pa.ListArray.from_arrays(pa.array(ends), hits)

    return F.arrow_udf(lambda texts: in_slices(count, texts), _HITS)(text)


def _by_word_join(docs: DataFrame, text: str, doc_id: str, patterns: list[Pattern], wide: bool) -> DataFrame:
    """(doc_id, idx, n) of more whole words than a task may hold: the words of a text meet the patterns in a join, and a row's hits are summed."""
    folded = any(p.ci for p in patterns)
    table = docs.sparkSession.createDataFrame(
        [(p.pattern.translate(str.maketrans(_UPPER, _LOWER)) if p.ci else p.pattern, p.ci, p.idx) for p in patterns], "word string, ci boolean, idx int"
    )
    size = sum(len(p.pattern) * 4 + 24 for p in patterns)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    each = rows.select("doc_id", "row", F.explode(F.split("text", _SPLIT_WIDE if wide else _SPLIT, -1)).alias("word")).filter("word <> ''")
    forms = each.withColumn("ci", F.lit(False))
    if folded:
        forms = forms.unionByName(each.withColumns({"word": F.translate("word", _UPPER, _LOWER), "ci": F.lit(True)}))
    hits = forms.join(checked_broadcast(table, size), ["word", "ci"])
    return hits.groupBy("row", "doc_id", "idx").agg(F.count("*").alias("n")).select("doc_id", "idx", "n")


def match_counts(
    docs: DataFrame, patterns: list[Pattern], text: str = "text", doc_id: str = "doc_id", non_ascii_wordsep: bool = False,
    mode: str = "independent", expressions: int = EXPRESSIONS, words: bool = True,
) -> DataFrame:
    """(doc_id, idx, pattern, yield, n) of the patterns that stand in each document.

    Separators are control characters, blank, ``! " ' ( ) , - . : ; ?`` and the back
    quote, with ``non_ascii_wordsep`` also everything beyond ASCII.  Up to ``expressions``
    patterns are row-local, as is the automaton; of more, whole words are looked for among
    the words of the texts unless ``words`` is off, also row-local while they are few enough
    to be broadcast.  Null and empty texts have no hits.
    """
    if mode not in ("independent", "scan"):
        raise ValueError("mode is 'independent' or 'scan'")
    few = mode == "independent" and len(patterns) <= expressions
    by = {p.idx: p for p in patterns}

    def found(hits: Column) -> DataFrame:
        return docs.select(F.col(doc_id).alias("doc_id"), F.explode(hits).alias("h")).select("doc_id", "h.idx", "h.n")

    if few:
        rows = found(_by_expressions(F.col(text), patterns, non_ascii_wordsep))
        names = F.create_map(*[x for k, p in by.items() for x in (F.lit(k), F.lit(p.pattern))])
        labels = F.create_map(*[x for k, p in by.items() for x in (F.lit(k), F.lit(p.label).cast("string"))])
        return rows.select("doc_id", "idx", F.element_at(names, F.col("idx")).alias("pattern"), F.element_at(labels, F.col("idx")).alias("yield"), "n")
    whole = [p for p in patterns if is_word(p, non_ascii_wordsep)] if words and mode == "independent" else []
    others = [p for p in patterns if p not in whole] if len(whole) < len(patterns) else []
    rows = None
    if whole and sum(len(p.pattern) * 4 + 24 for p in whole) <= BROADCAST_BYTES:
        rows = found(_by_words(F.col(text), whole, non_ascii_wordsep))
    elif whole:
        rows = _by_word_join(docs, text, doc_id, whole, non_ascii_wordsep)
    if others or rows is None:
        scanned = found(_by_automaton(F.col(text), others or patterns, non_ascii_wordsep, mode))
        rows = scanned if rows is None else rows.unionByName(scanned)
    table = docs.sparkSession.createDataFrame([(k, p.pattern, p.label) for k, p in by.items()], "idx int, pattern string, yield string")
    size = sum(len(p.pattern) * 4 + len(p.label or "") * 4 + 32 for p in patterns)
    return rows.join(checked_broadcast(table, size), "idx").select("doc_id", "idx", "pattern", "yield", "n")


def match_report(
    docs: DataFrame, patterns: list[Pattern], text: str = "text", doc_id: str = "doc_id", show_patterns: bool = False, invert: bool = False,
    include_matches: bool = False, **how,
) -> DataFrame:
    """(doc_id, label, n, first_idx): hits summed by label, or by pattern where it has none.

    ``show_patterns`` goes by pattern throughout.  ``invert`` gives the documents
    without hits instead, with null label and 0; ``include_matches`` adds the others'
    rows.  A pattern that reads like a label stays apart from it.
    """
    counts = match_counts(docs, patterns, text, doc_id, **how)
    labelled = F.lit(False) if show_patterns else F.col("yield").isNotNull()
    report = (
        counts.groupBy("doc_id", labelled.alias("labelled"), F.when(labelled, F.col("yield")).otherwise(F.col("pattern")).alias("label"))
        .agg(F.sum("n").alias("n"), F.min("idx").alias("first_idx")).drop("labelled")
    )
    if not invert:
        return report
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    without = ids.join(counts.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit(None).cast("string").alias("label"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("first_idx")
    )
    return report.unionByName(without) if include_matches else without
