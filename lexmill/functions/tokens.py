"""Tokenising as Column expressions: everything stays in the JVM.

The patterns repeat single character classes only, never groups: Java's matcher
recurses for a repeated group and would exhaust its stack on a long token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII signs that may stand inside a term.
INNER = r"!#$%&'*+,./:=?@\\\^_`|"
_OUTSIDE = r"&&[^\x{3401}-\x{4dbe}\x{4e01}-\x{9ffe}\x{ac01}-\x{d7a2}\x{10000}-\x{10ffff}]"
_ASCII = "A-Za-z0-9"
_WIDE = r"\x{80}-\x{10ffff}"


def term_regex(unicode: str = "full") -> str:
    """Terms: a letter or digit, then letters, digits and inner signs up to the last letter or digit; U+FFFD is as a blank.

    ``unicode='compat'`` leaves out ideographs, Hangul and all beyond the basic plane.
    """
    if unicode not in ("full", "compat"):
        raise ValueError("unicode is 'full' or 'compat'")
    less = _OUTSIDE if unicode == "compat" else ""
    edge = rf"[[\p{{L}}\p{{N}}]{less}]"
    inner = rf"[[\p{{L}}\p{{N}}{INNER}[[^\x00-\x7f\x{{fffd}}]&&[\p{{P}}\p{{S}}]]]{less}]"
    return f"{edge}(?:{inner}*{edge})?"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, unicode: str = "full", normal: bool = False) -> Column:
    """Array of the terms of a text, in order; null for a null text."""
    found = F.regexp_extract_all(_column(text), F.lit(term_regex(unicode)), F.lit(0))
    return F.transform(found, normal_form) if normal else found


def normal_form(term: Column | str) -> Column:
    """Lower case for terms with a letter that is neither upper nor title case; others stay (AG, 1990)."""
    c = _column(term)
    return F.when(c.rlike(r"[\p{L}&&[^\p{Lu}\p{Lt}]]"), F.lower(c)).otherwise(c)


def fast_tokens(text: Column | str) -> Column:
    """Array of terms by ASCII classes alone.

    Non-ASCII characters are glue: they belong to the word they touch, and make no word
    of their own.
    """
    lone = rf"(?<![{_ASCII}{_WIDE}])[{_WIDE}]++(?![{_ASCII}])"
    word = f"[{_ASCII}{_WIDE}]"
    clean = F.regexp_replace(_column(text), lone, " ")
    return F.regexp_extract_all(clean, F.lit(f"{word}(?:[{_ASCII}{_WIDE}{INNER}]*{word})?"), F.lit(0))


def ngram_array(terms: Column | str, n: int) -> Column:
    """Array of all runs of ``n`` neighbouring terms, joined by a space; empty if there are too few."""
    if n < 1:
        raise ValueError("n is 1 at least")
    t = _column(terms)
    if n == 1:
        return t
    last = F.size(t) - n
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def term_hash(term: Column | str) -> Column:
    """Sixteen hexadecimal digits, as two words with a plus between, of a 64-bit hash of the text."""
    digits = F.lpad(F.lower(F.hex(F.xxhash64(_column(term)))), 16, "0")
    return F.concat(F.substring(digits, 9, 8), F.lit("+"), F.substring(digits, 1, 8))
