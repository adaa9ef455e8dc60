"""Porter's suffix stripping (1980) over dictionaries of words.

Three departures: words of one or two letters stay, ``bli`` becomes ``ble`` (not
only ``abli`` ``able``), and ``logi`` becomes ``log``.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)
_LOWER = {c: c + 32 for c in range(65, 91)}


def _shape(word: str) -> str:
    """c and v for the letters: y is a consonant at the start and behind a vowel."""
    out = []
    for k, ch in enumerate(word):
        if ch in "aeiou":
            out.append("v")
        elif ch == "y":
            out.append("c" if k == 0 or out[-1] == "v" else "v")
        else:
            out.append("c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) >= least else word
    return word


def porter(word: str) -> str:
    """The stem of a word, whose ASCII letters are lowered first."""
    w = word.translate(_LOWER)
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, _STEP2, 1)
    w = _replaced(w, _STEP3, 1)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem(term: Column | str) -> Column:
    """Column of the stems; each distinct word of an Arrow batch is stemmed once."""

    def stems(words: pa.Array) -> pa.Array:
        d = pc.dictionary_encode(words)
        if isinstance(d, pa.ChunkedArray):
            d = d.combine_chunks()
        table = pa.array([porter(w) for w in d.dictionary.to_pylist()], pa.string())
        return table.take(d.indices)

    return F.arrow_udf(stems, "string")(F.col(term) if isinstance(term, str) else term)
