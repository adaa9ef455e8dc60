"""The pattern language: ``"[*]word[*]"[i] [-> "label"]``, one pattern a line."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "idx int, pattern string, ci boolean, left boolean, right boolean, yield string"


@dataclass(frozen=True)
class Pattern:
    """``left`` and ``right`` say that the word may go on on that side; ``ci`` ignores ASCII case."""

    idx: int
    pattern: str
    ci: bool = False
    left: bool = False
    right: bool = False
    label: str | None = None


def _quoted(text: str, at: int) -> tuple[str, int]:
    """(what stands between the quotes, place behind them) of the quote at ``at``."""
    k = at + 1
    while k < len(text):
        if text[k] == "\\":
            k += 2
            continue
        if text[k] == '"':
            return text[at + 1 : k], k + 1
        if text[k] == "\n":
            raise ValueError(f"a line ends within quotes at {k}")
        k += 1
    raise ValueError(f"the quote at {at} isn't closed")


def _word(raw: str, ci: bool) -> Pattern:
    left = raw.startswith("*")
    body = raw[1:] if left else raw
    right = body.endswith("*") and not body.endswith("\\*")
    body = (body[:-1] if right else body).replace("\\", "")
    if not body:
        raise ValueError("a pattern without characters")
    return Pattern(0, body, ci, left, right)


def parse_patterns(text: str) -> list[Pattern]:
    """The patterns of a text, in order.

    Everything outside quotes but ``->``, the ``i`` behind a quote and line ends is
    ignored, so comments need no sign; a backslash before a line end continues the
    line.  Of several words on a line the last counts, as of several labels; labels
    that aren't quoted are none.  A word that was there before keeps its place and gets
    the new flags and label.  Raises ValueError for quotes that a line doesn't close,
    for empty patterns and for texts without any.
    """
    found: dict[str, Pattern] = {}
    word: Pattern | None = None
    label: str | None = None
    labelling = False

    def commit() -> None:
        nonlocal word, label, labelling
        if word is not None:
            found[word.pattern] = replace(word, label=label)
        word, label, labelling = None, None, False

    k = 0
    while k < len(text):
        c = text[k]
        if c == '"':
            raw, k = _quoted(text, k)
            if labelling:
                label = raw
            else:
                ci = text[k : k + 1] == "i"
                word = _word(raw, ci)
                k += ci
        elif text.startswith("->", k):
            labelling = True
            k += 2
        elif c == "\\":
            k += 2
        else:
            if c == "\n":
                commit()
            k += 1
    commit()
    if not found:
        raise ValueError("no patterns")
    return [replace(p, idx=i) for i, p in enumerate(found.values())]


def read_patterns(spark: SparkSession, path: str) -> list[Pattern]:
    """The patterns of a file that Spark can read."""
    return parse_patterns("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def select_patterns(patterns: list[Pattern], keep: Callable[[Pattern], bool]) -> list[Pattern]:
    """Those that ``keep`` accepts, with the numbers they had."""
    return [p for p in patterns if keep(p)]


def patterns_df(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    """The patterns as a table."""
    return spark.createDataFrame([(p.idx, p.pattern, p.ci, p.left, p.right, p.label) for p in patterns], SCHEMA)
