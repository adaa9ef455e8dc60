"""Layout of plain text: pages, wrapped lines, columns of fixed width.

All of it is local to a document, so nothing is shuffled and streams work too.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import in_slices

_BLANK = " \t\n\x0b\f\r"
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}


def unescaped(sep: str) -> str:
    """A separator as written on a command line, with escapes such as ``\\f``."""
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), sep)


def pages(df: DataFrame, sep: str = "\f", text: str = "text", keep_empty: bool = False) -> DataFrame:
    """``df`` with a row for each page of a text: ``text`` is the page, ``page_no`` its number from 1.

    A line end behind a separator belongs to it.  Empty pages count but are left out
    unless ``keep_empty``.
    """
    others = [c for c in df.columns if c not in (text, "page_no")]
    split = df.select(*others, F.posexplode(F.split(text, f"\\Q{sep}\\E\n?", -1)).alias("k", text))
    out = split.select(*others, (F.col("k") + 1).cast("int").alias("page_no"), text)
    return out if keep_empty else out.filter(F.col(text) != "")


def unwrap_step(line: str, held: str) -> tuple[list[str], str]:
    """(lines to print, open paragraph) after one more line."""
    body = line.lstrip(_BLANK)
    indent = len(line) - len(body)
    trimmed = body.rstrip(_BLANK)
    if len(trimmed) <= 80 and indent < 4 and ((trimmed and held) or len(trimmed) >= 60):
        held += trimmed
        return ([held], "") if trimmed.endswith(".") else ([], held + " ")
    out = [held] if held else []
    if len(trimmed) <= 80 and indent >= 4:
        body = line if trimmed else ""
    return [*out, body if trimmed else ""], ""


def unwrapped(lines: list[str]) -> list[str]:
    """Lines of at least 60 characters, and those that follow, joined up to one that ends in a full stop.

    Lines of over 80 characters, indented by four or more, and blank ones stand alone
    and end a paragraph; so does the end of the text.
    """
    out, held = [], ""
    for line in lines:
        more, held = unwrap_step(line, held)
        out += more
    return out + ([held] if held else [])


def text_lines(text: str | None) -> list[str]:
    """Lines of a text; a last one without its line end counts."""
    if not text:
        return []
    found = text.split("\n")
    return found[:-1] if found[-1] == "" else found


def unwrap(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the lines of each text unwrapped; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else "".join(x + "\n" for x in unwrapped(text_lines(t))) for t in texts.to_pylist()], pa.string())

    return df.withColumn(text, F.arrow_udf(lambda texts: in_slices(run, texts), "string")(F.col(text)))


def gaps(line: str, delim: str) -> list[tuple[int, int]]:
    """Where the runs of the delimiter are, but one at the line's end."""
    found = [m.span() for m in re.finditer(re.escape(delim) + "+", line)]
    return found[:-1] if found and found[-1][1] == len(line) else found


def common_gaps(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlaps of two lines' gaps, one for each gap at most; ``y`` if there is none.

    Of two gaps the one that ends first is done with; if the next gap on its side begins
    before the other one's end, the other one waits for it.
    """
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        a, b = x[i], y[j]
        i += a[1] <= b[1]
        j += b[1] <= a[1]
        if a[1] < b[1]:
            if i < len(x) and x[i][0] < b[1]:
                continue
            j += 1
        elif b[1] < a[1]:
            if j < len(y) and y[j][0] < a[1]:
                continue
            i += 1
        lo, hi = max(a[0], b[0]), min(a[1], b[1])
        if lo < hi:
            out.append((lo, hi))
    return out or y


def fields(line: str, cuts: list[tuple[int, int]], delim: str) -> list[str]:
    """The parts of a line between the gaps, without the delimiter around them."""
    out, at = [], 0
    for lo, hi in cuts:
        out.append(line[at:lo].strip(delim))
        at = hi
    return [*out, line[at:].strip(delim)]


def column_fields(lines: list[str], delim: str = " ", mode: str = "running") -> list[list[str]]:
    """The fields of every line.

    ``running``: a line is cut at the gaps common to it and all before it; ``global``: all
    lines are cut at the gaps common to all.
    """
    state: list[tuple[int, int]] = []
    states = []
    for line in lines:
        state = common_gaps(state, gaps(line, delim))
        states.append(state)
    if mode == "global" and states:
        states = [states[-1]] * len(states)
    elif mode not in ("running", "global"):
        raise ValueError("mode is 'running' or 'global'")
    return [fields(line, s, delim) for line, s in zip(lines, states)]


def split_columns(df: DataFrame, delim: str = " ", mode: str = "running", text: str = "text", by_bytes: bool = False) -> DataFrame:
    """df's columns but ``text``, with a row (line_no, fields) for each line, line_no from 1.

    Places in a line are counted in characters, or in bytes if ``by_bytes``; characters that
    a cut between bytes breaks are replaced.
    """
    if mode not in ("running", "global"):
        raise ValueError("mode is 'running' or 'global'")

    def split(t: str) -> list[list[str]]:
        if not by_bytes:
            return column_fields(text_lines(t), delim, mode)
        found = column_fields(text_lines(t.encode().decode("latin-1")), delim.encode().decode("latin-1"), mode)
        return [[x.encode("latin-1").decode("utf-8", "replace") for x in line] for line in found]

    def run(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else split(t) for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.list_(pa.string())))

    others = [c for c in df.columns if c not in (text, "line_no", "fields")]
    split = df.select(*others, F.posexplode(F.arrow_udf(lambda texts: in_slices(run, texts), "array<array<string>>")(F.col(text))).alias("k", "fields"))
    return split.select(*others, (F.col("k") + 1).cast("bigint").alias("line_no"), "fields")


def joined_fields(df: DataFrame, delim: str = "\t") -> DataFrame:
    """``df`` with the fields joined to ``line``."""
    return df.withColumn("line", F.array_join("fields", delim)).drop("fields")
