"""Licence scan: matching statistics against an automaton of licence templates.

The templates' words go into one generalised suffix automaton, which is broadcast.
A document's words are streamed through it, which gives the longest run of template
words that ends at each place, and along the suffix links every template place at which
a run of ``MIN_MATCH`` words or more ends.  Runs that can't be made longer are chained,
template by template, over small gaps, and chains that cover enough of a template are
reported.  Words of the document between a chain's runs count against it, so that a
text with something added never reads as the plain one in full.  Only stretches whose
every run of ``MIN_MATCH`` words is in some template are streamed: a match can't lie
elsewhere.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .runtime import small_batches
from .text import doc_chunks, mix, split_words

MIN_MATCH = 3
MIN_COVERAGE = 0.6
MAX_GAP = 12
#: Template words in one automaton; more are scanned in several passes.
AUTOMATON_WORDS = 200_000

_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and
associated documentation files the software to deal in the software without restriction including without
limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
software and to permit persons to whom the software is furnished to do so subject to the following
conditions the above copyright notice and this permission notice shall be included in all copies or
substantial portions of the software"""
_MIT_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not
limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no
event shall the authors or copyright holders be liable for any claim damages or other liability whether in
an action of contract tort or otherwise arising from out of or in connection with the software or the use or
other dealings in the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided
that the following conditions are met redistributions of source code must retain the above copyright
notice this list of conditions and the following disclaimer redistributions in binary form must reproduce
the above copyright notice this list of conditions and the following disclaimer in the documentation and
or other materials provided with the distribution"""
_BSD_NAMES = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission"""
_BSD_ADVERTISING = """all advertising materials mentioning features or use of this software must display the
following acknowledgement this product includes software developed by the organization"""
_BSD_WARRANTY = """this software is provided by the copyright holders and contributors as is and any express or
implied warranties including but not limited to the implied warranties of merchantability and fitness for a
particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any
direct indirect incidental special exemplary or consequential damages including but not limited to
procurement of substitute goods or services loss of use data or profits or business interruption however
caused and on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of such
damage"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is
hereby granted"""
_ISC_NOTICE = " provided that the above copyright notice and this permission notice appear in all copies"
_ISC_WARRANTY = """ the software is provided as is and the author disclaims all warranties with regard to this
software including all implied warranties of merchantability and fitness in no event shall the author be
liable for any special direct indirect or consequential damages or any damages whatsoever resulting from
loss of use data or profits whether in an action of contract negligence or other tortious action arising out
of or in connection with the use or performance of this software"""


def _gnu(kind: str, version: str, what: str = "program", later: bool = True) -> str:
    either = f"either version {version} of the license or at your option any later version" if later else f"version {version} of the license"
    return f"""this {what} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general
public license as published by the free software foundation {either}"""


def _commons() -> list[tuple[str, str]]:
    """Notices and short statements of the Creative Commons licences."""
    parts = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    out = []
    for kind in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        name = "CC-" + kind.upper().replace(" ", "-")
        words = [" ".join(parts[k] for k in kind.split())]
        if kind != "by":  # also as written with spaces or hyphens inside
            words.append(words[0].replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives"))
        if "nd" in kind:
            words.append(words[0].replace("noderivatives", "noderivs"))
        for version in ("4.0", "3.0", "2.5", "2.0"):
            v = version.replace(".", " ")
            port = {"4.0": "international ", "3.0": "unported "}.get(version, "")
            for w in dict.fromkeys(words):
                out.append((f"{name}-{version}", f"licensed under a creative commons {w} {v} {port}license"))
                out.append((f"{name}-{version}", f"licensed under the creative commons {w} {v} {port}license"))
            out.append((f"{name}-{version}", f"licensed under cc {kind} {v}"))
            out.append((f"{name}-{version}", f"http creativecommons org licenses {kind} {v}"))
    return out


def _full_texts() -> list[tuple[str, str]]:
    """(licence, words) of whole licences, from the file beside this module."""
    out: list[tuple[str, list[str]]] = []
    with open(os.path.join(os.path.dirname(__file__), "license_texts.txt"), encoding="utf-8") as f:
        for line in f:
            if line.startswith("== "):
                out.append((line[3:].strip(), []))
            else:
                out[-1][1].append(line.strip())
    return [(name, " ".join(lines)) for name, lines in out]


#: (licence, words) of common notices, short statements and whole licences, in their standard public wording.
#: Marks and case don't count in the scan, so they are left out.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_WARRANTY}"),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "distributed under the mit license"),
    ("Apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance
with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless
required by applicable law or agreed to in writing software distributed under the license is distributed
on an as is basis without warranties or conditions of any kind either express or implied"""),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("BSD-4-Clause", f"{_BSD.split(' redistributions in binary')[0]} {_BSD_ADVERTISING} {_BSD_NAMES}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}"),
    ("ISC", _ISC + _ISC_NOTICE),
    ("ISC", _ISC + _ISC_NOTICE + _ISC_WARRANTY),
    ("0BSD", _ISC + _ISC_WARRANTY),
    ("Zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held
liable for any damages arising from the use of this software permission is granted to anyone to use this
software for any purpose including commercial applications and to alter it and redistribute it freely subject
to the following restrictions the origin of this software must not be misrepresented you must not claim that
you wrote the original software if you use this software in a product an acknowledgment in the product
documentation would be appreciated but is not required altered source versions must be plainly marked as such
and must not be misrepresented as being the original software this notice may not be removed or altered from
any source distribution"""),
    ("BSL-1.0", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license the software to use reproduce display distribute
execute and transmit the software and to prepare derivative works of the software and to permit third parties
to whom the software is furnished to do so all subject to the following"""),
    ("BSL-1.0", "distributed under the boost software license version 1 0"),
    ("GPL-3.0", _gnu("", "3")),
    ("GPL-3.0", _gnu("", "3", later=False)),
    ("GPL-3.0", "licensed under the gnu general public license version 3"),
    ("GPL-2.0", _gnu("", "2")),
    ("GPL-2.0", _gnu("", "2", later=False)),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("LGPL-2.1", _gnu("lesser ", "2 1", "library")),
    ("LGPL-2.1", _gnu("lesser ", "2 1")),
    ("LGPL-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("LGPL-3.0", _gnu("lesser ", "3", "library")),
    ("LGPL-3.0", _gnu("lesser ", "3")),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", _gnu("affero ", "3")),
    ("AGPL-3.0", _gnu("affero ", "3", later=False)),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("MPL-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl
was not distributed with this file you can obtain one at http mozilla org mpl 2 0"""),
    ("EPL-2.0", """this program and the accompanying materials are made available under the terms of the eclipse public license
2 0 which is available at"""),
    ("Unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify
publish use compile sell or distribute this software either in source code form or as a compiled binary
for any purpose commercial or non commercial and by any means"""),
    ("WTFPL", """everyone is permitted to copy and distribute verbatim or modified copies of this license document and
changing it is allowed as long as the name is changed do what the fuck you want to public license"""),
    *_commons(),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    *[(name, f"spdx license identifier {words}") for name, words in (
        ("MIT", "mit"), ("Apache-2.0", "apache 2 0"), ("BSD-2-Clause", "bsd 2 clause"), ("BSD-3-Clause", "bsd 3 clause"), ("ISC", "isc"),
        ("0BSD", "0bsd"), ("Zlib", "zlib"), ("BSL-1.0", "bsl 1 0"), ("GPL-2.0", "gpl 2 0 only"), ("GPL-2.0", "gpl 2 0 or later"),
        ("GPL-2.0", "gpl 2 0"), ("GPL-3.0", "gpl 3 0"), ("GPL-3.0", "gpl 3 0 only"), ("GPL-3.0", "gpl 3 0 or later"), ("LGPL-2.1", "lgpl 2 1"),
        ("LGPL-2.1", "lgpl 2 1 only"), ("LGPL-2.1", "lgpl 2 1 or later"), ("LGPL-3.0", "lgpl 3 0"), ("LGPL-3.0", "lgpl 3 0 only"),
        ("LGPL-3.0", "lgpl 3 0 or later"), ("AGPL-3.0", "agpl 3 0"), ("AGPL-3.0", "agpl 3 0 only"), ("AGPL-3.0", "agpl 3 0 or later"),
        ("MPL-2.0", "mpl 2 0"), ("EPL-2.0", "epl 2 0"), ("Unlicense", "unlicense"), ("WTFPL", "wtfpl"), ("CC0-1.0", "cc0 1 0"),
    )],
    ("Proprietary", "all rights reserved no part of this publication may be reproduced without permission"),
    *_full_texts(),
]


class Templates:
    """The automaton, with the template places at which each state's runs end."""

    def __init__(self, templates: list[tuple[str, str]], min_match: int = MIN_MATCH):
        if min_match < 2:
            raise ValueError("min_match is 2 at least")
        words = split_words(pa.array([t for _, t in templates], pa.large_string()))
        h = words.hashes()
        self.names = [n for n, _ in templates]
        self.lengths = np.diff(words.ptr).tolist()
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h)
        self.automaton = a = SuffixAutomaton()
        self.words = [ids[words.ptr[t] : words.ptr[t + 1]].tolist() for t in range(len(templates))]
        ends: dict[int, set] = defaultdict(set)
        for t, seq in enumerate(self.words):
            for k, state in enumerate(a.add(seq)):
                ends[state].add((t, k))
        for s in a.by_size():  # a link's runs end wherever the state's do
            if s in ends and a.link[s] > 0 and a.size[a.link[s]] >= min_match:
                ends[a.link[s]] |= ends[s]
        self.ends = {s: sorted(e) for s, e in ends.items() if a.size[s] >= min_match}
        self.min_match = min_match
        grams = [self._grams(ids[words.ptr[t] : words.ptr[t + 1]]) for t in range(len(templates))]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each run of min_match ids."""
        n = len(ids) - self.min_match + 1
        out = np.zeros(max(n, 0), np.uint64)
        for k in range(self.min_match if n > 0 else 0):
            out = mix(out ^ ids[k : k + n].astype(np.uint64) + np.uint64(k + 1))
        return out

    def known_runs(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template word of each word, whether the run of min_match words from each is in a template)."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        all_known = known[: len(h) - self.min_match + 1].copy()
        for k in range(1, self.min_match):
            all_known &= known[k : len(h) - self.min_match + 1 + k]
        some = np.flatnonzero(all_known)
        if len(some):
            out = np.zeros(len(some), np.uint64)
            for k in range(self.min_match):
                out = mix(out ^ at[some + k].astype(np.uint64) + np.uint64(k + 1))
            place = np.minimum(np.searchsorted(self.grams, out), len(self.grams) - 1)
            all_known[some] = self.grams[place] == out
        return at, all_known

    def matches(self, h: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Of each template (first word, first template word, words) of the runs of a document that can't be made longer."""
        found: dict[int, list] = defaultdict(list)
        if len(h) < self.min_match or not len(self.grams):
            return found
        at, good = self.known_runs(h)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        size, link, least = self.automaton.size, self.automaton.link, self.min_match
        for first, last in zip(edge[::2].tolist(), edge[1::2].tolist()):
            seq = at[first : last + least - 1].tolist()
            for k, (state, n) in enumerate(self.automaton.matching(seq)):
                after = seq[k + 1] if k + 1 < len(seq) else -1
                seen: set = set()
                while n >= least:
                    for place in self.ends[state]:
                        if place not in seen:
                            seen.add(place)
                            t, e = place
                            words = self.words[t]
                            if e + 1 == len(words) or words[e + 1] != after:
                                found[t].append((first + k - n + 1, e - n + 1, n))
                    state = link[state]
                    n = size[state]
        return found


def chains(matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """(first word, end, covered template words) of the best chains of one template's matches.

    A match is (first word, first template word, words); a chain's matches go forward in
    both, with at most ``max_gap`` words between.  The chain that covers most is taken (of
    equal ones the first), then the best of those that neither touch it nor reach across
    it, until none is left.  Taking one changes only chains that come close to it, so the
    work grows with the matches and not with their square.
    """
    left = sorted(set(matches))
    if not left:
        return []
    n = len(left)
    starts = [m[0] for m in left]
    reach = max(m[2] for m in left) + max_gap
    alive, wall = [True] * n, [0] * n
    score, back, origin = [0] * n, [-1] * n, [0] * n

    def best(i: int) -> tuple[int, int]:
        d, t, k = left[i]
        top, of = k, -1
        for j in range(bisect_left(starts, d - reach), bisect_left(starts, d)):
            e, u, m = left[j]
            if alive[j] and e >= wall[i] and t > u and d + k > e + m and t + k > u + m and d - e - m <= max_gap and t - u - m <= max_gap:
                gain = score[j] + k - max(0, e + m - d, u + m - t)
                if gain > top:
                    top, of = gain, j
        return top, of

    heap: list[tuple[int, int, int]] = []

    def value(i: int) -> bool:
        now = best(i)
        start = starts[i] if now[1] < 0 else origin[now[1]]
        if (score[i], back[i], origin[i]) == (*now, start):
            return False
        (score[i], back[i]), origin[i] = now, start
        heapq.heappush(heap, (-now[0], start, i))
        return True

    for i in range(n):
        value(i)
    out = []
    while heap:
        minus, start, i = heapq.heappop(heap)
        if not alive[i] or (-minus, start) != (score[i], origin[i]):
            continue
        end = starts[i] + left[i][2]
        out.append((start, end, -minus))
        # matches that touch it go; those behind it don't reach across it
        low = bisect_left(starts, start - reach)
        k, until = low, end + reach
        while k < n and starts[k] <= until:
            if alive[k]:
                if starts[k] < end and starts[k] + left[k][2] > start:
                    alive[k] = False
                elif starts[k] >= end:
                    wall[k] = max(wall[k], end)
                    if value(k):
                        until = max(until, starts[k] + reach)
            k += 1
    return out


def spans(h: np.ndarray, t: Templates, min_coverage: float, max_gap: int) -> list[tuple[str, int, int, int, float]]:
    """(licence, first word, end, matched words, coverage) of one document, before ``best_spans``."""
    out = []
    for template, found in t.matches(h).items():
        if sum(m[2] for m in found) < min_coverage * t.lengths[template]:
            continue
        for start, end, covered in chains(found, max_gap):
            share = covered / (t.lengths[template] + max(0, end - start - covered))
            if share >= min_coverage:
                out.append((t.names[template], start, end, covered, min(share, 1.0)))
    return out


def best_spans(found: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, int, int, float]]:
    """Those that aren't overlapped by half by one of more matched words (then coverage, then name)."""
    kept: list = []
    near: dict[int, list] = defaultdict(list)  # by stretches of 256 words
    for s in sorted(found, key=lambda s: (-s[3], -s[4], s[0], s[1])):
        places = range(s[1] // 256, (s[2] - 1) // 256 + 1)
        if all(min(s[2], k[2]) - max(s[1], k[1]) < 0.5 * (s[2] - s[1]) for p in places for k in near[p]):
            kept.append(s)
            for p in places:
                near[p].append(s)
    return sorted(kept, key=lambda s: (s[1], s[0]))


_FIELDS = "license string, start_word long, end_word long, matched long, coverage double"


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "license", "start_word", "end_word", "matched", "coverage"])


def license_spans(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text", doc_id: str = "doc_id",
    min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, max_gap: int = MAX_GAP, automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """(doc_id, license, start_word, end_word, matched, coverage) of every licence text found.

    Words start_word:end_word of the document hold at least ``min_coverage`` of a
    template's words in matches of ``min_match`` words and more; coverage is the share of
    the template's words and of the document's words between the matches, together, that
    match.  Where spans overlap by half, the one of more matched words stays (of as many
    the one of more coverage, then the first by name); a licence found twice in a document
    is two rows.  Texts of any length are scanned whole.  A template of fewer than
    ``min_match`` words raises ValueError.  Null, empty and wordless texts give none, repeated rows repeated
    ones, a null id stays null, empty tables (also of templates) no rows.  Columns
    that aren't named are not read.  Templates beyond ``automaton_words`` are scanned
    in groups, one automaton after another.
    """
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, {_FIELDS}"
    groups: list[list[tuple[str, str]]] = [[]]
    size = 0
    for name, t in templates:
        words = len(split_words(pa.array([t], pa.large_string())).starts)
        if words < min_match:
            raise ValueError(f"a template of {name} has fewer than {min_match} words")
        if groups[-1] and size + words > automaton_words:
            groups.append([])
            size = 0
        groups[-1].append((name, t))
        size += words
    single = len(groups) == 1
    rows = small_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    if not single:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
    context = docs.sparkSession.sparkContext

    def scan(group: list[tuple[str, str]]):
        shared = context.broadcast(Templates(group, min_match))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for batch in batches:
                for chunk in doc_chunks(batch, "text"):
                    w = split_words(chunk.column("text"))
                    h = w.hashes()
                    at, out = [], []
                    for d in _candidates(h, w.ptr, t):
                        found = spans(h[w.ptr[d] : w.ptr[d + 1]], t, min_coverage, max_gap)
                        found = best_spans(found) if single else found
                        at += [d] * len(found)
                        out += found
                    if out:
                        ids = chunk.column("doc_id").take(pa.array(at))
                        got = _batch(ids, out)
                        yield got if single else got.append_column("row", chunk.column("row").take(pa.array(at)))

        return run

    if single:
        return rows.mapInArrow(scan(groups[0]), schema)
    found = None
    for group in groups:
        part = rows.mapInArrow(scan(group), schema + ", row long")
        found = part if found is None else found.unionByName(part)

    def resolve(t: pa.Table) -> pa.Table:
        r = best_spans([tuple(x.values()) for x in t.select(["license", "start_word", "end_word", "matched", "coverage"]).to_pylist()])
        return pa.Table.from_batches([_batch(t.column("doc_id").combine_chunks().slice(0, 1).take(pa.array([0] * len(r))), r)])

    return found.groupBy("row").applyInArrow(resolve, schema)


def _candidates(h: np.ndarray, ptr: np.ndarray, t: Templates) -> np.ndarray:
    """Documents with a run of ``min_match`` words that is in a template; the others can't match."""
    if len(h) < t.min_match or not len(t.grams):
        return np.zeros(0, np.int64)
    return np.unique(np.searchsorted(ptr, np.flatnonzero(t.known_runs(h)[1]), side="right") - 1)
