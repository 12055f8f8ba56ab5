"""License scans: patience alignment of license notices with whole texts."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import importable, text_or_empty

TOKEN = re.compile(r"[^\W_]+")
#: Notices by license. Fixed values.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "MPL-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: Words that tell a notice from its like: each phrase has to be aligned word by word. Fixed values.
REQUIRED = {
    "MIT": (("mit",),),
    "Apache-2.0": (("apache",), ("2", "0")),
    "GPL-3.0": (("gnu", "general"), ("version", "3")),
    "CC-BY-NC-4.0": (("cc", "by", "nc", "4", "0"),),
    "MIT-text": (("this", "software"),),
    "Apache-2.0-text": (("apache",), ("2", "0")),
    "GPL-text": (("gnu", "general"),),
    "MPL-2.0-text": (("mozilla",), ("2", "0")),
    "ISC-text": (("with", "or", "without", "fee"),),
    "MIT-full": (("free", "of", "charge"),),
    "ISC-full": (("with", "or", "without", "fee"),),
    "BSD-3-full": (("endorse", "or", "promote"),),
}


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly rising subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Rising pairs (place in template, place in text) of equal words.

    Anchors are words that occur once in either; a longest chain of them that rises in both is kept, and the gaps between, before and
    after are aligned likewise. A gap without anchors is aligned from its ends as far as words agree. Gaps wait on a stack.
    """
    found: list[tuple[int, int]] = []
    gaps = [(0, len(template), 0, len(text))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and template[a0] == text[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and template[a1 - 1] == text[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ours, theirs = Counter(template[a0:a1]), Counter(text[b0:b1])
        place = {w: b for b, w in enumerate(text[b0:b1], b0) if theirs[w] == 1}
        anchors = [(a, place[w]) for a, w in enumerate(template[a0:a1], a0) if ours[w] == 1 and w in place]
        chain = [anchors[i] for i in rising([b for _, b in anchors])]
        found += chain
        for (a, b), (c, d) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]) if chain else ():
            if c - a > 1 and d - b > 1:
                gaps.append((a + 1, c, b + 1, d))
    return sorted(found)


def _holds(pairs: list[tuple[int, int]], notice: list[str], phrases: Sequence[tuple[str, ...]]) -> bool:
    """Whether each phrase is aligned word by word, without other words between in the text."""
    at = dict(pairs)
    for phrase in phrases:
        n = len(phrase)
        runs = (i for i in range(len(notice) - n + 1) if tuple(notice[i : i + n]) == phrase and i in at)
        if not any(all(at.get(i + k) == at[i] + k for k in range(n)) for i in runs):
            return False
    return True


def notice_places(tokens: list[str], notice: list[str], marks: Mapping[str, list[int]], least: float, phrases: Sequence[tuple[str, ...]] = ()) -> list[tuple[float, int, int]]:
    """(coverage, first word, word after the last) of the places where ``least`` or more of the notice is aligned; none overlap.

    ``marks`` are words, each with its places in the text, of which any place of the notice holds one. The notice is aligned with the whole
    text, with what lies between a mark's neighbours of the same word (where it is unique), and about each mark with windows that have or
    have not half a notice on either side. The best covered and shortest places are taken first, and what is left of the text is aligned
    again until nothing reaches ``least``.
    """
    taken: list[tuple[float, int, int]] = []
    margin, size = len(notice) // 2 + 1, len(notice)
    spans = {(0, len(tokens))}
    for w, at in marks.items():
        spans.update((a + 1, b) for a, b in zip([-1, *at], [*at[1:], len(tokens)]))
        for start in {max(0, p - i) for p in at for i, x in enumerate(notice) if x == w}:
            spans.update((max(0, start - m), min(len(tokens), start + size + n)) for m in (0, margin) for n in (0, margin))
    while True:
        found, ends = set(), [(0, 0), *((f, e) for _, f, e in taken), (len(tokens), len(tokens))]
        free = [(a, b) for (_, a), (b, _) in zip(ends, ends[1:]) if b > a]
        starts = [a for a, _ in free]
        windows = set()
        for lo, hi in spans:  # as far as they are free
            k = max(0, bisect_right(starts, lo) - 1)
            while k < len(free) and free[k][0] < hi:
                windows.add((max(lo, free[k][0]), min(hi, free[k][1])))
                k += 1
        for lo, hi in windows:
            pairs = align(notice, tokens[lo:hi]) if hi - lo >= least * size - 1e-9 else []
            if pairs and len(pairs) / size >= least and _holds(pairs, notice, phrases):
                found.add((-len(pairs) / size, pairs[-1][1] - pairs[0][1], lo + pairs[0][1]))
        new: list[tuple[float, int, int]] = []
        for share, span, first in sorted(found):
            if all(first + span < f or first >= e for _, f, e in new):
                new.append((-share, first, first + span + 1))
        if not new:
            return taken
        taken = sorted(taken + new, key=lambda x: x[1])


def all_notices(tokens: list[str], notices: Mapping[str, list[str]], least: float, required: Mapping[str, Sequence[tuple[str, ...]]] = {}) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, word after the last) of every place of every notice, by place.

    A notice is left out only if more of its words are missing from the text than ``least`` allows, or one of its required phrases.
    Else a place of it lacks few of its words, so it holds one of its rarest words in the text, and each word of its phrases.
    """
    out: list[tuple[str, float, int, int]] = []
    present = set(tokens)
    places: dict[str, list[int]] | None = None
    for name, notice in notices.items():
        own, needed = set(notice), {w for phrase in required.get(name, ()) for w in phrase}
        spare = int((1 - least) * len(notice) + 1e-9)
        if not notice or not needed <= present or sum(w not in present for w in notice) > spare:
            continue
        if places is None:
            places = {}
            known = set().union(*notices.values())
            for i, w in enumerate(tokens):
                if w in known:
                    places.setdefault(w, []).append(i)
        rarest = sorted(needed or own, key=lambda w: (len(places.get(w, ())), w))[: 1 if needed else spare + 1]
        marks = {w: places[w] for w in rarest if w in places}
        out += [(name, *place) for place in notice_places(tokens, notice, marks, least, required.get(name, ()))]
    return sorted(out, key=lambda x: (x[2], x[3]))


def license_scan(docs: DataFrame, notices: Mapping[str, str] = NOTICES, least: float = 0.8, required: Mapping[str, Sequence[tuple[str, ...]]] = REQUIRED) -> DataFrame:
    """doc_id, license, coverage, first_word, end_word, found for each row of ``docs`` (doc_id, text).

    ``found`` has each place of each notice that an alignment covers by ``least`` or more, with the notice's ``required`` phrases (see :func:`all_notices`), as (license, coverage,
    first_word, end_word) by place in the text's words; places of one notice don't overlap. The columns before are the best
    covered of these, ties going to the longer notice, then to the first notice and place. A text with none has a null license, coverage
    0.0, null places and nothing found. So do null and empty texts. Repeated rows give a row each; an empty table gives none;
    other columns are ignored.
    """
    importable(docs.sparkSession)
    cut = {name: words(text) for name, text in notices.items()}
    order = {name: i for i, name in enumerate(cut)}
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [all_notices(words(x), cut, least, required) for x in b.column(1).to_pylist()]
            best = [min(f, key=lambda x: (-x[1], -len(cut[x[0]]), order[x[0]], x[2]), default=(None, 0.0, None, None)) for f in every]
            name, share, first, end = zip(*best) if best else ((), (), (), ())
            found = pa.array([[dict(zip(("license", "coverage", "first_word", "end_word"), x)) for x in f] for f in every], kind)
            columns = [b.column(0), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64()), found]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "license", "coverage", "first_word", "end_word", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    place = "license string, coverage double, first_word long, end_word long"
    return rows.mapInArrow(run, f"doc_id long, {place}, found array<struct<{place.replace(' string', ': string').replace(' double', ': double').replace(' long', ': long')}>>")
