"""Licence scan: matching statistics against a suffix automaton of licence wordings, chained into spans.

The automaton holds the wordings below and the base phrases (some two thousand words, sent with
the task). Texts stream through it word by word; a word outside the vocabulary resets it
at the price of one dictionary lookup. A base phrase ends at a word exactly if its state lies
on the suffix-link path of the current state, so all places are found in the same pass. Maximal matches of
`min_match` words and more are chained per wording, left to right in the text: a match goes on a chain that ends
at most `max_gap` words before it, at the next place of its words in the wording; what it shares with
the chain's last words is trimmed. A chain that covers `min_cover` of its wording becomes
a span, and of spans that share words with one that covers more words of the text only the latter stays.
No shuffle: one scan, each text in one row.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_automaton import SuffixAutomaton

#: Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public licence texts and the notices by which works refer to them, by label.
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_FORMS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_KEEP = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_HOLDERS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version"
_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details you should have received a copy of the gnu {0} along with this program if not see https www gnu org licenses"
_CC = "this work is licensed under a creative commons {0} 4 0 international license"
_CC_LONG = "to view a copy of this license visit http creativecommons org licenses {0} 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa"
WORDINGS = {
    "mit": (f"{_GRANT} {_AS_IS}", _GRANT, "released under the mit license", "licensed under the mit license", "the mit license mit"),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2 0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution",
    ),
    "gpl": (
        f"this program is free software {_GNU.format('general public license', '3')} this program {_HOPE.format('general public license')}", f"this program is free software {_GNU.format('general public license', '2')}",
        "licensed under the gnu general public license", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc",
    ),
    "lgpl": (f"this library is free software {_GNU.format('lesser general public license', '2 1')} this library {_HOPE.format('lesser general public license')}", "licensed under the gnu lesser general public license"),
    "agpl": (f"this program is free software {_GNU.format('affero general public license', '3')} this program {_HOPE.format('affero general public license')}", "licensed under the gnu affero general public license"),
    "bsd": (f"{_FORMS} {_KEEP} {_HOLDERS}", f"{_FORMS} {_KEEP} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_HOLDERS}", _FORMS, "licensed under the bsd license", "licensed under the 3 clause bsd license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "licensed under the isc license"),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost": ("distributed under the boost software license version 1 0",),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "licensed under the mozilla public license"),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license",),
    "cc-by": (_CC.format("attribution"), _CC_LONG.format("by"), "licensed under cc by 4 0"),
    "cc-by-sa": (_CC.format("attribution sharealike"), _CC_LONG.format("by sa"), "licensed under cc by sa 4 0"),
    "cc-by-nc": (_CC.format("attribution noncommercial"), _CC_LONG.format("by nc"), "licensed under cc by nc 4 0"),
    "cc-by-nd": (_CC.format("attribution noderivatives"), _CC_LONG.format("by nd"), "licensed under cc by nd 4 0"),
    "cc-by-nc-sa": (_CC.format("attribution noncommercial sharealike"), _CC_LONG.format("by nc sa"), "licensed under cc by nc sa 4 0"),
    "cc-by-nc-nd": (_CC.format("attribution noncommercial noderivatives"), _CC_LONG.format("by nc nd"), "licensed under cc by nc nd 4 0"),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0 1 0 universal public domain dedication"),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "this is free and unencumbered software released into the public domain"),
    "wtfpl": ("do what the fuck you want to public license terms and conditions for copying distribution and modification",),
}
MIN_MATCH, MIN_COVER, MAX_GAP = 3, 0.75, 8

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])))])
SCHEMA = "doc_id long, n_words long, base array<struct<label string, start long>>, spans array<struct<label string, start long, end long, cover double>>"


class Scanner:
    def __init__(self, base: dict[str, str], wordings: dict[str, tuple[str, ...]], min_match: int, min_cover: float, max_gap: int):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.automaton = a = SuffixAutomaton()
        self.label: list[str | None] = []
        for label, texts in wordings.items():
            for text in texts:
                a.add(text.encode().split())
                self.label.append(label)
        for phrase in base:
            a.add(phrase.encode().split())
            self.label.append(None)
        a.place(text.encode().split() for text in [*(t for texts in wordings.values() for t in texts), *base])
        held = {a.state_of(p.encode().split()): (len(p.split()), label) for p, label in base.items()}
        self.ends = [[(s == own, *held[s]) for s in a.ancestors(own) if s in held] for own in range(len(a.next))]
        self.vocabulary = frozenset(w for after in a.next for w in after)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        a, known, state, length = self.automaton, self.vocabulary, 0, 0
        base, matches, last = [], [], -1
        for i, w in enumerate(words):
            if w not in known:
                continue
            if i != last + 1 and state:
                self._close(matches, state, length, last + 1)
                state = length = 0
            last = i
            to, n = a.step(state, length, w)
            if n <= length and length:
                self._close(matches, state, length, i)
            state, length = to, n
            for own, size, label in self.ends[state]:
                if not own or length >= size:
                    base.append((label, i + 1 - size))
        if state:
            self._close(matches, state, length, last + 1)
        return base, self._chain(matches)

    def _close(self, matches: list, state: int, length: int, end: int) -> None:
        if length >= self.min_match:
            matches.append((state, length, end))

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        a, found = self.automaton, []
        open_: dict[int, tuple[int, int, int, int]] = {}  # by wording: start, end, words covered, place in the wording after them

        def done(number: int, start: int, end: int, covered: int, _: int) -> None:
            if covered >= self.min_cover * a.sizes[number]:
                found.append((covered, start, end, number))

        for state, length, end in matches:
            for number, places in a.places[state].items():
                if self.label[number] is None:
                    continue
                start = end - length
                if held := open_.get(number):
                    shared = max(0, held[1] - start)
                    at = bisect_left(places, held[3] + length - shared)
                    if start - held[1] <= self.max_gap and at < len(places):
                        open_[number] = (held[0], end, held[2] + length - shared, places[at])
                        continue
                    done(number, *held)
                open_[number] = (start, end, length, places[0])
        for number, held in open_.items():
            done(number, *held)
        return self._apart(found)

    def _apart(self, found: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The spans left when those with the most covered words are taken first and what overlaps them goes."""
        starts: list[int] = []
        ends: list[int] = []
        out = []
        for covered, start, end, number in sorted(found, key=lambda f: (-f[0], -f[0] / self.automaton.sizes[f[3]], f[1], f[3])):
            i = bisect_left(ends, start + 1)
            if i < len(starts) and starts[i] < end:
                continue
            starts.insert(i, start)
            ends.insert(i, end)
            out.append((self.label[number], start, end, covered / self.automaton.sizes[number]))
        return sorted(out, key=lambda x: (x[1], x[0]))


def _scan(*args):
    def run(batches):
        scanner = Scanner(*args)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text.lower()) if text else []
                base, spans = scanner.scan(words)
                rows.append((doc, len(words), [{"label": x, "start": s} for x, s in base], [{"label": x, "start": s, "end": e, "cover": c} for x, s, e, c in spans]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_SCHEMA)], schema=_SCHEMA)

    return run


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, wordings: dict[str, tuple[str, ...]] | None = None, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, base (label, start word of each phrase place), spans (label, start, end, cover).

    Words are runs of characters other than ASCII non-alphanumerics, after A-Z are lower-cased.
    Null and empty texts have no words, places or spans. Repeated rows stay apart; extra columns
    are ignored; an empty table gives no rows.
    """
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return cols.mapInArrow(_scan(BASE if base is None else base, WORDINGS if wordings is None else wordings, min_match, min_cover, max_gap), SCHEMA)


def license_digest(scanned: DataFrame) -> DataFrame:
    """The query's columns: counts, bounds and labels. score is 1 with a base phrase, else the best cover of a span, else 0."""
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    words = F.col("base.start")
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        labels("base.label").alias("base_labels"), labels("base.label", "spans.label").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.cover"), F.lit(0.0))).alias("score"), "spans",
    )
