"""Names of a document found again in its own text: one pass over the tokens with an Aho-Corasick automaton of all names and their variants."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import longest_first

#: Fixed value: a token is a run of word characters or one other character.
TOKEN = re.compile(r"\w+|[^\w\s]")
FOUND = "array<struct<name: string, start: int, end: int>>"
_FOUND = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


class Automaton:
    """All places of many token sequences in one pass: a trie with failure links, and links to the next shorter sequence that ends at the same place."""

    def __init__(self, sequences: Sequence[Sequence[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, tokens in enumerate(sequences):
            at = 0
            for t in tokens:
                if t not in self.next[at]:
                    self.next[at][t] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][t]
            if tokens:
                self.ends[at].append(i)
        self.fail, self.shorter = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for t, to in self.next[at].items():
                back = self.fail[at]
                while back and t not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(t, 0)
                queue.append(to)
            back = self.fail[at]
            self.shorter[at] = back if self.ends[back] else self.shorter[back]

    def find(self, tokens: Iterator[str]) -> Iterator[tuple[int, int]]:
        """(place of the last token, sequence) of every occurrence."""
        at = 0
        for i, t in enumerate(tokens):
            while at and t not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(t, 0)
            hit = at if self.ends[at] else self.shorter[at]
            while hit:
                for s in self.ends[hit]:
                    yield i, s
                hit = self.shorter[hit]


def plurals(token: str) -> tuple[str, ...]:
    """A last token as it is, and with the endings of a plural."""
    return token, token + "s", token + "es"


@lru_cache(256)
def _automaton(sequences: tuple[tuple[str, ...], ...]) -> Automaton:
    """Documents often name the same things."""
    return Automaton(sequences)


def find_in(text: str, names: Sequence[tuple[str, int]], fold: bool, plural: bool, hyphens: bool) -> list[tuple[str, int, int]]:
    """(name, start, end) of the names (with the place from which each counts) in a text, longest first where they overlap, in text order."""
    sequences, owner = [], []
    for i, (name, _) in enumerate(names):
        tokens = TOKEN.findall(name.lower() if fold else name)
        for last in plurals(tokens[-1]) if plural and tokens else tokens[-1:]:
            sequences.append([*tokens[:-1], last])
            owner.append(i)
    if not sequences:
        return []
    places = [m.span() for m in TOKEN.finditer(text)]
    # many names are seldom those of another document, and would fill the memo
    made = tuple(map(tuple, sequences))
    automaton = _automaton(made) if len(made) <= 16 else Automaton(made)
    found = []
    # token by token in lower case: whole texts may change their length
    for i, s in automaton.find(text[a:b].lower() if fold else text[a:b] for a, b in places):
        start, end = places[i - len(sequences[s]) + 1][0], places[i][1]
        name, since = names[owner[s]]
        joined = hyphens and (text[start - 1 : start] == "-" or text[end : end + 1] == "-")
        if start >= since and not joined:
            found.append((start, end, name))
    found.sort()  # the first of equal spans by name
    kept = longest_first([a for a, _, _ in found], [b for _, b, _ in found])
    return [(found[i][2], found[i][0], found[i][1]) for i in kept]


def find_names(text: Column, names: Column, fold: bool = False, plural: bool = False, hyphens: bool = False) -> Column:
    """array<struct<name, start, end>>: places of a document's names in its text, in text order; of overlapping places the longest stays, then the first.

    names: array<struct<name: string, since: int>>; a name counts from the place `since` on. A name matches whole tokens with any white
    space between them, with `fold` in any case, with `plural` also with a plural's ending, and with `hyphens` only where no hyphen joins it to more. Null texts and
    names find nothing; a name without tokens is never found. One pass a text, whatever the number of names.
    """

    def run(texts: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for t, given in zip(texts, names, strict=True):
            known = [(n["name"], n["since"] or 0) for n in given.as_py() or () if n and n["name"]]
            hits = find_in(t.as_py() or "", list(dict.fromkeys(known)), fold, plural, hyphens) if known else []
            out.append([{"name": n, "start": a, "end": b} for n, a, b in hits])
        return pa.array(out, _FOUND)

    return F.arrow_udf(run, FOUND)(text.cast("string"), names.cast("array<struct<name: string, since: int>>"))
