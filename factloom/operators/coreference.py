"""Coreference chains from raw sentences: sieves from strict to loose, over clusters that carry what their mentions have fixed.

Mentions are names, definite noun phrases and pronouns. Each sieve links a mention that still begins its cluster to an earlier cluster, nearest first: equal text, then the
same head with no new words, then the head among the cluster's words, then pronouns by number, person and distance. Clusters are a union-find whose roots hold the
number, the kind and the words of all their mentions; a union that would mix two numbers, or things and people, is refused. A document is one group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(\"“])")
_ABBREVIATED = re.compile(r"\b(?:Inc|Corp|Co|Ltd|No|Mr|Mrs|Ms|Dr)\.$")
#: Word lists of the language.
ENDINGS = frozenset("inc corp co ltd llc lp plc company corporation".split())
TITLES = {"mr": "he", "mrs": "she", "ms": "she", "dr": "person"}
DETERMINERS = frozenset("the this that these those such our its their".split())
PRONOUNS = {
    "it": ("one", "thing"), "its": ("one", "thing"), "itself": ("one", "thing"), "they": ("many", None), "them": ("many", None), "their": ("many", None),
    "he": ("one", "he"), "him": ("one", "he"), "his": ("one", "he"), "she": ("one", "she"), "her": ("one", "she"), "hers": ("one", "she"),
}
PEOPLE = frozenset("officer director holder stockholder shareholder president chairman agent".split())
#: Words that never head a phrase of their own.
_NOT_HEADS = frozenset("of to in on at by for from with and or is are was were be been has have had will may shall can not as that which who whose any all each other same".split())
_TOKEN = re.compile(r"[A-Za-z][\w&'’-]*\.?|[^\w\s]|\d[\w.,]*")
#: Sentences between a pronoun and what it stands for.
REACH = 3


class Mention(NamedTuple):
    sentence: int
    start: int
    end: int
    text: str
    kind: str
    head: str
    words: frozenset[str]
    number: str | None
    being: str | None


def sentence_places(text: str) -> list[tuple[int, int]]:
    out, lo = [], 0
    for m in _SENTENCE.finditer(text):
        if not _ABBREVIATED.search(text[lo : m.start()]):
            out.append((lo, m.start()))
            lo = m.end()
    return [*out, (lo, len(text))] if text[lo:].strip() else out


def _bare(token: str) -> str:
    return token.rstrip(".").lower()


def _singular(head: str) -> str:
    return head[:-1] if head.endswith("s") and not head.endswith(("ss", "us", "is")) else head


def mentions(text: str) -> list[Mention]:
    """Names (capitalised words, an ending such as Corp. included), definite noun phrases and pronouns, in text order. A lone capital at a sentence's start is a name where a name elsewhere holds the word."""
    sure = _mentions(text, frozenset())
    known = frozenset(w for m in sure if m.kind == "name" for w in m.words)
    return _mentions(text, known) if known else sure


def _mentions(text: str, known: frozenset[str]) -> list[Mention]:
    out = []
    for n, (lo, hi) in enumerate(sentence_places(text)):
        tokens = [(m[0], lo + m.start(), lo + m.end()) for m in _TOKEN.finditer(text[lo:hi])]
        # a full stop belongs to an abbreviation only
        tokens = [(t, a, b) if not t.endswith(".") or _ABBREVIATED.search(t) else (t[:-1], a, b - 1) for t, a, b in tokens]
        i = 0
        while i < len(tokens):
            word, start, end = tokens[i]
            low = _bare(word)
            if low in PRONOUNS:
                number, being = PRONOUNS[low]
                out.append(Mention(n, start, end, word, "pronoun", low, frozenset((low,)), number, being))
                i += 1
                continue
            j = i
            if word[:1].isupper() and low not in DETERMINERS and low not in _NOT_HEADS:
                while j < len(tokens) and tokens[j][0][:1].isupper() and (j == i or _bare(tokens[j][0]) not in DETERMINERS):
                    j += 1
                run = tokens[i:j]
                # one capital at a sentence's start says nothing, unless an ending or a title marks a name
                if len(run) > 1 or i > 0 or low in known:
                    words = [_bare(t) for t, _, _ in run]
                    title = TITLES.get(words[0])
                    body = [w for w in words if w not in ENDINGS and w not in TITLES] or words
                    being = title or ("thing" if any(w in ENDINGS for w in words) else None)
                    out.append(Mention(n, run[0][1], run[-1][2], text[run[0][1] : run[-1][2]], "name", body[-1] if title else body[0], frozenset(body), "one" if being else None, being))
            elif low in DETERMINERS:
                j = i + 1
                while j < len(tokens) and j - i <= 4 and re.fullmatch(r"[a-z][\w-]*", tokens[j][0]) and tokens[j][0] not in _NOT_HEADS and tokens[j][0] not in PRONOUNS:
                    j += 1
                words = [t for t, _, _ in tokens[i + 1 : j]]
                if words and low not in ("its", "their", "our"):
                    words = words[: _phrase(words)]
                    j = i + 1 + len(words)
                    head = words[-1]
                    number = "many" if low in ("these", "those") or _singular(head) != head else "one"
                    out.append(Mention(n, start, tokens[j - 1][2], text[start : tokens[j - 1][2]], "phrase", _singular(head), frozenset(map(_singular, words)), number, "person" if _singular(head) in PEOPLE else "thing"))
                else:
                    j = i + 1
            i = max(j, i + 1)
    return out


#: Verbs of filings that may follow a noun without a mark.
_VERBS = re.compile(r"(?:\w+ed|sold|paid|gave|made|took|bought|rose|fell|sells?|issues?|offers?|pays?|expires?|owns?|holds?|files?|intends?|expects?|said|says|does|do|did|also|now|then|only)$")


def _phrase(words: list[str]) -> int:
    """Words of a noun phrase at the start of a run of lower-case words: up to the first verb after a word."""
    return next((k for k, w in enumerate(words) if k and _VERBS.fullmatch(w)), len(words))


@dataclass
class Clusters:
    """A union-find over mentions; a root holds what its members have fixed, and its first member."""

    given: list[Mention]
    parent: list[int] = field(init=False)
    number: list[str | None] = field(init=False)
    being: list[str | None] = field(init=False)
    words: list[set[str]] = field(init=False)
    heads: list[set[str]] = field(init=False)

    def __post_init__(self):
        self.parent = list(range(len(self.given)))
        self.number = [m.number for m in self.given]
        self.being = [m.being for m in self.given]
        self.words = [set(m.words) if m.kind != "pronoun" else set() for m in self.given]
        self.heads = [{m.head} if m.kind != "pronoun" else set() for m in self.given]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def agree(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        one = lambda x, y: x is None or y is None or x == y or (x == "person" and y in ("he", "she")) or (y == "person" and x in ("he", "she"))
        return one(self.number[a], self.number[b]) and one(self.being[a], self.being[b])

    def join(self, a: int, b: int) -> bool:
        """Joins b's cluster to a's unless they disagree."""
        a, b = self.root(a), self.root(b)
        if a == b or not self.agree(a, b):
            return False
        first, other = min(a, b), max(a, b)
        self.parent[other] = first
        self.number[first] = self.number[first] or self.number[other]
        # he and she say more than person
        self.being[first] = next((x for x in (self.being[first], self.being[other]) if x not in (None, "person")), self.being[first] or self.being[other])
        self.words[first] |= self.words[other]
        self.heads[first] |= self.heads[other]
        return True


def _exact(c: Clusters, i: int, j: int) -> bool:
    a, b = c.given[j], c.given[i]
    return a.kind == b.kind != "pronoun" and a.words == b.words and a.head == b.head


def _head(c: Clusters, i: int, j: int) -> bool:
    """The same head, and no word that the earlier cluster lacks."""
    a, b = c.root(j), c.given[i]
    return b.kind != "pronoun" and c.given[j].kind != "pronoun" and b.head in c.heads[a] and b.words <= c.words[a]


def _relaxed(c: Clusters, i: int, j: int) -> bool:
    """The head among the earlier cluster's words, for mentions of one kind, or a name's kind of company named by its noun."""
    a, b = c.given[j], c.given[i]
    if b.kind == "phrase" and a.kind == "name":
        return b.head in ("company", "corporation", "registrant", "issuer") and c.being[c.root(j)] == "thing"
    return a.kind == b.kind != "pronoun" and b.head in c.words[c.root(j)]


def _pronoun(c: Clusters, i: int, j: int) -> bool:
    return c.given[i].kind == "pronoun" and c.given[i].sentence - c.given[j].sentence <= REACH


SIEVES = (_exact, _head, _relaxed, _pronoun)


def chains(text: str) -> list[tuple[int, Mention]]:
    """(chain, mention) of chains of two mentions or more, chains numbered from 1 in the order of their first mention.

    In every sieve a mention looks back, the nearest mention first, but within the sentence before a pronoun's the leftmost first, since subjects are taken up most; the first
    that the sieve allows and whose cluster agrees is joined.
    """
    given = mentions(text)
    c = Clusters(given)
    for sieve in SIEVES:
        for i, m in enumerate(given):
            if c.root(i) != i:
                continue  # only the first mention of a cluster looks back
            before = range(i - 1, -1, -1)
            if sieve is _pronoun:
                # by sentence from the nearest, and within one from the left
                before = sorted(before, key=lambda j: (m.sentence - given[j].sentence, j))
            for j in before:
                if sieve(c, i, j) and c.join(j, i):
                    break
    members: dict[int, list[int]] = {}
    for i in range(len(given)):
        members.setdefault(c.root(i), []).append(i)
    kept = [v for _, v in sorted(members.items()) if len(v) > 1]
    return sorted(((n, given[i]) for n, v in enumerate(kept, 1) for i in v), key=lambda x: (x[1].start, x[0]))


CHAIN_SCHEMA = "chain int, start int, `end` int, text string, kind string"


def coreference(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, chain, start, end, text, kind: the mentions of each document's chains, in one Arrow pass. Null and empty texts have none. text.chain_references takes the result."""

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, m in chains(t or ""):
                    keys.append(k)
                    rows.append((n, m.start, m.end, m.text, m.kind))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=[key, "chain", "start", "end", "text", "kind"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {CHAIN_SCHEMA}")
