"""BPE by a bounded-lookahead streaming transducer, and an incremental decoder.

From the merge list the driver computes how far to the right of a token its neighbours may still change it
(`sufficient_lookahead`). A transducer then needs a window of that many symbols, whatever the length of a pre-token: it emits
a token once so much follows it, and forgets it. Texts are normalised and cut in stretches, pre-tokens pass through the transducer,
and the decoder turns ids into text as they come, holding the bytes of an unfinished character.

Plan, for 100 TB: one pass over the texts, no shuffle; a task holds a stretch, a window and a memo of short
pre-tokens of bounded size beside the Arrow batch. The tokenizer file is read by the driver and broadcast: its size is that of the vocabulary.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slimming

#: Code points normalised at once, and code points up to which a pre-token is remembered.
STRETCH, SHORT = 1 << 18, 48
#: Bytes of remembered pre-tokens of a worker, counted with their encodings.
MEMO_BYTES = 192 << 20
#: Symbols that the transducer takes in before it looks for stable tokens again.
STRIDE = 2048
#: White space as the pattern reads it, and the letters, numbers and lower cases of Unicode 16 and 17 that Python's tables may lack.
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = (
    (0x1C8A, 0x1C8A), (0xA7CD, 0xA7CD), (0xA7DB, 0xA7DB), (0x105C0, 0x105F3), (0x10D4A, 0x10D4F), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
#: Below this code point (Latin, Greek, Cyrillic) all versions of Unicode in use agree.
SETTLED = "\u0530"
_UNSETTLED = re.compile(f"[{SETTLED}-\U0010ffff]")

_DONE = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("plain", pa.string())])
DONE = "doc_id long, ids array<int>, decoded string, plain string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("plain_sha256", pa.string())])
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, plain_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else the next of those from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def sufficient_lookahead(rules: list[tuple[int, int, int]], size: dict[int, int]) -> int | None:
    """Symbols after a token's end beyond which nothing can change it; None where the list gives no bound.

    rules: (left, right, product) in order of priority. Compare the merging of a text with that of the text and more. Both agree up
    to an edge, at first the text's end. The edge moves left only where a rule joins the last common token u with the token
    after the edge in one of them and not in the other; then uv stands behind the new edge in one and u in the other. The next such
    rule comes later, and the token it takes behind the edge began with that uv, or that u, grown by rules later than the
    first. So the edge's way is at most the heaviest chain of such rules, each weighing the length of its left part. This needs products made
    by one rule each, after the rules that make their parts.
    """
    made: dict[int, int] = {}
    #: for each left part its rules, and the heaviest chain up to each
    chains: dict[int, tuple[list[int], list[int]]] = {}
    weight: list[int] = []
    products = {p for _, _, p in rules}
    for s, (u, v, p) in enumerate(rules):
        if p in made or any(x in products and x not in made for x in (u, v)):
            return None
        before, token, until = 0, v, s
        while True:
            # token stood behind the edge from before `until`, when a rule made it longer (or took it)
            if token in made:
                before = max(before, weight[made[token]])
            at, best = chains.get(token, ((), ()))
            if i := bisect_left(at, until):
                before = max(before, best[i - 1])
            if token not in made:
                break
            until = made[token]
            token = rules[until][0]
        weight.append(before + size[u])
        size[p] = size[u] + size[v]
        made[p] = s
        at, best = chains.setdefault(u, ([], []))
        at.append(s)
        best.append(max(weight[s], best[-1] if best else 0))
    return max(weight, default=0)


#: Stands after every rule; and the bits of a rule's product.
NEVER, _PRODUCT = 1 << 63, (1 << 32) - 1


class Rules:
    """Merge list, vocabulary and special tokens of a tokenizer file with byte letters and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        #: left << 32 | right to rank << 32 | product
        self.ranks = {a << 32 | b: rank << 32 | product for rank, (a, b, product) in enumerate(rules)}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        # rules of two letters, the second inside a word and at its end
        self.inside, self.ending = ([self.ranks.get(a << 32 | b, NEVER) for a in self.inner for b in seconds] for seconds in (self.inner, self.final))
        self.spelled = {i: token for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.spelled |= {i: token for token, i in self.special.items()}
        byte_of = {c: b for b, c in enumerate(letters)}
        self.raw = {i: bytes(byte_of[c] for c in token.removesuffix(end)) + (b" " if token.endswith(end) else b"") for token, i in vocab.items()}
        self.raw |= {i: token.encode() for token, i in self.special.items()}
        self.size = dict.fromkeys([*self.inner, *self.final], 1)
        self.lookahead = sufficient_lookahead(rules, self.size)


def _short(word: bytes, rules: Rules) -> list[int]:
    """The ids of a pre-token shorter than the transducer's window: it passes at once."""
    inner, inside, n = rules.inner, rules.inside, len(word) - 1
    part = [inner[b] for b in word]
    part[n] = rules.final[word[n]]
    found = [inside[a << 8 | b] for a, b in zip(word, word[1:])]  # noqa: B905
    if n:
        found[n - 1] = rules.ending[word[n - 1] << 8 | word[n]]
    return merge(part, rules.ranks, found)


def merge(symbols: list[int], ranks: dict[int, int], found: list[int] | None = None) -> list[int]:
    """Tokens of a run of symbols, by rules left << 32 | right -> rank << 32 | product: the adjacent pair of least rank merges first, the leftmost among equals.

    found: the rules of adjacent symbols, where they are known; NEVER where there is none.
    """
    part, n, known, never = list(symbols), len(symbols), ranks.get, NEVER
    if n < 64:
        if found is None:
            found = [known(a << 32 | b, never) for a, b in zip(part, part[1:])]  # noqa: B905
        while found and (best := min(found)) < never:
            i, product = found.index(best), best & _PRODUCT
            part[i : i + 2] = [product]
            del found[i]
            if i:
                found[i - 1] = known(part[i - 1] << 32 | product, never)
            if i < len(found):
                found[i] = known(product << 32 | part[i + 1], never)
        return part
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := known(part[i] << 32 | part[i + 1])) is not None]
    heapify(heap)
    while heap:
        r, i, a, b = heappop(heap)
        j = after[i]
        if gone[i] or j >= n or part[i] != a or part[j] != b:
            continue
        part[i] = product = r & _PRODUCT
        gone[j] = True
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := known(product << 32 | part[k])) is not None:
                heappush(heap, (r, i, product, part[k]))
        if (h := before[i]) >= 0 and (r := known(part[h] << 32 | product)) is not None:
            heappush(heap, (r, h, part[h], product))
    return [p for p, g in zip(part, gone, strict=True) if not g]


class Transducer:
    """Token ids of one pre-token at a time, given in pieces of any length; what it holds is bounded by the lookahead and STRIDE."""

    def __init__(self, rules: Rules, stride: int = STRIDE):
        # a stride holds the longest token, so each window gives one at least
        self.rules, self.stride, self.held, self.last = rules, max(stride, *rules.size.values()), [], None

    def feed(self, piece: bytes) -> list[int]:
        """Takes a piece of the pre-token; the ids that are stable now."""
        if not piece:
            return []
        if self.last is not None:
            self.held.append(self.rules.inner[self.last])
        self.held += [self.rules.inner[b] for b in piece[:-1]]
        self.last = piece[-1]
        hold, out = self.rules.lookahead, []
        if hold is None or len(self.held) <= hold + self.stride:
            return out
        # a long piece goes through in windows of hold + stride symbols
        symbols, at = self.held, 0
        while len(symbols) - at > hold + self.stride:
            stable, size = [], 0
            for t in merge(symbols[at : at + hold + self.stride], self.rules.ranks):
                if size + self.rules.size[t] > self.stride:
                    break
                size += self.rules.size[t]
                stable.append(t)
            out += stable
            at += size
        self.held = symbols[at:]
        return out

    def finish(self) -> list[int]:
        """Ends the pre-token: the rest of its ids."""
        if self.last is None:
            return []
        out = merge([*self.held, self.rules.final[self.last]], self.rules.ranks)
        self.held, self.last = [], None
        return out


class Decoder:
    """Ids to text as they come: a character's bytes wait until it is whole; malformed bytes give U+FFFD. A word end gives one space."""

    def __init__(self, rules: Rules):
        self.rules, self.state = rules, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.rules.raw.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_SECOND: set[str] = set()


def _composes(c: str) -> bool:
    """Whether c may join or move past what stands before it when texts are composed."""
    if c < "\x80":
        return False
    if not _SECOND:
        whole = (unicodedata.normalize("NFD", chr(i)) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000)
        _SECOND.update(x for d in whole if len(d) > 1 for x in d[1:])
    return unicodedata.combining(c) != 0 or c in _SECOND


def lowered(text: str) -> str:
    """Lower case of each character by itself: a final sigma is not told apart."""
    out = text.replace("\u03a3", "\u03c3").lower()
    return out if out.isascii() or not _UNSETTLED.search(out) else out.translate(LOWER)


@cache
def classes() -> tuple[str, str]:
    """Letters and numbers as members of a character class."""
    found: dict[str, list[tuple[int, int]]] = {"L": list(LETTERS), "N": list(NUMBERS)}
    for c in range(0x110000):
        if (runs := found.get(unicodedata.category(chr(c))[0])) is not None:
            if runs[-1][1] == c - 1 and runs[-1] not in (*LETTERS, *NUMBERS):
                runs[-1] = (runs[-1][0], c)
            else:
                runs.append((c, c))
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in sorted(set(found[k]))) for k in "LN")


def normalised(text: str, stretch: int = STRETCH) -> Iterator[tuple[str, bool]]:
    """(part, whether it is the last) of the composed, lower-cased text; no part is cut where characters compose."""
    lo, n = 0, len(text)
    while True:
        hi = min(n, lo + stretch)
        while hi < n and _composes(text[hi]):
            hi += 1
        part = text if hi - lo == n else text[lo:hi]
        yield lowered(unicodedata.normalize("NFC", part)), hi >= n
        if hi >= n:
            return
        lo = hi


class Patterns:
    """The pre-token pattern of the file and the runs that may go on, with classes from a table of the stated Unicode version, or `quick`, for texts below SETTLED."""

    def __init__(self, quick: bool):
        import regex

        letters, numbers = (r"\p{L}", r"\p{N}") if quick else classes()
        engine = regex if quick else re
        #: Fixed value: the pattern.
        self.find = engine.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{WHITE_SPACE}{letters}{numbers}]+")
        self.letters, self.others = engine.compile(f"[{letters}]*"), engine.compile(f"[^{WHITE_SPACE}{letters}{numbers}]*")


    @staticmethod
    @cache
    def known(quick: bool) -> Patterns:
        return Patterns(quick)


class Memo(dict):
    """Pre-tokens and their ids; forgets those not met lately once they take more than `most` bytes."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.size, self.older = encode, most, 0, {}

    def __missing__(self, word: str) -> list[int]:
        got = self.older.get(word) or self.encode(word)
        if len(word) <= SHORT:
            self[word] = got
            self.size += 200 + len(word) + 12 * len(got)
        return got

    def forget(self) -> None:
        if self.size > self.most // 2:
            self.older, self.size = dict(self), 0
            self.clear()


class Encoder:
    """Texts to ids, token spellings and text; remembers short pre-tokens up to MEMO_BYTES."""

    def __init__(self, rules: Rules, stretch: int = STRETCH, memo_bytes: int = MEMO_BYTES, stride: int = STRIDE):
        self.rules, self.stretch = rules, stretch
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(rules.special, key=len, reverse=True))) if rules.special else None
        self.transducer = Transducer(rules, stride)
        self.memo = Memo(self.long, memo_bytes)

    def patterns(self, part: str) -> Patterns:
        return Patterns.known(part.isascii() or not _UNSETTLED.search(part))

    def long(self, word: str) -> list[int]:
        word = word.encode()
        return _short(word, self.rules) if len(word) < 64 else self.transducer.feed(word) + self.transducer.finish()

    def ids(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in lists of bounded length."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from self._plain(text[at : m.start()])
            yield [self.rules.special[m.group()]]
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[list[int]]:
        short = self.memo.__getitem__
        #: the start of a pre-token that may go on, and the name of the run that an unfinished long one goes on with
        tail, open_ = "", None
        for part, last in normalised(text, self.stretch):
            patterns = self.patterns(tail + part if tail else part)
            if last and not tail and open_ is None:
                yield list(chain.from_iterable(map(short, patterns.find.findall(part))))
                self.memo.forget()
                return
            at = 0
            if open_ is not None:
                at = getattr(patterns, open_).match(part).end()
                yield self.transducer.feed(part[:at].encode())
                if at == len(part) and not last:
                    continue
                yield self.transducer.finish()
                open_ = None
            part, tail, out = tail + part[at:], "", []
            for m in patterns.find.finditer(part):
                word, end = m.group(), m.end()
                if not last and end > len(part) - 3:
                    # what follows may change a short pre-token and lengthen a long one
                    if len(word) <= SHORT:
                        tail = part[m.start() :]
                        break
                    if end == len(part):
                        yield out
                        out = self.transducer.feed(word.encode())
                        open_ = "letters" if patterns.letters.match(word).end() else "others"
                        break
                out += short(word)
                if len(out) > self.stretch:
                    yield out
                    out = []
            yield out
            self.memo.forget()


def _run(table, digest: bool, stretch: int):
    def run(batches):
        rules = table.value
        encoder = Encoder(rules, stretch)
        ids_ = range(max(rules.spelled) + 1)
        digit = [b"%d" % i for i in ids_].__getitem__
        spelling = [rules.spelled.get(i, "").encode() for i in ids_].__getitem__
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                decoder = Decoder(rules)
                parts = filter(None, encoder.ids(text.as_py() or ""))
                if digest:
                    sums, n = [hashlib.sha256() for _ in range(3)], 0
                    for ids in parts:
                        gap = b" " if n else b""
                        n += len(ids)
                        sums[0].update(gap + b" ".join(map(digit, ids)))
                        sums[1].update(gap + b" ".join(map(spelling, ids)))
                        sums[2].update(decoder.feed(ids).encode())
                    sums[2].update(decoder.finish().encode())
                    rows.append((doc.as_py(), n, *[s.hexdigest() for s in sums]))
                else:
                    ids = [i for p in parts for i in p]
                    rows.append((doc.as_py(), ids, " ".join([rules.spelled[i] for i in ids]), decoder.feed(ids) + decoder.finish()))
            schema = _DIGEST if digest else _DONE
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    return run


def encode_decode_words(docs: DataFrame, path: str, digest: bool = False, stretch: int = STRETCH) -> DataFrame:
    """One row per row of docs (doc_id, text): ids, their spellings joined by one space (`decoded`) and the text they stand for (`plain`), or with `digest` sha-256 sums.

    Special tokens that stand in a text count as such; none are added. Null and empty texts have no tokens. Repeated rows
    and doc_ids stay apart; a null doc_id stays null. Extra columns are ignored; an empty table gives no rows. A text
    may be as long as a Spark string: it passes in stretches, and a pre-token of any length through the transducer's window.
    """
    table = docs.sparkSession.sparkContext.broadcast(Rules(path))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(slimming(_run(table, digest, stretch)), DIGEST if digest else DONE)
