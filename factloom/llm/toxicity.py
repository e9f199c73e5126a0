"""Toxicity of texts restored by a noisy-channel decoder.

A character trigram model is counted over all documents (each task sends one row per trigram
it saw; the sums are a table of fixed size). Suspicious tokens - digits or symbols among letters,
letters repeated three times and more, single letters set apart by spaces or dots - are expanded to
a lattice of letters they may stand for, and Viterbi picks the reading most likely under the
model and the channel's costs; other tokens have one reading. Restored words and their
prefixes are looked up in a lexicon learnt from a bounded sample of labelled rows: each entry
holds a lower confidence bound of the share of toxic rows among those that contain it.
A logistic regression turns a text's strongest entry, the number of its tokens that hold one and its length into a
probability; it is fitted on folds whose entries the other folds gave, weighted to the labels' own shares. Scoring is one
scan with a broadcast model of bounded size.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import slimming

#: Rows of each label that are learnt from, in expectation.
PER_LABEL = {1: 2000, 0: 5000}
THRESHOLD = 0.3
#: An entry must beat chance by this many nats beyond the logarithm of the number of entries tried, and reach this bound.
MARGIN, LEAST = 3.0, 0.6
#: The score's logistic regression: folds of its fit, ridge, logarithm of the number of tokens that counts as longest, which features are evidence.
FOLDS, RIDGE, LONGEST = 5, 1.0, 12.0
EVIDENCE = np.array([False, True, True, True, False])
#: Letters that digits and symbols may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Log-probabilities of the channel: a symbol for a letter, a symbol for itself, a doubled letter drawn out, one letter written twice.
_COST, _KEEP, _DOUBLE, _SINGLE = math.log(0.3), math.log(0.0005), math.log(0.5), math.log(0.02)
_SYMBOLS = 28
_CODE = np.zeros(256, np.int64)
_CODE[np.arange(97, 123)] = _CODE[np.arange(65, 91)] = np.arange(1, 27)
_CODE[128:] = 27

_EDGES = re.compile(r"^[^\w@$]+|[^\w@$|+]+$")
_TAIL = re.compile(r"^[^\w@$]*|[^\w]+$")
_LETTERS = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W\d_][\d@$!|+(€£]|[\d@$!|+(€£][^\W\d_]|([^\W\d_])\1\1")
_TRIPLE = re.compile(r"(.)\1\1")
#: A single letter, digit or symbol of LEET, and what sets them apart: white space, also of no width, and some punctuation.
_UNIT, _APART = r"(?:[^\W_]|[@$!|+(€£])", r"[\s\u200b-\u200d\u2060\ufeff.\-_*]"
_SPACED = re.compile(rf"(?<![^\W_]){_UNIT}(?:{_APART}{{1,2}}{_UNIT}(?![^\W_])){{2,}}")
_GAP, _WIDE = re.compile(rf"{_APART}+"), re.compile(rf"{_APART}{{2}}")
_PUNCTUATION = re.compile(r"[^\w@$!|+(€£]+")
#: A letter is a word by itself if this share of the words that start with it are.
_ALONE = 0.05


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


class Decoder:
    """Viterbi over a lattice: state = last two symbols, score = trigram and channel log-probabilities."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(np.float64)
        pair, one = cube.sum(0), cube.sum((0, 1))
        unigram = (one + 1) / (one.sum() + _SYMBOLS)
        bigram = (pair + 20 * unigram) / (pair.sum(1, keepdims=True) + 20)
        trigram = (cube + 20 * bigram[None]) / (cube.sum(2, keepdims=True) + 20)
        self.log = np.log(trigram)
        self.alone = {chr(96 + x) for x in range(1, 27) if cube[0, x, 0] > _ALONE * cube[0, x].sum()}

    def restore(self, token: str, breaks: bool = False) -> str:
        """The likeliest reading of a lower-cased token without spaces; with `breaks`, a word may end after any letter."""
        runs, i = [], 0
        while i < len(token):
            j = i + 1
            while j < len(token) and token[j] == token[i]:
                j += 1
            runs.append((token[i], j - i))
            i = j
        # a reading is a chain (output, chain before it), so a step costs the same at any length
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for at, (char, count) in enumerate(runs):
            options: list[tuple[str, float]] = []
            letters = char if char.isalpha() else LEET.get(char, "")
            change = 0.0 if char.isalpha() else _COST - math.log(max(1, len(letters)))
            for x in letters:
                options.append((x, change + (_SINGLE if count == 2 else 0.0)))
                if count > 1:
                    options.append((x + x, change + (0.0 if count == 2 else _DOUBLE)))
                    if breaks:
                        options.append((x + " " + x, change))
            if breaks and at:
                options += [(" " + out, cost) for out, cost in options]
            if not char.isalpha():
                options.append((" ", _KEEP))
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, chain) in best.items():
                for out, cost in options:
                    p, q, s = a, b, score + cost
                    for x in out:
                        r = _symbol(x)
                        s += self.log[p, q, r]
                        p, q = q, r
                    if (p, q) not in step or s > step[p, q][0]:
                        step[p, q] = (s, (out, chain))
            best = step
        chain = max(((s + self.log[a, b, 0], c) for (a, b), (s, c) in best.items()), key=lambda x: x[0])[1]
        outs = []
        while chain:
            out, chain = chain
            outs.append(out)
        return "".join(reversed(outs)).strip()

    def readings(self, token: str) -> list[str]:
        """Words of a token after restoration; punctuation that stands for no letter parts the token."""
        token = token.lower()
        if token.isalpha() and not _TRIPLE.search(token):
            return [token]
        words: list[str] = []
        for piece in _PUNCTUATION.split(token):
            core = _EDGES.sub("", piece)
            if not _ODD.search(core):
                words += _LETTERS.findall(piece)
                continue
            bare = _TAIL.sub("", core)
            words += _LETTERS.findall(bare)
            # symbols that only enclose a word are read both as letters and as punctuation
            for part in {core, bare}:
                if len(part) > 2 and _ODD.search(part):
                    words += self.restore(part).split()
        return words

    def spaced(self, text: str) -> list[str]:
        """Readings of runs of single letters: of the whole, with and without breaks, of what wider gaps part, and without a one-letter word at an end."""
        out = []
        for m in _SPACED.finditer(text):
            run = m.group().lower()
            for part in dict.fromkeys([run, *_WIDE.split(run)]):
                letters = _GAP.sub("", part)
                if len(letters) < 3:
                    continue
                out += self.restore(letters).split() + self.restore(letters, breaks=True).split()
                if letters[0] in self.alone and len(letters) > 3:
                    out += self.restore(letters[1:]).split()
                if letters[-1] in self.alone and len(letters) > 3:
                    out += self.restore(letters[:-1]).split()
        return out


def unlike(rows: list[tuple[str, int]], coordinates: int = 24, alike: int = 12) -> list[tuple[str, int]]:
    """The rows without near copies of earlier ones, whose words would count as independent evidence."""
    flips = np.random.default_rng(5).integers(1, 1 << 32, coordinates, np.uint64)
    posted: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, (text, toxic) in enumerate(rows):
        words = np.fromiter({zlib.crc32(w.encode()) for w in text.lower().split()}, np.uint64)
        if not len(words):
            continue
        mixed = (words[None, :] ^ flips[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        keys = list(enumerate((mixed >> np.uint64(16)).min(1).tolist()))
        met = Counter(j for k in keys for j in posted.get(k, ()))
        if met and max(met.values()) >= alike:
            continue
        out.append((text, toxic))
        for k in keys:
            posted.setdefault(k, []).append(i)
    return out


class Lexicon:
    """Lower confidence bounds of toxicity for words and prefixes, and the probability of toxicity of a text from the entries it holds."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.bound, self.memo = decoder, {}, {}
        self.weights: np.ndarray | None = None

    @staticmethod
    def keys(word: str) -> tuple[str, ...]:
        n = len(word)
        return (word + "$",) if n < 5 else (word + "$", word[:4]) if n == 5 else (word + "$", word[:4], word[:5]) if n == 6 else (word + "$", word[:4], word[:5], word[:6])

    def entries(self, text: str) -> set[str]:
        """The keys of all restored words of three letters or more."""
        words = {w for token in set(text.split()) for w in self.decoder.readings(token)}
        words.update(self.decoder.spaced(text))
        return {k for w in words if len(w) > 2 for k in self.keys(w)}

    @staticmethod
    def bounds(hit: dict[str, int], miss: dict[str, int], n1: int, n0: int) -> dict[str, float]:
        """Entries from the numbers of toxic and other rows that hold a key, and of all toxic and other rows."""
        out = {}
        tested = {k: a for k, a in hit.items() if a >= 3}
        if not tested or not n0:
            return out
        base, needed, z = n1 / (n1 + n0), math.log(len(tested)) + MARGIN, 1.5
        for k, a in tested.items():
            n = a + miss.get(k, 0)
            p = a / n
            excess = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0)
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if p > base and n * excess >= needed and low > LEAST:
                out[k] = round(low, 6)
        # a prefix that one word accounts for says nothing about others
        for word in [k for k in out if k[-1] == "$"]:
            for prefix in Lexicon.keys(word[:-1])[1:]:
                if hit[word] >= 0.5 * hit[prefix]:
                    out.pop(prefix, None)
        return out

    def fit(self, rows: list[tuple[str, int]], natural: float | None = None) -> Lexicon:
        """Learns the entries from all rows; the weights from entries that FOLDS - 1 folds gave, seen on the fold left out.

        natural: share of toxic rows among all labelled ones, where the rows are a sample by label.
        """
        rows = unlike(rows)
        folds = np.array([zlib.crc32(text.encode()) % FOLDS for text, _ in rows])
        y = np.array([toxic for _, toxic in rows], np.int64)
        # counts only: rows are read again where their keys are needed, so memory holds the keys of the toxic rows alone
        hits, misses = [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]
        for i in np.flatnonzero(y == 1):
            hits[folds[i]].update(self.entries(rows[i][0]))
        hit = sum(hits, Counter())
        tested = {k for k, n in hit.items() if n >= 3}
        for i in np.flatnonzero(y == 0):
            misses[folds[i]].update(self.entries(rows[i][0]) & tested)
        miss = sum(misses, Counter())
        self.bound = self.bounds(hit, miss, int((y == 1).sum()), int((y == 0).sum()))
        if not self.bound:
            return self
        x = np.zeros((len(rows), len(EVIDENCE)))
        for fold in range(FOLDS):
            others, seen = Lexicon(self.decoder), folds != fold
            others.bound = self.bounds(hit - hits[fold], miss - misses[fold], int((y[seen] == 1).sum()), int((y[seen] == 0).sum()))
            for i in np.flatnonzero(~seen):
                x[i] = others.evidence(rows[i][0])
        share = y.mean()
        natural = share if natural is None else natural
        self.weights = calibrated(x, y, np.where(y == 1, natural / share, (1 - natural) / (1 - share)))
        return self

    def of_token(self, token: str) -> float:
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = self.memo[token] = best_of(self.decoder.readings(token), self.bound)
        return found

    def bests(self, text: str) -> list[float]:
        """The strongest entry of each distinct token, and of the spaced runs."""
        return [*map(self.of_token, set(text.split())), best_of(self.decoder.spaced(text), self.bound)]

    def evidence(self, text: str) -> tuple[float, ...]:
        """1; an entry is there; its strength beyond the least; how many tokens hold one; how many different tokens there are."""
        bests = self.bests(text)
        best, holding = max(bests), sum(b > 0 for b in bests)
        strength = math.log(best / (1 - best)) - math.log(LEAST / (1 - LEAST)) if best else 0.0
        return 1.0, float(holding > 0), strength, math.log(max(holding, 1)), min(math.log(len(bests)), LONGEST) / LONGEST

    def score(self, text: str | None) -> float:
        """Probability of toxicity; 0 for every text if nothing was learnt."""
        if self.weights is None:
            return 0.0
        return 1 / (1 + math.exp(-float(np.dot(self.weights, self.evidence(text or "")))))


def best_of(words: list[str], bound: dict[str, float]) -> float:
    """The strongest entry among the words' keys; 0 if there is none."""
    return max((bound[k] for w in words for k in Lexicon.keys(w) if k in bound), default=0.0)


def calibrated(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; a feature of evidence that came out negative is left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        w, part = np.zeros(used.sum()), x[:, used]
        ridge = np.where(np.flatnonzero(used) == 0, 1e-6, RIDGE)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope = part.T @ (share * (p - y)) + ridge * w
            step = np.linalg.solve((part * (share * p * (1 - p))[:, None]).T @ part + np.diag(ridge), slope)
            w = w - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        out = np.zeros(x.shape[1])
        out[used] = w
        wrong = (out < 0) & EVIDENCE
        if not wrong.any():
            return out
        used &= ~wrong


def _count(batches):
    for batch in batches:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for text in batch.column(0).to_pylist():
            for lo in range(0, len(text or b""), 1 << 20):
                c = _CODE[np.frombuffer(b" " + text[max(0, lo - 1) : lo + (1 << 20)] + b" ", np.uint8)]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; at most 28^3 sums reach the driver."""
    counted = docs.select(F.col("text").cast("binary")).mapInArrow(slimming(_count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SYMBOLS**3, np.int64)
    for r in counted:
        out[r["code"]] = r["n"]
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: dict[int, int]) -> tuple[list[tuple[str, int]], float | None]:
    """(text, toxic) of about `per_label[toxic]` rows for each label, chosen by a hash of doc_id; the share of toxic ones among all labelled."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = lambda v: int(min(1.0, per_label[v] / n.get(v, 1)) * (1 << 30))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))
    # about sum(per_label) rows: a fixed bound, so the broadcast does not grow with the corpus
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    total = sum(n.values())
    return sorted({(r["text"], r["toxic"]) for r in rows.select("text", "toxic").collect()}), n.get(1, 0) / total if total else None


def _score(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        lexicon = shared.value
        for batch in batches:
            scores = [lexicon.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], schema=schema)

    return run


def _clean(shared, at: int, threshold: float):
    def run(batches):
        lexicon = shared.value
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def _learn(docs: DataFrame, labels: DataFrame, training: Column, per_label: dict[int, int] | None):
    """The lexicon learnt from labels, as a broadcast."""
    decoder = Decoder(character_counts(docs))
    lexicon = Lexicon(decoder).fit(*labelled_sample(docs, labels.where(training), per_label or PER_LABEL))
    return docs.sparkSession.sparkContext.broadcast(lexicon)


def score_toxicity(docs: DataFrame, labels: DataFrame, training: Column, per_label: dict[int, int] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, score (0 to 1), predicted (1 from `threshold` on).

    Learns from rows of labels (doc_id, toxic in 0, 1) where `training` holds; other values and
    null are skipped. Null and empty texts score as texts without a word; every text scores 0 if
    nothing can be learned. Repeated rows stay apart; extra columns are ignored; an empty table gives no rows. The whole text counts;
    only its length stops counting beyond e^LONGEST different tokens (about 160,000).
    """
    shared = _learn(docs, labels, training, per_label)
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(slimming(_score(shared)), "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean_rows(docs: DataFrame, labels: DataFrame, training: Column, per_label: dict[int, int] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score_toxicity doesn't predict toxic; each row is judged by its own text."""
    shared = _learn(docs.select("doc_id", "text"), labels, training, per_label)
    return docs.mapInArrow(slimming(_clean(shared, docs.columns.index("text"), threshold)), docs.schema)
