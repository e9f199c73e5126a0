"""Language identification by hierarchical discrimination with linear support vector machines.

A text's relative frequencies of hashed byte 2- to 4-grams (lower-cased, everything but letters
collapsed to one space) are scored first by one-versus-rest SVMs for the language family, then by
one-versus-one SVMs among the languages of that family. Training takes a bounded sample
(`per_language` rows in expectation for each language, by a hash of the text, so one scan and no sort), whose texts become features on the
executors: the driver gets `dimension` numbers a row, however long its text; prediction is
a single scan with a weight table of fixed size broadcast to the tasks, each whole text in one
row, and no shuffle.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language families by ISO 639-1 code; a language not named is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "finnic": "fi et",
    "turkic": "tr az kk uz",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMENSION, PER_LANGUAGE, EPOCHS, PENALTY = 1 << 12, 400, 30, 1e-5

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_CHUNK = 1 << 20
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def family(language: str) -> str:
    return _FAMILY.get(language, language)


def _slots(texts: list[str], dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram slots at every byte (one row for each n), and the byte where each text starts."""
    parts = [(" " + _OTHER.sub(" ", t.lower()).strip() + " ").encode() for t in texts]
    raw = np.frombuffer(b"".join(parts) + b"   ", np.uint8).astype(np.uint32)
    begin = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    n, bits = len(raw) - 3, np.uint32(32 - int(dimension).bit_length() + 1)
    gram, out = raw[:n] + np.uint32(1), np.empty((3, n), np.intp)
    for k in range(1, 4):
        gram = gram * np.uint32(0x01000193) + raw[k : k + n] + np.uint32(1)
        out[k - 1] = (gram * np.uint32(0x9E3779B1)) >> bits
    return out, begin


def features(texts: list[str], dimension: int) -> np.ndarray:
    """A row for each text: square roots of the n-grams' shares, and 1."""
    out = np.zeros((len(texts), dimension + 1), np.float32)
    slots, begin = _slots(texts, dimension)
    for i in range(len(texts)):
        out[i, :-1] = np.bincount(slots[:, begin[i] : begin[i + 1]].ravel(), minlength=dimension)
    out[:, :-1] = np.sqrt(out[:, :-1] / np.maximum(1, out[:, :-1].sum(1, keepdims=True)))
    out[:, -1] = 1
    return out


class Model:
    """Families, languages, and one weight column for each binary decision."""

    def __init__(self, languages: list[str], dimension: int):
        self.languages, self.dimension = sorted(languages), dimension
        self.families = sorted({family(x) for x in self.languages})
        self.decisions = [("family", f, None) for f in self.families]
        for f in self.families:
            self.decisions += [("pair", a, b) for a, b in combinations([x for x in self.languages if family(x) == f], 2)]
        self.weights = np.zeros((dimension + 1, len(self.decisions)), np.float32)

    def fit(self, x: np.ndarray, langs: list[str], epochs: int, penalty: float) -> Model:
        """Averaged stochastic subgradient descent on the hinge loss over rows of features(), in a fixed pseudorandom order."""
        langs = np.array(langs)
        fams = np.array([family(v) for v in langs])
        for column, (kind, a, b) in enumerate(self.decisions):
            rows = np.arange(len(langs)) if kind == "family" else np.flatnonzero((langs == a) | (langs == b))
            y = np.where((fams if kind == "family" else langs)[rows] == a, 1.0, -1.0).astype(np.float32)
            if len(rows) == 0 or abs(y.sum()) == len(y):
                self.weights[-1, column] = y[0] if len(y) else 0
                continue
            rng, w, mean, steps = np.random.default_rng(7), np.zeros(x.shape[1], np.float32), 0, 0
            balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())).astype(np.float32)
            for epoch in range(epochs):
                order = rng.permutation(len(rows))
                for lo in range(0, len(order), 16):
                    part = order[lo : lo + 16]
                    f = x[rows[part]]
                    wrong = (y[part] * (f @ w) < 1) * balance[part]
                    w = w * (1 - penalty) + (1.0 / (1 + 0.05 * epoch)) * ((wrong * y[part]) @ f) / len(part)
                    if epoch >= epochs // 2:
                        mean, steps = mean + w, steps + 1
            self.weights[:, column] = mean / steps
        return self

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and confidence: the product of the family's and the worst pair's logistic margins."""
        margins = features(texts, self.dimension) @ self.weights
        out = []
        for row in margins:
            of = {(k, a, b): m for (k, a, b), m in zip(self.decisions, row.tolist(), strict=True)}
            fam = max(self.families, key=lambda f: of["family", f, None])
            near = [x for x in self.languages if family(x) == fam]
            wins, least = dict.fromkeys(near, 0), dict.fromkeys(near, 30.0)
            for a, b in combinations(near, 2):
                m = of["pair", a, b]
                best = a if m >= 0 else b
                wins[best] += 1
                least[a], least[b] = min(least[a], m), min(least[b], -m)
            lang = max(near, key=lambda v: (wins[v], least[v]))
            squash = lambda m: 1 / (1 + np.exp(-2 * max(-30.0, min(30.0, m))))
            out.append((lang, float(squash(of["family", fam, None]) * squash(least[lang]))))
        return out


def _predict(model_of):
    def run(batches):
        model = model_of.value
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [("und", 0.0)] * batch.num_rows
            at, held, size = [], [], 0

            def flush():
                for i, found in zip(at, model.predict(held), strict=True):
                    out[i] = found

            for i, t in enumerate(texts):
                if model.languages and t and _LETTER.search(t):
                    at.append(i)
                    held.append(t)
                    size += len(t)
                    if size > _CHUNK or len(held) >= 256:
                        flush()
                        at, held, size = [], [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], schema=_SCHEMA)

    return run


def _featured(dimension: int):
    def run(batches):
        for batch in batches:
            langs, rows = [], []
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                if _LETTER.search(t := text.as_py()):
                    langs.append(lang)
                    rows.append(features([t], dimension)[0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v.as_py() for v in langs], pa.string()), pa.array(rows, pa.binary())], names=["lang", "features"])

    return run


def sample(docs: DataFrame, per_language: int, dimension: int) -> list[tuple[str, bytes]]:
    """(lang, features) of about `per_language` different texts of each language, chosen by a hash of the text; all, where there are no more. Texts without a letter give none."""
    rows = docs.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()
    if not sizes:
        return []
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, per_language / r["n"]))])
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    found = rows.where(chosen).select("text", "lang").distinct().mapInArrow(_featured(dimension), "lang string, features binary")
    return sorted((r["lang"], bytes(r["features"])) for r in found.collect())


def identify_languages(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE, dimension: int = DIMENSION, epochs: int = EPOCHS, penalty: float = PENALTY) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, lang_pred, score (0 to 1).

    Learns from text and lang of the rows where `training` holds and lang is not null. Null texts,
    texts without a letter, and all texts if nothing can be learned, get `und` and 0. Repeated
    rows stay apart; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = sample(docs.where(training).select("text", "lang"), per_language, dimension)
    model = Model(sorted({v for v, _ in rows}), dimension)
    if rows:
        model.fit(np.frombuffer(b"".join([x for _, x in rows]), np.float32).reshape(len(rows), -1), [v for v, _ in rows], epochs, penalty)
    shared = spark.sparkContext.broadcast(model)
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
