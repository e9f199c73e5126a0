"""Language identification and toxicity against plain versions: features, votes, every reading of a short token; odd rows."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import language_id as L
from factloom.llm import toxicity as X


def plain_features(text, dimension):
    t = (" " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " ").encode()
    counts = Counter()
    for i in range(len(t)):
        # n-grams at the end reach into the bytes of what follows: three spaces after the last text
        gram, tail = (t[i] + 1) % 2**32, (t + b"   ")[i + 1 :]
        for k in range(3):
            gram = (gram * 0x01000193 + tail[k] + 1) % 2**32
            counts[(gram * 0x9E3779B1) % 2**32 >> (32 - dimension.bit_length() + 1)] += 1
    total = sum(counts.values())
    return [math.sqrt(counts[j] / max(1, total)) for j in range(dimension)] + [1.0]


def test_features_one_by_one():
    rnd = random.Random(41)
    for _ in range(40):
        text = "".join(rnd.choice("abc éß1_.  \nÜ") for _ in range(rnd.randrange(1, 60)))
        assert np.allclose(L.features([text], 256)[0], plain_features(text, 256), atol=1e-6)


def test_votes_one_by_one():
    """Family by the largest margin, then the language with most pairs won, by its worst margin among equals."""
    rnd = np.random.default_rng(42)
    model = L.Model(["de", "en", "nl", "sv", "fr", "es", "ja"], 256)
    for _ in range(60):
        model.weights = rnd.normal(size=model.weights.shape).astype(np.float32)
        text = "".join(rnd.choice(list("abcdefg ")) for _ in range(30)) + "a"
        margin = dict(zip(model.decisions, (L.features([text], 256) @ model.weights)[0].tolist(), strict=True))
        fam = max(model.families, key=lambda f: margin["family", f, None])
        near = [v for v in model.languages if L.family(v) == fam]
        won = lambda a, b: margin["pair", a, b] >= 0 if a < b else margin["pair", b, a] < 0  # noqa: E731, B023
        by = lambda a, b: margin["pair", a, b] if a < b else -margin["pair", b, a]  # noqa: E731, B023
        rank = {a: (sum(won(a, b) for b in near if b != a), min([by(a, b) for b in near if b != a], default=30.0)) for a in near}
        assert model.predict([text])[0][0] == max(near, key=lambda v: rank[v])


SAID = {"en": "the of and to in that it is was for on are with they be at this", "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein", "fr": "de la le et les des en un du une que est pour qui dans sur"}


def spoken(rnd, lang, n):
    return " ".join(rnd.choices(SAID[lang].split(), k=n))


def test_languages_of_odd_rows(spark):
    rnd = random.Random(43)
    rows = [(i, spoken(rnd, lang, 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    odd = [(None, spoken(rnd, "de", 40), None), (900, None, "en"), (901, "", "de"), (902, "123 ...", "fr"), (903, spoken(rnd, "fr", 200000), None), (904, rows[0][1], "en"), (904, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, features double")
    got = L.identify_languages(docs, F.col("doc_id") % 3 != 5, per_language=30).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert found[None][0] == "de" and found[903][0] == "fr" and [found[k] for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert sum(found[i][0] == lang for i, _, lang in rows) >= 0.95 * len(rows) and sum(r.doc_id == 904 for r in got) == 2
    # the driver gets features of one size, however long a text is
    sampled = L.sample(docs.select("text", "lang"), 10**6, 256)
    assert {len(x) for _, x in sampled} == {4 * 257}


def decoder(rnd):
    counts = np.zeros(28**3, np.int64)
    for w in ["hate", "all", "be", "a", "bee", "see", "set", "toot", "i"] * 20 + ["".join(rnd.choice("abehilost") for _ in range(4)) for _ in range(60)]:
        c = [0, 0, *[ord(x) - 96 for x in w], 0]
        for p, q, r in zip(c, c[1:], c[2:], strict=False):
            counts[(p * 28 + q) * 28 + r] += 1
    return X.Decoder(counts)


def every_reading(d, token, breaks):
    """The best total over the product of all runs' options, each read symbol by symbol."""
    runs = [(c, len(list(g))) for c, g in itertools.groupby(token)]
    options = []
    for at, (c, n) in enumerate(runs):
        letters = c if c.isalpha() else X.LEET.get(c, "")
        change = 0.0 if c.isalpha() else math.log(0.3) - math.log(max(1, len(letters)))
        own = []
        for x in letters:
            own.append((x, change + (math.log(0.02) if n == 2 else 0.0)))
            if n > 1:
                own.append((x + x, change + (0.0 if n == 2 else math.log(0.5))))
                if breaks:
                    own.append((x + " " + x, change))
        if breaks and at:
            own += [(" " + o, cost) for o, cost in own]
        if not c.isalpha():
            own.append((" ", math.log(0.0005)))
        options.append(own)
    scored = {}
    for pick in itertools.product(*options):
        text, cost = "".join(o for o, _ in pick), sum(c for _, c in pick)
        s = [0, 0, *[X._symbol(c) for c in text], 0]
        total = cost + sum(d.log[p, q, r] for p, q, r in zip(s, s[1:], s[2:], strict=False))
        scored[text.strip()] = max(total, scored.get(text.strip(), -1e9))
    return scored


def test_decoder_by_every_reading():
    rnd = random.Random(44)
    d = decoder(rnd)
    for _ in range(150):
        token = "".join(rnd.choice(["a", "b", "h4t3", "5", "e", "ee", "eee", "1", "@", "!", "l", "s"]) for _ in range(rnd.randrange(1, 4)))
        breaks = rnd.random() < 0.5
        scored = every_reading(d, token, breaks)
        assert scored[d.restore(token, breaks)] >= max(scored.values()) - 1e-9, token


def test_toxicity_of_odd_rows(spark):
    rnd = random.Random(45)
    words = ["table", "river", "stone", "green", "walks", "paper", "light"]
    rows = [(i, " ".join(rnd.choices(words, k=12) + (["vilescum"] if i % 3 == 0 else [])) + f" u{i} v{i * 7} w{i * 3}", int(i % 3 == 0)) for i in range(240)]
    odd = [(None, "you v1lescum there", None), (900, None, None), (901, "", None), (902, " ".join(rnd.choices(words, k=50000)) + " v i l e s c u m", None), (903, "vilescum stone", None), (903, "vilescum stone", None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows + odd], "doc_id long, text string, toxic string, score int")
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in rows] + [(None, 1, "z"), (5, None, "z"), (6, 9, "z")], "doc_id long, toxic int, text string")
    got = X.score_toxicity(docs, labels, F.lit(True)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    found = {r.doc_id: r.predicted for r in got}
    assert found[None] == found[902] == found[903] == 1 and found[900] == found[901] == 0
    assert all(found[i] == y for i, _, y in rows) and sum(r.doc_id == 903 for r in got) == 2
    assert {r.score for r in X.score_toxicity(docs, labels.where("false"), F.lit(True)).collect()} == {0.0}
