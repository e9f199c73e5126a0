"""Obfuscated words that the decoder of op3_toxicity must read."""

import random

import numpy as np
import pytest
from factloom.llm import toxicity

ENGLISH = "you are a moron and i am not an idiot so this is a class of scum that a man will pass in a glass house i am in a mood for more iron and i ran on"


@pytest.fixture(scope="module")
def decoder():
    rng = random.Random(2)
    words = ENGLISH.split()
    text = " ".join(rng.choice(words) for _ in range(20000)).encode()
    counts = np.zeros(28**3, np.int64)
    c = toxicity._CODE[np.frombuffer(text, np.uint8)]
    np.add.at(counts, (c[:-2] * 28 + c[1:-1]) * 28 + c[2:], 1)
    return toxicity.Decoder(counts)


def test_tokens(decoder):
    assert "idiot" in decoder.readings("id" + "i" * 200 + "ot")
    glued = ",".join(["word", "house"] * 20)
    assert "moron" in decoder.readings(f"{glued},m0r0n,{glued}")
    assert "moron" in decoder.readings("m0r0n") and decoder.readings("glass,house") == ["glass", "house"]
    assert len(decoder.restore("m0r0n" * 4000)) == 20000


def test_spaced(decoder):
    found = lambda text: decoder.spaced(text)
    assert "moron" in found("you are a m o r o n")
    assert "moron" in found("m o r o n i am")
    assert "moron" in found("a  m o r o n")
    assert "scum" in found("this $ c u m") and "moron" in found("m 0 r o n")
    assert "idiot" in found("you ! d i o t") and "glass" in found("g l @ s s")
    for gap in ("\t", "\n", "\u00a0", "\u2003", "\u200b"):
        assert "moron" in found(gap.join("moron"))
    assert "moron" in found("(m o r o n)!") and "ass" not in found("c l a s s")


def test_scores_of_texts(decoder):
    lexicon = toxicity.Lexicon(decoder)
    lexicon.bound = {"moron$": 0.9, "scum$": 0.9, "idiot$": 0.9}
    for text in ("you are a m o r o n", "$ c u m", "x,id" + "i" * 90 + "ot,y", "s\tc\tu\tm"):
        assert max(lexicon.bests(text)) == 0.9
    for text in ("a | b | c | d", "1. 2. 3.", "a glass house", "", "see (a) (b) (c)"):
        assert max(lexicon.bests(text)) == 0.0


def test_scores_are_calibrated(decoder):
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(400)]
    rows = [(" ".join(rng.choice(plain, 12)) + (" moron" if i % 5 == 0 else ""), int(i % 5 == 0 and i % 10 != 5)) for i in range(1000)]
    lexicon = toxicity.Lexicon(decoder).fit(rows)
    with_entry, without = [lexicon.score(f"{t} moron") for t, _ in rows[:50]], [lexicon.score(t) for t, y in rows[1:50:5]]
    # half of the texts that hold the word are toxic: no entry reaches the least bound, so nothing is learnt
    assert not lexicon.bound and {*with_entry, *without} == {0.0}
    rows = [(" ".join(rng.choice(plain, 12)) + (" moron" if i % 5 == 0 else ""), int(i % 5 == 0 and i % 25 != 5)) for i in range(1000)]
    lexicon = toxicity.Lexicon(decoder).fit(rows)
    assert "moron$" in lexicon.bound
    share = np.mean([lexicon.score(t) for t, _ in rows if "moron" in t])
    assert abs(share - 0.8) < 0.06 and lexicon.score("w1 w2") < 0.05
    assert lexicon.score("w1 m0r0n") > 0.3 > lexicon.score("") == lexicon.score(None) > 0
    # a sample of half toxic rows from labels of which a hundredth is toxic: scores follow the labels
    rare = toxicity.Lexicon(decoder).fit(rows, natural=0.01)
    assert rare.score("w1 moron") < lexicon.score("w1 moron")
