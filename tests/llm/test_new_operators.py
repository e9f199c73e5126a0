"""Collocations, conversation repair and word BPE against brute force, the SQL twins and the tokenizer library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factloom.llm import registry
from factloom.llm.collocations import BLOCK_BITS, adjacent, collocations, compact, stretches, words_of
from factloom.llm.conversation_repair import ACCEPTING, NEXT, ROLE, START, damage, repair_conversations, search, undamaged
from factloom.llm.word_bpe import Decoder, Encoder, Rules, Transducer, encode_decode_words, merge, normalised, sufficient_lookahead

SF = "/root/testdata/sf0.01"


# ---- collocations


def by_counting(rows, least, top, covered):
    import re

    counts = {}
    for lang, text in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            c.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in phrases.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in phrases.items()):
                continue
            score, _, le, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), le, r))
        out += [(lang, i, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(rnd, n):
    words = ["a", "b", "Ab", "c", "new", "york", "city", "é", "x y", "z\x00"]
    ends = [" ", "  ", "\t", ". ", "\n", ",", "\r\n", " ! "]
    return ["".join(rnd.choice(words) + rnd.choice(ends[:2] * 4 + ends) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_collocations_by_counting(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["en", "fr", None, "und"]), t) for t in texts(rnd, 80)] + [("en", None), (None, ""), ("de", "..."), ("en", "new york " * 200), ("en", "new york " * 200)]
    docs = spark.createDataFrame([(lang, t, 1, "x", 2) for lang, t in rows], "lang string, text string, id long, word string, a int")
    want = by_counting(rows, 5, 12, 80)
    assert want
    for options in ({}, {"block_bytes": 200, "stretch": 16}):
        got = collocations(docs.repartition(3), least=5, top=12, **options)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == want


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations(empty).count() == 0
    assert collocations(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).count() == 0


def test_collocation_parts():
    assert words_of(b"A\tb,c..\xc3\x89 ") == [b"a", b"b", b".", b"c", b".", b".", b"\xc3\x89"]
    text = b"one two  three,four" * 40 + b"y" * 100
    for size in (1, 7, 50):
        assert [w for part in stretches(text, size) for w in words_of(part)] == words_of(text)
    assert compact(np.array([-1, 3, -1, 1, 2, -1, -1, 4, 5, 6, -1, 7])).tolist() == [1, 2, -1, 4, 5, 6, -1]
    both, found, inverse, n = adjacent(np.array([0, 1, 0, 1, -1, 1, 1]), 2)
    assert (both.tolist(), found.tolist(), inverse.tolist(), n.tolist()) == ([True, True, True, False, False, True], [1, 2, 3], [0, 1, 0, 2], [2, 1, 1])
    assert BLOCK_BITS + 28 + 21 <= 63


# ---- conversations


def by_trying(initials, faulty):
    """The cheapest edits, then the least audit, over every sequence with at most two insertions in a row."""
    found, n = [], len(initials)

    def go(i, state, cost, audit, added):
        if i == n and state in ACCEPTING:
            found.append((cost, audit))
        if added < 2:
            go(i, NEXT[state][ROLE[state][0]], cost + 5, audit + "I", added + 1)
        if i < n:
            go(i + 1, state, cost + 2, audit + "D", 0)
            if faulty[i] in ("", "truncated"):
                more = 5 if faulty[i] else 0
                for role in "ua":
                    if role in NEXT[state]:
                        go(i + 1, NEXT[state][role], cost + more + 1, audit + "R", 0)
                if initials[i] in NEXT[state]:
                    go(i + 1, NEXT[state][initials[i]], cost + more, audit + "K", 0)

    go(0, START, 0, "", 0)
    return min(found)


def test_search_by_trying():
    rnd = random.Random(11)
    for _ in range(300):
        n = rnd.randrange(6)
        initials, faulty = [rnd.choice(["s", "u", "a", "t", ""]) for _ in range(n)], [rnd.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        (got,) = search(initials, faulty, START, ACCEPTING, True).values()
        assert got == by_trying(initials, faulty)


def plainly(rows):
    """The result of one conversation's rows (turn, role, text), in order."""
    seen, faulty = set(), []
    for _, role, text in rows:
        shown = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        faulty.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    initials, turns = [r[:1] for _, r, _ in rows], [t for t, _, _ in rows if t is not None]
    (got,) = search(initials, faulty, START, ACCEPTING, True).values()
    at, state, lines = 0, START, []
    for e in got[1]:
        role = rows[at][1] if e == "K" else ROLE[state]
        if e != "D":
            lines.append(f"{role}:{'' if e == 'I' else rows[at][2]}")
            state = NEXT[state][role[0]]
        at += e != "I"
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[faulty.count(f) for f in ("blank", "duplicate", "truncated")], illegal, *got, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("rows_held", [1, 3, 1024])
def test_conversations_in_segments(spark, rows_held):
    rnd = random.Random(13)
    rows = []
    for conv in [None, *range(12), 99]:
        for turn in [*rnd.choices([None, *range(9)], k=rnd.randrange(1, 9)), *(range(60) if conv == 99 else ())]:
            rows.append((conv, turn, rnd.choice(["system", "user", "assistant", "tool", "", None, "user"]), rnd.choice(["a.", "b!", "c", "", " ", None, "d?\n", "x" * 3000 + "."])))
    given = spark.createDataFrame([(*r, 1, "t") for r in rows], "conv_id long, turn long, role string, text string, segment int, tie string")
    got = {r[0]: tuple(r)[1:] for r in repair_conversations(undamaged(given), segment_rows=rows_held).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: plainly([r[1:] for r in sorted((r for r in clean if r[0] == c), key=key)]) for c in {r[0] for r in rows}}
    assert got == want


def test_conversations_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(17)
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "tool", None]), rnd.choice(["a. B", "b!", "c", None, "\t", "d? "])) for c in [None, *range(150)] for t in [*range(rnd.randrange(1, 7)), *rnd.choices([None, 3], k=rnd.randrange(2))]]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", given.toArrow())
    sql = con.sql(registry.SQL["op12_conversation_repair"])
    got = repair_conversations(damage(given), segment_rows=2)
    assert len({r[0] for r in rows}) == got.count()
    assert sorted(map(str, (tuple(r[c] for c in sql.columns) for r in got.collect()))) == sorted(map(str, sql.fetchall()))


def test_conversations_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(damage(empty)).count() == 0
    # crc32("0:N") % 20 == 0 drops the row
    import zlib

    dropped = [(0, t, "user", "x.") for t in range(200) if zlib.crc32(f"0:{t}".encode()) % 20 == 0]
    (row,) = repair_conversations(damage(spark.createDataFrame(dropped, empty.schema))).collect()
    assert tuple(row) == (0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ---- word BPE


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    out = tokenizers.Tokenizer.from_file(registry.word_tokenizer())
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def rules():
    return Rules(registry.word_tokenizer())


def odd_texts(rnd, n):
    parts = [
        "abcdefghijklmnopqrstuvwxyz", ["a", "e", "́", "̣", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "Σ", "AΣ", "İ"], "ab'ster lvd!?1 \n\x85 ",
        ["the", "ing", "tion", "er", "an", "!", "...", "'ll", "'"], [chr(c) for c in (*range(0x4E00, 0x4E20), *range(0x1100, 0x1110), *range(0x1161, 0x1170), 0x11A8, 0x1F600, 0x1C89, 0xA7DC, 0x16EA0, 0x10D50, 0xFB01)],
    ]
    return ["".join(rnd.choice(p) for _ in range(rnd.randrange(300))) for p in rnd.choices(parts, k=n)]


def test_transducer_equals_library(library, rules):
    rnd = random.Random(19)
    for text in [*odd_texts(rnd, 400), "ha" * 3000, "a" * 5000, "中" * 2000, "'" * 999 + "s"]:
        want = library.encode(text, add_special_tokens=False).ids
        for options in ({}, {"stretch": rnd.randrange(1, 50), "stride": 1}):
            assert [i for part in Encoder(rules, **options).ids(text) for i in part] == want, (options, text)
        assert " ".join(rules.spelled[i] for i in want) == library.decode(want, skip_special_tokens=False)


def test_window_stays_bounded(rules):
    rnd = random.Random(23)
    word = "".join(rnd.choice("abcdefghij") for _ in range(50000)).encode()
    t = Transducer(rules, stride=200)
    out, most = [], 0
    for at in range(0, len(word), 37):
        out += t.feed(word[at : at + 37])
        most = max(most, len(t.held))
    assert most <= rules.lookahead + t.stride + 37
    assert out + t.finish() == merge([*[rules.inner[b] for b in word[:-1]], rules.final[word[-1]]], rules.ranks)


def test_lookahead_of_small_lists():
    """No text's token changes once the lookahead's symbols follow it: every text of up to 9 symbols over small random lists."""
    import itertools

    rnd = random.Random(29)
    for _ in range(30):
        tokens, pairs, lists = [0, 1], set(), []
        for _ in range(rnd.randrange(1, 7)):
            u, v = rnd.choice(tokens), rnd.choice(tokens)
            if (u, v) not in pairs:
                pairs.add((u, v))
                tokens.append(len(tokens))
                lists.append((u, v, tokens[-1]))
        size = {0: 1, 1: 1}
        hold = sufficient_lookahead(lists, size)
        ranks = {u << 32 | v: i << 32 | p for i, (u, v, p) in enumerate(lists)}
        for text in itertools.product((0, 1), repeat=9):
            whole = merge(list(text), ranks)
            for n in range(9):
                at = 0
                for i, t in enumerate(merge(list(text[:n]), ranks)):
                    at += size[t]
                    if at > n - hold:
                        break
                    assert whole[i] == t
    assert sufficient_lookahead([(0, 1, 2), (2, 3, 4)], {0: 1, 1: 1, 3: 1}) == 2
    assert sufficient_lookahead([(2, 1, 3), (0, 1, 2)], {0: 1, 1: 1}) is None
    assert sufficient_lookahead([(0, 1, 2), (1, 0, 2)], {0: 1, 1: 1}) is None


def test_decoder_waits_for_whole_characters(rules):
    decoder = Decoder(rules)
    ids = [i for part in Encoder(rules).ids("Café \U0001f600 中") for i in part]
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "café \U0001f600 中 "
    decoder = Decoder(rules)
    assert [decoder.feed([rules.inner[b]]) for b in "中".encode()] == ["", "", "中"]
    assert decoder.feed([rules.inner[0xE4]]) + decoder.finish() == "�"


def test_normalised_in_parts():
    import unicodedata

    text = "ẹ́ 한" * 30 + "́" * 40 + "ab"
    for size in (1, 2, 5, 1000):
        parts = list(normalised(text, size))
        assert "".join(p for p, _ in parts) == unicodedata.normalize("NFC", text) and [last for _, last in parts] == [False] * (len(parts) - 1) + [True]


def test_word_bpe_rows(spark, library):
    rnd = random.Random(31)
    rows = [(1, "Hello, World's end <|endoftext|>"), (1, "Hello, World's end <|endoftext|>"), (None, "x"), (2, None), (3, ""), (4, "ab " * 100000), (5, "q" * 300000), *[(10 + i, t) for i, t in enumerate(odd_texts(rnd, 20))]]
    docs = spark.createDataFrame([(i, t, "n", [1]) for i, t in rows], "doc_id long, text string, n_tokens string, ids array<int>")
    got = encode_decode_words(docs, registry.word_tokenizer(), digest=True).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, want))
    whole = encode_decode_words(docs.where("doc_id = 1"), registry.word_tokenizer()).first()
    assert whole.plain == "hello , world 's end <|endoftext|>" and whole.decoded.startswith("hello</w> ,</w>")
    assert encode_decode_words(docs.limit(0), registry.word_tokenizer()).count() == 0


@pytest.mark.parametrize("name", ["op11_collocations", "op12_conversation_repair"])
def test_new_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
