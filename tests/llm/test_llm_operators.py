import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bit_sliced, byte_bpe, language_id, license_scan, mixing, near_duplicates, order_minhash, sharding, substring_dedup, suffix_automaton, toxicity
from factloom.llm.components import components
from factloom.llm.textops import Scratch, Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def texts(seed=0, n=40):
    """Short texts with exact and near copies, shared passages, ties, an empty, a blank, a null and a very long one."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "The", "MIT", "license"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(20))
    out = base + [base[0], base[0], base[3] + "  " + passage, passage + "\t" + base[5], base[7] + " tail", "", " \n ", None, ("x" * 300 + " ") * 700]
    for b in base[:6]:
        w = b.split()
        if len(w) > 30:
            w[4] = "changed"
        out.append(" ".join(w))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 7 else None, len(t or ""), "z") for i, t in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_words():
    data = ["a bb  c", "", " x\ty\x0b", "é b"]
    words = Words([t.encode() for t in data])
    assert words.counts().tolist() == [len(WORD.findall(t)) for t in data]
    b = [words.hash[i] for i in (1, 6)]
    assert b[0] != b[1] and len(set(words.hash.tolist())) == 7
    assert Words([b"q bb"]).hash[1] == words.hash[1]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root if x in got} and {x for e in edges if e[0] != e[1] for x in e} == set(got)


def test_near_duplicates(spark, docs, rows, nothing):
    sets = []
    for t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(rows))}
    assert near_duplicates.near_duplicates(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(odd).collect()), key=str) == [(1, 1, True), (1, 1, True), (None, None, False)]


def test_skip_merging():
    draw = random.Random(4)
    for _ in range(500):
        lists = [sorted(draw.sample(range(30), draw.randrange(20))) for _ in range(draw.randrange(9))]
        counts = Counter(x for held in lists for x in held)
        for least in (1, 2, 4, 8):
            assert near_duplicates.merge_skip(lists, least) == sorted(x for x, n in counts.items() if n >= least)


def test_colliding(spark):
    keys = {1: [1, 2, 3, 4], 2: [1, 2, 3, 9], 3: [1, 2, 8, 9], 4: [2, 1, 4, 3], 5: [7, 2, 3, 4], 6: [1, 2, 3, 4]}
    pairs = spark.createDataFrame([(1, b) for b in (2, 3, 4, 5, 6)] + [(2, 3), (2, 5)], "a long, b long")
    held = spark.createDataFrame(list(keys.items()), "doc_id long, keys array<long>")
    for least in (1, 2, 3, 4):
        found = {tuple(r) for r in near_duplicates.colliding(pairs, held, least).collect()}
        assert found == {(a, b) for a, b in map(tuple, pairs.collect()) if sum(x == y for x, y in zip(keys[a], keys[b], strict=True)) >= least}


def test_near_copies_in_one_large_family(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    family = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = f"e{i}-{rng.random()}"
        family.append(w)
    sets = [{tuple(w[j : j + 5]) for j in range(146)} for w in family]
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(150):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_duplicates.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(family)], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in range(150)}


def test_substring_dedup(spark, docs, rows, nothing):
    own, want = {}, {}
    for i, t in enumerate(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if own.setdefault(tuple(w[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeated_windows(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0
    assert substring_dedup.remove_repeated_windows(nothing).count() == 0
    same = " ".join(f"s{i}" for i in range(14))
    odd = spark.createDataFrame([(1, same), (1, same), (None, same)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeated_windows(odd).collect()), key=str) == [(1, 0), (1, 0), (None, 14)]


def test_byte_bpe(spark, docs, nothing):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = frame(spark, ["a\x1cb \x1d c   x\u0085y\n\n  z don't I'll 123 ½", "x" * 3000, "ab" * 900 + " " * 500 + "q", "😀 日本語 \t "]).withColumn("doc_id", F.col("doc_id") + 1000)
    all_ = docs.unionByName(extra)
    want = {r.doc_id: ref.encode_ordinary(r.text or "") for r in all_.collect()}
    full = {r.doc_id: r for r in byte_bpe.encode_decode(all_, path, P.PATTERN, block_bytes=2000).collect()}
    assert {i: r.ids for i, r in full.items()} == want
    assert {i: bytes(r.decoded) for i, r in full.items()} == {r.doc_id: (r.text or "").encode() for r in all_.collect()}
    digest = {r.doc_id: r for r in byte_bpe.encode_decode(all_, path, P.PATTERN, digest=True).collect()}
    assert all(digest[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and digest[i].n_tokens == len(ids) for i, ids in want.items())
    assert byte_bpe.encode_decode(nothing, path, P.PATTERN, digest=True).count() == 0
    again = [(None, "one two"), (None, "one two"), (7, "one two"), (7, None), (7, " ".join(f"long{i % 977}" for i in range(9000)))]
    odd = spark.createDataFrame(again, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("block", F.lit(1))
    for size in (50, 1 << 24):  # texts larger than a block, and cut in stretches
        for stretch in (7, 1 << 20):
            got = byte_bpe.encode_decode(odd, path, P.PATTERN, block_bytes=size, stretch=stretch).collect()
            assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=str) == sorted(((i, ref.encode_ordinary(t or ""), (t or "").encode()) for i, t in again), key=str)
        digests = byte_bpe.encode_decode(odd, path, P.PATTERN, digest=True, block_bytes=size, stretch=5).collect()
        assert sorted(((r.doc_id, r.ids_sha256) for r in digests), key=str) == sorted(((i, hashlib.sha256(",".join(map(str, ref.encode_ordinary(t or ""))).encode()).hexdigest()) for i, t in again), key=str)


def test_places_reach_all_buckets():
    """Blocks of many tasks don't meet in a few buckets."""
    import pyarrow as pa

    from factloom.llm.byte_bpe import _PLACES, _cut

    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([f"text {i} here" for i in range(400)])], names=["doc_id", "text"])
    found = [r for out in _cut(r"\w+|\s+", 16, 30, 1 << 20)([batch]) for r in out.to_pylist() if r["kind"] == _PLACES]
    shares = Counter(r["bucket"] for r in found)
    assert len(shares) == 16 and max(shares.values()) < 3 * len(found) / 16


def test_squeeze():
    rng = np.random.default_rng(0)
    for n in (0, 1, 300, 5000):
        raw = (rng.pareto(0.6, n) * 3).astype(np.int64)
        seen = {}
        places = np.array([seen.setdefault(int(x), len(seen)) for x in raw], np.uint32)
        assert (byte_bpe.expand(byte_bpe.squeeze(places, len(seen), 0)) == places).all()
        half = n // 2
        known = int(places[:half].max(initial=0)) + 1 if half else 0
        assert (byte_bpe.expand(byte_bpe.squeeze(places[half:], len(seen), known)) == places[half:]).all()
    words = sorted({b"", b"a", b"ab", b"abc", b"b" * 300, b"b" * 299 + b"c", "é".encode()})
    assert list(byte_bpe.unfront(byte_bpe.front(words))) == words and list(byte_bpe.unfront(byte_bpe.front([]))) == []


def test_suffix_automaton():
    rng = random.Random(2)
    for _ in range(200):
        seqs = [[rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(3)]
        a = suffix_automaton.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        a.place(seqs)
        runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        stream = [rng.choice("abcd") for _ in range(20)]
        state = length = 0
        for e, token in enumerate(stream, 1):
            state, length = a.step(state, length, token)
            assert length == max((n for n in range(1, e + 1) if tuple(stream[e - n : e]) in runs), default=0)
            if length:
                tail = stream[e - length : e]
                assert {n: p for n, p in a.places[state].items()} == {n: at for n, s in enumerate(seqs) if (at := [i for i in range(length, len(s) + 1) if s[i - length : i] == tail])}


def test_license_scan(spark, nothing):
    full = "Intro. " + license_scan.WORDINGS["bsd"][0].upper() + ". MIT License, mit-license; Apache\nLicense. gnu general public license"
    docs = spark.createDataFrame([(1, full), (2, None), (3, ""), (4, "mit. licensee"), (5, "é MIT LİCENSE")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_digest(license_scan.scan_licenses(docs)).collect()}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(full))
    places = [i for p in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (len(words), len(places), min(places), max(places))
    assert got[1].base_labels == "apache,gpl,mit" and "bsd" in got[1].labels.split(",") and got[1].score == 1.0
    assert all((got[i].n_base, got[i].first_word, got[i].base_labels, got[i].labels) == (0, None, "", "") for i in (2, 3, 4, 5))
    assert license_scan.scan_licenses(nothing).count() == 0


def brute_spans(words, wordings, min_match, min_cover, max_gap):
    """Spans by the definition: runs of words that stand in a wording, chained left to right for each wording, the widest first."""
    every = [(label, t.split()) for label, texts in wordings.items() for t in texts]
    stands = lambda run, t: [i + len(run) for i in range(len(t) - len(run) + 1) if t[i : i + len(run)] == run]
    longest = [max((n for n in range(1, e + 1) if any(stands(words[e - n : e], t) for _, t in every)), default=0) for e in range(len(words) + 1)]
    ends = [e for e in range(1, len(words) + 1) if longest[e] and (e == len(words) or longest[e + 1] <= longest[e])]
    found = []
    for number, (label, t) in enumerate(every):
        chains = []
        for e in ends:
            n = longest[e]
            places = stands(words[e - n : e], t)
            if n < min_match or not places:
                continue
            if chains:
                start, end, covered, place = chains[-1]
                over = max(0, end - (e - n))
                after = [p for p in places if p - (n - over) >= place]
                if e - n - end <= max_gap and after:
                    chains[-1] = (start, e, covered + n - over, after[0])
                    continue
            chains.append((e - n, e, n, places[0]))
        found += [(c, s, e, number) for s, e, c, _ in chains if c >= min_cover * len(t)]
    out = []
    for c, s, e, number in sorted(found, key=lambda f: (-f[0], -f[0] / len(every[f[3]][1]), f[1], f[3])):
        if all(e <= a or b <= s for _, a, b, _ in out):
            out.append((every[number][0], s, e, c / len(every[number][1])))
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_license_spans_by_brute_force():
    rng = random.Random(4)
    for case in range(300):
        wordings = {f"l{k}": tuple(" ".join(rng.choice("abcde") for _ in range(rng.randint(3, 12))) for _ in range(2)) for k in range(3)}
        words = []
        while len(words) < 50:
            t = rng.choice(rng.choice(list(wordings.values()))).split()
            words += t[rng.randrange(3) :][: rng.randint(2, 12)] + ["x"] * rng.choice([0, 0, 1, 4]) + [rng.choice("abcde")] * rng.choice([0, 1])
        scanner = license_scan.Scanner({"b c": "base"}, wordings, 2, 0.7, 3)
        base, spans = scanner.scan([w.encode() for w in words])
        assert spans == brute_spans(words, wordings, 2, 0.7, 3), case
        assert [i for _, i in base] == [i for i in range(len(words) - 1) if words[i : i + 2] == ["b", "c"]]


def test_license_texts(spark):
    mit, apache = license_scan.WORDINGS["mit"][0].split(), license_scan.WORDINGS["apache"][0].split()
    changed = [w if i % 17 else "acme" for i, w in enumerate(mit, 1)]
    rows = [
        (1, "Licensed under CC BY-NC 4.0."), (2, "x " * 5 + " ".join(changed) + " and " + " ".join(apache)), (3, " ".join(mit[: len(mit) // 4])), (4, "licensed under the terms we like"),
        (5, "word " * 200_000 + "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. " + "word " * 1000), (1, "Licensed under CC BY-NC 4.0."), (None, "cc0 1.0 universal public domain dedication"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = license_scan.license_digest(license_scan.scan_licenses(docs)).collect()
    assert sorted((str(r.doc_id), r.labels) for r in got) == sorted([("1", "cc-by-nc"), ("1", "cc-by-nc"), ("2", "apache,mit"), ("3", ""), ("4", ""), ("5", "cc-by-sa"), ("None", "cc0")])
    spans = {r.doc_id: [(s.label, s.start, s.end) for s in r.spans] for r in got}
    assert spans[2][0][0] == "mit" and spans[2][0][1] == 5 and spans[2][1][:1] == ("apache",) and spans[5] == [("cc-by-sa", 200_000, 200_014)]


def test_language_of_few_texts(spark):
    rows = [(i, f"alpha beta gamma {i} delta epsilon", "en") for i in range(300)] + [(1000 + i, "où être là çà très", "fr") for i in range(300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = language_id.identify_languages(docs.unionByName(docs.limit(2)), F.lit(True), per_language=20).collect()
    assert len(got) == 602 and all(r.lang_pred == ("fr" if r.doc_id >= 1000 else "en") for r in got)
    long = spark.createDataFrame([(1, "où être là çà très " * 60_000, None), (2, "alpha beta " * 100_000, None)], "doc_id long, text string, lang string")
    found = language_id.identify_languages(docs.drop("score").unionByName(long), F.col("doc_id") > 2, per_language=20)
    assert {r.doc_id: r.lang_pred for r in found.where("lang_pred is not null").collect() if r.doc_id in (1, 2)}[1] in ("fr", "en")


def test_language_id(spark, nothing):
    stems = {"en": "the and of thing ing er th", "de": "der und sch ung keit ich ein", "fr": "le que eau oux ment tion è", "es": "el que ción ado ez la ñ"}
    rng = random.Random(0)
    rows = [(i, " ".join("".join(rng.choice(stems[v].split()) for _ in range(rng.randint(1, 3))) for _ in range(40)), v) for i in range(400) for v in [list(stems)[i % 4]]]
    rows += [(1000, None, "en"), (1001, "123 !?", "en"), (1002, "the thing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify_languages(docs, F.col("doc_id") % 5 != 0).collect()}
    held = [r for r in rows[:400] if r[0] % 5 == 0]
    assert sum(got[i].lang_pred == v for i, _, v in held) >= 0.95 * len(held)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and 0 <= got[1002].score <= 1
    assert language_id.identify_languages(nothing, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.identify_languages(docs.limit(5), F.lit(False)).collect()} == {"und"}


def test_toxicity(spark, nothing):
    rng = random.Random(1)
    clean = [f"{a}{b}" for a in ("stone", "river", "green", "paper", "cloud") for b in ("", "s", "ing", "er")]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(clean) + rng.choice("abcdefgh") * 2 for _ in range(40)]
        if i % 5 == 0:
            w[7] = rng.choice(["moron", "idiot"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if i % 5 == 0 else 0))
    hidden = [(500, "you m0r0n"), (501, "such an i d i o t here"), (502, "idiiiiiot!"), (503, "river stones"), (504, None), (505, ""), (506, "24be64 $$$ ###")]
    docs = spark.createDataFrame(rows + hidden, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(500, None), (501, 7), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks, F.col("doc_id") % 3 != 0).collect()}
    assert all(got[i].predicted == 1 for i in (500, 501, 502)) and all(got[i].predicted == 0 for i in (503, 504, 505, 506))
    held = [(i, t) for i, t in labels if i % 3 == 0]
    assert all(got[i].predicted == t for i, t in held)
    assert toxicity.score_toxicity(nothing, marks, F.lit(True)).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs.limit(3), marks.limit(0), F.lit(True)).collect()} == {0.0}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    v += [(i, v[0][1]) for i in range(300, 330)]  # ties
    v += [(400, None), (450, [1.0] * 7 + [float("nan")]), (401, [1.0] * 7 + [None]), (402, [0.5] * 3), (500, [0.25] * 3), (403, [])]
    df = spark.createDataFrame([(i, x, "z") for i, x in v], "vec_id long, embedding array<float>, label string")
    fit = {i: [int(np.floor(256 * float(np.float32(c)))) for c in x] for i, x in v if x and all(c is not None and np.isfinite(c) for c in x)}
    want = set()
    for q in (i for i in fit if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(fit[q], fit[j], strict=True)), j) for j in fit if j != q and len(fit[j]) == len(fit[q]))
        want |= {(q, r, j, -s) for r, (s, j) in enumerate(scores[:5], 1)}
    got = {tuple(r) for r in bit_sliced.top_k(df, F.col("vec_id") % 50 == 0, block_rows=64, slice_queries=3).collect()}
    assert got == want
    assert bit_sliced.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    wide = spark.createDataFrame([(50, [1e7, -1.0]), (1, [1e6, 1.0]), (2, [-1e6, 3e6]), (1, [1e6, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    found = [(r["rank"], r.vec_id, r.score) for r in bit_sliced.top_k(wide, F.col("vec_id") == 50).orderBy("rank").collect()]
    x, y = 256 * 10**7, -256
    assert found == [(i, v, x * 256 * a + y * 256 * b) for i, v, a, b in ((1, 1, 10**6, 1), (2, 1, 10**6, 1), (3, 2, -(10**6), 3 * 10**6))]
    with pytest.raises(Exception, match="2\\^62"):
        bit_sliced.top_k(spark.createDataFrame([(50, [1e300])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def test_minimax():
    rng = np.random.default_rng(0)

    def brute(sizes, k):
        p = np.concatenate(([0], np.cumsum(sizes)))
        best = list(p)
        for _ in range(k - 1):
            best = [min(max(best[j], p[i] - p[j]) for j in range(i + 1)) for i in range(len(p))]
        return best[-1]

    for _ in range(200):
        sizes, k = rng.integers(1, 50, rng.integers(0, 20)), int(rng.integers(1, 7))
        capacity, cuts = sharding.minimax_cuts(sizes, k)
        ends = [0, *cuts, len(sizes)]
        assert capacity == brute(sizes, k)
        assert all(a <= b and sizes[a:b].sum() <= capacity for a, b in zip(ends, ends[1:], strict=False))


def brute_capacity(sizes, k):
    """The least largest sum of k runs, by dynamic programming over cuts."""
    p = np.concatenate(([0], np.cumsum(sizes)))
    best = p.copy()
    for _ in range(k - 1):
        best = np.array([np.maximum(best[: j + 1], p[j] - p[: j + 1]).min() for j in range(len(p))])
    return int(best[-1])


def test_sharding(spark, docs, rows, nothing):
    more = [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (3, rows[3]), (None, rows[4]), (None, None), (90, rows[0])]
    odd = spark.createDataFrame([(i, t, 0, "clash") for i, t in more], "doc_id long, text string, shard int, rank string")
    for fine in (200_000, 5):
        for given, of in ((odd, more), (docs, list(enumerate(rows)))):
            got = sharding.shard_documents(given, fine_rows=fine).collect()
            text = {i: t for i, t in of}
            assert len(got) == len(of) and all(r["size"] == len((text[r.doc_id] or "").encode()) + 8 for r in got if r.doc_id is not None)
            key = lambda t: "" if t is None else hashlib.sha256(t.encode()).hexdigest()
            groups = Counter()
            for _, t in of:
                groups[key(t)] += len((t or "").encode()) + 8
            total = sum(groups.values())
            order = sorted(groups, key=lambda k: (groups[k] * 24 <= total, k))
            held = Counter()
            for r in got:
                held[r.shard] += r["size"]
            assert max(held.values()) == brute_capacity([groups[k] for k in order], 24)
            # slots: gapless, groups together in key order, then by doc_id
            crc = {key(t): (zlib.crc32(t.encode()) if t is not None else None) for _, t in of}
            rank = {crc[k]: n for n, k in enumerate(order)}
            for s in held:
                mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
                assert [r.slot for r in mine] == list(range(len(mine)))
                places = [(rank[r.text_crc32], -1 if r.doc_id is None else r.doc_id) for r in mine]
                assert places == sorted(places)
            assert len({(r.text_crc32, r.shard) for r in got}) == len(groups)
    assert sharding.shard_documents(nothing).count() == 0


def test_order_minhash(spark, docs, rows, nothing):
    got = {r.doc_id: r for r in order_minhash.compare_with_edits(docs).collect()}
    ring = sorted(range(len(rows)), reverse=True)
    for p, i in enumerate(ring):
        t, nxt = rows[i] or "", rows[ring[(p + 1) % len(ring)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[40].fingerprint != got[1].fingerprint
    long = [i for i in got if got[i].n_chars > 100]
    assert sum(got[i].near_edited for i in long) > 2 * sum(got[i].near_next for i in long)
    assert order_minhash.compare_with_edits(nothing).count() == 0
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, None)], "doc_id long, text string")
    assert order_minhash.compare_with_edits(odd).count() == 4


def xx(*values):
    """Spark's xxhash64 of strings, longs and ints with seed 42, one after another."""
    import struct

    import xxhash

    h = 42
    for kind, v in values:
        raw = v.encode() if kind == "s" else struct.pack("<q", v) if kind == "l" else struct.pack("<i", v)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_fingerprint(text, k=2, sketches=32, bits=26):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    u = lambda x: x & ((1 << 64) - 1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seen, members = Counter(), []
    unit = max(1, -(-len(words) // (1 << bits)))
    for i in range(max(1, len(words) - k + 1) if words else 0):
        name = u(xx(*[("s", w) for w in words[i : i + k]])) >> bits
        members.append((u(xx(("l", name), ("i", seen[name]))) >> bits, i // unit))
        seen[name] += 1
    least = {}
    for name, place in sorted(members):
        # the least of a part, in the order of signed numbers
        part = name >> (64 - bits - (2 * sketches - 1).bit_length())
        value = signed(name << bits | place)
        least[part] = min(least.get(part, value), value)
    out = []
    for j in range(sketches):
        pair = [(u(least[p]) >> bits, u(least[p]) & ((1 << bits) - 1)) if p in least else None for p in (2 * j, 2 * j + 1)]
        a, b = pair
        if a and b:
            out.append(xx(("l", a[0]), ("l", b[0]), ("i", 0)) if a[1] <= b[1] else xx(("l", b[0]), ("l", a[0]), ("i", 1)))
        else:
            out.append(xx(("l", (a or b)[0])) if a or b else None)
    return out


def test_fingerprint_by_brute_force(spark, rows):
    repeated = [*rows, "a b a b a b a", "one", "the the the the " * 50, " ".join(f"w{i % 7}" for i in range(500))]
    df = spark.createDataFrame([(t,) for t in repeated], "text string")
    for bits in (26, 6):  # 6: places in units of several words
        got = df.select("text", order_minhash.fingerprint(F.col("text"), place_bits=bits).alias("f")).collect()
        assert all(list(r.f) == brute_fingerprint(r.text, bits=bits) for r in got)
    both = df.select(order_minhash.fingerprint(F.col("text")).alias("f"), order_minhash.fingerprint(F.reverse("text")).alias("g")).withColumn("x", order_minhash.likeness(F.col("f"), F.col("g")))
    for r in both.collect():
        some = sum(1 for a, b in zip(r.f, r.g, strict=True) if a is not None or b is not None)
        same = sum(1 for a, b in zip(r.f, r.g, strict=True) if a is not None and a == b)
        assert abs(r.x - ((same / some) ** 0.5 if some else 1.0)) < 1e-12


def test_order_matters(spark):
    a, b = " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in [*range(50, 100), *range(50)])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(order_minhash.fingerprint(F.col("a")).alias("a"), order_minhash.fingerprint(F.col("b")).alias("b"))
    assert 0.5 < df.select(order_minhash.likeness(F.col("a"), F.col("b")).alias("x")).first().x < 0.9  # plain MinHash would see 0.96


def test_mixing(spark, docs, rows, nothing):
    got = mixing.mix_sources(docs).toPandas()
    assert dict(zip(got.doc_id, got["size"], strict=True)) == {i: len(WORD.findall(t or "")) for i, t in enumerate(rows)}
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.target - by.taken).abs() <= 0.5).all()
    again = mixing.mix_sources(docs.repartition(3)).toPandas()
    key = lambda d: sorted(map(tuple, d.values.tolist()))
    assert key(got) == key(again)
    mixed = mixing.mixed_texts(docs).toPandas()
    counts = mixed.groupby("doc_id").text.apply(lambda s: sum(len(x.split(" ")) for x in s)).to_dict()
    taken = {i: n for i, n in zip(got.doc_id, got.taken, strict=True) if n}
    assert counts == taken and list(mixed.columns) == docs.columns
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_texts(nothing).count() == 0


def brute_mix(mix):
    """Words taken of each row, from the slots as drawn: streams laid out, cut in blocks, and looked up by index."""
    laid = [r.asDict() for r in mix.laid.collect()]
    out = Counter()
    uses = Counter()
    for r in mix.slots().collect():
        uses.update((r["s"], r["index"] * mix.block + k) for k in range(r["upto"]))
    for s in {r["s"] for r in laid}:
        stream = {}
        for r in (r for r in laid if r["s"] == s):
            for k in range(r["size"]):
                assert r["begin"] + k not in stream
                stream[r["begin"] + k] = (r["doc_id"], r["content"], r["copy"])
        assert sorted(stream) == list(range(len(stream)))
        for at, row in stream.items():
            out[(s, *row)] += uses[s, at]
    return {(r["s"], r["doc_id"], r["content"], r["copy"]): (r["size"], out[r["s"], r["doc_id"], r["content"], r["copy"]]) for r in laid}


def test_mixing_by_brute_force(spark, docs):
    mix = mixing.Mix(docs, block=8, shards=5)
    want = Counter((k[1], *v) for k, v in brute_mix(mix).items())
    assert Counter((r.doc_id, r["size"], r.taken) for r in mixing.mix_sources(docs, block=8, shards=5).collect()) == want
    drawn = mix.draws.sum(0).tolist()
    assert [sum(1 for r in mix.slots().collect() if r["s"] == s) for s in range(len(drawn))] == drawn


def test_small_sources_reach_their_targets(spark):
    """Sources of 1 to 40 words beside a large one: each gives its target to the word, no row more than twice its size, and reruns agree."""
    rows = [(100 * n + k, " ".join(f"w{n}" for _ in range(part)), f"s{n:02}", 0) for n in range(1, 41) for k, part in enumerate((n // 3, n - n // 3))]
    rows += [(9000 + k, " ".join("y" * 3 for _ in range(97)), "zz", 0) for k in range(60)] + [(7, "a b c", None, 0)] * 5
    small = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for block in (mixing.BLOCK, 7):
        mix = mixing.Mix(small, block=block)
        got = mixing.mix_sources(small, block=block).toPandas()
        assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
        taken = Counter()
        for (s, *_), (_, n) in brute_mix(mix).items():
            taken[s] += n
        assert len(mix.targets) == 42 and all(abs(t - taken[s]) <= 0.5 for s, t in enumerate(mix.targets))
        assert Counter((k[1], *v) for k, v in brute_mix(mix).items()) == Counter(zip(got.doc_id, got["size"], got.taken, strict=True))
        again = mixing.mix_sources(small.repartition(5), block=block).toPandas()
        assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
        words = sum(len(r.text.split(" ")) for r in mixing.mixed_texts(small, block=block).collect())
        assert words == got.taken.sum()


def test_mixing_of_repeated_rows(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(1, text, "x", 0), (1, text, "x", 1), (1, text, "y", 2), (None, text, None, 3), (None, text, None, 4), (None, None, "x", 5), (2, " ", "x", 6)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("copy", F.lit("clash")).withColumn("s", F.lit(1))
    got = mixing.mix_sources(odd, block=8).collect()
    assert len(got) == 7 and all(r.taken <= 2 * r["size"] for r in got)
    mixed = mixing.mixed_texts(odd, block=8).collect()
    assert sum(r.taken for r in got) == sum(len(r.text.split()) for r in mixed) and mixed[0].asDict().keys() == {*odd.columns}
    for r in mixed:  # words of one row stand once in a pass, in text order
        at = [int(w[1:]) for w in r.text.split()]
        assert at == sorted(set(at)) and r.n_chars == len(r.text)


def test_targets_and_permutation(spark):
    assert mixing.fill_targets([10, 100], [3, 1], 1.5, 2) == [20.0, 145.0]
    assert mixing.fill_targets([], [], 1.5, 2) == []
    slots = spark.range(999).select(F.lit(2).alias("s"), F.lit(1).cast("long").alias("epoch"), F.col("id").alias("at"), F.lit(999).cast("long").alias("size"))
    index = [r["index"] for r in mixing.permuted(slots, 1).orderBy("at").collect()]
    assert sorted(index) == list(range(999)) and index != list(range(999))
    drawn = mixing.draw([100, 7, 0], 8, 1)
    assert drawn.sum(0).tolist() == [100, 7, 0] and (drawn >= 0).all()
