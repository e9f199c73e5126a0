"""Each stage decides on rows, also where doc_id is null or repeated."""

import random
from collections import Counter

import corpus_pipeline
from factloom.llm import near_duplicates
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{j % 2}", len(t or "")) for j, (i, t) in enumerate(rows)], SCHEMA)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def words(seed, n=60):
    rng = random.Random(seed)
    return [f"v{rng.randrange(10**6)}" for _ in range(n)]


def test_toxic_rows(spark, tmp_path):
    rng = random.Random(1)
    plain = ["stone", "river", "green", "paper", "cloud", "table", "window", "garden"]
    rows = [(i, " ".join([rng.choice(plain) + rng.choice("abcdefgh") * 2 for _ in range(40)] + (["moron"] if i % 5 == 0 else []))) for i in range(400)]
    spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bad = [(None, "you m0r0n"), (600, "such a moron")]
    good = [(None, "river stones"), (None, None), (600, "green paper"), (600, ""), (None, "river stones")]
    docs = frame(spark, rows + bad + good)
    gone = {t for i, t in rows if i is not None and i % 5 == 0} | {t for _, t in bad}
    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert got.schema == docs.schema
    assert bag(got) == bag(docs.where(F.col("text").isNull() | ~F.col("text").isin(*gone)))


def test_near_duplicate_rows(spark):
    a, b = words(1), words(2)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(3, near(a)), (5, " ".join(a)), (5, " ".join(b)), (5, None), (9, near(b)), (None, " ".join(a)), (None, near(a)), (11, " ".join(words(3))), (11, " ".join(words(3)))]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    texts = Counter((r.doc_id, r.text) for r in got.collect())
    kept_b = {k for k in texts if k in ((5, " ".join(b)), (9, near(b)))}
    kept_a = {k for k in texts if k in ((3, near(a)), (5, " ".join(a)))}
    assert len(kept_a) == len(kept_b) == 1
    assert texts == Counter([*kept_a, *kept_b, (5, None), *rows[5:]])


def test_cut_rows(spark):
    p = words(4, 15)
    repeat, clean = " ".join(p), "two  spaces and\ta tab " + " ".join(words(5, 20))
    want = {1: "head", 4: "tail", 7: ""}
    rows = [(1, repeat), (None, "head " + repeat), (None, clean), (None, None), (7, repeat + " tail"), (7, " ".join(words(6, 30))), (7, "tail  of seven"), (None, repeat)]
    docs = frame(spark, rows)
    got = corpus_pipeline.cut_repeats(spark, docs, "")
    assert got.schema.simpleString() == docs.schema.simpleString()
    made = [(i, want.get(j, t), "en", f"src{j % 2}", len(want.get(j, t) or "")) for j, (i, t) in enumerate(rows)]
    assert bag(got) == Counter(made)


def test_near_duplicates_from_80(spark):
    rng = random.Random(9)
    rows, base = [], words(7, 200)
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(200)] = f"e{i}-{rng.random()}"
        rows.append((i, " ".join(w)))
    a, b = words(8, 104), words(10, 104)
    rows += [(100, " ".join(a)), (101, " ".join([*a[:-11], *words(11, 11)])), (102, " ".join(b)), (103, " ".join([*b[:-12], *words(12, 12)]))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shares = {}
    for x in sets:
        for y in sets:
            k = len(sets[x] & sets[y])
            if y < x and 100 * k >= 80 * (len(sets[x]) + len(sets[y]) - k):
                shares[x, y] = k / (len(sets[x]) + len(sets[y]) - k)
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    assert 0.8 <= shares[101, 100] < 0.81 and (103, 102) not in shares
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    assert {r.doc_id for r in got.collect()} == {i for i in sets if find(i) == i}
    assert [near_duplicates.agreeing(32, p, near_duplicates.MISS) for p in (85, 80)] == [16, 13]
    assert [near_duplicates.agreeing(256, p, near_duplicates.MARK_MISS, 1 / 256) for p in (85, 80)] == [190, 174]
