"""Name search, overlap resolution, path search, the command log and attribute lookup against brute force."""

import random
import re
import time
from collections import deque

from pyspark.sql import functions as F

from factloom.operators import command_log, commands, graph, intervals, names, text
from factloom.plans import records


def greedy(spans):
    kept = []
    for s, e in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if e > s and all(e <= a or b <= s for a, b in kept):
            kept.append((s, e))
    return sorted(kept)


def test_longest_first_by_comparing_all():
    rnd = random.Random(1)
    for _ in range(300):
        spans = [(a, a + rnd.randrange(9)) for a in (rnd.randrange(40) for _ in range(rnd.randrange(25)))]
        got = intervals.longest_first([a for a, _ in spans], [b for _, b in spans])
        assert [spans[i] for i in got] == greedy(spans)


def test_longest_first_of_many():
    rnd = random.Random(2)
    spans = [(a, a + rnd.randrange(1, 200)) for a in (rnd.randrange(10**6) for _ in range(10**5))]
    began = time.perf_counter()
    kept = intervals.longest_first([a for a, _ in spans], [b for _, b in spans])
    assert time.perf_counter() - began < 5
    ordered = [spans[i] for i in kept]
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:], strict=False))


def test_keep_longest_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [(0, 3), (2, 9), None, (4, 4)]), (2, None), (3, [])], "id int, s array<struct<start: int, end: int>>")
    got = {r.id: [tuple(x) for x in r.k] for r in df.select("id", intervals.keep_longest(F.col("s")).alias("k")).collect()}
    assert got == {1: [(2, 9)], 2: [], 3: []}


def by_scanning(t, given, fold, plural, hyphens):
    tokens = [m.span() for m in names.TOKEN.finditer(t)]
    words = [t[a:b].lower() if fold else t[a:b] for a, b in tokens]
    hits = set()
    for name, since in given:
        own = names.TOKEN.findall(name.lower() if fold else name)
        for last in (own[-1], own[-1] + "s", own[-1] + "es") if plural and own else own[-1:]:
            want = [*own[:-1], last]
            for i in range(len(words) - len(want) + 1):
                a, b = tokens[i][0], tokens[i + len(want) - 1][1]
                if words[i : i + len(want)] == want and a >= since and not (hyphens and "-" in (t[a - 1 : a], t[b : b + 1])):
                    hits.add((a, b, name))
    kept = []
    for a, b, name in sorted(hits, key=lambda h: (h[0] - h[1], h)):
        if all(b <= x or y <= a for _, x, y in kept):
            kept.append((name, a, b))
    return sorted(kept, key=lambda h: h[1])


def test_names_by_scanning(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "b", "A", "ab", "as", "Bs", "é", "a-b", "(", ".", "bes"])
    rows = []
    for i in range(200):
        t = "".join(word() + rnd.choice([" ", " ", "  ", "-", ""]) for _ in range(rnd.randrange(40)))
        rows.append((i, t, [("".join(word() + " " for _ in range(rnd.randrange(1, 4))).strip(), rnd.choice([0, 0, 10])) for _ in range(rnd.randrange(6))]))
    rows += [(900, None, [("a", 0)]), (901, "a a", None), (902, "", []), (903, "x", [(" ", 0), (None, 0)])]
    df = spark.createDataFrame(rows, "id int, t string, n array<struct<name: string, since: int>>")
    for fold, plural, hyphens in [(False, False, True), (True, True, False), (True, False, False)]:
        got = {r.id: [tuple(h) for h in r.h] for r in df.select("id", names.find_names(F.col("t"), F.col("n"), fold, plural, hyphens).alias("h")).collect()}
        assert got == {i: by_scanning(t, dict.fromkeys((a, b) for a, b in n if a), fold, plural, hyphens) if t and n else [] for i, t, n in rows}


def test_many_names_in_one_pass():
    given = [(f"name {i}", 0) for i in range(3000)]
    t = " ".join(f"name {i} said" for i in range(0, 60000, 2))
    began = time.perf_counter()
    found = names.find_in(t, given, False, False, False)
    assert len(found) == 1500 and time.perf_counter() - began < 5


def test_places_of_many_matches(spark):
    t = "ab cd " * 20000
    row = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(text.places(F.col("t"), "[a-z]+").alias("p")).collect()
    assert [(x.start, x.end, x.text) for x in row[0].p] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a-z]+", t)]
    assert row[1].p is None and row[2].p == []


def test_paths_between_by_breadth_first(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)] + [(None, 1), (3, 3), (100, 101)]
    pairs = [(rnd.randrange(42), rnd.randrange(42)) for _ in range(60)] + [(5, 5), (100, 1), (None, 2), (100, 101)]
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(a, b):
        if a == b:
            return [a]
        level, seen = {a: [a]}, {a}
        while level:
            after = {}
            for n, p in level.items():
                for m in near.get(n, ()):
                    if m not in seen:
                        after[m] = min(after.get(m, [10**9]), [*p, m])
            if b in after:
                return after[b]
            seen |= after.keys()
            level = after
        return None

    got = graph.paths_between(spark.createDataFrame(edges, "parent int, child int"), spark.createDataFrame(pairs, "a int, b int")).collect()
    want = {(a, b): least(a, b) for a, b in pairs if a is not None}
    assert {(r.a, r.b): list(r.path) for r in got} == {k: p for k, p in want.items() if p is not None}
    none = spark.createDataFrame([], "parent int, child int")
    assert graph.paths_between(none, spark.createDataFrame([(1, 2)], "a int, b int")).count() == 0


def test_paths_between_reads_few_rounds(spark, monkeypatch):
    read = []
    keep = graph.Rounds.keep
    monkeypatch.setattr(graph.Rounds, "keep", lambda self, df: (read.append(len(df.inputFiles())) if "/from-" in self.root or "/to-" in self.root else None, keep(self, df))[1])
    chain = [(i, i + 1) for i in range(16)]
    got = graph.paths_between(spark.createDataFrame(chain, "parent int, child int"), spark.createDataFrame([(0, 16)], "a int, b int")).first()
    assert list(got.path) == list(range(17))
    assert len(read) > 16 and max(read[-4:]) <= max(read[6:10])


def test_paths_within_tasks(spark, monkeypatch):
    rnd = random.Random(11)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(80)] + [(None, 1), (3, 3), (100, 101)]
    pairs = [(rnd.randrange(62), rnd.randrange(62)) for _ in range(200)] + [(5, 5), (100, 1), (None, 2), (100, 101)]
    edges, pairs = spark.createDataFrame(edges, "parent int, child int"), spark.createDataFrame(pairs, "a int, b int")
    by_rounds = sorted(graph.paths_between(edges, pairs).collect())
    assert len(by_rounds) > 100 and by_rounds == sorted(graph.paths_within(edges, pairs).collect()) == sorted(graph.paths_within(edges, pairs, most=1).collect())
    assert graph.paths_within(edges.where("false"), pairs.where("a <> b")).count() == 0
    kept, keep = [], graph.Rounds.keep
    monkeypatch.setattr(graph.Rounds, "keep", lambda self, df: (kept.append(self.root), keep(self, df))[1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "parent int, child int")
    monkeypatch.setattr(records, "_pairs", lambda spark, sf: spark.createDataFrame([("s0", "s300")], "a string, b string"))
    monkeypatch.setattr(records, "table", lambda spark, sf, name: chain.selectExpr("parent as s_suppkey", "0 as s_nationkey", "0 as s_acctbal").unionByName(spark.createDataFrame([(300, 0, 0)], "s_suppkey int, s_nationkey int, s_acctbal int")))
    assert records.paths_in_any_graph(spark, "").first().path.split("/") == [f"s{i}" for i in range(301)]
    assert len(kept) <= 5


def test_command_log_by_replaying(spark):
    rnd = random.Random(5)
    ops = ["company", "shelf", "offering", "registration", "resale", "effect", "odd", None]
    queue = [(seq, rnd.choice(ops), rnd.choice([1, 2, None, 3]), rnd.choice(["a", "b", "c", None]), rnd.choice(["a", "b", "c"]), rnd.choice([1, 2]), "x") for seq in rnd.sample(range(5000), 1500)]
    have, want = set(), {}
    rules = {r.op: r for r in command_log.RULES}
    names_ = ["seq", "op", "company_id", "accn", "offering_accn", "security_id", "status_before"]
    for row in sorted(queue):
        r, v = rules.get(row[1]), dict(zip(names_, row, strict=True))
        if r is None:
            want[row[0]] = ("rejected", "unknown op")
        elif any(v[c] is None for c in (*r.key, *r.by)):
            want[row[0]] = ("rejected", "no key")
        elif r.needs and (r.needs, *[v[c] for c in r.by]) not in have:
            want[row[0]] = ("rejected", r.missing)
        else:
            key = (r.op, *[v[c] for c in r.key])
            want[row[0]] = ("present" if key in have else "applied", None)
            have.add(key)
    df = spark.createDataFrame(queue, "seq long, op string, company_id long, accn string, offering_accn string, security_id long, status_before string")
    history = command_log.replay(df)
    got = {r.seq: (r.status, r.reason) for r in history.collect()}
    assert got == want and set(want.values()) >= {("applied", None), ("present", None), ("rejected", "no company")}
    assert command_log.made(history, "offering", ["company_id", "accn"]).count() == sum(k[0] == "offering" for k in have)
    assert command_log.replay(df.limit(0)).count() == 0


def test_early_registration_is_rejected(spark):
    none = spark.createDataFrame([], "company_id long, offering_accn string, security_id long")
    offerings = spark.createDataFrame([(1, "a", "a", 9)], "company_id long, accn string, shelf_accn string, seq long")
    new = spark.createDataFrame([(1, "a", 7, 3), (1, "a", 8, 10)], "company_id long, offering_accn string, security_id long, seq long")
    table, missed = commands.add_registrations(none, new, offerings, ["company_id", "offering_accn", "security_id"])
    assert [r.security_id for r in table.collect()] == [8] and [r.seq for r in missed.collect()] == [3]


def test_attributes_by_comparing_all(spark):
    import json

    rnd = random.Random(6)
    pick = lambda most: {k: str(rnd.randrange(2)) for k in rnd.sample("abcd", rnd.randrange(most))}
    held = [(c, i, json.dumps(pick(5))) for i, c in enumerate(rnd.choices([1, 2], k=60))] + [(1, 99, None), (2, 98, "no json")]
    asked = [(c, s, rnd.choice([pick(4), {}, None, {"a": None}, {"z": "1"}])) for s, c in enumerate(rnd.choices([1, 2, 3], k=200))]
    got = commands.by_attributes(spark.createDataFrame(asked, "company_id long, seq long, attributes map<string, string>"), spark.createDataFrame(held, "company_id long, id long, security_attributes string"))
    assert got.count() == len(asked)
    for r in got.collect():
        want = dict((s, a) for _, s, a in asked)[r.seq]
        hits = [i for c, i, j in held if c == r.company_id and j and j.startswith("{") and want and all(v is not None and json.loads(j).get(k) == v for k, v in want.items())]
        assert r.security_id == (min(hits) if hits else None), (r, hits)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan


def test_runs_over_bins(spark):
    rnd = random.Random(16)
    rows = [(k, p, label) for k in (1, 2) for p, label in enumerate(rnd.choices(["a", "a", "a", "b", None], k=90)) if rnd.random() < 0.95]
    want = []
    for k in (1, 2):
        mine = {p: label for j, p, label in rows if j == k and label}
        for p, label in sorted(mine.items()):
            if mine.get(p - 1) != label:
                last = p
                while mine.get(last + 1) == label:
                    last += 1
                want.append((k, label, p, last))
    df = spark.createDataFrame(rows, "k int, p long, l string")
    for width in (1, 4, 1 << 16):
        assert sorted(map(tuple, intervals.runs_of_equal(df, ["k"], "p", "l", width).collect())) == sorted(want)
