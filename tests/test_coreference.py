import random

from factloom.operators import coreference as C
from factloom.operators import text as T


def names(t):
    return [(n, m.text) for n, m in C.chains(t)]


def test_company_and_person():
    t = "In May Acme Holdings Corp. filed a report. The company sold shares to Mr. Smith. It waits. He kept his seat. Acme ended. We met Smith."
    assert names(t) == [(1, "Acme Holdings Corp."), (1, "The company"), (2, "Mr. Smith"), (1, "It"), (2, "He"), (2, "his"), (1, "Acme"), (2, "Smith")]


def test_number_and_kind_hold():
    t = "The agent paid the holders. They left. Ms. Lee saw the warrants. She sold them. These warrants are void."
    assert names(t) == [(1, "the holders"), (1, "They"), (2, "Ms. Lee"), (3, "the warrants"), (2, "She"), (3, "them"), (3, "These warrants")]
    # a woman is not taken up by he, nor one thing by they
    assert names("Ms. Lee came. He left.") == [] and names("The report came. They left.") == []
    # too far back
    assert names("The report came. A b. C d. E f. It left.") == []


def test_odd_texts():
    assert C.chains("") == [] and C.chains("...") == [] and names("It. It.") == [(1, "It"), (1, "It")]
    assert [m.text for m in C.mentions("Acme Inc. of N.J. sued. Co.")][0] == "Acme Inc."


def plainly(given):
    """The same sieves over lists of sets, each fact worked out anew from the members."""
    groups = [{i} for i in range(len(given))]
    of = lambda i: next(g for g in groups if i in g)

    def facts(g):
        # joined in order of index, the first to know decides; he and she say more than person
        beings = [given[i].being for i in sorted(g) if given[i].being]
        return next((given[i].number for i in sorted(g) if given[i].number), None), next((b for b in beings if b != "person"), beings[0] if beings else None)

    def agree(g, h):
        (n1, b1), (n2, b2) = facts(g), facts(h)
        people = {"person", "he", "she"}
        return (not n1 or not n2 or n1 == n2) and (not b1 or not b2 or b1 == b2 or ("person" in (b1, b2) and {b1, b2} <= people))

    def allowed(sieve, i, j):
        a, b, g = given[j], given[i], of(j)
        words = {w for k in g if given[k].kind != "pronoun" for w in given[k].words}
        heads = {given[k].head for k in g if given[k].kind != "pronoun"}
        if sieve == 0:
            return a.kind == b.kind != "pronoun" and a.words == b.words and a.head == b.head
        if sieve == 1:
            return "pronoun" not in (a.kind, b.kind) and b.head in heads and b.words <= words
        if sieve == 2:
            if b.kind == "phrase" and a.kind == "name":
                return b.head in ("company", "corporation", "registrant", "issuer") and facts(g)[1] == "thing"
            return a.kind == b.kind != "pronoun" and b.head in words
        return b.kind == "pronoun" and b.sentence - a.sentence <= C.REACH

    for sieve in range(4):
        for i, m in enumerate(given):
            if min(of(i)) != i:
                continue
            before = sorted(range(i), key=(lambda j: (m.sentence - given[j].sentence, j)) if sieve == 3 else (lambda j: -j))
            for j in before:
                g, h = of(j), of(i)
                if allowed(sieve, i, j) and g is not h and agree(g, h):
                    groups = [x for x in groups if x is not g and x is not h] + [g | h]
                    break
    return sorted(sorted(g) for g in groups if len(g) > 1)


def test_clusters_by_sets():
    rnd = random.Random(15)
    parts = ["Acme Corp.", "Acme Holdings Inc.", "Mr. Smith", "Ms. Smith", "Smith", "the company", "The warrants", "these warrants", "the new warrants", "the agent", "the director", "It", "it", "they", "He", "she", "them", "its"]
    for _ in range(400):
        t = " ".join(rnd.choice(parts) + rnd.choice([" paid", " of", "."]) for _ in range(rnd.randrange(1, 16)))
        given = C.mentions(t)
        found = {}
        for n, m in C.chains(t):
            found.setdefault(n, []).append(given.index(m))
        assert sorted(sorted(v) for v in found.values()) == plainly(given), t


def test_chains_feed_references(spark):
    docs = spark.createDataFrame([(1, "In May Acme Holdings Corp. filed a report. The company sold shares. It waits."), (2, None), (3, "")], "id long, t string")
    found = C.coreference(docs, "id", "t")
    aliases = spark.createDataFrame([(1, "Acme", 7, 26)], "id long, alias string, start int, end int")
    refs = T.chain_references(found.select("id", "chain", "start", "end"), aliases, "id").collect()
    assert sorted((r.alias, r.start) for r in refs) == [("Acme", 43), ("Acme", 68)]
