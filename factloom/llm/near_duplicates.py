"""Near-duplicate classes: MinHash coordinates, an inverted join over rare coordinates, exact confirmation.

Plan, for 100 TB: one pass computes each text's 5-word shingle set, its set key and 32 posting
keys. Texts with equal sets collapse to one representative before anything is joined, so a
group of a million copies costs one posting. Posting keys are counted (partial aggregation),
keys held once are dropped, and each representative posts only under its
``coordinates - threshold + 1`` rarest keys (prefix filter: two texts that agree in `threshold`
coordinates share one of them). Every posting list first links its members to its hub only,
the member whose keys are the most common. A list of n mutual near copies thus makes n-1
candidates, not n^2. A hub's candidates are posted under the coordinate-value pairs that they
share with it, and skip merging of those lists counts the collisions. Then the members of a hub's lists that are not in its largest component
meet the others of another component, so no link between components is left out: slices of
outsiders stay in a task's memory while the hub's members stream past; pairs that agree in enough of MARKS
further coordinates are confirmed there on full shingle sets, and only links leave the task.

Misses: how many coordinates and marks must agree follows from `percent`, so that a pair at
exactly that similarity fails them with probability under MISS and MARK_MISS: 16 of 32 and
190 of 256 at 85, 13 of 32 and 174 of 256 at 80.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textops import Scratch, Words, chunks, constants, lower_ascii, mix, slimming, table

COORDINATES, SHINGLE, PERCENT = 32, 5, 85
#: Further coordinates, kept as 8 bits each.
MARKS = 256
#: Probabilities that a pair at the least similarity has too few equal coordinates, or marks.
MISS, MARK_MISS = 1e-6, 3e-6
#: Shingles of the outsiders that one task holds in memory, about.
OUTSIDER_SHINGLES = 2_000_000
#: Members whose texts are compared with one hub's text, and whose posting lists are merged, in one task slice.
SLICE, MERGED = 64, 1024

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("keys", pa.list_(pa.int64())), ("marks", pa.binary())])


def agreeing(n: int, percent: int, miss: float, alike: float = 0.0) -> int:
    """The largest count that n coordinates of a pair at `percent` stay below with probability under `miss`; unequal minima agree with probability `alike`."""
    p = percent / 100
    p += (1 - p) * alike
    below, t = 0.0, 0
    while t < n and (below := below + math.comb(n, t) * p**t * (1 - p) ** (n - t)) < miss:
        t += 1
    return max(1, t)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle, none an empty set."""
    words = Words(lower_ascii(texts))
    shingles = words.windows(k)
    out = []
    for lo, hi in zip(words.first.tolist(), words.last.tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(shingles[lo : hi - k + 1]))
        elif hi > lo:
            h = np.uint64(hi - lo)
            for w in words.hash[lo:hi]:
                h = mix(np.array([h ^ w], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(k: int, coordinates: int):
    flips, odds, tags = constants(coordinates, 21), constants(coordinates, 22), constants(coordinates, 23)
    more_flips, more_odds = constants(MARKS, 24), constants(MARKS, 25)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in chunks(texts):
                sets = shingle_sets(part, k)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                keys = np.zeros((len(sets), coordinates), np.int64)
                marks = np.zeros((len(sets), MARKS), np.uint8)
                full = np.flatnonzero(sizes)
                a = b = np.zeros(len(sets), np.int64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                    a[full], b[full] = np.add.reduceat(flat, begin), np.add.reduceat(mix(flat ^ flips[0]), begin)
                    a, b = a.view(np.int64), b.view(np.int64)
                    for j in range(coordinates):
                        least = np.minimum.reduceat((flat ^ flips[j]) * odds[j], begin)
                        keys[full, j] = mix(least ^ tags[j]).view(np.int64)
                    for j in range(MARKS):
                        least = np.minimum.reduceat((flat ^ more_flips[j]) * more_odds[j], begin)
                        marks[full, j] = (mix(least) & np.uint64(0xFF)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, coordinates, dtype=np.int32), pa.array(keys.ravel()))
                yield table(_SIGNED, ids[at : at + len(part)], sizes, a, b, lists, [m.tobytes() for m in marks])

    return run


def signatures(docs: DataFrame, k: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, set key (set_a, set_b) and the posting keys of each text; one key per coordinate-value pair."""
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return cols.mapInArrow(slimming(_signed(k, coordinates)), "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, marks binary")


_CHECKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def merge_skip(lists: list[list[int]], least: int) -> list[int]:
    """What stands on at least `least` (1 or more) of the sorted lists.

    Where the smallest head stands on too few lists, the `least - 1` smallest heads all skip to the next one:
    nothing before it stands on any other list.
    """
    heap = [(held[0], i) for i, held in enumerate(lists) if held]
    heapify(heap)
    at, found = [0] * len(lists), []
    while len(heap) >= least:
        low, taken = heap[0][0], []
        while heap and heap[0][0] == low:
            taken.append(heappop(heap)[1])
        if len(taken) >= least:
            found.append(low)
            to = low + 1
        else:
            while len(taken) < least - 1:
                taken.append(heappop(heap)[1])
            to = heap[0][0]
        for i in taken:
            at[i] = bisect_left(lists[i], to, at[i])
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))
    return found


def _collide(least: int):
    """Pairs of hub and member whose keys agree in `least` coordinates; a slice's hub stands before its members."""

    def run(batches):
        group, hubs = None, []
        for batch in batches:
            a, s, ids, is_hub = (batch.column(i).to_pylist() for i in range(4))
            keys = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            at, out = 0, []
            while at < len(ids):
                if (a[at], s[at]) != group:
                    group, hubs = (a[at], s[at]), []
                end = at
                while end < len(ids) and (a[end], s[end]) == group and is_hub[end] == is_hub[at]:
                    end += 1
                if is_hub[at]:
                    hubs += list(keys[at:end].copy())
                else:
                    found: set[int] = set()
                    for hub in hubs:
                        coordinate, member = np.nonzero((keys[at:end] == hub).T)
                        posted = np.split(member, np.searchsorted(coordinate, np.arange(1, len(hub))))
                        found.update(merge_skip([p.tolist() for p in posted], least))
                    out += [(group[0], ids[at + x]) for x in sorted(found)]
                at = end
            if out:
                yield table(_CHECKED, *zip(*out, strict=True))

    return run


def _compare(k: int, percent: int):
    def run(batches):
        group, hub_set = None, None
        for batch in batches:
            a, s, ids, is_hub, texts = (batch.column(i).to_pylist() for i in range(5))
            for at, part in chunks(texts):
                out = []
                for i, found in enumerate(shingle_sets(part, k), at):
                    if is_hub[i]:
                        group, hub_set = (a[i], s[i]), found
                    elif (a[i], s[i]) == group:
                        both = len(np.intersect1d(found, hub_set, assume_unique=True))
                        if 100 * both >= percent * (len(found) + len(hub_set) - both):
                            out.append((a[i], ids[i]))
                if out:
                    yield table(_CHECKED, *zip(*out, strict=True))

    return run


def _meet(threshold: int, k: int, percent: int):
    """Links between a slice's outsiders, held as shingle sets, and the hub's members that stream past."""

    def run(batches):
        group, names, parts, rows, sets = None, [], [], [], []
        for batch in batches:
            a, s, reps, part, kind, marks, texts = (batch.column(i).to_pylist() for i in range(7))
            g = list(zip(a, s, strict=True))
            at = 0
            while at < len(g):
                if g[at] != group:
                    group, names, parts, rows, sets = g[at], [], [], [], []
                end = at
                while end < len(g) and g[end] == group and kind[end] == kind[at]:
                    end += 1
                if kind[at] == 0:
                    names += reps[at:end]
                    parts += part[at:end]
                    rows += [np.frombuffer(m, np.uint8) for m in marks[at:end]]
                    for _, held in chunks(texts[at:end]):
                        sets += shingle_sets(held, k)
                elif names:
                    held = np.frombuffer(b"".join(marks[at:end]), np.uint8).reshape(-1, MARKS)
                    comp = np.array(part[at:end])
                    near: dict[int, list[int]] = {}
                    for x, m in enumerate(rows):
                        for y in np.flatnonzero(((held == m).sum(1) >= threshold) & (comp != parts[x])).tolist():
                            near.setdefault(y, []).append(x)
                    met = sorted(near)
                    for first, some in chunks([texts[at + y] for y in met]):
                        out = []
                        for y, found in zip(met[first:], shingle_sets(some, k), strict=False):
                            for x in near[y]:
                                both = len(np.intersect1d(found, sets[x], assume_unique=True))
                                if 100 * both >= percent * (len(found) + len(sets[x]) - both):
                                    out.append((names[x], reps[at + y]))
                        if out:
                            yield table(_CHECKED, *zip(*out, strict=True))
                at = end

    return run


def streams(pairs: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """a, s, doc_id, hub and the second column of held (doc_id, ...) for both ends of the pairs (a, b).

    Pairs are grouped by a in slices of about `width` partners; a slice streams through one task,
    its hub first, so memory holds what one hub has and one chunk of members.
    """
    n = pairs.groupBy("a").agg(F.count("*").alias("n"))
    sliced = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / width)).alias("s"))
    ask = sliced.select("a", "s", F.col("b").alias("doc_id"), F.lit(False).alias("hub"))
    ask = ask.unionByName(sliced.select("a", "s", F.col("a").alias("doc_id"), F.lit(True).alias("hub")).distinct())
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # merge: what the ends hold is too large to broadcast at any size worth planning for
    met = ask.hint("merge").join(held, "doc_id").select("a", "s", "doc_id", "hub", held.columns[1])
    return met.repartition(parts, "a", "s").sortWithinPartitions("a", "s", F.desc("hub"))


def colliding(pairs: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose keys (doc_id, keys) agree in `least` coordinates, by skip merging."""
    return streams(pairs, keys, MERGED).mapInArrow(slimming(_collide(least)), "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    return streams(pairs, texts, SLICE).mapInArrow(slimming(_compare(k, percent)), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, threshold: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts whose shingle sets meet ``100 * |A & B| >= percent * |A | B|`` are linked. Null, empty
    and blank texts have no shingles and are linked with nothing. doc_id identifies a document;
    a repeated row gets the same values as its first. A row without doc_id forms no link
    and has a null component. Extra columns are ignored; an empty table gives no rows.
    """
    threshold = threshold or agreeing(coordinates, percent, MISS)
    marks_alike = agreeing(MARKS, percent, MARK_MISS, 1 / 256)
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.keep(signatures(docs, k, coordinates))
    owner = signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("marks").alias("marks"))
    owner = scratch.keep(owner)
    reps = owner.select("rep", "keys")
    posts = reps.select("rep", F.explode("keys").alias("key"))
    common = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    prefix = coordinates - threshold + 1
    ranked = posts.join(common, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held"), F.sum("n").alias("weight"))
    # a key held once stands before every other in the order, and takes one place of the prefix
    room = F.lit(prefix) - (F.lit(coordinates) - F.size("held"))
    lists = scratch.keep(ranked.where(room > 0).select("rep", "weight", F.explode(F.slice("held", 1, room)).alias("h")).select("rep", "weight", F.col("h.key").alias("key")))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    first = lists.groupBy("key").agg(F.min_by("rep", F.struct(-F.col("weight"), F.col("rep"))).alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    cluster = scratch.keep(lists.join(first, "key").select("a", "rep").distinct())
    star = cluster.where("rep <> a").select("a", F.col("rep").alias("b"))
    star = scratch.keep(colliding(star, reps.withColumnRenamed("rep", "doc_id"), threshold))
    links = scratch.keep(confirmed(star, texts, k, percent))
    parts = components(links, scratch)

    member = cluster.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("a", "rep", F.coalesce("component", "rep").alias("part"))
    member = scratch.keep(member.join(owner.select("rep", "n_shingles"), "rep"))
    sizes = member.groupBy("a", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    main = sizes.groupBy("a").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"), (F.sum("weight") - F.max_by("weight", F.struct("n", "part"))).alias("odd")).where("parts > 1")
    # every slice of a hub's outsiders meets all its members
    slices = F.ceil(F.col("odd") / OUTSIDER_SHINGLES)
    met = member.join(main, "a")
    odd = met.where("part <> main").select("a", "rep", "part", F.pmod(F.xxhash64("rep"), slices).alias("s"), F.lit(0).alias("kind"))
    rest = met.select("a", "rep", "part", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("s"), F.lit(1).alias("kind"))
    both = odd.unionByName(rest).join(owner.select("rep", "marks"), "rep")
    both = both.hint("merge").join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("a", "s", "rep", "part", "kind", "marks", "text")
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cross = both.repartition(shuffles, "a", "s").sortWithinPartitions("a", "s", "kind").mapInArrow(slimming(_meet(marks_alike, k, percent)), "a long, b long")
    links = links.unionByName(cross)
    parts = components(links, scratch)

    of_set = owner.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(of_set, ["n_shingles", "set_a", "set_b"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
