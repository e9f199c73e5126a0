"""Trees and directed graphs as edge tables (parent, child), by path doubling.

A round joins the paths of k edges with what they reach, so a chain of n edges takes log2(n) rounds, whatever its depth; each
round is written to the shared folder and ends the lineage before it. A round that adds no pair is the last, so cycles end too. Only
counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Rounds


def _steps(edges: DataFrame) -> DataFrame:
    """Distinct edges (child, ancestor) with both ends known, without loops."""
    return edges.where(F.col("parent").isNotNull() & F.col("child").isNotNull() & (F.col("parent") != F.col("child"))).select("child", F.col("parent").alias("ancestor")).distinct()


def _beyond(paths: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of `more` (child, ...) that start where `paths` (child, ancestor) end, with the start of the path as child."""
    ends = paths.select("child", F.col("ancestor").alias("_via"))
    return ends.join(more.withColumnRenamed("child", "_via"), "_via").drop("_via")


def ancestors(edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth): every ancestor once, with the least number of edges to it; a node is not its own ancestor. Edges with a null end are left out."""
    rounds = Rounds(edges.sparkSession, "ancestors")
    exact = rounds.keep(_steps(edges))  # pairs joined by a path of exactly `reach` edges
    closure, reach = rounds.keep(exact.withColumn("depth", F.lit(1).cast("long"))), 1
    known = closure.count()
    while known:
        far = _beyond(exact, closure).select("child", "ancestor", (F.col("depth") + reach).alias("depth")).where("child <> ancestor")
        closure = rounds.keep(closure.unionByName(far).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        if (now := closure.count()) == known:
            break
        exact, known, reach = rounds.keep(_beyond(exact, exact).distinct()), now, 2 * reach
        rounds.drop_before(2)
    rounds.drop_before()  # the last table kept is the closure
    return closure


def root_paths(edges: DataFrame) -> DataFrame:
    """(leaf, path): the nodes from each root to each leaf, root first; a path visits a node once. A path is assembled from pieces of 2^i edges."""
    rounds = Rounds(edges.sparkSession, "paths")
    steps = rounds.keep(_steps(edges))
    parents, children = steps.select(F.col("ancestor").alias("node")).distinct(), steps.select(F.col("child").alias("node")).distinct()
    ends = parents.join(children, "node", "left_anti")
    down = rounds.keep(ends.select("node", F.array("node").alias("path")))  # paths from a root of fewer than `reach` edges
    pieces = rounds.keep(steps.select(F.col("ancestor").alias("first"), F.col("child").alias("last"), F.array("child").alias("rest")))
    while not pieces.isEmpty():
        longer = down.join(pieces, F.col("node") == F.col("first")).where(~F.arrays_overlap("path", "rest"))
        down = rounds.keep(down.unionByName(longer.select(F.col("last").alias("node"), F.concat("path", "rest").alias("path"))))
        a, b = pieces.alias("a"), pieces.alias("b")
        joined = a.join(b, F.col("a.last") == F.col("b.first")).where(~F.arrays_overlap("a.rest", "b.rest") & ~F.array_contains(F.col("b.rest"), F.col("a.first")))
        pieces = rounds.keep(joined.select(F.col("a.first").alias("first"), F.col("b.last").alias("last"), F.concat("a.rest", "b.rest").alias("rest")))
    return down.join(parents, "node", "left_anti").select(F.col("node").alias("leaf"), "path")


def ultimate_origins(edges: DataFrame) -> DataFrame:
    """(child, origin): the ancestors without a parent."""
    up = ancestors(edges)
    return up.join(edges.select(F.col("child").alias("ancestor")).distinct(), "ancestor", "left_anti").select("child", F.col("ancestor").alias("origin")).distinct()


def _with_self(edges: DataFrame) -> DataFrame:
    """The closure with each node as its own ancestor at depth 0."""
    own = edges.select(F.explode(F.array("parent", "child")).alias("child")).where("child is not null").distinct()
    return ancestors(edges).unionByName(own.select("child", F.col("child").alias("ancestor"), F.lit(0).cast("long").alias("depth")))


def _meetings(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, m: struct<total, meeting, da, db>): the nearest common ancestor of each pair."""
    left = closure.select(F.col("child").alias("a"), "ancestor", F.col("depth").alias("da"))
    right = closure.select(F.col("child").alias("b"), "ancestor", F.col("depth").alias("db"))
    met = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "ancestor"])
    return met.groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("total"), F.col("ancestor").alias("meeting"), "da", "db")).alias("m"))


def tree_distance(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, distance, meeting): number of nodes on the path of each pair (a, b), through the nearest common ancestor; pairs without one have no row."""
    return _meetings(_with_self(edges), pairs).select("a", "b", (F.col("m.total") + 1).cast("int").alias("distance"), F.col("m.meeting").alias("meeting"))


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, path): the path between two nodes of a tree (a child has one parent), edges taken either way: up from a to the nearest common ancestor, down to b."""
    closure = _with_self(edges)
    met = _meetings(closure, pairs).select("a", "b", "m.da", "m.db")
    up = met.join(closure.select(F.col("child").alias("a"), "ancestor", "depth"), "a").where("depth <= da").select("a", "b", F.col("depth").alias("at"), "ancestor")
    down = met.join(closure.select(F.col("child").alias("b"), "ancestor", "depth"), "b").where("depth < db").select("a", "b", (F.col("da") + F.col("db") - F.col("depth")).alias("at"), "ancestor")
    nodes = up.unionByName(down).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("at", "ancestor"))).alias("n"))
    return nodes.select("a", "b", F.col("n.ancestor").alias("path"))


def paths_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, path): the shortest path of each pair in any graph, edges taken either way, of equally short ones the least node by node; pairs that no path joins have no row.

    A search from both ends of all pairs at once: each round one side's frontier steps to its neighbours; new nodes meet the other side's
    frontier, and a pair that has met, or whose frontier is empty, leaves. So nodes within half the distance are
    seen, cycles and several parents do no harm, and the rounds are as many as the longest path asked for has edges. A row holds numbers, not the path: nodes are
    numbered in their order, and a row names the one before it. A round's nodes have neighbours in the two rounds of its side before it only, so it is compared with
    those alone. Each round is a table; the paths are read back from them at the end, and then they are deleted. Pairs are taken once; those with a
    null end and edges with a null end or two equal ends are left out; a node's path to itself is the node.
    """
    spark = edges.sparkSession
    rounds, held, ends = Rounds(spark, "steps"), [Rounds(spark, side) for side in ("from", "to")], Rounds(spark, "met")
    names, steps, asked, out = _numbered(rounds, edges, pairs)
    one, alive = F.lit(1).cast("long"), asked.select("pair")
    # (pair, node, place, back): the nodes at a distance from one end. From a, place is that of a node's least path among those of the pair, and back the place of the
    # node before it; from b, place is the node, and back the next one
    levels = [[held[0].keep(asked.select("pair", F.col("n_a").alias("node"), one.alias("place"), one.alias("back")))], [held[1].keep(asked.select("pair", F.col("n_b").alias("node"), F.col("n_b").alias("place"), F.col("n_b").alias("back")))]]
    met, side = [], 0
    while not alive.isEmpty():
        least = levels[side][-1].join(alive, "pair", "left_semi").join(steps, "node").groupBy("pair", F.col("next").alias("node")).agg(F.min("place").alias("back"))
        known = reduce(DataFrame.unionByName, [level.select("pair", "node") for level in levels[side][-2:]])
        fresh = least.join(known.hint("merge"), ["pair", "node"], "left_anti")
        place = F.row_number().over(W.partitionBy("pair").orderBy("back", "node")).cast("long") if side == 0 else F.col("node")
        fresh = held[side].keep(fresh.select("pair", "node", place.alias("place"), "back"))
        levels[side].append(fresh)
        there = levels[1 - side][-1].select("pair", "node", F.col("place").alias("_place"))
        hit = F.when(F.col("_place").isNotNull(), F.col("place" if side == 0 else "_place"))
        state = ends.keep(fresh.join(there.hint("merge"), ["pair", "node"], "left").groupBy("pair").agg(F.min(hit).alias("place")))
        alive = state.where("place is null").select("pair")
        met.append((state.where("place is not null"), len(levels[0]) - 1, len(levels[1]) - 1))
        side = 1 - side
    walks = Rounds(spark, "walks")
    if met:
        up = _walk_back(walks, levels[0], [(m.withColumn("path", F.array().cast("array<long>")), at) for m, at, _ in met])
        # the meeting is the last node of its way from a, and the place to go on from towards b
        down = _walk_back(walks, levels[1], [(up.where(F.size("path") == at + 1).select("pair", F.element_at("path", -1).alias("place"), F.array().cast("array<long>").alias("path")).join(m.select("pair"), "pair", "left_semi"), on) for m, at, on in met])
        whole = F.concat("path", F.slice(F.reverse("rest"), 2, F.greatest(F.size("rest") - 1, F.lit(0))))
        both = walks.keep(up.join(down.withColumnRenamed("path", "rest"), "pair").select("pair", F.posexplode(whole).alias("at", "node")))
        out = out.unionByName(_named(asked, names, both))
    found = Rounds(spark, "paths").keep(out)
    for r in (rounds, *held, ends, walks):
        r.drop_before(0)
    return found


def _numbered(rounds: Rounds, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The nodes' names (name, node) numbered in their order, the steps (node, next) both ways, the pairs asked for (a, b, n_a, n_b, pair), and the paths of nodes to themselves."""
    number, apart = F.monotonically_increasing_id(), edges.where("parent <> child")
    pairs = pairs.where("a is not null and b is not null").select("a", "b").distinct()
    # ordered partitions are numbered in order
    names = rounds.keep(apart.select(F.explode(F.array("parent", "child")).alias("name")).distinct().orderBy("name").withColumn("node", number))
    numbered = lambda df, *columns: reduce(lambda d, c: d.join(names.select(F.col("name").alias(c), F.col("node").alias(f"n_{c}")), c), columns, df)
    one_way = numbered(apart, "parent", "child").select(F.col("n_parent").alias("node"), F.col("n_child").alias("next"))
    steps = rounds.keep(one_way.unionByName(one_way.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct())
    asked = rounds.keep(numbered(pairs.where("a <> b"), "a", "b").withColumn("pair", number))
    return names, steps, asked, pairs.where("a = b").select("a", "b", F.array("a").alias("path"))


def _named(asked: DataFrame, names: DataFrame, walked: DataFrame) -> DataFrame:
    """(a, b, path) of paths as rows (pair, at, node)."""
    paths = walked.join(names, "node").groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("at", "name")))["name"].alias("path"))
    return asked.join(paths, "pair").select("a", "b", "path")


#: Steps of a graph that a task may hold, two an edge: at four steps a node 28 MB of a broadcast and 290 MB of a worker.
HELD_STEPS = 4_000_000


def paths_within(edges: DataFrame, pairs: DataFrame, most: int = HELD_STEPS) -> DataFrame:
    """The rows of paths_between. Of a graph of at most `most` steps, each task holds the steps and searches its share of the pairs on its own, so no node that a search has seen is shuffled or written.

    The smaller of a pair's two frontiers steps next, and a search keeps what it has seen of one pair. Larger graphs go by the rounds of paths_between.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark, "steps")
    names, steps, asked, out = _numbered(rounds, edges, pairs)
    if steps.count() > most:
        rounds.drop_before(0)
        return paths_between(edges, pairs)
    import numpy as np

    start, end = (c.to_numpy() for c in steps.toArrow().columns)
    nodes, places = np.unique(start, return_inverse=True)
    ends = np.searchsorted(nodes, end)[np.argsort(places, kind="stable")]
    graph = spark.sparkContext.broadcast((nodes, np.cumsum(np.bincount(places, minlength=len(nodes))).astype("int32"), ends.astype("int32")))

    def search(batches):
        nodes, stops, ends = graph.value
        ends, stops = ends.tolist(), stops.tolist()
        beside = [tuple(ends[i:j]) for i, j in zip([0, *stops], stops, strict=False)]
        for batch in batches:
            a, b = (np.searchsorted(nodes, batch.column(c).to_numpy()).tolist() for c in (1, 2))
            ways = [w and nodes[w] for w in (_way(beside.__getitem__, *x) for x in zip(a, b, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ways, pa.list_(pa.int64()))], names=["pair", "way"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ways = rounds.keep(asked.select("pair", "n_a", "n_b").repartition(parts).mapInArrow(search, "pair long, way array<long>"))
    found = Rounds(spark, "paths").keep(out.unionByName(_named(asked, names, ways.select("pair", F.posexplode("way").alias("at", "node")))))
    graph.destroy()
    rounds.drop_before(0)
    return found


def _way(beside: Callable[[int], tuple[int, ...]], a: int, b: int) -> list[int] | None:
    """The shortest way between two nodes, of equally short ones the least node by node; None if nothing joins them."""
    up, down = [{a}], [{b}]
    while up[-1].isdisjoint(down[-1]):
        side = up if len(up[-1]) <= len(down[-1]) else down
        fresh = set().union(*map(beside, side[-1])).difference(*side[-2:])
        if not fresh:
            return None
        side.append(fresh)
    # of those seen from a, the nodes on a shortest way stay
    up[-1] &= down[-1]
    for near, far in zip(up[-2::-1], up[:0:-1], strict=True):
        near &= set().union(*map(beside, far))
    way = [a]
    for level in (*up[1:], *down[-2::-1]):
        way.append(min(level.intersection(beside(way[-1]))))
    return way


def _walk_back(walks: Rounds, levels: list[DataFrame], met: list[tuple[DataFrame, int]], stride: int = 6) -> DataFrame:
    """(pair, path): from places (pair, place, path), each at its distance, to the end where the search began, a level a join. The path is in order from that end."""
    now = None
    for at in range(len(levels) - 1, -1, -1):
        for start in [m for m, depth in met if depth == at]:
            now = start if now is None else now.unionByName(start)
        if now is not None:
            now = now.join(levels[at].select("pair", "place", "back", "node"), ["pair", "place"]).select("pair", F.col("back").alias("place"), F.concat(F.array("node"), "path").alias("path"))
            if at % stride == 0:
                now = walks.keep(now)
    return now.select("pair", "path")


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones; an edge exists once."""
    return edges.unionByName(new.select(*edges.columns)).distinct()


def remove_node(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges without those of the nodes."""
    gone = nodes.select(F.col(node).alias("_n"))
    return edges.join(gone, F.col("parent") == F.col("_n"), "left_anti").join(gone, F.col("child") == F.col("_n"), "left_anti")


def match_pattern(tokens: DataFrame, edges: DataFrame, pattern: list[dict]) -> DataFrame:
    """Dependency patterns: one row per match, a column per pattern node holding its token.

    pattern: nodes as {id, attrs: {column: value or list}, not: {column: list}, of: id of an earlier node, op, optional}. op relates the
    earlier node A to this node B: "<" B is A's head, "<<" an ancestor, ">" a child, ">>" a descendant. Optional nodes
    join to null. tokens: (doc, token, attributes); edges: (doc, parent, child).
    """
    def nodes(p: dict) -> DataFrame:
        out = tokens
        for c, v in p.get("attrs", {}).items():
            out = out.where(F.col(c).isin(v if isinstance(v, list) else [v]))
        for c, v in p.get("not", {}).items():
            out = out.where(~F.col(c).isin(v))
        return out.select("doc", F.col("token").alias(p["id"]))

    step = edges.select("doc", "parent", "child")
    # nodes of the closure carry their document: token numbers repeat across documents
    node = lambda c: F.struct(F.col("doc"), F.col(c).alias("token"))
    closure = None
    out = nodes(pattern[0])
    for p in pattern[1:]:
        if p["op"] in ("<<", ">>") and closure is None:
            up = ancestors(edges.select(node("parent").alias("parent"), node("child").alias("child")))
            closure = up.select(F.col("child.doc").alias("doc"), F.col("ancestor.token").alias("parent"), F.col("child.token").alias("child"))
        pairs = closure if p["op"] in ("<<", ">>") else step
        a, b = ("child", "parent") if p["op"] in ("<", "<<") else ("parent", "child")
        near = pairs.select("doc", F.col(a).alias(p["of"]), F.col(b).alias(p["id"])).join(nodes(p), ["doc", p["id"]])
        out = out.join(near, ["doc", p["of"]], "left" if p.get("optional") else "inner")
    return out.select("doc", *[p["id"] for p in pattern])
