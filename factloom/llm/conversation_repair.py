"""Conversation repair: the cheapest edits that give a conversation the order of roles it should have.

A node of the edit lattice is (rows consumed, grammar state); its edges keep, rerole or delete the next row, or insert a row. Dijkstra runs on the
implicit lattice with the key (cost, audit), the audit being the edits' initials so far, and stops at the first accepting end node it pops.
Every edge makes the key larger (an edit costs something or lengthens the audit). Two audits of one cost at one node differ before either ends: the rows fix what an
audit costs, so one that goes on would cost an insertion more. Hence the order of audits survives what is appended, and a node's first pop is its best.

Plan, for 100 TB. Rows are sorted by conversation and turn over range partitions, so a conversation of any size is spread over tasks. Streaming over a
partition, a task closes a *segment* after SEGMENT_ROWS rows or SEGMENT_BYTES. A conversation that lies whole in one segment inside a partition is
finished there. The others (at the partition's edges, or long) write segments. Texts seen in earlier segments come from a window over digests; each segment
is searched from every grammar state to every other, which gives a 4 x 4 table of (cost, audit); a stream over a conversation's segments then adds the tables up, and
carries one hash for each state. So what grows with a conversation is its audit, which the result holds anyway, and the hash, which must read
the repaired texts in order: those pass one task, a segment at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textops import Scratch, slimming

#: The costs.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 4 << 20
#: Grammar states of s?(ua)+ or nothing, and the state after each initial.
START, SYSTEM, USER, DONE = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": DONE}, {"u": USER})
#: The role that a reroled or inserted row takes in each state.
ROLE = ("user", "user", "assistant", "user")
ACCEPTING = (START, DONE)
LEGAL = {"su", "ua", "au"}

_BLANKS = " \t\n\x0b\x0c\r"

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_PART = [("segment", pa.int64()), ("rows", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))), ("digests", pa.list_(pa.binary()))]
_SEGMENT = pa.schema([*_RESULT, *_PART])
SEGMENT = f"{RESULT}, segment long, rows array<struct<turn: long, role: string, text: string>>, digests array<binary>"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as damaged by crc32(conv_id:turn) % 20; copies is 0 for a dropped row and 2 for a repeated one. Nulls read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows as they are."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.lit(1).alias("copies"))


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def faults(rows: list[tuple], digests: list[bytes], seen: set[bytes]) -> list[str]:
    """Each row's first fault: blank, duplicate, truncated, or an empty string. rows: (turn, role, text); seen: digests of the rows before."""
    out, seen = [], set(seen)
    for (_, _, text), d in zip(rows, digests, strict=True):
        shown = text.rstrip(_BLANKS)[-1:]
        out.append("blank" if not shown else "duplicate" if d in seen else "truncated" if shown not in ".!?" else "")
        seen.add(d)
    return out


def search(initials: list[str], faulty: list[str], start: int, ends: tuple[int, ...], first: bool) -> dict[int, tuple[int, str]]:
    """Dijkstra from (0, start): the best (cost, audit) at each end state in `ends`; with `first`, of the first one popped only."""
    n, best, done = len(initials), {}, set()
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ends:
            best[state] = cost, audit
            if first or len(best) == len(ends):
                break
        take = NEXT[state][ROLE[state][0]]
        heappush(heap, (cost + INSERT, audit + "I", i, take))
        if i < n:
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if faulty[i] not in ("blank", "duplicate"):
                more = TRUNCATED if faulty[i] else 0
                heappush(heap, (cost + more + REROLE, audit + "R", i + 1, take))
                if (kept := NEXT[state].get(initials[i])) is not None:
                    heappush(heap, (cost + more, audit + "K", i + 1, kept))
    return best


def repaired(rows: list[tuple], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows as the audit leaves them, from a grammar state on."""
    at = 0
    for edit in audit:
        role, text = ROLE[state], ""
        if edit != "I":
            _, own, text = rows[at]
            at += 1
            if edit == "D":
                continue
            role = own if edit == "K" else role
        yield role, text
        state = NEXT[state][role[:1]]


def _lines(sha, wrote: bool, rows, audit: str, state: int):
    """The hash with the repaired lines added, and whether it holds any."""
    for role, text in repaired(rows, audit, state):
        sha.update(f"{chr(10) if wrote else ''}{role}:{text}".encode())
        wrote = True
    return wrote


@dataclass
class Tally:
    """Counts over the rows of a conversation that have come so far, in order."""

    low: int | None = None
    high: int | None = None
    turns: int = 0
    last: int | None = None
    initial: str | None = None
    illegal: int = 0
    faults: dict[str, int] = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0})

    def add(self, rows: list[tuple], initials: list[str], found: list[str]) -> None:
        for (turn, _, _), initial, fault in zip(rows, initials, found, strict=True):
            if turn is not None:
                self.turns += turn != self.last
                self.low = turn if self.low is None else self.low
                self.high = self.last = turn
            if self.initial is not None and self.initial + initial not in LEGAL:
                self.illegal += 1
            self.initial = initial
            if fault:
                self.faults[fault] += 1

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def repair(conv_id, rows: list[tuple], digests: list[bytes]) -> tuple:
    """The result row of a conversation held whole."""
    initials, found, tally = [r[1][:1] for r in rows], faults(rows, digests, set()), Tally()
    tally.add(rows, initials, found)
    ((cost, audit),) = search(initials, found, START, ACCEPTING, True).values()
    sha = hashlib.sha256()
    _lines(sha, False, rows, audit, START)
    return conv_id, tally.gaps(), *tally.faults.values(), tally.illegal, cost, audit, sha.hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


def _segments(most_rows: int, most_bytes: int):
    empty = (None,) * len(_RESULT)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        segment = (task.partitionId() if task else 0) << 32
        out, size = [], 0
        rows, held, conv, whole, started = [], 0, None, False, False

        def close(last: bool):
            """Ends the segment; a conversation that began and ended inside this partition, in one segment, is done."""
            nonlocal segment, size
            digests = [digest(role, text) for _, role, text in rows]
            if whole and last:
                out.append((*repair(conv, rows, digests), None, None, None))
            else:
                # a digest once a segment, so that one common row is one row a segment
                out.append((conv, *empty[1:], segment, [{"turn": t, "role": r, "text": x} for t, r, x in rows], sorted(set(digests))))
                size += held
            segment += 1

        for batch in batches:
            for conv_id, turn, role, text, copies in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if not started or conv_id != conv:
                    if started:
                        close(True)
                    # the partition's first conversation may have begun in the one before
                    conv, whole, started, rows, held = conv_id, started, True, [], 0
                elif len(rows) >= most_rows or held >= most_bytes:
                    close(False)
                    rows, held, whole = [], 0, False
                rows += [(turn, role, text)] * copies
                held += copies * (len(text) + len(role))
                if len(out) >= 512 or size >= most_bytes:
                    yield _batch(out, _SEGMENT)
                    out, size = [], 0
        if started:
            close(False)  # may go on in the next partition
        if out:
            yield _batch(out, _SEGMENT)

    return run


_SEARCHED = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("rows", _PART[1][1]), ("faults", pa.list_(pa.string())), ("paths", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
SEARCHED = "conv_id long, segment long, rows array<struct<turn: long, role: string, text: string>>, faults array<string>, paths array<struct<start: int, end: int, cost: long, audit: string>>"


def _plain(rows) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"]) for r in rows]


def _search_segments(batches):
    for batch in batches:
        for conv, segment, rows, seen in zip(*[batch.column(i) for i in range(4)], strict=True):
            given = rows.as_py()
            own = _plain(given)
            found = faults(own, [digest(r, t) for _, r, t in own], set(seen.as_py() or ()))
            initials = [r[1][:1] for r in own]
            paths = [
                {"start": s, "end": e, "cost": cost, "audit": audit}
                for s in range(4)
                for e, (cost, audit) in search(initials, found, s, tuple(range(4)), False).items()
            ]
            yield _batch([(conv.as_py(), segment.as_py(), given, found, paths)], _SEARCHED)


def _fold(batches):
    """Adds up the tables of a conversation's segments, which come in order."""
    started, conv = False, None

    def result():
        cost, audit, sha, _ = min((states[s] for s in ACCEPTING if s in states), key=lambda x: x[:2])
        return conv, tally.gaps(), *tally.faults.values(), tally.illegal, cost, audit, sha.hexdigest()

    for batch in batches:
        for conv_id, rows, found, paths in zip(*[batch.column(i) for i in range(4)], strict=True):
            conv_id, rows, found = conv_id.as_py(), _plain(rows.as_py()), found.as_py()
            if not started or conv_id != conv:
                if started:
                    yield _batch([result()], _RESULT)
                started, conv, tally, states = True, conv_id, Tally(), {START: (0, "", hashlib.sha256(), False)}
            tally.add(rows, [r[1][:1] for r in rows], found)
            best: dict[int, tuple] = {}
            for p in paths.as_py():
                if p["start"] in states:
                    cost, audit, _, _ = states[p["start"]]
                    met = cost + p["cost"], audit + p["audit"], p["start"], p["audit"]
                    if p["end"] not in best or met < best[p["end"]]:
                        best[p["end"]] = met
            fresh = {}
            for end, (cost, audit, start, own) in best.items():
                _, _, sha, wrote = states[start]
                sha = sha.copy()
                wrote = _lines(sha, wrote, rows, own, start)
                fresh[end] = cost, audit, sha, wrote
            states = fresh
    if started:
        yield _batch([result()], _RESULT)


def repair_conversations(damaged: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    damaged: (conv_id, turn, role, text, copies), as damage() or undamaged() give it. Rows stand by turn, nulls first; those of one turn by role, then by the
    md5 of their text; copies stand side by side. Null conv_ids are one conversation. Roles are read by their initial; one that is not s, u or a is kept by no
    edit. A conversation all of whose rows were dropped has zeros, an empty audit and the hash of nothing. Texts may be of any length. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = damaged.sparkSession
    keep = Scratch(spark, "repair").keep
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = damaged.select("conv_id", "turn", "role", "text", "copies").withColumn("tie", F.md5("text"))
    order = ["conv_id", "turn", "role", "tie"]
    ranged = given.repartitionByRange(parts, "conv_id", "turn", F.substring("role", 1, 64), "tie").sortWithinPartitions(*order).drop("tie")
    cut = keep(ranged.mapInArrow(slimming(_segments(segment_rows, segment_bytes)), SEGMENT))
    whole, open_ = cut.where("segment is null").select(*_RESULT.names), cut.where("segment is not null").select("conv_id", "segment", "rows", "digests")
    # digests that an earlier segment of the conversation holds
    one = open_.select("conv_id", "segment", F.explode("digests").alias("digest"))
    again = one.withColumn("first", F.min("segment").over(W.partitionBy("conv_id", "digest"))).where("first < segment")
    seen = again.groupBy(F.col("segment").alias("in")).agg(F.collect_list("digest").alias("seen"))
    met = open_.join(seen, F.col("segment") == F.col("in"), "left").select("conv_id", "segment", "rows", "seen")
    searched = met.mapInArrow(slimming(_search_segments), SEARCHED)
    dealt = searched.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "rows", "faults", "paths")
    return whole.unionByName(dealt.mapInArrow(slimming(_fold), RESULT))
