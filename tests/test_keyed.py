import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.streaming import keyed

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("v", T.StringType()), T.StructField("n", T.LongType())])
DAY = dt.datetime(2024, 1, 1)


def table(spark, changes):
    return sorted(tuple(r) for r in keyed.newest(spark, SCHEMA, changes, ["k"]).collect())


def folded(rows):
    best = {}
    order = lambda r: (r[1], r[2] is not None, str(r[2]), r[3] is not None, str(r[3]))
    for r in rows:
        if r[0] not in best or order(r) > order(best[r[0]]):
            best[r[0]] = r
    return sorted(best.values())


def test_late_and_repeated_files_fold_alike(spark, tmp_path):
    """Files in any order, one of them twice, rows of equal time, and a restart between them: the table is that of one fold over all rows."""
    rnd = random.Random(12)
    rows = [(rnd.randrange(12), DAY + dt.timedelta(hours=rnd.randrange(30)), rnd.choice(["a", "b", None]), rnd.choice([1, 2, None])) for _ in range(60)]
    source, changes, log = str(tmp_path / "in"), str(tmp_path / "changes"), str(tmp_path / "log")
    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: keyed.fold_newest(spark, source, SCHEMA, changes, log, ["k"], "at", files_per_batch=1).awaitTermination()
    put(rows[40:])
    put(rows[:20])
    run()
    assert table(spark, changes) == folded(rows[40:] + rows[:20])
    # another run starts from the checkpoint: old files are not read again
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "changes").glob("batch=*")}
    put(rows[20:40])
    put(rows[:20])
    run()
    assert table(spark, changes) == folded(rows)
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "changes").glob("batch=*")}
    assert before.items() <= after.items()
    # a batch writes what it changed, and a repeated file changes nothing
    sizes = [spark.read.schema(SCHEMA).parquet(f"{changes}/batch={n}").count() for n in range(len(after))]
    assert sizes[3] == 0 or sizes[2] == 0
    keyed.compact(spark, SCHEMA, changes, ["k"])
    assert table(spark, changes) == folded(rows) and len(list((tmp_path / "changes").glob("batch=*"))) == 2


def test_settled_state_is_dropped(spark, tmp_path):
    """With a lateness bound, newer rows of a key still win after its state has gone, and rows further behind are left out."""
    source, changes, log = str(tmp_path / "in"), str(tmp_path / "changes"), str(tmp_path / "log")
    steps = [[(1, DAY, "a", 1)], [(2, DAY + dt.timedelta(days=9), "b", 1)], [(3, DAY + dt.timedelta(days=9), "c", 1)], [(1, DAY + dt.timedelta(days=9), "d", 2), (1, DAY + dt.timedelta(hours=1), "late", 3)]]
    for step in steps:
        spark.createDataFrame(step, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        keyed.fold_newest(spark, source, SCHEMA, changes, log, ["k"], "at", lateness="1 day").awaitTermination()
    assert [(r[0], r[2]) for r in table(spark, changes)] == [(1, "d"), (2, "b"), (3, "c")]


def test_empty_source(spark, tmp_path):
    source, changes, log = str(tmp_path / "in"), str(tmp_path / "changes"), str(tmp_path / "log")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(source)
    keyed.fold_newest(spark, source, SCHEMA, changes, log, ["k"], "at").awaitTermination()
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_many_keys_without_calls_for_each(spark, tmp_path):
    """The state store's own aggregate folds the rows; a batch writes the keys whose row it changed, and nulls, NaN, nested values and times without a zone come back as they went."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("at", T.TimestampNTZType()), T.StructField("x", T.DoubleType()), T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    source, changes, log = str(tmp_path / "in"), str(tmp_path / "changes"), str(tmp_path / "log")
    gap, zone = dt.datetime(2024, 3, 10, 2, 30), spark.conf.get("spark.sql.session.timeZone")
    steps = [
        [(n, gap, float(n), {"a": n}) for n in range(500)] + [(None, None, None, None), (1000, None, float("nan"), None)],
        [(n, gap if n % 2 else gap + dt.timedelta(minutes=n % 5), float(n), {"a": n}) for n in range(500)] + [(None, gap, 1.0, {}), (1000, None, None, {"b": 1})],
    ]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for step in steps:
            spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(source)
            query = keyed.fold_newest(spark, source, schema, changes, log, ["k"], "at", files_per_batch=1)
            query.awaitTermination()
        assert [o.operatorName for o in query.lastProgress.stateOperators] == ["stateStoreSave"]
        got = {r["k"]: r for r in keyed.newest(spark, schema, changes, ["k"]).collect()}
        changed = {r["k"] for r in spark.read.parquet(f"{changes}/batch=1").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(got) == 502 and changed == {None, *[n for n in range(0, 500, 2) if n % 5]}
    assert all((got[n]["at"], got[n]["x"], got[n]["m"]) == (gap if n % 2 else gap + dt.timedelta(minutes=n % 5), n, {"a": n}) for n in range(500))
    assert (got[None]["at"], got[None]["x"], got[None]["m"]) == (gap, 1, {}) and got[1000]["at"] is None and got[1000]["x"] != got[1000]["x"]


def test_newest_events_in_few_batches_of_many_files(spark, tmp_path, monkeypatch):
    """Files follow the partitions, so that no task writes a large part of the table, and batches do not."""
    from factloom.plans import texts

    monkeypatch.setattr(texts, "new_folder", lambda session, label: str(tmp_path / label))
    assert texts.newest_events(spark, "/root/testdata/sf0.001").count() > 0
    assert len(list((tmp_path / "newest" / "in").glob("*.parquet"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(list((tmp_path / "newest" / "changes").glob("batch=*"))) <= 3


def test_repeated_batch_writes_the_same(spark, tmp_path):
    """A batch whose end was not logged runs again with the time it had, and writes the same changes."""
    source, changes, log = str(tmp_path / "in"), str(tmp_path / "changes"), tmp_path / "log"
    batch = lambda: sorted(tuple(r) for r in spark.read.schema(SCHEMA).parquet(f"{changes}/batch=1").collect())
    for step in ([(1, DAY, "a", 1), (2, DAY, "a", 1)], [(1, DAY + dt.timedelta(days=1), "b", 1), (2, DAY, "a", 1), (3, DAY, "c", 1)]):
        spark.createDataFrame(step, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        keyed.fold_newest(spark, source, SCHEMA, changes, str(log), ["k"], "at", files_per_batch=1).awaitTermination()
    first = batch()
    assert [r[0] for r in first] == [1, 3]
    for name in ("1", ".1.crc"):
        (log / "commits" / name).unlink(missing_ok=True)
    keyed.fold_newest(spark, source, SCHEMA, changes, str(log), ["k"], "at", files_per_batch=1).awaitTermination()
    assert batch() == first and (log / "commits" / "1").exists()
