"""Bucketed tables, the outbox and keyed state: commits, crashes, restarts."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from lakegraph import analytics_catalog
from lakegraph.operators import lifecycle
from lakegraph.sources import buckets
from lakegraph.streaming import outbox, states


def rows_of(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def files_of(table):
    return {b: sorted(glob.glob(f"{table.path}/data/{f}/_bucket={b}/*.parquet")) for b, f in table.manifest()["folders"].items()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = buckets.BucketTable.create(spark, str(tmp_path / "t"), "key string, n long, v string", "key", 8)
    assert rows_of(table) == []
    first = [(f"k{i}", 1, "old") for i in range(100)] + [(None, 1, "null key"), ("k1", 3, "newest"), ("k1", 2, "older")]
    table.upsert(spark.createDataFrame(first, "key string, n long, v string"), ["n"])
    want = {k: (k, n, v) for k, n, v in sorted(first, key=lambda r: r[1])}
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(want.values(), key=repr)
    before = files_of(table)
    table.upsert(spark.createDataFrame([("k5", 0, "new side wins"), ("fresh", 0, "x")], "key string, n long, v string"), ["n"])
    after = files_of(table)
    touched = {b for b in after if before.get(b) != after[b]}
    assert 1 <= len(touched) <= 2 and len(before) == 8 and all(before[b] == after[b] for b in before if b not in touched)
    want |= {"k5": ("k5", 0, "new side wins"), "fresh": ("fresh", 0, "x")}
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(want.values(), key=repr)
    assert table.read(1).where("key = 'k5'").head().v == "old"  # the version before is still there
    table.insert_ignore(spark.createDataFrame([("k5", 9, "ignored"), ("more", 2, "b"), ("more", 1, "a")], "key string, n long, v string"), "n")
    assert {r.key: r.v for r in table.read().where("key in ('k5', 'more')").collect()} == {"k5": "new side wins", "more": "a"}
    unchanged = files_of(table)
    table.delete(F.col("key") == "more")
    assert table.read().where("key = 'more'").isEmpty() and sum(unchanged[b] != files_of(table).get(b) for b in unchanged) == 1
    table.change(spark.createDataFrame([], "key string, n long, v string"), lambda old, new: new)
    kept = sorted(map(tuple, table.read().collect()), key=repr)
    assert table.vacuum(1) >= 1 and table.vacuum(1) == 0
    assert sorted(map(tuple, table.read().collect()), key=repr) == kept and len(table.versions()) == 1


def test_a_failed_writer_leaves_the_last_version(spark, tmp_path, monkeypatch):
    table = buckets.BucketTable.create(spark, str(tmp_path / "t"), "key long, v long", "key", 4)
    table.upsert(spark.range(50).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("v")), ["v"])
    before, version = rows_of(table), table.versions()[-1]
    broken = spark.range(50).select(F.col("id").alias("key"), F.expr("if(id = 49, raise_error('lost'), 2L)").cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken, ["v"])
    with monkeypatch.context() as m:  # after the files and before the manifest
        m.setattr(buckets.BucketTable, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            table.upsert(spark.createDataFrame([(1, 5)], "key long, v long"), ["v"])
    assert rows_of(table) == before and table.versions()[-1] == version
    stale = table.manifest()
    table.upsert(spark.createDataFrame([(2, 7)], "key long, v long"), ["v"])
    with pytest.raises(buckets.Conflict):
        table._rewrite(stale, [0], lambda old: old, None)
    assert table.read().where("key = 2").head().v == 7


EVENTS = "id long, kind string, value double"


@pytest.fixture
def stateful(spark):
    with states.settings(spark):
        yield


def feed(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_outbox_counts_one_attempt_a_batch(spark, tmp_path, monkeypatch):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "table")
    feed(spark, inbox, [(1, "a", 5.0), (2, "a", None), (3, "b", 0.0)])
    stream = spark.readStream.schema(EVENTS).parquet(inbox)
    table = outbox.outbox_table(stream, path, buckets=4)
    error, handled = F.when(F.col("value").isNull() | (F.col("value") < 1), F.lit("no value")), []
    handle = lambda df: handled.extend(r.id for r in df.collect())
    run = lambda: outbox.consume_outbox(stream, table, error, "s", str(tmp_path / "state"), handle=handle)
    state = lambda: {r.id: (r.status, r.error_count) for r in table.read().collect()}
    run()
    assert state() == {1: ("processed", 0), 2: ("pending", 1), 3: ("pending", 1)}
    feed(spark, inbox, [(4, "a", 2.0), (1, "a", 5.0)])  # an event that comes again is known

    real, calls = outbox.attempt, []

    def crash_after_commit(*args, **kwargs):
        real(*args, **kwargs)
        calls.append(1)
        raise RuntimeError("crash between the table's commit and the stream's")

    with monkeypatch.context() as m:
        m.setattr(outbox, "attempt", crash_after_commit)
        with pytest.raises(Exception, match="crash"):
            run()
    after = {1: ("processed", 0), 2: ("pending", 2), 3: ("pending", 2), 4: ("processed", 0)}
    assert calls and state() == after
    run()  # the batch is handed on again and skipped
    assert state() == after and sorted(handled) == [1, 4]
    feed(spark, inbox, [(5, "c", 9.0)])
    run()
    assert state() == {1: ("processed", 0), 2: ("failed", 3), 3: ("failed", 3), 4: ("processed", 0), 5: ("processed", 0)}
    assert outbox.drain(table, error) == 0


def batches(spark, tmp_path, rows, schema, cuts):
    """Writes the parts one after the other and yields after each."""
    folder = str(tmp_path / "source")
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        yield folder


def test_results_never_shrink(spark, tmp_path, stateful):
    rng = random.Random(2)
    rows = [(f"k{rng.randint(0, 30)}", n) for n in range(120)]
    table = buckets.BucketTable.create(spark, str(tmp_path / "t"), "key string, first long, newest long, seen long", "key", 4)
    shown = []
    for folder in batches(spark, tmp_path, rows, "key string, n long", [40, 80]):  # each round is a restart
        stream = states.monotone_results(spark.readStream.schema("key string, n long").parquet(folder))
        now = outbox.into_table(stream, table, ["seen"], "s", str(tmp_path / "state"))
        shown.append([r.key for r in now.orderBy("first").limit(20).collect()])
    assert all(b[: len(a)] == a for a, b in zip(shown, shown[1:]))
    want = {k: (min(n for x, n in rows if x == k), max(n for x, n in rows if x == k), sum(x == k for x, _ in rows)) for k, _ in rows}
    assert {r.key: (r.first, r.newest, r.seen) for r in table.read().collect()} == want


def test_patches_that_come_late_or_early(spark, tmp_path, stateful):
    schema = "id string, is_lead boolean, at long, name string, kind string, title string, confidence long"
    rows = [("a", False, 1, None, "news", "x", 5), ("b", True, 1, "B", None, None, 0)]  # a signal before its lead
    rows += [("a", True, 2, "A", None, None, 0), ("b", False, 2, None, "news", "y", 7), ("b", False, 3, None, "news", "y", 9)]
    rows += [("b", False, 4, None, "news", "y", 1), ("a", False, 5, None, None, "z", 6), ("c", False, 5, None, "k", "no lead", 1)]
    table = buckets.BucketTable.create(spark, str(tmp_path / "t"), "id string, name string, n_signals long, confidence long", "id", 4)
    seen = []
    for folder in batches(spark, tmp_path, rows, schema, [2, 5]):
        stream = states.late_patches(spark.readStream.schema(schema).parquet(folder))
        seen.append({r.id: (r.name, r.n_signals, r.confidence) for r in outbox.into_table(stream, table, ["n_signals"], "s", str(tmp_path / "state")).collect()})
    assert seen[0] == {"b": ("B", 0, 0)}
    assert seen[1] == {"a": ("A", 1, 5), "b": ("B", 1, 7)}
    assert seen[2] == {"a": ("A", 2, 6), "b": ("B", 1, 7)}


def test_changes_across_a_restart_equal_the_batch(spark, tmp_path, stateful):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id")
    rows, schema = events.collect(), events.schema
    cut = len(rows) // 3
    out = str(tmp_path / "out")
    for folder in batches(spark, tmp_path, rows, schema, [cut, 2 * cut]):
        snaps, flags = analytics_catalog.snapshots(spark.readStream.schema(schema).parquet(folder))
        run = states.snapshot_changes(snaps, flags).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    snaps, flags = analytics_catalog.snapshots(events)
    want = sorted(tuple(r) for r in lifecycle.changes(snaps, flags, "rating").select("id", "change").collect())
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("id", "change").collect()) == want and len(want) > 500
