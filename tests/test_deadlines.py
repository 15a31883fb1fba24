"""Deadlines that cancel jobs, runs that stay marked where they were cut, progress of streams, and epochs with gaps."""

import time

import pytest
from pyspark.sql import functions as F

from loomgraph.sources.publish import Publisher, PublicationError
from loomgraph.streaming.deadlines import DeadlineExceeded, Progress, Stage, run_stages, within
from loomgraph.streaming.epochs import seal_batches, sealed, worklist


def slow(spark, rows=8, seconds=30):
    @F.udf("long")
    def wait(x):
        time.sleep(seconds)
        return x

    return spark.range(rows, numPartitions=4).select(wait("id").alias("key"), F.lit(1.0).alias("score"))


def test_a_late_action_is_cancelled_and_others_go_on(spark):
    began = time.monotonic()
    with pytest.raises(DeadlineExceeded):
        within(spark, 1.5, lambda: slow(spark).collect())
    assert time.monotonic() - began < 20
    assert within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 / 0)


def test_stages_are_cut_and_stop_when_they_add_little(spark):
    rows = lambda *r: lambda known: spark.createDataFrame(list(r), "key long, score double")
    out = run_stages(spark, [Stage("first", rows((1, 1.0), (2, 1.0)), 60, 10), Stage("slow", lambda known: slow(spark), 1.5, 10), Stage("after", rows((1, 3.0), (3, 1.0)), 60, 10)], 120)
    assert out.candidates == {1: 3.0, 2: 1.0, 3: 1.0} and out.reason == "deadline"
    assert [(t.name, t.status, t.added) for t in out.traces] == [("first", "completed", 2), ("slow", "pending_after_deadline", 0), ("after", "completed", 1)]
    assert out.traces[2].gain == pytest.approx(1.5)
    out = run_stages(spark, [Stage(str(i), rows((1, 1.0)), 60, 10) for i in range(5)], 120, 0.1, 2)
    assert [t.status for t in out.traces] == ["completed"] * 3 + ["skipped"] * 2 and out.reason == "marginal_gain"
    out = run_stages(spark, [Stage("slow", lambda known: slow(spark), 60, 10), Stage("never", rows((1, 1.0)), 60, 10)], 1.5)
    assert [t.status for t in out.traces] == ["pending_after_deadline", "cancelled_before_start"] and out.candidates == {}


def test_a_run_that_is_cut_stays_incomplete(spark, tmp_path):
    p = Publisher(spark, f"file://{tmp_path}/g")
    p.promote(p.stage({"file": spark.range(2)}))
    p.begin_run("one")
    with pytest.raises(DeadlineExceeded):
        within(spark, 1.5, lambda: p.promote(p.stage({"file": slow(spark)})))
    again = Publisher(spark, p.root)
    assert again.incomplete_run() == "one" and again.table("file").count() == 2
    with pytest.raises(PublicationError):
        again.begin_run("two")
    again.finish_run("one")
    again.begin_run("two")
    again.promote(again.stage({"file": spark.range(3)}))
    again.finish_run("two")
    assert again.incomplete_run() is None and again.table("file").count() == 3


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "epoch long, seq long, path string, kind string")


def test_epochs(spark):
    c = changes(
        spark, (0, 5, "src/a", "mutated"), (0, 6, "src/b", "membership"), (0, 6, "src/b", "membership"), (1, 7, "target/x", "mutated"), (2, 9, "c", "mutated"), (3, 10, "d", "mutated"), (3, 12, "d", "mutated"), (4, 13, None, "lost"), (5, 14, "e", "membership"), (6, None, "e", "mutated"),
    )
    found = [(r.epoch, r.armed, r.sealed, r.gap, r.dirty, r.rescan) for r in sealed(c, None).orderBy("epoch").collect()]
    assert found == [(0, 4, 6, None, 1, 1), (1, 6, 7, None, 0, 0), (2, 7, 9, "missing_before", 1, 0), (3, 9, 12, "missing_within", 1, 0), (4, 12, 13, "coverage_lost", 0, 0), (5, 13, 14, None, 0, 1), (6, 14, 14, "coverage_lost", 1, 0)]
    assert [r.gap for r in sealed(c.where("epoch = 0"), 4).collect()] == [None] and [r.gap for r in sealed(c.where("epoch = 0"), 3).collect()] == ["missing_before"]
    work = worklist(c, sealed(c, None), spark.createDataFrame([("p",), ("q",)], "path string"))
    assert sorted(map(tuple, work.where("action <> 'full'").collect())) == [(0, "src", "rescan"), (0, "src/a", "rehash"), (5, "", "rescan")]
    assert sorted((r.epoch, r.path) for r in work.where("action = 'full'").collect()) == [(e, p) for e in (2, 3, 4, 6) for p in ("p", "q")]


def test_a_stream_with_a_gap_turns_into_a_full_scan(spark, tmp_path):
    p = Publisher(spark, f"file://{tmp_path}/g")
    inventory = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        for rows in ([(1, "a", "mutated"), (2, "b", "mutated")], [(3, "a", "mutated")], [(5, "c", "mutated")], [(6, "b", "mutated")]):
            spark.createDataFrame(rows, "seq long, path string, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("seq long, path string, kind string").parquet(f"{tmp_path}/in")
            seal_batches(stream, p, inventory, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        time.sleep(1)
    finally:
        spark.streams.removeListener(progress)
    epochs = [(r.epoch, r.armed, r.sealed, r.proven) for r in p.table("epoch").orderBy("epoch").collect()]
    assert epochs == [(0, 0, 2, True), (1, 2, 3, True), (2, 3, 5, False), (3, 5, 6, True)]
    work = sorted((r.epoch, r.action, r.path) for r in p.table("work").collect())
    assert work == [(0, "rehash", "a"), (0, "rehash", "b"), (1, "rehash", "a"), (2, "full", "a"), (2, "full", "b"), (2, "full", "c"), (3, "rehash", "b")]
    batches = [t for t in progress.told if t["event"] == "progress" and t["rows"]]
    assert [t["batch"] for t in batches] == [0, 1, 2, 3] and [t["rows"] for t in batches] == [2, 1, 1, 1]
    assert [t["event"] for t in progress.told].count("ended") == 4
