"""Batches that fail, die and are taken up again; each is committed once."""

import pytest
from pyspark.sql import functions as F

from colloquy.sources import runs, store


@pytest.fixture
def rows(spark):
    rows = spark.createDataFrame([(i, f"t{i}", None if i == 7 else 1.5) for i in range(40)], "id long, text string, x double").repartition(3)
    return rows.withColumn("batch", runs.stable_batches(F.col("id"), 4))


@pytest.fixture
def path(spark):
    return store.scratch(spark)


def upper(own):
    return own.select("id", F.upper("text").alias("text"))


def told(run, rows):
    return sorted((r.id, r.text) for r in run.results(rows, "id long, text string").collect())


WHOLE = sorted((i, f"T{i}") for i in range(40))


def test_each_batch_is_done_once(spark, rows, path):
    run = runs.BatchRun(spark, path, "v1")
    assert run.run(rows, upper) == runs.Outcome([], [0, 1, 2, 3], [])
    assert run.run(rows.repartition(5), lambda own: 1 / 0) == runs.Outcome([0, 1, 2, 3], [], [])
    assert told(run, rows) == WHOLE
    assert runs.BatchRun(spark, path, "v2").run(rows, upper).done == [0, 1, 2, 3]  # another contract


def test_changed_rows_are_new_work_for_their_batch_alone(spark, rows, path):
    run = runs.BatchRun(spark, path, "v1")
    run.run(rows, upper)
    other = rows.where("id <> 3").withColumn("x", F.when(F.col("id") == 7, 0.0).otherwise(F.col("x")))
    touched = sorted({r.batch for r in rows.where("id in (3, 7)").collect()})
    assert run.run(other, upper).done == touched
    assert told(run, other) == [r for r in WHOLE if r[0] != 3] and told(run, rows) == WHOLE


def test_failures_are_recorded_and_left_alone_in_the_end(spark, rows, path):
    run = runs.BatchRun(spark, path, "v1")

    def work(own):
        if own.where("id = 5").limit(1).count():
            raise OSError("no such\nthing")
        return upper(own)

    bad = [r.batch for r in rows.where("id = 5").collect()]
    for attempt in (1, 2):
        assert run.run(rows, work, attempts=2).failed == bad
        assert {(r.attempt, r.reason) for r in run.log().where("status = 'FAILED'").collect()} == {(i, "no such") for i in range(1, attempt + 1)}
    assert run.run(rows, upper, attempts=2).failed == bad  # not tried a third time
    with pytest.raises(ValueError, match=f"batch {bad[0]}"):
        told(run, rows)
    assert run.run(rows, upper, attempts=3).done == bad and told(run, rows) == WHOLE


def test_a_writer_that_dies_before_it_commits(spark, rows, path, monkeypatch):
    run = runs.BatchRun(spark, path, "v1")
    enter = runs.BatchRun._enter

    def dies(self, **entry):
        if entry["status"] == "SUCCESS" and entry["batch"] == 2:
            raise KeyboardInterrupt
        enter(self, **entry)

    monkeypatch.setattr(runs.BatchRun, "_enter", dies)
    with pytest.raises(KeyboardInterrupt):
        run.run(rows, upper)
    monkeypatch.undo()
    assert {r.batch: (r.status, r.attempts) for r in run.states(rows).collect()} == {0: ("SUCCESS", 1), 1: ("SUCCESS", 1), 2: ("CRASHED", 1), 3: ("NEW", 0)}
    left = run.log().where("batch = 2 and status = 'STARTED'").first().folder
    assert store._fs(spark, left)[0].exists(store._fs(spark, left)[1])
    assert run.run(rows, upper) == runs.Outcome([0, 1], [2, 3], [])
    assert not store._fs(spark, left)[0].exists(store._fs(spark, left)[1])
    assert told(run, rows) == WHOLE
    assert run.log().where("status = 'SUCCESS'").groupBy("batch").count().where("count > 1").count() == 0


def test_empty_and_null_batches(spark, path):
    run = runs.BatchRun(spark, path, "v1")
    none = spark.createDataFrame([], "id long, text string, batch long")
    assert run.run(none, upper) == runs.Outcome([], [], []) and told(run, none) == []
    some = spark.createDataFrame([(1, None, None), (1, None, None), (2, "b", 0)], "id long, text string, batch long")
    assert run.run(some, upper).done == [None, 0]
    assert run.results(some, "id long, text string").count() == 3
