"""Stored marks, appends keyed by their run, stages that notice a change, bounded stream state."""

import pytest
from pyspark.sql import functions as F

from pawgrid.session import run_path
from pawgrid.sources import marks as M
from pawgrid.sources import sinks as SK
from pawgrid.streaming import incremental as I


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, day int")


def test_rounds_read_tied_times_once(spark):
    out, log = run_path(spark, "t-out"), run_path(spark, "t-log")
    rows = [(i, i // 10) for i in range(50)]
    assert M.read_round(spark, frame(spark, rows[:25]), "day", "id", out, log) == M.Mark(2, 24, 0)
    assert M.read_round(spark, frame(spark, rows[:25]), "day", "id", out, log) == M.Mark(2, 24, 0)  # nothing new
    late_tie = [*rows, (1000, 2), (None, 3), (7, None)]
    assert M.read_round(spark, frame(spark, late_tie), "day", "id", out, log) == M.Mark(4, 49, 1)
    got = sorted((r["id"], r["run_id"]) for r in spark.read.parquet(out).collect())
    assert got == [*[(i, 0) for i in range(25)], *[(i, 1) for i in range(25, 50)], (1000, 1)]
    assert [r["n_rows"] for r in spark.read.parquet(log).orderBy("run_id").collect()] == [25, 26]


def test_a_run_that_died_before_its_mark_is_done_again(spark):
    out, log = run_path(spark, "t-out"), run_path(spark, "t-log")

    def dies(rows):
        SK.append_log(rows, out, run=0)  # the output is there, the mark is not
        raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        M.read_round(spark, frame(spark, [(1, 1), (2, 1)]), "day", "id", out, log, dies)
    assert M.current_mark(spark, log) is None
    M.read_round(spark, frame(spark, [(1, 1), (2, 1), (3, 2)]), "day", "id", out, log)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_an_empty_source_has_no_mark(spark):
    out, log = run_path(spark, "t-out"), run_path(spark, "t-log")
    assert M.read_round(spark, frame(spark, []), "day", "id", out, log) is None
    assert not SK.path_exists(spark, out)


def test_the_same_run_twice_holds_each_row_once(spark):
    for fmt in ("parquet", "csv"):
        path = run_path(spark, "log")
        for run in ("a", "b", "a"):
            SK.append_log(frame(spark, [(1, 1), (2, 2)]), path, fmt, run=run)
        assert spark.read.format(fmt).option("header", "true").load(path).count() == 4


def test_stage_is_rebuilt_when_its_input_or_parameters_change(spark):
    source, path, built = run_path(spark, "in"), run_path(spark, "stage"), []
    frame(spark, [(1, 1)]).write.parquet(source)

    def stage(**params):
        def build():
            built.append(1)
            return spark.read.parquet(source)
        return SK.materialise(spark, path, build, inputs=[spark.read.parquet(source)], params=params).count(), len(built)

    assert stage(k=1) == (1, 1)
    assert stage(k=1) == (1, 1)
    frame(spark, [(2, 2)]).write.mode("append").parquet(source)
    assert stage(k=1) == (2, 2)
    assert stage(k=1) == (2, 2)
    assert stage(k=2) == (2, 3)
    assert stage(k=1) == (2, 4)  # the stored digest is that of the last build


def test_stream_state_is_bounded_and_late_rows_are_accounted(spark):
    home, out, ck = (run_path(spark, n) for n in ("s-in", "s-out", "s-ck"))
    day = lambda d, n, hour=0: [(f"2024-03-{d:02d} {hour:02d}:00:00", "k", 1.0)] * n
    files = [day(1, 3) + day(2, 2), day(8, 4), day(9, 1), day(20, 2) + day(1, 5, 3)]
    schema = "ts timestamp, key string, value double"

    def add(rows):
        spark.createDataFrame(rows, "ts string, key string, value double").withColumn("ts", F.to_timestamp("ts")) \
            .coalesce(1).write.mode("append").parquet(home)

    def drain():
        return I.window_counts_upsert(I.stream_files(spark, home, schema, max_files_per_trigger=1), out, ck, "ts", "key", delay="2 days")

    for rows in files[:3]:
        add(rows)
    drain()
    add(files[3])
    left = drain()  # a later job goes on where the first ended
    table = {r["w"]["start"].day: r["n"] for r in I.latest_windows(spark, out, "key").collect()}
    assert table == {1: 3, 2: 2, 8: 4, 9: 1, 20: 2}
    report = I.late_rows(spark.read.parquet(home), I.latest_windows(spark, out, "key")).first()
    assert (report["rows_read"], report["rows_counted"], report["rows_late"]) == (17, 12, 5)
    assert left == 1  # only the window of the 20th is open, though five were counted
    # a batch done again replaces its folder
    assert drain() in (0, 1) and I.latest_windows(spark, out, "key").count() == 5
