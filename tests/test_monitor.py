"""The stream gives what the batch gives on the same files."""

import os
import time

import pytest

from tidewater.schema import SERIES
from tidewater.sources import files
from tidewater.streaming import monitor


def test_stream_equals_batch(spark, tmp_path):
    top = tmp_path / "calc" / "bound" / "restrain" / "output" / "lambda_0.500"
    for run in (1, 2):
        (top / f"run_0{run}").mkdir(parents=True)
        (top / f"run_0{run}" / "simfile.dat").write_text("#head\n" + "".join(f"{100 * i} 0 {run * i}.5 0 0 1 2\n" for i in range(1, 6)))
    lines = monitor.file_stream(spark, str(tmp_path / "calc"))
    state = str(tmp_path / "state")
    monitor.start_monitor(monitor.progress(monitor.sample_lines(lines), 0.01), monitor.merge_state(state), str(tmp_path / "ck")).awaitTermination()
    got = {r.run: tuple(r) for r in monitor.current_state(spark, state).collect()}
    batch = monitor.progress(files.read_samples(spark, f"{top}/*/simfile.dat"), 0.01).collect()
    assert got == {r.run: tuple(r) for r in batch} and len(got) == 2
    # a restarted file repeats a step
    (top / "run_01" / "again.dat").write_text("500 0 1.0 0 0 1 2\n600 0 1.0 0 0 1 2\n")
    plan = monitor.streaming_allocation(monitor.sample_lines(monitor.file_stream(spark, str(tmp_path / "calc"))), lambda s: s.selectExpr(*SERIES, "10 - simtime_ns as extra_ns"), str(tmp_path / "s2"), str(tmp_path / "out"), str(tmp_path / "ck2"), 0.01)
    plan.awaitTermination()
    left = {r.run: r.extra_ns for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert left == {1: 4.0, 2: 5.0}
    rows = files.read_samples(spark, f"{top}/*/*.dat")
    assert monitor.progress(rows, 0.01, distinct_steps=True).where("run = 1").first().rows == 6
    logs = spark.createDataFrame([("c", "l", "s", 0.0, 1, "Simulation took 36 s"), ("c", "l", "s", 0.0, 1, "x")], "calc string, leg string, stage string, lam double, run int, value string")
    row = monitor.job_state(logs).first()
    assert (row.gpu_hours, row.finished, row.nan_failure) == (0.01, True, False)


LIVE = ["simtime_ns", "rows", "gaps", "mean", "variance", "gpu_hours", "open_logs", "nan_failure", "finished"]


def test_one_live_state_of_runs(spark, tmp_path):
    """Restarted files, gaps, late and failing logs, a stall: after each poll the state is that of the batch."""
    top, state, ck = tmp_path / "calc" / "bound" / "restrain" / "output" / "lambda_0.500", str(tmp_path / "state"), str(tmp_path / "ck")
    clock = [1_700_000_000]

    def put(run, name, text):
        (top / f"run_0{run}").mkdir(parents=True, exist_ok=True)
        (top / f"run_0{run}" / name).write_text(text)
        clock[0] += 100
        os.utime(top / f"run_0{run}" / name, (clock[0], clock[0]))

    samples = lambda steps: "#head\n" + "".join(f"{100 * i} 0 {(i * 7) % 5}.5 0 0 1 2\n" for i in steps)

    def poll(silent=3600):
        lines = monitor.run_lines(*(monitor.file_stream(spark, str(tmp_path / "calc"), p) for p in ("*.dat", "*.out")))
        monitor.start_monitor(monitor.live_runs(lines, 0.01, 100, silent), monitor.merge_state(state), ck).awaitTermination()
        return {r.run: r for r in monitor.current_state(spark, state).collect()}

    def whole():
        dat, out = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", p).text(str(tmp_path / "calc")).select("value", "_metadata.file_path", "_metadata.file_modification_time") for p in ("*.dat", "*.out"))
        tables = [x.select(*files.path_keys(x.file_path), x.file_path.alias("file"), x.file_modification_time.alias("modified"), "value") for x in (dat, out)]
        return {r.run: r for r in monitor.runs_now(monitor.run_lines(*tables), 0.01, 100).collect()}

    def same(got):
        want = whole()
        assert got.keys() == want.keys()
        for run, r in got.items():
            for c in LIVE:
                assert getattr(r, c) == pytest.approx(getattr(want[run], c)) or (getattr(want[run], c) is None and getattr(r, c) != getattr(r, c)), (run, c)

    put(1, "a.dat", samples(range(1, 6)))
    put(1, "a.out", "started\n")
    put(2, "a.dat", samples([1, 2, 7, 8]))
    put(3, "only.out", "nan\n")
    first = poll(silent=1)
    same(first)
    assert (first[1].rows, first[1].gaps, first[2].gaps, first[1].open_logs, first[1].finished) == (5, 0, 1, 1, False)
    # the restarted run repeats two steps, the hole is filled, a second log says that the first run is done
    time.sleep(1.5)
    put(1, "b.dat", samples(range(4, 9)))
    put(2, "b.dat", samples([3, 4, 5, 6]))
    put(2, "late.out", "x\nSimulation took 72 s\n")
    second = poll(silent=1)
    same(second)
    assert (second[1].rows, second[2].rows, second[2].gaps, second[2].gpu_hours, second[2].finished) == (8, 8, 0, 0.02, True)
    assert second[3].stalled and not second[1].stalled and not second[2].stalled
    put(1, "c.out", "Simulation took 36 s\n")
    third = poll()
    same(third)
    assert third[1].open_logs == 1 and third[1].gpu_hours == 0.01


def test_intervals():
    new, first, last = monitor._between([2, 8], [4, 9], monitor.np.array([1, 3, 5, 7, 9, 12]))
    assert new.tolist() == [True, False, True, True, False, True] and (first, last) == ([1, 7, 12], [5, 9, 12])
    assert monitor._between([], [], monitor.np.array([], int))[1:] == ([], [])


def test_state_of_many_batches(spark, tmp_path):
    """A poll reads a snapshot and the batches since; a replayed batch changes nothing."""
    folder = str(tmp_path / "s")
    write, want = monitor.merge_state(folder, ["k"]), {}
    frame = lambda rows: spark.createDataFrame(rows, "k int, v long")
    for n in range(24):
        rows = [(n % 7, n), (7 + n % 3, 10 * n)]
        write(frame(rows), n)
        want |= dict(rows)
        if n in (0, 9, 10, 20, 23):
            write(frame(rows), n)
            state = monitor.current_state(spark, folder, ["k"])
            assert {r.k: r.v for r in state.collect()} == want and len(monitor._parts(folder, n)) <= monitor.SNAPSHOT
    assert len(monitor._parts("", 99)) == 10 and monitor._parts("f", 20) == ["f/snapshot=20"]
