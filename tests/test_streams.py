"""Streams of events: any arrival order within the watermark gives the same result, late rows have no effect."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from corpuscope.plans import event_streams
from corpuscope.streaming import machine, telemetry
from corpuscope.streaming.runs import in_goes

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def test_moves():
    assert machine.applied("REGISTERED", ["start", "done", "done", "fail", "start"]) == ("INDEXED", 2, 3)
    assert machine.applied("FAILED", []) == ("FAILED", 0, 0)
    assert machine.applied("INGESTING", ["fail", "start", "start"]) == ("INGESTING", 2, 1)


@pytest.mark.parametrize("seed", [0, 1])
def test_machine_in_any_order(spark, seed):
    """Commands arrive shuffled, in three goes that overlap by less than the watermark's delay; one is far too late."""
    rng = random.Random(seed)
    commands = [(n % 4, T0 + dt.timedelta(minutes=n), n, rng.choice(["start", "done", "fail", "none"])) for n in range(180)]
    goes = [commands[:60], commands[60:120], commands[120:]]
    goes[1].append(goes[0].pop())  # within the delay of 30 minutes
    goes[2].append((1, T0 + dt.timedelta(minutes=1), 999, "start"))  # behind the watermark
    goes[2].append((-1, T0 + dt.timedelta(days=9), -1, "none"))
    for g in goes:
        rng.shuffle(g)
    schema = "run long, ts timestamp, number long, command string"
    frames = [spark.createDataFrame(g, schema).repartition(3) for g in goes]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = in_goes(spark, frames, frames[0].schema, lambda s: machine.followed(s, "30 minutes"), "machine")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.run: tuple(r)[1:] for r in machine.latest(out.where("run >= 0")).collect()}
    for run in range(4):
        mine = [c for r, _, _, c in sorted(commands, key=lambda x: x[1]) if r == run]
        assert got[run] == (*machine.applied("REGISTERED", mine), len(mine))


def test_a_stream_goes_on_where_it_stopped(spark):
    rows = [spark.createDataFrame([(k, T0 + dt.timedelta(hours=k), 1, "view", 1.0)], "event_id long, ts timestamp, user_id long, event_type string, value double") for k in range(4)]
    out = in_goes(spark, [*rows, rows[3]], rows[0].schema, telemetry.unique, "again")
    assert sorted(r.event_id for r in out.collect()) == [0, 1, 2, 3]


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for f in (event_streams.tumbling_windows, event_streams.session_windows, event_streams.run_states, event_streams.stream_lines):
        assert f(spark, str(tmp_path)).count() == 0
