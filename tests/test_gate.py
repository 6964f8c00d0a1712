"""The bounded line: a stream in pieces, with a restart in between, against a plain list."""

import collections
import random

import pytest

from tabulon.plans import stream_queries
from tabulon.streaming import gate


@pytest.mark.parametrize("room", [1, 3])
def test_stream_with_restarts_equals_a_list(spark, tmp_path, room):
    rng = random.Random(room)
    events = [(rng.choice("abc"), at, rng.randrange(9), rng.choice(["arrive", "arrive", "arrive", "done", "read", "forget"])) for at in range(300)]
    stream = lambda: spark.readStream.schema(gate.EVENTS).parquet(str(tmp_path / "in"))
    for k in range(0, 300, 100):  # three starts, each of one micro-batch
        spark.createDataFrame([*events[k:k + 100], (None, 1, 1, "arrive"), ("a", None, 1, "done")], gate.EVENTS).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        gate.run_stream(stream(), str(tmp_path / "out"), str(tmp_path / "state"), room)
    got = [tuple(r) for r in spark.read.schema(gate.ACTIONS).parquet(str(tmp_path / "out")).collect()]
    want = gate.plain(events, room)
    assert sorted(got) == sorted(want)
    # the line never grows beyond its room but by urgent reads
    assert all(line <= room for _, _, _, action, line, _ in want if action == "released") and {a[3] for a in want} == {"entered", "parked", "released", "left", "forgotten"}
    parked = collections.Counter(a[3] for a in want)
    assert parked["parked"] >= parked["released"] > 2


def test_registered_line(spark):
    sf = "/root/testdata/sf0.001"
    rows = stream_queries.gate_events(spark, sf).collect()
    from tabulon import registry

    got = registry.queries()["t05_bounded_line"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(gate.plain([tuple(r) for r in rows]))
