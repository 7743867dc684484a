"""State machines: streams equal stored recordings and plain loops, whatever the order of rows and over a restart."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from strayframe.operators import kinematics
from strayframe.plans import machines as plans
from strayframe.streaming import machines, online

RULE = {"trigger": 2, "give_up": 45, "cooldown": 2, "rest": 8}


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(machines.STORE)
    spark.conf.set(machines.STORE, machines.ROCKS)
    yield spark
    spark.conf.set(machines.STORE, before)


def candidates(rng, runs, ticks):
    out = []
    for run in range(runs):
        for tick in range(ticks):
            if rng.random() < 0.9:  # some ticks are missing
                agents = rng.sample(range(4), rng.randrange(0, 4))
                out.append((run, tick, agents, [rng.randrange(1, 6) for _ in agents], [rng.random() < 0.2 for _ in agents]))
    return out


def looped(rows, trigger, give_up, cooldown, rest):
    """One recording, tick by tick."""
    by, out, failed, now, after, n = {r[1]: r for r in rows}, [], {}, None, trigger, 0
    for tick in range(0, 200):
        if now and now[3] == tick:
            out.append(now)
            if now[4]:
                return out
            failed[now[1]], after, now = tick, tick + cooldown, None
        if now is None and after <= tick < give_up and tick in by:
            _, _, agents, lengths, wins = by[tick]
            fit = [k for k, a in enumerate(agents) if a not in failed or tick - failed[a] >= rest]
            if fit:
                n += 1
                now = (n, agents[fit[0]], tick, tick + lengths[fit[0]], wins[fit[0]])
    return out


SCHEMA = "run long, tick int, agents array<long>, lengths array<int>, wins array<boolean>"


def test_retries_stream_in_any_order_and_over_a_restart(rocks, tmp_path):
    rng = random.Random(2)
    rows = candidates(rng, 4, 50)
    want = sorted((run, *x) for run in range(4) for x in looped([r for r in rows if r[0] == run], **RULE))
    machine = machines.retries(**RULE)
    assert sorted(tuple(r) for r in machines.folded(rocks.createDataFrame(rows, SCHEMA), machine).collect()) == want
    assert len(want) > 15 and any(x[-1] for x in want) and len({(x[0], x[2]) for x in want}) < len(want)  # some agent is tried again
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 12))  # up to 11 ticks late
    parts = [order[:60], order[60:110], order[110:], [(-1, 10_000, [], [], [])]]
    for k, part in enumerate(parts):  # after each file the stream is stopped and started again
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k != 1:
            stream = online.stream_of(rocks, str(tmp_path / "in"), SCHEMA)
            got = online.drained(machines.streamed(stream, machine, late_ticks=12), str(tmp_path / "run")).collect()
    assert sorted(tuple(r) for r in got if r.run >= 0) == want


def test_crossing_over_two_joined_streams(rocks, tmp_path):
    rng = random.Random(5)
    ego = [(r, t, 0.5 * t, 0.0, 0.0) for r in range(3) for t in range(40)]
    walker = [(r, t, 12.0 + rng.uniform(-1, 1), max(-6.0, 6 - 0.3 * t + rng.uniform(-0.3, 0.3))) for r in range(3) for t in range(40) if rng.random() < 0.95]
    goals = {"ix": F.lit(12.0), "iy": F.lit(2.0), "cx": F.lit(12.0), "cy": F.col("run") * 1.0 - 4.0}
    machine = machines.crossing(near=9.0, view_deg=50.0, pause=4, most=9, reach=1.5)
    a = rocks.createDataFrame(ego, "run long, tick int, x double, y double, yaw double")
    b = rocks.createDataFrame(walker, "run long, tick int, wx double, wy double")
    want = sorted(tuple(r) for r in machines.folded(a.join(b, ["run", "tick"]).withColumns(goals), machine).collect())
    assert {p for *_, p in want} == {"wait", "in", "pause", "cross", "done"}
    stamped = lambda df: df.withColumn("ts", machines.tick_time("tick", 100))
    for name, df, end in (("a", a, (-1, 10_000, 0.0, 0.0, 0.0)), ("b", b, (-1, 10_000, 0.0, 0.0))):
        both = df.unionByName(rocks.createDataFrame([end], df.schema))
        stamped(both).coalesce(1).write.parquet(str(tmp_path / name))
    left, right = (online.stream_of(rocks, str(tmp_path / n), stamped(df).schema.simpleString()[7:-1].replace(":", " ")) for n, df in (("a", a), ("b", b)))
    got = online.drained(machines.streamed(online.matched(left, right).withColumns(goals), machine), str(tmp_path / "run"))
    assert sorted(tuple(r) for r in got.where("run >= 0").collect()) == want


def test_crossing_by_hand(spark):
    machine = machines.crossing(near=10.0, view_deg=30.0, pause=2, most=3, reach=0.5)
    ego = {"x": 0.0, "y": 0.0, "yaw": 0.0, "ix": 5.0, "iy": 0.0, "cx": 5.0, "cy": -4.0}
    steps = [((20, 0), "wait"), ((5, 4), "wait"), ((5, 1), "in"), ((5, 0.2), "pause"), ((5, 0), "pause"), ((5, 0), "cross"), ((5, -1), "cross"), ((5, -2), "done"), ((5, -2), "done")]
    rows = [(7, t, *(float(x) for x in ego.values()), float(x), float(y)) for t, ((x, y), _) in enumerate(steps)]
    df = spark.createDataFrame(rows, f"run long, tick int, {', '.join(f'{k} double' for k in ego)}, wx double, wy double")
    assert [r.phase for r in machines.folded(df, machine).orderBy("tick").collect()] == [p for _, p in steps]


def test_route_is_searched_forward_only(spark):
    line = [(x, 0.0) for x in range(30)] + [(30.0 - x, 0.1) for x in range(30)]  # out and back beside itself
    ticks = [(1, t, float(x), 0.04 if t < 15 else 0.06) for t, x in enumerate([*range(0, 30, 2), *range(29, 0, -2)])] + [(1, 99, 500.0, 500.0), (1, 100, 500.0, 500.0), (2, 0, 0.0, 0.0)]
    found = kinematics.route_cursor(spark.createDataFrame(ticks, "run long, tick int, x double, y double"), spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(line)], "run long, seq int, x double, y double"), off=2.0)
    rows = found.orderBy("tick").collect()
    k = [r.k for r in rows]
    assert k == sorted(k) and k[14] == 28 and k[29] > 50 and [r.off for r in rows[-2:]] == [1, 2] and {r.run for r in rows} == {1}
    assert all(math.isclose(r.off, 0) for r in rows[:-2])


class _Store:
    """A handle and its states, which counts the calls that would go to the state store."""

    def __init__(self):
        self.calls, self.rows, self.timers, self.value = 0, [], [], None

    def registerTimer(self, at):  # noqa: N802
        self.calls, self.timers = self.calls + 1, [*self.timers, at]

    def deleteTimer(self, at):  # noqa: N802
        self.calls, self.timers = self.calls + 1, [t for t in self.timers if t != at]

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return iter(self.timers)

    def __getattr__(self, name):  # whatever else a state is asked
        if name.startswith("get") and name.endswith("State"):
            return lambda *a, **b: self

        def call(*a):
            self.calls += 1
            return iter([x[:1] for x in self.rows]) if name == "keys" else self.rows.append(a[0])

        return call


def test_rows_of_a_run_are_held_by_one_call():
    calls = []
    for n in (1, 60):
        held = machines._Ordered(machines.retries(**RULE), 100)
        store = _Store()
        held.init(store)
        rows = pd.DataFrame({"run": [3] * n, "tick": range(5, 5 + n), "agents": [np.array([1, 2])] * n, "lengths": [np.array([2, 2])] * n, "wins": [np.array([True, False])] * n})
        assert not list(held.handleInputRows((3,), iter([rows]), None)) and store.timers == [600]
        calls.append(store.calls)
    assert calls[0] == calls[1]


def test_candidates_need_no_join(spark):
    plan = plans._candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
