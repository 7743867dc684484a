"""State machines over ticks: retries with a cooldown and a rest for each agent, a walker's crossing, a swerve out and back.

A machine is a function from (state, row, memory) to (state, output). ``folded`` runs it over stored recordings, ``streamed`` over a stream.
There, rows are held in list state until the watermark has passed them and are taken in the order of their ticks, so it does not
matter in which order they come; what is under way is closed by an event-time timer, also if no row follows. Held rows, states and memories
live in the state store and its checkpoint. Rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


@dataclass(frozen=True)
class Machine:
    """columns: what rows have besides run and tick. memory maps agents to ticks; entries ``rest`` ticks old are forgotten. due(state): the tick
    at which something ends by itself, or None; close(state, memory) ends it."""

    columns: str
    state: str
    output: str
    start: tuple
    step: Callable[[tuple, dict, dict], tuple[tuple, tuple | None]]
    due: Callable[[tuple], int | None] = lambda state: None
    close: Callable[[tuple, dict], tuple[tuple, tuple | None]] | None = None
    rest: int = 0

    def advance(self, state: tuple, memory: dict, tick: int | None) -> tuple[tuple, list[tuple]]:
        """The state at the beginning of a tick (None: after all), and the output of what ended before."""
        due, out = self.due(state), None
        if due is not None and (tick is None or due <= tick):
            state, out = self.close(state, memory)
        for agent in [a for a, t in memory.items() if tick is not None and tick - t >= self.rest]:
            del memory[agent]
        return state, [] if out is None else [out]


def tick_time(tick: str, tick_ms: int) -> Column:
    """The end of a tick (from 0); the watermark begins at the epoch, and nothing at it or before would count."""
    return F.timestamp_millis((F.col(tick).cast("bigint") + 1) * tick_ms)


def folded(rows: DataFrame, machine: Machine) -> DataFrame:
    """run and the machine's outputs over whole recordings, each a group as long as its recording. rows: run, tick and the columns."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, memory, found = machine.start, {}, []
        for row in pdf.sort_values("tick", kind="stable").to_dict("records"):
            state, ended = machine.advance(state, memory, row["tick"])
            state, out = machine.step(state, row, memory)
            found += ended if out is None else [*ended, out]
        found += machine.advance(state, memory, None)[1]
        return pd.DataFrame({"run": [key[0]] * len(found)} | {n: [x[k] for x in found] for k, n in enumerate(_names(machine.output))})

    return rows.groupBy("run").applyInPandas(fold, f"run long, {machine.output}")


class _Ordered(StatefulProcessor):
    """Holds a run's rows until the watermark is past them and steps the machine in the order of ticks, each ``tick_ms`` long."""

    def __init__(self, machine: Machine, tick_ms: int):
        self.machine, self.tick_ms = machine, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", self.machine.state)
        self.held = handle.getListState("held", "rows binary")  # the rows of a call together: values are converted one by one otherwise
        self.memory = handle.getMapState("memory", "agent long", "tick int")

    def _wake(self, tick: int) -> None:
        """One timer a run: at the first held row, or where something ends."""
        self.handle.registerTimer((tick + 1) * self.tick_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        names, first = ["tick", *_names(self.machine.columns)], None
        for pdf in rows:
            taken = [tuple(x.tolist() if hasattr(x, "tolist") else x for x in r) for r in zip(*(pdf[n].tolist() for n in names), strict=True)]
            self.held.appendValue((pickle.dumps(taken),))
            first = min([r[0] for r in taken] if first is None else [first, *(r[0] for r in taken)])
        timers = list(self.handle.listTimers())
        if first is not None and all((first + 1) * self.tick_ms < timer for timer in timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = int(timerValues.getCurrentWatermarkInMs()) // self.tick_ms - 1
        held = {r[0]: r for (rows,) in self.held.get() for r in pickle.loads(rows)}
        known = {k[0]: v[0] for k, v in self.memory.iterator()}
        now = self.now.get()
        state, memory, found = tuple(now) if now is not None else self.machine.start, dict(known), []
        names = ["tick", *_names(self.machine.columns)]
        for tick in sorted(t for t in held if t <= past):
            state, ended = self.machine.advance(state, memory, tick)
            state, out = self.machine.step(state, dict(zip(names, held.pop(tick), strict=True)), memory)
            found += ended if out is None else [*ended, out]
        state, ended = self.machine.advance(state, memory, past)
        found += ended
        if held:
            self.held.put([(pickle.dumps(list(held.values())),)])
        else:
            self.held.clear()
        self.now.update(state)
        for agent in known.keys() - memory.keys():
            self.memory.removeKey((agent,))
        for agent, tick in memory.items():
            if known.get(agent) != tick:
                self.memory.updateValue((agent,), (tick,))
        due = self.machine.due(state)
        if held or due is not None:  # the timer that has expired goes by itself
            self._wake(min([*held, *([] if due is None else [due])]))
        if not found:
            return iter(())
        return iter([pd.DataFrame({"run": [key[0]] * len(found)} | {n: [x[k] for x in found] for k, n in enumerate(_names(self.machine.output))})])

    def close(self) -> None:
        pass


def streamed(rows: DataFrame, machine: Machine, *, tick_ms: int = 100, late_ticks: int = 0) -> DataFrame:
    """:func:`folded` over a stream whose rows may be ``late_ticks`` late. rows: run, tick (int) and the machine's columns, and ts where a
    join has set a watermark on it already (:func:`tick_time`). The session's state store has to be RocksDB."""
    if "ts" not in rows.columns:
        rows = rows.withColumn("ts", tick_time("tick", tick_ms)).withWatermark("ts", f"{late_ticks * tick_ms} milliseconds")
    return rows.groupBy("run").transformWithStateInPandas(_Ordered(machine, tick_ms), f"run long, {machine.output}", "Append", "EventTime")


def retries(*, trigger: int, give_up: int, cooldown: int, rest: int) -> Machine:
    """Attempts on agents until one succeeds: (attempt, agent, start, stop, success). From tick ``trigger`` on and before ``give_up``, while none is
    under way, the first candidate that has not failed within ``rest`` ticks is tried; a failure is followed by ``cooldown`` ticks of
    none. Rows: agents (candidates in order), lengths (ticks that an attempt on each would take) and wins (whether it would succeed)."""

    def step(state: tuple, row: dict, memory: dict) -> tuple[tuple, tuple | None]:
        after, agent, *_, done, n = state
        tick = row["tick"]
        if agent >= 0 or done or not after <= tick < give_up:
            return state, None
        fit = next((k for k, a in enumerate(row["agents"]) if int(a) not in memory), None)
        if fit is None:
            return state, None
        return (after, int(row["agents"][fit]), tick, tick + int(row["lengths"][fit]), bool(row["wins"][fit]), False, n + 1), None

    def close(state: tuple, memory: dict) -> tuple[tuple, tuple | None]:
        _, agent, start, until, won, _, n = state
        if not won:
            memory[agent] = until
        return (until + cooldown, -1, 0, 0, False, won, n), (n, agent, start, until, won)

    return Machine(
        "agents array<long>, lengths array<int>, wins array<boolean>", "after int, agent long, start int, until int, won boolean, done boolean, n int", "attempt int, agent long, start int, stop int, success boolean",
        (trigger, -1, 0, 0, False, False, 0), step, lambda s: s[3] if s[1] >= 0 else None, close, rest,
    )


def crossing(*, near: float, view_deg: float, pause: int, most: int, reach: float) -> Machine:
    """A walker's phase at each tick (tick, phase): waits until in the ego's view (within ``near`` metres and ``view_deg`` degrees of its heading),
    goes in, pauses ``pause`` ticks within ``reach`` of the first goal, crosses, and is done at the second goal or after ``most`` ticks of
    crossing. Rows: x, y, yaw of the ego, wx, wy of the walker, ix, iy and cx, cy of the goals."""
    width = math.cos(math.radians(view_deg))

    def step(state: tuple, row: dict, memory: dict) -> tuple[tuple, tuple | None]:
        phase, wait, left = state
        at = lambda a, b: math.hypot(row[a] - row["wx"], row[b] - row["wy"]) < reach
        if phase == "wait":
            dx, dy = row["wx"] - row["x"], row["wy"] - row["y"]
            d = math.hypot(dx, dy)
            if 0 < d < near and (dx * math.cos(row["yaw"]) + dy * math.sin(row["yaw"])) / d > width:
                phase = "in"
        if phase == "in":
            phase = "pause" if at("ix", "iy") else "in"
        elif phase == "pause":
            wait -= 1
            phase = "cross" if wait <= 0 else phase
        if phase == "cross":
            left -= 1
            phase = "done" if at("cx", "cy") or left <= 0 else phase
        return (phase, wait, left), (row["tick"], phase)

    columns = ", ".join(f"{c} double" for c in ("x", "y", "yaw", "wx", "wy", "ix", "iy", "cx", "cy"))
    return Machine(columns, "phase string, wait int, left int", "tick int, phase string", ("wait", pause, most), step)


def swerve(*, swing: float, most: int, least: float) -> Machine:
    """An agent's swerve: out to ``swing`` metres beside its line (or for more than ``most`` ticks), then back to it (or likewise). Rows: y, the
    offset. Output at its end, once: (tick, max_lat, success), success being ``least`` metres or more to a side."""

    def step(state: tuple, row: dict, memory: dict) -> tuple[tuple, tuple | None]:
        phase, ticks, far = state
        if phase == "done":
            return state, None
        y, ticks = row["y"], ticks + 1
        far = max(far, abs(y))
        if phase == "out" and (abs(y - swing) < 0.5 or ticks > most):
            phase, ticks = "back", 0
        if phase == "back" and (abs(y) < 0.5 or ticks > most):
            return ("done", ticks, far), (row["tick"], far, far >= least)
        return (phase, ticks, far), None

    return Machine("y double", "phase string, ticks int, far double", "tick int, max_lat double, success boolean", ("out", 0, 0.0), step)
