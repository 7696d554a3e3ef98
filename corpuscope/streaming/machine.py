"""State machines of runs over a stream: events take effect in the order of their times, however they arrive.

Each run's events wait in its state until the watermark has passed them; a timer then applies them in order. What arrives
behind the watermark is dropped by the stream and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a command makes of a status; any other command is invalid and changes nothing.
MOVES = {
    ("REGISTERED", "start"): "INGESTING",
    ("FAILED", "start"): "INGESTING",
    ("INGESTING", "done"): "INDEXED",
    ("INGESTING", "fail"): "FAILED",
}
FIRST = "REGISTERED"
OUT = "run long, status string, moves long, invalid long, applied long"


def applied(status: str, commands: list[str]) -> tuple[str, int, int]:
    """Status after the commands, how many moved it, how many were invalid."""
    moves = 0
    for c in commands:
        if (status, c) in MOVES:
            status, moves = MOVES[status, c], moves + 1
    return status, moves, len(commands) - moves


class Machine(StatefulProcessor):
    """Rows have run, at (a time in microseconds), number (tells events of one time apart) and command."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, moves long, invalid long, applied long")
        self.waiting = handle.getListState("waiting", "at long, number long, command string")

    def _now(self) -> tuple:
        return self.now.get() if self.now.exists() else (FIRST, 0, 0, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  (names of the interface)
        new = [(r.at, r.number, r.command) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(at for at, _, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(x for x in held if x[0] < until)
        if not due:
            return
        rest = [x for x in held if x[0] >= until]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        status, moves, invalid, done = self._now()
        status, more, bad = applied(status, [c for _, _, c in due])
        now = (status, moves + more, invalid + bad, done + len(due))
        self.now.update(now)
        yield Row(run=key[0], **dict(zip(("status", "moves", "invalid", "applied"), now, strict=True)))

    def close(self) -> None:
        pass


def followed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """States of runs each time they change; events have run, ts (a timestamp), number and command."""
    rows = events.withWatermark("ts", delay).select("ts", "run", F.unix_micros("ts").alias("at"), "number", "command")
    return rows.groupBy("run").transformWithState(Machine(), OUT, "Append", "EventTime")


def latest(states: DataFrame) -> DataFrame:
    """The last of each run's states."""
    return states.groupBy("run").agg(F.max(F.struct("applied", "status", "moves", "invalid")).alias("s")).select("run", "s.status", "s.moves", "s.invalid", "s.applied")
