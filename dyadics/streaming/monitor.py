"""A monitor of training runs as a stream: progress, pace, recent metrics, and whether a run has gone silent.

Each run keeps a small state: its last progress bar and the last few values of each metric, by their place in the log, so
lines may arrive in any order and again. A timer of processing time tells of a run that has written nothing for a while.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TAIL = 5
#: How trainers print a progress bar and a metric.
BAR = re.compile(r"(\d+)/(\d+)\s*\[(?:(\d+):)?(\d+):(\d+)<")
METRIC = r"'{0}': '?([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
METRICS = ("reward", "frac_reward_zero_std")
STATUS = "run string, done long, total long, share double, seconds_left double, seconds_a_step double, reward array<double>, frac_reward_zero_std array<double>, last_place long, stalled boolean"
_STATE = "bar_place long, done long, total long, spent long, last_place long, rewards string, zero_stds string"


def _tail(text: str) -> list[tuple[int, float]]:
    return [(int(p), float(v)) for p, v in (x.split("=") for x in text.split(";") if x)]


def _kept(known: list[tuple[int, float]], more: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The last TAIL values by place; a place that comes again counts once."""
    return sorted((dict(known) | dict(more)).items())[-TAIL:]


class RunMonitor(StatefulProcessor):
    """Input rows (run, place, value); a status row for each run that a batch brings lines of, or that falls silent."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _status(self, key, s: tuple, stalled: bool) -> pd.DataFrame:
        _, done, total, spent, last, rewards, zeros = s
        known = done is not None and done >= 0
        pace = spent / done if known and done else None
        row = (str(key[0]), done if known else None, total if known else None, done / total if known and total else None, pace * (total - done) if pace is not None else None, pace, [v for _, v in _tail(rewards)], [v for _, v in _tail(zeros)], last, stalled)
        return pd.DataFrame([row], columns=[c.split()[0] for c in STATUS.split(", ")]).astype({"done": "Int64", "total": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = tuple(self.state.get()) if self.state.exists() else (-1, -1, -1, 0, -1, "", "")
        bar, metrics, last = s[:4], [_tail(s[5]), _tail(s[6])], s[4]
        for part in rows:
            for place, line in zip(part["place"].tolist(), part["value"].tolist(), strict=True):
                last = max(last, int(place))
                found = BAR.search(line or "")
                if found and place > bar[0]:
                    done, total, hours, minutes, seconds = (int(x or 0) for x in found.groups())
                    bar = (int(place), done, total, hours * 3600 + minutes * 60 + seconds)
                for k, name in enumerate(METRICS):
                    value = re.search(METRIC.format(name), line or "")
                    if value:
                        metrics[k] = _kept(metrics[k], [(int(place), float(value[1]))])
        s = (*bar, last, *(";".join(f"{p}={v!r}" for p, v in m) for m in metrics))
        self.state.update(s)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield self._status(key, s, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._status(key, tuple(self.state.get()), True)

    def close(self) -> None:
        pass


def monitored(lines: DataFrame, patience_ms: int = 600_000) -> DataFrame:
    """STATUS rows, in update mode, of a stream of (run, place, value): ``place`` orders the lines of a run.

    A run without a progress bar has null progress; one that writes nothing for ``patience_ms`` is reported once more, with
    ``stalled``. The session needs the RocksDB state store (``dyadics.session.STATE_STORE``).
    """
    return lines.selectExpr("cast(run AS string) AS run", "place", "value").groupBy("run").transformWithStateInPandas(RunMonitor(patience_ms), STATUS, "Update", "ProcessingTime")


def until_read(query, rows: int, seconds: float = 300.0) -> None:
    """Waits until a query has taken in so many rows, then stops it.

    Timers of processing time keep a stream alive for ever, so a replay has no end of its own.
    """
    import time

    limit, read = time.monotonic() + seconds, {}
    try:
        while True:
            read |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress if p["numInputRows"]}
            if sum(read.values()) >= rows:
                return
            if not query.isActive and query.exception():
                raise query.exception()
            if time.monotonic() > limit:
                raise TimeoutError(f"the stream has not read {rows} rows in {seconds} seconds")
            time.sleep(0.2)
    finally:
        query.stop()
