"""Custom state of keys in the state store: memories with a time to live, and running surprise.

State lies in the embedded store of each partition (``jobs.run_once`` chooses it)
and in checkpoints that executors share, so a lost executor's keys go on
elsewhere. Of a key's rows in a micro-batch only times
and numbers are held, to be taken in time order: a trigger's size
(``files_per_trigger``) bounds them, 24 bytes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemospark.operators.learning import surprise_step

def in_time_order(frames: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """(microseconds, event_id, columns) of a key's rows, by time."""
    parts = [(f.ts.to_numpy().astype("datetime64[us]").astype(np.int64), f.event_id.to_numpy(), *(f[c].to_numpy() for c in columns)) for f in frames]
    out = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((out[1], out[0]))
    return [c[order] for c in out]


class Memory(StatefulProcessor):
    """The event that opens a memory of each key, which lives for a time from then on; a timer in event time clears it."""

    def __init__(self, hours: int):
        self.life = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = until = self.until.get()[0] if self.until.exists() else None
        ts, event = in_time_order(rows)
        opened, at = [], 0
        while at < len(ts):  # from opening to opening, whatever lies between
            if until is not None and ts[at] < until:
                at = int(np.searchsorted(ts, until))
                continue
            opened.append(at)
            until = int(ts[at]) + self.life
        if opened:
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            self.until.update((until,))
            self.handle.registerTimer(until // 1000)
            begun = ts[opened]
            yield pd.DataFrame({"user_id": key[0], "event_type": key[1], "event_id": event[opened], "begun": begun.astype("datetime64[us]"), "until": (begun + self.life).astype("datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


class Surprise(StatefulProcessor):
    """Running momentum surprise of a user: four numbers of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "n long, mean double, momentum double, promoted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.now.get()) if self.now.exists() else (0, 0.0, 0.0, 0)
        for score in in_time_order(rows, "score")[2].tolist():
            if score == score:  # nulls come as NaN
                now = surprise_step(now, score)
        self.now.update(now)
        yield pd.DataFrame({"user_id": [key[0]], "n": [now[0]], "promoted": [now[3]], "momentum": [now[2]]})

    def close(self) -> None:
        pass
