"""Stateful processors of the streams: a small state for each key, cleared by an event-time timer.

Rows of a trigger are taken in order of their time, so what a processor says of events that come in
order doesn't depend on how they are cut into triggers.
"""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor


class Expiring(StatefulProcessor):
    """Keeps a timer at the time from which a key's state says nothing any more."""

    def _expire_at(self, micros: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(micros // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def in_order(rows):
    return sorted(rows, key=lambda r: (r["event_t"], r["event_o"] is not None, r["event_o"]))


class AcceptFirst(Expiring):
    """Passes every row on with ``accepted``: no accepted row of its key is less than ``gap`` microseconds old."""

    def __init__(self, gap: int, columns: list[str]) -> None:
        self.gap, self.columns = gap, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues):
        before = last = self.state.get()[0] if self.state.exists() else None
        out = Row(*self.columns, "accepted")
        for r in in_order(rows):
            # A row that comes late is judged by the last accepted one too, and doesn't take its place.
            new = last is None or r["event_t"] - last >= self.gap
            if new:
                last = r["event_t"]
            yield out(*(r[c] for c in self.columns), new)
        if last != before:
            self.state.update((last,))
            self._expire_at(last + self.gap)


class Dispute(Expiring):
    """A row when a key's reports of the last ``span`` microseconds reach ``least``, and none again until they fell below.

    State is the last ``least`` times and whether the row was given. A report of a protected key counts, but
    gives no row; the next one may.
    """

    def __init__(self, span: int, least: int) -> None:
        self.span, self.least = span, least

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reports", "times array<long>, raised boolean")

    def handleInputRows(self, key, rows, timerValues):
        times, raised = (list(self.state.get()[0]), self.state.get()[1]) if self.state.exists() else ([], False)
        out = Row("k", "t", "first_t", "n_reports")
        for r in in_order(rows):
            times = sorted([*times, r["event_t"]])[-self.least :]
            recent = [t for t in times if t > times[-1] - self.span]
            if len(recent) < self.least:
                raised = False
            elif not raised and not r["protected"]:
                raised = True
                yield out(key[0], times[-1], recent[0], len(recent))
        self.state.update((times, raised))
        self._expire_at(times[-1] + self.span)
