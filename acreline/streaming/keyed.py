"""Keyed operators with state of their own: watchdog, ageing out, ordered status events, first sightings.

Each keeps a few values a key in the state store and is woken by event-time timers, so a
key costs nothing once its timer has gone off; rows may come in any order within the time
that late rows are waited for (`late`). Rows with a null key only move the clock.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE, DAY = 60_000, 86_400_000


class Watchdog(StatefulProcessor):
    """Tells when a key has been silent for `limit` ms, and when it is heard again after that."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, idle boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest = max((r.at for r in rows), default=None)
        if key[0] is None or newest is None:
            return
        held, idle = self.last.get() if self.last.exists() else (None, False)
        if held is not None and held >= newest:
            return
        if held is not None and not idle:
            self.handle.deleteTimer(held + self.limit)
            if held + self.limit < timerValues.getCurrentWatermarkInMs():
                # the alarm is due in the batch that brings these rows, which are seen first
                idle = True
                yield Row(key=key[0], at=held, idle=True)
        self.last.update((newest, False))
        self.handle.registerTimer(newest + self.limit)
        if idle:
            yield Row(key=key[0], at=newest, idle=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at, _ = self.last.get()
        self.last.update((at, True))
        yield Row(key=key[0], at=at, idle=True)


class Ageing(StatefulProcessor):
    """Tells of a key's item when it has got older than `keep` ms without a confirmation, whichever of the two came first, and forgets both."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "id long, due long")
        self.confirmed = handle.getValueState("confirmed", "until long")

    def _due(self, at: int, arrived: int) -> int:
        # a timer goes off at its own time too, when an item is `keep` ms old and not yet older
        return max(at + self.keep + 1, arrived)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if key[0] is None:
            return
        for r in rows:
            if r.confirms:
                if self.item.exists():
                    self.handle.deleteTimer(self.item.get()[1])
                    self.item.clear()
                until = self._due(r.at, r.arrived) + self.keep
                if not self.confirmed.exists():
                    self.confirmed.update((until,))
                    self.handle.registerTimer(until)
            elif not self.confirmed.exists() and not self.item.exists():
                due = self._due(r.at, r.arrived)
                self.item.update((r.id, due))
                self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.item.exists() and self.item.get()[1] == at:
            yield Row(key=key[0], id=self.item.get()[0])
            self.item.clear()
        if self.confirmed.exists() and self.confirmed.get()[0] == at:
            self.confirmed.clear()


class LastStatus(StatefulProcessor):
    """Applies a key's events in the order of their time and number once no earlier one can come; the last status stands, `ends` closes the key's code."""

    def __init__(self, ends: str, closed: str) -> None:
        self.ends, self.closed = ends, closed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, number long, status string")
        self.state = handle.getValueState("state", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came = [(r.at, r.number, r.status) for r in rows]
        if key[0] is not None and came:
            self.waiting.appendList(came)
            self.handle.registerTimer(max(at for at, _, _ in came))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        now = sorted(x for x in held if x[0] <= until)
        later = [x for x in held if x[0] > until]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if now:
            at, number, status = now[-1]
            name = self.closed if status == self.ends else status.lower()
            if not self.state.exists() or self.state.get()[0] != name:
                self.state.update((name,))
                yield Row(key=key[0], state=name, active=name != self.closed, at=at, number=number)


class FirstSight(StatefulProcessor):
    """Passes a key's first row on, and another only when the key hasn't been kept for longer (state with a time to live)."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "number long", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min((r.number for r in rows), default=None)
        if first is not None and not self.seen.exists():
            self.seen.update((first,))
            yield Row(key=key[0], number=first)


def idle(rows: DataFrame, limit: int = 30 * MINUTE, late: str = "1 day") -> DataFrame:
    """(key, at, idle) from (key, ts): a row when a key falls silent for longer than `limit` ms and one when it is heard again."""
    timed = rows.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("at"))
    return timed.groupBy("key").transformWithState(Watchdog(limit), "key long, at long, idle boolean", "append", "eventTime")


def aged_out(rows: DataFrame, keep: int = 60 * DAY, late: str = "10 days") -> DataFrame:
    """(key, id) of items older than `keep` ms that no row has confirmed, from (key, id, confirms, at, arrived)."""
    timed = rows.withWatermark("arrived", late).select("key", "id", "confirms", F.unix_millis("at").alias("at"), F.unix_millis("arrived").alias("arrived"))
    return timed.groupBy("key").transformWithState(Ageing(keep), "key string, id long", "append", "eventTime")


def statuses(rows: DataFrame, ends: str, closed: str = "canceled", late: str = "1 day") -> DataFrame:
    """(key, state, active, at, number): each change of a key's status from (key, ts, number, status)."""
    timed = rows.withWatermark("ts", late).select("key", "number", "status", F.unix_millis("ts").alias("at"))
    return timed.groupBy("key").transformWithState(LastStatus(ends, closed), "key long, state string, active boolean, at long, number long", "append", "eventTime")


def first_sights(rows: DataFrame, keep: int = DAY) -> DataFrame:
    """(key, number) of each key's least number when it is first met, or met again after `keep` ms of processing time."""
    return rows.select("key", "number").groupBy("key").transformWithState(FirstSight(keep), "key long, number long", "append", "processingTime")
