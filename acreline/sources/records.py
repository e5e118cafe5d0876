"""A paged record service as a Spark source, in batches and as a stream.

The service is a function request -> (status, headers, records) given by import path: a
request is a dict of what a call to the service would send, so the source has no client of
its own and any can be put in. A task reads a page or a few; a page that fails for good
fails its task, which Spark runs again.

In batches, the first page tells how many records there are and later pages are dealt to
tasks; bounds on distance and date are pushed into the request. As a stream, the offset is
the place in the pull - phase, circle and record - so a pull goes on after a stop where the
sink has got to, and what the sink has taken is acknowledged to the service.
"""

from __future__ import annotations

import importlib
import itertools
import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Seconds between tries, and records of a page: fixed values of the service.
WAITS = (5, 10, 20)
LIMIT = 500
#: Pages that the first batch of a stream takes; without a number given each one after it takes as many again as all before it.
PAGES = 4
#: Tasks that the pages of a read or of a batch are dealt to at most: a task reads pages that follow each other.
TASKS = 64
PHASES = ("deed_records", "listings_records")
SCHEMA = "id long, address_hash string, zip_code string, lat double, lng double, miles double, price double, sold_date timestamp"


class Answer(NamedTuple):
    status: int
    headers: dict
    records: list


def named(path: str) -> Callable:
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def ask(call: Callable[[dict], Answer | None], request: dict, waits: Sequence[float] = WAITS, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The service's answer, waiting where it asks to be left alone or fails.

    No answer, 429 and 5xx are tried again; 429 after what Retry-After says. 401 and other
    refusals give no records, and their status. What still fails after the last wait is an
    error, but 5xx, which is a refusal then.
    """
    for wait in (*waits, None):
        try:
            got = call(request)
        except OSError:
            got = None
        if got is not None and got.status == 200:
            return Answer(*got)
        if got is not None and got.status != 429 and (got.status < 500 or wait is None):
            return Answer(got.status, got.headers, [])
        if wait is None:
            raise OSError("the service gave no answer" if got is None else "the service's rate limit is used up")
        sleep(float(got.headers.get("Retry-After", wait)) if got is not None and got.status == 429 else wait)
    raise AssertionError


class Page(InputPartition):
    """So many pages from a request's on; of the first its records, if they are here already, and of all no more than `keep`."""

    def __init__(self, request: dict, records: list | None = None, keep: int | None = None, pages: int = 1) -> None:
        super().__init__(json.dumps(request))
        self.request, self.records, self.keep, self.pages = request, records, keep, pages


def rows_of(page: Page, fetch: Callable) -> Iterator[tuple]:
    left = page.keep
    for i in range(page.pages):
        records = page.records if i == 0 else None
        if records is None:
            request = {**page.request, "offset": page.request["offset"] + i * page.request["limit"]}
            got = ask(fetch, request)
            if got.status not in (200, 401):
                raise OSError(f"the service answered {got.status} to {request}")
            records = got.records
        yield from map(tuple, records[:left])
        left = None if left is None else max(0, left - len(records))


class RecordReader(DataSourceReader):
    """Options: fetch; lat, lng, radius; or zip; kind (a phase), since (a date), limit, cap (records at most; none by default); others go to the service as they are."""

    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.fetch = self.options.pop("fetch")
        self.limit = int(self.options.pop("limit", LIMIT))
        cap = self.options.pop("cap", None)
        self.cap = int(cap) if cap else None
        self.pushed: dict = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Upper bounds of `miles` and lower ones of `sold_date` narrow the request; Spark still applies all filters."""
        for f in filters:
            if isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("miles",):
                self.pushed["radius"] = min(float(f.value), self.pushed.get("radius", float(self.options.get("radius", f.value))))
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("sold_date",):
                self.pushed["since"] = max(str(f.value)[:10], self.pushed.get("since", self.options.get("since", "")))
            yield f

    def request(self, offset: int) -> dict:
        return {**self.options, **self.pushed, "limit": self.limit, "offset": offset}

    def partitions(self) -> list[InputPartition]:
        first = ask(named(self.fetch), {**self.request(0), "count": True})
        if first.status not in (200, 401):
            raise OSError(f"the service answered {first.status}")
        total = int(first.headers.get("X-Total-Count", len(first.records)))
        total = total if self.cap is None else min(total, self.cap)
        # the first page is here already: its records travel with its task
        pages = -(-total // self.limit) - 1
        each = max(1, -(-pages // TASKS))
        later = range(1, pages + 1, each)
        return [Page(self.request(0), first.records, total)] + [Page(self.request(i * self.limit), None, total - i * self.limit, min(each, pages + 1 - i)) for i in later]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from rows_of(partition, named(self.fetch))


class PullReader(DataSourceStreamReader):
    """Options: fetch; circles ([[lat, lng, radius], ...] as JSON); phases, since, limit, pages (of each batch; by default they grow); ack (called with an offset that the sink has taken)."""

    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.fetch, self.ack = options.pop("fetch"), options.pop("ack", None)
        self.circles = json.loads(options.pop("circles"))
        self.phases = tuple(options.pop("phases", ",".join(PHASES)).split(","))
        self.limit, self.pages = int(options.pop("limit", LIMIT)), int(options.pop("pages", 0))
        self.taken = 0
        self.options = options
        self.totals: dict[tuple[str, int], int] = {}
        self.at: dict | None = None

    def _request(self, phase: str, circle: int, offset: int) -> dict:
        lat, lng, radius = self.circles[circle]
        return {**self.options, "kind": phase, "lat": lat, "lng": lng, "radius": radius, "limit": self.limit, "offset": offset}

    def _total(self, phase: str, circle: int) -> int:
        """Records of a circle, asked for once a pull when it is reached."""
        if (phase, circle) not in self.totals:
            got = ask(named(self.fetch), {**self._request(phase, circle, 0), "limit": 0, "count": True})
            if got.status not in (200, 401):
                raise OSError(f"the service answered {got.status}")
            self.totals[phase, circle] = int(got.headers.get("X-Total-Count", 0))
        return self.totals[phase, circle]

    def _next(self, at: dict, pages: int) -> dict:
        """The place after so many pages, or at the end of the circle."""
        if at["phase"] == "complete":
            return at
        offset = at["offset"] + pages * self.limit
        if offset < self._total(at["phase"], at["circle"]):
            return {**at, "offset": offset}
        if at["circle"] + 1 < len(self.circles):
            return {"phase": at["phase"], "circle": at["circle"] + 1, "offset": 0}
        after = self.phases.index(at["phase"]) + 1
        return {"phase": self.phases[after] if after < len(self.phases) else "complete", "circle": 0, "offset": 0}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"phase": self.phases[0], "circle": 0, "offset": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        # a query that is started again plans its last batch first, so no place is known only in a new one
        at, pages = self.at or self.initialOffset(), self.pages or max(PAGES, self.taken)
        self.at = self._next(at, pages)
        here = self._total(at["phase"], at["circle"]) - at["offset"] if at["phase"] != "complete" else 0
        self.taken += min(pages, -(-here // self.limit))
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:
            self.at = end
        pages: list[dict] = []
        at = start
        while at != end and at["phase"] != "complete":
            if self._total(at["phase"], at["circle"]):
                pages.append(at)
            at = self._next(at, 1)
        each = max(1, -(-len(pages) // TASKS))
        out: list[InputPartition] = []
        for _, circle in itertools.groupby(pages, lambda p: (p["phase"], p["circle"])):
            some = list(circle)
            out += [Page(self._request(**some[i]), None, None, len(some[i : i + each])) for i in range(0, len(some), each)]
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in rows_of(partition, named(self.fetch)):
            yield (*row, partition.request["kind"])

    def commit(self, end: dict) -> None:
        if self.ack:
            named(self.ack)(end)


class RecordSource(DataSource):
    """spark.dataSource.register(RecordSource); spark.read.format("records") or spark.readStream.format("records").

    Where filters are pushed down (spark.sql.python.filterPushdown.enabled), load anew for each
    query: Spark keeps with a loaded frame what its first filter has narrowed.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA + (", phase string" if "circles" in {k.lower() for k in self.options} else "")

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PullReader(dict(self.options))
