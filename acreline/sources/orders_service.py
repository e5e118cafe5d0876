"""The given orders behind a paged service's interface: what queries and tests pull from.

A circle's (or zip's) records come in the order of their ids. The table is looked at a
batch of rows at a time: a process that is asked for a number of records holds no more than
the first page of them, one that is asked for pages the columns that a record is made from.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads

from acreline.sources.records import Answer

RADIUS = 3958.8
#: Rows of the table that are looked at together.
ROWS = 1 << 17
ZIPS = np.array([f"296{x:02d}" for x in range(40)])


def _miles(k: np.ndarray, area: tuple) -> np.ndarray:
    _, at, lng, radius = area
    lat_, lng_ = _places(k)
    r = math.pi / 180
    x, y = np.sin((lat_ - at) * (r / 2)), np.sin((lng_ - lng) * (r / 2))
    return 2 * RADIUS * np.arcsin(np.sqrt(x * x + np.cos(lat_ * r) * math.cos(at * r) * (y * y)))


def _places(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return 34.5 + (k * 7919 % 10007) / 10007.0 * 0.2, -82.65 + (k * 104729 % 10009) / 10009.0 * 0.2


def _matches(table: str, kind: str, area: tuple, since: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(id, zip's number, price, microseconds of the sale) of the area's records, batch by batch in the table's order."""
    stream = pads.ParquetFragmentScanOptions(use_buffered_stream=True, buffer_size=1 << 20, pre_buffer=False)
    data = pads.dataset(table, format=pads.ParquetFileFormat(default_fragment_scan_options=stream))
    names = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"]
    for b in data.to_batches(columns=names, batch_size=ROWS, batch_readahead=1, fragment_readahead=1):
        keep = pc.equal(b["o_orderstatus"], "F" if kind == "deed_records" else "O")
        day = pc.cast(b["o_orderdate"], pa.timestamp("us"))
        if since:
            keep = pc.and_(keep, pc.greater_equal(day, pc.strptime(since, "%Y-%m-%d", "us")))
        b = pa.table({"k": b["o_orderkey"], "c": b["o_custkey"], "price": pc.cast(b["o_totalprice"], pa.float64()), "day": pc.cast(day, pa.int64())}).filter(keep)
        k, zip_ = b["k"].to_numpy(), (b["c"].to_numpy() % 40).astype(np.int8)
        own = ZIPS[zip_] == area[1] if area[0] == "zip" else _miles(k, area) <= area[3]
        yield k[own], zip_[own], b["price"].to_numpy()[own], b["day"].to_numpy()[own]


def _rows(area: tuple, k: np.ndarray, zip_: np.ndarray, price: np.ndarray, day: np.ndarray) -> list[tuple]:
    lat, lng = _places(k)
    miles = pa.nulls(len(k), pa.float64()) if area[0] == "zip" else pa.array(_miles(k, area))
    page = pa.table({
        "id": pa.array(k), "address_hash": pa.array([f"H{x}" for x in k.tolist()], pa.string()), "zip_code": pa.array(ZIPS[zip_].tolist(), pa.string()), "lat": pa.array(lat), "lng": pa.array(lng), "miles": miles, "price": pa.array(price), "sold_date": pa.array(day).cast(pa.timestamp("us")),
    })
    return [tuple(r.values()) for r in page.to_pylist()]


@functools.lru_cache(16)
def _first(table: str, kind: str, area: tuple, since: str, n: int) -> tuple[int, list[tuple]]:
    """The number of records and the first n of them."""
    total, held = 0, None
    for came in _matches(table, kind, area, since):
        total += len(came[0])
        if n:
            held = came if held is None else tuple(np.concatenate(x) for x in zip(held, came, strict=True))
            least = np.argsort(held[0], kind="stable")[:n]
            held = tuple(x[least] for x in held)
    return total, _rows(area, *held) if held is not None else []


@functools.lru_cache(1)
def _records(table: str, kind: str, area: tuple, since: str) -> list[np.ndarray]:
    """25 bytes a record, in the order of the ids."""
    parts = list(zip(*_matches(table, kind, area, since), strict=True))
    if not parts:
        return [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0), np.zeros(0, np.int64)]
    order = np.argsort(np.concatenate(parts[0]), kind="stable")
    out = []
    while parts:
        out.append(np.concatenate(parts.pop(0))[order])
    return out


def fetch(request: dict) -> Answer:
    """A page of the records of a kind in a circle or zip, sold since a date."""
    area = ("zip", request["zip"]) if "zip" in request else ("circle", float(request["lat"]), float(request["lng"]), float(request["radius"]))
    of = request["table"], request["kind"], area, request.get("since", "")
    start, limit = int(request["offset"]), int(request["limit"])
    if request.get("count"):
        total, rows = _first(*of, start + limit)
        return Answer(200, {"X-Total-Count": str(total)}, rows[start:])
    return Answer(200, {}, _rows(area, *[x[start : start + limit] for x in _records(*of)]))
