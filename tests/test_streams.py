"""Keyed streams, joins of two streams, the bucketed table and the record source: state, order of arrival, replays and restarts."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from acreline.plans import pulls
from acreline.plans.base import Tables
from acreline.sources import records
from acreline.sources.records import Answer, RecordSource
from acreline.streaming import keyed, pairs, run
from acreline.streaming.buckets import BucketTable
from tests.conftest import SF

MINUTE = 60


def deliveries(spark, path, schema, *batches):
    """Each batch one file, later ones delivered later."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return run.read(run.session(spark), str(path), spark.createDataFrame([], schema).schema)


def at(minutes):
    return time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(1_700_000_000 + minutes * MINUTE))


def drain(rows, path, spark):
    query = rows.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "log")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return [tuple(r) for r in spark.read.schema(rows.schema).parquet(str(path / "out")).collect()], query.recentProgress


def timed(rows):
    return rows.withColumn("ts", F.col("at").cast("timestamp"))


def test_watchdog_fires_without_rows_of_the_key(spark, tmp_path):
    rows = timed(deliveries(spark, tmp_path / "in", "key long, at string", [(1, at(0)), (2, at(0))], [(1, at(20))], [(1, at(50)), (None, at(100))], [(2, at(170)), (None, at(400))]))
    got, progress = drain(keyed.idle(rows.select("key", "ts"), 30 * keyed.MINUTE, "10 minutes"), tmp_path, spark)
    base = 1_700_000_000_000
    # 2 is silent from the start and heard again; 1 has no row between its last one and the alarm
    assert sorted(got) == sorted([(2, base, True), (1, base + 50 * 60_000, True), (2, base + 170 * 60_000, False), (2, base + 170 * 60_000, True)])


def test_ageing_forgets_its_keys(spark, tmp_path):
    kind = "key string, id long, confirms boolean, at string, arrived string"
    day = 24 * 60
    first = [("a", 1, False, at(0), at(0)), ("b", 2, False, at(0), at(0)), ("c", None, True, at(0), at(0)), ("d", 4, False, at(9 * day), at(0))]
    second = [("b", None, True, at(day), at(day)), ("c", 3, False, at(0), at(day))]
    rows = deliveries(spark, tmp_path / "in", kind, first, second, [(None, None, False, at(20 * day), at(8 * day))], [(None, None, False, at(20 * day), at(60 * day))])
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("at", "arrived")})
    got, progress = drain(keyed.aged_out(rows, 3 * keyed.DAY, "2 days"), tmp_path, spark)
    # b and c were confirmed, before and after they came; d was young for longer than a
    assert sorted(got) == [("a", 1), ("d", 4)]
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(held) > 0 and held[-1] < max(held)


def test_ageing_keeps_what_is_as_old_as_it_may_be(spark, tmp_path):
    kind = "key string, id long, confirms boolean, at string, arrived string"
    day = 24 * 60
    first = [("older", 1, False, at(-1), at(0)), ("as old", 2, False, at(0), at(0)), ("younger", 3, False, at(1), at(0))]
    rows = deliveries(spark, tmp_path / "in", kind, first, [(None, None, False, at(0), at(5 * day))])
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("at", "arrived")})
    got, _ = drain(keyed.aged_out(rows, 3 * keyed.DAY, "2 days"), tmp_path, spark)  # the clock stops at three days
    assert got == [("older", 1)]


def test_statuses_settle_in_order(spark, tmp_path):
    kind = "key long, at string, number long, status string"
    late = [(1, at(10), 3, "CALLBACK"), (1, at(4), 1, "QUALIFIED"), (1, at(4), 2, "HARD_NO")]
    rows = timed(deliveries(spark, tmp_path / "in", kind, [(1, at(8), 9, "QUALIFIED"), (2, at(3), 4, "SOLD")], late, [(None, at(90), None, None)]))
    got, _ = drain(keyed.statuses(rows.select("key", "ts", "number", "status"), "HARD_NO", late="20 minutes"), tmp_path, spark)
    last = {}
    for key, state, active, when, number in sorted(got, key=lambda r: (r[3], r[4])):
        last[key] = (state, active, number)
    assert last == {1: ("callback", True, 3), 2: ("sold", True, 4)}


def taken(rows, path, spark, n):
    """What a stream on processing time has given by when it has read n rows; it would go on for ever."""
    query = rows.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "log")).trigger(processingTime="1 second").start()
    end = time.time() + 60
    while time.time() < end and sum(p.numInputRows for p in query.recentProgress) < n:
        time.sleep(0.5)
    query.stop()
    return sorted(tuple(r) for r in spark.read.schema(rows.schema).parquet(str(path / "out")).collect())


def test_first_sights_expire(spark, tmp_path):
    rows = deliveries(spark, tmp_path / "in", "key long, number long", [(1, 5), (1, 2), (2, 7)], [(1, 9)])
    assert taken(keyed.first_sights(rows, keyed.DAY), tmp_path, spark, 4) == [(1, 2), (2, 7)]
    short = tmp_path / "short"
    short.mkdir()
    rows = deliveries(spark, short / "in", "key long, number long", [(1, 5)], [(1, 9)])
    assert taken(keyed.first_sights(rows, 1), short, spark, 2) == [(1, 5), (1, 9)]


def test_pairs_give_each_left_row_once(spark, tmp_path):
    left = [[(1, 1, at(0)), (2, 1, at(400)), (3, 2, at(30))], [(4, 3, at(420))], [(9, -1, at(9000))]]
    right = [[(10, 1, at(20))], [(11, 1, at(410)), (12, 1, at(415)), (13, 3, at(300))], [(99, -1, at(9000))]]
    for name, kind, rows in (("left", "id long, k long, x string", left), ("right", "other long, k long, y string", right)):
        deliveries(spark, tmp_path / name, kind, *rows)
    session = run.session(spark)
    read = lambda name, kind, c: run.read(session, str(tmp_path / name), spark.createDataFrame([], kind).schema).withColumn(c, F.col(c).cast("timestamp"))
    met = pairs.within(read("left", "id long, k long, x string", "x"), read("right", "other long, k long, y string", "y"), ["k"], ("x", "y"), "30 MINUTES", "30 MINUTES", ("10 minutes", "10 minutes"))
    got, _ = drain(met.select("id", "other"), tmp_path, spark)
    assert sorted(r for r in got if r[0] != 9) == [(1, 10), (2, 11), (2, 12), (3, None), (4, None)] or sorted(map(str, got))[:5] == ["(1, 10)", "(2, 11)", "(2, 12)", "(3, None)", "(4, None)"]


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_bucket_table_rewrites_what_a_batch_touches(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, ts long, v string").schema
    table = BucketTable(spark, str(tmp_path / "t"), schema, ["id"], ["ts"], buckets=32)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table.apply(frame([(i, 1, "a") for i in range(400)]), 0)
    before = files(tmp_path / "t" / "table")
    table.apply(frame([(7, 2, "b"), (8, 0, "old"), (9, 1, "a"), (1000, 1, "new"), (None, 5, "nobody")]), 1)
    after = files(tmp_path / "t" / "table")
    assert len({p.split("/")[0] for p in set(before) ^ set(after)}) <= 2  # of 32 buckets, those of 7 and 1000
    rows = {r.id: (r.v, r.changed_by) for r in table.rows().collect()}
    assert len(rows) == 401 and rows[7] == ("b", 1) and rows[8] == ("a", 0) and rows[9] == ("a", 0) and rows[1000] == ("new", 1)
    # the same batch again, and its rows under another number
    table.apply(frame([(7, 2, "b"), (1000, 1, "new")]), 1)
    table.apply(frame([(7, 2, "b"), (1000, 1, "new")]), 2)
    assert {r.id: (r.v, r.changed_by) for r in table.rows().collect()} == rows
    fed = spark.read.parquet(str(tmp_path / "t" / "feed"))
    assert {(r.batch, r.id) for r in fed.filter("batch > 0").collect()} == {(1, 7), (1, 1000)}


def test_bucket_table_ends_a_broken_batch(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "id long, ts long").schema
    table = BucketTable(spark, str(tmp_path / "t"), schema, ["id"], ["ts"])
    table.apply(spark.createDataFrame([(1, 1)], schema), 0)
    real = BucketTable.rows
    calls = []

    def broken(self):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost between the feed and the table")
        return real(self)

    monkeypatch.setattr(BucketTable, "rows", broken)
    with pytest.raises(OSError, match="lost"):
        table.apply(spark.createDataFrame([(1, 2), (2, 2)], schema), 1)
    monkeypatch.setattr(BucketTable, "rows", real)
    table.apply(spark.createDataFrame([(1, 2), (2, 2)], schema), 1)
    assert sorted((r.id, r.ts, r.changed_by) for r in table.rows().collect()) == [(1, 2, 1), (2, 2, 1)]


def test_waits_of_the_service():
    waited, answers = [], iter([OSError(), Answer(429, {"Retry-After": "7"}, []), Answer(503, {}, []), Answer(200, {}, [(1,)])])

    def call(request):
        got = next(answers)
        if isinstance(got, OSError):
            raise got
        return got

    assert records.ask(call, {}, sleep=waited.append).records == [(1,)]
    assert waited == [5, 7.0, 20]
    assert records.ask(lambda r: Answer(401, {}, [(1,)]), {}, sleep=waited.append) == Answer(401, {}, [])
    assert records.ask(lambda r: Answer(404, {}, []), {}, sleep=waited.append).status == 404
    assert len(waited) == 3
    assert records.ask(lambda r: Answer(500, {}, []), {}, sleep=waited.append).status == 500
    with pytest.raises(OSError, match="rate limit"):
        records.ask(lambda r: Answer(429, {}, []), {}, sleep=waited.append)
    with pytest.raises(OSError, match="no answer"):
        records.ask(lambda r: None, {}, sleep=waited.append)


def logged(request):
    """The service, noting each request in a file named by the request."""
    from acreline.sources.orders_service import fetch

    with open(request["log"], "a") as f:
        f.write(json.dumps(request) + "\n")
    return fetch(request)



def test_filters_reach_the_service(spark, tmp_path):
    session = run.session(spark)
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    session.dataSource.register(RecordSource)
    options = {"fetch": "tests.test_streams.logged", "log": str(tmp_path / "log"), "table": f"{SF}/orders.parquet", "kind": "deed_records", "lat": 34.6, "lng": -82.55, "radius": 20, "limit": 100}
    rows = session.read.format("records").options(**options).load()
    near = rows.filter((F.col("miles") <= 3.0) & (F.col("sold_date") >= F.lit("1997-06-01").cast("timestamp")))
    n = near.count()
    asked = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert all(r["radius"] == 3.0 and r["since"] == "1997-06-01" for r in asked)
    assert len({r["offset"] for r in asked}) == len(asked)  # no page is fetched twice
    (tmp_path / "log").unlink()
    whole = session.read.format("records").options(**options).load().collect()
    assert 0 < n == sum(r.miles <= 3.0 and str(r.sold_date) >= "1997-06-01" for r in whole) < len(whole)
    assert session.read.format("records").options(**options, cap=150).load().count() == 150


def test_pull_goes_on_where_it_stopped(spark, tmp_path):
    t = Tables(spark, SF)
    options = {"fetch": "tests.test_streams.logged", "log": str(tmp_path / "asked"), "limit": 60, "pages": 2}
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(records.SCHEMA + ", phase string")
    table = BucketTable(spark, str(tmp_path / "t"), schema, ["id"], ["phase", "miles"], keep_first=True)
    assert pulls.pull(t, table, str(tmp_path / "check"), 2, **options) == 2
    some = table.rows().count()
    first = (tmp_path / "asked").read_text()
    assert pulls.pull(t, table, str(tmp_path / "check"), **options) >= 1
    rows = table.rows().collect()
    assert 0 < some < len(rows) == len({r.id for r in rows})
    again = [json.loads(x) for x in (tmp_path / "asked").read_text()[len(first) :].splitlines()]
    taken = {(r["kind"], r["lat"], r["offset"]) for r in map(json.loads, first.splitlines()) if r["limit"]}
    # only what the broken-off batch had asked for is asked for again
    assert len(taken & {(r["kind"], r["lat"], r["offset"]) for r in again if r["limit"]}) <= 2


def test_pull_offsets_walk_phases_circles_and_pages():
    reader = records.PullReader({"fetch": "tests.test_streams.counted", "circles": "[[0, 0, 1], [1, 1, 1]]", "limit": "10", "pages": "2"})
    at, seen = reader.initialOffset(), []
    while at["phase"] != "complete":
        end = reader.latestOffset()
        seen.append([(p.request["kind"], p.request["lat"], p.request["offset"]) for p in reader.partitions(at, end)])
        at = end
    assert seen == [[("deed_records", 0, 0), ("deed_records", 0, 10)], [("deed_records", 0, 20)], [], [("listings_records", 0, 0), ("listings_records", 0, 10)], [("listings_records", 0, 20)], []]
    again = records.PullReader({"fetch": "tests.test_streams.counted", "circles": "[[0, 0, 1], [1, 1, 1]]", "limit": "10", "pages": "2"})
    assert len(again.partitions({"phase": "deed_records", "circle": 0, "offset": 0}, {"phase": "deed_records", "circle": 0, "offset": 20})) == 2
    assert again.latestOffset() == {"phase": "deed_records", "circle": 1, "offset": 0}  # started again, it goes on behind its last batch


def counted(request):
    return Answer(200, {"X-Total-Count": "25" if request["lat"] == 0 else "0"}, [])


def test_batches_of_a_pull_grow():
    """Four pages a batch made a pull of 25,000 pages 6,250 batches, each with a rewrite of its table's buckets."""
    reader = records.PullReader({"fetch": "tests.test_streams.many", "circles": "[[0, 0, 1], [1, 1, 1]]", "limit": "10"})
    at, got, sizes = reader.initialOffset(), [], []
    while at["phase"] != "complete":
        end = reader.latestOffset()
        tasks = reader.partitions(at, end)
        assert len(tasks) <= records.TASKS
        offsets = [(p.request["kind"], p.request["lat"], p.request["offset"] + 10 * i) for p in tasks for i in range(p.pages)]
        got += offsets
        sizes.append(len(offsets))
        at = end
    assert got == [(k, c, o) for k in records.PHASES for c in (0, 1) for o in range(0, 62_500, 10)]
    assert sizes[:4] == [4, 4, 8, 16] and len(sizes) < 20


def many(request):
    return Answer(200, {"X-Total-Count": "62500"}, [])


def ids(request):
    """A service of 10,050 records that are their numbers."""
    there = range(request["offset"], min(request["offset"] + request["limit"], 10_050))
    return Answer(200, {"X-Total-Count": "10050"} if request.get("count") else {}, [(i,) for i in there])


def test_pages_are_dealt_to_a_bounded_number_of_tasks():
    for cap, n in ((None, 10_050), (9_001, 9_001), (7, 7)):
        reader = records.RecordReader({"fetch": "tests.test_streams.ids", "limit": "10"} | ({"cap": str(cap)} if cap else {}))
        tasks = reader.partitions()
        assert len(tasks) <= records.TASKS + 1
        assert [r for t in tasks for r in reader.read(t)] == [(i,) for i in range(n)]


def test_service_looks_at_a_table_in_batches(spark, tmp_path, monkeypatch):
    """A count read the whole table and made lists of all its rows in the driver's process."""
    from acreline.sources import orders_service as service

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    rows = {r.o_orderkey: r for r in orders.filter("o_orderstatus = 'F' AND o_orderdate >= '1996-01-01'").collect()}
    orders.repartition(5).write.parquet(str(tmp_path / "orders.parquet"))  # in no order, several files
    monkeypatch.setattr(service, "ROWS", 64)
    monkeypatch.setattr(service, "_records", None)
    of = {"table": str(tmp_path / "orders.parquet"), "kind": "deed_records", "zip": "29607", "since": "1996-01-01"}
    want = sorted(k for k, r in rows.items() if r.o_custkey % 40 == 7)
    counted = service.fetch({**of, "offset": 0, "limit": 5, "count": True})
    assert counted.headers == {"X-Total-Count": str(len(want))} and [r[0] for r in counted.records] == want[:5]
    monkeypatch.undo()
    got = [r for at in range(0, len(want) + 4, 4) for r in service.fetch({**of, "offset": at, "limit": 4}).records]
    assert [r[0] for r in got] == want
    assert all(r[1:3] == (f"H{r[0]}", "29607") and r[5] is None and r[6] == rows[r[0]].o_totalprice and r[7] == rows[r[0]].o_orderdate for r in got)
