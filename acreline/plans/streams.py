"""Queries of the M family that run as streams: each deals its rows into deliveries, drains the stream and gives what came out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.plans.base import AS_OF, AS_OF_PROPS, Tables
from acreline.plans.catalog import query
from acreline.sources.scratch import folder
from acreline.streaming import keyed, pairs, run
from acreline.streaming.buckets import BucketTable

#: Deliveries of a stream, the last of which is the clock alone.
FILES = 4
#: Days of the log's month in each delivery, and hours by which an event may come late.
LOG_DELIVERY = f"least({FILES - 2}, CAST(floor((unix_seconds(ts) - unix_seconds(timestamp'2024-01-01') + (number % 13) * 3600) / 86400 / 10) AS INT))"
#: The same for records of several years, by up to 40 days.
RECORD_DELIVERY = f"greatest(0, least({FILES - 2}, CAST(floor((datediff({{at}}, date'1995-01-01') + {{id}} % 40) / 800) AS INT)))"


def _with_clock(rows: DataFrame, at: str, time: str, blank: int | None) -> DataFrame:
    """The rows and one that moves the clock to `time` (SQL); it is `blank` elsewhere, or null."""
    clock = rows.sparkSession.range(1).select(*[F.expr(time).alias(c) if c == at else F.lit(blank).cast(kind).alias(c) for c, kind in rows.dtypes])
    return rows.unionByName(clock)


def _stream(t: Tables, rows: DataFrame, at: str, time: str, number: str, name: str, blank: int | None = None) -> DataFrame:
    number = f"CASE WHEN {at} >= {time} THEN {FILES - 1} ELSE {number} END"
    return run.stream_of(run.session(t.spark), _with_clock(rows, at, time, blank), number, FILES, name)


@query("m10_watchdog_stream", f"SELECT rep FROM logs GROUP BY rep HAVING max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE")
def m10(t: Tables) -> DataFrame:
    rows = t.logs.select(F.col("rep").alias("key"), "ts", F.col("event_id").alias("number"))
    told = run.drained(keyed.idle(_stream(t, rows, "ts", f"timestamp'{AS_OF}' + INTERVAL 1 DAY", LOG_DELIVERY, "watchdog")), t.spark, "idle")
    last = told.groupBy(F.col("key").alias("rep")).agg(F.max_by("idle", F.struct("at", "idle")).alias("idle"))
    return last.filter("idle").select("rep")


@query("m18_subscription_stream", """SELECT rep, CASE WHEN arg_max(status, (ts, event_id)) = 'HARD_NO' THEN 'canceled' ELSE lower(arg_max(status, (ts, event_id))) END AS state,
  arg_max(status, (ts, event_id)) <> 'HARD_NO' AS active FROM logs GROUP BY rep""")
def m18(t: Tables) -> DataFrame:
    rows = t.logs.select(F.col("rep").alias("key"), "ts", F.col("event_id").alias("number"), "status")
    told = run.drained(keyed.statuses(_stream(t, rows, "ts", f"timestamp'{AS_OF}' + INTERVAL 2 DAYS", LOG_DELIVERY, "webhooks"), "HARD_NO"), t.spark, "statuses")
    return told.groupBy(F.col("key").alias("rep")).agg(F.max_by(F.struct("state", "active"), F.struct("at", "number")).alias("s")).select("rep", "s.*")


@query("m06_ageing_stream", f"SELECT id FROM props WHERE sale_type = 'MLS' AND sold_date < TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 60 DAY AND address_hash NOT IN (SELECT 'H' || pid FROM logs WHERE status = 'SOLD')")
def m06(t: Tables) -> DataFrame:
    """Listings and deeds come in any order over nine days; a listing of over 60 days goes unless its deed is among them."""
    came = lambda n: F.expr(f"timestamp'{AS_OF_PROPS}' - make_interval(0, 0, 0, CAST(1 + {n} % 9 AS INT))")
    listed = t.props.filter("sale_type = 'MLS' AND sold_date IS NOT NULL").select(F.col("address_hash").alias("key"), "id", F.lit(False).alias("confirms"), F.col("sold_date").alias("at"), came("id").alias("arrived"))
    deeds = t.logs.filter("status = 'SOLD'").select(F.concat(F.lit("H"), "pid").alias("key"), F.col("event_id").alias("id"), F.lit(True).alias("confirms"), came("event_id").alias("at"), came("event_id").alias("arrived"))
    number = f"CAST(2 - least(2, datediff(timestamp'{AS_OF_PROPS}', arrived) div 4) AS INT)"
    rows = _stream(t, listed.unionByName(deeds), "arrived", f"timestamp'{AS_OF_PROPS}' + INTERVAL 10 DAYS", number, "listings")
    return run.drained(keyed.aged_out(rows), t.spark, "aged").select("id")


def _records(t: Tables, rows: DataFrame, id_: str, at: str, name: str) -> DataFrame:
    # a null key would be filtered out before it could move the clock
    return _stream(t, rows, at, "timestamp'2030-01-01'", RECORD_DELIVERY.format(at=at, id=id_), name, -1)


@query("m07_deed_join_stream", """SELECT l.id, d.id AS deed_id FROM props l LEFT JOIN props d ON d.sale_type = 'DEED' AND d.house_number = l.house_number AND d.zip_code = l.zip_code
  AND d.sold_date >= l.sold_date - INTERVAL 45 DAY AND d.sold_date <= l.sold_date + INTERVAL 45 DAY WHERE l.sale_type = 'MLS' AND l.sold_date IS NOT NULL""")
def m07(t: Tables) -> DataFrame:
    """Each listing with the deeds of its address within 45 days, or alone."""
    side = lambda kind, id_, at: t.props.filter(f"sale_type = '{kind}' AND sold_date IS NOT NULL").select(F.col("id").alias(id_), "house_number", "zip_code", F.col("sold_date").alias(at))
    listed, deeds = _records(t, side("MLS", "id", "removed_at"), "id", "removed_at", "listed"), _records(t, side("DEED", "deed_id", "deed_at"), "deed_id", "deed_at", "deeds")
    met = pairs.within(listed, deeds, ["house_number", "zip_code"], ("removed_at", "deed_at"), "45 DAYS", "45 DAYS", ("60 days", "60 days"))
    return run.drained(met, t.spark, "met").filter("id >= 0").select("id", "deed_id")


@query("m14_answers_stream", """WITH answers AS (SELECT l_orderkey AS pid, l_linenumber AS line, l_shipdate AS answered_at FROM lineitem WHERE l_linenumber <= 2)
SELECT id, line, CASE WHEN line IS NULL THEN 'check again' ELSE 'answered' END AS outcome FROM props LEFT JOIN answers ON pid = id AND answered_at >= sold_date AND answered_at <= sold_date + INTERVAL 30 DAY
WHERE status = 'MLS_PENDING' AND sold_date IS NOT NULL""")
def m14(t: Tables) -> DataFrame:
    """Each pending property with the answers of the 30 days after it was asked for, or alone, to be asked again."""
    pending = t.props.filter("status = 'MLS_PENDING' AND sold_date IS NOT NULL").select("id", F.col("id").alias("pid"), F.col("sold_date").alias("asked_at"))
    answers = t.raw("lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("timestamp").alias("answered_at"))
    met = pairs.within(_records(t, pending, "id", "asked_at", "pending"), _records(t, answers, "pid", "answered_at", "answers"), ["pid"], ("asked_at", "answered_at"), "0 DAYS", "30 DAYS", ("60 days", "60 days"))
    return run.drained(met, t.spark, "answered").filter("id >= 0").select("id", "line", F.when(F.col("line").isNull(), "check again").otherwise("answered").alias("outcome"))


def _delivered(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    """The log in three deliveries, a fourth of its events in two of them."""
    again = rows.filter("event_id % 4 = 0").withColumn("delivery", F.expr("CAST(event_id % 3 + 1 AS INT)"))
    both = rows.withColumn("delivery", F.expr("CAST(event_id % 3 AS INT)")).unionByName(again)
    return run.stream_of(run.session(t.spark), both, "delivery", FILES, name).drop("delivery")


def _latest(t: Tables) -> BucketTable:
    """The last event of each address, kept up to date from the log."""
    rows = t.logs.select("address_hash", "ts", "event_id", "status")
    table = BucketTable(t.spark, folder(t.spark, "latest"), rows.schema, ["address_hash"], ["ts", "event_id"])
    run.through(_delivered(t, rows, "log"), t.spark, "latest", table.apply)
    return table


LATEST = "SELECT address_hash, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM logs GROUP BY address_hash"


@query("m09_write_back", f"SELECT address_hash, status, status <> 'HARD_NO' AS route_active FROM ({LATEST}) x")
def m09(t: Tables) -> DataFrame:
    """Properties that were rejected last are written back as inactive."""
    return _latest(t).rows().select("address_hash", "status", (F.col("status") != "HARD_NO").alias("route_active"))


@query("m12_live_view", LATEST)
def m12(t: Tables) -> DataFrame:
    """A view kept from the feed of what each batch changed, not from the table."""
    source = _latest(t)
    rows = source.changes().drop("bucket", "batch", "changed_by")
    view = BucketTable(t.spark, folder(t.spark, "view"), rows.schema, ["address_hash"], ["ts", "event_id"])
    run.through(rows, t.spark, "view", view.apply)
    return view.rows().select("address_hash", "status", "ts")


@query("m13_offline_replay", "SELECT event_id, rep, status, address_hash FROM logs")
def m13(t: Tables) -> DataFrame:
    """A queue that sends some events twice: the first delivery of each stays."""
    rows = t.logs.select("event_id", "rep", "status", "address_hash")
    table = BucketTable(t.spark, folder(t.spark, "queue"), rows.schema, ["event_id"], ["event_id"], keep_first=True)
    run.through(_delivered(t, rows, "offline"), t.spark, "queue", table.apply)
    return table.rows().select("event_id", "rep", "status", "address_hash")


@query("m02_replayed_chunks", "SELECT status, count(*) AS n FROM logs GROUP BY status")
def m02(t: Tables) -> DataFrame:
    """Every chunk is handed over twice under its number; the second time changes nothing."""
    rows = t.logs.select("event_id", "status")
    table = BucketTable(t.spark, folder(t.spark, "chunks"), rows.schema, ["event_id"], ["event_id"], keep_first=True)

    def twice(batch: DataFrame, number: int) -> None:
        table.apply(batch, number)
        table.apply(batch, number)

    run.through(_delivered(t, rows, "chunks"), t.spark, "chunks", twice)
    return table.rows().groupBy("status").agg(F.count("*").alias("n"))
