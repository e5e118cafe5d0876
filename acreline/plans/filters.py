"""Queries of the C family: predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.functions import geo
from acreline.operators import filters
from acreline.plans.base import AS_OF, AS_OF_PROPS, Tables
from acreline.plans.catalog import query

POLYGON = [(34.52, -82.63), (34.66, -82.60), (34.68, -82.50), (34.58, -82.47), (34.55, -82.55)]
BOX = (34.52, 34.62, -82.60, -82.50)
ACTIVE = "route_active AND lat IS NOT NULL AND lng IS NOT NULL AND coalesce(status, '') <> 'REJECTED' AND coalesce(confidence, '') <> 'REJECTED'"


def simple(name: str, predicate: str, table: str = "props", columns: str = "id", spark: str | None = None) -> None:
    """A query whose predicate reads alike in both dialects."""

    @query(name, f"SELECT {columns} FROM {table} WHERE {predicate}")
    def run(t: Tables) -> DataFrame:
        return getattr(t, table).filter(spark or predicate).selectExpr(*[c.strip() for c in columns.split(",")])


@query("c01_candidates", f"SELECT id, zip_code, price FROM props WHERE {ACTIVE} AND owner_id = 7 AND zip_code IN ('29607', '29617') AND (sold_date IS NULL OR sold_date >= TIMESTAMP '1998-01-01')")
def c01(t: Tables) -> DataFrame:
    return filters.candidates(t.props, 7, ["29607", "29617"], "1998-01-01").select("id", "zip_code", "price")


@query("c01_candidates_box", f"SELECT id FROM props WHERE {ACTIVE} AND lat BETWEEN 34.52 AND 34.62 AND lng BETWEEN -82.60 AND -82.50")
def c01b(t: Tables) -> DataFrame:
    return filters.candidates(t.props, box=BOX).select("id")


SOLD_SQL = """sold_date IS NOT NULL AND NOT (CASE WHEN state IN ('TX', 'UT') THEN coalesce(price > 0 AND price < 1000, false)
  ELSE coalesce(price < 30000, false) OR coalesce(assessed > 0 AND price < assessed * 0.25, false) OR coalesce(assessed < 25000, false) END)
  AND NOT coalesce(property_type IN ('Commercial', 'Industrial', 'Vacant Land', 'Agricultural'), false)"""


@query("c03_valid_sales", f"SELECT id, state FROM props WHERE {SOLD_SQL}")
def c03(t: Tables) -> DataFrame:
    return t.props.filter(filters.valid_sale(*map(F.col, ("price", "assessed", "state", "property_type", "sold_date")))).select("id", "state")


@query(
    "c04_rejection_reasons",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN sold_date IS NULL THEN 'no_sale_date' WHEN price < 10000 THEN 'price_too_low'
  WHEN assessed > 0 AND price < assessed * 0.15 THEN 'below_assessed' WHEN property_type IN ('Commercial', 'Industrial', 'Vacant Land', 'Agricultural') THEN 'bad_type' END AS reason FROM props) GROUP BY reason""",
)
def c04(t: Tables) -> DataFrame:
    return t.props.groupBy(filters.rejection_reason(*map(F.col, ("price", "assessed", "property_type", "sold_date"))).alias("reason")).agg(F.count("*").alias("n"))


@query("c05_month_window", f"SELECT id FROM props WHERE sold_date BETWEEN TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 12 MONTH AND TIMESTAMP '{AS_OF_PROPS}'")
def c05(t: Tables) -> DataFrame:
    now = F.lit(AS_OF_PROPS).cast("timestamp")
    return t.props.filter(F.col("sold_date").between(F.add_months(now, -12).cast("timestamp"), now)).select("id")


@query("c06_removed_30_days", f"SELECT id FROM listings WHERE removed >= TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 30 DAY")
def c06(t: Tables) -> DataFrame:
    return t.listings.filter(F.col("removed") >= F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 30 DAYS")).select("id")


simple("c08_stream_validity", "CASE WHEN sale_type = 'MLS' THEN sold_date IS NOT NULL ELSE sold_date IS NOT NULL AND price > 100 END AND coalesce(property_type, '') NOT IN ('Commercial', 'Industrial', 'Vacant Land', 'Agricultural')")
simple("c09_verified_only", "confidence IN ('verified', 'high')")
simple("c10_placed", "(abs(lat) >= 1e-4 OR abs(lng) >= 1e-4) AND NOT isnan(lat) AND NOT isnan(lng)")


@query("c11_territory_or_on_route", "SELECT id FROM props WHERE zip_code IN ('29601', '29602') OR address_hash IN (SELECT address_hash FROM stops)")
def c11(t: Tables) -> DataFrame:
    assigned = t.stops.select("address_hash").distinct().withColumn("on_route", F.lit(True))
    return t.props.join(assigned, "address_hash", "left").filter(F.col("zip_code").isin("29601", "29602") | F.col("on_route").isNotNull()).select("id")


@query("c12_geographic_stage", f"""WITH edges AS (SELECT * FROM (VALUES {", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True))}) e(la, na, lb, nb))
SELECT id FROM props, edges WHERE (la > lat) <> (lb > lat) AND lng < (nb - na) * (lat - la) / (lb - la) + na GROUP BY id HAVING count(*) % 2 = 1""")
def c12(t: Tables) -> DataFrame:
    near = geo.in_bounds(F.col("lat"), F.col("lng"), geo.bounds(POLYGON))
    return t.props.filter(near & geo.in_polygon(F.col("lat"), F.col("lng"), POLYGON)).select("id")


@query("c13_unassigned", "SELECT id FROM props WHERE address_hash NOT IN (SELECT address_hash FROM stops)")
def c13(t: Tables) -> DataFrame:
    return t.props.join(t.stops.select("address_hash").distinct(), "address_hash", "left_anti").select("id")


@query("c14_sold_date_stage", f"SELECT id FROM props WHERE CASE WHEN status = 'MLS_PENDING' THEN true WHEN sold_date IS NULL THEN address_hash IN (SELECT address_hash FROM logs) ELSE sold_date >= TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 12 MONTH END")
def c14(t: Tables) -> DataFrame:
    touched = t.logs.select("address_hash").distinct().withColumn("touched", F.lit(True))
    cut = F.add_months(F.lit(AS_OF_PROPS).cast("timestamp"), -12)
    keep = F.when(F.col("status") == "MLS_PENDING", True).when(F.col("sold_date").isNull(), F.col("touched").isNotNull()).otherwise(F.col("sold_date") >= cut)
    return t.props.join(touched, "address_hash", "left").filter(keep).select("id")


simple("c15_types_included", "property_type IS NULL OR property_type IN ('Single Family', 'Townhouse')")
simple("c16_types_excluded", "property_type IS NULL OR NOT (lower(property_type) LIKE '%commercial%' OR lower(property_type) LIKE '%condo%' OR lower(property_type) LIKE '%land%')")
simple("c17_single_family", "property_type IS NULL OR lower(property_type) LIKE '%single%'")
simple("c18_rejected_inactive", "status <> 'REJECTED' AND confidence <> 'REJECTED' AND route_active IS NOT DISTINCT FROM true")
simple("c19_stale_mls", f"NOT (sale_type = 'MLS' AND coalesce(sold_date < TIMESTAMP '{AS_OF_PROPS}' - INTERVAL '30' DAY, true))")
simple("c20_mls_verified", "sale_type <> 'MLS' OR status IN ('SOLD', 'ELIGIBLE') OR confidence IN ('high', 'verified')")
simple("c21_confident", "confidence <> 'low'")


@query("c22_not_knocked", "SELECT id FROM props WHERE address_hash NOT IN (SELECT address_hash FROM logs) OR address_hash IN (SELECT address_hash FROM logs GROUP BY 1 HAVING arg_max(status, (ts, event_id)) = 'CALLBACK')")
def c22(t: Tables) -> DataFrame:
    last = t.logs.groupBy("address_hash").agg(F.max_by("status", F.struct("ts", "event_id")).alias("last"))
    return t.props.join(last, "address_hash", "left").filter("last IS NULL OR last = 'CALLBACK'").select("id")


simple("c23_price_year", "coalesce(price BETWEEN 100000 AND 300000, true) AND coalesce(year_built >= 1970, true)")


@query("c24_no_callbacks", "SELECT id FROM props WHERE address_hash NOT IN (SELECT address_hash FROM logs WHERE status = 'CALLBACK')")
def c24(t: Tables) -> DataFrame:
    return t.props.join(t.logs.filter("status = 'CALLBACK'").select("address_hash").distinct(), "address_hash", "left_anti").select("id")


simple("c25_not_terminal", "status NOT IN ('HARD_NO', 'SOLD', 'DO_NOT_KNOCK')", "logs", "event_id")
simple("c26_explorer", f"coalesce(price, 0) BETWEEN 50000 AND 400000 AND coalesce(sold_date >= TIMESTAMP '{AS_OF_PROPS}' - INTERVAL '730' DAY, true)")
simple("c27_campaign", f"status IN ('SOLD', 'HEURISTIC_SOLD') AND price > 0 AND price <= 350000 AND sold_date BETWEEN TIMESTAMP '{AS_OF_PROPS}' - INTERVAL '1825' DAY AND TIMESTAMP '{AS_OF_PROPS}' - INTERVAL '730' DAY")
simple("c28_rep_list", f"lower(street_name) LIKE '%maple 1%' AND sold_date >= TIMESTAMP '{AS_OF_PROPS}' - INTERVAL '365' DAY")


@query("c29_appointments", """SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN 'today' WHEN CAST(ts AS DATE) = DATE '2024-01-16' THEN 'tomorrow'
  WHEN ts > TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00' THEN 'this_week' WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'past' ELSE 'upcoming' END AS bucket FROM logs WHERE status = 'QUALIFIED'""")
def c29(t: Tables) -> DataFrame:
    day = F.to_date("ts")
    bucket = (
        F.when(day == "2024-01-15", "today").when(day == "2024-01-16", "tomorrow").when((F.col("ts") > "2024-01-15 00:00:00") & (F.col("ts") < "2024-01-22 00:00:00"), "this_week")
        .when(F.col("ts") < "2024-01-15 00:00:00", "past").otherwise("upcoming")
    )
    return t.logs.filter("status = 'QUALIFIED'").select("event_id", bucket.alias("bucket"))


@query("c30_analytics_window", f"SELECT l.event_id FROM logs l JOIN members m ON l.rep = m.member_id WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND industry = 'BUILDING'")
def c30(t: Tables) -> DataFrame:
    recent = t.logs.filter(F.col("ts") > F.expr(f"timestamp'{AS_OF}' - INTERVAL 7 DAYS"))
    return recent.join(t.members.filter("industry = 'BUILDING'"), F.col("rep") == F.col("member_id"), "left_semi").select("event_id")


simple("c31_period", f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY", "logs", "event_id")
simple("c32_search", "lower(street_name) LIKE '%maple 12%' OR lower(city) LIKE '%city3%' OR zip_code LIKE '%29605%'")


@query("c33_stale_reasons", f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN sale_type <> 'MLS' THEN 'not_mls' WHEN status = 'SOLD' THEN 'sold' WHEN confidence = 'verified' THEN 'verified'
  WHEN sold_date IS NULL THEN 'undated' WHEN sold_date >= TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 30 DAY THEN 'fresh' WHEN NOT route_active THEN 'inactive' ELSE 'stale' END AS reason FROM props) GROUP BY reason""")
def c33(t: Tables) -> DataFrame:
    reason = (
        F.when(F.col("sale_type") != "MLS", "not_mls").when(F.col("status") == "SOLD", "sold").when(F.col("confidence") == "verified", "verified").when(F.col("sold_date").isNull(), "undated")
        .when(F.col("sold_date") >= F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 30 DAYS"), "fresh").when(~F.col("route_active"), "inactive").otherwise("stale")
    )
    return t.props.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


simple("c34_unverified", "sale_type = 'MLS' AND confidence NOT IN ('verified', 'high') AND status <> 'SOLD'")
simple("c35_cleanup", f"status IN ('MLS_PENDING', 'REJECTED') AND coalesce(sold_date < TIMESTAMP '{AS_OF_PROPS}' - INTERVAL '30' DAY, true)", columns="id, status")
simple("c36_like", "zip_code LIKE '2960%' OR city ILIKE '%CITY1%'")
simple("c37_zip_format", "length(zip_code) = 5 AND zip_code LIKE '2963%'", columns="id, zip_code")
simple("c38_min_score", "value >= 60", "logs", "event_id, value")

@query("c40_route_sold", f"SELECT s.route_id, s.pos FROM stops s JOIN props p ON s.address_hash = p.address_hash WHERE p.status = 'SOLD' OR p.sold_date >= TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 90 DAY")
def c40(t: Tables) -> DataFrame:
    kept = t.props.filter((F.col("status") == "SOLD") | (F.col("sold_date") >= F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 90 DAYS"))).select("address_hash")
    return t.stops.join(kept, "address_hash").select("route_id", "pos")


@query("c41_snapshot_eligible", "SELECT id FROM props WHERE lat IS NOT NULL AND address_hash NOT IN (SELECT address_hash FROM logs WHERE status IN ('HARD_NO', 'SOLD'))")
def c41(t: Tables) -> DataFrame:
    gone = t.logs.filter(F.col("status").isin(*filters.TERMINAL)).select("address_hash").distinct()
    return t.props.filter("lat IS NOT NULL").join(gone, "address_hash", "left_anti").select("id")


@query("c42_invite_code", "SELECT member_id FROM members WHERE upper('Rep17@Example.com') = upper(email) AND member_status = 'active' ORDER BY member_id DESC LIMIT 1")
def c42(t: Tables) -> DataFrame:
    return t.members.filter((F.upper("email") == "REP17@EXAMPLE.COM") & (F.col("member_status") == "active")).orderBy(F.desc("member_id")).limit(1).select("member_id")


@query("c43_new_zips", "SELECT DISTINCT zip_code FROM props WHERE regexp_matches(zip_code, '^[0-9]{5}$') AND zip_code NOT IN ('29600', '29601', '29602')")
def c43(t: Tables) -> DataFrame:
    return t.props.filter(F.col("zip_code").rlike(r"^\d{5}$") & ~F.col("zip_code").isin("29600", "29601", "29602")).select("zip_code").distinct()
