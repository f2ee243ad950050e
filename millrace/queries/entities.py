"""Entity resolution, extraction, and routed questions."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.temporal import Clock
from ..operators import resolve as R
from ..plans.ir import run as run_plan
from ..plans.ops import registry
from ..plans.router import route
from ..sources.shapes import calendar, table
from .base import query


def _seen(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lower("c_mktsegment"), F.pmod("c_custkey", F.lit(40)).cast("string"), F.lit("@example.com")).alias("address"), F.concat_ws(" ", F.initcap(F.lower("c_mktsegment")), F.concat(F.lit("No"), F.pmod("c_custkey", F.lit(40)).cast("string"))).alias("name"), F.lit(1.0).alias("weight"), F.lit("mail").alias("source"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("noreply"), F.pmod("s_suppkey", F.lit(7)).cast("string"), F.lit("@example.com")).alias("address"), F.concat(F.lit("Building Supplier "), "s_suppkey").alias("name"), F.lit(2.0).alias("weight"), F.lit("calendar").alias("source"))
    return c.unionAll(s)


_SEEN = """seen AS (SELECT lower(c_mktsegment) || (c_custkey % 40) || '@example.com' AS address, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' No' || (c_custkey % 40) AS name, 1.0 AS weight, 'mail' AS source FROM customer
UNION ALL SELECT 'noreply' || (s_suppkey % 7) || '@example.com', 'Building Supplier ' || s_suppkey, 2.0, 'calendar' FROM supplier)"""


@query(f"""WITH {_SEEN}, p AS (SELECT address, count(*) AS n, sum(weight)::DOUBLE AS weight, arg_max(name, lpad(length(name)::VARCHAR, 4, '0') || name) AS name FROM seen GROUP BY address),
m AS (SELECT *, string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM p),
s AS (SELECT *, (CASE WHEN list_contains(w, 'building') THEN 1.0 WHEN len(list_filter(w, lambda h: starts_with(h, 'buil'))) > 0 THEN 0.5 ELSE 0 END + CASE WHEN list_contains(w, 'no12') THEN 1.0 WHEN len(list_filter(w, lambda h: starts_with(h, 'no12'))) > 0 THEN 0.5 ELSE 0 END) / 2 AS match FROM m)
SELECT address, n, round(least(1, 0.75 * match + 0.25 * least(weight, 10) / 10), 6) AS cn FROM s""")
def e1_resolve_person(spark: SparkSession, d: str) -> DataFrame:
    return R.people(_seen(spark, d), "building no12").select("address", "n", "cn")


@query("""SELECT user_id AS conversation, event_id AS ref, round(1 / (1 + (1706659200000000 - epoch_us(ts)) / 60000000.0 / 30) - 0.02 * (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1), 6) AS score FROM events WHERE event_type = 'view'""")
def e2_resolve_reference(spark: SparkSession, d: str) -> DataFrame:
    e = calendar(spark, d).select(F.col("calendar_id").alias("conversation"), F.col("event_id").alias("ref"), F.col("title").alias("kind"), F.col("starts_us").alias("seen_us"))
    return R.references(e, 1_706_659_200_000_000, "view").select("conversation", "ref", "score")


@query("SELECT label, CASE WHEN count(*) = 1 THEN 'confident' WHEN count(*) = 0 THEN 'absent' ELSE 'ambiguous' END AS verdict, count(*) AS n FROM (SELECT p_brand AS label FROM part WHERE p_type ILIKE '%a%' OR p_size = 7) GROUP BY label")
def e3_label_verdict(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "part").where(F.col("p_type").ilike("%a%") | (F.col("p_size") == 7)).groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n"))
    return hits.select("label", F.when(F.col("n") == 1, "confident").otherwise("ambiguous").alias("verdict"), "n")


@query("SELECT DISTINCT kind, ref FROM (SELECT 'event' AS kind, event_type AS ref FROM events UNION ALL SELECT 'person', role FROM conversations UNION ALL SELECT 'file', source FROM documents)")
def e4_entities_of_results(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, kind, c: table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(c).alias("ref")).distinct()
    return one("events", "event", "event_type").unionAll(one("conversations", "person", "role")).unionAll(one("documents", "file", "source"))


@query("SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%7%' OR s_suppkey::VARCHAR ILIKE '%12%'")
def e5_loose_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where(F.col("s_name").ilike("%7%") | F.col("s_suppkey").cast("string").ilike("%12%")).select("s_suppkey")


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """One invented booking letter an order, so that every rule has something to find."""
    o = table(spark, d, "orders")
    text = F.concat(F.lit("Your booking QX"), F.lpad(F.pmod("o_orderkey", F.lit(9999)).cast("string"), 4, "0"), F.lit(" flies on TK 0"), F.pmod("o_orderkey", F.lit(900)).cast("string"), F.lit(" IST-JFK at 9 AM. Order no. A-"), "o_orderkey", F.lit(" total EUR "), F.format_number("o_totalprice", 2), F.lit("."))
    return o.select("o_orderkey", text.alias("t"))


@query("SELECT o_orderkey, 'QX' || lpad((o_orderkey % 9999)::VARCHAR, 4, '0') AS booking, CASE WHEN o_orderkey % 900 = 0 THEN '' ELSE 'TK' || (o_orderkey % 900) END AS flights FROM orders")
def x1_booking_and_flights(spark: SparkSession, d: str) -> DataFrame:
    return X.cue_rules(_letters(spark, d), "o_orderkey", "t").select("o_orderkey", "booking", F.array_join("flights", ",").alias("flights"))


@query("SELECT o_orderkey, 'EUR' AS currency, round(o_totalprice, 2) AS value, 'A-' || o_orderkey AS number, 'IST' AS origin, 'JFK' AS destination FROM orders")
def x5_amount_order_route(spark: SparkSession, d: str) -> DataFrame:
    t = _letters(spark, d).select("o_orderkey", F.get(X.amounts(F.col("t")), F.lit(0)).alias("a"), X.order_number(F.col("t")).alias("number"), X.route(F.col("t")).alias("r"))
    return t.select("o_orderkey", "a.currency", "a.value", "number", "r.origin", "r.destination")


def _tickets(spark: SparkSession, d: str) -> DataFrame:
    """Further invented letters: tickets, help desks, airports in brackets and dates in three forms."""
    n = F.col("o_orderkey").cast("string")
    long = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("235 "), F.lpad(n, 10, "0"))).otherwise(F.concat(F.lit("your e-ticket has no. "), F.lpad(n, 7, "0")))
    desk = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Questions? Write to Max@Desk.example.com")).otherwise(F.lit("a@b.example.com or Support@air.example.com"))
    text = F.concat(long, F.lit(". Istanbul (IST) to New York (JFK) on 5 Ağustos 2024, back 09.10.2024 or 2024-02-31. "), desk, F.lit(". Case ZX-"), n)
    return table(spark, d, "orders").select("o_orderkey", text.alias("t"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '235' || lpad(o_orderkey::VARCHAR, 10, '0') ELSE lpad(o_orderkey::VARCHAR, 7, '0') END AS ticket, CASE WHEN o_orderkey % 3 = 0 THEN 'max@desk.example.com' ELSE 'support@air.example.com' END AS support,
'IST' AS origin, '2024-08-05,2024-10-09' AS dates, 'case:ZX-' || o_orderkey AS codes, 'order' AS missing, true AS distinctive FROM orders""")
def x7_ticket_support_dates_codes(spark: SparkSession, d: str) -> DataFrame:
    t = _tickets(spark, d)
    c = F.col("t")
    t = t.select("o_orderkey", X.extracted(c).alias("x"), F.array_join(X.dates(c), ",").alias("dates"), X.alias_codes(c, {"case": r"ZX-\d+", "visa": r"V\d{9}"}).alias("codes"), X.distinctive(c).alias("distinctive"))
    return t.select("o_orderkey", "x.ticket", "x.support", "x.origin", "dates", F.array_join(F.transform("codes", lambda k: F.concat(k["alias"], F.lit(":"), k["code"])), ",").alias("codes"), F.array_join("x.missing", ",").alias("missing"), "distinctive")


@query("SELECT event_id, title FROM calendar WHERE status IS DISTINCT FROM 'cancelled' AND starts_us >= 1705363200000000 AND starts_us < 1705449600000000 ORDER BY starts_us, event_id LIMIT 50")
def g10_routed_question(spark: SparkSession, d: str) -> DataFrame:
    found = route("What's on my calendar tomorrow?", Clock(datetime(2024, 1, 15, 9, tzinfo=UTC)))
    if found is None:
        raise ValueError("no shape fits")
    return run_plan(found[1], registry(spark, d))[0]["a"].select("event_id", "title")
