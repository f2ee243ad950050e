"""Plans run end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ir import Plan
from ..plans.ir import run as run_plan
from ..plans.ops import registry
from .base import query


@query("""WITH a AS (SELECT message_id, thread_id FROM messages WHERE from_email = 'system@example.com' ORDER BY sent_us DESC, message_id LIMIT 10) SELECT message_id, position FROM messages WHERE thread_id = (SELECT thread_id FROM a ORDER BY thread_id DESC LIMIT 1) ORDER BY sent_us DESC, message_id LIMIT 20""")
def g5_plan_scalar_reference(spark: SparkSession, d: str) -> DataFrame:
    plan = Plan.of({"steps": [{"id": "first", "op": "mail.search", "args": {"from_email": "system@example.com", "limit": 10}}, {"id": "rest", "op": "mail.search", "args": {"thread_id": "{{first.thread_id}}", "limit": 20}, "depends_on": ["first"]}]})
    return run_plan(plan, registry(spark, d))[0]["rest"].select("message_id", "position")


@query("""WITH a AS (SELECT event_id, k FROM calendar WHERE status = 'confirmed' AND calendar_id = 8 ORDER BY starts_us, event_id LIMIT 30) SELECT event_id FROM calendar WHERE event_id IN (SELECT event_id FROM a) AND starts_us < 1705276800000000 ORDER BY starts_us, event_id LIMIT 25""")
def g4_plan_star_reference(spark: SparkSession, d: str) -> DataFrame:
    plan = Plan.of({"steps": [
        {"id": "mine", "op": "calendar.search", "args": {"status": "confirmed", "calendar_id": 8, "limit": 30}},
        {"id": "early", "op": "calendar.search", "args": {"ids": "{{mine.refs[*]}}", "until": 1_705_276_800_000_000, "limit": 25}, "depends_on": ["mine"], "gate": {"step": "mine", "test": "count_gt", "value": 3}},
    ]})
    return run_plan(plan, registry(spark, d))[0]["early"].select("event_id")


@query("SELECT id, outcome FROM (VALUES ('a', 'ok'), ('b', 'skipped: gate'), ('c', 'skipped: dependency'), ('d', 'ok')) t(id, outcome)")
def g6_plan_outcomes(spark: SparkSession, d: str) -> DataFrame:
    plan = Plan.of({"steps": [
        {"id": "a", "op": "drive.search", "args": {"folder_prefix": "/none"}},
        {"id": "b", "op": "drive.search", "args": {}, "depends_on": ["a"], "gate": {"step": "a", "test": "exists"}},
        {"id": "c", "op": "drive.search", "args": {}, "depends_on": ["b"]},
        {"id": "d", "op": "calendar.find_conflicts", "args": {"title": "purchase", "against": "error"}},
    ]})
    _, outcome = run_plan(plan, registry(spark, d))
    return spark.createDataFrame(sorted(outcome.items()), "id string, outcome string").select("id", F.col("outcome"))
