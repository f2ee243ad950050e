"""Aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.shapes import calendar, messages, micros, table
from .base import query

NOW = 1_706_745_600_000_000


@query("SELECT k.t AS title, count(e.event_id) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error'), ('refund')) k(t) LEFT JOIN events e ON e.event_type = k.t GROUP BY k.t")
def a1_counts_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(x,) for x in ("click", "view", "purchase", "signup", "error", "refund")], "title string")
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("title")).agg(F.count("*").alias("n"))
    return known.join(n, "title", "left").select("title", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT count(*) AS n FROM calendar WHERE status = 'confirmed'")
def a2_count_after_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return calendar(spark, d).where("status = 'confirmed'").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def a4_counts_by_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def a5_percentile_disc(spark: SparkSession, d: str) -> DataFrame:
    return M.percentiles(table(spark, d, "events"), "event_type", "value", 0.5, 0.95, 0.99)


@query(f"SELECT event_type, count(*) AS n, max({NOW} - epoch_us(ts)) AS worst, round(avg(({NOW} - epoch_us(ts)) / 1e6), 3) AS mean_s, count(*) FILTER ({NOW} - epoch_us(ts) > 900000000) AS late FROM events GROUP BY event_type")
def a6_freshness(spark: SparkSession, d: str) -> DataFrame:
    lag = F.lit(NOW) - micros("ts")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max(lag).alias("worst"), F.round(F.avg(lag / 1e6), 3).alias("mean_s"), F.count(F.when(lag > 900_000_000, 1)).alias("late"))


@query("SELECT max(value) AS worst, epoch_us(min(ts) FILTER (event_type = 'error')) AS first_failed, count(*) FILTER (event_type = 'error') AS failed FROM events")
def a8_overall(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").agg(F.max("value").alias("worst"), micros(F.min(F.when(bad, F.col("ts")))).alias("first_failed"), F.count(F.when(bad, 1)).alias("failed"))


@query("SELECT c.c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next FROM customer c LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c.c_custkey")
def a9_next_number(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("m"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", (F.coalesce("m", F.lit(0)) + 1).alias("next"))


@query("SELECT DISTINCT split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages")
def a10_distinct_part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host")).distinct()


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id")
def a11_counts_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count(F.when(F.col("role") == "user", 1)).alias("asked"))


@query("""WITH p AS (SELECT user_id, count(*) AS n, round(sum(value), 4) AS weight, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, arg_max(event_type, length(event_type) * 1000000 - event_id) AS longest FROM events GROUP BY user_id)
SELECT user_id, n, weight, kinds, longest, round(least(1, 0.75 + 0.25 * least(weight / 100, 10) / 10), 6) AS cn FROM p""")
def a12_person_evidence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("weight"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.max_by("event_type", F.length("event_type") * 1_000_000 - F.col("event_id")).alias("longest")
    )
    return p.withColumn("cn", F.round(F.least(F.lit(1.0), 0.75 + 0.25 * F.least(F.col("weight") / 100, F.lit(10.0)) / 10), 6))


@query("SELECT conv_id, sum(length(text)) AS tokens, arg_max(role, turn) AS last, count(DISTINCT role) AS models FROM conversations GROUP BY conv_id")
def a13_usage_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("tokens"), F.max_by("role", "turn").alias("last"), F.count_distinct("role").alias("models"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) FILTER (l_linestatus = 'F') AS last_ok FROM lineitem GROUP BY l_suppkey")
def a14_ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("l_linestatus") == "F"
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("cost"), F.max_by("l_returnflag", F.when(ok, F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("last_ok"))


@query("SELECT t, model, count(*) AS n FROM (SELECT 'vectors' AS t, 'm' || label AS model FROM embeddings UNION ALL SELECT 'documents', lang FROM documents) WHERE model IS NOT NULL GROUP BY ALL")
def a15_model_survey(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "embeddings").select(F.lit("vectors").alias("t"), F.concat(F.lit("m"), "label").alias("model"))
    b = table(spark, d, "documents").select(F.lit("documents").alias("t"), F.col("lang").alias("model"))
    return a.unionAll(b).where("model IS NOT NULL").groupBy("t", "model").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def a16_pool_moments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 4).alias("variance"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("""WITH t AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT source, array_to_string(list_distinct_ordered, ',') AS langs FROM
(SELECT source, list(lang ORDER BY first) AS list_distinct_ordered FROM (SELECT source, lang, min(r) AS first FROM t WHERE r <= 3 GROUP BY source, lang) GROUP BY source)""")
def a17_rollup_of_top3(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    t = table(spark, d, "documents").select("source", "lang", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("r")).where("r <= 3")
    langs = F.transform(F.array_sort(F.collect_list(F.struct("r", "lang"))), lambda x: x["lang"])
    return t.groupBy("source").agg(F.array_join(F.array_distinct(langs), ",").alias("langs"))


@query("""WITH c AS (SELECT count(*) FILTER (q = 1 AND g = 1) AS tp, count(*) FILTER (q <> 1 AND g = 1) AS fp, count(*) FILTER (q = 1 AND g <> 1) AS fn, count(*) FILTER (q <> 1 AND g <> 1) AS tn FROM (SELECT quality AS q, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS g FROM labels JOIN documents USING (doc_id)))
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def a18_confusion(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 400).cast("int").alias("guess"))
    return M.confusion(table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id"), "quality", "guess")


@query("SELECT event_type, count(*) FILTER (value < 30) AS hits, count(*) FILTER (value >= 30) AS misses, round(count(*) FILTER (value < 30) / count(*), 6) AS rate FROM events GROUP BY event_type")
def a21_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    hit = F.count(F.when(F.col("value") < 30, 1))
    miss = F.count(F.when(F.col("value") >= 30, 1))
    return table(spark, d, "events").groupBy("event_type").agg(hit.alias("hits"), miss.alias("misses"), F.round(M.share(hit, hit + miss), 6).alias("rate"))


@query("SELECT sum(u * n)::BIGINT AS units FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) JOIN (VALUES ('click', 5), ('view', 1), ('purchase', 50), ('error', 100)) q(event_type, u) USING (event_type)")
def a24_quota_units(spark: SparkSession, d: str) -> DataFrame:
    units = spark.createDataFrame([("click", 5), ("view", 1), ("purchase", 50), ("error", 100)], "event_type string, u int")
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.join(units, "event_type").agg(F.sum(F.col("u") * F.col("n")).alias("units"))


@query("""WITH s AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS got FROM conversations GROUP BY conv_id)
SELECT round(avg(CASE WHEN got = ['assistant', 'user'] THEN 1.0 ELSE 0 END), 6) AS exact, round(sum(len(list_intersect(got, ['assistant', 'user']))) / sum(len(got)), 6) AS precision, round(sum(len(list_intersect(got, ['assistant', 'user']))) / (2 * count(*)), 6) AS recall FROM s""")
def a25_set_equality(spark: SparkSession, d: str) -> DataFrame:
    want = F.array(F.lit("assistant"), F.lit("user"))
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("got"))
    both = F.sum(F.size(F.array_intersect("got", want)))
    return s.agg(F.round(F.avg((F.col("got") == want).cast("double")), 6).alias("exact"), F.round(both / F.sum(F.size("got")), 6).alias("precision"), F.round(both / (2 * F.count("*")), 6).alias("recall"))


@query("SELECT thread_id, string_agg(position || ': ' || substr(body, 1, 20), chr(10) ORDER BY position) AS body FROM messages GROUP BY thread_id")
def e6_stitch_chunks(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).select("thread_id", "position", F.concat("position", F.lit(": "), F.substring("body", 1, 20)).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "t"))), lambda x: x["t"])
    return m.groupBy("thread_id").agg(F.array_join(parts, "\n").alias("body"))


@query("SELECT title, count(*) AS n, min(starts_us) AS first, 'upcoming: ' || count(*) || ' ' || title AS line FROM calendar WHERE starts_us >= 1706140800000000 GROUP BY title")
def p1_count_answer(spark: SparkSession, d: str) -> DataFrame:
    c = calendar(spark, d).where("starts_us >= 1706140800000000").groupBy("title").agg(F.count("*").alias("n"), F.min("starts_us").alias("first"))
    return c.withColumn("line", F.format_string("upcoming: %d %s", "n", "title"))


@query("SELECT event_type, 'millrace_events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def s19_metrics_text(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", F.format_string('millrace_events_total{type="%s"} %d', "event_type", "n").alias("line"))


@query("""WITH p AS (SELECT o_orderstatus AS t, CASE WHEN o_totalprice < 100000 THEN 'F' WHEN o_totalprice < 200000 THEN 'O' WHEN o_orderkey % 7 = 0 THEN 'X' ELSE 'P' END AS g FROM orders),
l AS (SELECT t AS label FROM p UNION SELECT g FROM p), c AS (SELECT label, count(*) FILTER (t = label AND g = label) AS tp, count(*) FILTER (t <> label AND g = label) AS fp, count(*) FILTER (t = label AND g <> label) AS fn FROM l, p GROUP BY label),
u AS (SELECT 'micro' AS label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (SELECT * FROM c UNION ALL SELECT * FROM u)),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM s)
SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f
UNION ALL SELECT 'macro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6) FROM f WHERE label <> 'micro'""")
def a18_classes(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a guess at an order's status by its price, for each status, their mean and all together."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    guess = F.when(price < 100000, "F").when(price < 200000, "O").when(key % 7 == 0, "X").otherwise("P")
    return M.class_scores(table(spark, d, "orders").select("o_orderstatus", guess.alias("guess")), "o_orderstatus", "guess")
