"""Upserts, pruning and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import rules as R
from ..sources.scratch import scratch, stored
from ..sources.shapes import at, calendar, table
from ..streaming import keyed
from .base import ORACLES, query

NOW = 1_706_659_200_000_000  # 2024-01-31, after the last event
_DOCS = "SELECT doc_id AS id, md5(text) AS hash, n_chars AS size, CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 END AS vec FROM documents WHERE doc_id % 5 <> 0"
_BATCH = "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE 'new' END AS hash, n_chars + 1 AS size, CASE WHEN doc_id % 7 = 0 THEN -doc_id END AS vec FROM documents WHERE doc_id % 4 = 0"


def _upsert_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "n_chars")
    old = t.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), F.col("n_chars").alias("size"), F.expr("CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 END").alias("vec"))
    new = t.where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id % 3 = 0 THEN h ELSE 'new' END").alias("hash"), (F.col("n_chars") + 1).alias("size"), F.expr("CASE WHEN doc_id % 7 = 0 THEN -doc_id END").alias("vec"))
    return old, new


@query(f"WITH t AS ({_DOCS}), s AS ({_BATCH}) SELECT coalesce(s.id, t.id) AS id, CASE WHEN s.id IS NULL THEN t.hash ELSE s.hash END AS hash, CASE WHEN s.id IS NULL THEN t.size ELSE s.size END AS size, CASE WHEN s.id IS NULL THEN t.vec WHEN s.hash IS NOT DISTINCT FROM t.hash THEN coalesce(s.vec, t.vec) ELSE s.vec END AS vec FROM t FULL JOIN s ON s.id = t.id")
def m1_upsert(spark: SparkSession, d: str) -> DataFrame:
    return L.upsert(*_upsert_input(spark, d), ["id"], "hash", "vec")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def m3_delete_by_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN (SELECT conv_id, count(*) // 2 AS keep FROM conversations GROUP BY conv_id) k USING (conv_id) WHERE c.turn < k.keep")
def m4_delete_extra_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn")
    keep = stored(c.groupBy("conv_id").agg(F.floor(F.count("*") / 2).alias("keep")), "keep")
    return c.join(keep, "conv_id").where("turn < keep").drop("keep")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY event_type")
def m5_prune(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("ts") >= at("2024-01-16")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN NULL ELSE props END AS result FROM events")
def m8_null_old_results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.when(F.col("ts") >= at("2024-01-10"), F.col("props")).alias("result"))


@query("""WITH t AS (SELECT user_id AS id, max(event_type) AS label, max(epoch_us(ts)) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id), s AS (SELECT user_id AS id, max(event_type) FILTER (event_type > 'p') AS label, max(epoch_us(ts)) AS seen FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND user_id % 2 = 0 GROUP BY user_id)
SELECT coalesce(t.id, s.id) AS id, coalesce(s.label, t.label) AS label, greatest(t.seen, s.seen) AS seen FROM t FULL JOIN s ON s.id = t.id""")
def m9_mru_upsert(spark: SparkSession, d: str) -> DataFrame:
    return L.merge_latest(*_mru_input(spark, d), ["id"], "seen")


def _mru_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = calendar(spark, d).select(F.col("calendar_id").alias("id"), F.col("title").alias("label"), F.col("starts_us").alias("seen"))
    old = e.where("seen < 1705276800000000").groupBy("id").agg(F.max("label").alias("label"), F.max("seen").alias("seen"))
    new = e.where("seen >= 1705190400000000 AND id % 2 = 0").groupBy("id").agg(F.max(F.when(F.col("label") > "p", F.col("label"))).alias("label"), F.max("seen").alias("seen"))
    return old, new


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'P' ELSE 'X' END END AS dest, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS expected FROM orders),
r AS (SELECT *, CASE WHEN dest IS NULL THEN 'kept' WHEN (status, dest) IN (('O', 'P'), ('O', 'F'), ('P', 'F'), ('P', 'X')) AND expected = status THEN 'moved' WHEN expected <> status THEN 'stale' ELSE 'refused' END AS result FROM m)
SELECT id, CASE WHEN result = 'moved' THEN dest ELSE status END AS status, result FROM r""")
def m10_transitions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    moves = o.where("id % 4 <> 0").select("id", F.expr("CASE WHEN id % 5 = 0 THEN 'P' ELSE status END").alias("expected"), F.expr("CASE id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'P' ELSE 'X' END").alias("to"))
    allowed = spark.createDataFrame([("O", "P"), ("O", "F"), ("P", "F"), ("P", "X")], "status string, to string")
    return L.transition(o, moves, allowed)


@query("SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P')")
def m11_in_flight_dedupe(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.where("o_orderstatus = 'O'").join(o.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC) > 1 THEN 'superseded' ELSE o_orderstatus END AS status FROM orders")
def m12_supersede(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status")
    return L.supersede(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "P").select("o_orderkey", "status")


@query("WITH e AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01') SELECT l_linestatus, count(*) AS cancelled FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM e) GROUP BY l_linestatus")
def m13_expire_and_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < at("1996-01-01"))).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linestatus").join(gone, "l_orderkey", "left_semi").groupBy("l_linestatus").agg(F.count("*").alias("cancelled"))


@query("SELECT conv_id, array_to_string(list_append(list(role ORDER BY turn), 'done'), '>') AS history FROM conversations GROUP BY conv_id")
def m15_array_append(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("h"))
    return h.select("conv_id", F.array_join(F.concat("h", F.array(F.lit("done"))), ">").alias("history"))


@query("SELECT o_custkey, greatest(max(epoch_us(o_orderdate)) FILTER (o_orderstatus <> 'P'), max(epoch_us(o_orderdate)) FILTER (o_orderstatus = 'P')) AS last_us FROM orders GROUP BY o_custkey")
def m16_monotone_max(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros("o_orderdate")
    p = F.col("o_orderstatus") == "P"
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.greatest(F.max(F.when(~p, t)), F.max(F.when(p, t))).alias("last_us"))


_RUNS = """r AS (SELECT user_id AS run, min(epoch_us(ts)) AS began, max(epoch_us(ts)) AS last FROM events GROUP BY user_id),
p AS (SELECT user_id AS run, event_type AS prompt, epoch_us(ts) AS asked FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('signup', 'error') AND value > 40) WHERE n = 1)"""


@query(f"""WITH {_RUNS}, x AS (SELECT r.run, coalesce(prompt, 'none') AS prompt, ({NOW} - last) // 1000000 AS idle, (last - coalesce(asked, began)) // 1000000 AS waited FROM r LEFT JOIN p USING (run)),
u(priority, prompt, idle_from, waited_from, action) AS (VALUES (1, NULL, 86400 * 3, NULL, 'timed_out'), (2, 'error', NULL, 86400, 'cancel'), (3, 'signup', NULL, 86400 * 10, 'cancel'), (4, 'signup', NULL, NULL, 'resume'), (5, 'none', NULL, 86400 * 20, 'resume'))
SELECT run, coalesce((SELECT min_by(action, priority) FROM u WHERE (u.prompt IS NULL OR u.prompt = x.prompt) AND (idle_from IS NULL OR idle >= idle_from) AND (waited_from IS NULL OR waited >= waited_from)), 'leave') AS action FROM x""")
def m17_classify(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a run with its first blocking prompt, classified by a table of rules."""
    e = calendar(spark, d).select(F.col("calendar_id").alias("run"), "title", "starts_us", "event_id", "value")
    runs = e.groupBy("run").agg(F.min("starts_us").alias("began"), F.max("starts_us").alias("last"))
    asked = e.where("title IN ('signup', 'error') AND value > 40").groupBy("run").agg(F.min(F.struct("starts_us", "event_id", "title")).alias("p"))
    seconds = lambda c: F.floor(c / 1_000_000)
    x = runs.join(asked, "run", "left").select("run", F.coalesce("p.title", F.lit("none")).alias("prompt"), seconds(F.lit(NOW) - F.col("last")).alias("idle"), seconds(F.col("last") - F.coalesce("p.starts_us", "began")).alias("waited"))
    day = 86_400
    rules = [(1, None, 3 * day, None, "timed_out"), (2, "error", None, day, "cancel"), (3, "signup", None, 10 * day, "cancel"), (4, "signup", None, None, "resume"), (5, "none", None, 20 * day, "resume")]
    table_ = spark.createDataFrame(rules, "priority int, prompt string, idle_from bigint, waited_from bigint, action string")
    return R.decide(x, table_, ["run"], "action", "leave").select("run", "action")


@query(f"""WITH p AS (SELECT event_type AS title, max((props::JSON ->> 'k')::INT) - 5 AS attempts, count(*) // 10 AS pause FROM events WHERE event_type <> 'view' GROUP BY event_type)
SELECT c.event_id, CASE WHEN p.attempts IS NULL THEN 'held' WHEN c.k >= p.attempts THEN 'abandoned' WHEN c.k * 60 < p.pause THEN 'not_yet' ELSE 'replay' END AS action FROM calendar c LEFT JOIN p ON p.title = c.title""")
def m18_sweep_policy(spark: SparkSession, d: str) -> DataFrame:
    """Letters by the policy of their kind: attempts and pauses come from a table, kinds without one are held."""
    c = calendar(spark, d).select("event_id", "title", "k")
    policy = c.where("title <> 'view'").groupBy(F.col("title").alias("kind")).agg((F.max("k") - 5).alias("attempts"), F.floor(F.count("*") / 10).alias("pause"))
    rule = lambda priority, action, low, high: F.struct(F.lit(priority).alias("priority"), F.col("kind").alias("title"), low.cast("int").alias("k_from"), high.cast("int").alias("k_upto"), F.lit(action).alias("action"))
    none = F.lit(None)
    rules = policy.select(F.explode(F.array(rule(1, "abandoned", F.col("attempts"), none), rule(2, "not_yet", none, F.ceil(F.col("pause") / 60)), rule(3, "replay", none, none))).alias("r")).select("r.*")
    return R.decide(c, rules, ["event_id"], "action", "held").select("event_id", "action")


@query("SELECT user_id, event_type, count(*) AS attempts, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events WHERE event_type = 'error' GROUP BY ALL")
def m19_dead_letter_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("attempts"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'F' AS done, l_returnflag = 'R' AS bad, l_partkey, l_suppkey FROM lineitem),
p AS (SELECT *, bool_or(bad) OVER w AS blocked, bool_or(NOT done) OVER w AS open FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN blocked THEN 'blocked' WHEN open THEN 'waiting' ELSE 'clear' END AS state FROM p""")
def m20_sequenced_actions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bool_or(F.col("l_returnflag") == "R").over(w).alias("blocked"), F.bool_or(F.col("l_linestatus") != "F").over(w).alias("open"))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("blocked"), "blocked").when(F.col("open"), "waiting").otherwise("clear").alias("state"))


@query("SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN 'm' || e.label ELSE 'none' END AS model FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.label < 5")
def m7_set_vectors_with_their_model(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("label < 5").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("m"), "label").alias("model"))
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left").select("doc_id", F.coalesce("model", F.lit("none")).alias("model"))


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'P' ELSE max(l_linestatus) END AS dest FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey),
n AS (SELECT o_orderstatus AS st, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT st FROM n WHERE n >= (SELECT max(n) FROM n))
SELECT o_orderkey, CASE WHEN o_orderstatus IN (SELECT st FROM e) OR dest IS NULL THEN o_orderstatus ELSE dest END AS status FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def m14_terminal_status_never_moves(spark: SparkSession, d: str) -> DataFrame:
    """Orders move to what their lines say; the status that most orders have is an end."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    lines = table(spark, d, "lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    moves = lines.agg(F.when(F.min("l_linestatus") < F.max("l_linestatus"), "P").otherwise(F.max("l_linestatus")).alias("to"))
    n = o.groupBy("status").agg(F.count("*").alias("n"))
    ends = n.join(n.agg(F.max("n").alias("n")), "n", "left_semi")
    return R.guarded(o, moves, ["o_orderkey"], ends)


@query("""WITH g AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
SELECT n_nationkey AS tenant, coalesce(n, 0) AS gone, 0 AS stays FROM g LEFT JOIN c ON c_nationkey = n_nationkey UNION ALL SELECT c_nationkey, 0, n FROM c WHERE c_nationkey NOT IN (SELECT n_nationkey FROM g)""")
def m6_purge_with_counts(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one region's nations go; what each tenant had, and what the others keep."""
    gone = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("tenant"))
    kept, counts = R.purge(table(spark, d, "customer").select(F.col("c_nationkey").alias("tenant"), "c_custkey"), "tenant", gone)
    stays = kept.groupBy("tenant").agg(F.lit(0).cast("bigint").alias("gone"), F.count("*").alias("stays"))
    return counts.select("tenant", F.col("n").alias("gone"), F.lit(0).cast("bigint").alias("stays")).unionAll(stays)


def _kept_vector() -> dict[str, Column]:
    """With an unchanged hash a missing vector is kept, else it falls."""
    same = F.when(F.col("hash").eqNullSafe(F.col("s_hash")), F.coalesce("s_vec", "vec")).otherwise(F.col("s_vec"))
    return {"hash": F.col("s_hash"), "size": F.col("s_size"), "vec": same}


@query(ORACLES["m1_upsert"])
def m1_merge_by_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same upsert into a table on disk: only buckets that the batch falls into are written anew."""
    old, new = _upsert_input(spark, d)
    root, schema = scratch(spark, "keyed"), "id bigint, hash string, size bigint, vec bigint"
    keyed.create(old, root, ["id"])
    keyed.merge(spark, root, new, ["id"], schema, _kept_vector)
    return keyed.read(spark, root, schema)


@query(ORACLES["m9_mru_upsert"])
def m9_merge_by_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Newer labels of users merged into a table on disk; the time of last sight never goes back."""
    old, new = _mru_input(spark, d)
    root, schema = scratch(spark, "keyed"), "id bigint, label string, seen bigint"
    keyed.create(old.select("id", "label", "seen"), root, ["id"], 16)
    keyed.merge(spark, root, new.select("id", "label", "seen"), ["id"], schema, lambda: {"label": F.coalesce("s_label", "label"), "seen": F.greatest("s_seen", "seen")})
    return keyed.read(spark, root, schema)
