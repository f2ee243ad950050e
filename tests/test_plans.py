from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.temporal import Clock
from millrace.operators import corpora as C
from millrace.operators import filters as P
from millrace.operators.search import SearchError
from millrace.plans import prepass
from millrace.plans.ir import Plan, PlanError, replan, run
from millrace.plans.ops import ACTIONS, registry, relabelled, revise, titled
from millrace.sources import layout

SMALL = "/root/testdata/sf0.001"
CLOCK = Clock(datetime(2024, 1, 10, 9, tzinfo=UTC))


@pytest.fixture(scope="module")
def ops(spark):
    return registry(spark, SMALL)


def plan(*steps, write=False):
    return Plan.of({"intent": {"services": sorted({s["op"].split(".")[0] for s in steps}), "has_write": write, "confidence": 1.0}, "steps": list(steps)})


def test_a_question_pauses_a_plan_and_an_answer_resumes_it(spark, ops):
    p = plan({"id": "q", "op": "ask.user", "args": {"question": "Which?", "choices": ["a", "b"]}}, {"id": "n", "op": "calendar.search", "args": {"limit": 3}}, {"id": "g", "op": "calendar.get", "args": {"ids": "{{q.answer}}"}, "depends_on": ["q"]})
    done, outcome = run(p, ops)
    assert outcome == {"q": "paused: Which?", "n": "ok", "g": "skipped: dependency"} and done["n"].count() == 3
    done, outcome = run(p, ops, completed={**done, "q": spark.createDataFrame([(5,)], "answer int")})
    assert set(outcome.values()) == {"ok"} and [r.event_id for r in done["g"].collect()] == [5]


def test_reads_and_operators_over_rows(ops):
    p = plan(
        {"id": "a", "op": "mail.search", "args": {"thread_id": 3, "limit": 4}}, {"id": "b", "op": "mail.get", "args": {"ids": "{{a.message_id[*]}}"}, "depends_on": ["a"]}, {"id": "c", "op": "text.extract", "args": {"rows": "{{b.text[*]}}", "column": "text"}, "depends_on": ["b"]},
        {"id": "d", "op": "data.filter", "args": {"rows": "{{a.position[*]}}", "tests": [["position", "gte", 1]]}, "depends_on": ["a"]}, {"id": "e", "op": "page.more", "args": {"shape": "mail", "limit": 2, "offset": 2, "filters": {"thread_id": 3}}},
    )
    done, outcome = run(p, ops)
    assert set(outcome.values()) == {"ok"}
    assert done["b"].count() == done["c"].count() > 0 and "missing" in done["c"].columns
    first = [r.message_id for r in done["a"].collect()]
    assert [r.message_id for r in done["e"].collect()] == first[2:4] and done["d"].where("position < 1").isEmpty()


def test_people_references_slots_and_all_corpora(ops):
    p = plan({"id": "p", "op": "resolve.person", "args": {"name": "assistant"}}, {"id": "s", "op": "search.all", "args": {"text": "click", "limit": 5}}, {"id": "f", "op": "calendar.find_free_slots", "args": {"day_us": 1_704_672_000_000_000, "days": 2}}, {"id": "m", "op": "calendar.match_event", "args": {"at_us": 1_704_880_800_000_000}}, {"id": "r", "op": "resolve.reference", "args": {"now_us": 1_706_659_200_000_000, "kind": "view"}}, {"id": "g", "op": "drive.get", "args": {"ids": [1, 2]}})
    done, outcome = run(p, ops)
    assert set(outcome.values()) == {"ok"}
    assert done["p"].orderBy(F.desc("cn")).first().address == "assistant@example.com"
    assert 0 < done["s"].count() <= 5 and done["f"].where("free_until - free_from < 1800000000").isEmpty()
    assert done["m"].first().verdict in ("ambiguous", "confident") and done["r"].count() > 0 and done["g"].count() == 2


def test_actions_are_staged_and_revised(spark, ops):
    assert all(ops[name].is_write for name in ACTIONS)
    p = plan({"id": "a", "op": "mail.send", "args": {"to": "x@y.example", "body": "hi"}}, {"id": "b", "op": "drive.move_file", "args": {"file_id": 3, "folder_id": "z"}}, write=True)
    done, _ = run(p, ops)
    staged = done["a"].unionByName(done["b"])
    out = {r.action: r for r in revise(staged, "mail.send", {"body": "hello"}).collect()}
    assert out["mail.send"].payload == {"to": "x@y.example", "body": "hello"} and len(out["mail.send"].history) == 1 and out["drive.move_file"].history == []
    with pytest.raises(PlanError):
        ops["mail.send"].lower(to="x")
    r = spark.createDataFrame([(["INBOX", "UNREAD"],)], "l array<string>").select(relabelled(F.col("l"), ["Done"], ["UNREAD"]).alias("l")).first()
    assert r.l == ["INBOX", "Done"]
    chats = titled(spark.createDataFrame([(1, None), (2, "old")], "conversation int, title string"), 1, "new")
    assert sorted(r.title for r in titled(chats, 2, "x").collect()) == ["new", "old"]
    assert replan({"a": "failed: plan: no value"}, 0) and replan({"a": "failed: plan: no value"}, 2) is None and replan({"a": "failed: service mail: X"}, 0) is None


def test_hints_of_a_message():
    h = prepass.hints("Hey, could you please show my unread emails from tomorrow?", CLOCK)
    assert h.text.startswith("show my unread") and h.labels == ["UNREAD"] and h.structural and not h.asks_to_write and h.windows[0].text == "tomorrow"
    h = prepass.hints("Send that deck to bob@example.com", CLOCK)
    assert h.asks_to_write and h.points_back and h.kinds and h.literals["email"] == ["bob@example.com"] and not h.structural
    assert P.kind_words("budget pdfs")[1] == ["application/pdf"] and P.kind_words("pdf")[0] == "pdf"


def test_rules_of_embeddings_and_filters(spark):
    assert C.reusable("budget plan", "The budget plan, please") and not C.reusable("budget draft", "the budget plan")
    with pytest.raises(SearchError):
        C.one_model(spark.createDataFrame([("a",), ("b",), (None,)], "embed_model string"))
    with pytest.raises(P.UnknownFilter):
        P.bounds(("2024-01-02", "2024-01-01"))
    with pytest.raises(P.UnknownFilter):
        P.MESSAGE.of(spark.range(1), None)
    rows = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h1", "a")], "hash string, text string")
    cache = spark.createDataFrame([("m", "h1", [1.0])], "model string, hash string, vector array<double>")
    out, full = C.embedded(rows, cache, "m", lambda texts: [[float(len(t))] for t in texts])
    assert out.where("vector IS NULL").isEmpty() and full.count() == 2


def test_layouts(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 5).alias("tenant"), F.col("id").alias("at"), F.concat(F.lit("w"), F.col("id") % 3).alias("t"))
    path = str(tmp_path / "t")
    layout.write_table(df, path, "tenant", "at", 8)
    own = layout.read_tenant(spark, path, "tenant", 3, 8)
    assert sorted(r["at"] for r in own.collect()) == list(range(3, 300, 5))
    assert "PartitionFilters: [isnotnull(_bucket" in own._jdf.queryExecution().toString()
    layout.append(df, path + "log")
    layout.append(df, path + "log")
    assert spark.read.parquet(path + "log").count() == 600
