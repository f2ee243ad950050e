from datetime import UTC, datetime

import pytest

from millrace.functions.temporal import Clock, resolve, scan, target_slot
from millrace.plans.ir import Op, Plan, PlanError, bind, order, run, validate

NOW = datetime(2024, 5, 15, 14, 30, tzinfo=UTC)  # a Wednesday


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("mail from 2024-03-02", "2024-03-02T00:00", "2024-03-03T00:00"),
        ("what is on tomorrow", "2024-05-16T00:00", "2024-05-17T00:00"),
        ("the day after tomorrow", "2024-05-17T00:00", "2024-05-18T00:00"),
        ("next friday", "2024-05-24T00:00", "2024-05-25T00:00"),
        ("on friday", "2024-05-17T00:00", "2024-05-18T00:00"),
        ("last week", "2024-05-06T00:00", "2024-05-13T00:00"),
        ("this quarter", "2024-04-01T00:00", "2024-07-01T00:00"),
        ("last month", "2024-04-01T00:00", "2024-05-01T00:00"),
        ("tonight", "2024-05-15T18:00", "2024-05-16T00:00"),
        ("past 3 hours", "2024-05-15T11:30", "2024-05-15T14:30"),
        ("2 weeks ago", "2024-05-01T00:00", "2024-05-02T00:00"),
        ("march 2023", "2023-03-01T00:00", "2023-04-01T00:00"),
        ("at 3pm", "2024-05-15T15:00", "2024-05-15T16:00"),
        ("June 3rd", "2024-06-03T00:00", "2024-06-04T00:00"),
        ("tomorrow at 3pm", "2024-05-16T15:00", "2024-05-16T16:00"),
        ("next friday morning", "2024-05-24T06:00", "2024-05-24T12:00"),
        ("2024-06-02 at 09:30", "2024-06-02T09:30", "2024-06-02T10:30"),
        ("friday from 2 to 4pm", "2024-05-17T14:00", "2024-05-17T16:00"),
        ("on the 3rd of June 2025", "2025-06-03T00:00", "2025-06-04T00:00"),
        ("sept 9", "2024-09-09T00:00", "2024-09-10T00:00"),
        ("October 1", "2024-10-01T00:00", "2024-10-02T00:00"),
        ("2 January", "2024-01-02T00:00", "2024-01-03T00:00"),
        ("in two weeks", "2024-05-29T00:00", "2024-05-30T00:00"),
        ("three days ago", "2024-05-12T00:00", "2024-05-13T00:00"),
        ("a couple of days ago", "2024-05-13T00:00", "2024-05-14T00:00"),
        ("a week from now", "2024-05-22T00:00", "2024-05-23T00:00"),
        ("in 2 hours", "2024-05-15T16:30", "2024-05-15T17:30"),
        ("next 3 days", "2024-05-15T14:30", "2024-05-18T14:30"),
        ("the past two months", "2024-03-15T14:30", "2024-05-15T14:30"),
        ("coming weekend", "2024-05-25T00:00", "2024-05-27T00:00"),
        ("previous year", "2023-01-01T00:00", "2024-01-01T00:00"),
        ("q3 2023", "2023-07-01T00:00", "2023-10-01T00:00"),
        ("in august", "2024-08-01T00:00", "2024-09-01T00:00"),
        ("this afternoon", "2024-05-15T12:00", "2024-05-15T18:00"),
        ("lunch at noon", "2024-05-15T12:00", "2024-05-15T13:00"),
    ],
)
def test_phrases(text, start, end):
    w = resolve(text, Clock(NOW))
    assert (w.start.isoformat()[:16], w.end.isoformat()[:16]) == (start, end)


def test_days_of_the_clock_changes_have_23_and_25_hours():
    spring = resolve("tomorrow", Clock(datetime(2024, 3, 9, 12, tzinfo=UTC), "America/New_York"))
    autumn = resolve("tomorrow", Clock(datetime(2024, 11, 2, 12, tzinfo=UTC), "America/New_York"))
    assert (spring.end - spring.start).total_seconds() == 23 * 3600
    assert (autumn.end - autumn.start).total_seconds() == 25 * 3600


def test_weeks_may_begin_on_sunday_and_stretches_do_not_overlap():
    assert resolve("this week", Clock(NOW, week_start=6)).start.date().isoformat() == "2024-05-12"
    assert [(w.rule, w.text) for w in scan("the day after tomorrow or next 3 days", Clock(NOW))] == [("day", "the day after tomorrow"), ("span", "next 3 days")]
    assert all(resolve(x, Clock(NOW)) is None for x in ("nothing here", "31 February", "may", "12 apples", "the morning paper", ""))


def test_wall_times_that_the_clocks_skip_and_repeat():
    ny = "America/New_York"
    skipped = resolve("2024-03-10 at 02:30", Clock(datetime(2024, 3, 1, tzinfo=UTC), ny))
    assert skipped.start.isoformat()[:16] == "2024-03-10T07:30"
    kolkata = resolve("today", Clock(datetime(2024, 5, 15, 20, tzinfo=UTC), "Asia/Kolkata"))
    assert kolkata.start.isoformat()[:16] == "2024-05-15T18:30"


def test_a_slot_takes_the_length_that_is_asked_for():
    assert [t.isoformat()[11:16] for t in target_slot("tomorrow at 3pm", Clock(NOW), 45)] == ["15:00", "15:45"]
    assert [t.isoformat()[11:16] for t in target_slot("tomorrow from 3 to 5pm", Clock(NOW))] == ["15:00", "17:00"]


def _ops(spark):
    numbers = lambda n: spark.range(n).selectExpr("id", "id * 2 AS ids")
    return {
        "data.numbers": Op("data.numbers", {"n": int}, ("id", "ids"), numbers, ("n",)),
        "data.pick": Op("data.pick", {"from_": object, "note": str}, ("id",), lambda from_, note="": from_.filter(spark.range(100), "id") if hasattr(from_, "filter") else spark.range(int(from_))),
        "mail.send": Op("mail.send", {}, ("id",), lambda: spark.range(1), is_write=True),
    }


def test_validation_names_every_fault(spark):
    spec = {"intent": {"services": ["drive"]}, "steps": [{"id": "a", "op": "data.numbers", "args": {"n": "x"}, "depends_on": ["b"]}, {"id": "b", "op": "data.pick", "args": {"from_": "{{c.id}}"}, "depends_on": ["a"]}, {"id": "c", "op": "mail.send"}, {"id": "c", "op": "no.such"}]}
    with pytest.raises(PlanError) as e:
        validate(Plan.of(spec), _ops(spark))
    text = str(e.value)
    for part in ("wait for each other", "wrong type", "not upstream", "used twice", "no operator", "not among", "a write under"):
        assert part in text
    with pytest.raises(PlanError, match="13 steps"):
        validate(Plan.of({"steps": [{"id": f"s{i}", "op": "data.numbers", "args": {"n": 1}} for i in range(13)]}), _ops(spark))
    assert order(Plan.of({"steps": [{"id": "b", "op": "x", "depends_on": ["a"]}, {"id": "a", "op": "x"}]})) == ["a", "b"]


def test_references_bind_lazily_and_keep_their_type(spark):
    done = {"a": spark.range(5).selectExpr("id + 3 AS id")}
    assert bind("{{a.id}}", done) == 3 and bind("{{a.id[1]}}", done) == 4 and bind("no {{a.id}}!", done) == "no 3!"
    with pytest.raises(PlanError):
        bind("{{a.id[9]}}", done)
    plan = Plan.of({"steps": [{"id": "a", "op": "data.numbers", "args": {"n": 4}}, {"id": "b", "op": "data.pick", "args": {"from_": "{{a.ids[*]}}"}, "depends_on": ["a"]}, {"id": "c", "op": "data.pick", "args": {"from_": "{{a.id[2]}}"}, "depends_on": ["a"]}]})
    done, outcome = run(plan, _ops(spark))
    assert sorted(r.id for r in done["b"].collect()) == [0, 2, 4, 6] and done["c"].count() == 2 and set(outcome.values()) == {"ok"}


def test_a_singular_field_is_mended_and_failures_stay_local(spark):
    plan = Plan.of({"steps": [{"id": "a", "op": "data.numbers", "args": {"n": 0}}, {"id": "b", "op": "data.pick", "args": {"from_": "{{a.idss}}"}, "depends_on": ["a"]}, {"id": "c", "op": "data.numbers", "args": {"n": 2}}]})
    done, outcome = run(plan, _ops(spark))
    assert outcome["b"].startswith("failed") and outcome["c"] == "ok" and done["c"].count() == 2
