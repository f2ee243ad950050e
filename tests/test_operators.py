import random
import uuid
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import extract as X
from millrace.functions import text as T
from millrace.functions.temporal import Clock
from millrace.operators import filters as P
from millrace.operators import intervals as I
from millrace.operators import ledger as L
from millrace.operators import search as S
from millrace.plans.router import route

M = I.MINUTE


def test_unknown_filters_are_refused_and_none_is_skipped(spark):
    df = spark.createDataFrame([("mail", 1, "cancelled"), ("mail", 2, None)], "connector string, event_id int, status string")
    with pytest.raises(P.UnknownFilter):
        P.EVENT.scan(df, colour="red")
    assert [r.event_id for r in P.EVENT.scan(df, not_cancelled=True, status=None).collect()] == [2]


@pytest.mark.parametrize(
    ("op", "value", "want"),
    [("eq", "A", [1]), ("ne", "a", [2, 3, 4]), ("in", ["b", "a"], [1, 2]), ("not_in", ["a"], [2, 3, 4]), ("icontains", "B", [2]), ("exists", None, [1, 2]), ("empty", None, [3, 4]), ("starts_with", "B", [2]), ("matches", "^.$", [1, 2]), ("gt", 1, [])],
)
def test_row_predicates(spark, op, value, want):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "")], "id int, v string")
    assert sorted(r.id for r in P.where(df, [("v", op, value)]).collect()) == want


def test_numbers_in_text_and_lists(spark):
    df = spark.createDataFrame([(1, "10.5", ["x", "Y"]), (2, "2024-01-01 00:00:00", []), (3, "no", None)], "id int, v string, l array<string>")
    ids = lambda *t: sorted(r.id for r in P.where(df, list(t)).collect())
    assert ids(("v", "gt", 5)) == [1, 2] and ids(("v", "within", (10, 11))) == [1]
    assert ids(("l", "contains", "y")) == [1] and ids(("l", "empty", None)) == [2, 3]


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(5)
    spans = lambda n: [(i, rng.randint(0, 3), s := rng.randint(0, 6 * I.DAY), s + rng.choice([0, M, 300 * M, 2 * I.DAY])) for i in range(n)]
    a, b = spans(80), spans(80)
    got = I.overlap_join(spark.createDataFrame(a, "i int, k int, start bigint, end bigint"), spark.createDataFrame(b, "j int, k int, b_start bigint, b_end bigint"), ["k"])
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_merge_gaps_and_slots(spark):
    day = 19_737 * I.DAY  # a Monday
    busy = spark.createDataFrame([("a", day + 9 * 60 * M, day + 10 * 60 * M), ("a", day + 10 * 60 * M, day + 11 * 60 * M), ("a", day + 13 * 60 * M, day + 13 * 60 * M), ("a", day + 16 * 60 * M + 45 * M, day + 20 * 60 * M)], "who string, start bigint, end bigint")
    merged = sorted((r.start - day, r.end - day) for r in I.merge(busy, ["who"]).collect())
    assert merged == [(540 * M, 660 * M), (1005 * M, 1200 * M)]
    assert [(r.free_from - day, r.free_until - day) for r in I.gaps(I.merge(busy, ["who"]), ["who"]).collect()] == [(660 * M, 1005 * M)]
    free = I.free_slots(busy, ["who"], day, 7)
    assert sorted(((r.free_from - day) // M, (r.free_until - day) // M) for r in free.collect())[0] == (660, 1005)
    assert free.count() == 5  # one on Monday, four whole days, no weekend


def test_ranking_rules(spark):
    arm = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
    fused = {r.id: r.rrf for r in S.rrf(arm("ab"), arm("cb")).collect()}
    assert abs(fused["a"] - 1 / 61) < 1e-12 and fused["b"] > fused["a"] == fused["c"]
    pool = spark.createDataFrame([(1, 0.2), (2, 0.9)], "id int, s double").withColumn("cn", S.confidence("s"))
    assert sorted(r.cn for r in pool.collect()) == [0.2, 0.9]  # too small a pool: the scores themselves
    values = spark.range(1).select(S.decay(F.lit(30.0)).alias("d"), S.decay(F.lit(-5.0)).alias("future"), S.boost(F.lit(0.0)).alias("b")).first()
    assert abs(values.d - 0.36787944) < 1e-6 and values.future == 1 and abs(values.b - 1.6) < 1e-9
    two = spark.createDataFrame([("x", 1, 0.9, 0.9), ("x", 2, 0.75, 0.75), ("y", 3, 0.9, 0.9), ("y", 4, 0.8, 0.8), ("z", 5, 0.4, 0.4)], "g string, id int, cn double, cn_raw double")
    assert {r.g: r.verdict for r in S.verdicts(two, "g").collect()} == {"x": "confident", "y": "ambiguous", "z": "absent"}


def test_upsert_keeps_a_vector_only_with_its_hash(spark):
    schema = "id int, hash string, vec string"
    t = spark.createDataFrame([(1, "h", "v"), (2, "h", "v"), (3, "h", "v")], schema)
    s = spark.createDataFrame([(1, "h", None), (2, "g", None), (4, "n", "w")], schema)
    assert sorted((r.id, r.hash, r.vec) for r in L.upsert(t, s, ["id"], "hash", "vec").collect()) == [(1, "h", "v"), (2, "g", None), (3, "h", "v"), (4, "n", "w")]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.normalise(F.lit("  Crème-Brûlée №5 "))) == "creme brulee no5"
    assert one(T.strip_html(F.lit("<p>a&amp;b<!-- x --><script>no</script> <b>c</b>"))) == "a&b c"
    assert one(T.file_words(F.lit("budgetReport_v2-final.docx"))) == "budget report v2 final"
    assert one(T.number(F.lit("1.234,56"))) == 1234.56 and one(T.number(F.lit("1,234.56"))) == 1234.56 and one(T.number(F.lit("1,234"))) == 1234
    assert one(T.fingerprint(F.lit("x"), str(uuid.NAMESPACE_DNS))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "x"))
    assert one(T.clean_mail(F.lit("Thanks, see you on Friday at the usual place.\nOn Mon, A wrote:\n> old"))) == "Thanks, see you on Friday at the usual place."
    assert one(T.emails(F.lit("A@b.com a@B.com, c@d.org"))) == ["a@b.com", "c@d.org"]


def test_chunks_fit_and_overlap():
    text = "One sentence here. " * 200 + "\n\n" + "x" * 3000
    parts = T.pieces(text, 800, 100)
    assert all(len(p) <= 800 for p in parts) and all(b.startswith(a[-100:]) for a, b in zip(parts, parts[1:], strict=False))
    assert T.pieces("", 800, 100) == []


def test_extraction_rules(spark):
    assert X.booking_code("Your booking AB12CD is set") == "AB12CD" and X.booking_code("code AB12CD") is None
    assert X.flights("TK 0123, AM 900 and tk1; LH 7, TK123") == ["TK123", "LH7"]
    t = spark.createDataFrame([("Order no. A-17 total EUR 1.234,50 IST-IST IST-JFK https://x.org/document/d/abcdef12",)], "t string")
    r = t.select(X.amounts(F.col("t")).alias("a"), X.order_number(F.col("t")).alias("n"), X.route(F.col("t")).alias("r"), X.doc_links(F.col("t")).alias("d")).first()
    assert (r.a[0].currency, r.a[0].value, r.n, r.r.origin, r.r.destination, r.d[0].kind) == ("EUR", 1234.5, "A-17", "IST", "JFK", "document")


def test_router_takes_whole_messages_only():
    clock = Clock(datetime(2024, 5, 15, 14, tzinfo=UTC))
    assert route("please show my calendar for next week?", clock)[0] == "calendar_window"
    assert route("Emails from Kim@Example.com", clock)[1].steps[0].args == {"from_email": "kim@example.com"}
    assert route("show my calendar for next week and cancel it", clock) is None


def test_literals_by_kind():
    got = X.literals('mail bob@example.com about "the plan" on 2024-03-02 at 10:30, file Budget.pdf, EUR 12.50, flight TK 12, ref AB12CD and 7 #urgent https://x.example/a?b.')
    assert got == {"email": ["bob@example.com"], "quoted": ["the plan"], "date": ["2024-03-02"], "time": ["10:30"], "file": ["Budget.pdf"], "amount": ["EUR 12.50"], "flight": ["TK 12"], "reference": ["AB12CD"], "number": ["7"], "hashtag": ["#urgent"], "url": ["https://x.example/a?b"]}


def test_phones_and_urls(spark):
    rows = [("call +90 (212) 555 44 33 or 030-1234-5678, not 12.5 or 2024-03-02 11",), ("see <https://a.example/b> and (https://c.example). https://",)]
    got = spark.createDataFrame(rows, "t string").select(T.phones(F.col("t")).alias("p"), T.urls(F.col("t")).alias("u")).collect()
    assert "030-1234-5678" in got[0].p and got[1].u == ["https://a.example/b", "https://c.example"]


def test_booking_code_is_the_nearest_to_its_word():
    assert X.booking_code("CODE12 long before, and then a reservation: AB12CD") == "AB12CD"
    assert X.booking_code("reservation ABCDEF 123456") is None and X.flights("") == []
