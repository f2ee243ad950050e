"""Claimed spans against plain searches and a trial of all choices."""

import itertools
import random
import re

import pytest

from pyspark.sql import functions as F

LETTER = (
    "Booking reference QX12AB for TK 0198 IST-JFK on 5 Nov 2024 at 10:30 pm. Your e-ticket number 235 1234567890, order no. A-77812, Invoice: INV-2024-05. "
    "Call +90 (212) 555-01-02 or write to support@air.example.com, see https://docs.google.com/document/d/abcdefghijkl and https://x.example.com/2024-01-02. "
    "Paid EUR 1.234,56 and 99 SEK or ₺50. Istanbul (IST) to Rome (FCO), March 3, 2025; 13/02/24 09:15; 02/30/2024; AM 10. Case zx-99."
)


def one(spark, text, **more):
    from millrace.functions.spans import claimed

    rows = claimed(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", **more).first().spans
    return [(s.kind, s.value) for s in rows], [(s.start, s.end) for s in rows]


def test_all_kinds_in_one_letter(spark):
    found, places = one(spark, LETTER, codes={"case": r"\bzx-\d+\b"})
    assert found == [
        ("booking", "QX12AB"), ("flight", "TK198"), ("route", "IST→JFK"), ("date", "2024-11-05T22:30"), ("ticket", "2351234567890"), ("order", "A-77812"), ("invoice", "INV-2024-05"), ("phone", "+902125550102"),
        ("email", "support@air.example.com"), ("doc_link", "document:abcdefghijkl"), ("link", "https://x.example.com/2024-01-02"), ("amount", "EUR 1234.56"), ("amount", "SEK 99.00"), ("amount", "TRY 50.00"),
        ("route", "IST→FCO"), ("date", "2025-03-03"), ("date", "2024-02-13T09:15"), ("code", "case:ZX-99"),
    ]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(places)) and LETTER[places[0][0] : places[0][1]] == "QX12AB"


@pytest.mark.parametrize("text, want", [
    ("2024-02-30", []), ("31 Ağustos 2023", ["2023-08-31"]), ("sept 9", ["2024-09-09"]), ("9 sep 69", ["1969-09-09"]), ("12/31/2024", ["2024-12-31"]), ("09.10.24", ["2024-09-10"]),
    ("2024-05-06T07:08", ["2024-05-06T07:08"]), ("2024-05-06 25:00", []), ("May 5 at 12:05 am", ["2024-05-05T00:05"]), ("1.2.3.4", []), (None, []), ("", []),
])
def test_dates(spark, text, want):
    assert [v for k, v in one(spark, text)[0] if k == "date"] == want


def test_places_equal_a_plain_search(spark):
    from millrace.functions.spans import located

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1 .é日😀\n") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None]
    for pattern in (r"a+", r"[ab]{2}", r"\d[^\n]?", r"(?<!a)b"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", located(F.coalesce("t", F.lit("")), pattern).alias("m")).collect()
        for r in rows:
            assert [(m.start, m.end, m.text) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, texts[r.i] or "")]


@pytest.mark.parametrize("seed", range(40))
def test_choice_weighs_most(seed):
    from millrace.functions.spans import WEIGHTS, heaviest

    rng = random.Random(seed)
    spans = [(a := rng.randint(0, 30), a + rng.randint(1, 9), rng.choice(sorted(WEIGHTS)), str(rng.randint(0, 2))) for _ in range(rng.randint(0, 11))]
    apart = lambda own: all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(own)))
    weight = lambda own: sum(WEIGHTS[s[2]] for s in own)
    every = [c for n in range(len(spans) + 1) for c in itertools.combinations(set(spans), min(n, len(set(spans)))) if apart(c)]
    got = heaviest(spans)
    assert apart(got) and weight(got) == max(map(weight, every)) and set(got) <= set(spans)


def test_registered_query_on_all_documents_and_pages(spark):
    from millrace.functions.spans import heaviest
    from millrace.queries import QUERIES

    small = "/root/testdata/sf0.001"
    rows = QUERIES["x14_claimed_spans"](spark, small).collect()
    texts = {("documents", r.doc_id): r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()} | {("pages", r.page_id): r.html or "" for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {(r.source, r.id) for r in rows} == set(texts)
    mail = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}\b", re.ASCII)
    for r in rows:
        text = texts[r.source, r.id]
        spans = [(s.start, s.end, s.kind, s.value) for s in r.spans]
        assert heaviest(spans) == spans  # apart and in order
        links = [(m.start(), m.end()) for m in re.finditer(r"(?i)\bhttps?://[^\s<>\"')\]]+", text)]
        want = {m[0].lower() for m in mail.finditer(text) if not any(a < m.end() and m.start() < b for a, b in links)}
        assert {v for _, _, k, v in spans if k == "email"} == want
        assert all(text[a:b].lower() == v for a, b, k, v in spans if k == "email")
    assert len({k for r in rows for k in (s.kind for s in r.spans)}) >= 3


def test_fields_and_help_desk(spark):
    from millrace.functions.spans import fields

    x = fields(spark.createDataFrame([(1, LETTER), (2, None)], "id int, t string"), "id", "t").collect()
    by = {r.key: r.x for r in x}
    assert by[1].support == "support@air.example.com" and by[1].phone == ["+902125550102"] and by[1].route == ["IST→JFK", "IST→FCO"] and by[2].email == [] and by[2].support is None


def test_rules_read_only_pieces_that_can_hold_a_match(spark, monkeypatch):
    """Prose is left out, and spans are those of the whole text as one piece, across tags, lines, cues and marks."""
    from millrace.functions import spans as S

    prose = "Nothing to be found in this line of text.\n" * 400
    row = S.condensed(spark.createDataFrame([(1, prose + LETTER + "\n" + prose)], "id int, t string"), "id", "t").first()
    assert len(row.dense) == len(LETTER) and len(row.lines) == len(LETTER) and one(spark, prose + LETTER + "\n" + prose)[0] == one(spark, LETTER)[0]
    rng = random.Random(3)
    parts = [*LETTER.split(), "order", "ticket", "pnr", "\n", "<b>", "</b>", "<", ">", "12", "0", "x@", "é", "\u0308", "😀", "(IST)", "(FCO)", "ABCD-EFGH-IJKLMNOPQRSTUVWXYZABCDEFGHIJKLMN9", "\r", "zx-1"]
    texts = spark.createDataFrame([(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30)))) for i in range(400)], "id int, t string").cache()
    find = lambda: {r.key: r.spans for r in S.claimed(texts, "id", "t", codes={"case": r"\bzx-\d+\b"}).collect()}
    got = find()
    monkeypatch.setattr(S, "PIECE", "(?s).+")
    monkeypatch.setattr(S, "LINE", "(?s).+")
    assert got == find() and sum(map(len, got.values())) > 500
