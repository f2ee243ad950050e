"""Evidence flags, aliases and folding against plain versions."""

import random
import re
import unicodedata

import pytest

from pyspark.sql import functions as F


def fold(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).replace("ı", "i")
    return re.sub("[^a-z0-9]+", " ", bare.casefold()).strip()


def test_folding_of_all_kinds_of_characters(spark):
    from millrace.functions.text import normalise, normalised

    rng = random.Random(1)
    any_of = lambda: chr(rng.choice([rng.randint(32, 0x250), rng.randint(0x250, 0xD7FF), rng.randint(0x1E00, 0x2200), rng.randint(0xFB00, 0xFB06), 65, 9]))
    texts = ["".join(any_of() for _ in range(12)) for _ in range(3000)] + ["Straße ﬁn ½ ㎏ İstanbul Ａ１", "", "plain ASCII"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalise(F.col("t")).alias("n")).collect()]
    assert got == [fold(t) for t in texts] == [normalised(t) for t in texts]


ROWS = [
    ("m-100000001", "anna@mail.blueair.com", "Your Blue Air booking", False), ("m-2", "bob@other.org", "Blue airport news", False), ("f-3", "carol@other.org", "Trip_Plan-2024.pdf", True),
    ("f-4", None, "presentation.ppt", True), ("f-5", "BOB@OTHER.ORG", "BX-12345 receipt", True), (None, "", None, True), ("f-7", "x@blueair.com.evil.net", "Ünïcode ﬁle v3.txt", True),
]


@pytest.mark.parametrize("question", ["trip plan 2024 of blue air", "unicode file v3 m 100000001", "presentation", "mail bob@other.org about the azul", "blue airport", ""])
@pytest.mark.parametrize("ids", [(), ("m-2",)])
def test_flags_equal_the_rule(spark, question, ids):
    from millrace.operators.evidence import flags, terms_of

    aliases = spark.createDataFrame([("blue", ["Blue Air", "Azul"], ["blueair.com"], [r"\bBX-\d{5}\b"]), ("red", ["Red"], ["red.com"], None)], "group string, tokens array<string>, domains array<string>, codes array<string>")
    terms = terms_of(question, aliases, ids=ids, filenames=("trip plan 2024",) if "azul" in question else ())
    named = any(f" {fold(x)} " in f" {fold(question)} " for x in ("Blue Air", "Azul"))
    assert (terms.domains == ("blueair.com",)) == named
    asked, inside = fold(question), lambda x: f" {x} " in f" {fold(question)} "
    table = spark.createDataFrame(ROWS, "id string, sender string, title string, file boolean")
    for files in (True, False):
        build = flags(terms, ids=F.array_compact(F.array("id")), sender=F.col("sender"), title=F.col("title"), is_file=files)
        for r in table.where(F.col("file") == files).select("*", build.alias("e")).collect():
            want = []
            if (r.id in ids) if ids else bool(r.id and len(r.id) >= 8 and fold(r.id) in asked):
                want.append("EXACT_ID")
            domain = (r.sender or "").lower().rsplit("@", 1)[-1]
            if r.sender and (r.sender.lower() in terms.emails or (named and (domain == "blueair.com" or domain.endswith(".blueair.com")))):
                want.append("EXACT_SENDER")
            if files and r.title:
                stem = re.sub(r"\.[A-Za-z0-9]{1,5}$", "", r.title)
                names = {fold(r.title), fold(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", stem))} - {""}
                exact = lambda x: len(x.split()) > 1 or any(c.isdigit() for c in x)
                if any((exact(x) and x in map(fold, terms.filenames)) or x == asked or (exact(x) and inside(x)) for x in names):
                    want.append("EXACT_FILENAME")
            title = f" {fold(r.title)} "
            if named and (" blue air " in title or " azul " in title or re.search(r"\bBX-\d{5}\b", r.title or "", re.IGNORECASE)):
                want.append("ALIAS_TOKEN_IN_SUBJECT")
            assert r.e == want, (r, question)


def test_ten_thousand_aliases_meet_texts_by_word_sequences(spark):
    from millrace.operators.evidence import alias_hits, longest_alias

    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    forms = [(g, [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))).title() for _ in range(2)]) for g in range(10_000)]
    texts = [(i, ", ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, "--")]
    aliases, table = spark.createDataFrame(forms, "group int, tokens array<string>"), spark.createDataFrame(texts, "id int, text string")
    want = {}
    by_form = {}
    for g, own in forms:
        for x in own:
            by_form.setdefault(fold(x), set()).add(g)
    for i, t in texts:
        w = fold(t).split()
        found = {" ".join(w[a : a + n]) for n in range(1, 5) for a in range(len(w) - n + 1)} & by_form.keys()
        want |= {(i, g, x): 1 for x in found for g in by_form[x]}
    hits = alias_hits(table, "id", "text", aliases)
    got = [tuple(r) for r in hits.collect()]
    assert len(got) == len(set(got)) and set(got) == set(want)
    best = {}
    for i, g, x in want:
        best[i] = min(best.get(i, (0, "~", 0)), (-len(x), x, g))
    assert {r.key: (-len(r.token), r.token, r.group) for r in longest_alias(table, "id", "text", aliases).collect()} == best
    assert "NestedLoop" not in hits._jdf.queryExecution().toString() and "Cartesian" not in hits._jdf.queryExecution().toString()
    assert alias_hits(table, "id", "text", aliases.where("false")).count() == 0


def most_rows(df):
    """The most rows that any join of the finished plan has made."""

    def walk(node):
        yield node
        name = node.nodeName()
        inside = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        children = node.children()
        for x in [*inside, *(children.apply(i) for i in range(children.size()))]:
            yield from walk(x)

    df.collect()
    return max(x.metrics().apply("numOutputRows").value() for x in walk(df._jdf.queryExecution().executedPlan()) if "Join" in x.nodeName())


def test_a_form_that_many_groups_share_meets_a_text_once(spark):
    from millrace.operators.evidence import longest_alias

    aliases = spark.range(3000).selectExpr("CAST(id AS INT) AS group", "array('the', concat('own ', id)) AS tokens")
    texts = spark.createDataFrame([(i, f"the, and own {i} of the") for i in range(40)] + [(i, "Thé end") for i in range(40, 50)], "id int, text string")
    best = longest_alias(texts, "id", "text", aliases)
    assert sorted(map(tuple, best.collect())) == [(i, i, f"own {i}") for i in range(40)] + [(i, 0, "the") for i in range(40, 50)]
    assert most_rows(best) <= 100


@pytest.mark.parametrize("numbered", [100_000, 1500])
def test_counts_of_hits_and_groups_without_a_row_for_each(spark, monkeypatch, numbered):
    from millrace.operators import evidence as E

    monkeypatch.setattr(E, "NUMBERED", numbered)
    rng = random.Random(9)
    forms = [(g, ["all", rng.choice(["red", "blue", "red sea", "deep blue"]), f"w{g % 700}"]) for g in range(3000)] + [(None, ["all", "grey"]), (5, ["all", "ALL", "x"])]
    texts = [(i, " ".join(rng.choice(["all", "red", "sea", "deep", "blue", "grey", "w7", "w699", "none"]) for _ in range(rng.randint(0, 6)))) for i in range(150)] + [(900, None)]
    aliases, table = spark.createDataFrame(forms, "group int, tokens array<string>"), spark.createDataFrame(texts, "id int, text string")
    want = E.alias_hits(table, "id", "text", aliases).groupBy("key").agg(F.count("*"), F.count_distinct("group")).collect()
    counts = E.alias_counts(table, "id", "text", aliases)
    assert sorted(map(tuple, counts.select("key", "hits", "groups").collect())) == sorted(map(tuple, want))
    assert most_rows(counts) <= 150 * 11 * 6  # sequences of a text, and rows of 1,024 groups
    assert E.alias_counts(table, "id", "text", aliases.where("false")).count() == 0
