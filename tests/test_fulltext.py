"""Full text: stems of published examples, web-style queries, and ranks against a search of all stretches."""

import random
import re

import pytest

SMALL = "/root/testdata/sf0.001"

#: Published pairs of the stemming rules.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit
knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
running run hoping hope hopping hop happy happi by by say say cries cri ties tie tied tie caresses caress gas gas this this generate generat generous generous communism communism
national nation rational ration relational relat hopefulness hope agreed agre feed feed skies sky dying die news news inning inning controlling control beautiful beauti""".split()


def test_published_stems(spark):
    from millrace.operators.fulltext import stemmed

    pairs = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = {r.word: r.stem for r in stemmed(spark.createDataFrame([(w,) for w in pairs], "word string"), "word", "stem").collect()}
    assert {w: s for w, s in got.items() if pairs[w] != s} == {}


def test_web_queries():
    from millrace.operators.fulltext import parse

    assert parse("the Cat sat").alternatives == (((((("cat", 0),), (("sat", 0),))), ()),)
    (yes, no), (other, _) = parse('"out of office" -"big dog" -spam or e-mail').alternatives
    assert yes == ((("office", 0),),) and no == ((("big", 0), ("dog", 1)), (("spam", 0),)) and other == ((("e", 0), ("mail", 1)),)
    assert parse("-only").alternatives == () and parse('the "of"').alternatives == ()
    assert parse('"bank of england"').alternatives == ((((("bank", 0), ("england", 2)),), ()),)


def holds(units, entries):
    at = set(entries)
    return all(any(all((w, p + d) in at for w, d in u) for v, p in entries if v == u[0][0]) for u in units)


def plain_rank(words, query, weights):
    """All stretches are tried, from the shortest."""
    wanted = {w for yes, _ in query.alternatives for u in yes for w, _ in u}
    every = [(w, k) for k, w in enumerate(words)]
    live = [yes for yes, no in query.alternatives if holds(yes, every) and not any(holds([u], every) for u in no)]
    if not live:
        return None
    entries = [(w, k) for w, k in every if w in wanted]
    places = sorted({k for _, k in entries})
    found = []
    for width in range(len(places)):
        for i in range(len(places) - width):
            a, b = places[i], places[i + width]
            if not any(a <= x and y <= b for x, y in found) and any(holds(yes, [e for e in entries if a <= e[1] <= b]) for yes in live):
                found.append((a, b))
    total = 0.0
    for a, b in found:
        inside = [weights[k] for _, k in entries if a <= k <= b]
        total += len(inside) / sum(1 / x for x in inside) / (1 + (b - a) - (len(inside) - 1))
    return total


@pytest.mark.parametrize("seed", range(60))
def test_covers_equal_a_search_of_all_stretches(seed):
    from millrace.operators.fulltext import covers, density, parse

    rng = random.Random(seed)
    for text in ("a b", "a or b c", '"a b" c', '"a b" -d', '"a b" or "c a" -e', "a", "a b c d", '"a c b"'):
        words = [rng.choice("abcdexy") for _ in range(rng.randint(0, 40))]
        weights = [rng.choice([1.0, 0.4]) for _ in words]
        query = parse(text, stop=frozenset())
        places = {}
        for k, w in enumerate(words):
            places.setdefault(w, []).append((k, weights[k]))
        found = covers(places, query)
        want = plain_rank(words, query, weights)
        assert (density(found) if found else None) == (want if want is None else pytest.approx(want)), (words, text)


@pytest.mark.parametrize("config", ["english", "simple"])
def test_index_on_all_documents(spark, tmp_path, config):
    import regex

    from millrace.operators import fulltext as T

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "concat('Doc ', doc_id, ' the runs') AS title", "text")
    T.write_index(docs, str(tmp_path), "doc_id", "text", "title", config=config, buckets=8)
    own = {}
    for r in docs.collect():
        title, body = (regex.findall(T.WORD, (x or "").lower()) for x in (r.title, r.text))
        own[r.doc_id] = (title + body, [T.TITLE] * len(title) + [T.BODY] * len(body))
    vocabulary = spark.createDataFrame([(w,) for w in {w for x, _ in own.values() for w in x}], "word string")
    stem = {r.word: r.stem for r in T.stemmed(vocabulary, "word", "stem").collect()} if config == "english" else {}
    common = sorted(stem, key=lambda w: (-sum(w in x for x, _ in own.values()), w))[:40] if stem else []
    texts = ["doc run", '"doc 7" or running', "the of -in", '"of the" or doc -run'] + ([f'{common[1]} {common[3]}', f'"{common[2]} {common[0]}" or {common[5]} -{common[9]}'] if common else [])
    for text in texts:
        query, lists = T.lists_of(spark, str(tmp_path), text)
        want = {}
        for key, (words, weights) in own.items():
            kept = [stem.get(w, w) if w not in T.STOP or config == "simple" else "" for w in words]
            entries = {}
            for k, w in enumerate(kept):
                entries.setdefault(w, []).append((k, weights[k]))
            if all(len(p) < 25 for w, p in entries.items() if w in query.terms):
                rank = plain_rank(kept, query, weights)
                if rank is not None:
                    want[key] = round(rank, 9)
        hits = T.search(spark, str(tmp_path), text)
        got = {r.key: round(r["rank"], 9) for r in hits.collect()}
        assert {k: v for k, v in got.items() if k in want} == want, text
        assert set(query.terms) >= {r.stem for r in lists.select("stem").distinct().collect()}
        plan = lists._jdf.queryExecution().toString()
        assert not query.terms or re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*word", plan)
    assert T.search(spark, str(tmp_path), "nosuchword").count() == 0
    assert T.search(spark, str(tmp_path), "-the").count() == 0
