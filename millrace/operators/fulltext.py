"""Full text with positions: web-style queries, stems, an inverted index on disk, and rank by cover density.

An index has two tables below its path. ``postings`` has a row for each word of each text with all its places, dealt to
folders by the word's bucket and sorted by word and key; ranges of keys split the list of a word that most texts hold.
``words`` has each different word once with its stem, so that stems are worked out once a word and never joined to the
postings. A search looks up the words of the query's stems, then reads those words' lists: folders are chosen before
the scan, row groups by the words.

Rank: a cover is a shortest stretch of places that satisfies the query. It adds the harmonic mean of its weights over
1 + the number of other places in it. Titles weigh 1, bodies 0.4.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored

# Weights of a title and of a body; words that English indexes leave out.
TITLE, BODY = 1.0, 0.4
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
WORD = r"[\p{L}\p{N}]+"


def stemmed(df: DataFrame, word: str, out: str) -> DataFrame:
    """``df`` with the stem of a lower-case word: the Porter2 rules as columns. Words of two letters or less stay."""
    w, kept = "_w", F.length(word) > 2
    put = lambda d, c: d.withColumn(w, c)
    at = lambda n: F.substring(w, F.length(w) - n + 1, F.lit(n))
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    ends = lambda *x: F.col(w).rlike(f"({'|'.join(x)})$")
    vowel, region = "[aeiouy]", "^.*?[aeiouy][^aeiouy]"
    df = put(df, F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), "([aeiouy])y", "$1Y"))
    first = F.length(F.regexp_extract(w, "^(gener|commun|arsen)", 0))
    one = F.when(first > 0, first).when(F.col(w).rlike(region), F.length(F.regexp_extract(w, region, 0))).otherwise(F.length(w))
    df = df.withColumn("_r1", one)
    rest = F.substring(w, F.col("_r1") + 1, F.length(w))
    df = df.withColumn("_r2", F.when(rest.rlike(region), F.col("_r1") + F.length(F.regexp_extract(rest, region, 0))).otherwise(F.length(w)))
    in1 = lambda n: F.length(w) - n >= F.col("_r1")
    in2 = lambda n: F.length(w) - n >= F.col("_r2")
    df = put(df, F.regexp_replace(w, "('s'|'s|')$", ""))
    # plurals
    s_goes = F.col(w).rlike(f"{vowel}.+s$") & ~ends("us", "ss")
    df = put(df, F.when(ends("sses"), cut(2)).when(ends("ied", "ies"), F.when(F.length(w) > 4, cut(2)).otherwise(cut(1))).when(s_goes, cut(1)).otherwise(F.col(w)))
    stays = F.col(w).isin("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
    df = df.withColumn("_stays", stays)
    # past and gerund
    size = F.when(ends("eedly"), 5).when(ends("ingly"), 5).when(ends("edly"), 4).when(ends("eed"), 3).when(ends("ing"), 3).when(ends("ed"), 2).otherwise(0)
    df = df.withColumn("_n", size).withColumn("_b", F.substring(w, F.lit(1), F.length(w) - F.col("_n")))
    eed = ends("eed", "eedly")
    short = F.col("_b").rlike("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$") & (F.length("_b") <= F.col("_r1"))
    mended = F.when(F.col("_b").rlike("(at|bl|iz)$"), F.concat("_b", F.lit("e"))).when(F.col("_b").rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substring("_b", F.lit(1), F.length("_b") - 1)).when(short, F.concat("_b", F.lit("e"))).otherwise(F.col("_b"))
    changed = F.when(F.col("_stays") | (F.col("_n") == 0), F.col(w)).when(eed, F.when(F.length("_b") >= F.col("_r1"), F.concat("_b", F.lit("ee"))).otherwise(F.col(w))).when(F.col("_b").rlike(vowel), mended).otherwise(F.col(w))
    df = put(df, changed)
    df = put(df, F.when(~F.col("_stays") & F.col(w).rlike("^.+[^aeiouy][yY]$"), F.concat(cut(1), F.lit("i"))).otherwise(F.col(w)))
    # suffixes that become shorter ones; the longest that a word has decides
    swaps = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousness": "ous", "ousli": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "abli": "able", "entli": "ent", "fulli": "ful", "lessli": "less"}
    c = None
    for suffix in sorted({*swaps, "ogi", "li"}, key=lambda x: (-len(x), x)):
        n = len(suffix)
        if suffix == "ogi":
            new = F.when(in1(3) & F.substring(cut(3), -1, 1).eqNullSafe("l"), cut(1))
        elif suffix == "li":
            new = F.when(in1(2) & cut(2).rlike("[cdeghkmnrt]$"), cut(2))
        else:
            new = F.when(in1(n), F.concat(cut(n), F.lit(swaps[suffix])))
        c = (F.when if c is None else c.when)(at(n) == suffix, new.otherwise(F.col(w)))
    df = put(df, F.when(F.col("_stays"), F.col(w)).otherwise(c.otherwise(F.col(w))))
    c = None
    shorter = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    for suffix in sorted({*shorter, "ative"}, key=lambda x: (-len(x), x)):
        n = len(suffix)
        new = F.when(in2(5), cut(5)) if suffix == "ative" else F.when(in1(n), F.concat(cut(n), F.lit(shorter[suffix])))
        c = (F.when if c is None else c.when)(at(n) == suffix, new.otherwise(F.col(w)))
    df = put(df, F.when(F.col("_stays"), F.col(w)).otherwise(c.otherwise(F.col(w))))
    c = None
    for suffix in sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=lambda x: (-len(x), x)):
        n = len(suffix)
        ok = in2(n) & cut(3).rlike("[st]$") if suffix == "ion" else in2(n)
        c = (F.when if c is None else c.when)(at(n) == suffix, F.when(ok, cut(n)).otherwise(F.col(w)))
    df = put(df, F.when(F.col("_stays"), F.col(w)).otherwise(c.otherwise(F.col(w))))
    closed = cut(1).rlike("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
    e_goes = ends("e") & (in2(1) | (in1(1) & ~closed))
    l_goes = ends("ll") & in2(1)
    df = put(df, F.when(~F.col("_stays") & (e_goes | l_goes), cut(1)).otherwise(F.col(w)))
    odd = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    same = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
    special = F.when(F.col(word).isin(*same) | ~kept, F.col(word))
    for a, b in odd.items():
        special = special.when(F.col(word) == a, b)
    return df.withColumn(out, special.otherwise(F.lower(w))).drop(w, "_r1", "_r2", "_stays", "_n", "_b")


@dataclass(frozen=True)
class WebQuery:
    """Alternatives of units that must hold and units that must not; a unit is words at distances from its first place."""

    alternatives: tuple[tuple[tuple[tuple[tuple[str, int], ...], ...], tuple[tuple[tuple[str, int], ...], ...]], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({w for yes, no in self.alternatives for unit in (*yes, *no) for w, _ in unit})


def parse(text: str, *, stop: frozenset[str] = STOP) -> WebQuery:
    """Words stand together, ``or`` sets alternatives apart, quotes make phrases, a minus forbids.

    Words that are left out keep their place within a phrase. A word that white space does not cut but other signs do is a
    phrase. An alternative without a unit that must hold is left out.
    """
    import regex

    alternatives, yes, no = [], [], []
    for minus, phrase, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if plain.lower() == "or" and not minus:
            alternatives.append((tuple(yes), tuple(no)))
            yes, no = [], []
            continue
        words = regex.findall(WORD, (phrase or plain).lower())
        kept = [(w, k) for k, w in enumerate(words) if w not in stop]
        if kept:
            unit = tuple((w, k - kept[0][1]) for w, k in kept)
            (no if minus else yes).append(unit)
    alternatives.append((tuple(yes), tuple(no)))
    return WebQuery(tuple(a for a in alternatives if a[0]))


def covers(places: dict[str, list[tuple[int, float]]], query: WebQuery) -> list[tuple[int, int, list[float]]]:
    """Shortest stretches (first place, last place, weights of the query's words in it) that satisfy the query.

    ``places`` holds each word's places in order. What is forbidden decides whether a text matches at all: an
    alternative with a forbidden unit in the text makes no cover.
    """
    at = {w: {p for p, _ in own} for w, own in places.items()}

    def found(unit: tuple[tuple[str, int], ...]) -> list[tuple[int, int]]:
        head, rest = unit[0][0], unit[1:]
        return [(p, p + unit[-1][1]) for p, _ in places.get(head, []) if all(p + d in at.get(w, ()) for w, d in rest)]

    open_, needed = [], set()
    for yes, no in query.alternatives:
        units = [found(u) for u in yes]
        if all(units) and not any(found(u) for u in no):
            open_.append(units)
        needed |= {w for u in yes for w, _ in u}
    if not open_:
        return []
    entries = sorted({(p, weight) for w in needed for p, weight in places.get(w, [])})
    ends = sorted({e for units in open_ for u in units for _, e in u})
    pointer = [[0] * len(units) for units in open_]
    out, last, lo = [], -1, 0
    for end in ends:
        begin = -1
        for k, units in enumerate(open_):
            starts = []
            for j, u in enumerate(units):
                while pointer[k][j] < len(u) and u[pointer[k][j]][1] <= end:
                    pointer[k][j] += 1
                starts.append(u[pointer[k][j] - 1][0] if pointer[k][j] else -1)
            begin = max(begin, min(starts))
        if begin > last:
            last = begin
            while entries[lo][0] < begin:
                lo += 1
            hi = lo
            while hi < len(entries) and entries[hi][0] <= end:
                hi += 1
            out.append((begin, end, [x for _, x in entries[lo:hi]]))
    return out


def density(found: list[tuple[int, int, list[float]]]) -> float:
    """Sum over covers of the harmonic mean of the weights over 1 + the places that hold other words."""
    total = 0.0
    for begin, end, weights in found:
        noise = (end - begin) - (len(weights) - 1)
        total += len(weights) / sum(1 / x for x in weights) / (1 + max(noise, 0))
    return total


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def postings(df: DataFrame, key: str, title: str | None, body: str, stop: frozenset[str] = STOP) -> DataFrame:
    """Rows (word, key, places) with places in order as structs of place and weight; a body's come behind its title's."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORD), F.lit(0))
    heavy = lambda c, x: F.transform(words(c), lambda v: F.struct(v.alias("word"), F.lit(x).alias("weight")))
    every = F.concat(heavy(title, TITLE), heavy(body, BODY)) if title else heavy(body, BODY)
    rows = df.select(F.col(key).alias("key"), F.posexplode(every).alias("place", "w")).select("key", "place", "w.word", "w.weight")
    if stop:
        rows = rows.where(~F.col("word").isin(*sorted(stop)))
    # a text's places are in one partition: they are put together before they move
    return rows.groupBy("word", "key").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("places"))


def write_index(df: DataFrame, path: str, key: str, body: str, title: str | None = None, *, config: str = "english", buckets: int = 64) -> None:
    """The two tables of an index below ``path``. ``config`` is english (stems, no stop words) or simple."""
    if config not in ("english", "simple"):
        raise ValueError(f"no configuration {config!r}")
    lists = stored(postings(df, key, title, body, STOP if config == "english" else frozenset()), "postings")  # ranges are sampled from it
    lists = lists.withColumn("bucket", bucket_of(F.col("word"), buckets))
    lists.repartitionByRange("bucket", "word", "key").sortWithinPartitions("bucket", "word", "key").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    words = df.sparkSession.read.parquet(f"{path}/postings").groupBy("word").agg(F.count("*").alias("texts"))
    words = stemmed(words, "word", "stem") if config == "english" else words.withColumn("stem", F.col("word"))
    words.repartitionByRange("stem").sortWithinPartitions("stem").write.mode("overwrite").parquet(f"{path}/words")
    df.sparkSession.createDataFrame([(config, buckets)], "config string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def lists_of(spark: SparkSession, path: str, text: str) -> tuple[WebQuery, DataFrame]:
    """The parsed query with stems for words, and its words' lists (stem, key, places): nothing else is read."""
    about = spark.read.parquet(f"{path}/about").first()
    query = parse(text, stop=STOP if about.config == "english" else frozenset())
    terms = query.terms
    if about.config == "english" and terms:
        stem = dict(map(tuple, stemmed(spark.createDataFrame([(t,) for t in terms], "word string"), "word", "stem").collect()))
        named = lambda units: tuple(tuple((stem[w], k) for w, k in u) for u in units)
        query = WebQuery(tuple((named(yes), named(no)) for yes, no in query.alternatives))
    # a stem has as many words as it has forms
    forms = {r.word: r.stem for r in spark.read.parquet(f"{path}/words").where(F.col("stem").isin(*query.terms)).select("word", "stem").collect()}
    folders = sorted({r.b for r in spark.createDataFrame([(w,) for w in forms], "w string").select(bucket_of(F.col("w"), about.buckets).alias("b")).collect()})
    lists = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(*folders) & F.col("word").isin(*sorted(forms)))
    if not forms:
        return query, lists.select(F.col("word").alias("stem"), "key", "places").where("false")
    names = F.create_map(*[F.lit(x) for pair in sorted(forms.items()) for x in pair])
    return query, lists.select(names[F.col("word")].alias("stem"), "key", "places")


def search(spark: SparkSession, path: str, text: str, n: int | None = None) -> DataFrame:
    """Rows (key, rank) of the texts that match a web-style query, or the best ``n`` of them."""
    query, lists = lists_of(spark, path, text)
    grouped = lists.groupBy("key").agg(F.collect_list(F.struct("stem", "places")).alias("lists"))
    kind = dict(lists.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = []
            for own in batch.column("lists").to_pylist():
                places: dict[str, list[tuple[int, float]]] = {}
                for x in own:
                    places.setdefault(x["stem"], []).extend((p["place"], p["weight"]) for p in x["places"])
                found = covers({w: sorted(p) for w, p in places.items()}, query)
                ranks.append(density(found) if found else None)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "rank": pa.array(ranks, pa.float64())})

    hits = grouped.mapInArrow(run, f"key {kind}, rank double").where("rank IS NOT NULL")
    return hits if n is None else hits.orderBy(F.round("rank", 9).desc(), "key").limit(n)
