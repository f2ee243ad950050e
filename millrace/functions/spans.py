"""Extraction with claimed spans: rules say where they find what, and each stretch of a text belongs to one of them.

Rules are columns: a pattern's matches with their places, filtered by cues near them and turned into values. A rule has a
weight, and of overlapping matches those are kept that weigh most together, so that a ticket number is no phone and a date
within an address is no date. That choice is a pass over at most a few matches a text, in Arrow batches.

Most of a text can hold no match. Addresses, dates, amounts, phones, flights and numbers have a digit or an at sign and cross
neither line ends nor the signs < and >, which count as the ends of a text do; so they are sought in the stretches between those that have one,
put together line by line. Links, and numbers behind cues, are sought where the text has their first signs at all.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import number

CUE_CHARS = 60
# Currencies, months, names of help desks, words that stand near references.
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₺": "TRY", "₹": "INR", "¥": "JPY"}
CODES = "USD EUR GBP TRY INR JPY CHF CAD AUD AED SGD SEK NOK DKK PLN QAR SAR".split()
MONTHS = (
    "january jan ocak", "february feb şubat subat", "march mar mart", "april apr nisan", "may mayıs mayis", "june jun haziran", "july jul temmuz",
    "august aug ağustos agustos", "september sept sep eylül eylul", "october oct ekim", "november nov kasım kasim", "december dec aralık aralik",
)
DESKS = "support help cancel refund reservation booking customercare customer.care customerservice customer.service care service contact destek iletisim musteri rezervasyon".split()
BOOKING = r"\b(?:pnr|record locator|locator|booking|reservation|confirmation|itinerary|rezervasyon|buchung\w*|localizador|réservation)\b"
ORDER, INVOICE, TICKET = r"\b(?:order|sipariş|bestellung|pedido|commande|receipt)", r"\b(?:invoice|fatura|rechnung|factura|facture)", r"\b(?:e-?ticket|ticket|bilet|document number)"
#: Weights of the kinds: what is written in one way only outweighs what looks like many things.
WEIGHTS = {"doc_link": 95, "drive_file": 95, "link": 90, "email": 80, "ticket": 70, "order": 65, "invoice": 65, "date": 60, "amount": 60, "booking": 55, "code": 50, "phone": 40, "route": 35, "flight": 30}

_SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


#: Stretches between line ends, < and > that have a digit or an at sign; lines that have a digit.
PIECE = r"(?<![^\n<>])[^\n<>0-9@]*+[0-9@][^\n<>]*+"
LINE = r"(?<![^\n])[^\n0-9]*+[0-9][^\n]*+"
_PLACES = "array<struct<start:int,end:int,text:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(c: Column, pattern: str) -> Column:
    """All matches of a pattern as structs (start, end, text), from 0: places follow from the gaps between matches."""
    first = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_PLACES).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.length(x["text"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text")))
        return F.struct(end.alias("at"), F.coalesce(F.concat(s["out"], one), one).alias("out"))

    def places(found: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(c, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text")))
        return F.when(F.size(found) > 0, F.aggregate(pairs, first, step)["out"]).otherwise(F.array().cast(_PLACES))

    return _let(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), places)


def _spans(kind: str, matches: Column, value: object = None) -> Column:
    """Matches as spans of a kind; those whose value is null are left out."""
    make = value or (lambda t: t)
    every = F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), make(m["text"]).alias("value")))
    return F.filter(every, lambda s: s["value"].isNotNull())


def _ends(matches: Column, token: str) -> Column:
    """Of matches that begin at a cue the token at their end."""

    def tail(m: Column) -> Column:
        t = F.regexp_extract(m["text"], f"({token})$", 1)
        return F.struct((m["end"] - F.length(t)).alias("start"), m["end"].alias("end"), t.alias("text"))

    return F.transform(matches, tail)


def _near(matches: Column, cues: Column) -> Column:
    """Matches with a cue at most ``CUE_CHARS`` away."""
    apart = lambda m, q: F.greatest(m["start"] - q["end"], q["start"] - m["end"])
    return F.filter(matches, lambda m: F.exists(cues, lambda q: apart(m, q) <= CUE_CHARS))


_NAMES = "|".join(sorted((n for own in MONTHS for n in own.split()), key=lambda n: -len(n)))
_TIME = r"(?:(?:,? at | |[Tt])\d{1,2}[:.]\d{2}(?::\d{2})?(?: ?[ap]m)?)?"
DATE = rf"(?iu)(?<![\d.])(?:\d{{4}}-\d\d-\d\d|\d{{1,2}} (?:{_NAMES})\.?(?:,? (?:\d{{4}}|\d\d(?![:.\d])))?|\b(?:{_NAMES})\.? \d{{1,2}}(?![\d:.])(?:,? \d{{4}})?|\d{{1,2}}([/.])\d{{1,2}}\1(?:\d{{4}}|\d\d)){_TIME}(?![\d])"


def iso_date(t: Column, year: int) -> Column:
    """The date, with its time if it has one, in ISO form; null for dates that do not exist.

    Numbers alone are month and day unless the first is above 12; a missing year is ``year``; years of two digits up to 68
    are after 2000.
    """
    low = F.lower(t)
    name = F.regexp_extract(low, rf"({_NAMES})", 1)
    names = F.create_map(*[F.lit(x) for k, own in enumerate(MONTHS, 1) for n in own.split() for x in (n, k)])
    day_part = F.regexp_replace(low, rf"{_TIME}$", "")
    numbers = F.transform(F.regexp_extract_all(day_part, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    at = lambda k: F.get(numbers, F.lit(k))
    worded, iso = name != "", low.rlike(r"^\d{4}-")
    full = lambda y: F.when(y.isNull(), F.lit(year)).when(y >= 100, y).when(y <= 68, y + 2000).otherwise(y + 1900)
    swapped = at(0) > 12
    y = F.when(worded, full(at(1))).when(iso, at(0)).otherwise(full(at(2)))
    m = F.when(worded, names[name]).when(iso, at(1)).otherwise(F.when(swapped, at(1)).otherwise(at(0)))
    d = F.when(worded, at(0)).when(iso, at(2)).otherwise(F.when(swapped, at(0)).otherwise(at(1)))
    day = F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")))
    clock = F.regexp_extract(low, r"(\d{1,2})[:.](\d{2})(?::\d{2})?(?: ?([ap])m)?$", 0)
    clock = F.when(F.length(day_part) < F.length(low), clock).otherwise("")
    hour, minute = F.regexp_extract(clock, r"^(\d+)", 1).cast("int"), F.regexp_extract(clock, r"^\d+[:.](\d+)", 1).cast("int")
    half = F.regexp_extract(clock, "([ap])m$", 1)
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    timed = F.concat(day.cast("string"), F.format_string("T%02d:%02d", hour, minute))
    return F.when(clock == "", day.cast("string")).when((hour < 24) & (minute < 60), timed)


def candidates(cut: DataFrame, codes: Mapping[str, str], year: int) -> tuple[Column, Column]:
    """Of condensed texts all spans that any rule finds, not yet held against each other: those with places in the text, and those with places in ``dense``."""
    c, dense, lines = cut["c"], cut["dense"], cut["lines"]
    token = r"(?=[A-Z0-9-]*\d)[A-Z0-9][A-Z0-9-]{3,29}\b"
    after = lambda cue: _ends(located(c, rf"(?:(?iu){cue})[^\n]{{0,{CUE_CHARS}}}?\b{token}"), token)
    plain = r"\d{1,3}(?:[., ]\d{3})*(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d{1,2})?(?!\d)"
    money = rf"(?:(?:[{''.join(SIGNS)}]|\b(?:{'|'.join(CODES)})) ?(?:{plain})|(?<!\d)(?:{plain}) ?(?:(?:{'|'.join(CODES)})\b|[€£₺₹]))"
    signs = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    unit = lambda t: F.regexp_extract(t, rf"[{''.join(SIGNS)}]|[A-Z]{{3}}", 0)
    amount = lambda t: F.concat(F.coalesce(signs[unit(t)], unit(t)), F.lit(" "), F.format_string("%.2f", number(F.translate(F.regexp_extract(t, r"\d[\d., ]*\d|\d", 0), " ", ""))))
    digits = lambda t: F.regexp_replace(t, r"\D", "")
    phone = lambda t: F.when(F.length(digits(t)).between(9, 15) & ~t.rlike(r"^\d+$"), F.concat(F.when(t.startswith("+"), "+").otherwise(""), digits(t)))
    flight = lambda t: F.when(~t.rlike(r"^[AP]M ?\d{1,2}$"), F.concat(F.substring(t, 1, 2), F.regexp_replace(F.regexp_replace(t, r"^..\s?", ""), r"^0+(?=\d)", "")))
    ends = lambda t: F.regexp_extract_all(t, F.lit(r"\b[A-Z]{3}\b"), F.lit(0))
    route = lambda t: F.when(F.get(ends(t), F.lit(0)) != F.element_at(ends(t), -1), F.concat(F.get(ends(t), F.lit(0)), F.lit("→"), F.element_at(ends(t), -1)))
    bare = lambda t: F.regexp_replace(t, r"[.,;:!?)\]]+$", "")
    long = r"\b\d{3}[- ]?\d{10}\b"
    link = r"(?i)\bhttps?://[^\s<>\"')\]]+"
    none = F.array().cast(_SPAN)
    if_any = lambda sign, spans: F.when(sign, spans.cast(_SPAN)).otherwise(none)
    cued = lambda kind, cue: if_any(lines.rlike(f"(?iu){cue}"), _spans(kind, after(cue)))
    six = r"\b(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{6}\b"
    rules = [
        if_any(cut["linked"], _spans("doc_link", located(c, r"(?i)\bhttps?://docs\.google\.com/(?:document|spreadsheets|presentation|forms)/d/[\w/-]{10,}"), lambda t: F.concat(F.regexp_extract(t, r"com/(\w+)/d/", 1), F.lit(":"), F.regexp_extract(t, r"/d/(?:e/)?([\w-]+)", 1)))),
        if_any(cut["linked"], _spans("drive_file", located(c, r"(?i)\bhttps?://drive\.google\.com/(?:file/d/|open\?id=|drive/folders/)[\w-]{10,}"), lambda t: F.regexp_extract(t, r"([\w-]+)$", 1))),
        if_any(cut["linked"], _spans("link", located(c, link), bare)),
        F.when(dense.rlike(long), none).otherwise(cued("ticket", TICKET)),
        cued("order", ORDER),
        cued("invoice", INVOICE),
        if_any(dense.rlike(six), _spans("booking", _near(located(c, six), located(c, rf"(?iu){BOOKING}")))),
        *[_spans("code", located(c, rf"(?i){p}"), lambda t, name=name: F.concat(F.lit(f"{name}:"), F.upper(t))) for name, p in sorted(codes.items())],
        _spans("route", located(c, rf"\b[A-Z]{{3}} ?(?:→|->|[—–/-]|to) ?[A-Z]{{3}}\b|\([A-Z]{{3}}\)[^()\n]{{0,{CUE_CHARS}}}\([A-Z]{{3}}\)"), route),
    ]
    inner = [
        _spans("email", located(dense, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}\b"), F.lower),
        if_any(dense.rlike(long), _spans("ticket", located(dense, long), digits)),
        _spans("date", located(dense, DATE), lambda t: iso_date(t, year)),
        _spans("amount", located(dense, money), amount),
        _spans("phone", located(dense, r"(?<![\w.])\+?\d[\d ().-]{7,17}\d(?!\w)"), phone),
        _spans("flight", located(dense, r"\b[A-Z]{2} ?\d{1,4}\b"), flight),
    ]
    return tuple(F.concat(*[r.cast(_SPAN) for r in own]) for own in (rules, inner))


def heaviest(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The choice without overlaps that weighs most, of equal ones the one whose last span begins first."""
    own = sorted(set(spans), key=lambda s: (s[1], -s[0], s[2], s[3]))
    ends = [s[1] for s in own]
    best, take = [0], []
    for k, (start, _, kind, _) in enumerate(own):
        before = bisect_right(ends, start, 0, k)
        more = best[before] + WEIGHTS[kind]
        take.append((more > best[k], before))
        best.append(max(best[k], more))
    out, k = [], len(own)
    while k:
        taken, before = take[k - 1]
        if taken:
            out.append(own[k - 1])
        k = before if taken else k - 1
    return out[::-1]


def condensed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, c, linked, dense, lines, gaps, sizes): texts, whether a link may be in them, their pieces and their lines with a digit put
    together, the characters between pieces, and those of pieces."""
    c, pieces = F.col("c"), F.col("pieces")
    cut = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("c")).select("key", "c", F.regexp_extract_all("c", F.lit(PIECE), F.lit(0)).alias("pieces"))
    some = F.size(pieces) > 0
    gaps = F.when(some, F.transform(F.split(c, PIECE, -1), F.length))
    lines = F.when(some, F.array_join(F.regexp_extract_all(c, F.lit(LINE), F.lit(0)), "\n")).otherwise("")
    return cut.select("key", "c", c.rlike("(?i)http").alias("linked"), F.array_join(pieces, "\n").alias("dense"), lines.alias("lines"), gaps.alias("gaps"), F.transform(pieces, F.length).alias("sizes"))


def claimed(df: DataFrame, key: str, text: str, *, codes: Mapping[str, str] | None = None, year: int = 2024) -> DataFrame:
    """Rows (key, spans): the spans of a text in order, none of which overlap."""
    kind = dict(df.dtypes)[key]
    cut = condensed(df, key, text)
    whole, inner = candidates(cut, codes or {}, year)
    found = cut.select("key", whole.alias("spans"), inner.alias("inner"), "gaps", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, chosen = batch.column("spans"), []
            for own, inner, gaps, sizes in zip(column.to_pylist(), *(batch.column(x) for x in ("inner", "gaps", "sizes")), strict=True):
                spans = [tuple(x.values()) for x in own]
                if len(inner):
                    starts = [0, *accumulate(n + 1 for n in sizes.as_py())]
                    ahead = list(accumulate(n - (k > 0) for k, n in enumerate(gaps.as_py())))  # of its place among the pieces
                    for x in inner.as_py():
                        on = ahead[bisect_right(starts, x["start"]) - 1]
                        spans.append((x["start"] + on, x["end"] + on, x["kind"], x["value"]))
                chosen.append([dict(zip(("start", "end", "kind", "value"), s, strict=True)) for s in heaviest(spans)])
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "spans": pa.array(chosen, column.type)})

    return found.mapInArrow(run, f"key {kind}, spans {_SPAN}")


def fields(df: DataFrame, key: str, text: str, *, codes: Mapping[str, str] | None = None, year: int = 2024) -> DataFrame:
    """Rows (key, x): a struct with an array of different values for each kind in order of place, and the help desk's address.

    That is the first address whose local part begins with a desk's name, else the first one near a word like cancel.
    """
    spans = claimed(df, key, text, codes=codes, year=year)
    values = lambda k: F.array_distinct(F.transform(F.filter("spans", lambda s: s["kind"] == k), lambda s: s["value"])).alias(k)
    emails = F.filter("spans", lambda s: s["kind"] == "email")
    named = F.filter(emails, lambda s: s["value"].rlike(rf"^(?:{'|'.join(d.replace('.', '[.]') for d in DESKS)})"))
    desk = F.get(named, F.lit(0))["value"]
    return spans.select("key", F.struct(*[values(k) for k in sorted(WEIGHTS)], desk.alias("support")).alias("x"))
