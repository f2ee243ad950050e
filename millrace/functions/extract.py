"""Information extraction: native patterns, and rules that weigh the distance to a cue in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import emails, number

CUE_CHARS = 60
#: Beginnings of words near which a code is a booking's.
BOOKING_STEMS = ("book", "buchung", "itinerar", "locator", "reserv", "réserv", "rezerv")
SUPPORT_NAMES = ("support", "help", "helpdesk", "service", "care", "kundenservice", "ayuda", "destek")
# Names of months.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "ocak": 1, "şubat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "eylül": 9, "ekim": 10, "kasım": 11, "aralık": 12,
}
_TOKEN = re.compile(r"[^\W_]+")
_AIRLINE = re.compile(r"[A-Z][A-Z0-9]|[0-9][A-Z]")


def _mixed(token: str) -> bool:
    return token.isascii() and token.isupper() and any(map(str.isdigit, token)) and any(map(str.isalpha, token))


def booking_code(text: str) -> str | None:
    """The upper-case token of six letters and digits, some of both, nearest to a booking word within ``CUE_CHARS``."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    cues = [(a, b) for a, b, t in tokens if t.lower().startswith(BOOKING_STEMS)]
    best: tuple[int, int, str] | None = None
    for a, b, t in tokens:
        if len(t) == 6 and _mixed(t) and cues:
            apart = min(max(a - d, c - b, 0) for c, d in cues)
            if apart <= CUE_CHARS and (best is None or apart < best[0]):
                best = apart, a, t
    return best[2] if best else None


def flights(text: str) -> list[str]:
    """Airline and number without leading zeros, each once; times of day and the booking code are none."""
    tokens, code, out = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)], booking_code(text), {}
    for k, (_, end, t) in enumerate(tokens):
        airline, digits = t[:2], t[2:]
        if not digits and k + 1 < len(tokens) and text[end : tokens[k + 1][0]] == " ":
            digits = tokens[k + 1][2]
        if t != code and _AIRLINE.fullmatch(airline) and airline not in ("AM", "PM") and digits.isascii() and digits.isdigit() and 0 < len(n := digits.lstrip("0")) <= 4:
            out[airline + n] = None
    return list(out)


def cue_rules(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, booking, flights): rules that weigh distances between matches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = b[text].fillna("")
            yield pd.DataFrame({key: b[key], "booking": t.map(booking_code), "flights": t.map(flights)})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, booking string, flights array<string>")


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def amounts(c: Column) -> Column:
    """Array of (currency, value) for amounts with a sign or code before or after them."""
    sign = F.regexp_extract_all(c, F.lit(r"(?:EUR|USD|GBP|TRY|[$€£₺]) ?\d[\d.,]*\d|\d[\d.,]*\d ?(?:EUR|USD|GBP|TRY|[$€£₺])"), F.lit(0))
    code = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"EUR|USD|GBP|TRY|[$€£₺]", 0), r"\$", "USD"), "€", "EUR"), "£", "GBP")
    return F.transform(sign, lambda x: F.struct(code(x).alias("currency"), number(F.regexp_extract(x, r"\d[\d.,]*\d", 0)).alias("value")))


def order_number(c: Column) -> Column:
    """The first token with a digit after an order or invoice cue, within 60 characters."""
    return _first(c, rf"(?i)\b(?:order|invoice|receipt)\b[^\n]{{0,{CUE_CHARS}}}?\b([A-Z0-9-]*\d[A-Z0-9-]*)\b")


def ticket_number(c: Column) -> Column:
    """Thirteen digits, the first three perhaps set apart; else the number that follows the word ticket."""
    long = F.regexp_replace(F.regexp_extract(c, r"(?<!\d)\d{3}[ -]?\d{10}(?!\d)", 0), "[ -]", "")
    return F.coalesce(F.nullif(long, F.lit("")), _first(c, rf"(?i)\be?-?ticket\b[^\n]{{0,{CUE_CHARS}}}?(?<!\d)(\d{{6,14}})(?!\d)"))


def route(c: Column) -> Column:
    """Origin and destination: AAA-BBB, or else names with (AAA) and then (BBB); they differ."""
    pairs = F.regexp_extract_all(c, F.lit(r"\b[A-Z]{3} ?(?:-|→|to) ?[A-Z]{3}\b"), F.lit(0))
    ends = F.transform(pairs, lambda x: F.struct(F.substring(x, 1, 3).alias("origin"), F.right(x, F.lit(3)).alias("destination")))
    named = F.regexp_extract_all(c, F.lit(rf"\([A-Z]{{3}}\)[^()\n]{{1,{CUE_CHARS}}}\([A-Z]{{3}}\)"), F.lit(0))
    more = F.transform(named, lambda x: F.struct(F.substring(x, 2, 3).alias("origin"), F.substring(F.right(x, F.lit(4)), 1, 3).alias("destination")))
    return F.get(F.filter(F.concat(ends, more), lambda e: e["origin"] != e["destination"]), F.lit(0))


def doc_links(c: Column) -> Column:
    """Kinds and ids of links to documents."""
    links = F.regexp_extract_all(c, F.lit(r"https?://[\w.-]+/(?:document|spreadsheets|presentation|file)/d/[\w-]{6,}"), F.lit(0))
    return F.transform(links, lambda x: F.struct(F.regexp_extract(x, r"/(document|spreadsheets|presentation|file)/d/", 1).alias("kind"), F.regexp_extract(x, r"/d/([\w-]+)", 1).alias("id")))


def dates(c: Column) -> Column:
    """ISO dates of a text, in order of their kinds: 2024-03-02, 2 March 2024 (English or Turkish), 02.03.2024; false ones are left out."""
    iso = F.regexp_extract_all(c, F.lit(r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"), F.lit(0))
    names = "|".join(MONTHS)
    month = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(f"{v:02d}"))])
    worded = F.regexp_extract_all(c, F.lit(rf"(?iu)(?<!\d)\d{{1,2}} (?:{names}) \d{{4}}(?!\d)"), F.lit(0))
    worded = F.transform(worded, lambda x: F.concat_ws("-", F.right(x, F.lit(4)), F.try_element_at(month, F.lower(F.split(x, " ")[1])), F.lpad(F.split(x, " ")[0], 2, "0")))
    dotted = F.regexp_extract_all(c, F.lit(r"(?<![\d.])\d{1,2}[./]\d{1,2}[./]\d{4}(?!\d)"), F.lit(0))
    dotted = F.transform(dotted, lambda x: F.concat_ws("-", F.right(x, F.lit(4)), F.lpad(F.split(x, "[./]")[1], 2, "0"), F.lpad(F.split(x, "[./]")[0], 2, "0")))
    sound = F.filter(F.concat(iso, worded, dotted), lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).isNotNull())
    return F.array_distinct(sound)


def support_address(c: Column) -> Column:
    """The first address whose local part names a help desk, else the first after a word that invites to write."""
    named = F.filter(emails(c), lambda x: F.substring_index(x, "@", 1).isin(*SUPPORT_NAMES))
    near = F.lower(_first(c, rf"(?i)\b(?:contact|questions?|reach us|write to)\b[^\n@]{{0,{CUE_CHARS}}}?([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}})"))
    return F.coalesce(F.get(named, F.lit(0)), near)


def alias_codes(c: Column, patterns: Mapping[str, str]) -> Column:
    """Array of (alias, code): what the pattern of each alias finds first."""
    found = F.array(*[F.struct(F.lit(name).alias("alias"), _first(c, rf"\b{p}\b", 0).alias("code")) for name, p in sorted(patterns.items())])
    return F.filter(found, lambda x: x["code"].isNotNull())


def distinctive(c: Column) -> Column:
    """Whether a text has a token that says what it is about: letters and digits together, or parts joined by signs."""
    tokens = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+(?:[-_/.][A-Za-z0-9]+)*"), F.lit(0))
    return F.exists(tokens, lambda t: (F.length(t) >= 4) & t.rlike("[0-9]") & (t.rlike("[A-Za-z]") | t.rlike("[-_/]")))


def extracted(c: Column) -> Column:
    """All native fields in one struct; ``missing`` names those without a value, which a caller's model may fill."""
    fields = {"order": order_number(c), "ticket": ticket_number(c), "support": support_address(c), "origin": route(c)["origin"], "date": F.get(dates(c), F.lit(0))}
    missing = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(k)) for k, v in fields.items()]))
    return F.struct(*[v.alias(k) for k, v in fields.items()], missing.alias("missing"))


#: Kinds of literals in a question, in this order; a stretch belongs to the first kind that takes it.
LITERALS = {
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "url": r"https?://\S+", "quoted": r"\"[^\"]+\"|“[^”]+”", "date": r"\d{4}-\d\d-\d\d", "amount": r"(?:EUR|USD|GBP|TRY|[$€£₺]) ?\d[\d.,]*", "file": r"[\w-]+\.(?:pdf|docx?|xlsx?|pptx?|txt|csv|png)",
    "ticket": r"\d{3}-?\d{10}", "time": r"\d{1,2}:\d\d", "reference": r"(?=\w*\d)[A-Z][A-Z0-9]{5}", "flight": r"[A-Z]{2} ?\d{1,4}", "hashtag": r"#\w+", "mention": r"@\w+", "number": r"\d+(?:[.,]\d+)?",
}
_LITERAL = re.compile("|".join(rf"(?P<{k}>(?<![\w@#]){p})" for k, p in LITERALS.items()))


def literals(question: str) -> dict[str, list[str]]:
    """What a question names outright, by kind."""
    out: dict[str, list[str]] = {}
    for m in _LITERAL.finditer(question):
        value = m[0].strip("\"“”").rstrip(".,;:!?)")
        if value not in out.setdefault(m.lastgroup, []):
            out[m.lastgroup].append(value)
    return out
