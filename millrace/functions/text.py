"""Text functions as columns: cleaning, normalising, words, sizes, and a chunker for Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words without a topic.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "what", "when", "where", "which", "who", "with")


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII that fold to letters and digits a to z, 0 to 9: those that fold to one, and to several (or a blank).

    Folding is compatibility decomposition without combining marks, then case folding; the dotless i counts as i.
    """
    one, several = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).replace("ı", "i").casefold()
        plain = "".join(x if x.isascii() and x.isalnum() else " " for x in bare)
        if not bare:
            several[c] = ""  # a combining mark
        elif plain.strip() and bare != c:
            (one if len(plain) == 1 else several)[c] = plain
    return one, several


ONE, SEVERAL = _folds()


def _class(characters: dict[str, str]) -> str:
    """The characters as ranges of a character class."""
    codes, out = sorted(map(ord, characters)), []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in out)


def _fold_with(c: Column, one: dict[str, str], several: dict[str, str]) -> Column:
    single = F.translate(c, "".join(one), "".join(one.values()))
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in several.items())), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(single, ""), lambda x: F.when(x.rlike(f"^[{_class(several)}]$"), table[x]).otherwise(x)), "")
    return F.lower(F.when(c.rlike(f"[{_class(several)}]"), spelled).otherwise(single))


def folded(c: Column) -> Column:
    """Lower case without accents, marks and ligatures, as far as that leaves letters and digits of ASCII.

    Texts of ASCII or of Latin letters only have shorter ways.
    """
    latin = lambda d: {k: v for k, v in d.items() if k < "\u0250"}
    few = F.when(~c.rlike("[^\\x00-\\u024F]"), _fold_with(c, latin(ONE), latin(SEVERAL)))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(few.otherwise(_fold_with(c, ONE, SEVERAL)))


def flat(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise(c: Column) -> Column:
    """Folded, everything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(folded(c), "[^a-z0-9]+", " "))


def normalised(text: str) -> str:
    """``normalise`` of a constant."""
    bare = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x)).replace("ı", "i").casefold()
    return re.sub("[^a-z0-9]+", " ", bare).strip()


def has_words(text: Column, words: Column) -> Column:
    """Whether normalised words stand in a normalised text as whole words."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), words, F.lit(" ")))


def strip_html(c: Column) -> Column:
    """Text of HTML: no scripts, styles, comments or tags; the common entities as characters."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return flat(out)


def clean_mail(c: Column, least_before_signature: int = 40) -> Column:
    """The text before the first quoted reply, or before a signature with enough text in front of it."""
    quote = F.regexp_instr(c, F.lit(r"(?m)^(On .{3,80} wrote:|-{3,} ?Original Message|>)"))
    head = F.when(quote > 0, F.substring(c, F.lit(1), quote - 1)).otherwise(c)
    sign = F.regexp_instr(head, F.lit(r"(?m)^-- ?$"))
    return F.regexp_replace(F.when(sign > least_before_signature, F.substring(head, F.lit(1), sign - 1)).otherwise(head), r"^\s+|\s+$", "")


# Lines that begin a quoted thread, a signature or a footer, and marks of links that only track.
QUOTES = (r"On .{3,120} wrote:", r"-{2,} ?Original Message.*", r"-{2,} ?Forwarded message.*", r"_{10,}", r"From: .*")
SIGNATURES = (r"--[ \t]?", r"[ \t]*Sent from my (?:iPhone|iPad|Android|Samsung|BlackBerry|mobile).*", r"[ \t]*Get Outlook for (?:iOS|Android).*")
FOOTERS = ("unsubscribe", "view this email in your browser", "view it in your browser", "this e-?mail was sent to", "this message was sent to", "you are receiving this", "you received this", "manage (?:your )?(?:email )?preferences", "all rights reserved", "confidential(?:ity)? notice")
TRACKERS = (r"utm_[a-z]+=", "/track/", "/o/", "/wf/click", r"list-manage\.com", r"sendgrid\.net", "mailchimp")


def tidy_lines(c: Column) -> Column:
    """Line ends as \\n, no zero-width spaces and soft hyphens, no blanks before a line end, at most one empty line, none at the ends."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[\u200B\u00AD]", "")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def before_line(c: Column, patterns: tuple[str, ...], least: Column | None = None) -> Column:
    """The text before the first whole line that one of the patterns describes, if at least ``least`` characters stand before it."""
    at = F.regexp_instr(c, F.lit(rf"(?im)^(?:{'|'.join(patterns)})$"))
    goes = at > 0
    return F.when(goes if least is None else goes & (at - 1 >= least), F.substring(c, F.lit(1), at - 1)).otherwise(c)


def ingested_mail(c: Column, most: int = 40_000) -> Column:
    """What somebody wrote in a mail: no quoted thread, signature, footer or tracking links.

    A footer is one only behind 80 characters and 55 percent of the text. Beyond ``most`` characters the text ends with the last whole word.
    """
    c = tidy_lines(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(before_line(c, QUOTES), r"(?m)^[ \t]*>.*(?:\n|\z)", "")
    c = before_line(c, SIGNATURES)
    c = before_line(c, tuple(rf".{{0,120}}\b{x}\b.{{0,200}}" for x in FOOTERS), F.greatest(F.lit(80), F.floor(F.length(c) * 0.55)))
    c = tidy_lines(F.regexp_replace(c, rf"(?i)https?://\S*?(?:{'|'.join(TRACKERS)})\S*", ""))
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, F.lit(1), F.lit(most)), r" [^ ]*\z", ""), F.lit(" ..."))).otherwise(c)


def file_words(name: Column) -> Column:
    """Words of a file name: no extension, camel case and punctuation taken apart."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    apart = F.regexp_replace(F.regexp_replace(stem, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]+", " ")
    return F.lower(flat(apart))


def clip(c: Column, n: int) -> Column:
    """At most ``n`` characters, an ellipsis in place of the rest."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def topic_words(c: Column) -> Column:
    words = F.filter(F.split(normalise(c), " "), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))
    return F.array_except(words, F.lit(list(STOP_WORDS)))


def identifier(c: Column) -> Column:
    """Whether a name says enough to be exact: two words, or a digit."""
    return (F.size(F.split(flat(c), " ")) >= 2) | c.rlike("[0-9]")


def number(c: Column) -> Column:
    """1.234,56 and 1,234.56 as doubles: the last separator is the decimal one if one or two digits follow it."""
    comma, dot = F.length(c) - F.instr(F.reverse(c), ","), F.length(c) - F.instr(F.reverse(c), ".")
    decimal_comma = (F.instr(c, ",") > 0) & ((F.instr(c, ".") == 0) | (comma > dot)) & c.rlike(r",\d{1,2}$")
    swapped = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(decimal_comma, swapped).otherwise(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")


def size_text(c: Column) -> Column:
    """Bytes in the largest unit that leaves a number of 1 or more, cut to one decimal."""
    return F.when(c < 1024, F.format_string("%d B", c)).when(c < 1 << 20, F.format_string("%.1f KB", F.floor(c / 102.4) / 10)).when(c < 1 << 30, F.format_string("%.1f MB", F.floor(c / 104857.6) / 10)).otherwise(F.format_string("%.1f GB", F.floor(c / 107374182.4) / 10))


def fingerprint(c: Column, namespace: str) -> Column:
    """UUID version 5 of a text in a namespace (32 hexadecimal digits), from SHA-1 with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), c.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("bigint").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def emails(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(ADDRESS), F.lit(0)), F.lower))


def urls(c: Column) -> Column:
    """Web addresses up to a blank, without signs that close a sentence, a bracket, a quotation or a tag."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"https?://\S+"), F.lit(0)), lambda x: F.regexp_replace(F.regexp_extract(x, "[^<>\"]+", 0), r"[]).,;:!?']+$", ""))
    return F.array_distinct(F.filter(found, lambda x: ~x.endswith("/") | (F.length(x) > 8)))


def phones(c: Column) -> Column:
    """Three or more groups of digits with one sign between them, 9 to 15 digits in all."""
    groups = F.regexp_extract_all(c, F.lit(r"(?:\+|\()?\d+(?:\)? |\)|[. -]\(?)\d+(?:[. -]\d+)+"), F.lit(0))
    return F.array_distinct(F.filter(groups, lambda x: F.length(F.regexp_replace(x, r"\D", "")).between(9, 15)))


def pieces(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters along paragraphs, sentences and words, each with the end of the one before."""
    units = [text]
    for pattern in (r"(?<=\n\n)", r"(?<=[.!?]) ", r"(?<= )"):
        units = [p for u in units for p in ([u] if len(u) <= size - overlap else re.split(pattern, u)) if p]
    units = [u[i : i + size - overlap] for u in units for i in range(0, len(u), size - overlap)]
    out: list[str] = []
    held = ""
    for u in units:
        if held and len(held) + len(u) > size:
            out.append(held)
            held = held[-overlap:] if overlap else ""
        held += u
    return [*out, held] if held.strip() else out


def chunks(df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """Rows (key, position, chunk). The cut depends on all before it, so that it is made in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(chunk=[pieces(t or "", size, overlap) for t in b[text]])
            yield b[[key, "chunk"]]

    kind = dict(df.dtypes)[key]
    cut = df.select(key, text).mapInPandas(run, f"{key} {kind}, chunk array<string>")
    return cut.select(key, F.posexplode("chunk").alias("position", "chunk"))
