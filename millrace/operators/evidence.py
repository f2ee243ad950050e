"""Exact evidence of a hit, and names found by a table of aliases of any size.

An alias table has a row for each group: ``group``, its surface forms ``tokens``, the domains ``domains`` that it sends from
and patterns ``codes`` of its own numbers. Texts meet the table by equality of word sequences: of each text all sequences of
those lengths that aliases have become rows and join the aliases on the sequence, so that work grows with the texts and
not with texts times aliases, and no two aliases meet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ADDRESS, file_words, has_words, identifier, normalise, normalised
from ..sources.scratch import stored

EXACT_ID, EXACT_SENDER, EXACT_FILENAME, ALIAS_TOKEN = "EXACT_ID", "EXACT_SENDER", "EXACT_FILENAME", "ALIAS_TOKEN_IN_SUBJECT"
WIDE, NUMBERED = 1024, 100_000  # groups whose bits are in one row, groups that one task numbers
LEAST_ID = 8  # an identifier that a question contains by chance is shorter


@dataclass(frozen=True)
class Terms:
    """What a question names: ids, addresses, domains, file names, surface forms of groups, patterns of their codes."""

    text: str = ""
    ids: tuple[str, ...] = ()
    emails: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()


def surface_forms(aliases: DataFrame) -> DataFrame:
    """Rows (group, token): the normalised forms of two letters or more, each once."""
    return aliases.select("group", F.explode("tokens").alias("t")).select("group", normalise(F.col("t")).alias("token")).where(F.length("token") > 1).distinct()


def _sequences(texts: DataFrame, key: str, text: str, forms: DataFrame) -> DataFrame:
    """Rows (key, token): the word sequences of a text of those lengths that forms have, each once."""
    # the different numbers of words of forms, a few small numbers
    lengths = sorted(r.n for r in forms.select(F.size(F.split("token", " ")).alias("n")).distinct().collect())
    words = texts.select(F.col(key).alias("key"), F.split(normalise(F.col(text)), " ").alias("words")).where(F.array_max(F.transform("words", F.length)) > 0)
    sequences = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (n - 1))), lambda i: F.array_join(F.slice("words", i, n), " "))
    every = F.array_distinct(F.flatten(F.array(*[F.when(F.size("words") >= n, sequences(n)).otherwise(F.array().cast("array<string>")) for n in lengths]))) if lengths else F.array().cast("array<string>")
    return words.select("key", F.explode(every).alias("token"))


def alias_hits(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """Rows (key, group, token): every form of every group that stands in the text as whole words."""
    forms = stored(surface_forms(aliases), "forms")
    return _sequences(texts, key, text, forms).join(forms, "token").select("key", "group", "token")


def alias_counts(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """Rows (key, hits, groups): how many rows ``alias_hits`` has for a text, and of how many different groups.

    A form that many groups share meets a text once: its groups are bits of numbers, a row for each ``WIDE`` groups, and those of a text are united.
    """
    forms = stored(surface_forms(aliases), "forms")
    groups = forms.select("group").where("group IS NOT NULL").distinct()
    # numbered within parts of some ``NUMBERED``
    part = F.pmod(F.xxhash64("group"), F.lit(1 + groups.count() // NUMBERED))
    place = F.row_number().over(Window.partitionBy("part").orderBy("group")) - 1
    numbered = groups.withColumn("part", part).select("group", "part", place.alias("place"))
    word = F.expr("shiftleft(1L, place % 64)")
    bits = [f"b{i}" for i in range(WIDE // 64)]
    sets = forms.join(numbered, "group", "left").groupBy("token", "part", F.floor(F.col("place") / WIDE).alias("wide"))
    sets = stored(sets.agg(F.count("*").alias("hits"), *[F.coalesce(F.bit_or(F.when(F.floor(F.col("place") % WIDE / 64) == i, word)), F.lit(0)).alias(b) for i, b in enumerate(bits)]), "sets")
    met = _sequences(texts, key, text, forms).join(sets, "token")
    united = met.groupBy("key", "part", "wide").agg(F.sum("hits").alias("hits"), *[F.bit_or(b).alias(b) for b in bits])
    return united.groupBy("key").agg(F.sum("hits").alias("hits"), F.sum(reduce(lambda x, y: x + y, [F.bit_count(b) for b in bits])).cast("bigint").alias("groups"))


def longest_alias(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """Rows (key, group, token): the longest form in the text with its group; of equally long ones the first in order."""
    # of the groups that share a form only the first can be it; ids ascend in the order of choice, so that a text keeps one number
    first = surface_forms(aliases).groupBy("token").agg(F.min("group").alias("group"))
    forms = stored(first.orderBy(F.length("token").desc(), "token").withColumn("id", F.monotonically_increasing_id()), "forms")
    met = _sequences(texts, key, text, forms).join(forms.select("token", "id"), "token")
    return met.groupBy("key").agg(F.min("id").alias("id")).join(forms, "id").select("key", "group", "token")


def terms_of(question: str, aliases: DataFrame, *, ids: tuple[str, ...] = (), filenames: tuple[str, ...] = ()) -> Terms:
    """What a question names, with all forms, domains and codes of the groups that it names."""
    words = normalised(question).split(" ")
    said = {" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)} - {""}
    forms = F.transform("tokens", normalise)
    named = aliases.select("group", forms.alias("forms"), "tokens", "domains", "codes").where(F.arrays_overlap("forms", F.lit(sorted(said) or [""])))
    longest = lambda r: max((len(x) for x in r.forms if x in said and len(x) > 1), default=0)
    own = sorted((r for r in named.collect() if longest(r)), key=lambda r: (-longest(r), r.group))  # groups that one question names
    every = lambda c: tuple(dict.fromkeys(x for r in own for x in (r[c] or [])))
    found = dict.fromkeys(x.lower() for x in re.findall(ADDRESS, question))
    return Terms(question, ids, tuple(found), every("domains"), filenames, every("tokens"), every("codes"))


def flags(terms: Terms, *, ids: Column, sender: Column, title: Column, is_file: bool = False) -> Column:
    """The array of flags that a row earns: its ids, its sender's address, and its title or file name."""
    no, asked = F.lit(False), F.lit(normalised(terms.text))
    some = lambda conditions: reduce(lambda a, b: a | b, conditions, no)
    if terms.ids:
        by_id = F.arrays_overlap(ids, F.lit(list(terms.ids)))
    else:
        by_id = F.exists(ids, lambda x: (F.length(x) >= LEAST_ID) & F.contains(asked, normalise(x)))
    address = F.lower(F.trim(sender))
    domain = F.regexp_replace(F.substring_index(address, "@", -1), r"\.$", "")
    known = [domain == d.lower() for d in terms.domains] + [domain.endswith("." + d.lower()) for d in terms.domains]
    by_sender = some([address.isin(*[e.lower() for e in terms.emails]) if terms.emails else no, *known])
    name = normalise(title)
    out = [F.when(by_id, EXACT_ID), F.when(by_sender, EXACT_SENDER)]
    if is_file:
        stem = normalise(file_words(title))
        wanted = F.array(*[F.lit(normalised(x)) for x in terms.filenames]) if terms.filenames else F.array().cast("array<string>")
        named = lambda x: (x != "") & ((F.array_contains(wanted, x) & identifier(x)) | (x == asked) | (identifier(x) & has_words(asked, x)))
        out.append(F.when(named(name) | named(stem), EXACT_FILENAME))
    spoken = [has_words(name, F.lit(x)) for x in dict.fromkeys(map(normalised, terms.aliases)) if len(x) > 1]
    coded = [title.rlike(f"(?i){x}") for x in terms.codes]
    out.append(F.when(some([*spoken, *coded]), ALIAS_TOKEN))
    return F.array_compact(F.array(*out))
