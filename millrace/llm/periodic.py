"""Runs of repeating words by the linear method for tandem repeats: blocks, suffix tree, suffix-link walks.

A run is a stretch of words with smallest period q that no neighbouring word extends, at least 3 q and 24 words long. The
steps, over the word numbers of many stretches of text put side by side between marks that occur once:

1. Names of all strings of 1, 2, 4, ... words, sorted (``Names``): they give the suffix array, and the length to which two
   places agree, forwards or backwards, in one look-up for each power of two.
2. Blocks of the Lempel-Ziv factorisation: from each place the longest string that also begins earlier, by the nearest
   smaller neighbours in the suffix array. For each border of blocks and each period that can fit there, agreements
   forwards and backwards over the border give the squares that lie across it; together they cover the leftmost
   occurrence of every square (``covering``). Each is kept if its half is no power of a shorter word.
3. The suffix tree is held as intervals of the suffix array. From a covering square a walk along suffix links rotates it word
   by word, as far as the text goes on with its period; each place of the walk is an interval at the depth of twice the period.
   The different places are the complete vocabulary of squares (``vocabulary``).
4. The leaves below a place are the occurrences of its square. Occurrences of one period at neighbouring starts merge
   into a run (``runs``).

The text's words are cut before that into stretches in which a run can lie: of 8 words in a row within a run, the same
8 words stand elsewhere in the run, so where 8 words occur once in a document no run passes. Equal hashes of different
8 words only leave a stretch longer. Nothing shorter than 24 words is left, and each run lies in one stretch as a whole.

Documents are independent: one pass over the table without a shuffle. Memory is that of one slice of texts of about
2 MB, or of one longer text.

Defined cases: a null or empty text has no words and no runs; repeated rows give repeated results; ids are passed on as
they are, null ids too; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, tidy

LEAST_WORDS, LEAST_TIMES, GRAM = 24, 3, 8
Ints = np.ndarray


class Names:
    """Ranks of all strings of 2**k words, for each k until all are different; also the suffix array."""

    def __init__(self, words: Ints) -> None:
        n = self.n = len(words)
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
        self.levels = [rank.astype(np.int32)]
        width = 1
        while True:
            # a place whose string would leave the text is less than all that agree with it so far
            behind = np.full(n, -1, np.int64)
            behind[: max(0, n - width)] = rank[width:]
            key = rank * (n + 1) + behind + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if n else key
            if n and new[-1] == rank.max() == n - 1:
                break
            rank = np.empty(n, np.int64)
            rank[order] = new
            self.levels.append(rank.astype(np.int32))
            width *= 2
            if not n or new[-1] == n - 1:
                break
        self.order = np.argsort(rank, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)

    def ahead(self, a: Ints, b: Ints) -> Ints:
        """How many words agree from a and from b on."""
        a, b = a.copy(), b.copy()
        begin = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], 1 << k
            inside = np.flatnonzero((a + width <= self.n) & (b + width <= self.n))
            same = inside[level[a[inside]] == level[b[inside]]]
            a[same] += width
            b[same] += width
        return a - begin

    def behind(self, a: Ints, b: Ints) -> Ints:
        """How many words agree up to a and up to b, both included."""
        a, b = a + 1, b + 1
        end = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], 1 << k
            inside = np.flatnonzero((a >= width) & (b >= width))
            same = inside[level[a[inside] - width] == level[b[inside] - width]]
            a[same] -= width
            b[same] -= width
        return end - a

    def same(self, a: Ints, b: Ints, length: Ints) -> Ints:
        """Whether the strings of that length from a and from b are equal; both lie in the text."""
        out = np.zeros(len(a), bool)
        level = np.minimum(np.frexp(length.astype(np.float64))[1] - 1, len(self.levels) - 1)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            names, shift = self.levels[k], length[at] - (1 << k)
            x, y = a[at], b[at]
            ok = names[x] == names[y]
            if (shift > (1 << k)).any():  # deeper than the last level, where all names differ
                ok &= x == y
            else:
                ok &= names[x + shift] == names[y + shift]
            out[at] = ok
        return out


def _nearest_smaller(values: Ints) -> tuple[Ints, Ints]:
    """For each entry the nearest one to the left and to the right that is smaller, -1 where there is none."""
    left, right, stack = [-1] * len(values), [-1] * len(values), []
    for k, v in enumerate(values.tolist()):
        while stack and stack[-1][1] > v:
            right[stack.pop()[0]] = v
        left[k] = stack[-1][1] if stack else -1
        stack.append((k, v))
    return np.array(left, np.int64), np.array(right, np.int64)


def blocks(names: Names) -> Ints:
    """Where the blocks begin: each is the longest string that begins earlier too, or a new word."""
    n, order = names.n, names.order
    longest = np.zeros(n, np.int64)
    for other in _nearest_smaller(order):
        known = np.flatnonzero(other >= 0)
        longest[order[known]] = np.maximum(longest[order[known]], names.ahead(order[known], other[known]))
    step, at, out = np.maximum(longest, 1).tolist(), 0, []
    while at < n:
        out.append(at)
        at += step[at]
    return np.array(out, np.int64)


def _spread(first: Ints, counts: Ints) -> tuple[Ints, Ints]:
    """Index of the owner and 1, 2, ..., count for each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return first[owner], np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def covering(names: Names, begins: Ints) -> tuple[Ints, Ints]:
    """Squares (start, half) that cover the leftmost occurrence of every square."""
    n = names.n
    ends = np.append(begins[1:], n)
    size = ends - begins
    found = []
    # the centre lies in the block: words up to its end repeat behind it
    owner, half = _spread(np.arange(len(begins)), size)
    border = ends[owner]
    inside = border < n
    owner, half, border = owner[inside], half[inside], border[inside]
    other = border - half
    ahead = names.ahead(border, other)
    back = np.where(other > 0, names.behind(border - 1, np.maximum(other - 1, 0)), 0)
    start = np.maximum(other - back, other - half + 1)
    ok = (ahead + back >= half) & (ahead > 0)
    found.append((start[ok], half[ok]))
    # the centre lies in front of the block or the square goes over two blocks
    owner, half = _spread(np.arange(len(begins)), size + np.append(size[1:], 0))
    border = begins[owner]
    other = border + half
    inside = (other < n) & (border > 0)
    owner, half, border, other = owner[inside], half[inside], border[inside], other[inside]
    ahead, back = names.ahead(border, other), names.behind(border - 1, other - 1)
    start = np.maximum(border - back, border - half + 1)
    ok = (ahead + back >= half) & (ahead > 0) & (back > 0) & (start + half <= ends[owner])
    found.append((start[ok], half[ok]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def primitive(names: Names, start: Ints, half: Ints) -> Ints:
    """Whether the half is no power of a shorter word: no prime factor of its length divides it into equal parts."""
    ok, rest = np.ones(len(half), bool), half.copy()
    factor = 2
    while (rest > 1).any():
        if factor * factor > rest.max():
            prime = rest.copy()
            rest = np.ones_like(rest)
        else:
            prime = np.where(rest % factor == 0, factor, 1)
            while (more := rest % factor == 0).any():
                rest[more] //= factor
            factor += 1
        at = np.flatnonzero(ok & (prime > 1))
        period = half[at] // prime[at]
        ok[at] = names.ahead(start[at], start[at] + period) < 2 * half[at] - period
    return ok


def vocabulary(names: Names, start: Ints, half: Ints) -> tuple[Ints, Ints, Ints]:
    """Different places (first, behind, half) in the suffix tree of all rotations that the text goes on with.

    ``first`` to ``behind`` is the interval of the suffix array below the place.
    """
    steps = names.ahead(start, start + half) - half + 1
    owner, walk = _spread(np.arange(len(start)), steps)
    at, half = start[owner] + walk - 1, half[owner]
    leaf, depth = names.place[at], 2 * half
    seen = np.unique(leaf * (names.n + 1) + half, return_index=True)[1]
    at, half, leaf, depth = at[seen], half[seen], leaf[seen], depth[seen]

    def reach(sign: int) -> Ints:
        """How far leaves to one side agree to the depth, by steps that double and then halve."""
        far, step, growing = np.zeros(len(at), np.int64), np.ones(len(at), np.int64), np.ones(len(at), bool)
        while (step > 0).any():
            live = np.flatnonzero(step > 0)
            to = leaf[live] + sign * (far[live] + step[live])
            inside = (to >= 0) & (to < names.n)
            other = names.order[np.where(inside, to, 0)]
            inside &= other + depth[live] <= names.n
            ok = inside.copy()
            ok[inside] = names.same(at[live][inside], other[inside], depth[live][inside])
            far[live[ok]] += step[live[ok]]
            growing[live[~ok]] = False
            grow = growing[live]
            step[live] = np.where(grow, step[live] * 2, step[live] // 2)
        return far

    first, behind = leaf - reach(-1), leaf + reach(1) + 1
    _, one = np.unique(first * (names.n + 1) + half, return_index=True)
    return first[one], behind[one], half[one]


def runs(names: Names, first: Ints, behind: Ints, half: Ints) -> tuple[Ints, Ints, Ints]:
    """Runs (start, length, period) from all occurrences of the squares of a vocabulary."""
    owner, number = _spread(np.arange(len(half)), behind - first)
    at, period = names.order[first[owner] + number - 1], half[owner]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return at[begin], at[end] - at[begin] + 2 * period[begin], period[begin]


def find_runs(words: Ints) -> tuple[Ints, Ints, Ints]:
    """All runs (start, length, period) of at least ``LEAST_TIMES`` periods and ``LEAST_WORDS`` words."""
    if len(words) < LEAST_WORDS:
        return (np.zeros(0, np.int64),) * 3
    names = Names(words)
    start, half = covering(names, blocks(names))
    ok = primitive(names, start, half)
    start, length, period = runs(names, *vocabulary(names, start[ok], half[ok]))
    ok = (length >= LEAST_TIMES * period) & (length >= LEAST_WORDS)
    return start[ok], length[ok], period[ok]


def stretches(words: Ints, doc: Ints) -> tuple[Ints, Ints]:
    """Stretches (begin, end) of documents put side by side in which runs can lie."""
    n = len(words)
    if n < LEAST_WORDS:
        return (np.zeros(0, np.int64),) * 2
    hashed = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed += words[k : n - GRAM + 1 + k].astype(np.uint64) + np.uint64(1)
    hashed ^= hashed >> np.uint64(29)
    hashed += doc[: len(hashed)].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    whole = doc[: len(hashed)] == doc[GRAM - 1 :]
    order = np.argsort(hashed)
    equal = hashed[order[1:]] == hashed[order[:-1]]
    twice = np.zeros(len(hashed), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    twice &= whole
    edge = np.flatnonzero(np.diff(np.concatenate([[0], twice.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2] + GRAM - 1
    # neighbouring documents are apart: where one's last 8 words end, the next one's first begin 8 words later
    ok = end - begin >= LEAST_WORDS
    return begin[ok], end[ok]


def runs_of_documents(numbers: list[Ints]) -> list[tuple[Ints, Ints, Ints]]:
    """Runs of each document, from the numbers of its words."""
    sizes = np.array([len(x) for x in numbers], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = stretches(words, doc)
    none = np.zeros(0, np.int64)
    if not len(begin):
        return [(none, none, none)] * len(numbers)
    # side by side, each behind a mark that occurs once
    owner, number = _spread(np.arange(len(begin)), end - begin + 1)
    source = begin[owner] + number - 2
    side = np.where(number == 1, -1 - owner, words[np.maximum(source, 0)])
    start, length, period = find_runs(side)
    at = source[start]
    where = np.searchsorted(edges, at, side="right") - 1
    order = np.lexsort((period, at))
    at, length, period, where = at[order], length[order], period[order], where[order]
    cut = np.searchsorted(where, np.arange(len(numbers) + 1))
    return [(at[a:b] - e, length[a:b], period[a:b]) for a, b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), edges[:-1].tolist(), strict=True)]


def looped(doc: Any, words: list[bytes]) -> list[bytes]:
    """Words of a document whose number's crc32 ends in 0 go in circles from one place on; other documents stay."""
    if doc is None or not words:
        return words
    hashed = zlib.crc32(str(doc).encode())
    g = hashed // 10
    if hashed % 10:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    circle = words[a : a + p]
    return (words[:a] + circle * (-(-(n - a) // p)))[:n]


def _summary(words: list[bytes], own: tuple[Ints, Ints, Ints], with_runs: bool) -> tuple:
    rows = list(zip(*(x.tolist() for x in own), strict=True))
    best: tuple | None = None
    for s, n, q in rows:
        if best is None or n * best[2] > best[1] * q:  # rows come by start and period
            best = (s, n, q)
    if rows:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, n, q in rows:
            drop[s + q] += 1
            drop[s + n] -= 1
        gone = np.cumsum(drop) > 0
        words = [w for w, x in zip(words, gone.tolist(), strict=False) if not x]
    collapsed = b" ".join(words)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    start, length, period = best or (None, None, None)
    milli = None if best is None else 1000 * length // period
    out = (len(rows), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
    return (*out, [{"start": s, "length": n, "period": q} for s, n, q in rows], collapsed.decode()) if with_runs else out


def _detect(prepare: Callable[[Any, list[bytes]], list[bytes]] | None, with_runs: bool, id_col: str, text_col: str):
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    if with_runs:
        names += ["runs", "collapsed"]
        kinds += [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, text_col, 2 << 20):
                part = batch.slice(a, b - a)
                docs = part.column(id_col)
                split = [(x or b"").split() for x in part.column(text_col).cast(pa.binary()).to_pylist()]  # bytes split at \x20 and \x09-\x0D
                if prepare:
                    split = [prepare(d, x) for d, x in zip(docs.to_pylist(), split, strict=True)]
                known: dict[bytes, int] = {}
                number = known.setdefault
                numbers = [np.fromiter((number(w, len(known)) for w in x), np.int64, len(x)) for x in split]
                found = runs_of_documents(numbers)
                rows = [_summary(x, r, with_runs) for x, r in zip(split, found, strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([docs, *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc", *names])

    return run


def periodic_runs(docs: DataFrame, *, prepare: Callable[[Any, list[bytes]], list[bytes]] | None = None, with_runs: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (doc, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), with ``with_runs``
    also the runs and the text in which each run is cut to its first period.

    The four numbers are those of the run with the most periods. ``prepare`` may change a document's words first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    if with_runs:
        schema += ", runs array<struct<start bigint, length bigint, period bigint>>, collapsed string"
    return docs.select(id_col, text_col).mapInArrow(tidy(_detect(prepare, with_runs, id_col, text_col), "periodic"), schema)
