"""Token counts of byte-level BPE by compiled finite-state transducers.

Two machines are compiled from the tokenizer file. The first is a deterministic automaton over character classes
that cuts a text into pre-tokens. Texts are laid side by side in chunks of equal length; each chunk is run from
every start state at once, which gives its state map, and the maps compose through a parallel prefix scan
(pointer doubling over an associative product), so that a very long text costs no more than many short ones.
The second is a transducer over the bytes of a pre-token. Its transitions carry the number of tokens that a byte
adds (or takes away): with the last token of each prefix known, the next prefix ends in the one token that may
follow its predecessor. States are made when they are first reached and forgotten when there are too many, so
that the machine stays bounded; counts of whole pre-tokens are remembered the same way. A pre-token of more than
400 bytes, a run of one kind of character, is counted prefix by prefix by the same rule without new states.

The strings of the file's special tokens count as one token wherever they stand, as the library does by default.
Defined cases: a null or empty text has no tokens; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, texts, tidy

#: Entries of each of the two generations of remembered pre-tokens, and states of the transducer.
GENERATION, STATES = 200_000, 400_000

# Character classes. The contraction letters have classes of their own, because 're, 've, 'll, 's, 't, 'm, 'd are
# pre-tokens where a quote begins one.
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, SINGLE, E, R, V, L = range(11)
_CLASSES = 11
# States: what the open pre-token is. Q: a quote that began it; QR, QV, QL: the quote and that letter.
START, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_BLANK, IN_SPACE, Q, QR, QV, QL, DONE = range(11)
_STATES = 11


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins before the character, by [class, state].

    White space needs its right neighbour: a run of it gives its last character to what follows if that character
    is a blank, and stands alone as a last pre-token otherwise. So does a quote with r, v or l, which needs one
    more letter to be a contraction. ``cuts_apart`` mends both from the neighbours.
    """
    step, begin = np.zeros((_CLASSES, _STATES), np.int8), np.zeros((_CLASSES, _STATES), bool)
    letters = {LETTER, SINGLE, E, R, V, L}
    for c in range(_CLASSES):
        for s in range(_STATES):
            if c in letters:
                if s == Q and c == SINGLE:
                    step[c, s] = DONE
                elif s == Q and c in (R, V, L):
                    step[c, s] = {R: QR, V: QV, L: QL}[c]
                elif (s in (QR, QV) and c == E) or (s == QL and c == L):
                    step[c, s] = DONE
                else:
                    step[c, s], begin[c, s] = IN_LETTER, s not in (IN_LETTER, AFTER_BLANK)
            elif c == NUMBER:
                step[c, s], begin[c, s] = IN_NUMBER, s not in (IN_NUMBER, AFTER_BLANK)
            elif c in (SPACE, BLANK):
                step[c, s] = AFTER_BLANK if c == BLANK else IN_SPACE
                begin[c, s] = s not in (AFTER_BLANK, IN_SPACE)
            elif c == QUOTE and s not in (IN_OTHER, AFTER_BLANK, Q):
                step[c, s], begin[c, s] = Q, True
            else:
                step[c, s], begin[c, s] = IN_OTHER, s not in (IN_OTHER, AFTER_BLANK, Q)
    return step, begin


_STEP, _BEGIN = _automaton()
_CLASS = np.zeros(0, np.uint8)


def _classes() -> np.ndarray:
    """Class of every code point, from the regular expression library's own properties."""
    global _CLASS
    if not len(_CLASS):
        import regex

        every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\x01" for i in range(sys.maxunicode + 1))
        table = np.full(len(every), OTHER, np.uint8)
        for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = c
        table[ord(" ")], table[ord("'")] = BLANK, QUOTE
        for x in "stmd":
            table[ord(x)] = SINGLE
        for x, c in zip("ervl", (E, R, V, L), strict=True):
            table[ord(x)] = c
        _CLASS = table
    return _CLASS


def _scan(maps: np.ndarray) -> np.ndarray:
    """Exclusive prefix compositions of state maps (chunks x states) by doubling."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.int64), axis=1)
        gap *= 2
    return np.concatenate([np.arange(_STATES, dtype=np.int8)[None], maps[:-1]])


def cuts_apart(glued: str, edges: np.ndarray, width: int = 512) -> np.ndarray:
    """Where pre-tokens begin in texts glued together, each text cut as if it stood alone."""
    codes = np.frombuffer(glued.encode("utf-32-le"), np.uint32)
    n = len(codes)
    kind = _classes()[codes]
    first = np.zeros(n, bool)
    first[edges[:-1]] = True
    # classes of first characters are shifted: whatever the state, they step as from the start
    step = np.concatenate([_STEP, np.repeat(_STEP[:, START : START + 1], _STATES, axis=1)]).reshape(-1)
    begin_of = np.concatenate([_BEGIN, np.ones((_CLASSES, _STATES), bool)]).reshape(-1)
    rows = -(-n // width)
    padded = np.full(rows * width, OTHER, np.int16)
    padded[:n] = kind + first * np.int16(_CLASSES)
    grid = np.ascontiguousarray(padded.reshape(rows, width).T) * np.int16(_STATES)
    state = np.broadcast_to(np.arange(_STATES, dtype=np.int16), (rows, _STATES))
    for column in grid:  # every chunk from every state
        state = step[column[:, None] + state]
    now = _scan(state)[:, START]
    begins = np.zeros((width, rows), bool)
    for k, column in enumerate(grid):  # every chunk from its true state
        at = column + now
        begins[k] = begin_of[at]
        now = step[at]
    begin = np.ascontiguousarray(begins.T).reshape(-1)[:n].copy()
    # the last character of white space before something else begins a pre-token of its own; a blank takes in
    # what follows, after other white space it begins anew
    space = (kind == SPACE) | (kind == BLANK)
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    begin[last] = True
    begin[last + 1] = kind[last] != BLANK
    # a quote and r, v or l without the letter that makes a contraction: the letters are a pre-token of their own
    quote = np.flatnonzero(begin & (kind == QUOTE))
    one, two = (np.minimum(quote + k, n - 1) for k in (1, 2))
    opened = (quote + 1 < n) & ~first[one] & np.isin(kind[one], (R, V, L))
    there = (quote + 2 < n) & ~first[two]
    joined = there & np.where(kind[one] == L, kind[two] == L, kind[two] == E)
    begin[one[opened & ~joined]] = True
    begin[two[opened & there & ~joined & np.isin(kind[two], (LETTER, SINGLE, E, R, V, L))]] = False
    return np.flatnonzero(begin)


class CountingTransducer:
    """Counts of tokens for pre-tokens, from a tokenizers file of byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalisation or a prefix space is supported")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        to_byte = {c: b for b, c in to_char.items()}
        specials = [t["content"] for t in spec["added_tokens"]]
        self.vocabulary = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in specials}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.rank = {tuple(bytes(to_byte[c] for c in x) for x in p): k for k, p in enumerate(pairs)}
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.longest = max(map(len, self.vocabulary))
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.forget()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def forget(self) -> None:
        """Begin the machine anew: by state, its transitions (state, added count), and the last token of its prefix."""
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, tokens: list[bytes]) -> list[bytes]:
        """The merges of a short run of tokens, best rank first."""
        rank = self.rank
        while len(tokens) > 1:
            best, at = min((rank.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)))
            if best == 1 << 60:
                break
            tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]
        return tokens

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded."""
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            found = self.follows[a, b] = self.merged([bytes([x]) for x in a + b]) == [a, b]
        return found

    def prefixes(self, word: bytes) -> list[tuple[int, bytes]]:
        """Count and last token of each prefix, the empty one first."""
        out: list[tuple[int, bytes]] = [(0, b"")]
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = word[begin:end]
                if token in self.vocabulary and (begin == 0 or self.may_follow(out[begin][1], token)):
                    out.append((out[begin][0] + 1, token))
                    break
            else:
                raise ValueError(f"no token ends the prefix {word[:end]!r}")
        return out

    def count(self, word: bytes) -> int:
        """Run the transducer over the word; missing transitions are compiled."""
        state, total, nexts = 0, 0, self.next
        for k, b in enumerate(word):
            step = nexts[state].get(b)
            if step is None:
                return total + self._compile(word, k, state)
            state, added = step
            total += added
        return total

    def _compile(self, word: bytes, known: int, state: int) -> int:
        prefixes = self.prefixes(word)
        done = prefixes[known][0]
        if len(self.next) > STATES:
            self.forget()
            known = state = 0
        for k in range(known, len(word)):
            self.next.append({})
            self.next[state][word[k]] = (len(self.next) - 1, prefixes[k + 1][0] - prefixes[k][0])
            state = len(self.next) - 1
        return prefixes[-1][0] - done

    def recall(self, wanted: set[str]) -> None:
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        missing = wanted - self.young.keys()
        if kept := missing & self.old.keys():
            self.young.update((x, self.old[x]) for x in kept)
            missing -= kept
        for x in missing:
            word = x.encode()
            if len(word) > 400:  # a run of one kind of character without end: the machine would grow with it
                self.young[x] = self.prefixes(word)[-1][0]
            else:
                self.young[x] = self.count(word)

    def counts(self, many: list[str]) -> list[int]:
        """Numbers of tokens of the texts; worked on together, so that short texts cost little."""
        parts: list[str] = []
        owner: list[int] = []
        total = [0] * len(many)
        for k, text in enumerate(many):
            pieces = self.special.split(text) if self.special else [text]
            total[k] += len(pieces) - 1
            for p in pieces:
                if p:
                    parts.append(p)
                    owner.append(k)
        if not parts:
            return total
        glued = "".join(parts)
        edges = np.cumsum([0, *map(len, parts)])
        begins = cuts_apart(glued, edges)
        ends = [*begins[1:].tolist(), len(glued)]
        words = [glued[a:b] for a, b in zip(begins.tolist(), ends, strict=True)]
        self.recall(set(words))
        numbers = np.fromiter(map(self.young.__getitem__, words), np.int64, len(words))
        sums = np.concatenate([[0], np.cumsum(numbers)])[np.searchsorted(begins, edges)]
        for k, n in zip(owner, np.diff(sums).tolist(), strict=True):
            total[k] += n
        return total


def _count(path: str, limit: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept("tokencount", path, lambda: CountingTransducer(path))
        for batch in batches:
            own, counts, group, held = texts(batch, text_col), [], [], 0
            for text in own:
                group.append(text)
                held += len(text)
                if held > 2_000_000:
                    counts += machine.counts(group)
                    group, held = [], 0
            counts += machine.counts(group)
            yield pa.RecordBatch.from_pydict({"doc": batch.column(id_col), "n_bytes": pa.array([len(x.encode()) for x in own], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([n > limit for n in counts], pa.bool_())})

    return run


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, n_bytes, n_tokens, over_limit) for every row; ``tokenizer`` is a file on every executor."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(_count(tokenizer, limit, id_col, text_col), "tokencount"), f"doc {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
