"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose union has the best score is merged
(the leftmost on ties), its neighbours' new pairs join the agenda, and stale entries are skipped. No piece of such
a vocabulary runs over a word start, so a text falls apart into segments that encode on their own; a bounded
two-generation memory keeps recent segments in each Python worker. Characters without a piece fall back to bytes.

In every Arrow batch the library encodes each new segment too, and each ``audit_every``-th text (by id) as a
whole, and decodes it; a difference fails the job rather than leaving wrong ids.

Defined cases: a null or empty text has only the end id, if asked for, and decodes to the empty text; very long
texts are worked on segment by segment; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, tidy

SPACE = "▁"
#: Entries of each of the two generations of a worker's memory.
GENERATION = 150_000
_NONE = float("inf")


class MergeModel:
    """A merge-type SentencePiece model: its pieces and scores, read through the library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {self.pieces[i]: (-sp.get_score(i), i) for i in plain}
        self.score = {p: s for p, (s, _) in self.rank.items()}
        self.id = {p: i for p, (_, i) in self.rank.items()}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score) or any("\n" in p and len(p) > 1 for p in self.score):
            raise ValueError("a piece of this vocabulary runs over a word start: segments would not be independent")
        if self.pieces[sp.encode("a")[0]][:1] != SPACE:
            raise ValueError("only models that put a space before the text are supported")
        self.find_segments = re.compile(self.segment_pattern()).findall
        #: Ids of a segment as decimal text, each after a blank; and of segments that decode to something else.
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.changed: dict[str, str] = {}

    def segment_pattern(self) -> str:
        """Segments end before a space, at a line break, and before signs that no piece has behind other characters."""
        cut = set("!\"#$%&()*+,-./:;<=>?@[]^_`{|}~")
        while bad := {b for p in self.score for a, b in zip(p, p[1:], strict=False) if b in cut and a not in cut and a != SPACE}:
            cut -= bad
        signs, rest = f"[{re.escape(''.join(sorted(cut)))}]" if cut else "(?!)", f"[^{SPACE}\n{re.escape(''.join(sorted(cut)))}]"
        return f"{SPACE}+(?:{signs}[^{SPACE}\n]*|{rest}*)|{signs}[^{SPACE}\n]*|{rest}+|\n"

    def encode_segment(self, text: str) -> list[int]:
        """Ids of one segment, by the agenda."""
        symbols = list(text)
        n, get = len(symbols), self.score.get
        if n <= 40:
            return self.ids_of(self.merge_short(symbols))
        agenda = [(s, i, i + 1, p) for i in range(n - 1) if (s := get(p := symbols[i] + symbols[i + 1])) is not None]
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            pop, push = heapq.heappop, heapq.heappush
            while agenda:
                _, left, right, piece = pop(agenda)
                a, b = symbols[left], symbols[right]
                if not a or not b or after[left] != right or len(a) + len(b) != len(piece):
                    continue
                symbols[left], symbols[right] = piece, ""
                after[left] = follow = after[right]
                if follow < n:
                    before[follow] = left
                    p = piece + symbols[follow]
                    if (s := get(p)) is not None:
                        push(agenda, (s, left, follow, p))
                if (lead := before[left]) >= 0:
                    p = symbols[lead] + piece
                    if (s := get(p)) is not None:
                        push(agenda, (s, lead, left, p))
        return self.ids_of(symbols)

    def merge_short(self, symbols: list[str]) -> list[str]:
        """The agenda of a short segment is a plain list by position: its minimum is found faster than a heap is kept."""
        get, none = self.score.get, _NONE
        agenda = [get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) is not none:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], none)
        return symbols

    def ids_of(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        ids = self.id
        for x in symbols:
            if x:
                if (i := ids.get(x)) is not None:
                    out.append(i)
                elif self.byte_id:
                    out.extend(self.byte_id[b] for b in x.encode())
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without the space that encoding put in front."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.id_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(decode_bytes(bytes(run)))
                run.clear()
            if i not in self.hidden:
                out.append(self.pieces[i])
        if run:
            out.append(decode_bytes(bytes(run)))
        text = "".join(out)
        return text.removeprefix(SPACE).replace(SPACE, " ")

    def segments(self, text: str) -> list[str]:
        """Parts of the text that encode on their own; the text begins with a space that is put in front."""
        return self.find_segments(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, wanted: set[str]) -> None:
        """Put the segments into the young generation, checked against the library."""
        new = list(wanted)
        own = [self.encode_segment(x) for x in new]
        # after a line break, whose byte or piece never merges, the library adds nothing to a segment
        theirs = self.library.encode(["\n" + x.replace(SPACE, " ") for x in new], num_threads=1)
        lead = len(self.library.encode("\n"))
        for x, ids, other in zip(new, own, theirs, strict=True):
            if ids != other[lead:]:
                raise ValueError(f"the library encodes {x!r} as {other[lead:]}, the agenda as {ids}")
            self.young[x] = "".join([f" {i}" for i in ids])
            if (decoded := self.decode_segment(ids)) != x.replace(SPACE, " "):
                self.changed[x] = decoded

    def decode_segment(self, ids: list[int]) -> str:
        """Text of a segment's ids with all of its spaces."""
        if self.id_byte.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        lead = self.library.encode("\n")[0]  # the mark of a space, which decoding takes away again
        return self.decode([lead, *ids])

    def recall(self, wanted: set[str]) -> None:
        """Bring all wanted segments into the young generation; the old one is forgotten when the young is full."""
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
            self.changed = {x: d for x, d in self.changed.items() if x in self.old}
        missing = wanted - self.young.keys()
        if kept := missing & self.old.keys():
            self.young.update((x, self.old[x]) for x in kept)
            missing -= kept
        if missing:
            self.learn(missing)


def decode_bytes(run: bytes) -> str:
    """Bytes as text; each byte that is not part of valid UTF-8 becomes U+FFFD, as in the library."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def _encode(path: str, add_end: bool, audit_every: int, with_text: bool, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept("sentencepiece", path, lambda: MergeModel(path))
        end = f" {m.end}" if add_end else ""
        for batch in batches:
            docs = batch.column(id_col).to_pylist()
            counts, id_hashes, text_hashes, decoded_texts, id_lists = [], [], [], [], []
            pending: list[list[str]] = []
            group: list[str] = []
            held = 0

            def flush() -> None:
                m.recall(set(chain.from_iterable(pending)))
                known = m.young
                for text, own in zip(group, pending, strict=True):
                    ids = "".join([known[x] for x in own])
                    n = ids.count(" ") + add_end
                    ids = (ids + end)[1:]
                    if not m.changed.keys().isdisjoint(own):
                        own = [m.changed.get(x, x) for x in own]
                    decoded = "".join(own).replace(SPACE, " ")[1:]  # without the space put in front
                    doc = docs[len(counts)]
                    if isinstance(doc, int) and doc % audit_every == 0:
                        theirs = m.library.encode(text, add_eos=add_end)
                        if " ".join(map(str, theirs)) != ids or m.library.decode(theirs) != decoded:
                            raise ValueError(f"the library encodes document {doc} otherwise")
                    counts.append(n)
                    id_hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_text:
                        decoded_texts.append(decoded)
                        id_lists.append([int(x) for x in ids.split()])
                pending.clear()
                group.clear()

            for text in batch.column(text_col).to_pylist():
                group.append(text or "")
                pending.append(m.segments(text or ""))
                held += len(text or "")
                if held > 1_000_000:
                    flush()
                    held = 0
            flush()
            out = {"doc": batch.column(id_col), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_hashes, pa.string()), "decoded_sha256": pa.array(text_hashes, pa.string())}
            if with_text:
                out |= {"ids": pa.array(id_lists, pa.list_(pa.int32())), "decoded": pa.array(decoded_texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode_decode(docs: DataFrame, model: str, *, add_end: bool = True, audit_every: int = 64, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, n_tokens, ids_sha256, decoded_sha256), with ``with_text`` also the ids and the decoded text.

    ``model`` is the path of a merge-type model on every executor. ``add_end`` appends the end id. Documents whose
    id ``audit_every`` divides are also encoded and decoded as a whole by the library and compared.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_text else "")
    return docs.select(id_col, text_col).mapInArrow(tidy(_encode(model, add_end, audit_every, with_text, id_col, text_col), "sentencepiece"), schema)
