"""Repair of conversations' turn structure with the fewest and cheapest edits.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turn. Every row is kept (0), given the role user or assistant (1) or deleted (2); empty turns may be
inserted anywhere (5). Blank rows and duplicates must be deleted, a truncated row that stays costs 5 more.

A backward dynamic program over rows and states of the grammar finds the least cost to go, then a walk forward takes
the edit of least initial (D, I, K, R) among those that keep to that cost. A state and an initial leave one way to go
(after system or assistant only user may follow, after user only assistant), so the audit alone fixes the repair.

In Spark: rows are numbered within their conversation (one shuffle, sorted), texts that a role repeats are found as the
least number by (conversation, role, digest), which is aggregated before it moves and joined back by (conversation,
number), so that no text makes a hot key. The program needs one letter of a row, its initial with its first fault. Letters
travel in chunks of 4,096 rows, and a whole conversation's take as much room as its audit does in the result. Cost
vectors relative to their least are few, hence steps of both passes are remembered, and a row is one look-up. The
edits go back to the rows in chunks too, ahead of their rows in the order of the second sort. The repaired text
is read as a stream: its digest is sequential, but a task holds one chunk of edits and one row of a conversation, however
long that is.

Defined cases: a null conversation id is a conversation of its own; a null role, text or turn counts as one blank where it
is read as text; null turns stand first; rows of one turn are ordered by role and text; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, tidy

KEEP, REROLE, DELETE, INSERT, STUMP = 0, 1, 2, 5, 5
CHUNK = 4096
BLANKS = r"[\x20\x09-\x0D]"

# States: nothing yet, after a system turn, after user, after assistant. What may follow, and where one may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
NEVER = 1 << 60
#: A letter of a row: its initial (s, u, a or another), and its first fault.
INITIALS, FAULTS = "sua-", ("", "blank", "duplicate", "truncated")


def _as_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` modulo 20 names.

    0 drops a row, 1 empties its text, 2 removes marks of sentence ends, 3 repeats it, 4 makes it the user's.
    """
    rows = rows.select("conv_id", "turn", _as_text("role").alias("role"), _as_text("text").alias("text"), (F.crc32(F.concat(_as_text("conv_id"), F.lit(":"), _as_text("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    rows = rows.where("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation in a partition sorted by conversation."""
    conv, at = object(), 0
    for batch in batches:
        numbers = []
        for c in batch.column("conv").to_pylist():
            at = at + 1 if c == conv else 0
            conv = c
            numbers.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "at"])


class Repairer:
    """Both passes over letters of rows; steps are made when they are first met."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.back: dict[tuple[int, int], tuple[int, int]] = {}
        self.ahead: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.last, self.least_of_end = self._name(self._with_inserts([0 if s in ENDS else NEVER for s in range(4)]))

    @staticmethod
    def _with_inserts(costs: list[int]) -> list[int]:
        costs = list(costs)
        for _ in range(4):
            for s in range(4):
                costs[s] = min(costs[s], *(INSERT + costs[t] for t in FOLLOWS[s].values() if t != SYSTEM))
        return costs

    def _name(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.known:
            self.known[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.known[vector], least

    @staticmethod
    def _edits(letter: int, state: int) -> Iterator[tuple[str, int, int]]:
        """(initial of the edit, its cost, next state) of the ways to deal with a row."""
        initial, fault = INITIALS[letter // 4], FAULTS[letter % 4]
        yield "D", DELETE, state
        if fault not in ("blank", "duplicate"):
            more = STUMP if fault == "truncated" else 0
            if initial in FOLLOWS[state]:
                yield "K", KEEP + more, FOLLOWS[state][initial]
            yield "R", REROLE + more, next(t for x, t in FOLLOWS[state].items() if x != "s")

    def step_back(self, vector: int, letter: int) -> tuple[int, int]:
        """The vector in front of a row with that letter, and what its least cost adds."""
        costs = self.vectors[vector]
        out = self._with_inserts([min(c + costs[t] for _, c, t in self._edits(letter, s)) for s in range(4)])
        self.back[vector, letter] = self._name(out)
        return self.back[vector, letter]

    def step_ahead(self, vector: int, letter: int, state: int) -> tuple[str, int]:
        """Edits from the state up to and with the row: the least initials that keep to the cost to go."""
        behind = self.vectors[vector]
        exact = [min(c + behind[t] for _, c, t in self._edits(letter, s)) for s in range(4)]
        costs = self._with_inserts(exact)
        key, out = (vector, letter, state), ""
        while True:
            ways = [(x, t, True) for x, c, t in self._edits(letter, state) if c + behind[t] == costs[state]]
            ways += [("I", t, False) for t in FOLLOWS[state].values() if t != SYSTEM and INSERT + costs[t] == costs[state]]
            edit, state, done = min(ways)
            out += edit
            if done:
                self.ahead[key] = out, state
                return self.ahead[key]

    def closing(self, state: int) -> str:
        """Inserts behind the last row."""
        out = ""
        while state not in ENDS:
            out, state = out + "I", next(t for t in FOLLOWS[state].values())
        return out

    def repair(self, letters: bytes) -> tuple[int, list[str]]:
        """Cost, and the edits up to each row and with it; what is inserted at the end belongs to the last row."""
        vector, cost = self.last, self.least_of_end
        behind = [0] * len(letters)
        back = self.back
        for k in range(len(letters) - 1, -1, -1):
            behind[k] = vector
            x = letters[k]
            vector, more = back.get((vector, x)) or self.step_back(vector, x)
            cost += more
        cost += self.vectors[vector][START]
        state, edits = START, []
        for k, x in enumerate(letters):
            done, state = self.ahead.get((behind[k], x, state)) or self.step_ahead(behind[k], x, state)
            edits.append(done)
        if edits:
            edits[-1] += self.closing(state)
        return cost, edits


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repairer = Repairer()
    for batch in batches:
        out: dict[str, list[Any]] = {k: [] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits")}
        for chunks in batch.column("letters").to_pylist():
            letters = "".join(chunks or []).encode()
            numbers = bytes(x - 65 for x in letters)
            cost, edits = repairer.repair(numbers)
            for k, fault in enumerate(FAULTS[1:], 1):
                out[fault].append(sum(numbers.count(4 * i + k) for i in range(4)))
            initials = "".join(INITIALS[x // 4] for x in numbers)
            right = sum(1 for x in zip(initials, initials[1:], strict=False) if x in {("s", "u"), ("u", "a"), ("a", "u")})
            out["illegal"].append(max(0, len(initials) - 1) - right)
            out["cost"].append(cost)
            out["audit"].append("".join(edits))
            out["edits"].append(["|".join(edits[k : k + CHUNK]) for k in range(0, len(edits), CHUNK)])
        columns = {k: pa.array(v, pa.list_(pa.string()) if k == "edits" else pa.string() if k == "audit" else pa.int64()) for k, v in out.items()}
        yield pa.RecordBatch.from_pydict({"conv": batch.column("conv")} | columns)


class _Rebuilt:
    """One conversation while its rows pass by."""

    def __init__(self, conv: Any, with_text: bool) -> None:
        self.conv, self.digest, self.state, self.lines = conv, hashlib.sha256(), START, 0
        self.text: list[str] | None = [] if with_text else None
        self.base, self.edits = 0, []
        self.turns, self.lowest, self.highest = 0, None, None

    def put(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        self.digest.update((b"\n" if self.lines else b"") + line.encode())
        self.lines += 1
        if self.text is not None:
            self.text.append(line)

    def put_next(self, text: str) -> None:
        """A turn of the role that must come next."""
        initial, self.state = next((x, t) for x, t in FOLLOWS[self.state].items() if x != "s")
        self.put("user" if initial == "u" else "assistant", text)

    def row(self, at: int, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.highest:
            self.turns, self.highest = self.turns + 1, turn
            self.lowest = turn if self.lowest is None else self.lowest
        for x in self.edits[at - self.base]:
            if x == "I":
                self.put_next("")
            elif x == "R":
                self.put_next(text)
            elif x == "K":
                self.state = FOLLOWS[self.state][role[:1]]
                self.put(role, text)

    def result(self) -> tuple:
        gaps = self.highest - self.lowest + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.digest.hexdigest(), None if self.text is None else "\n".join(self.text)


def _rebuild(with_text: bool, kind: pa.DataType):
    """Applies edits to the rows that follow them."""

    def as_batch(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_pydict({"conv": pa.array(columns[0], kind), "gaps": pa.array(columns[1], pa.int64()), "repaired_sha256": pa.array(columns[2], pa.string()), "repaired": pa.array(columns[3], pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Rebuilt | None = None
        for batch in batches:
            done = []
            for conv, at, edits, turn, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "at", "edits", "turn", "role", "text")), strict=True):
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.result())
                    now = _Rebuilt(conv, with_text)
                if edits is None:
                    now.row(at, turn, role, text)
                else:
                    now.base, now.edits = at, edits.split("|")
            if done:
                yield as_batch(done)
        if now:
            yield as_batch([now.result()])

    return run


def repair_conversations(rows: DataFrame, *, with_text: bool = False) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text): (conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256), with ``with_text`` also the repaired text.

    ``gaps`` counts turn numbers that are missing between the least and the greatest, the next three count rows by
    their first fault, ``illegal`` neighbouring roles that the grammar does not allow side by side.
    """
    kind = rows.schema["conv_id"].dataType
    turn = rows.schema["turn"].dataType.simpleString()
    rows = rows.select(F.col("conv_id").alias("conv"), "turn", _as_text("role").alias("role"), _as_text("text").alias("text"))
    numbered = rows.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    numbered = stored(numbered.mapInArrow(tidy(_number), f"conv {kind.simpleString()}, turn {turn}, role string, text string, at bigint"), "turns")

    digest = F.sha2("text", 256)
    first = numbered.groupBy("conv", "role", digest.alias("digest")).agg(F.min("at").alias("at")).select(F.col("conv").alias("c"), F.col("at").alias("a"))
    bare = F.regexp_replace("text", BLANKS, "")
    begin = F.substring("role", 1, 1)
    initial = F.when(begin == "s", 0).when(begin == "u", 1).when(begin == "a", 2).otherwise(3)
    light = numbered.select("conv", "at", initial.alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    light = light.join(first, light["conv"].eqNullSafe(first["c"]) & (light["at"] == first["a"]), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("a").isNull(), 2).when(F.col("truncated"), 3).otherwise(0)
    letter = F.char((65 + 4 * F.col("initial") + fault).cast("bigint"))
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    chunks = light.select("conv", "at", F.floor(F.col("at") / CHUNK).alias("chunk"), letter.alias("letter"))
    chunks = chunks.groupBy("conv", "chunk").agg(F.array_join(in_order("at", "letter"), "").alias("letters"))
    whole = chunks.groupBy("conv").agg(in_order("chunk", "letters").alias("letters"))
    counts = ", ".join(f"{x} bigint" for x in ("blank", "duplicate", "truncated", "illegal", "cost"))
    repaired = stored(whole.mapInArrow(tidy(_repair), f"conv {kind.simpleString()}, {counts}, audit string, edits array<string>"), "audits")

    heads = repaired.select("conv", F.posexplode("edits").alias("chunk", "edits")).select("conv", (F.col("chunk") * F.lit(CHUNK)).cast("bigint").alias("at"), "edits", F.lit(None).cast(turn).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = numbered.select("conv", "at", F.lit(None).cast("string").alias("edits"), "turn", "role", "text").unionByName(heads)
    both = both.repartition("conv").sortWithinPartitions("conv", "at", F.asc_nulls_last("edits"))
    texts = both.mapInArrow(tidy(_rebuild(with_text, to_arrow_type(kind))), f"conv {kind.simpleString()}, gaps bigint, repaired_sha256 string, repaired string")
    texts = texts.withColumnRenamed("conv", "c")
    out = repaired.join(texts, repaired["conv"].eqNullSafe(texts["c"]))
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", *(["repaired"] if with_text else []))


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """``repair_conversations`` of the damaged rows, with a row for every conversation of ``rows``.

    Where no row is left, the counts are 0, the audit is empty and the digest is that of an empty text.
    """
    out = repair_conversations(damaged(rows))
    every = rows.select("conv_id").distinct()
    out = every.join(out, every["conv_id"].eqNullSafe(out["conv"]), "left").drop("conv")
    return out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
