"""Packing and conversation repair against plain versions of both."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

SMALL = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= x]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - x)
        else:
            n += 1
            rooms.append(capacity - x)
    return n


@pytest.mark.parametrize("seed", range(20))
def test_plan_equals_best_fit_piece_by_piece(seed):
    from millrace.llm.packing import plan

    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 30, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))] + [rng.randint(1, capacity)] * rng.randint(0, 200)
    lines, sequences = plan(dict(Counter(lengths)), capacity)
    assert sequences == best_fit(lengths, capacity)
    filled, ranks = defaultdict(list), defaultdict(list)
    for n, a, b, each, first, place in lines:
        ranks[n] += range(a, b)
        for k in range(b - a):
            filled[first + k // each].append((place + k % each * n, n))
    assert {n: len(r) for n, r in ranks.items()} == Counter(lengths) and all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for own in filled.values():
        at = 0
        for place, n in sorted(own):
            assert place == at
            at += n
        assert at <= capacity


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first, at, piece = len(ids) % capacity or capacity, 0, 0
        while at < len(ids):
            n = first if at == 0 else capacity
            want[doc, piece, at, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + n]))] += 1
            at, piece = at + n, piece + 1
    assert Counter((r.doc, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    lengths = [n for (_, _, _, n, _), k in want.items() for _ in range(k)]
    assert len(by_sequence) == best_fit(lengths, capacity) >= -(-sum(lengths) // capacity)


def test_packing_of_documents_and_odd_rows(spark, odd, odd_rows, none):
    from millrace.llm.packing import pack, token_pieces

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = pack(token_pieces(docs, BYTES)).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 1024)
    rows = pack(token_pieces(odd, BYTES, capacity=64, audit_every=1), capacity=64).collect()
    check_packing(rows, [(r[0], r[1]) for r in odd_rows], 64)
    assert pack(token_pieces(none, BYTES)).count() == 0
    ids = token_pieces(odd.where("doc_id = 6"), BYTES, with_ids=True).select("ids").first().ids
    assert ids[-1] == 2


def test_pre_tokens_equal_the_library():
    from millrace.llm.packing import Ids

    ids, rng = Ids(BYTES), random.Random(4)
    letters = "ab'sdvlreT19 \n\t\r  ½²٣日本\x1c\x85 !?😀Ǆé́_-<|endoftext|>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) + rng.choice(["", "<|endoftext|>", "don't 'LL 've"])
        assert ids.of_texts([text])[0] == ids.whole(text), text


def test_one_length_of_many_rows_is_ranked_in_blocks(spark, monkeypatch):
    from millrace.llm import packing

    monkeypatch.setattr(packing, "BLOCK", 16)
    rows = packing.pack(spark.range(1000).selectExpr("id as doc", "if(id % 3 = 0, 5L, 1 + id % 9) as length"), capacity=10).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 1000
    assert max(r.offset + r.length for r in rows) <= 10


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_search(rows):
    """Least cost and least audit of all edits, by uniform-cost search over whole audits."""
    import heapq

    own, right = faults(rows), re.compile(r"(s?(ua)+)?")
    heap = [(0, "", 0, "", ())]
    best = None
    while heap:
        cost, audit, k, initials, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if k == len(rows) and right.fullmatch(initials):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        for x, role in (("u", "user"), ("a", "assistant")):
            if audit.count("I") < 2 * len(rows) + 2:
                heapq.heappush(heap, (cost + 5, audit + "I", k, initials + x, (*lines, f"{role}:")))
        if k < len(rows):
            role, text = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, initials, lines))
            if own[k] not in ("blank", "duplicate"):
                more = 5 * (own[k] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", k + 1, initials + (role[:1] or "-"), (*lines, f"{role}:{text}")))
                for x, to in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, initials + x, (*lines, f"{to}:{text}")))
    return best


def expected(rows):
    """Conversation id to its result, from rows after damage."""
    order = defaultdict(list)
    for r in rows:
        order[r[0]].append(r)
    out = {}
    for conv, own in order.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        said = [(r[2], r[3]) for r in own]
        turns = {r[1] for r in own} - {None}
        kinds = Counter(faults(said))
        illegal = sum((a[0][:1] or "-") + (b[0][:1] or "-") not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        cost, audit, lines = by_search(said)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_query_equals_search_over_all_edits(spark):
    import __spark_entry__

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(damage(rows))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in __spark_entry__.queries()["op13_conversation_repair"](spark, SMALL).collect()}
    assert got == {r[0]: want.get(r[0], EMPTY) for r in rows}


def test_odd_conversations(spark, monkeypatch):
    from millrace.llm import conversations

    rng = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", None, "sun", "abbot", "user", "assistant"]
    texts = ["Well.", "Why?", "no end", "", " \t\n", None, "Well.", "end!  ", "日本。", "a|b."]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts), "x", 1) for _ in range(330)]
    schema = "conv_id bigint, turn int, role string, text string, conv string, at int"
    want = expected([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, _, _ in rows if c is not None and c < 58])
    monkeypatch.setattr(conversations, "CHUNK", 2)
    table = spark.createDataFrame(rows, schema).repartition(3)
    got = conversations.repair_conversations(table.where("conv_id < 58"), with_text=True).collect()
    assert {r.conv: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert all(hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256 for r in got)
    whole = conversations.damage_and_repair(table).collect()
    assert {r.conv_id for r in whole} == {r[0] for r in rows} and len(whole) == len({r[0] for r in rows})
    assert conversations.damage_and_repair(table.where("false")).count() == 0


def test_a_long_conversation_is_read_in_chunks(spark):
    from millrace.llm.conversations import repair_conversations

    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}." if k % 7 else "") for k in range(20_000)]
    out = repair_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).first()
    assert out.blank == -(-20_000 // 7) and len(out.audit.replace("I", "")) == 20_000
