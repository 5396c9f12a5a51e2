"""Conversation repair against a plain search over whole edit strings."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from loanloom.llm.conversations import over, power, repair, repaired, runs, segment_matrix, symbol, unroll

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, place bigint"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_repair(rows):
    """Cheapest, then ASCII-least edits of (role, text, must go, extra) and the repaired rows."""

    def legal(last):  # roles that may follow what stands last
        return {"": ("system", "user"), "s": ("user",), "u": ("assistant",), "a": ("user",)}[last]

    @lru_cache(maxsize=None)
    def best(at, last, inserts):
        found = []
        if at == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, gone, extra = rows[at]
            cost, edits, out = best(at + 1, last, 0)
            found.append((3 + cost, "D" + edits, out))
            if not gone:
                for edit, price, written in [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")]:
                    if any(written[:1] == able[0] for able in legal(last)):
                        cost, edits, out = best(at + 1, written[0], 0)
                        found.append((price + extra + cost, edit + edits, ((written, text), *out)))
        if inserts < 3:
            for role in ("user", "assistant"):
                if role in legal(last):
                    cost, edits, out = best(at, role[0], inserts + 1)
                    found.append((2 + cost, "I" + edits, ((role, ""), *out)))
        return min(found) if found else (10**9, "~", ())

    return best(0, "", 0)


def plain(rows):
    out = []
    for conv_id in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv_id]:
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
            action = zlib.crc32(name.encode()) % 20
            text = "" if action == 1 else re.sub("[.!?]", "", text) if action == 2 else text
            role = "user" if action == 4 else role
            kept += [(turn, role, text)] * {0: 0, 3: 2}.get(action, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        counts, seen, marked = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = {t for t, _, _ in kept if t is not None}
        initials = [role[:1] for _, role, _ in kept]
        cost, audit, repaired_rows = plain_repair(tuple(marked))
        out.append((
            conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(f"{role}:{text}" for role, text in repaired_rows).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "s"]
    texts = ["Fine.", "Open", "Why?", "", " \t", None, "Stop! ", "a. b", "x" * 3000 + "."]
    rows = []
    for conv_id in range(n):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, 14)):
            rows.append((conv_id, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7
                         else f"Text {rng.randrange(99)}."))
            turn += rng.choice([0, 1, 1, 1, 2, 5])
    return rows


@pytest.mark.parametrize(("whole_rows", "segment_rows"), [(4096, 4096), (5, 3), (0, 2), (0, 50)])
def test_equal_to_a_plain_search(spark, whole_rows, segment_rows):
    rows = conversations(4, 150) + [(None, 1, "user", "No id."), (None, None, None, None), (7, 1, "user", "Again."), (7, 1, "user", "Again.")]
    table = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(7)
    got = repaired(table, whole_rows, segment_rows)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_a_conversation_of_dropped_rows_and_an_empty_table(spark):
    dropped = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(*dropped, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    for whole_rows in (4096, 0):
        assert [tuple(r) for r in repaired(table, whole_rows, 2).collect()] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", nothing)]
    assert repaired(table.limit(0)).collect() == []


def test_runs_and_segments_give_the_same_as_rows():
    rng = random.Random(6)
    for _ in range(60):
        marks = "".join(rng.choice("suaoSUAO-") * rng.choice([1, 1, 2, 3, 40]) for _ in range(rng.randrange(1, 12)))
        rows = tuple(({"s": "system", "u": "user", "a": "assistant"}.get(m.lower(), "tool"), "t", m == "-", int(m.isupper())) for m in marks)
        if len(marks) <= 60:
            cost, audit, _ = plain_repair(rows)
            assert repair(marks) == (audit, cost)
        cut_at = rng.randrange(len(marks) + 1)
        after = (7, 3, 5, 0)
        whole = runs(marks)
        first, second = runs(marks[:cut_at]), runs(marks[cut_at:])
        between = tuple(unroll(second, state, after)[2] for state in range(4))
        assert tuple(unroll(first, state, between)[2] for state in range(4)) == tuple(unroll(whole, state, after)[2] for state in range(4))
        matrix = segment_matrix(whole)
        assert tuple(min(a + b for a, b in zip(row, after, strict=True)) for row in matrix) == tuple(
            unroll(whole, state, after)[2] for state in range(4)
        )


def test_powers_of_a_symbol_are_its_repeated_step():
    for mark in "suaoSUAO-":
        for count in (1, 2, 3, 7, 100):
            to_go = (0, 4, 2, 0)
            for _ in range(count):
                to_go = tuple(min(a + b for a, b in zip(row, to_go, strict=True)) for row in power(mark, 0))
            assert over(mark, count, (0, 4, 2, 0)) == to_go


def test_symbols():
    assert [symbol("u", 0), symbol("u", 3), symbol("u", 1), symbol("t", 2), symbol("t", 3), symbol("", 0)] == ["u", "U", "-", "-", "O", "o"]


def test_one_conversation_with_a_third_of_all_rows(spark):
    rng = random.Random(8)
    rows = [(0, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", "Same.", f"Text {t}.", "open"])) for t in range(600)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"Text {c} {t}.") for c in range(1, 301) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    got = {r["conv_id"]: tuple(r) for r in repaired(table, 100, 64).collect()}
    assert len(got) == 301
    want = {r[0]: r for r in plain([r for r in rows if r[0] < 3])}
    assert all(got[c] == want[c] for c in (1, 2))
    assert got[0] == tuple(repaired(table.where("conv_id = 0")).first())
