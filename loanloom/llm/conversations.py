"""Repair of conversation structure by the cheapest edits, over runs of equal rows.

A row is a symbol: its role's initial and its fault.  Rows after each other with one symbol are a run, and a run's
step from states to states is a power, in (min, plus), of its symbol's 4 x 4 matrix, made of cached powers of two.
Costs to go move from the end of a conversation to its start run by run; the choices of the audit are then unrolled
inside each run by halving it, again through the cached powers.

Conversations of up to ``WHOLE_ROWS`` rows are repaired one by one in the order of a shuffle on their ids.  Larger
ones are cut into segments of rows: segments are summed up as matrices, costs to go pass from segment to segment, each
segment unrolls its choices for all four states that it may start in, and one pass in the order of rows picks among
them while it digests the repaired text.  That last pass holds a row, a segment and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import cut, slices

WHOLE_ROWS = 4096
SEGMENT_ROWS = 4096

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States: nothing yet, after the system row, after a user row, after an assistant row (may end).
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 50

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _step(matrix: Matrix, to_go: Vector) -> Vector:
    return tuple(min(a + b for a, b in zip(row, to_go, strict=True)) for row in matrix)  # type: ignore[return-value]


def _times(left: Matrix, right: Matrix) -> Matrix:
    columns = list(zip(*right, strict=True))
    return tuple(tuple(min(a + b for a, b in zip(row, c, strict=True)) for c in columns) for row in left)  # type: ignore[return-value]


SAME: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))  # type: ignore[assignment]
#: Inserts before a row, or before the end: a user and an assistant row at most are ever worth it.
INSERTS: Matrix = _times(*[tuple(
    tuple(0 if i == j else INSERT_COST if j == NEXT[i] else NEVER for j in range(4)) for i in range(4)
)] * 2)  # type: ignore[arg-type]
AT_END: Vector = _step(INSERTS, (0, NEVER, NEVER, 0))


def symbol(initial: str, fault: int) -> str:
    """One character for a row; the role of rows that must go does not matter."""
    if fault in (BLANK, DUPLICATE):
        return "-"
    kind = initial if initial in ("s", "u", "a") else "o"
    return kind.upper() if fault == TRUNCATED else kind


def _kept(mark: str, state: int) -> int | None:
    """The state after a row is kept, if it may be."""
    role = mark.lower()
    if role == "s" and state == START:
        return SYSTEM
    if role == "u" and state != USER:
        return USER
    return ASSISTANT if role == "a" and state == USER else None


@lru_cache(maxsize=4096)
def power(mark: str, level: int) -> Matrix:
    """The step over ``2**level`` rows of one symbol."""
    if level:
        half = power(mark, level - 1)
        return _times(half, half)
    rows = [[NEVER] * 4 for _ in range(4)]
    extra = TRUNCATED_COST if mark.isupper() else 0
    for state in range(4):
        rows[state][state] = DELETE_COST
        if mark != "-":
            rows[state][NEXT[state]] = min(rows[state][NEXT[state]], REROLE_COST + extra)
            kept = _kept(mark, state)
            if kept is not None:
                rows[state][kept] = min(rows[state][kept], extra)
    return _times(INSERTS, tuple(map(tuple, rows)))  # type: ignore[arg-type]


def over(mark: str, count: int, to_go: Vector) -> Vector:
    """Costs to go before ``count`` rows of one symbol."""
    level = 0
    while count:
        if count & 1:
            to_go = _step(power(mark, level), to_go)
        count, level = count >> 1, level + 1
    return to_go


def runs(marks: Iterable[str]) -> list[tuple[str, int]]:
    return [(mark, sum(1 for _ in group)) for mark, group in groupby(marks)]


def _choose(mark: str, state: int, before: int, to_go: Vector) -> tuple[str, int]:
    """The ASCII-least edits of one row among the cheapest, and the state after it."""
    extra, out = TRUNCATED_COST if mark.isupper() else 0, ""
    while True:
        if DELETE_COST + to_go[state] == before:
            return out + DELETE, state
        inserted = over(mark, 1, to_go)[NEXT[state]]
        if INSERT_COST + inserted == before:
            out, state, before = out + INSERT, NEXT[state], inserted
            continue
        kept = _kept(mark, state) if mark != "-" else None
        if kept is not None and extra + to_go[kept] == before:
            return out + KEEP, kept
        return out + REROLE, NEXT[state]


def _unrolled(mark: str, count: int, state: int, to_go: Vector) -> tuple[str, int]:
    """Edits of a run from a state, and the state after it; costs to go are relative to their least."""
    if count <= 32:
        return _short(mark, count, state, to_go)
    later = count // 2
    first, between = _unrolled(mark, count - later, state, _relative(over(mark, later, to_go)))
    second, end = _unrolled(mark, later, between, to_go)
    return first + second, end


@lru_cache(maxsize=65_536)
def _short(mark: str, count: int, state: int, to_go: Vector) -> tuple[str, int]:
    if count == 1:
        return _choose(mark, state, over(mark, 1, to_go)[state], to_go)
    later = count // 2
    first, between = _short(mark, count - later, state, _relative(over(mark, later, to_go)))
    second, end = _short(mark, later, between, to_go)
    return first + second, end


def _relative(to_go: Vector) -> Vector:
    least = min(to_go)
    return tuple(cost - least for cost in to_go)  # type: ignore[return-value]


def unroll(of_runs: list[tuple[str, int]], state: int, to_go: Vector) -> tuple[str, int, int]:
    """Edits of rows given as runs, the state after them, and the cost from ``state`` on with ``to_go`` after them."""
    after = [to_go]
    for mark, count in reversed(of_runs):
        after.append(over(mark, count, after[-1]))
    cost, out = after.pop()[state], []
    for mark, count in of_runs:
        edits, state = _unrolled(mark, count, state, _relative(after.pop()))
        out.append(edits)
    return "".join(out), state, cost


def ending(state: int) -> str:
    """Inserts after the last row."""
    return {SYSTEM: INSERT * 2, USER: INSERT}.get(state, "")


def repair(marks: Iterable[str]) -> tuple[str, int]:
    """The audit of a conversation's symbols and its cost."""
    audit, state, cost = unroll(runs(marks), START, AT_END)
    return audit + ending(state), cost


def segment_matrix(of_runs: list[tuple[str, int]]) -> Matrix:
    out = SAME
    for mark, count in of_runs:
        level = 0
        while count:
            if count & 1:
                out = _times(out, power(mark, level))
            count, level = count >> 1, level + 1
    return out


class _Conversation:
    """What is reported of a conversation, filled row by row in its order."""

    NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    TYPES = [pa.int64()] * 7 + [pa.string()] * 2
    DDL = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
           "audit string, repaired_sha256 string")

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.faults = [0, 0, 0, 0]
        self.low = self.high = None
        self.turns = self.illegal = self.cost = 0
        self.initial: str | None = None
        self.state, self.audit, self.empty = START, [], True
        self.digest = hashlib.sha256()

    def see(self, turn: int | None, role: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{role}:{text}".encode() if self.empty else f"\n{role}:{text}".encode())
        self.empty = False

    def edit(self, edits: Iterator[str], role: str, text: str) -> None:
        """Apply the edits up to and with the one of the next row."""
        for edit in edits:
            self.audit.append(edit)
            if edit == INSERT:
                self.state = NEXT[self.state]
                self._write(ROLE_OF[self.state], "")
                continue
            if edit == KEEP:
                self.state = _kept(role[:1], self.state)
                self._write(role, text)
            elif edit == REROLE:
                self.state = NEXT[self.state]
                self._write(ROLE_OF[self.state], text)
            return

    def close(self) -> tuple:
        for edit in ending(self.state):
            self.audit.append(edit)
            self.state = NEXT[self.state]
            self._write(ROLE_OF[self.state], "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after damage; a dropped row has no copies and no text, a repeated one two.

    A null role or text is one space, a null id or turn is one space in the name that decides.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    action = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(action == 4, "user").otherwise(role).alias("role"),
        F.when(action == 0, F.lit(None)).when(action == 1, "").when(action == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.when(action == 0, 0).when(action == 3, 2).otherwise(1).alias("copies"),
    )


def _state_of_text() -> Column:
    """Blank, truncated or fine."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds ``digest`` (null where dropped), which orders rows of one turn and role, and ``fault`` without duplicates."""
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("fault", _state_of_text())


ORDER = ("conv_id", "turn", "role", "digest")


def _tuples(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)


def _report(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _Conversation.TYPES, strict=True)], names=_Conversation.NAMES
        )

    for row in found:
        held.append(row)
        if len(held) == 1024:
            yield out()
            held = []
    if held:
        yield out()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations whose rows follow each other, each held as a whole."""

    def each() -> Iterator[tuple]:
        columns = ["conv_id", "turn", "role", "text", "copies", "digest", "fault"]
        for conv_id, rows in groupby(_tuples(batches, columns), key=lambda row: row[0]):
            report, seen, held = _Conversation(conv_id), set(), []
            for _, turn, role, text, copies, digest, fault in rows:
                for _ in range(copies):
                    key = (role, digest)
                    now = DUPLICATE if fault != BLANK and key in seen else fault
                    seen.add(key)
                    report.see(turn, role, now)
                    held.append((symbol(role[:1], now), role, text))
            audit, report.cost = repair(mark for mark, _, _ in held)
            edits = iter(audit)
            for _, role, text in held:
                report.edit(edits, role, text)
            yield report.close()

    yield from _report(each())


def _segments(rows: int):
    """Runs of consecutive rows of a conversation, ``rows`` at most, and the matrix of each."""
    names = ["conv_id", "first", "marks", "matrix"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, first, marks = None, None, []

        def done() -> pa.RecordBatch:
            matrix = [cost for row in segment_matrix(runs(marks)) for cost in row]
            values = ([conv_id], [first], ["".join(marks)], [matrix])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        for conv, place, initial, copies, fault, again in _tuples(batches, ["conv_id", "place", "initial", "copies", "fault", "again"]):
            if marks and (conv != conv_id or len(marks) >= rows):
                yield done()
                marks = []
            for copy in range(copies):
                if not marks:
                    conv_id, first = conv, place
                marks.append(symbol(initial, DUPLICATE if fault != BLANK and (again or copy) else fault))
        if marks:
            yield done()

    return run


def _passed_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go after each segment; segments of a conversation come from its last to its first."""
    names, types = ["first", "to_go"], [pa.int64(), pa.list_(pa.int64())]
    at, to_go, out = (), AT_END, []
    for conv_id, first, matrix in _tuples(batches, ["conv_id", "first", "matrix"]):
        if (conv_id,) != at:
            at, to_go = (conv_id,), AT_END
        out.append((first, to_go))
        to_go = _step([matrix[i : i + 4] for i in range(0, 16, 4)], to_go)
        if len(out) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)


def _unroll_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits and cost of each segment from each of the four states."""
    names = ["conv_id", "first", "marks", "edits", "cost"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64()]
    for conv_id, first, marks, to_go in _tuples(batches, ["conv_id", "first", "marks", "to_go"]):
        ways = [unroll(runs(marks), state, tuple(to_go)) for state in range(4)]
        values = ([conv_id], [first], [marks], [[edits for edits, _, _ in ways]], [ways[START][2]])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)


FAULT_OF = {"-": DUPLICATE, "S": TRUNCATED, "U": TRUNCATED, "A": TRUNCATED, "O": TRUNCATED}


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation in their order, each segment's edits before its first row."""

    def each() -> Iterator[tuple]:
        columns = ["conv_id", "turn", "role", "text", "copies", "fault", "marks", "edits", "cost"]
        for conv_id, rows in groupby(_tuples(batches, columns), key=lambda row: row[0]):
            report, begun, marks, edits, left = _Conversation(conv_id), False, iter(""), iter(""), []
            for _, turn, role, text, copies, fault, of_marks, of_edits, cost in rows:
                if of_marks is not None:
                    left.append((of_marks, of_edits))
                    if not begun:
                        report.cost, begun = cost, True
                    continue
                for _ in range(copies):
                    mark = next(marks, None)
                    if mark is None:
                        of_marks, of_edits = left.pop(0)
                        marks, edits = iter(of_marks), iter(of_edits[report.state])
                        mark = next(marks)
                    now = DUPLICATE if mark == "-" and fault != BLANK else fault
                    report.see(turn, role, now)
                    report.edit(edits, role, text)
            yield report.close()

    yield from _report(each())


def _large(rows: DataFrame, segment_rows: int) -> DataFrame:
    """The report of conversations of any size, rows as from ``_ranked``."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are told apart, so that no key is too large for a task; which of them comes first does not matter
    apart = rows.withColumn("_apart", F.monotonically_increasing_id())
    dealt = apart.repartitionByRange(parts, *ORDER, "_apart").sortWithinPartitions(*ORDER, "_apart").drop("_apart")
    placed = cut(dealt.withColumn("place", F.monotonically_increasing_id()))
    there = placed.where("copies > 0")
    # the first row of each text is found by an aggregate and marked by its place, which no other row has
    firsts = there.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(False).alias("again"))
    thin = there.select("conv_id", "place", F.substring("role", 1, 1).alias("initial"), "copies", "fault")
    marked = thin.join(firsts, "place", "left").withColumn("again", F.coalesce("again", F.lit(True)))
    in_order = marked.repartitionByRange(parts, "place").sortWithinPartitions("place")
    segments = cut(in_order.mapInArrow(_segments(segment_rows), "conv_id bigint, first bigint, marks string, matrix array<bigint>"))
    backwards = segments.select("conv_id", "first", "matrix").repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("first").desc())
    to_go = backwards.mapInArrow(_passed_back, "first bigint, to_go array<bigint>")
    edits = segments.join(to_go, "first").mapInArrow(
        _unroll_all, "conv_id bigint, first bigint, marks string, edits array<string>, cost bigint"
    )
    decided = edits.select("conv_id", F.col("first").alias("place"), F.lit(0).alias("kind"), "marks", "edits", "cost")
    texts = placed.select("conv_id", "place", F.lit(1).alias("kind"), "turn", "role", "text", "copies", "fault")
    merged = texts.unionByName(decided, allowMissingColumns=True).repartition(parts, "conv_id")
    return merged.sortWithinPartitions("conv_id", "place", "kind").mapInArrow(_in_order, _Conversation.DDL)


def repaired(conversations: DataFrame, whole_rows: int = WHOLE_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row for every ``conv_id`` of ``conversations`` (conv_id, turn, role, text) after damage and repair.

    Rows of one turn are taken in order of role, then of the SHA-256 of their text; null turns come first and a null
    id is a conversation of its own.  A row that came twice is a duplicate.  A conversation without rows after damage
    has zeros, an empty audit and the digest of nothing; an empty table gives no rows; other columns are ignored.
    Texts are digested and compared whole, however long.  ``segment_rows`` is at least 2.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _ranked(damaged(conversations))
    sizes = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > whole_rows).select(F.col("conv_id").alias("large_id")))
    same = F.col("conv_id").eqNullSafe(F.col("large_id"))
    if large.isEmpty():
        return _dealt(rows, parts)
    # at most one id for every ``whole_rows`` rows
    return _dealt(rows.join(large, same, "left_anti"), parts).unionByName(_large(rows.join(large, same, "left_semi"), segment_rows))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "conv_id").sortWithinPartitions(*ORDER).mapInArrow(_whole, _Conversation.DDL)
