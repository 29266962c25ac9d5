"""Repair the order of roles in conversations at least cost, and render them.

Legal conversations may begin with a system turn; then user and assistant alternate.  For every turn the
repair keeps or changes its role, and before it may insert empty turns; a turn of the same role as the one
before is merged into it.  Each of these has a cost, and the cheapest whole repair is found by dynamic
programming over the role that spoke last.

A step of the program is a small matrix of costs from state to state, and matrices of successive turns
combine, so that a conversation of any length is split: turns are sorted by range into parts, each part of
a conversation gives one matrix, the parts of a conversation are chained, and with the states at its ends
known each part is repaired by itself.  A second, lower cost from a hash of the row decides between
repairs of equal cost, so that results do not depend on the parts.

Turns with equal numbers are ordered by a hash of role and text.  Null or unknown roles have to be given
one; null texts are empty turns; repeated rows are turns of their own; a null conversation is one
conversation.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_of
from emberline.session import written

ROLES = ("", "system", "user", "assistant")  # states; the first is before any turn
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
MOVES = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ENDS = (2, 3)
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1  # NAME gives an unknown role a known one
FINE = 1 << 50  # of the lower costs to one unit; a row has at most 1,024
NEVER = 1 << 90
START, STOP, BETWEEN = "<|im_start|>", "<|im_end|>\n", "\n"


def _inserted() -> dict[tuple[int, int], tuple[int, ...] | None]:
    """The shortest row of empty turns that makes a move legal; None where there is none."""
    found: dict = {}
    for p in MOVES:
        ways = [(p, ())]
        while ways:
            at, way = ways.pop(0)
            for q in MOVES[at]:
                if (p, q) not in found:
                    found[p, q] = way
                    ways.append((q, (*way, q)))
    return {(p, q): found.get((p, q)) for p in MOVES for q in MOVES}


BEFORE = _inserted()


def step_cost(p: int, q: int, role: int, tie: int) -> int:
    """Of a turn of ``role`` that becomes ``q`` after ``p``."""
    if q == 0:
        return NEVER
    cost = 0 if role == q else (RELABEL if role else NAME)
    if p == q:
        cost += MERGE
    elif BEFORE[p, q] is None:
        return NEVER
    else:
        cost += INSERT * len(BEFORE[p, q])
    return cost * FINE + (tie >> (10 * q) & 1023)


def code(role) -> int:
    role = ALIASES.get(role, role)
    return ROLES.index(role) if role in ROLES[1:] else 0


def best(costs: list[int], role: int, tie: int) -> tuple[list[int], list[int]]:
    """Costs after a turn by state, and the state each came from."""
    after, origin = [NEVER] * 4, [0] * 4
    for q in (1, 2, 3):
        after[q], origin[q] = min((costs[p] + step_cost(p, q, role, tie), p) for p in range(4))
    return after, origin


def runs(batches: Iterator[pa.RecordBatch], *columns: str):
    """Groups of rows of equal ``key`` and ``part`` from sorted batches, as they come."""
    return groupby(_rows(batches, "key", "part", *columns), key=lambda r: r[:2])


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    return pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(fields)}, fields)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for (key, part), rows in runs(batches, "role", "tie"):
        lines = [[0 if p == q else NEVER for q in range(4)] for p in range(4)]
        for _, _, role, tie in rows:
            lines = [best(line, code(role), tie)[0] for line in lines]
        out.append((key, part, [str(min(c, NEVER)) for line in lines for c in line]))
    yield _batch(out, MATRICES)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States at the ends of each part; the parts of one conversation come together."""
    out = []
    for key, parts in groupby(_rows(batches, "key", "part", "matrix"), key=lambda r: r[0]):
        costs, steps = [0, NEVER, NEVER, NEVER], []
        for _, part, matrix in parts:
            matrix = list(map(int, matrix))
            found = [min((costs[p] + matrix[4 * p + q], p) for p in range(4)) for q in range(4)]
            costs = [c for c, _ in found]
            steps.append((part, [p for _, p in found]))
        last = min(((c + INSERT * FINE * (q not in ENDS), q) for q, c in enumerate(costs)))[1]
        for n, (part, origin) in enumerate(reversed(steps)):
            out.append((key, part, origin[last], last, n == 0))
            last = origin[last]
    yield _batch(out, STATES)


MATRICES = "key string, part int, matrix array<string>"
STATES = "key string, part int, enter int, leave int, is_last boolean"
RESULT = "conv_id long, turn long, tie long, old_role string, role string, action string, n_inserted int, cost int, piece string"


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run begins with the row of its ends."""
    out = []
    for _, rows in runs(batches, "conv_id", "turn", "role", "tie", "text", "enter", "leave", "is_last"):
        _, _, _, _, _, _, _, enter, leave, is_last = next(rows)
        state, leave, rows = int(enter), int(leave), list(rows)
        costs, origins = [0 if p == state else NEVER for p in range(4)], []
        for row in rows:
            costs, origin = best(costs, code(row[4]), row[5])
            origins.append(origin)
        states = [leave]
        for origin in reversed(origins):
            states.append(origin[states[-1]])
        states.reverse()
        for n, ((_, _, conv_id, turn, role, tie, text, *_), p, q) in enumerate(zip(rows, states, states[1:])):
            new, inserted = p != q, () if p == q else BEFORE[p, q]
            piece = (STOP if p and new else "") + "".join(f"{START}{ROLES[x]}\n{STOP}" for x in inserted)
            piece += f"{START}{ROLES[q]}\n{text}" if new else BETWEEN + text
            cost = step_cost(p, q, code(role), 0) // FINE
            if is_last and n == len(rows) - 1:
                piece += STOP
                if q not in ENDS:
                    piece, inserted, cost = piece + f"{START}user\n{STOP}", (*inserted, 2), cost + INSERT
            action = ("keep" if code(role) == q else "relabel") + ("" if new else " and merge")
            out.append((conv_id, turn, tie, role, ROLES[q], action, len(inserted), cost, piece))
        if len(out) > 5000:
            yield _batch(out, RESULT)
            out = []
    yield _batch(out, RESULT)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per turn: its role before and after, what was done, its cost, and its piece of the rendering.

    The pieces of a conversation, in the order of ``turn`` and ``tie``, are the rendered conversation.
    """
    role = F.lower(F.trim(F.col("role").cast("string")))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text_of().alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("tie", F.xxhash64("role", "text"))
    # equal rows are interchangeable, and a random number lets a range of them be split
    rows = rows.withColumn("chance", F.rand(1)).repartitionByRange("key", "turn", "tie", "chance").withColumn("part", F.spark_partition_id())
    rows = written(rows.drop("chance"), "turns")
    together = rows.select("key", "part", "turn", "role", "tie").repartition("key", "part").sortWithinPartitions("key", "part", "turn", "tie")
    matrices = together.mapInArrow(_summaries, MATRICES)
    chained = matrices.repartition("key").sortWithinPartitions("key", "part")
    ends = chained.mapInArrow(_ends, STATES)
    both = rows.withColumn("kind", F.lit(1)).unionByName(ends.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.repartition("key", "part").sortWithinPartitions("key", "part", "kind", "turn", "tie")
    return both.mapInArrow(_repairs, RESULT)
