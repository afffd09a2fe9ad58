"""Chat formatting by minimum-cost role repair.

A conversation is legal if an optional system turn is followed by user and assistant turns in alternation, the last by the
assistant.  Dynamic programming over that automaton finds the cheapest way to make a conversation legal: turns are kept,
merged into the turn before, given another role, or preceded by empty turns.

Conversations may be of any length.  They are cut into blocks of turns; what a block costs from each state to each state is
a small matrix, the matrices of a conversation are chained to find the states between its blocks, and the blocks are then
traced back independently.  No task needs more than one block's turns, or one small matrix for every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capacast import session

BLOCK = 4096
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
OTHER = "other"
# Role names in use, by the role that they stand for.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT,
         "ai": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
# Costs: a turn of an unknown role is cheaper to change, as there is less to lose.
MERGE_SAME, MERGE_OTHER, RELABEL, INSERT, MERGE_UNKNOWN, RELABEL_UNKNOWN = 1, 4, 3, 2, 2, 1

START = 0
STATES = [None, SYSTEM, USER, ASSISTANT]  # the role of the turn that is open; none at the start
NEXT = {0: [1, 2], 1: [2], 2: [3], 3: [2]}
# Equal costs prefer keeping to merging to relabelling, and few empty turns; the cost itself counts in units of COST.
COST = 1 << 32
PREFER_MERGE, PREFER_RELABEL, PREFER_INSERT = 1, 2, 3
INFINITE = 1 << 62


def _gaps() -> dict[tuple[int, int], list[int]]:
    """The shortest lists of empty turns (never system) that lead from a state to another; none for itself."""
    found = {(s, s): [] for s in range(4)}
    for _ in range(3):
        for (s, t), path in list(found.items()):
            for n in NEXT[t]:
                if n != 1 and ((s, n) not in found or len(path) + 1 < len(found[s, n])):
                    found[s, n] = [*path, n]
    return found


GAPS = _gaps()


def _options(role: str) -> list[tuple[int, int, int, str, list[int]]]:
    """All steps for a turn: from state, to state, cost, action, empty turns before."""
    steps = []
    for s in range(4):
        if s != START:
            cost = MERGE_UNKNOWN if role == OTHER else MERGE_SAME if STATES[s] == role else MERGE_OTHER
            steps.append((s, s, cost * COST + PREFER_MERGE, "merge", []))
        for mid in range(4):
            if (s, mid) not in GAPS or (mid == s and GAPS[s, mid]):
                continue
            gap = GAPS[s, mid]
            for t in NEXT[mid]:
                if STATES[t] == role:
                    cost, action = 0, "keep"
                else:
                    cost = (RELABEL_UNKNOWN if role == OTHER else RELABEL) * COST + PREFER_RELABEL
                    action = "relabel"
                steps.append((s, t, cost + len(gap) * (INSERT * COST + PREFER_INSERT), action, gap))
    return steps


OPTIONS = {role: _options(role) for role in (SYSTEM, USER, ASSISTANT, OTHER)}


def closing(state: int) -> tuple[int, list[int]]:
    """Cost of ending in a state, and the empty turns that this takes."""
    gap = GAPS.get((state, 3))
    return len(gap) * (INSERT * COST + PREFER_INSERT), gap


def normal(role: str | None) -> str:
    return NAMES.get((role or "").strip().lower(), OTHER)


def matrix(roles: list[str]) -> list[int]:
    """Lowest cost from each state to each state over a run of turns, row by row."""
    out = []
    for s in range(4):
        best = [INFINITE] * 4
        best[s] = 0
        for role in roles:
            after = [INFINITE] * 4
            for a, b, cost, _, _ in OPTIONS[role]:
                if best[a] + cost < after[b]:
                    after[b] = best[a] + cost
            best = after
        out += [min(b, INFINITE) for b in best]
    return out


def chain(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """States before and after each block on the cheapest way through all of them."""
    best, origins = [0, INFINITE, INFINITE, INFINITE], []
    for m in matrices:
        sums = [[min(best[a] + m[4 * a + b], INFINITE) for a in range(4)] for b in range(4)]
        origins.append([min(range(4), key=row.__getitem__) for row in sums])
        best = [min(row) for row in sums]
    state = min(range(1, 4), key=lambda s: best[s] + closing(s)[0])
    found = []
    for origin in reversed(origins):
        found.append((origin[state], state))
        state = origin[state]
    return found[::-1]


def trace(roles: list[str], first: int, last: int) -> list[tuple[int, int, str, list[int]]]:
    """For each turn of a block the state before and after, the action, and the empty turns before it."""
    best, chosen = [INFINITE] * 4, []
    best[first] = 0
    for role in roles:
        after, steps = [INFINITE] * 4, [None] * 4
        for a, b, cost, action, gap in OPTIONS[role]:
            if best[a] + cost < after[b]:
                after[b] = best[a] + cost
                steps[b] = (a, b, action, gap)
        best = after
        chosen.append(steps)
    path, state = [], last
    for steps in reversed(chosen):
        path.append(steps[state])
        state = steps[state][0]
    return path[::-1]


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _framed(before: int, after: int, action: str, gap: list[int], last: bool) -> tuple[str, str]:
    """What is rendered in front of a turn's text and behind it."""
    if action == "merge":
        front = "\n"
    else:
        front = (CLOSE if before != START else "") + "".join(
            f"{OPEN}{STATES[s]}\n{CLOSE}" for s in gap) + f"{OPEN}{STATES[after]}\n"
    back = CLOSE + "".join(f"{OPEN}{STATES[s]}\n{CLOSE}" for s in closing(after)[1]) if last else ""
    return front, back


def _numbered(turns: DataFrame) -> DataFrame:
    """Rows in order, with the number of their partition, their place in it, and their place among those rows of their
    conversation that are in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row, at, last = 0, 0, None
        for batch in batches:
            places = []
            for conversation in batch.column("conv_id").to_pylist():
                at = at + 1 if row + len(places) and conversation == last else 0
                last = conversation
                places.append(at)
            count = len(places)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * count, pa.int32()), pa.array(range(row, row + count), pa.int64()),
                 pa.array(places, pa.int64()), *batch.columns], ["part", "row", "at", *batch.schema.names])
            row += count

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema.fields)
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, f"part int, row bigint, at bigint, {fields}")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(conv_id, block, turns): the turns' roles in blocks of ``size``, which do not depend on the partitions."""
    counts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("conv_id").alias("of"), F.col("part").alias("in_part"),
                           F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    placed = rows.select("part", "row", "at", "conv_id", "role").join(
        before, (F.col("part") == F.col("in_part")) & F.col("conv_id").eqNullSafe(F.col("of")))
    position = F.col("before") + F.col("at")
    return placed.groupBy("conv_id", F.floor(position / size).alias("block")).agg(F.array_sort(F.collect_list(
        F.struct(position.alias("position"), "part", "row", "role"))).alias("turns"))


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every turn with its repaired role and its part of the rendered conversation.

    Takes conv_id, turn, role, text; returns conv_id, position (from 1), turn, role, new_role, action, inserted (roles of
    the empty turns put before it), cost (of the whole conversation) and piece.  The pieces of a conversation, joined in the
    order of position, are the rendered conversation.

    Turns are ordered by turn, then role, then a hash of the text; turns that agree in all of these are repeated turns and
    all stay.  Null roles and names that are not known count as an unknown role, a null text is empty, rows without a
    conv_id are one conversation.  "<|" in texts is rendered "< |", so that no text can pose as a turn.  Other columns are
    ignored; an empty table gives no rows.
    """
    given = turns.select("conv_id", "turn", "role", "text")
    rows = session.materialise(_numbered(given), "turns")
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = session.materialise(_blocks(rows, block), "blocks")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matrix([normal(t["role"]) for t in listed]) for listed in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["conv_id", "block", "matrix"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = []
            for parts in batch.column("parts").to_pylist():
                through = chain([p["matrix"] for p in parts])
                cost = sum(p["matrix"][4 * a + b] for p, (a, b) in zip(parts, through)) + closing(through[-1][1])[0]
                ways.append([(p["block"], a, b, i + 1 == len(parts), cost // COST)
                             for i, (p, (a, b)) in enumerate(zip(parts, through))])
            kinds = pa.struct([("block", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("ends", pa.bool_()),
                               ("cost", pa.int64())])
            listed = [[dict(zip(("block", "first", "last", "ends", "cost"), w)) for w in way] for way in ways]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(listed, pa.list_(kinds))], ["of", "ways"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "row", "position", "new_role", "action", "inserted", "cost", "front", "back"]
        types = [pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            done = []
            for found in batch.to_pylist():
                listed = found["turns"]
                path = trace([normal(t["role"]) for t in listed], found["first"], found["last"])
                for i, (t, (a, b, action, gap)) in enumerate(zip(listed, path)):
                    done.append((t["part"], t["row"], t["position"] + 1, STATES[b], action,
                                 ",".join(STATES[s] for s in gap), found["cost"],
                                 *_framed(a, b, action, gap, found["ends"] and i + 1 == len(path))))
            columns = zip(*done) if done else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    priced = blocks.mapInArrow(costs, f"conv_id {kind}, block bigint, matrix array<bigint>")
    ways = priced.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("parts"))
    ways = ways.mapInArrow(states, f"of {kind}, ways array<struct<block: bigint, first: int, last: int, ends: boolean, "
                                   "cost: bigint>>").select("of", F.explode("ways").alias("way"))
    steps = blocks.join(ways, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("way.block"))).select(
        "turns", "way.first", "way.last", "way.ends", "way.cost").mapInArrow(
        traced, "part int, row bigint, position bigint, new_role string, action string, inserted string, cost bigint, "
                "front string, back string")
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    return rows.join(steps, ["part", "row"]).select(
        "conv_id", "position", "turn", "role", "new_role", "action", "inserted", "cost",
        F.concat("front", safe, "back").alias("piece"))


def rendered(pieces: DataFrame) -> DataFrame:
    """(conv_id, cost, conversation): pieces joined to one string each, for conversations that fit into a row."""
    return pieces.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda p: p["piece"]), "").alias("conversation"))
