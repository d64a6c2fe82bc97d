"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with
the assistant. Dynamic programming over the automaton of legal turns picks, for every turn, to keep or
relabel its role, to merge it into the turn before (of the role it then has), or to insert an empty turn
before it, so that the whole costs least; the repaired sequence is then rendered. A text's own markers are
escaped, so that ``read_back`` gives the repaired turns again whatever their texts hold.

The cost of a run of turns is a matrix from the state before to the state after, and matrices compose by
(min, +). So conversations are cut by turn number into segments of SEGMENT turns, each with its matrix;
a conversation's matrices alone decide the states at the cuts, and segments are repaired side by side.
Renderings of a conversation's segments, joined in order, are the rendering of the conversation.

Defined results: a null or unknown role costs UNKNOWN to label; a null text is the empty text; turns are in
the order of turn (null last), role and text, nulls before others; repeated rows are turns of their own; a
row without a conv_id belongs to no other and is a conversation by itself; texts and conversations of any length
are whole, a row being a segment; of choices that tie the smaller state is taken; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

ROLES = ("system", "user", "assistant")
SEGMENT = 128
RELABEL, UNKNOWN, MERGE, INSERT = 5, 1, 2, 4
#: States: at the start, after a system, user, assistant turn. State s > 0 is that of role ROLES[s - 1].
STATES, NEVER = 4, 1 << 40
#: (state, label) -> empty turns to insert before the turn.
BEFORE = {(0, 0): (), (0, 1): (), (1, 1): (), (3, 1): (), (2, 2): (), (0, 2): (1,), (1, 2): (1,), (3, 2): (1,), (2, 1): (2,)}
#: Cost and empty turns that end a conversation legally from each state.
ENDING = {0: (0, ()), 1: (2 * INSERT, (1, 2)), 2: (INSERT, (2,)), 3: (0, ())}


def choices(role: str | None, state: int) -> list[tuple[int, int, str, int]]:
    """(cost, next state, action, label) of a turn, cheapest and then plainest first."""
    known = role.strip().lower() if role else ""
    out = []
    for label, name in enumerate(ROLES):
        named = 0 if known == name else RELABEL if known in ROLES else UNKNOWN
        if (state, label) in BEFORE:
            inserted = BEFORE[state, label]
            out.append((named + INSERT * len(inserted), label + 1, "insert" if inserted else "keep" if not named else "relabel", label))
        if state == label + 1:
            out.append((named + MERGE, state, "merge", label))
    return sorted(out, key=lambda c: (c[0], c[2] != "keep", c[1], c[2]))


_MARKER, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", re.S)


def escaped(text: str) -> str:
    """The text with a backslash in whatever could be read as a marker."""
    return _MARKER.sub(r"<\\\1|", text) if "|" in text else text


def read_back(rendered: str) -> list[tuple[str, str]]:
    """Role and text of the turns of a whole rendering."""
    return [(role, _ESCAPED.sub(r"<\1|", text)) for role, text in _TURN.findall(rendered)]


_steps: dict[str | None, np.ndarray] = {}


def step(role: str | None) -> np.ndarray:
    """Cost matrix of one turn."""
    key = role.strip().lower() if role else ""
    key = key if key in ROLES else ""
    if key not in _steps:
        m = np.full((STATES, STATES), NEVER, np.int64)
        for s in range(STATES):
            for cost, after, _, _ in choices(key, s):
                m[s, after] = min(m[s, after], cost)
        _steps[key] = m
    return _steps[key]


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(1), NEVER)


def repair(roles: list[str | None], entry: int, exit_: int) -> list[tuple[str, int]]:
    """Action and label of each turn, of least cost from state entry to exit_; ties go to the smaller next state."""
    ahead = [np.where(np.arange(STATES) == exit_, 0, NEVER)]
    for role in reversed(roles):
        ahead.append(np.minimum((step(role) + ahead[-1]).min(1), NEVER))
    ahead.reverse()
    out, state = [], entry
    for i, role in enumerate(roles):
        _, state, action, label = min(choices(role, state), key=lambda c: (c[0] + int(ahead[i + 1][c[1]]), c[1], c[0], c[2]))
        out.append((action, label))
    return out


def render(turns: list[tuple[str | None, str]], entry: int, exit_: int, last: bool) -> tuple[str, dict[str, int]]:
    """The segment's part of the rendering, and how often each action was taken."""
    counts = dict.fromkeys(("keep", "relabel", "merge", "insert"), 0)
    parts, state = [], entry

    def open_(label: int) -> None:
        parts.append(("<|end|>\n" if state else "") + f"<|{ROLES[label]}|>\n")

    for (action, label), (_, text) in zip(repair([r for r, _ in turns], entry, exit_), turns, strict=True):
        counts[action] += 1
        if action == "merge":
            parts.append("\n\n")
        else:
            for missing in BEFORE[state, label]:
                open_(missing)
                state = missing + 1
            open_(label)
            state = label + 1
        parts.append(escaped(text))
    if last:
        for missing in ENDING[state][1]:
            open_(missing)
            state = missing + 1
            counts["insert"] += 1
        parts.append("<|end|>\n" if state else "")
    return "".join(parts), counts


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, lone (of a row without one), segment, roles and texts in order and the segment's cost matrix."""
    placed = turns.select("conv_id", "lone", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit((1 << 62))).cast("long").alias("segment"), "turn", "role", "text")
    order = F.struct(F.col("turn").isNull().alias("n"), "turn", "role", "text")
    listed = placed.groupBy("conv_id", "lone", "segment").agg(F.sort_array(F.collect_list(order)).alias("t"))
    listed = listed.select("conv_id", "lone", "segment", F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))).alias("texts"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        costs = []
        for roles in batch.column("roles").to_pylist():
            m = step(roles[0])
            for role in roles[1:]:
                m = compose(m, step(role))
            costs.append(m.ravel().tolist())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "lone", "segment", "roles", "texts")), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "lone", "segment", "roles", "texts", "costs"])

    return map_batches(listed, "conv_id long, lone long, segment long, roles array<string>, texts array<string>, costs array<long>", run)


def cut_states(costs: list[np.ndarray]) -> tuple[list[int], int]:
    """States before each segment and after the last, of least cost; and that cost."""
    ahead = [np.array([ENDING[s][0] for s in range(STATES)], np.int64)]
    for m in reversed(costs):
        ahead.append(np.minimum((m + ahead[-1]).min(1), NEVER))
    ahead.reverse()
    states = [0]
    for m, rest in zip(costs, ahead[1:], strict=True):
        states.append(int((m[states[-1]] + rest).argmin()))
    return states, int(ahead[0][0])


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns, the actions' counts, the conversation's cost and the rendering: a row for each segment."""
    # rows without a conv_id never meet: the row itself is told apart by where it lies
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    made, _ = written(segments(turns.select("conv_id", own.alias("lone"), "turn", "role", "text")), "segments")
    listed = made.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list(F.struct("segment", "costs"))).alias("all"))

    def cuts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for own in batch.column("all").to_pylist():
            states, cost = cut_states([np.array(x["costs"], np.int64).reshape(STATES, STATES) for x in own])
            found.append([{"segment": x["segment"], "entry": a, "exit": b, "last": x is own[-1], "cost": cost} for x, a, b in zip(own, states[:-1], states[1:], strict=True)])
        kind = pa.list_(pa.struct([("segment", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64()), ("last", pa.bool_()), ("cost", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("lone"), pa.array(found, kind)], ["conv_id", "lone", "cuts"])

    placed = map_batches(listed, "conv_id long, lone long, cuts array<struct<segment: long, entry: long, exit: long, last: boolean, cost: long>>", cuts).select("conv_id", "lone", F.inline("cuts"))
    joined = made.alias("m").join(placed.alias("p"), F.col("m.conv_id").eqNullSafe(F.col("p.conv_id")) & F.col("m.lone").eqNullSafe(F.col("p.lone")) & (F.col("m.segment") == F.col("p.segment")))
    joined = joined.select("m.conv_id", "m.segment", "roles", "texts", "entry", "exit", "last", "cost")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(c).to_pylist() for c in ("roles", "texts", "entry", "exit", "last")]
        done = [render(list(zip(r, t, strict=True)), a, b, z) for r, t, a, b, z in zip(*columns, strict=True)]
        counts = [pa.array([c[k] for _, c in done], pa.int64()) for k in ("keep", "relabel", "merge", "insert")]
        out = [batch.column("conv_id"), batch.column("segment"), pa.array([len(r) for r in columns[0]], pa.int64()), *counts, batch.column("cost"), pa.array([t for t, _ in done], pa.string())]
        return pa.RecordBatch.from_arrays(out, ["conv_id", "segment", "n_turns", "n_kept", "n_relabelled", "n_merged", "n_inserted", "cost", "rendered"])

    return map_batches(joined, "conv_id long, segment long, n_turns long, n_kept long, n_relabelled long, n_merged long, n_inserted long, cost long, rendered string", run)
