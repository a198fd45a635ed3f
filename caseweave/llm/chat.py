"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, from a user turn to an
assistant turn. Each turn of a conversation is kept, relabelled, or merged into the message before it, and
empty messages may be inserted before a turn or at the end; the cheapest repair is found by dynamic
programming over the states of that automaton.

The steps compose like matrices over (min, +): a run of turns is summed up by the cheapest repair from each
state to each state. So a conversation may span many tasks: turns are sorted by range, each task solves its
runs for every entry and exit state, the few run summaries of a conversation are chained, and each turn then
picks its action for the states chosen. What a turn renders to is a piece of text; a conversation's pieces in
order are the rendered conversation, which no task needs to hold whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, the roles that may come next.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NOISE = 40  # bits of the draw that decides between repairs of equal cost
SHIFT = 128  # costs stand above the sum of all draws, which never reaches them
INFINITE = 1 << (SHIFT + 64)


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 3
    insert: int = 4
    merge_relabelled: int = 5  # a turn of another role joins the message before it


def _gap(state: int, goal: int) -> tuple[int, ...] | None:
    """The fewest messages to insert so that `goal` may follow `state`."""
    paths = [((), state)]
    for _ in range(4):
        for path, at in paths:
            if goal in NEXT[at]:
                return path
        paths = [((*p, n), n) for p, at in paths for n in NEXT[at]]
    return None


def moves(role: str | None, costs: Costs) -> tuple:
    """(from, to, cost, merged, inserted messages) of every way to place a turn of this role."""
    said = ROLES.index(role) + 1 if role in ROLES else None
    out = []
    for state in range(4):
        if state != START:
            out.append((state, state, costs.merge if said == state else costs.merge_relabelled, True, ()))
        for goal in (SYSTEM, USER, ASSISTANT):
            gap = _gap(state, goal)
            if gap is not None:
                cost = costs.insert * len(gap) + (0 if said == goal else costs.relabel)
                out.append((state, goal, cost, False, gap))
    return tuple(out)


def ending(costs: Costs) -> list[tuple[int, tuple[int, ...]]]:
    """For each last state, the cost of ending there and the messages to insert."""
    return [(0, ()) if s in (START, ASSISTANT) else (costs.insert * len(g := (*_gap(s, ASSISTANT), ASSISTANT)), g) for s in range(4)]


def _draws(turn, role, text, n: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(f"{turn}\x1f{role}\x1f{text}".encode("utf-8", "replace"))
    return [xxhash.xxh64_intdigest(h.to_bytes(16, "little"), i) & ((1 << NOISE) - 1) for i in range(n)]


def solve(turns: list[tuple], costs: Costs) -> tuple[list[list[int]], list[list[list[int]]]]:
    """For a run of (turn, role, text): cost[entry][exit], and for each turn choice[entry][exit], a move's index."""
    best = [[0 if s == e else INFINITE for s in range(4)] for e in range(4)]
    back: list[list[list[tuple[int, int]]]] = []
    known = {r: moves(r, costs) for r in (None, *ROLES)}
    for turn, role, text in turns:
        ways = known.get(role, known[None])
        noise = _draws(turn, role, text, len(ways))
        step, now = [], []
        for e in range(4):
            row, frm = [INFINITE] * 4, [(-1, -1)] * 4
            for k, (a, b, cost, _, _) in enumerate(ways):
                if best[e][a] < INFINITE and (c := best[e][a] + (cost << SHIFT) + noise[k]) < row[b]:
                    row[b], frm[b] = c, (a, k)
            now.append(row)
            step.append(frm)
        best = now
        back.append(step)
    choice = [[[-1] * 4 for _ in range(4)] for _ in turns]
    for e in range(4):
        for x in range(4):
            at = x
            for i in range(len(turns) - 1, -1, -1):
                at, k = back[i][e][at]
                if k < 0:
                    break
                choice[i][e][x] = k
    return best, choice


def _message(role: str, first: bool) -> str:
    return ("" if first else "<|end|>\n") + f"<|{role}|>\n"


def escaped(text: str) -> str:
    """A text without markers: a backslash more between `<` and `|`, so that no text opens or ends a message."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    """What escaped() was made from."""
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def parsed(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the messages of a rendered conversation."""
    pieces = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", rendered, re.DOTALL)
    return [(role, unescaped(text)) for role, text in pieces]


def _schema(turn: pa.DataType) -> pa.Schema:
    kinds = [pa.int64(), pa.string(), pa.int32(), turn, pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
    return pa.schema(list(zip(["run", "conv", "i", "turn", "role", "text", "choice", "cost"], kinds, strict=True)))


def _runs(costs: Costs, longest: int):
    """Sorted rows (conv, turn, role, text, task) to rows with run, choices, and the run's costs at its last row."""

    def flush(run, conv, rows, schema):
        cost, choice = solve(rows, costs)
        n = len(rows)
        columns = [
            [run] * n,
            [conv] * n,
            range(n),
            *zip(*rows, strict=True),
            [[k for e in c for k in e] for c in choice],
            [None] * (n - 1) + [[str(c) for e in cost for c in e]],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        held, conv, number, schema = [], None, None, None
        for b in batches:
            schema = _schema(b.schema.field(1).type)
            for c, turn, role, text, task in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if held and (c != conv or len(held) >= longest):
                    yield flush(number, conv, held, schema)
                    held, number = [], number + 1
                if number is None:
                    number = task << 33  # runs are numbered in the order of the rows
                conv = c
                held.append((turn, role, text))
        if held:
            yield flush(number, conv, held, schema)

    return run


def _chain(costs: Costs):
    """Rows with all runs of a conversation (16 costs each) to the entry and exit state of every run."""

    def run(batches):
        for b in batches:
            out = []
            for runs in b.column(0).to_pylist():
                state, trail = [0, INFINITE, INFINITE, INFINITE], []
                for r in runs:
                    m = [int(x) for x in r["cost"]]
                    step = [min((state[e] + m[4 * e + x], e) for e in range(4)) for x in range(4)]
                    trail.append([e for _, e in step])
                    state = [min(c, INFINITE) for c, _ in step]
                end = min(range(4), key=lambda s: (state[s] + (ending(costs)[s][0] << SHIFT), s))
                total, at = (state[end] >> SHIFT) + ending(costs)[end][0], end
                for i in range(len(runs) - 1, -1, -1):
                    out.append((runs[i]["run"], trail[i][at], at, i == len(runs) - 1, total))
                    at = trail[i][at]
            names = ["c_run", "entry", "exit", "last", "total"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    return run


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    costs: Costs = Costs(),
    longest: int = 4096,
) -> DataFrame:
    """One row for each turn: conv, turn, role, repaired (its role now), action (keep, relabel or merge), inserted
    (empty messages put before it, by role), piece (its part of the rendered conversation), place (the order
    of pieces in a conversation), cost (of the conversation's whole repair).

    Rows of a conversation are ordered by turn, null turns last, ties by role and text; repeated rows are turns
    of their own. A role that is null or unknown is relabelled. A null text renders as an empty one. Rows with
    a null conversation form one conversation. Among repairs of equal cost a draw keyed by the turns decides. Markers in a
    text are escaped, so that a rendered conversation parses to its turns (see parsed) and no text can forge one. An empty table gives no rows; other columns are ignored. One row gathers 16 numbers for every `longest`
    turns of a conversation; no row or task holds a long conversation's turns.
    """
    kind = turns.schema[turn_col].dataType.simpleString()
    rows = turns.select(
        F.col(conv_col).cast("string").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.lower(F.trim(F.col(role_col).cast("string"))).alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    # a hash stands for the text, so that the sample of range bounds holds no long texts
    order = [F.asc("conv"), F.asc_nulls_last("turn"), F.asc("role"), F.asc(F.xxhash64("text"))]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.asc("text"))
    solved = materialize(
        dealt.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(
            _runs(costs, longest),
            f"run long, conv string, i int, turn {kind}, role string, text string, choice array<int>, cost array<string>",
        ),
        "runs",
    )
    runs = solved.where("cost IS NOT NULL").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("run", "cost"))).alias("runs"))
    chosen = runs.select("runs").mapInArrow(_chain(costs), "c_run long, entry int, exit int, last boolean, total long")

    def render(batches):
        ends, known = ending(costs), {r: moves(r, costs) for r in (None, *ROLES)}
        for b in batches:
            out = []
            for conv, place, turn, role, text, k, final, exit_, cost in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, goal, _, merged, gap = known.get(role, known[None])[k]
                now, piece, first = ROLES[goal - 1], "", a == START
                for g in gap:
                    piece += _message(ROLES[g - 1], first)
                    first = False
                piece += ("\n" if merged else _message(now, first)) + escaped(text or "")
                if final:
                    piece += "".join(_message(ROLES[g - 1], False) for g in ends[exit_][1]) + "<|end|>\n"
                action = "merge" if merged else "keep" if role == now else "relabel"
                out.append((conv, place, turn, role, now, action, [ROLES[g - 1] for g in gap], piece, cost))
            kinds = [pa.string(), pa.int64(), b.schema.field(2).type, *[pa.string()] * 3, pa.list_(pa.string()), pa.string(), pa.int64()]
            names = ["conv", "place", "turn", "role", "repaired", "action", "inserted", "piece", "cost"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

    return (
        solved.withColumn("ends", F.col("cost").isNotNull())
        .drop("cost")
        .join(chosen, F.col("run") == F.col("c_run"))
        .select(
            "conv",
            (F.col("run") * longest + F.col("i")).alias("place"),
            "turn",
            "role",
            "text",
            F.element_at("choice", F.col("entry") * 4 + F.col("exit") + 1).alias("k"),
            (F.col("last") & F.col("ends")).alias("final"),
            "exit",
            "total",
        )
        .mapInArrow(
            render,
            f"conv string, place long, turn {kind}, role string, repaired string, action string, inserted array<string>, piece string, cost long",
        )
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return format_chats(turns).select(
        F.col("conv").cast(kind).alias("conv_id"), "turn", "role", "repaired", "action",
        F.array_join("inserted", ",").alias("inserted"), "piece", "cost",
    )
