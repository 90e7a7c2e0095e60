"""Operator 1: chat formatting with minimum-cost role repair.

A legal-turn automaton says which role may follow which: an optional system turn first, then user and
assistant in turn; a conversation may end after either. Reading the turns in order, each one either opens
a turn of its own (in its role, or relabelled) or is merged into the open turn; empty turns may be
inserted before it. Dynamic programming over the automaton's states finds the cheapest legal
reading (costs: ``COSTS``); it is rendered as marked-up text, one piece per input turn, whose concatenation in
order is the conversation.

Scale: turns are range-partitioned in their order, tied and repeated ones by where they are stored, so a conversation (or one
repeated turn) with a third of all turns is spread over many tasks.
Costs of a run of turns form a small matrix (state before, state after) and matrices of consecutive
runs combine by (min, +). A first pass gives the matrix of each partition's first and last run;
only these, two rows a partition, are combined on the driver, for the states at the partition borders. A second
pass traces each run back between its known states and renders it.

Edge cases: roles are compared trimmed and in lower case with common aliases; an unknown or null role is
relabelled; a null text is empty; turns are ordered by turn (null first), then role and a hash of the text, so repeated rows are
consecutive turns of one role; null conversation ids form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "customer": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant",
           "ai": "assistant", "chatgpt": "assistant", "instruction": "system", "developer": "system"}
COSTS = {"merge": 1, "relabel": 2, "relabel_unknown": 1, "insert": 3}

#: States: nothing read yet, or the role of the open turn.
START = 0
STATES = ("start", *ROLES)
_FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
_ENDS = (0, 2, 3)
_UNKNOWN = len(ROLES)
_FAR = 1 << 40


@dataclass(frozen=True)
class Step:
    """How one turn is read from one state to another: its cost, the empty turns before it, and whether it is merged."""

    cost: int
    inserted: tuple[int, ...]
    merged: bool


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns (their states) that lead from one state to another."""
    best = {}
    for s in range(len(STATES)):
        todo, seen = [(s, ())], {s: ()}
        for at, path in todo:
            for n in _FOLLOWS[at]:
                if n not in seen:
                    seen[n] = (*path, n)
                    todo.append((n, seen[n]))
        best.update({(s, e): p for e, p in seen.items()})
    return best


def _steps(costs: dict[str, int]) -> list[list[list[Step | None]]]:
    """By role (unknown last), state before and state after: the cheapest reading of a turn."""
    paths = _insertions()
    out = []
    for role in range(len(ROLES) + 1):
        own = role + 1 if role < _UNKNOWN else None
        table = []
        for s in range(len(STATES)):
            row: list[Step | None] = []
            for e in range(len(STATES)):
                options = []
                if e != START:
                    named = 0 if e == own else costs["relabel"] if own else costs["relabel_unknown"]
                    if s == e:
                        options.append(Step(named + costs["merge"], (), True))
                    options += [Step(named + costs["insert"] * len(p), p, False) for m in range(len(STATES)) if e in _FOLLOWS[m]
                                for p in [paths.get((s, m))] if p is not None]
                row.append(min(options, key=lambda o: (o.cost, not o.merged, o.inserted), default=None))
            table.append(row)
        out.append(table)
    return out


class Repair:
    """Forward pass with shared transitions: costs are kept relative to the cheapest, so few cost vectors occur."""

    def __init__(self, costs: dict[str, int] | None = None):
        self.steps = _steps(costs or COSTS)
        self.known: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int, tuple[int, ...]]] = {}

    @staticmethod
    def first(state: int) -> tuple[int, ...]:
        return tuple(0 if s == state else _FAR for s in range(len(STATES)))

    def read(self, vector: tuple[int, ...], role: int) -> tuple[tuple[int, ...], int, tuple[int, ...]]:
        """(costs after the turn less the least, the least, the state before for each state after)."""
        got = self.known.get((vector, role))
        if got is None:
            cost, came = [], []
            for e in range(len(STATES)):
                c, s = min(((vector[s] + st.cost, s) for s in range(len(STATES)) if (st := self.steps[role][s][e])), default=(_FAR, 0))
                cost.append(min(c, _FAR))
                came.append(s)
            least = min(cost)
            got = self.known[(vector, role)] = (tuple(min(c - least, _FAR) if c < _FAR else _FAR for c in cost), least, tuple(came))
        return got

    def matrix(self, roles: list[int]) -> list[list[int]]:
        """Least costs from each state to each state over a run of turns."""
        out = []
        for s in range(len(STATES)):
            vector, base = self.first(s), 0
            for r in roles:
                vector, least, _ = self.read(vector, r)
                base += least
            out.append([v + base if v < _FAR else _FAR for v in vector])
        return out

    def trace(self, roles: list[int], entry: int, end: int | None) -> list[tuple[int, Step]]:
        """The state after each turn and how it is read, from ``entry`` to ``end`` (None: the cheapest legal end)."""
        vector, came = self.first(entry), []
        for r in roles:
            vector, _, c = self.read(vector, r)
            came.append(c)
        if end is None:
            end = min(_ENDS, key=lambda s: (vector[s], s))
        out = []
        for r, c in zip(reversed(roles), reversed(came)):
            out.append((end, self.steps[r][c[end]][end]))
            end = c[end]
        return out[::-1]


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else _UNKNOWN


#: Closes a turn.
END = "\n<|end|>\n"


def render(before: int, after: int, step: Step, text: str) -> str:
    """One input turn's piece of the conversation; the open turn stays open for a merge."""
    if step.merged:
        return "\n" + text
    close = "" if before == START else END
    empty = "".join(f"<|{STATES[s]}|>{END}" for s in step.inserted)
    return f"{close}{empty}<|{STATES[after]}|>\n{text}"


_OUT = "conv_id bigint, turn bigint, position bigint, action string, new_role string, inserted int, cost int, piece string, is_last boolean"
_OUT_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("action", pa.string()), ("new_role", pa.string()),
                        ("inserted", pa.int32()), ("cost", pa.int32()), ("piece", pa.string()), ("is_last", pa.bool_())])


def _runs(batches) -> Iterator[tuple[int | None, list]]:
    """Consecutive rows of one conversation: (conv_id, rows)."""
    conv, rows, begun = None, [], False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and row[0] != conv:
                yield conv, rows
                rows = []
            conv, begun = row[0], True
            rows.append(row)
    if begun:
        yield conv, rows


def _border_states(borders: list, repair: Repair) -> dict[tuple[int, bool], tuple[int, int, int, bool]]:
    """(entry, end, turns before, whether the conversation ends there) of each partition's first and last run, from their matrices in partition order."""
    out: dict[tuple[int, bool], tuple[int, int, int, bool]] = {}
    chain: list = []

    def settle():
        vector, came = [0 if s == START else _FAR for s in range(len(STATES))], []
        for b in chain:
            step = [min((vector[s] + b["matrix"][s][e], s) for s in range(len(STATES))) for e in range(len(STATES))]
            vector, back = [c for c, _ in step], [s for _, s in step]
            came.append(back)
        end = min(_ENDS, key=lambda s: (vector[s], s))
        before = sum(b["turns"] for b in chain)
        for b, back in zip(reversed(chain), reversed(came)):
            before -= b["turns"]
            for edge in b["edges"]:
                out[(b["part"], edge)] = (back[end], end, before, b is chain[-1])
            end = back[end]
        chain.clear()

    for b in sorted(borders, key=lambda r: (r["part"], r["last"])):
        edges = [e for e, on in ((False, b["first"]), (True, b["last"])) if on]
        # a conversation goes on over a border where the run before ended its partition and this one begins the next
        if chain and not (b["first"] and chain[-1]["conv_id"] == b["conv_id"] and chain[-1]["last"]):
            settle()
        chain.append({**b.asDict(), "edges": edges})
    if chain:
        settle()
    return out


def repair_turns(turns: DataFrame, costs: dict[str, int] | None = None) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text), in repaired form.

    position: place in the conversation from 0; action: keep, relabel, merge or relabel+merge; new_role;
    inserted: empty turns put before it; cost; piece: rendered text; is_last: the conversation's last turn.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal texts are told apart by where they are stored, so that any number of tied turns is split over tasks
    digest, place = C.scratch_name("digest"), C.scratch_name("place")
    keys = ["conv_id", "turn", "role", digest, place]
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text",
                        F.md5("text").alias(digest), F.monotonically_increasing_id().alias(place))
    # checkpoint() keeps the partitions as they are, which both passes rely on
    sorted_turns = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(digest, place).checkpoint()

    def edges(batches):
        repair, part, ends = Repair(costs), TaskContext.get().partitionId(), []
        for conv, run in _runs(batches):
            ends = [*ends[:1], (conv, run)]
        for i, (conv, run) in enumerate(ends):
            yield pa.RecordBatch.from_pylist([{"part": part, "first": i == 0, "last": i == len(ends) - 1, "conv_id": conv, "turns": len(run),
                                               "matrix": repair.matrix([role_number(r[2]) for r in run])}], schema=pa.schema([
                ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("conv_id", pa.int64()), ("turns", pa.int64()),
                ("matrix", pa.list_(pa.list_(pa.int64())))]))

    borders = sorted_turns.mapInArrow(edges, "part int, first boolean, last boolean, conv_id bigint, turns bigint, matrix array<array<bigint>>").collect()
    shared = C.broadcast(_border_states(borders, Repair(costs)))

    def traced(batches):
        repair, part = Repair(costs), TaskContext.get().partitionId()
        runs = _runs(batches)
        run, first = next(runs, None), True
        while run is not None:
            following = next(runs, None)
            known = shared.value.get((part, False)) if first else shared.value.get((part, True)) if following is None else None
            entry, end, before, last = known or (START, None, 0, True)
            yield from _rendered(repair, run[0], run[1], entry, end, before, last)
            run, first = following, False

    return sorted_turns.mapInArrow(traced, _OUT)


def _rendered(repair: Repair, conv: int | None, rows: list, entry: int, end: int | None, before: int, last: bool):
    roles = [role_number(r[2]) for r in rows]
    state = entry
    for at in range(0, len(rows), C.TEXT_BATCH_ROWS) if rows else ():
        if at == 0:
            path = repair.trace(roles, entry, end)
        out: list[list] = [[] for _ in _OUT_ARROW]
        for i in range(at, min(at + C.TEXT_BATCH_ROWS, len(rows))):
            after, step = path[i]
            is_last = last and i == len(rows) - 1
            relabelled = roles[i] != after - 1
            action = "+".join([*["relabel"] * relabelled, *["merge"] * step.merged]) or "keep"
            for c, v in zip(out, (conv, rows[i][1], before + i, action, STATES[after], len(step.inserted), step.cost,
                                  render(state, after, step, rows[i][3] or "") + END * is_last, is_last)):
                c.append(v)
            state = after
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _OUT_ARROW)], schema=_OUT_ARROW)


def conversations(repaired: DataFrame) -> DataFrame:
    """conv_id, turns, cost of every conversation (text stays in its pieces, whose number has no bound)."""
    return repaired.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("cost").alias("cost"))
