import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendgov.llm import chat
from lendgov.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = "conv_id bigint, turn bigint, role string, text string"
FOLLOWS = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def legal(roles):
    return all(r in FOLLOWS[p] for p, r in zip([None, *roles], roles)) and (not roles or roles[-1] != "system")


def slow_cost(roles):
    """Cheapest repair, over all roles for the turns, merges and up to two empty turns before each."""
    best = 10 ** 9
    n = len(roles)
    for named in itertools.product(("system", "user", "assistant"), repeat=n):
        base = sum(0 if a == b else 2 if b in chat.ROLES else 1 for a, b in zip(named, roles))
        if base >= best:
            continue
        for merged in itertools.product((False, True), repeat=n):
            if merged[:1] == (True,) or any(m and named[i] != named[i - 1] for i, m in enumerate(merged)):
                continue
            cost = base + sum(merged)
            at = None
            for role, m in zip(named, merged):
                if not m:
                    ways = [k for k in range(4) for mid in itertools.product(chat.ROLES, repeat=k)
                            if all(b in FOLLOWS[a] for a, b in zip([at, *mid], [*mid, role]))]
                    if not ways:
                        cost = 10 ** 9
                        break
                    cost += 3 * min(ways)
                at = role
            if at != "system":
                best = min(best, cost)
    return best if n else 0


def test_cost_is_the_least():
    repair = chat.Repair()
    rng = random.Random(2)
    for _ in range(120):
        roles = [rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]) for _ in range(rng.randint(1, 4))]
        path = repair.trace([chat.role_number(r) for r in roles], chat.START, None)
        assert sum(s.cost for _, s in path) == slow_cost(roles), roles


def rendered_roles(text):
    return [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line not in ("<|end|>",)]


def whole(rows):
    """conv_id -> (text, cost) from the pieces in order."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position)):
        text, cost, n = out.get(r.conv_id, ("", 0, 0))
        assert r.position == n
        out[r.conv_id] = (text + r.piece, cost + r.cost, n + 1)
    return {k: v[:2] for k, v in out.items()}


@pytest.mark.parametrize("parts", ["1", "3", "8", "40"])
def test_borders_between_tasks_change_nothing(spark, parts):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "human", "tool", None]), f"t{c}.{t}") for c in range(6) for t in range(rng.randint(1, 40))]
    rows += [(99, t, rng.choice(["user", "assistant"]), "hot") for t in range(900)]  # most turns in one conversation
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = whole(chat.repair_turns(spark.createDataFrame(rows, COLUMNS)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    repair = chat.Repair()
    for c in {r[0] for r in rows}:
        roles = [chat.role_number(r[2]) for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert got[c][1] == sum(s.cost for _, s in repair.trace(roles, chat.START, None))
        assert legal(rendered_roles(got[c][0])) and got[c][0].endswith("<|end|>\n")
        assert got[c][0].count("<|end|>") == len(rendered_roles(got[c][0]))


def test_query_keeps_legal_conversations(spark):
    got = QUERIES["op1_chat_repair"](spark, SF).collect()
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert len(got) == len(turns)
    roles = {}
    for t in sorted(turns, key=lambda t: (t.conv_id, t.turn)):
        roles.setdefault(t.conv_id, []).append(t.role)
    for c, (text, cost) in whole(got).items():
        assert legal(rendered_roles(text))
        assert (cost == 0) == legal(roles[c])
        if cost == 0:
            assert rendered_roles(text) == roles[c]


def test_edges(spark):
    rows = [(None, 0, "user", "a"), (None, 1, None, "b"), (1, None, "Human", None), (1, 0, " Assistant ", "x"), (1, 0, " Assistant ", "x"),
            (2, 0, "system", "only"), (3, 0, "assistant", "first"), (4, 0, "user", "long " * 200_000)]
    schema = T.StructType([*spark.createDataFrame([], COLUMNS).schema.fields, T.StructField("position", T.StringType()), T.StructField("cost", T.StringType())])
    got = chat.repair_turns(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).collect()
    out = whole(got)
    assert len(got) == len(rows) and all(legal(rendered_roles(t)) for t, _ in out.values())
    assert out[1] == ("<|user|>\n\n<|end|>\n<|assistant|>\nx\nx\n<|end|>\n", 1)
    assert out[2][1] == 2 and out[3][1] == 2 and rendered_roles(out[None][0]) == ["user", "assistant"]
    assert chat.repair_turns(spark.createDataFrame([], COLUMNS)).count() == 0
    assert chat.conversations(chat.repair_turns(spark.createDataFrame(rows, COLUMNS))).count() == 5


def test_tied_turns_are_split_over_tasks(spark):
    # 30,000 equal turns, and as many that tie on conversation and turn only
    turns = spark.range(0, 60_000, 1, 6).selectExpr("7L as conv_id", "3L as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "if(id % 2 = 0, 'same', cast(id as string)) as text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = chat.repair_turns(turns)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        rows = got.select("position", "action", "new_role", "inserted", "cost", "is_last").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) == 8 and max(sizes) < 15_000
    assert sorted(r.position for r in rows) == list(range(60_000)) and sum(r.is_last for r in rows) == 1
    roles = ["assistant"] * 30_000 + ["user"] * 30_000
    assert sum(r.cost for r in rows) == sum(s.cost for _, s in chat.Repair().trace([chat.role_number(r) for r in roles], chat.START, None))
