"""Free-form requests, consent as of the request, decisions as a stream, events in event-time order."""

import datetime as dt
import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lendgov.functions import hashing as HS
from lendgov.functions.prefix import last_known
from lendgov.operators import audit as AU
from lendgov.operators import consent as CO
from lendgov.operators import requests as RQ
from lendgov.session import checkpoint_path
from lendgov.streaming import jobs as ST


def bodies(spark, *texts):
    return RQ.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string"))


def test_bodies_that_say_the_same_have_the_same_hash(spark):
    same = ['{"b": 1, "a": {"z": [3, {"y": null, "x": "é"}], "k": 1.50}}', ' {"a":{"k":1.5,"z":[3.0,{"x":"\\u00e9","y":null}]},\n"b":1.0}']
    rows = bodies(spark, *same, '{"b": 1, "a": {"z": [{"y": null, "x": "é"}, 3], "k": 1.50}}').select(RQ.canonical("request").alias("c"), RQ.request_hash("request").alias("h")).collect()
    assert rows[0].c == '{"a":{"k":1.5,"z":[3,{"x":"é","y":null}]},"b":1}' and rows[0].h == rows[1].h != rows[2].h


def test_what_is_no_object_is_marked(spark):
    rows = bodies(spark, "[1]", "3", '{"a": 1, "a": 2}', "{", "", None, "null", "{}").select("id", RQ.canonical("request").alias("c")).orderBy("id").collect()
    assert [r.c for r in rows] == [None] * 7 + ["{}"]


def test_a_given_null_blocks_the_default(spark):
    df = bodies(spark, '{"LoanAmount": 1200, "Loan_Amount_Term": 12}', '{"LoanAmount": 1200, "Loan_Amount_Term": 12, "emi": null}',
                '{"LoanAmount": 1200, "Loan_Amount_Term": 12, "emi": 7}', '{"LoanAmount": "1200", "emi": "x"}', "broken")
    rows = RQ.served(df, ["id"]).orderBy("id").collect()
    assert [r.emi for r in rows] == [100.0, None, 7.0, None, 0.0]
    p = df.select(RQ.present("request", "emi").alias("p"), RQ.value("request", "emi").alias("v")).collect()
    assert [(r.p, r.v) for r in p] == [(False, None), (True, None), (True, 7.0), (True, None), (False, None)]
    projected = RQ.project(df, ["id"]).orderBy("id").collect()
    assert projected[0].LoanAmount == 1200.0 and projected[0].Gender is None


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_last_known_of_several_values(spark, ranges):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, rng.choice([None, rng.randrange(9)]), rng.choice([None, None, "x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, a int, b string").repartition(5)
    got = {r.t: (r.la, r.lb) for r in last_known(df, ["k"], ["t"], ["a", "b"], ["la", "lb"], ranges).collect()}
    seen = {}
    for k, t, a, b in rows:
        la, lb = seen.get(k, (None, None))
        seen[k] = (la if a is None else a, lb if b is None else b)
        assert got[t] == seen[k]


def test_consent_as_of_each_row(spark):
    rng = random.Random(1)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    events = [(i, rng.choice([1, 1, 1, 2]), at(rng.randrange(200)), rng.choice(["A", "B", "Z"]), rng.choice([True, False, None])) for i in range(300)]
    rows = [(i, rng.choice([1, 1, 2, 3]), at(rng.randrange(200)), "kept") for i in range(400)]
    e = spark.createDataFrame(events, "event_id long, applicant_id long, ts timestamp_ntz, group_name string, allowed boolean")
    d = spark.createDataFrame(rows, "application_id long, applicant_id long, at timestamp_ntz, extra string")
    got = CO.with_flags_as_of(d, e, ["A", "B"], "at")
    assert got.columns == [*d.columns, "ok_A", "ok_B"]
    for r in got.collect():
        for g, flag in (("A", r.ok_A), ("B", r.ok_B)):
            before = [(ts, i, ok) for i, who, ts, name, ok in events if who == r.applicant_id and name == g and ts <= r.at and ok is not None]
            assert flag == (max(before)[2] if before else True)
    assert got.count() == 400


def event_stream(spark, rows, cut):
    """Rows as event files in the given order, ``cut`` to a file, each file its own micro-batch."""
    run = f"ordered-{uuid.uuid4().hex[:8]}"
    base = checkpoint_path(spark, os.path.join("tests", run))
    src, sink = os.path.join(base, "src"), os.path.join(base, "sink")
    end = [(ST.END_KEY, max(r[1] for r in rows) + dt.timedelta(days=30), 0, -1, "{}")]
    for k, at in enumerate(range(0, len(rows) + 1, cut)):
        part = rows[at:at + cut] or end
        spark.createDataFrame(part, ST.EVENT_SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"part={k:06d}"))
    if rows[len(rows) // cut * cut:]:
        spark.createDataFrame(end, ST.EVENT_SCHEMA).coalesce(1).write.parquet(os.path.join(src, "part=999999"))
    return src, sink, run


@pytest.mark.parametrize("cut", [7, 60])
def test_any_split_into_batches_gives_the_batch_chain(spark, cut):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    # events come up to two days late, some at the same time, most of one chain
    events = [(rng.choice([1, 1, 1, 2, 3]), start + dt.timedelta(hours=rng.randrange(400) // 3, microseconds=rng.randrange(3)), 0, i, json.dumps({"payload": f"p{i}"})) for i in range(60)]
    arrival = sorted(events, key=lambda e: e[1] + dt.timedelta(hours=rng.randrange(36)))
    src, sink, run = event_stream(spark, arrival, cut)
    q = ST.governance_chain(spark, src, sink, run, max_files=1)
    q.awaitTermination()
    assert q.exception() is None
    got = spark.read.parquet(sink).select(F.col("key").alias("chain_id"), "id", "seq", "previous_hash", "output_hash")
    df = spark.createDataFrame([(k, ts, i, json.loads(b)["payload"]) for k, ts, _, i, b in events], "chain_id long, ts timestamp, id long, payload string")
    want = AU.chain_links(df, "chain_id", ["ts", "id"], "payload", ["id"]).select("chain_id", "id", "seq", "previous_hash", "output_hash")
    assert got.count() == 60 and got.exceptAll(want).count() == 0


def test_stream_of_decisions_equals_the_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    s, b = (q[n](spark, SF_SMALL) for n in ("stream_decisions", "decide_as_of"))
    assert s.columns == b.columns and b.count() > 0
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
    latest = q["decide_batch"](spark, SF_SMALL).select("application_id", F.col("consent_applied").alias("c"))
    assert b.join(latest, "application_id").where("c <> consent_applied").count() > 0  # the time of the request matters
    links = b.withColumn("ok", F.col("previous_hash").isNull() == (F.col("seq") == 1))
    assert links.where("not ok").count() == 0


def test_every_line_is_accepted_blank_or_rejected(spark):
    run = f"lines-{uuid.uuid4().hex[:8]}"
    base = checkpoint_path(spark, os.path.join("tests", run))
    src, sink = os.path.join(base, "src"), os.path.join(base, "sink")
    good = '{"timestamp": "2024-01-01T00:00:00Z", "feature": "emi", "allowed": true, "model_version": "v"}'
    lines = [good, "", "  \t", "{", "[1]", '{"allowed": true}', '{"feature": "x", "allowed": "yes"}', '{"feature": "x"}', '{"feature": null}', '{"feature": "x", "allowed": null}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    for _ in range(2):  # a second run finds nothing new
        ST.access_log_ingest(spark, src, sink, run).awaitTermination()
    all_lines = spark.read.parquet(sink)
    assert all_lines.count() == len(lines) and sorted(r.line for r in all_lines.collect()) == list(range(1, len(lines) + 1))
    assert [(r.line, r.reason) for r in ST.rejected(spark, sink).orderBy("line").collect()] == [
        (4, "not JSON"), (5, "not an object"), (6, "no feature"), (7, "allowed is not boolean"), (9, "no feature")]
    assert [(r.feature, r.allowed) for r in ST.accepted(spark, sink).orderBy("feature", "allowed").collect()] == [("emi", True), ("x", None), ("x", None)]


def test_judged_lines_parse_a_line_once_and_judge_as_before(spark, tmp_path):
    from lendgov.sources import files as FS
    from lendgov.streaming import jobs as ST

    given = {'{"timestamp":"t","feature":"f","allowed":true,"model_version":"m"}': ("accepted", None),
             '{"feature":"f","allowed":null}': ("accepted", None), '{"feature":"f","more":{"a":[1]}}': ("accepted", None),
             '{"timestamp":"t","feature":"f","allowed":"yes","model_version":"m"}': ("rejected", "allowed is not boolean"),
             '{"timestamp":1,"feature":"f","allowed":"yes","model_version":"m"}': ("rejected", "timestamp is not string"),
             '{"feat":"f"}': ("rejected", "no feature"), '[1]': ("rejected", "not an object"), 'null': ("rejected", "not an object"),
             '{"feature":': ("rejected", "not JSON"), '  ': ("blank", None)}
    (tmp_path / "a.txt").write_text("\n".join(given) + "\n")
    out = FS.judged_lines(spark.read.text(str(tmp_path / "a.txt")), ST.ACCESS_SCHEMA)
    assert {r["value"]: (r["status"], r["reason"]) for r in out.collect()} == given
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(") + plan.count("ParseJson") + plan.count("parseJson") == 1 and plan.count("from_json(") <= 1
    assert all((r["record"] is not None) == (r["status"] == "accepted") for r in out.collect())
