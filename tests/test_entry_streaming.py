from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["section", "item", "label", "n", "value"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_streaming_chain_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    s = q["stream_governance_chain"](spark, SF_SMALL).select("chain_id", "seq", "output_hash")
    b = q["governance_chain"](spark, SF_SMALL).select("chain_id", "seq", "output_hash")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_streaming_consent_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    s = q["stream_consent_state"](spark, SF_SMALL).select("applicant_id", "group_name", "allowed")
    b = q["consent_latest"](spark, SF_SMALL).select("applicant_id", "group_name", "allowed")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_streaming_volume_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    s = q["stream_daily_volume"](spark, SF_SMALL)
    b = q["applications"](spark, SF_SMALL).groupBy(F.to_date("submitted_at").alias("day")).agg(
        F.count("*").alias("n"))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_access_stream_drops_nothing_valid(spark):
    import __spark_entry__ as E
    q = E.queries()
    assert q["stream_access_log"](spark, SF_SMALL).count() == q["access_log"](spark, SF_SMALL).count()


def test_daily_volume_late_data_dropped(spark):
    import datetime as dt
    import os
    import uuid

    from lendgov.session import checkpoint_path
    from lendgov.streaming import jobs as ST

    run = f"late-{uuid.uuid4().hex[:8]}"
    base = checkpoint_path(spark, os.path.join("tests", run))
    src, sink = os.path.join(base, "src"), os.path.join(base, "sink")
    schema = ST.DECISION_SCHEMA
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    first = [(i, day(1 + i % 5), "approved", 0.9, "Male", 1, "Urban") for i in range(50)]
    spark.createDataFrame(first, schema).write.parquet(os.path.join(src, "b=1"))
    ST.daily_volume(spark, src, sink, run).awaitTermination()
    # late row for day 1 (watermark is already past it) + a sentinel far ahead closing day 5
    late = [(999, day(1), "approved", 0.9, "Male", 1, "Urban"), (1000, day(20), "denied", 0.1, "Male", 1, "Urban")]
    spark.createDataFrame(late, schema).write.parquet(os.path.join(src, "b=2"))
    ST.daily_volume(spark, src, sink, run).awaitTermination()
    got = {r.day.day: r.n for r in spark.read.parquet(sink).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 10, 5: 10}


def test_bias_stream_equals_batch(spark):
    import __spark_entry__ as E
    from lendgov.operators import fairness as FA
    from lendgov.plans.common import views
    from lendgov.streaming import jobs as ST

    s = E.queries()["stream_bias_alerts"](spark, SF_SMALL).select("window_day", "sensitive_feature", "metric", "value")
    r = views(spark, SF_SMALL).risk.select(F.col("submitted_at").cast("timestamp").alias("ts"), "decision", *ST.BIAS_ATTRIBUTES)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), FA.group_label(a).alias("g")) for a in ST.BIAS_ATTRIBUTES]))
    long = r.select(F.window("ts", "7 days").start.alias("window_start"),
                    (F.col("decision") == "approved").cast("long").alias("y"), pairs.alias("p"))
    totals = long.groupBy("window_start", F.col("p.a").alias("sensitive_feature"), F.col("p.g").alias("group_value")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("n_selected"))
    b = ST.window_alerts(totals).select(F.to_date("window_start").alias("window_day"), "sensitive_feature", "metric", F.round("value", 9).alias("value"))
    assert b.count() > 0 and s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_bias_alerts_over_batches_that_split_the_groups(spark):
    """Groups of one window come in different batches; an alert is raised late, stands while nothing changes, and is cleared."""
    import datetime as dt
    import os
    import uuid

    from lendgov.session import checkpoint_path
    from lendgov.streaming import jobs as ST

    run = f"bias-{uuid.uuid4().hex[:8]}"
    base = checkpoint_path(spark, os.path.join("tests", run))
    src, sink = os.path.join(base, "src"), os.path.join(base, "sink")
    at = dt.datetime(2024, 1, 5, 12)
    rows = lambda n, decision, sex: [(i, at, decision, 0.5, sex, 1, "Urban") for i in range(n)]
    batches = [rows(10, "approved", "Male") + rows(10, "approved", "Female"), rows(100, "denied", "Male"),
               [(0, at + dt.timedelta(days=30), "approved", 0.5, "Male", 1, "Urban")], rows(900, "approved", "Male")]
    standing, events = [], []
    for k, b in enumerate(batches):
        spark.createDataFrame(b, ST.DECISION_SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"b={k}"))
        ST.bias_monitor(spark, src, sink, run, attributes=("Gender",)).awaitTermination()
        standing.append(sorted(r.metric for r in ST.current_alerts(spark, sink).collect()))
        got = spark.read.parquet(os.path.join(sink, "alerts"))
        events.append(sorted((r.metric, r.status) for r in got.where(F.col("batch_id") == got.agg(F.max("batch_id")).first()[0]).collect()))
    both = ["disparate_impact", "statistical_parity_difference"]
    assert standing == [[], both, both, []]
    assert events[1] == [(m, "raised") for m in both] and events[3] == [(m, "cleared") for m in both]
    di = spark.read.parquet(os.path.join(sink, "alerts")).where("metric = 'disparate_impact' and status = 'raised'").first()
    assert abs(di.value - (10 / 110) / 1.0) < 1e-9


def test_one_task_does_not_aggregate_all_state_partitions_of_a_bias_batch(spark, tmp_path, monkeypatch):
    import datetime as dt
    import uuid

    from pyspark.sql import DataFrameWriter

    from lendgov.streaming import jobs as ST

    rows = [(i, dt.datetime(2024, 1, 1 + i % 20), "approved" if i % 2 else "rejected", 0.5, "Male" if i % 2 else "Female", i % 3 % 2, "Urban") for i in range(300)]
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    spark.createDataFrame(rows, ST.DECISION_SCHEMA).repartition(2).write.parquet(src)
    plans, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: plans.append(self._df._jdf.queryExecution().logical().toString()) or real(self, path, *a, **k))
    ST.bias_monitor(spark, src, sink, f"bias-{uuid.uuid4().hex}", max_files=1).awaitTermination()
    assert len(plans) == 4 and all(p.startswith("Repartition 1, true") for p in plans)  # an exchange between the aggregate and the one file
    assert ST.current_alerts(spark, sink).count() > 0


class _Handle:
    """State in memory that counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, *_):
        return _State(self)

    getValueState = getMapState

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class _State:
    def __init__(self, handle):
        self.handle, self.held = handle, {}

    def __getattr__(self, name):
        def call(*a):
            self.handle.calls += 1
            key = a[0] if name in ("getValue", "updateValue", "removeKey") else ()
            if name == "exists":
                return () in self.held
            if name in ("update", "updateValue"):
                self.held[key] = a[-1]
                return None
            return self.held.pop(key) if name == "removeKey" else self.held[key]
        return call


def test_waiting_rows_take_few_state_calls_and_keep_their_order():
    from types import SimpleNamespace

    from lendgov.streaming import ordered as OR

    def run(cuts, marks):
        h = _Handle()
        p = OR.Links()
        p.init(h)
        out = []
        for cut, mark in zip(cuts, marks):
            list(p.handleInputRows((1,), iter([{"at_us": us, "rank": 0, "id": i, "body": '{"payload": "%d"}' % i} for us, i in cut]), None))
            for t in sorted(t for t in h.timers if t <= mark):
                h.timers.discard(t)
                out += list(p.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda: t)))
        return out, h

    hour = 3_600_000_000
    rows = [(i * hour // 10 + i, i) for i in range(500)]  # a little over two days
    whole, h = run([rows[::-1]], [10**12])
    assert [r.id for r in whole] == list(range(500)) and [r.seq for r in whole] == list(range(1, 501))
    assert not h.timers and h.calls < 50
    mark = rows[250][0] // 1000 + 1  # the watermark is at row 250's millisecond
    cut, h = run([rows[260:] + rows[:100], rows[100:260], []], [-1, mark, 10**12])
    assert cut == whole and not h.timers
    first, _ = run([rows[260:] + rows[:100], rows[100:260]], [-1, mark])
    assert [r.id for r in first] == list(range(251))
