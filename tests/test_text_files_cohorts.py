import os
import tempfile

from pyspark.sql import functions as F

from lendgov.functions import text as TX
from lendgov.operators import cohorts as CH
from lendgov.sources import files as FS


def _one(spark, col, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(col(F.col("t"))).collect()]


def test_gate(spark):
    assert _one(spark, TX.is_banking, ["My card is hard", "hello", None]) == [True, False, False]


def test_amount(spark):
    assert _one(spark, TX.loan_amount, ["need 40,000 or 8,00,000", "2024", "50000"]) == [800000.0, None, 50000.0]


def test_routing(spark):
    assert _one(spark, TX.intent, ["income to EMI ratio", "EMI ratio", "my cibil", "hi"]) == \
        ["income", "emi_ratio", "credit", "retrieval"]


def test_access_log_scan(spark):
    d = tempfile.mkdtemp(prefix="lendgov-test-")
    p = os.path.join(d, "log.json")
    with open(p, "w") as f:
        f.write('{"timestamp": "2024-01-01T00:00:00Z", "feature": "a", "allowed": true, "model_version": "v"}\n')
        f.write("\n")
        f.write('{"timestamp": "2024-01-01T00:00:01Z", "feature": "b", "allo\n')
        f.write('{"timestamp": "2024-01-01T00:00:02Z", "feature": "c"}\n')
    rows = FS.read_access_log(spark, p).collect()
    assert [(r.feature, r.allowed) for r in rows] == [("a", True), ("c", None)]


def test_missing_csv_and_registry_default(spark):
    assert FS.read_loans_csv(spark, "/nonexistent/x.csv") is None
    assert FS.availability(None) == (False, "credit_data.csv not found")
    assert FS.read_model_version(spark, "/nonexistent.json").collect()[0].version == "indian_v1"


def test_empty_range_falls_back(spark):
    base = spark.createDataFrame([(i, 100000.0 + i, 1000.0 * i, 1) for i in range(50)],
                                 "application_id long, LoanAmount double, bank_balance double, Credit_History int")
    for c in ("total_income", "income_to_emi_ratio", "cibil_proxy_score", "mobile_usage_score",
              "transaction_stability_score", "credit_utilization"):
        base = base.withColumn(c, F.col("bank_balance"))
    amounts = spark.createDataFrame([(100000.0,), (9000000.0,)], "amount double")
    out = {r.amount: r for r in CH.cohort_stats(amounts, base).collect()}
    assert out[9000000.0].uses_fallback and out[9000000.0].cohort_rows == 50
    assert not out[100000.0].uses_fallback and out[100000.0].cohort_rows == 50
    assert out[None].cohort_rows == 50


def _loans(spark, n, seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    loans = np.concatenate((rng.integers(50000, 3000000, n), [70000, 130000, 0, 233333.1], [100000 * 0.7, 100000 * 1.3])).astype(float)
    stats = {c: np.where(rng.random(len(loans)) < 0.05, np.nan, rng.lognormal(3, 2, len(loans)).round(1)) for _, c in CH.STATS}
    stats["bank_balance"] = np.full(len(loans), 7.0)  # a statistic with one value
    rows = [(i, float(v), int(i % 3 == 0), *[None if np.isnan(stats[c][i]) else float(stats[c][i]) for _, c in CH.STATS]) for i, v in enumerate(loans)]
    names = ", ".join(f"{c} double" for _, c in CH.STATS)
    return spark.createDataFrame(rows, f"application_id long, LoanAmount double, Credit_History int, {names}"), loans, stats


def test_cohorts_match_bruteforce(spark):
    import numpy as np
    base, loans, stats = _loans(spark, 3000, 5)
    am = [100000.0, 100001.0, 333333.0, 333333.0, 1000000.0, 1000000.5, 2500000.0, 9e9, 60000.0]
    out = {r.amount: r for r in CH.cohort_stats(spark.createDataFrame([(a,) for a in am], "amount double"), base).collect()}
    assert set(out) == {*am, None}
    for a in out:
        inside = np.ones(len(loans), bool) if a is None else (loans >= a * 0.7) & (loans <= a * 1.3)
        assert out[a].uses_fallback == (a is not None and not inside.any())
        inside = inside if inside.any() else np.ones(len(loans), bool)
        assert out[a].cohort_rows == inside.sum()
        assert abs(out[a].good_share - np.mean([i % 3 == 0 for i in np.flatnonzero(inside)])) < 1e-12
        for pre, c in CH.STATS:
            v = stats[c][inside]
            for q in (25, 50, 75):
                assert abs(out[a][f"{pre}_q{q}"] - np.quantile(v[~np.isnan(v)], q / 100)) < 1e-9, (a, pre, q)


def test_cohorts_of_nothing(spark):
    base, _, _ = _loans(spark, 10, 1)
    none = spark.createDataFrame([], "amount double")
    assert [(r.amount, r.cohort_rows) for r in CH.cohort_stats(none, base).collect()] == [(None, 16)]
    empty = CH.cohort_stats(spark.createDataFrame([(100000.0,)], "amount double"), base.where("false")).collect()
    assert {r.amount: (r.cohort_rows, r.good_share, r.bal_q50) for r in empty} == {None: (0, None, None), 100000.0: (0, None, None)}


def test_dyadic_nodes_cover_a_range_once(spark):
    rows = [(lo, hi) for lo in range(0, 20, 3) for hi in range(lo, 40, 7)]
    got = spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", CH._nodes(F.col("lo"), F.col("hi"), 6).alias("n")).collect()
    for r in got:
        cover = [s for x in r.n for s in range(x.node << x.level, (x.node + 1) << x.level)]
        assert sorted(cover) == list(range(r.lo, r.hi + 1))


def test_credit_question_without_loans_gets_the_retrieval_answer(spark):
    from lendgov.operators import advice as AD
    stats = CH.cohort_stats(spark.createDataFrame([], "amount double"), _loans(spark, 5, 2)[0].where("false"))
    q = spark.createDataFrame([(1, "Which CIBIL score is enough?", True, "credit", None, None, None)],
                              "id long, question string, is_banking boolean, intent string, amount double, last_decision string, main_negative_feature string")
    assert AD.answers(q, stats).first().answer.startswith(AD.RETRIEVAL_BASE)


def test_decision_as_of_the_question(spark):
    import datetime as dt
    import random
    from lendgov.operators import advice as AD
    rng = random.Random(3)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    who = lambda: 1 if rng.random() < 0.7 else rng.randint(2, 9)  # noqa: E731  a hot applicant
    dec = [(who(), day(rng.randint(0, 60)), i, "approved" if i % 2 else "denied", f"f{i % 4}") for i in range(400)]
    ask = [(i, who(), day(rng.randint(0, 60))) for i in range(300)]
    d = spark.createDataFrame(dec, "applicant_id long, submitted_at timestamp_ntz, application_id long, decision string, main_negative_feature string")
    q = spark.createDataFrame(ask, "question_id long, applicant_id long, asked_at timestamp_ntz")
    got = {r.question_id: r["last"] for r in AD.decision_as_of(q, d).collect()}
    for i, a, t in ask:
        best = max(((x[1], x[2]) for x in dec if x[0] == a and x[1] <= t), default=None)
        assert (got[i] and got[i].application_id) == (best and best[1])


def test_fixed_rounding_matches_python(spark):
    vals = [100.625, 0.125, 1.005, 2.675, -0.5, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(TX.fixed(F.col("x"), 2)).collect()]
    assert got == [None if v is None else format(v, ".2f") for v in vals]
    assert got[:3] == ["100.62", "0.12", "1.00"]


def test_last_access_local_ist(spark):
    import datetime as dt

    from lendgov.operators import consent as CO
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 20, 0, 0)), (1, dt.datetime(2024, 1, 1, 23, 45, 10))],
                                "applicant_id long, ts timestamp_ntz")
    r = CO.last_access_local(log).collect()[0]
    assert r.last_access_local == "2024-01-02 05:15:10 IST"


def test_access_logs_are_written_compressed_and_read_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from lendgov.sources import files as FS
    df = spark.range(20000, numPartitions=2).select(F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("f"), F.col("id") % 9).alias("feature"),
                                                    (F.col("id") % 2 == 0).alias("allowed"), F.lit("m").alias("model_version"))
    records, text = str(tmp_path / "records"), str(tmp_path / "text")
    FS.write_access_log(df, records)
    FS.write_log_lines(df.select(F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), "feature", "allowed", "model_version"))), text)
    for path in (records, text):
        got = FS.read_access_log(spark, path)
        assert got.count() == 20000 and got.select("timestamp").distinct().count() == 20000
        assert sum(f.stat().st_size for f in (tmp_path / path.rsplit("/", 1)[1]).glob("part-*")) < 20000 * 70 / 4
