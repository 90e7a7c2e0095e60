from pyspark.sql import functions as F

from lendgov.operators import consent as CO

GROUPS = ["Financial Data", "Demographic Data"]
FG = {"LoanAmount": "Financial Data", "Gender": "Demographic Data"}


def _frame(spark, events):
    apps = spark.createDataFrame([(1, 1, 1000, "Male", 5), (2, 2, 2000, "Female", 6)],
                                 "application_id long, applicant_id long, LoanAmount long, Gender string, bank_balance long")
    ev = spark.createDataFrame(events, "event_id long, ts timestamp, applicant_id long, group_name string, allowed boolean")
    return CO.with_flags(apps, ev, GROUPS)


def test_drop_mask_denied_group_and_ungrouped(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    df = _frame(spark, [(1, t, 1, "Financial Data", False), (2, t, 1, "Unknown Group", False)])
    out = {r.application_id: r for r in CO.mask_drop(df, FG, ["LoanAmount", "Gender", "bank_balance"]).collect()}
    assert out[1].LoanAmount is None and out[1].Gender == "Male" and out[1].bank_balance == 5
    assert out[2].LoanAmount == 2000  # no events: allowed


def test_latest_wins_and_idempotent(spark):
    import datetime as dt
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    df = _frame(spark, [(1, t1, 1, "Demographic Data", True), (2, t2, 1, "Demographic Data", False)])
    once = CO.mask_drop(df, FG, ["LoanAmount", "Gender"])
    assert {r.application_id: r.Gender for r in once.collect()}[1] is None
    twice = CO.mask_drop(once.join(df.select("application_id", *[c for c in df.columns if c.startswith("ok_")]),
                                   "application_id"), FG, ["LoanAmount", "Gender"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select(*once.columns).collect()))


def test_all_true_is_identity(spark):
    df = _frame(spark, [])
    out = CO.mask_drop(df, FG, ["LoanAmount", "Gender"]).select("application_id", "LoanAmount", "Gender")
    assert sorted(map(tuple, out.collect())) == [(1, 1000, "Male"), (2, 2000, "Female")]


def test_neutral_mask(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    df = _frame(spark, [(1, t, 1, "Financial Data", False), (2, t, 1, "Demographic Data", False)])
    out = {r.application_id: r for r in CO.mask_neutral(df, FG, ["LoanAmount"], ["Gender"]).collect()}
    assert out[1].LoanAmount == 0 and out[1].Gender == "missing"


def test_feature_groups_first_wins_and_empty_dropped(spark):
    ds = spark.createDataFrame([(1, 2)], "LoanAmount long, Gender long")
    fg = {r.feature: r.group_name for r in CO.feature_groups(ds).collect()}
    assert fg["LoanAmount"] == "Financial Data" and fg["cibil_proxy_score"] == "Credit History Data"
    assert "Banking Behaviour Data" not in set(fg.values())
    assert "Married" not in fg


def test_changes(spark):
    import datetime as dt
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, "G", True), (2, dt.datetime(2024, 1, 2), 1, "G", False),
                                (3, dt.datetime(2024, 1, 3), 1, "G", False), (4, dt.datetime(2024, 1, 4), 1, "G", True)],
                               "event_id long, ts timestamp, applicant_id long, group_name string, allowed boolean")
    ch = [(r.event_id, r.change) for r in CO.consent_changes(ev).orderBy("event_id").collect()]
    assert ch == [(2, "disabled"), (4, "enabled")]


def test_profile_defaults_all_or_nothing(spark):
    apps = spark.createDataFrame([(10, 1, None, "2024-01-01")],
                                 "application_id long, applicant_id long, ApplicantIncome long, submitted_at string")
    people = spark.createDataFrame([(1,), (2,)], "applicant_id long")
    CO.PROFILE_DEFAULTS.setdefault("ApplicantIncome", 60000)
    r = {x.applicant_id: x for x in CO.profiles(people, apps, ["ApplicantIncome"]).collect()}
    assert r[1].has_profile and r[1].ApplicantIncome is None
    assert (not r[2].has_profile) and r[2].ApplicantIncome == 60000


def test_save_and_reset_events(spark):
    import datetime as dt
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    ev = spark.createDataFrame([(1, t1, 1, "Financial Data", False)],
                               "event_id long, ts timestamp, applicant_id long, group_name string, allowed boolean")
    saved = spark.createDataFrame([(2, t1, False, None, True)],
                                  "applicant_id long, ts timestamp, `Financial Data` boolean, "
                                  "`Demographic Data` boolean, `Unknown` boolean")
    ev2 = ev.unionByName(CO.state_events(saved, GROUPS, first_event_id=100))
    st = {(r.applicant_id, r.group_name): r.allowed for r in
          CO.consent_state(spark.createDataFrame([(1,), (2,)], "applicant_id long"), ev2, GROUPS).collect()}
    assert st == {(1, "Financial Data"): False, (1, "Demographic Data"): True,
                  (2, "Financial Data"): False, (2, "Demographic Data"): True}
    reset = CO.reset_events(spark.createDataFrame([(1,), (2,)], "applicant_id long"), GROUPS, t2, first_event_id=1000)
    st2 = CO.consent_state(spark.createDataFrame([(1,), (2,)], "applicant_id long"), ev2.unionByName(reset), GROUPS)
    assert all(r.allowed for r in st2.collect())
