import hashlib

from pyspark.sql import functions as F

from lendgov.functions.hashing import canonical
from lendgov.operators import audit as AU


def _log(spark, n=6, chains=2):
    rows = [(c, i, f"e{c}-{i}", None if i == 2 else "v1") for c in range(chains) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "chain_id long, k long, details string, model_version string")
    df = df.withColumn("model_version", F.coalesce("model_version", F.lit("unknown")))
    df = df.withColumn("payload", canonical([("details", F.col("details")), ("model_version", F.col("model_version"))]))
    return AU.chain_links(df, "chain_id", ["k"], "payload", ["k", "details", "model_version"], num_partitions=3)


def _payload():
    return canonical([("details", F.col("details")), ("model_version", F.col("model_version"))])


def test_links_match_python(spark):
    links = _log(spark).where("chain_id = 0").orderBy("seq").collect()
    prev = None
    for r in links:
        text = f"details={r.details}|model_version={r.model_version}|previous_hash={prev or 'null'}"
        assert r.output_hash == hashlib.sha256(text.encode()).hexdigest()
        assert r.previous_hash == prev
        prev = r.output_hash


def test_verify_intact(spark):
    s = AU.verify_summary(AU.verify(_log(spark), _payload())).collect()
    assert all(r.valid for r in s)


def test_verify_one_byte_changed(spark):
    log = _log(spark).withColumn("details", F.when((F.col("chain_id") == 0) & (F.col("seq") == 3),
                                                    F.lit("e0-X")).otherwise(F.col("details")))
    chk = AU.verify(log, _payload()).where("NOT content_ok OR NOT link_ok").collect()
    assert [(r.chain_id, r.seq, r.content_ok, r.link_ok) for r in chk] == [(0, 3, False, True)]


def test_verify_hash_rewritten_breaks_next_link(spark):
    # attacker rewrites row 3 and its hash: content passes, the link after it fails
    log = _log(spark)
    bad = log.withColumn("details", F.when((F.col("chain_id") == 0) & (F.col("seq") == 3), F.lit("e0-X"))
                         .otherwise(F.col("details")))
    from lendgov.functions.hashing import link_text, sha256
    bad = bad.withColumn("output_hash", F.when((F.col("chain_id") == 0) & (F.col("seq") == 3),
                                               sha256(link_text(_payload(), F.col("previous_hash"))))
                         .otherwise(F.col("output_hash")))
    chk = AU.verify(bad, _payload()).where("NOT content_ok OR NOT link_ok").collect()
    assert [(r.seq, r.content_ok, r.link_ok) for r in chk] == [(4, True, False)]


def test_verify_deleted_row_and_head(spark):
    log = _log(spark).where("NOT (chain_id = 0 AND seq = 3)")
    chk = AU.verify(log, _payload()).where("NOT link_ok").collect()
    assert [(r.chain_id, r.seq) for r in chk] == [(0, 4)]
    pruned = _log(spark).where("NOT (chain_id = 1 AND seq = 1)")
    assert AU.verify(pruned, _payload()).where("NOT link_ok").count() == 0
    assert AU.verify(pruned, _payload(), strict=True).where("NOT link_ok").count() == 1


def test_tips(spark):
    t = AU.chain_tips(_log(spark)).orderBy("chain_id").collect()
    assert [r.last_seq for r in t] == [6, 6]


def _seg(spark):
    rows = [(c, i, i // 3, f"e{c}-{i}") for c in range(2) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "chain_id long, k long, seg long, details string")
    df = df.withColumn("payload", canonical([("details", F.col("details"))]))
    return df


def test_segmented_chain_verify_and_tamper(spark):
    df = _seg(spark)
    links, anchors = AU.segmented_chain(df, "chain_id", "seg", ["k"], "payload", ["k", "details"], 3)
    pay = canonical([("details", F.col("details"))])
    ok = AU.verify_segmented(links, anchors, pay, "chain_id", "seg").collect()
    assert all(r.valid for r in ok) and anchors.count() == 8  # chains x segments (0..3)
    bad = links.withColumn("details", F.when((F.col("chain_id") == 1) & (F.col("k") == 5), F.lit("x"))
                           .otherwise(F.col("details")))
    res = {r.chain_id: r for r in AU.verify_segmented(bad, anchors, pay, "chain_id", "seg").collect()}
    assert res[0].valid and not res[1].valid and res[1].segment_violations == 1
    gone = links.where("NOT (chain_id = 0 AND k = 9)")  # tail row of the last segment deleted
    res = {r.chain_id: r for r in AU.verify_segmented(gone, anchors, pay, "chain_id", "seg").collect()}
    assert not res[0].valid and res[0].tip_mismatches == 1


def test_single_segment_equals_plain_chain(spark):
    df = _seg(spark).withColumn("seg", F.lit(0))
    links, _ = AU.segmented_chain(df, "chain_id", "seg", ["k"], "payload", ["k"], 3)
    plain = AU.chain_links(df, "chain_id", ["k"], "payload", ["k"], 3)
    a = sorted((r.chain_id, r.seq, r.output_hash) for r in links.collect())
    b = sorted((r.chain_id, r.seq, r.output_hash) for r in plain.collect())
    assert a == b


def test_append_continues_from_tips(spark):
    rows = [(c, i, f"e{c}-{i}", "v1") for c in range(3) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "chain_id long, k long, details string, model_version string")
    df = df.withColumn("payload", _payload())
    full = AU.chain_links(df, "chain_id", ["k"], "payload", ["k"], 3)
    in_first = "chain_id < 2 AND k <= 5"  # chain 2 appears only in the second batch
    first = AU.chain_links(df.where(in_first), "chain_id", ["k"], "payload", ["k"], 3)
    second = AU.chain_links(df.where(f"NOT ({in_first})"), "chain_id", ["k"], "payload", ["k"], 3,
                            seed=AU.chain_tips(first))
    both = first.unionByName(second)
    a = sorted((r.chain_id, r.k, r.seq, r.previous_hash, r.output_hash) for r in full.collect())
    b = sorted((r.chain_id, r.k, r.seq, r.previous_hash, r.output_hash) for r in both.collect())
    assert a == b


def test_json_payload_equals_sorted_key_json(spark):
    import hashlib
    import json

    from pyspark.sql import functions as F

    from lendgov.functions import hashing as HS
    from lendgov.operators import audit as AU

    texts = ["plain", 'q"b\\s/', "n\nt\tr\r\b\f\x01\x7f", "é ₹ \U0001f600", "", None]
    rows = [(1, i, t, "decision") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chain_id long, n int, details string, event_type string")
    payload = HS.sorted_json([("event_type", HS.json_string(F.col("event_type"))), ("details", HS.json_string(F.col("details")))])
    links = AU.chain_links(df.withColumn("payload", payload), "chain_id", ["n"], "payload", ["n", "details", "event_type"], link="json")
    previous = None
    for r in links.orderBy("seq").collect():
        text = json.dumps({"previous_hash": previous, "details": texts[r.n], "event_type": "decision"}, sort_keys=True)
        assert r.previous_hash == previous and r.output_hash == hashlib.sha256(text.encode()).hexdigest()
        previous = r.output_hash
    checks = AU.verify(links, payload, link="json")
    assert checks.where("content_ok and link_ok").count() == len(texts)


def test_alert_events_are_appended_once(spark):
    from lendgov.operators import audit as AU
    rows = [("Gender", "bias-alert", "{}", '{"a":1}', "k1"), ("Area", "bias-alert", "{}", '{"a":2}', "k2")]
    cols = "sensitive_feature string, event_type string, fairness_snapshot string, details string, event_key string"
    log = AU.append_alerts(spark.createDataFrame(rows, cols))
    assert AU.append_alerts(spark.createDataFrame(rows, cols), log).count() == 0
    more = AU.append_alerts(spark.createDataFrame([*rows, ("Gender", "bias-alert", "{}", '{"a":3}', "k3")], cols), log).collect()
    first = {r.sensitive_feature: r.output_hash for r in log.collect()}
    assert [(r.seq, r.previous_hash) for r in more] == [(2, first["Gender"])]


def test_credit_g_file_has_typed_columns(spark, tmp_path):
    from lendgov.operators import prep as PR
    from lendgov.sources import files as FS
    p = str(tmp_path / "credit.csv")
    with open(p, "w") as f:
        f.write("duration,checking_status,credit_amount,class\n6,'<0',1169,good\n48,'no checking',5951.5,bad\n")
    df = FS.read_credit_g(spark, p)
    assert PR.split_by_dtype(df, exclude=["class"]) == (["duration", "credit_amount"], ["checking_status"])


def test_distributed_rank_equals_a_window(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lendgov.functions.prefix import distributed_rank

    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc") if rng.random() < 0.9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long")
    for n in (1, 3, 16):
        got = {(r.k, r.o): r["rank"] for r in distributed_rank(df, ["k"], ["o"], num_ranges=n).collect()}
        want = {(r.k, r.o): r.rn for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o"))).collect()}
        assert got == want


def test_hashes_are_shuffled_as_bytes_and_no_text_is_lost(spark):
    """hash texts become 32 bytes on the way; texts that are no hash stay apart from them and come back."""
    from lendgov.functions import hashing as HS
    texts = ["a" * 64, "0123456789abcdef" * 4, "A" * 64, "a" * 63, "a" * 65, "", "a" * 64 + "\n", "x" * 32, "\x00" * 33, None, "é" * 64]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", HS.short_hash(F.col("t")).alias("b")).withColumn("back", HS.long_hash(F.col("b"))).orderBy("i").collect()
    assert [r.back for r in rows] == texts
    assert [len(r.b) for r in rows[:2]] == [32, 32] and all(len(r.b) != 32 for r in rows[2:] if r.b is not None)
    assert len({bytes(r.b) for r in rows if r.b is not None}) == len(texts) - 1


def test_verify_with_odd_texts_and_repeated_links(spark):
    """previous hashes that are no hashes, missing links and repeated rows are judged as by the texts themselves."""
    import hashlib
    h = lambda p, prev: hashlib.sha256(f"k={p}|previous_hash={prev or 'null'}".encode()).hexdigest()
    a = h(1, None)
    b = h(2, a)
    rows = [(1, 1, 1, None, a), (1, 2, 2, a, b), (1, 4, 4, b, h(4, b)),  # a link is missing
            (2, 1, 1, "odd", "odd tip"), (2, 2, 2, "odd tip", h(2, "odd tip")), (2, 3, 3, "ODD", h(3, "ODD")),
            (3, 5, 1, a, h(1, a)), (3, 6, 2, h(1, a), h(2, h(1, a))), (3, 6, 2, h(1, a), h(2, h(1, a)))]
    log = spark.createDataFrame(rows, "chain_id long, seq long, k int, previous_hash string, output_hash string")
    payload = F.concat(F.lit("k="), F.col("k").cast("string"))
    got = sorted((r.chain_id, r.seq, r.content_ok, r.link_ok) for r in AU.verify(log, payload).collect())
    assert got == [(1, 1, True, True), (1, 2, True, True), (1, 4, True, False), (2, 1, False, True), (2, 2, True, True), (2, 3, True, False),
                   (3, 5, True, True), (3, 6, True, True), (3, 6, True, True)]
    strict = {(r.chain_id, r.seq): r.link_ok for r in AU.verify(log, payload, strict=True).collect()}
    assert strict[(1, 1)] and not strict[(2, 1)] and not strict[(3, 5)]


def test_texts_are_spelled_after_the_shuffle(spark):
    """with ``spelled`` the links are the same, and the shuffle carries the bytes only."""
    df = spark.range(200).selectExpr("id % 7 AS chain_id", "id AS k", "unhex(sha2(cast(id AS string), 256)) AS b")
    text = F.lower(F.hex("b"))
    want = AU.chain_links(df.withColumn("t", text).withColumn("payload", F.concat(F.lit("t="), "t")), "chain_id", ["k"], "payload", ["k", "t"], 3)
    got = AU.chain_links(df, "chain_id", ["k"], "payload", ["k", "t"], 3, spelled={"t": text, "payload": F.concat(F.lit("t="), text)})
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "hex(" in plan[:plan.index("RepartitionByExpression")] and "hex(b" not in plan[plan.index("RepartitionByExpression"):]
