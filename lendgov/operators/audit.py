"""Hash-chained audit logs: links, tips, verification, recent events.

A chain is sequential by nature: link i hashes link i-1's hash. Chains are
independent of each other, so rows are hash-partitioned by chain and sorted
within partitions, and a per-partition fold streams Arrow batches carrying
only (chain, last hash, seq). A hot chain costs one task's time, never its
memory: nothing collects a chain into one buffer.

Verification needs no fold: every link's hash is recomputed row by row, and
linkage is an equi self-join on (chain_id, seq) = (chain_id, seq + 1), whose
key is unique per row (no skew).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import LINK_FORMATS, canonical, link_text, sha256, short_hash
from ..functions.prefix import distributed_rank
from .monitoring import iso_text


def chain_links(df: DataFrame, chain_col: str, order_cols: Sequence[str], payload_col: str,
                carry_cols: Sequence[str], num_partitions: int | None = None,
                seed: DataFrame | None = None, link: str = "text", spelled: dict[str, Column] | None = None) -> DataFrame:
    """Emit every link: carry columns + seq (1-based) + previous_hash + output_hash.

    ``payload_col`` is the canonical text of the link without the previous hash.
    ``seed`` (chain_col, tip_hash, last_seq), e.g. ``chain_tips`` of the stored
    log, continues existing chains when a new batch is appended; chains absent
    from it start fresh. ``link`` names the payload format (``hashing.LINK_FORMATS``).
    ``spelled``: payload or carry columns that are computed from those of ``df`` once its rows are in order, so that long texts
    are not shuffled.
    """
    before, quote, none, after = LINK_FORMATS[link]
    carry = [c for c in carry_cols if c not in (chain_col,)]
    spelled = spelled or {}
    schema_of = df.withColumns(spelled).schema
    fields = [schema_of[chain_col]] + [schema_of[c] for c in carry] + [
        T.StructField("seq", T.LongType()), T.StructField("previous_hash", T.StringType()),
        T.StructField("output_hash", T.StringType())]
    schema = T.StructType(fields)
    d = df if spelled else df.select(chain_col, *order_cols, payload_col, *[c for c in carry if c not in order_cols])
    if seed is not None:
        d = d.join(seed.select(chain_col, F.col("tip_hash").alias("_seed_hash"),
                               F.col("last_seq").cast("long").alias("_seed_seq")), chain_col, "left")
    else:
        d = d.withColumn("_seed_hash", F.lit(None).cast("string")).withColumn("_seed_seq", F.lit(0).cast("long"))
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(n, chain_col).sortWithinPartitions(chain_col, *order_cols)
    out_cols = [chain_col] + carry
    if spelled:
        d = d.withColumns(spelled).select(*out_cols, payload_col, "_seed_hash", "_seed_seq")

    def fold(batches):
        last_chain, last_hash, seq = object(), None, 0
        for pdf in batches:
            prev, outs, seqs = [], [], []
            for ch, pl, sh, ss in zip(pdf[chain_col].tolist(), pdf[payload_col].tolist(),
                                      pdf["_seed_hash"].tolist(), pdf["_seed_seq"].tolist()):
                if ch != last_chain:
                    last_chain = ch
                    last_hash = sh if isinstance(sh, str) else None
                    seq = int(ss) if ss == ss and ss is not None else 0
                seq += 1
                text = pl + before + (quote + last_hash + quote if last_hash is not None else none) + after
                h = hashlib.sha256(text.encode("utf-8")).hexdigest()
                prev.append(last_hash)
                outs.append(h)
                seqs.append(seq)
                last_hash = h
            res = pdf[out_cols].copy()
            res["seq"] = seqs
            res["previous_hash"] = prev
            res["output_hash"] = outs
            yield res

    return d.mapInPandas(fold, schema)


# The fields of an alert event that its link hashes.
ALERT_LINK_KEYS = ["details", "event_key", "event_type", "fairness_snapshot", "sensitive_feature"]


def append_alerts(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Alert events as links of the governance log, one chain per sensitive attribute.

    ``stored`` is the log so far: events whose ``event_key`` it already holds are
    left out (a rerun appends nothing) and chains go on from its tips.
    """
    if stored is not None:
        events = events.join(stored.select("event_key").distinct(), "event_key", "left_anti")
    payload = canonical([(k, F.col(k)) for k in ALERT_LINK_KEYS])
    seed = chain_tips(stored, "sensitive_feature") if stored is not None else None
    return chain_links(events.withColumn("payload", payload), "sensitive_feature", ["event_key"], "payload",
                       ["event_type", "fairness_snapshot", "details", "event_key"], seed=seed)


def chain_tips(links: DataFrame, chain_col: str = "chain_id") -> DataFrame:
    """Last hash of each chain (partial max_by: skew-safe)."""
    return links.groupBy(chain_col).agg(F.max("seq").alias("last_seq"),
                                         F.max_by("output_hash", "seq").alias("tip_hash"),
                                         F.count(F.lit(1)).alias("n_links"))


def verify(log: DataFrame, payload: Column, chain_col: str = "chain_id", strict: bool = False, link: str = "text") -> DataFrame:
    """H5: per-link violations. Returns chain_id, seq, content_ok, link_ok.

    content_ok: the stored hash equals the recomputed one.
    link_ok: previous_hash equals the previous link's output_hash; a link whose
    predecessor is missing (deleted row) fails unless it is the first kept link
    of its chain, whose previous_hash is unchecked (unless ``strict``: then it
    must be null).
    """
    rows = log.select(chain_col, "seq", short_hash(F.col("previous_hash")).alias("_previous"), short_hash(F.col("output_hash")).alias("_output"),
                      (sha256(link_text(payload, F.col("previous_hash"), link)) == F.col("output_hash"))
                      .alias("content_ok"))
    pred = rows.select(F.col(chain_col).alias("_c"), (F.col("seq") + 1).alias("_s"),
                       F.col("_output").alias("_ph"))
    first = log.groupBy(chain_col).agg(F.min("seq").alias("_first"))
    # what is left of the hashes are two flags, before rows move on to their chain's first place
    j = rows.join(pred, (F.col(chain_col) == F.col("_c")) & (F.col("seq") == F.col("_s")), "left").select(
        chain_col, "seq", "content_ok", F.col("_previous").isNull().alias("_head"),
        (F.col("_ph").isNotNull() & F.col("_previous").eqNullSafe(F.col("_ph"))).alias("_follows")).join(first, chain_col)
    is_first = F.col("seq") == F.col("_first")
    head_ok = F.col("_head") if strict else F.lit(True)
    return j.select(chain_col, "seq", "content_ok", F.when(is_first, head_ok).otherwise(F.col("_follows")).alias("link_ok"))


def verify_summary(checks: DataFrame, chain_col: str = "chain_id") -> DataFrame:
    """Per chain: counts of bad links and a validity flag."""
    return checks.groupBy(chain_col).agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(~F.col("content_ok")).alias("content_violations"),
        F.count_if(~F.col("link_ok")).alias("link_violations"),
        F.bool_and(F.col("content_ok") & F.col("link_ok")).alias("valid"))


def recent_events(log: DataFrame, limit: int = 100, json_schema: str = "k INT") -> DataFrame:
    """W6 + X10: newest governance events; JSON text parsed, missing text read as {}."""
    top = log.orderBy(F.col("ts").desc(), F.col("chain_id").desc(), F.col("seq").desc()).limit(limit)
    parsed = F.from_json(F.coalesce(F.col("details"), F.lit("{}")), json_schema)
    return top.select("chain_id", "seq", F.concat(iso_text("ts"), F.lit("Z")).alias("timestamp"),
                      "event_type", "model_version", "previous_hash", "output_hash",
                      parsed.alias("details_parsed"))


def segmented_chain(df: DataFrame, chain_col: str, segment_col: str, order_cols: Sequence[str],
                    payload_col: str, carry_cols: Sequence[str],
                    num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Hash chains split into (chain, segment) pieces folded in parallel, plus an anchor chain.

    A single chain is one sequential fold; when one chain holds a large share of
    all rows, cut it into segments (e.g. the day): each segment is its own chain
    (first previous_hash null), and an anchor chain per chain hashes the segment
    tips in segment order, so changing, deleting or reordering any link still
    breaks a recomputed hash. Returns (links, anchors).
    """
    key = F.concat_ws("|", F.col(chain_col).cast("string"), F.col(segment_col).cast("string"))
    d = df.withColumn("_seg_chain", key)
    carry = [chain_col, segment_col] + [c for c in carry_cols if c not in (chain_col, segment_col)]
    links = chain_links(d, "_seg_chain", order_cols, payload_col, carry, num_partitions)
    tips = links.groupBy(chain_col, segment_col).agg(
        F.max_by("output_hash", "seq").alias("tip_hash"), F.count(F.lit(1)).alias("n_links"))
    tips = tips.withColumn("payload", canonical([("n_links", F.col("n_links")), ("segment", F.col(segment_col)),
                                                 ("tip_hash", F.col("tip_hash"))]))
    anchors = chain_links(tips, chain_col, [segment_col], "payload",
                          [segment_col, "tip_hash", "n_links"], num_partitions)
    return links.drop("_seg_chain"), anchors


def row_segments(df: DataFrame, chain_col: str, order_cols: Sequence[str], rows: int, out: str = "segment") -> DataFrame:
    """Adds a segment number that changes every ``rows`` links of a chain, for ``segmented_chain``: no fold is longer.

    The places come from a distributed rank, so a chain with a third of all rows is cut evenly too.
    """
    ranked = distributed_rank(df, [chain_col], order_cols, "_place")
    return ranked.withColumn(out, F.floor((F.col("_place") - 1) / F.lit(rows)).cast("bigint")).drop("_place")


def verify_segmented(links: DataFrame, anchors: DataFrame, payload: Column, chain_col: str,
                     segment_col: str) -> DataFrame:
    """Per chain: link and anchor checks; the anchor's tips must equal the segments' recomputed tips."""
    seg_key = F.concat_ws("|", F.col(chain_col).cast("string"), F.col(segment_col).cast("string"))
    seg_checks = verify(links.withColumn("_sc", seg_key), payload, chain_col="_sc")
    seg_bad = seg_checks.join(links.withColumn("_sc", seg_key).select("_sc", chain_col).distinct(), "_sc") \
        .groupBy(chain_col).agg(F.count_if(~(F.col("content_ok") & F.col("link_ok"))).alias("segment_violations"))
    tips = links.groupBy(chain_col, segment_col).agg(F.max_by("output_hash", "seq").alias("tip_now"),
                                                      F.count(F.lit(1)).alias("n_now"))
    a = anchors.join(tips, [chain_col, segment_col], "full_outer")
    tip_bad = a.groupBy(chain_col).agg(F.count_if(
        ~F.coalesce((F.col("tip_hash") == F.col("tip_now")) & (F.col("n_links") == F.col("n_now")), F.lit(False)))
        .alias("tip_mismatches"))
    anchor_payload = canonical([("n_links", F.col("n_links")), ("segment", F.col(segment_col)),
                                ("tip_hash", F.col("tip_hash"))])
    anc = verify(anchors, anchor_payload, chain_col=chain_col).groupBy(chain_col).agg(
        F.count_if(~(F.col("content_ok") & F.col("link_ok"))).alias("anchor_violations"))
    out = seg_bad.join(tip_bad, chain_col, "full_outer").join(anc, chain_col, "full_outer")
    return out.select(chain_col, *[F.coalesce(F.col(c), F.lit(0)).alias(c)
                                   for c in ("segment_violations", "tip_mismatches", "anchor_violations")]) \
        .withColumn("valid", (F.col("segment_violations") + F.col("tip_mismatches") + F.col("anchor_violations")) == 0)
