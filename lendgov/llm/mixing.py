"""Operator 5: mix sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Its leading bits are a range bucket; a
distributed prefix sum of token counts over the buckets of each source finds the
bucket that the source's budget ends in. The rows of that bucket are
range-partitioned, sorted by key and summed up to the exact key and word of the cut.
A budget above the source's size takes whole epochs first and cuts the last one.

Only (source, key, size) of each row is shuffled. The cut is one row per source, so
the documents themselves are read a second time and never moved: a row's key says
which side of its source's cut it is on. A source with a third of all rows is spread
over its key buckets.

The document on the cut gives just the words that are missing. Rows with the same
source and key as the cut (repeated rows) share them evenly; what does not divide goes, a word
each, to those that are stored first, so that a source's words are its budget exactly.
(Stored first: ``docs`` must read the same each time, as a stored table does.)

Edge cases: a null text has size 0; a null source is a source of its own, last in order;
a source of size 0 has target 0; equal ids with equal text are repeated rows and are all
mixed; null ids get the key of an empty id with their text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SEED = 5
MAX_EPOCHS = 3
#: Key buckets of each source (16 to that power): a bucket is the unit of the range sort.
BUCKET_DIGITS = 3
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD_PATTERN)), F.lit(0)).cast("bigint")


def random_key(seed: int = SEED) -> Column:
    """A hash-random key of a row's id and text: 64 bits as hex digits (MD5, so that plain SQL can repeat it)."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                         F.coalesce(F.col("text"), F.lit("")))), 1, 16)


def _bucket(key: Column) -> Column:
    """Order-preserving: the key's leading digits."""
    return F.substring(key, 1, BUCKET_DIGITS)


def source_order(sources: DataFrame) -> DataFrame:
    """``sources`` (one row each) with its place by code point, null last, from 0."""
    return sources.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight), one row per source.

    All sizes together are shared by weight; no target is above ``max_epochs`` times its
    source's size, and what is cut off is shared again among the others. The sources
    that end at their limit are those with the least size for their weight, so one pass in that order finds the level.
    """
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    s = (sources.withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
         .withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
         .withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
         .withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(everything)))  # the first open one is the highest
    level = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("final") * F.col("weight")))
    return s.select("source", "source_size", level.alias("target"))


def cuts(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per source: source_size, target, epochs taken whole, and where the last epoch is cut.

    ``weights`` (source, weight) defaults to ``WEIGHTS`` repeating over the sources in order.
    """
    rows = C.written(docs.select("source", random_key(seed).alias("key"), n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("place")),
                     "mix-sizes")
    sized = rows.where("size > 0").withColumn("bucket", _bucket(F.col("key")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
        weighed = source_order(sources).withColumn("weight", F.element_at(cycle, (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double"))
        weighed = sources.join(w, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    budget = C.written(
        targets(weighed, max_epochs)
        .withColumn("budget", F.round("target").cast("bigint"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "mix-budgets")

    # prefix sums over the key buckets, at most 16 ** BUCKET_DIGITS rows a source, tell which bucket holds the cut
    in_source = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
               .withColumn("offset", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0))))
    held = (offsets.alias("o").join(budget.where("rest > 0").alias("b"), F.col("o.source").eqNullSafe(F.col("b.source")))
            .where("o.offset < b.rest and b.rest <= o.offset + o.bucket_size")
            .select(F.col("o.source").alias("cut_source"), F.col("o.bucket").alias("cut_bucket"), "o.offset", "b.rest"))
    # the keys of those buckets, range-partitioned and sorted; rows with equal keys are one row, a step of the running sum
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_bucket = W.partitionBy("cut_source", "cut_bucket").orderBy("key")
    found = (sized.join(held, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("bucket") == F.col("cut_bucket")))
             .groupBy("cut_source", "cut_bucket", "offset", "rest", "key").agg(F.sum("size").alias("here"), F.count(F.lit(1)).alias("cut_rows"))
             .repartitionByRange(parts, "cut_source", "cut_bucket")
             .select("cut_source", "key", "rest", (F.col("offset") + F.sum("here").over(in_bucket)).alias("upto"), "here", "cut_rows")
             .where("upto >= rest and upto - here < rest")
             .groupBy("cut_source").agg(F.max("key").alias("cut_key"), F.max("cut_rows").alias("cut_rows"),
                                        F.max(F.expr("rest - (upto - here)")).alias("cut_words")))
    plan = C.written(budget.join(found, F.col("source").eqNullSafe(F.col("cut_source")), "left")
                     .select("source", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_rows"), "mix-cuts")
    last = _last_with_one_more(rows.where("size > 0").select("source", "key", "place"), plan)
    return C.written(plan.join(last, F.col("source").eqNullSafe(F.col("one_more_source")), "left").drop("one_more_source"), "mix-plan")


def _last_with_one_more(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(one_more_source, one_more): the rows on a cut share its words evenly, and those up to the place ``one_more`` take one more.

    Counts per stored partition tell in which one that place lies; only its rows on the cut are ordered.
    """
    odd = (plan.where("cut_words % cut_rows > 0")
           .select(F.col("source").alias("one_more_source"), "cut_key", F.expr("cut_words % cut_rows").alias("extra")))
    part = F.shiftright("place", 33)  # of monotonically_increasing_id
    tied = (rows.join(odd, F.col("source").eqNullSafe(F.col("one_more_source")) & (F.col("key") == F.col("cut_key")))
            .select("one_more_source", "extra", part.alias("part"), "place"))
    before = W.partitionBy("one_more_source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    held = (tied.groupBy("one_more_source", "extra", "part").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("need", F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0)))
            .where("need > 0 and need <= n").select(F.col("one_more_source").alias("s"), F.col("part").alias("p"), "need"))
    own = tied.join(held, F.col("one_more_source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return (own.withColumn("nth", F.row_number().over(W.partitionBy("one_more_source", "part").orderBy("place")))
            .where("nth = need").select("one_more_source", F.col("place").alias("one_more")))


def mixed(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with one struct column ``mix`` (size, source_size, target, epochs, last): words the mix takes from each row.

    ``epochs`` whole repeats are taken, then the first ``last`` words.
    """
    plan = cuts(docs, weights, max_epochs, seed)
    names = {c: C.scratch_name(c) for c in ("src", "key", "size", "place", *plan.columns)}
    plan = plan.select(*[F.col(c).alias(names[c]) for c in plan.columns])
    d = docs.withColumns({names["key"]: random_key(seed), names["size"]: n_words(F.col("text")), names["place"]: F.monotonically_increasing_id()})
    joined = d.join(plan, d["source"].eqNullSafe(F.col(names["source"])))
    key, size, cut = (F.col(names[c]) for c in ("key", "size", "cut_key"))
    one_more = F.coalesce((F.col(names["place"]) <= F.col(names["one_more"])).cast("bigint"), F.lit(0))
    last = (F.when(cut.isNull() | (key > cut), F.lit(0)).when(key < cut, size)
            .otherwise(F.least(size, F.expr(f"{names['cut_words']} div {names['cut_rows']}") + one_more)).cast("bigint"))
    mix = F.struct(size.alias("size"), F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"),
                   F.col(names["epochs"]).alias("epochs"), last.alias("last"))
    tag = names["src"]
    return joined.withColumn(tag, mix).select(*[d[c] for c in docs.columns], F.col(tag).alias("mix") if "mix" not in docs.columns else tag)


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    m = F.col("mix")
    return (mixed(docs.select("doc_id", "text", "source"), **how)
            .select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"),
                    (m["size"] * m["epochs"] + m["last"]).alias("taken")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, the one on the cut shortened; columns as in ``docs``.

    A document of size 0 takes no words, costs nothing and goes.
    """
    tag = C.scratch_name("part")
    m = mixed(docs, **how)
    mix = m.columns[-1]
    parts = F.concat(F.array_repeat(F.col(mix)["size"], F.col(mix)["epochs"].cast("int")), F.array(F.col(mix)["last"]))
    out = m.withColumn(tag, F.explode(F.filter(parts, lambda n: n > 0)))
    short = F.col(tag) < F.col(mix)["size"]
    out = out.withColumn("text", F.when(short, first_words(F.col("text"), F.col(tag))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(short, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
