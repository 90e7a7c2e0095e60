"""Operator 12: importance resampling towards a target corpus, over hashed word windows.

An untrained pre-tokeniser of ``tokenizers`` (a Split by a regular expression, nothing learned) reads each whole text,
lower-cased in A-Z only, and returns its words with their offsets. The words joined by one space give each window of
consecutive words by the pair (start of its first word, end of its last word); the CRC-32 of that slice names its bucket.
Histograms of the buckets over all documents and over the target give each bucket a gain, the scaled log ratio of
the two smoothed shares. A document's weight is the sum of the gains of its windows; Gumbel noise from a
hash of its id makes the highest scores a draw without replacement in proportion to the weights.

Texts are read once: the buckets of a document are stored as a list of numbers, which the histogram and the sums then read.
Only the histograms (``buckets`` numbers each) reach the driver. The draw is a rank over range partitions.

Edge cases: a null or empty text has no words, weight 0, and is never drawn; repeated rows are scored and drawn one by one
(equal ids have equal noise); a null id counts as an empty one and comes before all others in ties; no documents, or none long
enough, draw nothing; an empty target gives every bucket of the target a count of 0; a long text is read in pieces that end
between words, and windows reach over the pieces; extra columns stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import distributed_rank
from . import common as C

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{SEPARATORS}]+"
ORDERS = (1, 1)
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of a text that the pre-tokeniser gets at once.
PIECE = 1 << 16


class Windows:
    """Buckets of the word windows of a text; builds its pre-tokeniser once per worker."""

    def __init__(self, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS):
        self.orders, self.buckets, self.split = orders, buckets, None

    def __getstate__(self):
        return self.__dict__ | {"split": None}

    def words(self, text: str) -> Iterator[list[bytes]]:
        """The words of one piece of the text after the other."""
        from tokenizers import PreTokenizedString, Regex, pre_tokenizers

        if self.split is None:
            self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        raw = text.encode().lower()  # of bytes: A-Z only
        end_of_word = re.compile(f"[{SEPARATORS}]".encode())
        at = 0
        while at < len(raw):
            stop = end_of_word.search(raw, at + PIECE)
            piece = raw[at:stop.start() if stop else len(raw)]
            read = PreTokenizedString(piece.decode())
            self.split.pre_tokenize(read)
            yield [piece[a:b] for _, (a, b), _ in read.get_splits("original", "byte")]
            at += len(piece)

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every window)."""
        least, most = self.orders
        n, out, carried = 0, [], []
        for words in self.words(text):
            n += len(words)
            if most == 1:
                out += [zlib.crc32(w) % self.buckets for w in words] if least == 1 else []
                continue
            run, old = carried + words, len(carried)
            joined = b" ".join(run)
            ends = np.cumsum([len(w) + 1 for w in run]).tolist()
            pairs = [(e - 1 - len(w), e - 1) for w, e in zip(run, ends)]
            for k in range(least, most + 1):
                # windows that end in this piece
                out += [zlib.crc32(joined[pairs[i - k + 1][0]:pairs[i][1]]) % self.buckets for i in range(max(old, k - 1), len(run))]
            carried = run[-(most - 1):]
        return n, np.array(out, np.int32)


_HASHED = "id bigint, place bigint, n_words bigint, buckets array<int>"


def hashed(docs: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """id, place (which row it is), n_words and the bucket of every window of every row of ``docs`` (id, place, text)."""
    windows = Windows(orders, buckets)
    schema = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.list_(pa.int32()))])

    def read(batches):
        for batch in batches:
            got = [windows(t or "") for t in batch.column(2).to_pylist()]
            ends = np.cumsum([0, *(len(b) for _, b in got)])
            flat = np.concatenate([b for _, b in got]) if got else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([n for n, _ in got], pa.int64()), lists], schema=schema)

    return docs.select(F.col("id").cast("bigint"), F.col("place").cast("bigint"), F.col("text").cast("string")).mapInArrow(read, _HASHED)


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: counted in each task first, ``buckets`` numbers at most a task and in all."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets."""
    b = len(source)
    s_all, t_all = float(int(source.sum()) + b), float(int(target.sum()) + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, place, n_words, n_features and weight (sum of gains) of every row."""
    shared = C.broadcast(gain)

    @F.arrow_udf("bigint")
    def weight(lists: pa.Array) -> pa.Array:
        # a running sum over all windows of the batch, read at the ends of its rows
        upto = np.concatenate([[0], np.cumsum(shared.value[lists.flatten().to_numpy(zero_copy_only=False)])])
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())

    return rows.select("id", "place", "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight("buckets").alias("weight"))


def noise(seed: int):
    """floor(-1000 ln(-ln u)) of an id, u in (0, 1) from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def scored(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS,
           min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """id, place, n_features, weight, score and rank (null: not drawn) of every row of ``docs`` (id, place, text).

    ``percent`` per cent of the rows with at least ``min_words`` words are drawn, towards ``target`` (text).
    """
    rows = C.written(hashed(docs, orders, buckets), "importance-buckets")
    aim = hashed(target.select(F.lit(None).cast("bigint").alias("id"), F.lit(0).alias("place"), "text"), orders, buckets)
    gain = gains(histogram(rows, buckets), histogram(aim, buckets))
    w = weighed(rows, gain)
    s = C.written(w.withColumn("score", F.col("weight") + noise(seed)), "importance-scores")
    long_enough = s.where(F.col("n_words") >= min_words)
    draw = percent * long_enough.count() // 100
    ranked = (distributed_rank(long_enough.withColumns({"one": F.lit(0), "down": -F.col("score")}), ["one"], ["down", "id", "n_features", "place"], "rank")
              .withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))))
    columns = ["id", "place", "n_features", "weight", "score", "rank"]
    short = s.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*columns).unionByName(short.select(*columns))


def placed(docs: DataFrame) -> DataFrame:
    """(id, place, text): a row's place tells repeated rows apart. ``docs`` must read the same each time, as a stored table does."""
    return docs.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("place"), "text")


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs`` themselves, whole and with all their columns, in no order."""
    mark = C.scratch_name("place")
    picked = scored(placed(docs), target, **how).where("rank is not null").select(F.col("place").alias(mark))
    return docs.withColumn(mark, F.monotonically_increasing_id()).join(picked, mark, "left_semi").drop(mark)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
