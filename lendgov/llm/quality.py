"""Operator 4: a quality classifier from weak labels.

1. Labellers: heuristics on a document's length, symbols, capitals, exclamation marks, repeated words and
   lines, separators, line ends, word lengths and letters object to it or abstain; one more votes for documents that nobody objects to.
2. Expectation-maximisation over the counts of all documents' vote patterns (a bounded number: one bit for each
   labeller) estimates how often each labeller votes in either class. It starts from documents
   without an objection as the good ones; no label is read.
3. The posterior of its pattern is a document's label. A linear scorer over hashed features (shapes of
   four characters, by character class, and buckets of the labellers' measures) is trained on a bounded
   sample, at most ``SAMPLE_DOCS`` of each posterior class, and scores every document's whole text. Rows with equal id and text
   are one row of the sample with their number as its weight.

Edge cases: null and empty texts have no characters and get the lowest length bucket; if all documents vote alike
there is one class to learn and scores are its share; rows are independent, so repeated rows and null ids keep
their rows; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE_DOCS = 2000
HASH_BITS = 14
SHAPE = 4
BUCKETS = 8
SEED = 4

#: name, limits, and whether high is good: objects at or below the first limit where high is good, else at or above the second.
LABELLERS = (
    ("words", 2.0, 20.0, True),
    ("symbols_per_word", 0.05, 0.3, False),
    ("capital_share", 0.15, 0.4, False),
    ("exclamations_per_word", 0.05, 0.3, False),
    ("repeated_word_share", 0.05, 0.2, False),
    ("repeated_line_share", 0.1, 0.5, False),
    ("separators_per_word", 0.02, 0.15, False),
    ("sentence_end_share", 0.3, 0.7, True),
    ("mean_word_chars", 2.0, 3.0, True),
    ("letter_share", 0.6, 0.75, True),
)
#: Upper ends of the buckets that a measure falls in, as parts of its labeller's upper limit.
_EDGES = np.array([0.01, 0.1, 0.25, 0.5, 0.75, 1.0, 2.0])

_UPPER = bytes(range(65, 91))
_LETTERS = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalpha())
_SYMBOLS = b"#*$%&<>^~{}=\\@_"
_ENDS = (b".", b"!", b"?", b":", b'"', b")", "…".encode(), "”".encode(), "»".encode())

#: Character classes: letters by case, digits, blanks and line ends; every other ASCII character is its own class.
_CLASS = np.array([1 if chr(c).islower() and c < 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in (9, 32) else 5 if c in (10, 13)
                   else 6 if c >= 128 else 7 + c % 121 for c in range(256)], np.uint32)


def _held(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def measures(text: str | None) -> list[float]:
    """One number for each labeller."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = max(len(words), 1)
    lines = [s for x in raw.split(b"\n") if (s := x.strip())]
    letters = _held(raw, _LETTERS)
    dense = max(len(raw) - sum(map(raw.count, (b" ", b"\n", b"\t", b"\r"))), 1)
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [float(len(words)), _held(raw, _SYMBOLS) / n, _held(raw, _UPPER) / max(letters, 1), raw.count(b"!") / n, same / n,
            (len(lines) - len(set(lines))) / max(len(lines), 1), raw.count(b"|") / n,
            (sum(x.endswith(_ENDS) for x in lines) + 1) / (len(lines) + 1), dense / n, letters / dense]


def votes(m: np.ndarray) -> np.ndarray:
    """Which labellers object, and lastly whether none does; rows are documents."""
    low, high = (np.array([x[i] for x in LABELLERS]) for i in (1, 2))
    bad = np.where(np.array([x[3] for x in LABELLERS]), m <= low, m >= high)
    return np.column_stack((bad, ~bad.any(1))).astype(np.int64)


def _pattern(v: np.ndarray) -> np.ndarray:
    return v @ (1 << np.arange(v.shape[1]))


def _of_pattern(p: np.ndarray) -> np.ndarray:
    return p[:, None] >> np.arange(len(LABELLERS) + 1) & 1


@dataclass(frozen=True)
class LabelModel:
    """P(good) and, for each class and labeller, the estimated probability that it votes."""

    prior: float
    rate: np.ndarray  # [class, labeller]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return C.sigmoid(np.log(self.prior) - np.log1p(-self.prior) + v @ (np.log(self.rate[1]) - np.log(self.rate[0])))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, smooth: float = 0.5) -> LabelModel:
    """Expectation-maximisation over vote patterns; starts from the view that one objection is enough.

    A labeller that does not vote abstains and says nothing: each kind of bad document is seen by few of them.
    """
    v = _of_pattern(patterns)
    q = np.where(v[:, :-1].any(1), 0.05, 0.95)
    model = LabelModel(0.5, np.full((2, v.shape[1]), 0.5))
    for _ in range(rounds):
        rate = np.stack([(w @ v + smooth) / (w.sum() + 2 * smooth) for w in (counts * (1 - q), counts * q)])
        model = LabelModel(float(np.clip((counts * q).sum() / max(counts.sum(), 1e-9), 1e-3, 1 - 1e-3)), rate)
        q = model.posterior(v)
    return model


def shapes(texts: list[str | None]):
    """(owner, feature) of every window of four characters, hashed by class."""
    raw = [(t or "").encode("utf-8", "replace").replace(b"\0", b" ") for t in texts]
    for buf, owner in C.chunks(raw, SHAPE - 1):
        c = _CLASS[buf]
        n = len(c) - SHAPE + 1
        if n < 1:
            continue
        g = c[:n] | c[1:n + 1] << 7 | c[2:n + 2] << 14 | c[3:n + 3] << 21
        ok = (buf[:n] != 0) & (buf[1:n + 1] != 0) & (buf[2:n + 2] != 0) & (buf[3:n + 3] != 0)
        yield owner[:n][ok], ((g[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def buckets(m: np.ndarray) -> np.ndarray:
    """The feature of each measure's bucket, after the shapes' features."""
    high = np.array([x[2] for x in LABELLERS])
    at = np.searchsorted(_EDGES, (m / high).ravel()).reshape(m.shape)
    return (1 << HASH_BITS) + np.arange(m.shape[1]) * BUCKETS + at


N_FEATURES = (1 << HASH_BITS) + len(LABELLERS) * BUCKETS


@dataclass(frozen=True)
class QualityModel:
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, f in shapes(texts):
            total += np.bincount(owner, self.weight[f], len(texts))
            n += np.bincount(owner, minlength=len(texts))
        m = np.array([measures(t) for t in texts]).reshape(len(texts), len(LABELLERS))
        return C.sigmoid(total / np.maximum(n, 1) * _SHAPE_SCALE + self.weight[buckets(m)].sum(1) + self.bias)


#: Shapes count as their share of the text times this, to be of the size of the buckets' ones.
_SHAPE_SCALE = 10.0


def pattern_column(text: Column) -> Column:
    @F.arrow_udf("int")
    def pattern(t: pa.Array) -> pa.Array:
        m = np.array([measures(x) for x in t.to_pylist()]).reshape(len(t), len(LABELLERS))
        return pa.array(_pattern(votes(m)), pa.int32())

    return pattern.asNondeterministic()(text)


def _features(batches):
    """Sparse features of the sampled documents: shares of shapes, and buckets."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        m = np.array([measures(t) for t in texts]).reshape(len(texts), len(LABELLERS))
        own = buckets(m)
        pairs = [o * N_FEATURES + f for o, f in shapes(texts)]
        pair, n = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
        doc, f = pair // N_FEATURES, pair % N_FEATURES
        share = n / np.maximum(np.bincount(doc, n, len(texts)), 1)[doc] * _SHAPE_SCALE
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        yield pa.record_batch([batch.column(1), batch.column(2), batch.column(3),
                               pa.array([f[a:b].tolist() + own[i].tolist() for i, (a, b) in enumerate(zip(cut, cut[1:]))], pa.list_(pa.int32())),
                               pa.array([share[a:b].tolist() + [1.0] * own.shape[1] for a, b in zip(cut, cut[1:])], pa.list_(pa.float32()))],
                              names=["key", "posterior", "copies", "features", "shares"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[LabelModel | None, QualityModel]:
    """Fit on all documents' votes and a bounded sample's features."""
    voted = C.written(docs.select(F.xxhash64("doc_id", "text", F.lit(SEED)).alias("key"), pattern_column(F.col("text")).alias("pattern")), "quality-votes")
    seen = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toPandas()
    if seen.empty:
        return None, QualityModel(np.zeros(N_FEATURES), 0.0)
    pattern, n = seen["pattern"].to_numpy(np.int64), seen["n"].to_numpy(float)
    model = estimate(pattern, n)
    q = model.posterior(_of_pattern(pattern))
    good = q >= 0.5
    share = {c: min(1.0, float(sample_docs) / max(float(n[good == c].sum()), 1.0)) for c in (True, False)}
    labels = docs.sparkSession.createDataFrame([(int(p), float(x), share[bool(g)]) for p, x, g in zip(pattern, q, good)],
                                               "pattern int, posterior double, share double")
    chosen = (voted.join(F.broadcast(labels), "pattern").where(F.pmod("key", F.lit(1 << 32)) < F.col("share") * float(1 << 32))
              .groupBy("key").agg(F.max("posterior").alias("posterior"), F.count(F.lit(1)).alias("copies")))
    classes = [chosen.where(c).orderBy(F.pmod("key", F.lit(1 << 32)), "key").limit(sample_docs) for c in ("posterior >= 0.5", "posterior < 0.5")]
    picked = C.written(classes[0].unionByName(classes[1]), "quality-sample")
    keyed = docs.select("text", F.xxhash64("doc_id", "text", F.lit(SEED)).alias("key"))
    texts = keyed.join(F.broadcast(picked), "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("text", "posterior", "copies")])
    rows = texts.select("text", "key", "posterior", "copies").mapInArrow(
        _features, "key bigint, posterior double, copies bigint, features array<int>, shares array<float>").toPandas()
    if rows.empty or rows["posterior"].ge(0.5).nunique() < 2:
        p = float(np.clip((q * n).sum() / n.sum(), 1e-6, 1 - 1e-6))
        return model, QualityModel(np.zeros(N_FEATURES), float(np.log(p) - np.log1p(-p)))
    rows = rows.assign(size=rows["features"].map(len)).sort_values("key").reset_index(drop=True)  # sums must not depend on the order of tasks
    doc = np.repeat(np.arange(len(rows)), rows["size"])
    f = np.concatenate([np.asarray(x, np.int64) for x in rows["features"]])
    s = np.concatenate([np.asarray(x, float) for x in rows["shares"]])
    y = rows["posterior"].to_numpy()
    copies = rows["copies"].to_numpy(float)
    halves = copies * np.where(y >= 0.5, 0.5 / max(copies[y >= 0.5].sum(), 1), 0.5 / max(copies[y < 0.5].sum(), 1))
    weight, bias = C.fit_logistic(doc, f, s, len(rows), N_FEATURES, y, halves)
    return model, QualityModel(weight, bias)


def score_documents(docs: DataFrame, **fit) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), predicted (1 if score >= 0.5, else 0) and kept of every document."""
    shared = C.broadcast(learn(docs.select("doc_id", "text"), **fit)[1])

    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(t.to_pylist()), pa.float64())

    return (docs.select("doc_id", score.asNondeterministic()("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("kept", F.col("predicted") == 1))
