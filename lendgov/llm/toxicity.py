"""Operator 3: toxicity by weak supervision.

1. Terms: word beginnings of 4 to 7 bytes, in words of more than 8 bytes (a word is a run of letters: a clause in
   scripts without spaces) such windows from every character on, and whole words, hashed over their full length, that
   labelled toxic documents hold much more often than others; counted in Spark, at most ``MAX_TERMS`` of them are kept.
2. Voters: the terms are dealt over many lexicon voters by lift, beside a public word list, text
   patterns and a voter for documents without any term. Each fires or abstains on the documents of a bounded
   sample of labelled rows.
3. Generative label model: expectation-maximisation estimates how often each voter fires in either class;
   correlations between voters, given the class, lower the weight of those that repeat each other.
   The given labels start it and are one more voter, whose accuracy is estimated like the others'.
4. A linear classifier over the terms' counts is trained on the posterior labels and scores every
   document's whole text.

Only rows of ``labels`` that the caller passes are learned from: at most ``SAMPLE_DOCS`` ids of each
class, picked by a hash of the id. A sampled id is one row of the sample, with the number of its document rows as its weight,
so at most twice ``SAMPLE_DOCS`` rows reach the driver. Scores depend on the text alone.

Edge cases: null and empty texts get the score of a text without terms; a missing or null label
is no label, of repeated labels the highest counts; of different texts under one id the one with the least hash stands for all; without labelled rows of both classes the public list alone
decides; repeated rows and null ids keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE_DOCS = 6000
MAX_TERMS = 4096
MIN_SUPPORT = 5
MIN_LIFT = 6.0
#: Terms are dealt over ``VOTERS_A_TIER`` voters between each two of these lifts.
LIFT_TIERS = (200.0, 50.0, 15.0)
VOTERS_A_TIER = 8
SEED = 3

#: A short public list of insults in four languages.
WORDS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "imbecile", "bastard",
         "dumpfbacke", "trottel", "arschloch", "abschaum", "connard", "salaud", "crétin", "ordure", "cabrón", "estúpido", "imbécil", "basura")
_PATTERNS = (re.compile(r"(?i)\b(?:you(?:'re| are)|du bist|tu es|eres)\b"), re.compile(r"!{2,}"), re.compile(r"(?i)\b(?:hate|kill|shut up)\b"))

#: Bytes of the windows; with its size a window fills 64 bits at most, so that different windows have different keys.
_SIZES = (4, 5, 6, 7)
#: Longer words have windows inside them too.
_SHORT = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0xC2B2AE3D27D4EB4F)
_CLEAN = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_FILTER_BITS = 20


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_CLEAN)


def _terms(texts: list[bytes]):
    """(owner, key) arrays of each piece of text: the windows of one size after the other, then the words. Owners ascend in each."""
    for buf, owner in C.chunks(texts, None):
        b = np.where(buf == 32, 0, buf).astype(np.uint64)
        inside = np.concatenate(([False], b != 0, [False]))
        starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        lens = np.flatnonzero(inside[1:-1] & ~inside[2:]) - starts + 1
        letters = np.flatnonzero(b)
        whole = np.repeat(lens, lens)
        left = np.repeat(starts + lens, lens) - letters  # bytes up to the word's end
        on = (left >= _SIZES[0]) & ((left == whole) | (whole > _SHORT)) & (b[letters] & np.uint64(0xC0) != 0x80)
        at, rest, value = letters[on], left[on], np.zeros(on.sum(), np.uint64)
        for i in range(_SIZES[0] - 1):
            value |= b[at + i] << np.uint64(8 * i)
        for n in _SIZES:
            on = rest >= n
            at, rest = at[on], rest[on]
            value = value[on] | b[at + n - 1] << np.uint64(8 * (n - 1))
            yield owner[at], (value | np.uint64(n << 56)) * _MIX
        yield owner[starts], _hashed(b[letters], whole - left, np.cumsum(lens) - lens)


def _hashed(b: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of all bytes of each word: a polynomial over their places in the word, modulo 2^64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(int(place.max()) + 1, _POWER), dtype=np.uint64)
    h = np.add.reduceat(b * power[place], starts)
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def word_keys(words) -> np.ndarray:
    """The whole-word keys of a word list."""
    return np.array(sorted({int(k[-1]) for w in words for k in [list(_terms([_bytes(w)]))[-1][1]]}), np.uint64)


class Lexicon:
    """Sorted term keys with a bitmap in front: most words of a text are ruled out by one look-up."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the terms found."""
        found = []
        for owner, key in _terms(texts):
            maybe = self.seen[key >> np.uint64(64 - _FILTER_BITS)]
            owner, key = owner[maybe], key[maybe]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            same = self.keys[at] == key if len(self.keys) else np.zeros(0, bool)
            found.append(owner[same] * np.int64(len(self.keys)) + at[same])
        pair, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        width = max(len(self.keys), 1)
        return pair // width, pair % width, n


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        doc, term, n = self.lexicon.counts([_bytes(t) for t in texts])
        return C.sigmoid(np.bincount(doc, self.weight[term] * np.log1p(n), len(texts)) + self.bias)


def label_model(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, n_signs: int, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 from 0/1 votes (rows: documents), and the estimated rates, prior and correlations.

    A voter that does not fire abstains: only fired voters speak, each with the ratio of its
    rates in the two classes, so that a document with one sure sign is not outvoted by silence. One
    voter is added that fires where none of the first ``n_signs``, the signs of class 1, does.
    The given label is one more voter, which always votes, with a hit and a false-alarm rate of its own
    to be estimated: where many sure voters contradict it, the posterior does too.
    ``weight``: labelled rows that a row of the sample stands for.
    """
    y = labels.astype(float)
    all_votes = np.column_stack((votes, ~votes[:, :n_signs].any(1), y))
    label = all_votes.shape[1] - 1
    prior, own = float(np.average(y, weights=weight)), np.ones(label + 1)
    corr, rate = np.eye(label + 1), [np.zeros(0), np.zeros(0)]
    q = 0.05 + 0.9 * y
    for _ in range(rounds):
        corr = np.zeros_like(corr)
        for c, w in ((0, weight * (1 - q)), (1, weight * q)):
            rate[c] = (w @ all_votes + 0.1) / (w.sum() + 1.0)
            r = (all_votes - rate[c]) * np.sqrt(w)[:, None]
            cov = r.T @ r
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr += cov / np.outer(sd, sd) / 2
        np.fill_diagonal(corr, 0.0)
        own = 1.0 / (1.0 + np.maximum(corr, 0.0).sum(1))
        own[label] = 1.0
        prior = min(max(float(np.average(q, weights=weight)), 1e-3), 1 - 1e-3)
        q = C.sigmoid(np.log(prior) - np.log1p(-prior) + all_votes @ (own * (np.log(rate[1]) - np.log(rate[0])))
                      + (1 - y) * (np.log1p(-rate[1][label]) - np.log1p(-rate[0][label])))
    return q, {"rate": rate, "prior": prior, "correlation": corr, "weight": own}


def _sample(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class, those with the least hashes (labelled_id, label), and each class's size."""
    one = C.written(labels.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("toxic").cast("int").alias("label"))
                    .where("label in (0, 1) and labelled_id is not null"), "toxic-labels")
    n = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = [one.where(F.col("label") == c).orderBy(C.hash_share("labelled_id", SEED), "labelled_id").limit(per_class) for c in (0, 1)]
    return C.written(least[0].unionByName(least[1]), "toxic-sample"), n


def _count_terms(batches):
    """Per batch (text, label, rows that the text stands for): in how many documents of each class a term occurs."""
    for batch in batches:
        copies = np.array(batch.column(2).to_pylist(), np.int64)
        labels = np.array(batch.column(1).to_pylist(), np.int64) * copies
        docs, keys = [], []
        for owner, key in _terms([_bytes(t) for t in batch.column(0).to_pylist()]):
            order = np.argsort(key, kind="stable")  # owners ascend, so equal pairs are neighbours
            owner, key = owner[order], key[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))[:len(key)]
            docs.append(owner[new])
            keys.append(key[new])
        doc, key = np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(keys or [np.zeros(0, np.uint64)])
        order = np.lexsort((doc, key))  # a long text's pieces repeat its pairs
        doc, key = doc[order], key[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))[:len(key)]
        doc, key = doc[new], key[new]
        key, first = np.unique(key, return_index=True)
        n, toxic = (np.add.reduceat(x[doc], first) if len(first) else first for x in (copies, labels))
        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n - toxic), pa.array(toxic)], names=["key", "clean", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, max_terms: int = MAX_TERMS,
          min_support: int = MIN_SUPPORT, min_lift: float = MIN_LIFT) -> ToxicityModel:
    """Fit on the rows of ``labels`` (doc_id, toxic); the driver gets the terms and the sampled documents' counts of them."""
    picked, labelled = _sample(labels, sample_docs)
    sample = C.written(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id"))
                       .groupBy("labelled_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"),
                                                   F.count(F.lit(1)).alias("copies")), "toxic-texts").select("text", "label", "copies")
    sizes = {r["label"]: r for r in sample.groupBy("label").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("ids")).collect()}
    n = {c: r["n"] for c, r in sizes.items()}
    public = word_keys(WORDS)
    if not (n.get(0) and n.get(1)):
        return ToxicityModel(Lexicon(public), np.full(len(public), 4.0), -2.0)
    picked_of = {c: (labelled[c], sizes[c]["ids"]) for c in (0, 1)}
    lift = ((F.col("toxic") + 0.5) / n[1]) / ((F.col("clean") + 0.5) / n[0])
    terms = (sample.mapInArrow(_count_terms, "key bigint, clean bigint, toxic bigint")
             .groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .where((F.col("toxic") >= min_support) & (lift >= min_lift))
             .orderBy(F.desc(F.col("toxic") * F.log(lift)), "key").limit(max_terms).select("key", lift.alias("lift")).toPandas())
    lift_of = dict.fromkeys(public.tolist(), LIFT_TIERS[0]) | dict(zip(terms["key"].to_numpy(np.int64).view(np.uint64).tolist(), terms["lift"].tolist()))
    lexicon = Lexicon(np.array(sorted(lift_of), np.uint64))
    shared = C.broadcast(lexicon)

    def found(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            doc, term, times = shared.value.counts([_bytes(t) for t in texts])
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            rows = [(slice(a, b)) for a, b in zip(cut, cut[1:])]
            yield pa.record_batch([pa.array(batch.column(1).to_pylist(), pa.int32()), batch.column(2),
                                   pa.array([term[r].tolist() for r in rows], pa.list_(pa.int32())),
                                   pa.array([times[r].tolist() for r in rows], pa.list_(pa.int32())),
                                   pa.array([[int(bool(p.search(t or ""))) for p in _PATTERNS] for t in texts], pa.list_(pa.int32()))],
                                  names=["label", "copies", "terms", "times", "patterns"])

    rows = sample.mapInArrow(found, "label int, copies bigint, terms array<int>, times array<int>, patterns array<int>").toPandas()
    y = rows["label"].to_numpy()
    doc = np.repeat(np.arange(len(rows)), rows["terms"].map(len))
    term = np.concatenate([np.asarray(t, np.int64) for t in rows["terms"]]) if len(doc) else np.zeros(0, np.int64)
    times = np.concatenate([np.asarray(t, float) for t in rows["times"]]) if len(doc) else np.zeros(0)

    # a lexicon voter holds terms of about the same lift
    tier = np.searchsorted(np.sort(LIFT_TIERS), [lift_of[int(k)] for k in lexicon.keys])
    voter = tier * VOTERS_A_TIER + (lexicon.keys % np.uint64(VOTERS_A_TIER)).astype(np.int64)
    listed, n_lexicon = np.isin(lexicon.keys, public), (len(LIFT_TIERS) + 1) * VOTERS_A_TIER
    votes = np.zeros((len(rows), n_lexicon + 1 + len(_PATTERNS)))
    votes[doc, voter[term]] = 1.0
    votes[doc[listed[term]], n_lexicon] = 1.0
    votes[:, n_lexicon + 1:] = np.array(rows["patterns"].tolist())
    # labelled rows for each sampled one
    stands = np.array([picked_of[c][0] / picked_of[c][1] for c in (0, 1)])[y] * rows["copies"].to_numpy(float)
    order = np.lexsort((*votes.T, y))  # sums must not depend on the order in which tasks ended
    q = np.empty(len(rows))
    q[order] = label_model(votes[order], y[order], stands[order], n_lexicon + 1)[0]
    weight, bias = C.fit_logistic(doc, term, np.log1p(times), len(rows), len(lexicon.keys), q, stands, l2=1e-5, steps=500)
    return ToxicityModel(lexicon, weight, bias)


def score_column(text: Column, model: ToxicityModel) -> Column:
    shared = C.broadcast(model)

    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(t.to_pylist()), pa.float64())

    return score.asNondeterministic()(text)


def held_out_column() -> Column:
    """Rows whose labels are not learned from: crc32 of the id's text mod 5 is 0 (null id: true, it has no label)."""
    return F.coalesce(F.pmod(C.text_crc("doc_id"), F.lit(5)) == 0, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels.select("doc_id", "toxic").where(~held_out_column()), **fit)
    return (docs.select("doc_id", held_out_column().alias("held_out"), score_column(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
