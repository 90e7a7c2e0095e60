"""Operator 7: language identification with bit-sliced Bloom filters over n-grams.

Every learned language has a profile of byte 4-grams. The profiles of all
languages share one table of 64-bit words: bit l of a word says that the slot is
set in the Bloom filter of language l, so a look-up of an n-gram's slots, joined
by AND, gives the bitmask of all languages that contain it. Per-language
popcounts of the masks, corrected for each filter's false-positive rate, decide.

Learning counts n-grams in Spark over a bounded sample of the labelled rows
(``SAMPLE_DOCS`` documents a language, picked by a hash of the id); an n-gram joins
the profile of a language if its share there is not far below its share in the
language where it is most frequent (``MIN_RELATIVE``), and a language keeps its
``PROFILE`` most frequent ones. All bounds are parameters.

Edge cases: a null text or one without a letter gives ``und`` with score 0; a text
with letters but no known n-gram gives the language with most learning rows with
score 0; ties go to the language with more learning rows, then by code point; with
no learning rows every prediction is ``und``. Rows are independent, so repeated
rows repeat their result, and long texts are read whole in pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

UND = "und"
SAMPLE_DOCS = 4000
PROFILE = 12000
MIN_RELATIVE = 0.1
MIN_COUNT = 3
SLOT_BITS = 18
N_HASH = 2
SEED = 7
#: A pipeline keeps documents that share at least this part of their n-grams with their language.
MIN_SCORE = 0.2

_GRAM = 4
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_CLEAN = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def _grams(text_bytes: list[bytes]):
    """(owner, gram) arrays for the letter 4-grams of each piece; runs of other characters count as one space."""
    for buf, owner in C.chunks(text_bytes, _GRAM - 1):
        sep = buf == 0
        b = np.frombuffer(buf.tobytes().translate(_CLEAN), np.uint8)
        b = np.where(sep, 0, b).astype(np.uint8)
        keep = np.ones(len(b), bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
        b, owner = b[keep].astype(np.uint32), owner[keep]
        if len(b) < _GRAM:
            continue
        n = len(b) - _GRAM + 1
        g = b[:n] | b[1:n + 1] << 8 | b[2:n + 2] << 16 | b[3:n + 3] << 24
        whole = (b[:n] != 0) & (b[1:n + 1] != 0) & (b[2:n + 2] != 0) & (b[3:n + 3] != 0)
        yield owner[:n][whole], g[whole]


def _bytes(text: str) -> bytes:
    """The text as it is compared: lower case, with a space before and after."""
    return b" " + text.lower().encode("utf-8", "replace").replace(b"\0", b" ") + b" "


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages (most learning rows first), the bit-sliced table and each filter's false-positive rate."""

    langs: tuple[str, ...]
    table: np.ndarray  # uint64 [2 ** slot_bits, words]
    false_rate: np.ndarray
    n_hash: int

    def slots(self, g: np.ndarray, k: int) -> np.ndarray:
        return (g * _MULTIPLIERS[k]) >> np.uint32(32 - int(np.log2(len(self.table))))

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams looked up, and for each language how many of them its filter holds."""
        total = np.zeros(len(texts))
        found = np.zeros((len(texts), len(self.langs)))
        for owner, g in _grams(texts):
            mask = self.table[self.slots(g, 0)]
            for k in range(1, self.n_hash):
                mask = mask & self.table[self.slots(g, k)]
            total += np.bincount(owner, minlength=len(texts))
            for i in range(len(self.langs)):
                bit = (mask[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)
                found[:, i] += np.bincount(owner, bit.astype(np.float64), len(texts))
        return total, found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ok = [t is not None and _LETTER.search(t) is not None for t in texts]
        score = np.zeros(len(texts))
        if not self.langs:
            return [UND] * len(texts), score
        total, found = self.hits([_bytes(t) if k else b"" for t, k in zip(texts, ok)])
        true = (found - total[:, None] * self.false_rate) / (1.0 - self.false_rate)
        best = np.argmax(np.maximum(true, 0.0), axis=1)
        own = true[np.arange(len(texts)), best]
        score = np.where(total > 0, np.clip(own / np.maximum(total, 1.0), 0.0, 1.0), 0.0) * np.asarray(ok, float)
        return [self.langs[i] if k else UND for i, k in zip(best, ok)], score


def _count_grams(batches):
    """Per partition: n-grams and documents of each language, counted before the shuffle."""
    counts: dict[str, dict[int, int]] = {}
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        for lang in set(langs):
            into = counts.setdefault(lang, {})
            for _, g in _grams([_bytes(t) for la, t in zip(langs, texts) if la == lang and t is not None]):
                keys, n = np.unique(g, return_counts=True)
                for key, v in zip(keys.tolist(), n.tolist()):
                    into[key] = into.get(key, 0) + v
    for lang, into in counts.items():
        yield pa.record_batch([pa.array([lang] * len(into), pa.string()), pa.array(list(into), pa.int64()),
                               pa.array(list(into.values()), pa.int64())], schema=schema)


def learn(docs: DataFrame, learn_rows: Column, sample_docs: int = SAMPLE_DOCS, profile: int = PROFILE,
          min_relative: float = MIN_RELATIVE, slot_bits: int = SLOT_BITS, n_hash: int = N_HASH) -> LanguageModel:
    """Fit the filters on rows of ``docs`` (doc_id, text, lang) where ``learn_rows`` holds.

    What reaches the driver is the number of rows per language and at most
    ``profile`` n-grams for each of them.
    """
    rows = docs.select("doc_id", "text", "lang").where(learn_rows & F.col("lang").isNotNull())
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = tuple(sorted(by_lang, key=lambda x: (-by_lang[x], x)))
    table = np.zeros((1 << slot_bits, max(1, (len(langs) + 63) // 64)), np.uint64)
    if not langs:
        return LanguageModel((), table, np.zeros(0), n_hash)
    share = F.create_map(*[F.lit(v) for la in langs for v in (la, min(1.0, sample_docs / by_lang[la]))])
    sample = rows.where(C.hash_share("doc_id", SEED) < share[F.col("lang")])
    grams = (sample.select("lang", "text").mapInArrow(_count_grams, "lang string, gram bigint, n bigint")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))
    grams = C.written(grams, "langid-grams")
    size = grams.groupBy("lang").agg(F.sum("n").alias("size"))
    part = grams.join(F.broadcast(size), "lang").withColumn("share", F.col("n") / F.col("size"))
    top = part.groupBy("gram").agg(F.max("share").alias("most"))
    kept = (part.join(top, "gram").where(F.col("share") >= min_relative * F.col("most"))
            .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))
            .where(F.col("rank") <= profile).select("lang", "gram").toPandas())
    model = LanguageModel(langs, table, np.zeros(len(langs)), n_hash)
    rate = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        g = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).astype(np.uint32)
        for k in range(n_hash):
            table[model.slots(g, k), i >> 6] |= np.uint64(1 << (i & 63))
        filled = float(((table[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean())
        rate[i] = min(filled ** n_hash, 0.999)
    return LanguageModel(langs, table, rate, n_hash)


def predict(text: Column, model: LanguageModel) -> Column:
    """struct<lang_pred, score> of a text column."""
    shared = C.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def lang_of(t: pa.Array) -> pa.Array:
        langs, score = shared.value.predict(t.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return lang_of.asNondeterministic()(text)


def held_out_column() -> Column:
    """Rows that nothing is learned from: crc32 of the id's text mod 3 is 1 (null id: false)."""
    return F.coalesce(F.pmod(C.text_crc("doc_id"), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, **fit) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    learnable = F.col("doc_id").isNotNull() & ~held_out_column()
    model = learn(docs, learnable, **fit)
    return (docs.select("doc_id", held_out_column().alias("held_out"), predict(F.col("text"), model).alias("r"))
            .select("doc_id", "held_out", "r.lang_pred", "r.score"))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, **fit) -> DataFrame:
    """The documents whose language is recognised: not ``und`` and a score of ``min_score`` or more."""
    model = learn(docs, F.col("doc_id").isNotNull() & ~held_out_column(), **fit)
    tag = C.scratch_name("lang")
    return (docs.withColumn(tag, predict(F.col("text"), model))
            .where((F.col(f"{tag}.lang_pred") != UND) & (F.col(f"{tag}.score") >= min_score)).drop(tag))
