"""Operator 6: SimHash near-duplicates with pigeonring filtering.

Fingerprint: ASCII lower case, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``shingle`` words joined by spaces (repeats included; fewer words: the whole
sequence; no word: fingerprint 0), XXH64 with seed 42 of each; a bit is 1 if it is
set in more than half of the hashes.

Pigeonring: the 64 bits lie on a ring of ``SEGMENTS`` segments. If two fingerprints
differ in at most t bits, then from some segment on every chain of l consecutive
segments differs in at most floor(l * t / SEGMENTS) bits. So for one of the starts
the leading segments with budget 0 agree exactly: they are the join key, one row
per fingerprint and start. The longer chains' budgets prune the pairs of a key
before the full Hamming check. The filter loses no pair.

Equal fingerprints are one vertex, so copies never meet in the join. A key that more
than ``HOT_KEY`` fingerprints share is not paired: its fingerprints are linked
through their one-bit neighbours (for t <= 2, two fingerprints differ in at most 2
bits exactly if they have a common fingerprint within one bit), 65 rows each and at
most 65 fingerprints a neighbour, however many share the key. Both ways give all links.

Edge cases: a null or blank text has fingerprint zero and links like any other; null
ids keep their rows and get the component's smallest non-null id (null if there is
none); repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 9
HOT_KEY = 64
SEED = 42

_BITS = 64
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at:at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.arrow_udf("bigint")
    def fp(t: pa.Array) -> pa.Array:
        got = np.array([fingerprint(x, shingle) for x in t.to_pylist()], np.uint64)
        return pa.array(got.view(np.int64), pa.int64())

    return fp.asNondeterministic()(text)


def _ring(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    at = [_BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _mask(ring: list[tuple[int, int]], start: int, length: int) -> int:
    """The bits of ``length`` consecutive segments from ``start``, as a signed integer."""
    m = 0
    for k in range(length):
        a, n = ring[(start + k) % len(ring)]
        m |= ((1 << n) - 1) << a
    return m - (1 << _BITS) if m >> (_BITS - 1) else m


def _budgets(segments: int, max_bits: int) -> list[tuple[int, int]]:
    """(chain length, most differing bits) where the proportional budget steps up after that length."""
    allowed = [length * max_bits // segments for length in range(1, segments + 1)]
    return [(i + 1, v) for i, v in enumerate(allowed) if i + 1 == segments or allowed[i + 1] > v]


def linked_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, hot_key: int = HOT_KEY) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``prints.fp`` just as all pairs within ``max_bits`` do."""
    if not 0 <= max_bits <= 2:
        raise ValueError("keys that many fingerprints share need max_bits <= 2")
    ring, budgets = _ring(segments), _budgets(segments, max_bits)
    exact = budgets[0][0] if budgets[0][1] == 0 else 0
    if exact == 0:
        raise ValueError("segments must exceed max_bits")
    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_mask(ring, i, exact))).alias("key"))
                                 for i in range(segments)]))
    keyed = C.written(prints.select("fp", starts.alias("k")).select("fp", "k.start", "k.key"), "simhash-keys")
    shared = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = C.written(keyed.join(shared, ["start", "key"]), "simhash-shared")

    small = shared.where(F.col("n") <= hot_key).select("start", "key", "fp")
    x, y = small.alias("x"), small.alias("y")
    differs = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    chain = F.lit(True)
    for length, most in budgets[1:]:
        by_start = F.element_at(F.array(*[F.lit(_mask(ring, i, length)) for i in range(segments)]), F.col("x.start") + 1)
        chain = chain & (F.bit_count(differs.bitwiseAND(by_start)) <= most)
    pairs = (x.join(y, (F.col("x.start") == F.col("y.start")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & chain)
             .where(F.bit_count(differs) <= max_bits)
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))

    hot = shared.where(F.col("n") > hot_key).select("fp").distinct()
    flips = [0] + ([1 << i if i < _BITS - 1 else -(1 << i) for i in range(_BITS)] if max_bits else [])
    near = hot.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("near"))
    # within one bit of the same value: at most two bits apart; a budget of one bit asks for a member at the value itself
    if max_bits == 1:
        near = near.join(hot.select(F.col("fp").alias("near")), "near", "left_semi")
    hub = near.groupBy("near").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = near.join(hub, "near").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def _row_key() -> Column:
    """128 bits of a row's id and text: rows with one key are repeated rows."""
    return F.struct(F.xxhash64("doc_id", "text", F.lit(1)).alias("k1"), F.xxhash64("doc_id", "text", F.lit(2)).alias("k2"))


def _grouped(docs: DataFrame, shingle: int, max_bits: int, segments: int, with_key: bool = False) -> DataFrame:
    """doc_id, fp, root (the smallest fingerprint of the component) of every row, and the component's smallest id (and k1, k2, the row's key)."""
    key = [_row_key().alias("k")] if with_key else []
    prints = C.written(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp"), *key).select("doc_id", "fp", *(["k.k1", "k.k2"] if key else [])),
                       "simhash-prints")
    vertex = C.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-vertices")
    roots = connected_components(linked_fingerprints(vertex, max_bits, segments))
    vertex = vertex.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    vertex = C.written(vertex, "simhash-roots")
    smallest = vertex.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(vertex.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp (signed), component_id of every row of ``docs``; near-duplicates share a component."""
    return _grouped(docs, shingle, max_bits, segments).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of its rows with that id the one with the smallest fingerprint stays; an id may stay once in each of several groups. A group whose ids are all null keeps one row with its smallest fingerprint.
    """
    found = _grouped(docs.select("doc_id", "text"), shingle, max_bits, segments, with_key=True)
    # each text is read once for its fingerprint; after that a row is known by its key, which the JVM computes again
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "k1", "k2")).alias("first")
    kept = C.written(found.groupBy("root").agg(first).select("first.k1", "first.k2"), "simhash-kept")
    tag = C.scratch_name("key")
    keyed = docs.withColumn(tag, _row_key())
    k1, k2 = F.col(tag)["k1"], F.col(tag)["k2"]
    # the texts are moved once: the join and the removal of repeated rows share a partitioning
    left = keyed.withColumns({f"{tag}1": k1, f"{tag}2": k2}).drop(tag)
    right = kept.select(F.col("k1").alias(f"{tag}1"), F.col("k2").alias(f"{tag}2"))
    return left.join(right, [f"{tag}1", f"{tag}2"], "left_semi").dropDuplicates([f"{tag}1", f"{tag}2"]).select(*docs.columns)
