"""Operator 8: embedding near-duplicates by lattice hashing on E8.

Vectors are scaled to length 1. Each of ``TABLES`` random Gaussian projections maps them to
8 dimensions, where the nearest point of the lattice E8 is decoded; its own cell and the
``PROBES`` neighbouring cells that the vector lies closest to are its cells in that table.
Vectors with the same label that share a cell are candidates; the cosine of the original vectors
in double precision decides.

Equal vectors with equal labels are one vertex with a multiplicity. Only cells with
two or more vertices are gathered. Within a cell vectors are compared in numpy, many small cells at once,
and give counts and a spanning forest, never their pairs; a pair that meets in several cells counts in the
first one only. A cell of more than ``BLOCK`` vertices is split into blocks, and each
two blocks meet in a task of their own, so no task holds more than two blocks whatever the cell's size.

Candidates are found with high probability, not with certainty (recall against brute force
is measured in the tests; README has the figures).

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing: n_links 0, their own component, kept. Vectors of another length than
the most frequent one of their cell's label are compared among equals in length only. Repeated vec_ids are separate
vectors with one id. Null vec_ids are kept with component null unless linked. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

MIN_COSINE = 0.98
TABLES = 6
PROBES = 3
#: Edge of the lattice in units of the distance of two unit vectors at the threshold.
SCALE = 4.0
BLOCK = 1024
SEED = 8

_DIM = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: +-e_i +- e_j, and (+-1/2)^8 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(_DIM), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(_DIM)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=_DIM) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even coordinate sum."""
    r = np.rint(x)
    off = x - r
    odd = r.sum(1) % 2 != 0
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    r[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 + 1/2."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def _hash_rows(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of lattice points (twice their coordinates are integers)."""
    h = np.full(len(points), ((salt * 2 + 1) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in np.rint(points * 2).astype(np.int64).view(np.uint64).reshape(points.shape).T:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, min_cosine: float, seed: int = SEED) -> np.ndarray:
    """Sorted cell hashes of each vector: 1 + ``probes`` for each table."""
    roots = _roots()
    edge = scale * np.sqrt(2 - 2 * min_cosine)
    out = []
    for t in range(tables):
        rng = np.random.default_rng((seed, t, unit.shape[1]))
        x = unit @ rng.standard_normal((unit.shape[1], _DIM)) / edge + rng.random(_DIM)
        own = nearest_e8(x)
        near = np.argsort(-((x - own) @ roots.T), axis=1, kind="stable")[:, :probes]
        out.append(_hash_rows(own, t))
        out += [_hash_rows(own + roots[near[:, p]], t) for p in range(probes)]
    return np.sort(np.stack(out, axis=1), axis=1)


def _unit(values: list) -> np.ndarray:
    """Unit vectors in double precision; inputs are finite and not zero."""
    m = np.asarray(values, np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


_CELLS_ARROW = pa.list_(pa.int64())


#: Groups of this many vectors are compared by one matrix product, smaller ones pair by pair.
_MATRIX = 64
_PAIRS = 1 << 15
_ROWS = 8192


def _pairs(start: np.ndarray, size: np.ndarray):
    """All pairs of rows (a < b) of each group, some groups at a time."""
    last = np.repeat(start + size, size)  # end of each row's group
    row = np.concatenate([np.arange(s, s + n) for s, n in zip(start, size)]) if len(start) else np.zeros(0, np.int64)
    more = last - row - 1
    upto = np.cumsum(more)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
        n = more[at:end]
        a = np.repeat(row[at:end], n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = end


def _compared(unit: np.ndarray, key: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with the same key (rows are sorted by it) whose cosine reaches the limit."""
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
    size = np.diff(np.append(start, len(key)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s, n in zip(start[size >= _MATRIX], size[size >= _MATRIX]):
        a, b = np.nonzero(np.triu(unit[s:s + n] @ unit[s:s + n].T >= min_cosine, 1))
        found.append((a + s, b + s))
    for a, b in _pairs(start[size < _MATRIX], size[size < _MATRIX]):
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= min_cosine
        found.append((a[near], b[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _links(key: np.ndarray, side: np.ndarray, v: np.ndarray, copies: np.ndarray, of: np.ndarray, unit: np.ndarray, min_cosine: float):
    """For each row (sorted by key: cell and its two blocks): its new links, and the vertex that a spanning forest ties it to."""
    a, b = _compared(unit, key, min_cosine)
    across = key[a, 1] == key[a, 2]  # within one block, or from one block to the other
    met = across | (side[a] != side[b])
    a, b = a[met], b[met]
    # a pair counts in the smallest cell that both have
    first, here = np.ones(len(a), bool), key[a, 0].view(np.uint64)
    for i in range(of.shape[1]):
        mine = of[a, i]
        earlier = np.flatnonzero(first & (mine < here))
        first[earlier] = ~(of[b[earlier]] == mine[earlier, None]).any(1)
    links = np.bincount(a[first], copies[b[first]], len(v)) + np.bincount(b[first], copies[a[first]], len(v))
    root = np.arange(len(v))
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return links.astype(np.int64), v[root]


_COMPARED = ["cell", "block_a", "block_b", "block", "v", "copies", "embedding", "cells"]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _compare_sorted(batches, min_cosine: float):
    """Rows sorted by (cell, block_a, block_b, v): whole groups are compared, many small ones at once."""
    def done(table: pa.Table):
        cols = [table.column(c).combine_chunks() for c in _COMPARED]
        key = np.stack([c.to_numpy().astype(np.int64) for c in cols[:3]], axis=1)
        side, v, copies = (c.to_numpy() for c in cols[3:6])
        values, length = _lists(cols[6])
        cell_values, n_cells = _lists(cols[7])
        first, first_cell = np.cumsum(length) - length, np.cumsum(n_cells) - n_cells
        for n in np.unique(length):  # a cell belongs to one length of vector
            r = np.flatnonzero(length == n)
            unit = _unit(values[first[r][:, None] + np.arange(n)])
            of = cell_values[first_cell[r][:, None] + np.arange(n_cells[r][0])].view(np.uint64)
            links, tie = _links(key[r], side[r], v[r], copies[r], of, unit, min_cosine)
            yield pa.record_batch([pa.array(v[r]), pa.array(links), pa.array(tie)], names=["v", "links", "tie"])

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= _ROWS:
            key = np.stack([held.column(c).to_numpy() for c in _COMPARED[:3]], axis=1)
            cut = int(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))[-1])  # the last group may go on
            if cut:
                yield from done(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from done(held)


def linked(vectors: DataFrame, min_cosine: float = MIN_COSINE, tables: int = TABLES, probes: int = PROBES,
           scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links and component_id of every row of ``vectors`` (vec_id, embedding, label)."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    sound = (F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
             & F.coalesce(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
             & F.coalesce(F.exists(values, lambda x: x != 0.0), F.lit(False)))
    rows = C.written(vectors.select("vec_id", F.col("label").cast("string").alias("label"), values.alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
                     # -0.0 and 0.0 are one value
                     .withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
                     .withColumn("v", F.when(F.col("sound"), F.xxhash64("label", "embedding"))), "lattice-rows")
    vertex = rows.where("sound").groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
                                                 F.first("embedding").alias("embedding"), F.first("label").alias("label"))

    @F.arrow_udf("array<bigint>")
    def cells_of(e: pa.Array, label: pa.Array) -> pa.Array:
        got: list = [None] * len(e)
        raw = e.to_pylist()
        salt = [hash_text(x) for x in label.to_pylist()]
        for n in {len(x) for x in raw}:
            at = [i for i, x in enumerate(raw) if len(x) == n]
            found = cells(_unit([raw[i] for i in at]), tables, probes, scale, min_cosine)
            for i, c in zip(at, found):
                got[i] = np.sort((c ^ np.uint64(salt[i] ^ n))).view(np.int64).tolist()
        return pa.array(got, _CELLS_ARROW)

    vertex = C.written(vertex.withColumn("cells", cells_of.asNondeterministic()("embedding", "label")), "lattice-vertices")
    member = vertex.select("v", F.explode(F.array_distinct("cells")).alias("cell"))
    full = member.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # blocks of a large cell meet two by two
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    member = (member.join(full, "cell").withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("v", "cell"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("v", "cell", "block", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b")))
    member = C.written(member, "lattice-members")
    group = ["cell", "block_a", "block_b"]
    gathered = (member.join(vertex.select("v", "copies", "embedding", "cells"), "v").select(*_COMPARED)
                .repartition(*group).sortWithinPartitions(*group, "v"))
    found = C.written(gathered.mapInArrow(lambda batches: _compare_sorted(batches, min_cosine), "v bigint, links bigint, tie bigint"), "lattice-links")
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("v <> tie").select(F.col("v").alias("a"), F.col("tie").alias("b")))
    vertex = (vertex.select("v", "first_id", "copies").join(links, "v", "left")
              .join(roots.withColumnRenamed("node", "v"), "v", "left")
              .select("v", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "v").alias("root")))
    vertex = C.written(vertex, "lattice-roots")
    smallest = vertex.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_vertex = vertex.join(smallest, "root").select("v", "n_links", "component_id")
    return (rows.select("vec_id", "v").join(by_vertex, "v", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("bigint").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def hash_text(x: str) -> int:
    """A 63-bit number for a label."""
    return xxhash.xxh64_intdigest(x.encode(), SEED) >> 1
