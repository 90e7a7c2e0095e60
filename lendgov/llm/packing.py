"""Operator 9: best-fit packing by exact-complement hashing.

Documents become token ids (the vocabulary's byte-level BPE plus an end id). Only those
longer than a sequence are cut, into whole sequences; their first piece takes the remainder.
So every piece is as long as a sequence or is the only short piece of its document.

Only the number of pieces of each length matters for a plan, and lengths are bounded by
the sequence: the counts of all lengths (``length`` rows) go to the driver. There the sums
of one, two and three available lengths are indexed by their gap; from the longest
piece down, combinations that fill its gap exactly are consumed in bulk, as often as the
counts of their lengths allow. What is left over is packed best-fit decreasing, again in
bulk by lengths. The plan lists patterns (lengths of one sequence, how many sequences).

In Spark every piece gets its rank among the pieces of its length (its place in its
partition plus the counts of the partitions before), and the plan maps a length's ranks to
(sequence, offset). Nothing is moved but counts; a length that a third of all pieces has is
ranked like any other.

Edge cases: a null text is empty and gives the end id alone; repeated rows are packed as often as
they occur; null ids are kept; an empty table gives no rows; a long text is tokenised whole.
"""

from __future__ import annotations

import base64
import json
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

LENGTH = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def load_encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS):
    """Function from a list of texts to lists of ids, from two public files of one vocabulary.

    The rank file's encoder gives the same ids several times faster. A text that holds
    the string of a special token goes to the ``tokenizers`` file itself.
    """
    import public_tokenizers as P

    with open(P.path(ranks), "rb") as f:
        table = f.read()
    with open(P.path(vocabulary)) as f:
        described = f.read()
    special = tuple(t["content"] for t in json.loads(described)["added_tokens"])
    return _Encoder(table, described, P.PATTERN, special)


class _Encoder:
    """Small enough to be sent with the tasks; builds its tables once per worker."""

    def __init__(self, table: bytes, described: str, pattern: str, special: tuple[str, ...]):
        self.parts, self.special = (table, described, pattern), special
        self.fast = self.exact = None

    def __getstate__(self):
        return self.__dict__ | {"fast": None, "exact": None}

    def __call__(self, text: str) -> list[int]:
        table, described, pattern = self.parts
        if any(s in text for s in self.special):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_str(described)
            return self.exact.encode(text, add_special_tokens=False).ids
        if self.fast is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return self.fast.encode_ordinary(text)


_PIECES = "doc_id bigint, piece int, start bigint, length int, ids binary, part int, place bigint"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
                           ("ids", pa.binary()), ("part", pa.int32()), ("place", pa.int64())])


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, encode=None) -> DataFrame:
    """The pieces of every document: ids (little-endian unsigned 32-bit) and place among its partition's pieces of its length."""
    shared = C.broadcast(encode or load_encoder())

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(shared.value(text or "") + [end_id], "<u4")
                first = (len(ids) - 1) % length + 1 if len(ids) > length else len(ids)
                at = 0
                for n, end in enumerate(range(first, len(ids) + 1, length)):
                    size = end - at
                    for c, v in zip(cols, (doc_id, n, at, size, ids[at:end].tobytes(), seen[size])):
                        c.append(v)
                    seen[size] += 1
                    at = end
            a, b, c, d, e, f = cols
            yield pa.record_batch([pa.array(x, t) for x, t in zip((a, b, c, d, e, [part] * len(a), f), _PIECES_ARROW.types)],
                                  schema=_PIECES_ARROW)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return C.written(rows.mapInArrow(cut, _PIECES), "pack-pieces")


def exact_fills(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of up to four lengths that fill a sequence exactly, consumed in bulk; ``counts`` keeps the rest.

    From the longest length down: fill its gap by one length, else by two, else by three,
    trying the longest partners first, until its pieces or the ways to fill are used up.
    """
    plan = []

    def consume(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(counts.get(x, 0) // n for x, n in need.items())
        if times:
            plan.append((lengths, times))
            for x, n in need.items():
                counts[x] -= n * times
                free[x] = counts[x] > 0

    free = np.zeros(length + 1, bool)  # the lengths still to be had
    free[[x for x, n in counts.items() if n]] = True

    def pairs(total: int) -> np.ndarray:
        """The larger ones of available lengths a >= b with a + b = total, longest first."""
        half = np.arange(1, total // 2 + 1)
        return total - half[free[half] & free[total - half]] if total >= 2 else half[:0]

    def fill(big: int) -> None:
        gap = length - big
        if gap == 0:
            consume((big,))
            return
        consume((big, gap))
        for a in pairs(gap):
            if counts[big]:
                consume((big, int(a), int(gap - a)))
        for a in np.flatnonzero(free[:gap])[::-1]:
            if not counts[big]:
                return
            for b in pairs(int(gap - a)):
                if b <= a and counts[big] and counts[a]:
                    consume((big, int(a), int(b), int(gap - a - b)))

    for big in sorted(counts, reverse=True):
        fill(big)
        free[big] = False  # what is left of it is not filled exactly by anything
    return plan


def best_fit(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over lengths in bulk: open sequences are kept by their free room and contents."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room -> contents -> how many
    for size in sorted((x for x in counts if counts[x]), reverse=True):
        todo = counts[size]
        while todo:
            fit = min((r for r in open_bins if r >= size and open_bins[r]), default=None)
            if fit is None:
                # as many of this length as fit go into each new sequence
                each = length // size
                full, rest = divmod(todo, each)
                for k, n in ((each, full), (rest, 1 if rest else 0)):
                    if n:
                        _add(open_bins, length - k * size, (size,) * k, n)
                todo = 0
                continue
            content, n = next(iter(open_bins[fit].items()))
            each = min(fit // size, todo)  # fill a sequence before the next one is opened
            use = min(n, todo // each)
            _take(open_bins, fit, content, use)
            _add(open_bins, fit - each * size, content + (size,) * each, use)
            todo -= use * each
    counts.clear()
    return [(content, n) for by in open_bins.values() for content, n in by.items()]


def _add(bins, room: int, content: tuple[int, ...], n: int) -> None:
    bins[room][content] = bins[room].get(content, 0) + n


def _take(bins, room: int, content: tuple[int, ...], n: int) -> None:
    bins[room][content] -= n
    if not bins[room][content]:
        del bins[room][content]
    if not bins[room]:
        del bins[room]


def make_plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), using up ``counts`` exactly."""
    counts = {k: v for k, v in counts.items() if v}
    return exact_fills(counts, length) + best_fit(counts, length)


@dataclass(frozen=True)
class Assignment:
    """For each length the ranks at which a run of a pattern's slot begins, and that run's first sequence and offset."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(plan: list[tuple[tuple[int, ...], int]]) -> "Assignment":
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        sequence = 0
        for lengths, times in plan:
            at = 0
            for x in lengths:
                runs[x].append((used[x], sequence, at))
                used[x] += times
                at += x
            sequence += times
        return Assignment({x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()})

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for x in np.unique(lengths):
            own = lengths == x
            starts, first, at = self.runs[int(x)]
            run = np.searchsorted(starts, ranks[own], side="right") - 1
            sequence[own] = first[run] + ranks[own] - starts[run]
            offset[own] = at[run]
        return sequence, offset


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, encode=None) -> DataFrame:
    """doc_id, piece, start, length, ids, their CRC-32, sequence_id and offset of every piece."""
    cut = pieces(docs, length, end_id, encode)
    counts = C.written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    plan = make_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length)
    shared = C.broadcast(Assignment.of(plan))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # the digest is taken before the join, so that the ids move only where a caller asks for them
    ranked = (cut.withColumn("ids_crc32", F.crc32("ids")).join(offsets, ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("place") + F.col("before")).alias("rank")))

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        got = shared.value.place(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x) for x in got], ["sequence_id", "offset"])

    return (ranked.withColumn("at", place.asNondeterministic()("length", "rank"))
            .select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset"))


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"),
                         "ids_crc32", "sequence_id", "offset")
