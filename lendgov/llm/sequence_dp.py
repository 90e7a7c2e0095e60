"""Operator 13: order-preserving packing by dynamic programming over document and sentence boundaries.

The documents of a partition, as token ids with an end id each, are one stream in their order. A sequence is a
window of the stream; where windows end is chosen among the ends of documents and of sentences. The costs are the padding
of each window (to ``length``; none where it holds a power of two), a constant for each window, and a penalty for each
cut inside a document: small at a sentence's end, larger inside a sentence. Inside a sentence cuts are open only every
``STRIDE`` tokens of a stretch without boundaries that is longer than ``STRETCH``.

With positions p and least costs d, a window from i to j costs length - (p_j - p_i) in padding, so the best i is the one with the
least d_i + p_i among those at most ``length`` before j: a monotone queue gives it in constant time. Windows of a power of two are
looked up by position, one for each power. Once ``HORIZON`` tokens are undecided, what all best ways have in common is written
out: that is the exact solution, not a cut into blocks, and it bounds what a task holds.

In Spark each partition is one stream, so nothing is shuffled or collected, and repeated or very frequent rows change nothing; a
partition's last window may be padded, which is one window of the tens of thousands that a partition of 128 MB gives.

Edge cases: a null text is empty and is the end id alone; repeated rows are packed as often as they occur; null ids are kept; an
empty table gives no rows; a long text is tokenised whole and cut like any other; extra columns are not read.
"""

from __future__ import annotations

import base64
import json
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import packing

LENGTH = 1024
END_ID = 0
#: Inside a stretch of more than STRETCH tokens without a boundary a cut may fall every STRIDE tokens.
STRETCH, STRIDE = 64, 16
#: Undecided tokens at which a task looks for the part that all best ways share.
HORIZON = 1 << 19
#: Sequence numbers of a partition.
SEQUENCES = 1 << 33


@dataclass(frozen=True)
class Costs:
    """In tokens of padding: of a window, of a cut after a sentence, of a cut inside one."""

    window: int = 16
    sentence: int = 2
    inside: int = 6


#: A sentence ends after one of these, and what closes it, before white space; after one of the wide marks; or at a line's end.
_MARKS, _CLOSERS, _SPACE = b".!?", b"\"')]", b" \t\n\r\x0b\x0c"
_WIDE = "…。！？।؟۔"


class Vocabulary:
    """What the ids' bytes say about sentences: bytes of each id, whether it ends with a mark, is made of closers, begins with white space, ends a line."""

    def __init__(self, tokens: list[bytes]):
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.mark = np.array([t.rstrip(_CLOSERS).endswith(tuple(bytes([c]) for c in _MARKS)) for t in tokens])
        self.closer = np.array([bool(t) and not t.strip(_CLOSERS) for t in tokens])
        self.space = np.array([t[:1] != b"" and t[0] in _SPACE for t in tokens])
        self.line = np.array([t.endswith(b"\n") for t in tokens])

    def sentence_ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """How many tokens lie before each sentence end but the text's own end; ``ids`` are the text's."""
        if not len(ids):
            return np.zeros(0, np.int64)
        ends, closers = self.mark[ids], self.closer[ids]
        for _ in range(2):  # closers that are tokens of their own
            ends[1:] |= closers[1:] & ends[:-1]
        ends[:-1] &= self.space[ids[1:]]
        ends |= self.line[ids]
        out = np.flatnonzero(ends) + 1
        marks = [m.encode() for m in _WIDE if m in text]
        if marks:  # their bytes may be dealt over tokens
            raw = text.encode()
            wide = np.array([i + len(m) for m in marks for i in _places(raw, m)])
            upto = np.cumsum(self.width[ids])
            at = np.searchsorted(upto, wide)
            out = np.union1d(out, at[upto[at] == wide] + 1)
        return out[out < len(ids)]


def _places(text: bytes, mark: bytes):
    at = text.find(mark)
    while at >= 0:
        yield at
        at = text.find(mark, at + 1)


def open_cuts(n_tokens: int, boundaries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) where a document of ``n_tokens`` may be cut, its end not included, and whether each lies inside a sentence."""
    inner = boundaries[(boundaries > 0) & (boundaries < n_tokens)]
    edges = np.concatenate([[0], inner, [n_tokens]])
    wide = np.flatnonzero(np.diff(edges) > STRETCH)
    if not len(wide):
        return inner, np.zeros(len(inner), bool)
    each = (edges[wide + 1] - edges[wide] - 1) // STRIDE  # cuts in each stretch
    extra = np.repeat(edges[wide], each) + STRIDE * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + 1)
    both = np.concatenate([inner, extra])
    order = np.argsort(both, kind="stable")
    return both[order], order >= len(inner)


class Cutter:
    """Least-cost windows over positions that come one by one; ``settle`` gives the windows that no later position changes."""

    def __init__(self, length: int = LENGTH, costs: Costs = Costs()):
        if length < STRIDE:
            raise ValueError(f"sequences of fewer than {STRIDE} tokens")
        self.length, self.costs = length, costs
        # bit d of ``behind`` says that there is a position d before the latest one; bits of the powers of two
        self.behind, self.reach = 0, (1 << length + 1) - 1
        self.powers = sum(1 << (1 << k) for k in range(length.bit_length()) if 1 << k <= length)
        self.position, self.least, self.came = [0], [0], [-1]
        self.at = {0: 0}                      # position -> its number
        self.queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (least + position, number, position), rising

    def add(self, positions: list[int], penalties: list[int]) -> None:
        """The next positions, ascending, and what a cut there costs beside padding."""
        queue, position, least, came, at = self.queue, self.position, self.least, self.came, self.at
        length, powers, window, known = self.length, self.powers, self.costs.window, self.at.get
        behind, reach, j, last = self.behind, self.reach, len(position), position[-1]
        for p, penalty in zip(positions, penalties):
            oldest = p - length
            behind = (behind << p - last | 1 << p - last) & reach
            last = p
            while queue[0][2] < oldest:
                queue.popleft()
            key, best, _ = queue[0]
            cost = key - oldest
            found = behind & powers
            while found:
                power = found.bit_length() - 1
                found ^= 1 << power
                i = known(p - power)
                if i is not None and least[i] < cost:
                    cost, best = least[i], i
            cost += window + penalty
            position.append(p)
            least.append(cost)
            came.append(best)
            at[p] = j
            key = cost + p
            while queue and queue[-1][0] >= key:
                queue.pop()
            queue.append((key, j, p))
            j += 1
        self.behind = behind

    def _way(self, j: int) -> list[int]:
        out = []
        while j >= 0:
            out.append(j)
            j = self.came[j]
        return out[::-1]

    def settle(self, done: bool) -> list[int]:
        """Positions of the cuts that are certain, from the last settled one on. ``done``: the last position ends the stream.

        Else the cut is the last one through which the best ways to all positions within one window of the end go.
        """
        if done:
            kept = self._way(len(self.position) - 1)
        else:
            live = {j for j in range(len(self.position) - 1, -1, -1) if self.position[j] >= self.position[-1] - self.length}
            while len(live) > 1:  # the latest of them goes back one window, until they meet
                j = max(live)
                live.remove(j)
                live.add(max(self.came[j], 0))
            kept = self._way(live.pop())
        out = [self.position[j] for j in kept]
        self._forget(kept[-1])
        return out

    def _forget(self, first: int) -> None:
        """Drop what lies before number ``first``; ways to later positions that do not pass it are never best again."""
        base = self.least[first]
        self.position, self.least = self.position[first:], [c - base for c in self.least[first:]]
        self.came = [-1, *(max(c - first, 0) for c in self.came[first + 1:])]
        self.at = {p: j for j, p in enumerate(self.position)}
        self.queue = deque((key - base, j - first, p) for key, j, p in self.queue if j >= first)


_OUT = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Stream:
    """Documents in order, cut into sequences; holds the undecided documents only."""

    def __init__(self, length: int, costs: Costs, first_sequence: int):
        self.cutter, self.costs, self.sequence = Cutter(length, costs), costs, first_sequence
        self.pending: deque[tuple[int | None, int, np.ndarray]] = deque()  # (doc_id, stream position, ids)
        self.end = self.settled = 0
        self.horizon = HORIZON

    def add(self, doc_id: int | None, ids: np.ndarray, boundaries: np.ndarray):
        """Takes a document and yields the pieces that are decided."""
        self.pending.append((doc_id, self.end, ids))
        begin, self.end = self.end, self.end + len(ids)
        cuts, inside = open_cuts(len(ids), boundaries)
        penalties = np.where(inside, self.costs.inside, self.costs.sentence)
        self.cutter.add([*(cuts + begin).tolist(), self.end], [*penalties.tolist(), 0])
        if self.end - self.settled > self.horizon:
            yield from self.finish(False)
            # a stream whose ways stay apart is looked at less and less often
            self.horizon = max(HORIZON, 2 * (self.end - self.settled))

    def finish(self, done: bool = True):
        cuts = self.cutter.settle(done)
        for a, b in zip(cuts, cuts[1:]):
            yield from self._window(a, b)
            self.sequence += 1
        self.settled = cuts[-1]

    def _window(self, a: int, b: int):
        while True:
            doc_id, begin, ids = self.pending[0]
            lo, hi = max(a, begin), min(b, begin + len(ids))
            yield doc_id, lo - begin, hi - lo, ids[lo - begin:hi - begin].tobytes(), len(ids), self.sequence, lo - a
            if hi == begin + len(ids):
                self.pending.popleft()
            if hi == b:
                return


def vocabulary(encoder) -> Vocabulary:
    """The bytes of every id of the encoder's vocabulary, those of special tokens included."""
    table, described = encoder.parts[:2]
    tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, table.splitlines())}
    tokens |= {t["id"]: t["content"].encode() for t in json.loads(described)["added_tokens"]}
    return Vocabulary([tokens.get(i, b"") for i in range(max(tokens) + 1)])


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, costs: Costs = Costs(), encode=None) -> DataFrame:
    """The pieces of every document of ``docs`` (doc_id, text): doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset."""
    encoder = encode or packing.load_encoder()
    shared, known = C.broadcast(encoder), C.broadcast(vocabulary(encoder))

    def cut(batches):
        stream = Stream(length, costs, TaskContext.get().partitionId() * SEQUENCES)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(shared.value(text or "") + [end_id], "<u4")
                rows += stream.add(doc_id, ids, known.value.sentence_ends(text or "", ids[:-1]))
            yield _batch(rows)
        yield _batch(list(stream.finish()))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_ARROW)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens, and padding tokens of all sequences (none where a sequence holds a power of two)."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return filled.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"),
                      F.sum(F.when(whole, F.lit(0)).otherwise(length - F.col("n"))).alias("padding"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
