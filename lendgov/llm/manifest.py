"""Operator 11: a Merkle manifest of a dataset, as a tree of SHA-256 midstates.

Every row is a leaf (the hash of its fields). The leaves of a group (language) ascend by id; every
``BRANCH`` consecutive nodes become their hash until one remains, the group's subroot, and the subroots
in the order of their groups become the root in the same way.

A parent keeps a copy of its running hash state from before each child slot. When a leaf is replaced, each
parent on its way up resumes the state before that slot and reads the replacement and the right siblings only;
what lies to the left is never read again.

In Spark the rows take their place in their group by range partitioning, so a group with a third of all rows lies in
many tasks. ``BRANCH ** LEVELS`` consecutive nodes are a block: one row with arrays, whose part of the tree is built
inside one task. Block roots are the nodes of the next round, 1/512 of the rows; a few rounds give the root.
Then the way up is handed down, block by block (a few siblings a level), and the leaves are folded where they lie.

Edge cases: a null field is ``-``; null ids come first, rows with equal ids ascend by leaf, repeated rows are leaves of
their own; a null group comes first and is unlike the group of an empty text; a single row is its own subroot and root, its
proof is the hash of nothing; an empty table has no rows and no root; extra columns are not hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import distributed_rank
from . import common as C

BRANCH = 8
#: Levels of the tree that one block holds.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hash of the fields in order: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def depth(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    d = 0
    while n > 1:
        n, d = -(-n // BRANCH), d + 1
    return d


class MidstateTree:
    """The levels above some consecutive nodes, with the hash state of each parent before each of its child slots."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.nodes = [nodes]
        self.states: list[list] = []
        for _ in range(levels):
            before, parents = [], []
            for at in range(0, len(nodes), BRANCH):
                h = hashlib.sha256()
                for child in nodes[at:at + BRANCH]:
                    before.append(h.copy())
                    h.update(child)
                parents.append(h.hexdigest().encode())
            self.states.append(before)
            self.nodes.append(parents)
            nodes = parents

    def siblings(self, place: int) -> list[tuple[bytes, bytes]]:
        """What lies left and right of the node among its parent's children, level by level."""
        out = []
        for nodes in self.nodes[:-1]:
            run = place - place % BRANCH
            out.append((b"".join(nodes[run:place]), b"".join(nodes[place + 1:run + BRANCH])))
            place //= BRANCH
        return out

    def fold(self, place: int, digest: bytes) -> bytes:
        """The top node when the node at ``place`` is ``digest``: each parent resumes its state before the slot."""
        for before, nodes in zip(self.states, self.nodes):
            h = before[place].copy()
            h.update(digest)
            h.update(b"".join(nodes[place + 1:place - place % BRANCH + BRANCH]))
            digest = h.hexdigest().encode()
            place //= BRANCH
        return digest


def block_tree(nodes: Sequence[str], block: int, levels: int = LEVELS) -> MidstateTree:
    """The tree of one block. A first block that is not full is alone in its group and goes up to the group's top only."""
    alone = block == 0 and len(nodes) < BRANCH ** levels
    return MidstateTree([x.encode() for x in nodes], depth(len(nodes)) if alone else levels)


class WayUp:
    """The levels above a block, from its siblings there, with the states before its slots."""

    def __init__(self, left: Sequence[str], right: Sequence[str]):
        self.steps = [(hashlib.sha256(a.encode()), b.encode()) for a, b in zip(left, right)]
        self.proof = b"".join(a.encode() + b.encode() for a, b in zip(left, right))

    def fold(self, digest: bytes) -> bytes:
        for before, right in self.steps:
            h = before.copy()
            h.update(digest)
            h.update(right)
            digest = h.hexdigest().encode()
        return digest


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place ``pos`` (from 0) in their ``tree``. Equal rows are told apart by where they are stored,
    so that any number of them can be split over tasks."""
    unique = C.scratch_name("stored")
    ranked = distributed_rank(rows.withColumn(unique, F.monotonically_increasing_id()), ["tree"], [*order, unique], "pos")
    return ranked.drop(unique).withColumn("pos", F.col("pos") - 1)


def _rounds(placed: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """Tables of blocks (tree, block, nodes: structs by place, top), round by round, until each tree is one block.

    ``placed`` has tree, pos, digest and columns that stay with the first round's nodes.
    """
    out = []
    while True:
        inner = F.struct("pos", "digest", *[c for c in placed.columns if c not in ("tree", "pos", "digest")])
        blocks = (placed.groupBy("tree", F.floor(F.col("pos") / BRANCH ** levels).cast("bigint").alias("block"))
                  .agg(F.sort_array(F.collect_list(inner)).alias("nodes")))

        @F.arrow_udf("string")
        def top(block: pa.Array, digests: pa.Array) -> pa.Array:
            return pa.array([block_tree(d.as_py(), b.as_py(), levels).nodes[-1][0].decode() for b, d in zip(block, digests)], pa.string())

        out.append(C.written(blocks.withColumn("top", top("block", F.col("nodes.digest"))), f"merkle-{name}"))
        last = out[-1].agg(F.max("block")).first()[0]
        if not last:
            return out
        placed = out[-1].select("tree", F.col("block").alias("pos"), F.col("top").alias("digest"))


def _each_block(blocks: DataFrame, work, schema: str, arrow: pa.Schema) -> DataFrame:
    """``work`` (a row of ``blocks`` as a dict -> columns) on one block after the other."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                columns = work(batch.slice(i, 1).to_pylist()[0])
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return blocks.mapInArrow(run, schema)


def _handed_down(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The way up of every node of ``blocks``, given that of every block: tree, block (the node's place), left, right, subroot, root."""
    texts = pa.list_(pa.string())
    arrow = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("left", texts), ("right", texts), ("subroot", pa.string()), ("root", pa.string())])

    def ways(row):
        digests = [n["digest"] for n in row["nodes"]]
        tree, n = block_tree(digests, row["block"], levels), len(digests)
        sides = [tree.siblings(i) for i in range(n)]
        return ([row["tree"]] * n, [n["pos"] for n in row["nodes"]], [[a.decode() for a, _ in s] + row["left"] for s in sides],
                [[z.decode() for _, z in s] + row["right"] for s in sides], [row["subroot"]] * n, [row["root"]] * n)

    joined = blocks.join(above, ["tree", "block"])
    return _each_block(joined, ways, "tree string, block bigint, left array<string>, right array<string>, subroot string, root string", arrow)


class Manifest:
    """The stored tree of a dataset: blocks of leaves and of the nodes above them, subroots and root.

    ``leaves`` has tree (group), id and leaf, and any further columns that stay with a leaf (such as its replacement).
    """

    def __init__(self, leaves: DataFrame, levels: int = LEVELS):
        self.levels = levels
        stored = C.written(leaves.withColumnRenamed("leaf", "digest"), "merkle-leaves")
        self.rounds = _rounds(_placed(stored, ["id", "digest"]), "blocks", levels)
        tops = self.rounds[-1].select("tree", F.col("top").alias("digest"))
        #: One row per group, in order: name (group), pos, digest.
        self.subroots = C.written(_placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]), "merkle-subroots")
        self.upper = _rounds(self.subroots, "upper", levels)

    @property
    def root(self) -> str | None:
        row = self.upper[-1].select("top").first()
        return row and row[0]

    def ways(self) -> DataFrame:
        """The way from every block of leaves up to the root: tree, block, left, right (siblings level by level), subroot, root."""
        none = F.array().cast("array<string>")
        above = self.upper[-1].select("tree", "block", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("top").alias("root"))
        for blocks in reversed(self.upper):
            above = _handed_down(blocks, above, self.levels)
        groups = self.subroots.select("tree", F.col("pos").alias("block"), "name", "digest")
        above = above.join(groups, ["tree", "block"]).select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("block"),
                                                             "left", "right", F.col("digest").alias("subroot"), "root")
        for blocks in reversed(self.rounds[1:]):
            above = _handed_down(blocks, above, self.levels)
        return above

    def folded(self, replacement: str) -> DataFrame:
        """Every leaf folded up with the column ``replacement`` in its place (null: the leaf itself).

        tree, id, leaf, subroot, root, proof (hash of the siblings up to the root), folded_root, verified.
        """
        arrow = pa.schema([("tree", pa.string()), ("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                           ("proof", pa.string()), ("folded_root", pa.string())])

        levels = self.levels

        def fold(row):
            nodes, up = row["nodes"], WayUp(row["left"], row["right"])
            tree, n = block_tree([x["digest"] for x in nodes], row["block"], levels), len(nodes)
            proofs = [hashlib.sha256(b"".join(x for side in tree.siblings(i) for x in side) + up.proof).hexdigest() for i in range(n)]
            tops = [up.fold(tree.fold(i, (x[replacement] or x["digest"]).encode())).decode() for i, x in enumerate(nodes)]
            return ([row["tree"]] * n, [x["id"] for x in nodes], [x["digest"] for x in nodes], [row["subroot"]] * n, [row["root"]] * n, proofs, tops)

        joined = self.rounds[0].join(self.ways(), ["tree", "block"])
        rows = _each_block(joined, fold, "tree string, id bigint, leaf string, subroot string, root string, proof string, folded_root string", arrow)
        return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def group_name(group: Column) -> Column:
    """A group's name in the tree: never null, in the order null first, then by UTF-8 bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), group.cast("string")))


def tampered(text: Column, doc_id: Column) -> Column:
    """What tampering makes of a text: lower case where 3 divides the crc32 of the id."""
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, lowered(text)).otherwise(text)


def of_documents(docs: DataFrame, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs`` by language, each leaf with ``changed``, its hash after tampering (null: not touched)."""
    own = {c: F.col(c) for c in FIELDS}
    changed = leaf_hash([own[c] if c != "text" else tampered(own["text"], own["doc_id"]) for c in FIELDS])
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return Manifest(docs.select(group_name(F.col("lang")).alias("tree"), F.col("doc_id").cast("bigint").alias("id"),
                                leaf_hash(list(own.values())).alias("leaf"), F.when(touched, changed).alias("changed")), levels)


def digest(folded: DataFrame) -> DataFrame:
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")
