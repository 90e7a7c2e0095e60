"""Vector and lexical retrieval.

Vectors are found through an exact index of balls around pivots, so that a query is not compared with every document.
Top-k per query uses ``row_number() <= k`` over a window by query: Spark
plans a partial WindowGroupLimit before the shuffle, so each map task keeps
at most k candidates per query and a hot query never gathers all documents
in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(arr):
    return F.transform(arr, lambda x: x.cast("double"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def normalized(df: DataFrame, vec: str = "embedding", out: str = "unit") -> DataFrame:
    """L2-normalised copy of a FLOAT array (in doubles)."""
    v = as_double(F.col(vec))
    once = F.array(F.sqrt(dot(v, v)))  # bound by a lambda: inside the inner one alone it would be computed for every component
    return df.withColumn(out, F.transform(once, lambda n: F.transform(v, lambda x: x / n))[0])


#: Pivots of an index, and the width of its shells (distances of unit vectors lie between 0 and 2).
PIVOTS = 256
SHELL = 0.1
#: Vectors that one task scores together: small blocks are put together up to it, a larger one is cut.
BLOCK_ROWS = 10_000
#: Queries whose distances to all pivots, or scores with a chunk, a task holds at once.
QUERY_ROWS = 64
#: Queries that meet one chunk in one task.
QUERY_GROUP = 100_000
#: What rounding may add to a distance, and to a score from a matrix product.
SLACK = 1e-6
SCORE_SLACK = 1e-9


@dataclass
class BallIndex:
    """An exact index for inner products of unit vectors.

    Every vector belongs to its nearest pivot and there to a shell of distances from it: a block. ``members`` (doc_id, unit, block,
    chunk) is stored; ``blocks`` holds block, pivot, least and greatest distance, vectors and chunks of each block, at most
    pivots x 2 / shell width rows. By the triangle inequality a query at distance d from the pivot is no nearer to any vector of the
    block than max(d - greatest, least - d), so whole blocks are passed over. A chunk is what one task scores together, by one
    matrix product: neighbouring small blocks, or an even part of a large one.
    """

    pivots: np.ndarray
    blocks: pd.DataFrame
    members: DataFrame

    @staticmethod
    def build(docs: DataFrame, n_pivots: int = PIVOTS, shell: float = SHELL, block_rows: int = BLOCK_ROWS) -> "BallIndex":
        """``docs``: (doc_id, unit). The pivots are ``n_pivots`` of its vectors, picked by a hash of the id."""
        spark = docs.sparkSession
        picked = docs.where("unit is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_pivots).select("unit").collect()
        pivots = np.array([r["unit"] for r in picked], float)
        if not len(picked):
            return BallIndex(pivots, pd.DataFrame(columns=["block", "pivot", "least", "greatest", "n", "chunks"]), docs.limit(0))
        shared = spark.sparkContext.broadcast(pivots)

        @F.arrow_udf("struct<pivot: int, distance: double>")
        def nearest(unit: pa.Array) -> pa.Array:
            x = unit.flatten().to_numpy(zero_copy_only=False).reshape(len(unit), -1)
            score = x @ shared.value.T
            best = score.argmax(1)
            far = np.sqrt(((x - shared.value[best]) ** 2).sum(1))
            return pa.StructArray.from_arrays([pa.array(best.astype(np.int32)), pa.array(far)], ["pivot", "distance"])

        shells = int(2 / shell) + 2
        found = docs.where("unit is not null").withColumn("at", nearest("unit"))
        block = F.col("at.pivot") * shells + F.floor(F.col("at.distance") / shell).cast("int")
        placed = found.select("doc_id", "unit", F.col("at.pivot").alias("pivot"), F.col("at.distance").alias("distance"), block.alias("block")).checkpoint()
        blocks = placed.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("least"), F.max("distance").alias("greatest"),
                                             F.count(F.lit(1)).alias("n")).orderBy("block").toPandas()
        blocks["chunks"] = _chunks(blocks["n"].tolist(), block_rows)
        of_block = spark.createDataFrame([(int(b), c) for b, c in zip(blocks["block"], blocks["chunks"])], "block int, chunks array<int>")
        part = F.pmod(F.xxhash64("doc_id"), F.size("chunks")).cast("int")
        members = placed.join(F.broadcast(of_block), "block").select("doc_id", "unit", "block", F.get("chunks", part).alias("chunk"))
        return BallIndex(pivots, blocks, members)

    def topk(self, queries: DataFrame, k: int = 3, exclude_self: bool = True) -> DataFrame:
        """query_id, doc_id, score, rank: the k documents with the greatest inner product with each query (query_id, unit).

        Ties -> smaller doc_id. The blocks with the greatest bounds that hold k vectors are scored first; then only those whose
        bound is not below the k-th score found. Of each chunk a query's k best go on.
        """
        one, two = self._passes(queries, k, exclude_self, keep=k)
        return _best(one.unionByName(two), k)

    def scored(self, queries: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
        """All (query_id, doc_id, score) that had to be computed, and how many blocks each query went into."""
        one, two = self._passes(queries, k, exclude_self, keep=None)
        if not len(self.pivots):
            return one.drop("block"), queries.select("query_id", F.lit(0).alias("blocks"))
        both = one.unionByName(two).checkpoint()
        return both.drop("block"), both.groupBy("query_id").agg(F.count_distinct("block").alias("blocks"))

    def _passes(self, queries: DataFrame, k: int, exclude_self: bool, keep: int | None) -> tuple[DataFrame, DataFrame]:
        """(query_id, doc_id, score, block) of the blocks that k vectors need, and of the others that may hold a better one;
        with ``keep`` only the ``keep`` best of a query in each chunk."""
        spark = queries.sparkSession
        doc_type = self.members.schema["doc_id"].dataType
        if not len(self.pivots):
            none = queries.select("query_id", F.lit(None).cast(doc_type).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("block")).limit(0)
            return none, none
        q = queries.where("unit is not null").select("query_id", "unit")
        # rows of a repeated query id share what they go into: each row's vector is scored where each row goes
        q = q.withColumnRenamed("unit", "seen").join(q, "query_id").checkpoint()
        groups = max(1, -(-q.count() // QUERY_GROUP))
        of_chunk: dict[int, list[int]] = {}
        for i, chunks in enumerate(self.blocks["chunks"]):
            for c in chunks:
                of_chunk.setdefault(c, []).append(i)
        chunk_blocks = [np.array(of_chunk[c]) for c in range(len(of_chunk))]
        shared = spark.sparkContext.broadcast((self.pivots, *[self.blocks[c].to_numpy() for c in ("pivot", "least", "greatest", "n", "block")], chunk_blocks))
        kind = q.schema["query_id"].dataType.simpleString()
        need = k + int(exclude_self)

        def visits(first: bool):
            """Per batch of queries (query_id, vector for the bounds, unit, k-th score found): the chunks to go into, and their blocks (``go``)."""
            def run(batches):
                pivots, pivot, least, greatest, n, _, chunk_blocks = shared.value
                for batch in (b.slice(i, QUERY_ROWS) for b in batches for i in range(0, b.num_rows, QUERY_ROWS)):
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    far = np.sqrt(np.maximum(((x[:, None, :] - pivots[None]) ** 2).sum(2), 0.0))[:, pivot]
                    near = np.maximum(np.maximum(far - greatest, least - far) - SLACK, 0.0)
                    bound = 1.0 - near * near / 2.0
                    order = np.argsort(-bound, axis=1, kind="stable")
                    upto = np.cumsum(n[order], axis=1) - n[order]
                    early = np.zeros(bound.shape, bool)
                    np.put_along_axis(early, order, upto < need, axis=1)  # until k vectors are in
                    if first:
                        go = early
                    else:
                        kth = batch.column(3).to_numpy(zero_copy_only=False)
                        go = ~early & (bound >= np.where(np.isnan(kth), -np.inf, kth)[:, None])
                    for chunk, cols in enumerate(chunk_blocks):
                        inside = go[:, cols]
                        rows = np.flatnonzero(inside.any(1))
                        if len(rows):
                            at = pa.array(rows)
                            yield pa.record_batch([pa.array(np.full(len(rows), chunk, np.int32)), *[batch.column(c).take(at) for c in (0, 2, 3)],
                                                   pa.array([r.tobytes() for r in inside[rows]], pa.binary())], names=["chunk", "query_id", "unit", "kth", "go"])
            return run

        out = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("doc_id", doc_type),
                            T.StructField("score", T.DoubleType()), T.StructField("block", T.IntegerType())])

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            return _meet(asked, held, shared.value[5], shared.value[6], exclude_self, keep)

        group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
        members = self.members.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def scores(given: DataFrame, first: bool) -> DataFrame:
            went = given.mapInArrow(visits(first), f"chunk int, query_id {kind}, unit array<double>, kth double, go binary").withColumn("grp", group)
            return went.groupBy("chunk", "grp").cogroup(members.groupBy("chunk", "grp")).applyInArrow(meet, out)

        one = scores(q.withColumn("kth", F.lit(float("nan"))), True).checkpoint()
        kth = _best(one, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        two = scores(q.join(kth, "query_id", "left").select("query_id", "seen", "unit", F.coalesce("kth", F.lit(float("nan"))).alias("kth")), False)
        return one, two


def _chunks(sizes: list[int], rows: int) -> list[list[int]]:
    """For each block the chunks its vectors are dealt over: a block above ``rows`` has chunks of its own, smaller neighbours share one."""
    out, last, held = [], -1, rows
    for n in sizes:
        if n > rows:
            out.append(list(range(last + 1, last + 1 - (-n // rows))))
            last, held = out[-1][-1], rows
        else:
            if held + n > rows:
                last, held = last + 1, 0
            out.append([last])
            held += n
    return out


def _matrix(units: pa.ChunkedArray) -> np.ndarray:
    return units.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(units), -1)


def _meet(asked: pa.Table, held: pa.Table, block, chunk_blocks, exclude_self: bool, keep: int | None) -> pa.Table:
    """Queries against the vectors of one chunk: a matrix product finds the pairs that matter, whose scores are then added up
    component by component, so that equal vectors score the same in every chunk."""
    none = pa.table({"query_id": asked["query_id"].slice(0, 0), "doc_id": held["doc_id"].slice(0, 0), "score": pa.array([], pa.float64()), "block": pa.array([], pa.int32())})
    if not asked.num_rows or not held.num_rows:
        return none
    if exclude_self:  # as in SQL, where null <> id is not true
        held = held.filter(held["doc_id"].is_valid())
    held = held.take(pc.sort_indices(held["doc_id"], null_placement="at_start"))  # by place = by doc_id
    names = block[chunk_blocks[asked["chunk"][0].as_py()]]
    if not held.num_rows:
        return none
    ids = held["doc_id"].combine_chunks().dictionary_encode("encode")
    x, col, id_code, known = _matrix(held["unit"]), np.searchsorted(names, held["block"].to_numpy()), ids.indices.to_numpy(), ids.dictionary.to_pandas()
    if keep is not None:
        some = _first_alike(x, col, id_code, keep)
        held, x, col, id_code = held.take(pa.array(some)), x[some], col[some], id_code[some]
    by_part = np.ascontiguousarray(x.T)
    tables = [none]
    for at in range(0, asked.num_rows, QUERY_ROWS):
        some = asked.slice(at, QUERY_ROWS)
        q = _matrix(some["unit"])
        into = np.array([np.frombuffer(b, bool) for b in some["go"].to_pylist()])[:, col]
        if exclude_self:
            into &= pd.Index(known).get_indexer(some["query_id"].to_pandas())[:, None] != id_code
        if keep is not None:
            score = np.where(into, q @ x.T, -np.inf)
            m = min(keep, len(x))
            floor = np.fmax(np.partition(score, len(x) - m, axis=1)[:, len(x) - m], some["kth"].to_numpy()) - SCORE_SLACK
            into &= ~(score < floor[:, None])
        row, place = np.nonzero(into)
        exact, q_part = np.zeros(len(row)), np.ascontiguousarray(q.T)
        for a, b in zip(q_part, by_part):
            exact += a[row] * b[place]
        if keep is not None:
            order = np.lexsort((place, np.where(np.isnan(exact), -np.inf, -exact), row))  # NaN is the greatest double, as in Spark
            row, place, exact = row[order], place[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < keep
            row, place, exact = row[best], place[best], exact[best]
        tables.append(pa.table({"query_id": some["query_id"].take(pa.array(row)), "doc_id": held["doc_id"].take(pa.array(place)),
                                "score": pa.array(exact, pa.float64()), "block": pa.array(names[col[place]], pa.int32())}))
    return pa.concat_tables(tables)


def _first_alike(x: np.ndarray, col: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """The rows that can be among a query's ``keep`` best where equal vectors of a block tie by place: of each vector the first
    ``keep`` + 1 ids (one may be the query's), and ``keep`` rows of each."""
    rows = np.ascontiguousarray(np.column_stack([x, col]) + 0.0)
    alike = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    of = pd.DataFrame({"alike": alike, "id": ids})
    copy = of.groupby(["alike", "id"], sort=False).cumcount()
    of["first"] = copy == 0
    nth = of.groupby("alike", sort=False)["first"].cumsum()
    return np.flatnonzero((copy < keep) & (nth <= keep + 1))


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return scored.select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_inner_product(queries: DataFrame, docs: DataFrame, k: int = 3, exclude_self: bool = True) -> DataFrame:
    """Top-k documents per query by cosine similarity, through an index built for the call."""
    return BallIndex.build(docs).topk(queries, k, exclude_self)


def centroids(df: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per key, L2-normalised: (query_id, unit).

    Element-wise means via (key, position) partial aggregates, so the work is
    one pass over the table and what is regrouped is keys x dimensions.
    """
    pos = df.select(F.col(key).alias("query_id"), F.posexplode(as_double(F.col(vec))).alias("i", "x"))
    means = pos.groupBy("query_id", "i").agg(F.avg("x").alias("m"))
    arr = means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    return normalized(arr, "embedding", "unit").select("query_id", "unit")


# The guidance corpus, in document order.
GUIDANCE = [
    "To improve loan approval chances, maintain a strong history of on-time repayments.",
    "Reducing existing debts and credit utilization lowers perceived risk.",
    "Providing collateral or a co-signer can help borderline applications.",
    "Stable employment and consistent income increase creditworthiness.",
    "Avoid applying for multiple loans or credit lines in a short period.",
    "If your application is denied, ask for specific reasons and address them before reapplying.",
    "Building savings and an emergency fund shows financial resilience.",
]


def tokens(text):
    """Distinct lower-case word tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]+", " ")), " "),
                                     lambda t: t != ""))


def guidance_topk(text, k: int = 3):
    """Top-k guidance snippets for one text: binary bag-of-words cosine, ties -> document order.

    The corpus is a fixed literal array, so this is a per-row expression (no join).
    """
    qt = tokens(text)
    docs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), tokens(F.lit(t)).alias("w"))
                     for i, t in enumerate(GUIDANCE)])
    scored = F.transform(docs, lambda d: F.struct(
        (-(F.size(F.array_intersect(qt, d["w"])) /
           F.greatest(F.sqrt(F.size(qt) * F.size(d["w"])), F.lit(1.0)))).alias("neg_score"),
        d["i"].alias("i"), d["t"].alias("t")))
    return F.transform(F.slice(F.sort_array(scored), 1, k), lambda x: x["t"])


def guidance_corpus(spark) -> DataFrame:
    """The literal corpus as a table."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(GUIDANCE)], "doc_id int, text string")
