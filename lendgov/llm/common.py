"""Helpers shared by the operators: session settings, shared scratch tables, text batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows and bytes of an Arrow batch: whole texts can be long, so batches stay small.
TEXT_BATCH_ROWS = 1000
TEXT_BATCH_BYTES = 1 << 25
#: Bytes of text that the vectorised scorers hold as numpy arrays at once.
CHUNK_BYTES = 1 << 20
#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+`` (what ``bytes.split`` splits at).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: UTC, a checkpoint folder, small Arrow batches."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))
    ensure_checkpoint_dir(spark)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def scratch_name(stem: str) -> str:
    """A column name that no input column has."""
    return f"__{stem}_{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet below the shared checkpoint folder and read it back.

    An executor that is lost later recomputes nothing upstream. The folder goes
    when the application ends.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def text_crc(col: Column | str) -> Column:
    """crc32 of a column's text form, as SQL and zlib compute it; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string"))


def hash_share(col: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone (null: that of an empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    h = F.xxhash64(F.coalesce(c.cast("string"), F.lit("")), F.lit(seed))
    return F.pmod(h, F.lit(1 << 32)).cast("double") / float(1 << 32)


def _windows(text: bytes, overlap: int, target: int) -> Iterator[bytes]:
    """Pieces that repeat ``overlap`` bytes: each window of ``overlap + 1`` bytes lies in exactly one."""
    yield text[:target + overlap]
    for at in range(target, len(text) - overlap, target):
        yield text[at:at + target + overlap]


def _whole_words(text: bytes, target: int) -> Iterator[bytes]:
    """Pieces that end at a space."""
    at = 0
    while at < len(text) or at == 0:
        end = text.find(b" ", at + target)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = max(end, 1)


def chunks(texts: Sequence[bytes], overlap: int | None, target: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pack texts into byte arrays of about ``target`` bytes.

    Yields (bytes, owner): ``owner[i]`` is the index of the text that byte i belongs
    to. Texts are separated by zero bytes. A longer text is cut into pieces: with an
    ``overlap`` for windows of ``overlap + 1`` bytes, with None between words.
    """
    gap = b"\0" * (overlap or 1)
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for p in _whole_words(t, target) if overlap is None else _windows(t, overlap, target):
            parts.append(p)
            owners.append(i)
            size += len(p)
            if size >= target:
                yield _packed(parts, owners, gap)
                parts, owners, size = [], [], 0
    if parts:
        yield _packed(parts, owners, gap)


def _packed(parts: list[bytes], owners: list[int], gap: bytes) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter((len(p) + len(gap) for p in parts), np.int64, len(parts))
    return np.frombuffer(gap.join(parts) + gap, np.uint8), np.repeat(np.asarray(owners, np.int64), lens)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n_rows: int, n_cols: int,
                 target: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over a sparse matrix of a bounded sample.

    Accelerated gradient descent with a step from the row norms; deterministic.
    """
    w, b = np.zeros(n_cols), 0.0
    weight = weight / max(weight.sum(), 1e-12)
    norm = np.bincount(rows, vals * vals, n_rows)
    rate = 4.0 / max(float((weight * (norm + 1.0)).sum()), 1e-12)
    vw, vb, prev = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(rows, vals * vw[cols], n_rows) + vb
        g = weight * (sigmoid(z) - target)
        gw = np.bincount(cols, vals * g[rows], n_cols) + l2 * vw
        nw, nb = vw - rate * gw, vb - rate * float(g.sum())
        nxt = (1 + (1 + 4 * prev * prev) ** 0.5) / 2
        m = (prev - 1) / nxt
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b, prev = nw, nb, nxt
    return w, b


def broadcast(value):
    """A read-only copy of a bounded value (model, plan) on every executor."""
    return SparkSession.getActiveSession().sparkContext.broadcast(value)
