"""Materialized derived tables in the shared folder.

A derived table (e.g. the scored loan dataset) is written once per input
version as Parquet under ``spark.checkpoint.dir``/tables and read back by
every query: later scans prune columns and push filters, the lineage is cut
(an executor loss recomputes nothing upstream), and the expensive join and
global statistics run once instead of once per consumer.

The key is a hash of the table name, the input files' (path, length,
modification time) and the source of the modules that define the
derivation, so a changed input or changed code builds a new table. Writes go
to a temporary folder that is renamed into place, so concurrent builders
never expose a partial table.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _files(fs, path):
    """Every file below a path, partition folders included (paths, lengths, times; no contents)."""
    if not fs.exists(path):
        return
    it = fs.listFiles(path, True)
    while it.hasNext():
        st = it.next()
        if not st.getPath().getName().startswith(("_", ".")):
            yield f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}"


def signature(spark: SparkSession, inputs: Sequence[str], code_files: Sequence[str], extra: str) -> str:
    """Hash of the input files (path, length, modification time), the defining modules and ``extra``."""
    h = hashlib.sha256(extra.encode())
    for path in inputs:
        fs, p = _fs(spark, path)
        h.update(f"{path}|".encode())
        for f in sorted(_files(fs, p)):
            h.update(f"{f}|".encode())
    for f in code_files:
        with open(f, "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()[:20]


def publish(fs, tmp, path) -> bool:
    """Rename a finished folder into place; False if another builder's table is already there.

    Where both rename at once, the later folder lands inside the earlier one; it is
    found there and removed.
    """
    if not fs.exists(path) and fs.rename(tmp, path):
        inside = path.suffix("/" + tmp.getName())
        if not fs.exists(inside):
            return True
        fs.delete(inside, True)
        return False
    fs.delete(tmp, True)
    return False


def published(spark: SparkSession, name: str, inputs: Sequence[str], code_files: Sequence[str],
              write: Callable[[str], None], extra: str = "", rebuild: bool = False, marker: str = "_SUCCESS") -> str:
    """The folder that ``write(path)`` fills, written once per version of the inputs and modules.

    ``marker``: the file below it that is written last."""
    root = os.path.join(ensure_checkpoint_dir(spark), "tables")
    path = os.path.join(root, f"{name}-{signature(spark, inputs, code_files, extra)}")
    fs, p = _fs(spark, path)
    _, done = _fs(spark, f"{path}/{marker}")
    if rebuild or not fs.exists(done):
        tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
        write(tmp)
        _, tp = _fs(spark, tmp)
        if rebuild and fs.exists(p):
            fs.delete(p, True)
        publish(fs, tp, p)
    return path


def materialized(spark: SparkSession, name: str, inputs: Sequence[str], code_files: Sequence[str],
                 build: Callable[[], DataFrame], extra: str = "", rebuild: bool = False) -> DataFrame:
    return spark.read.parquet(published(spark, name, inputs, code_files, lambda tmp: build().write.mode("overwrite").parquet(tmp, compression="zstd"), extra, rebuild))
