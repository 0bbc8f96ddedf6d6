"""Helpers of this subpackage: stored intermediate tables, text columns as numpy arrays, hashing."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and any other
    one a folder in the warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if re.match(r"local(\[|$)", spark.conf.get("spark.master", None) or ""):
            root = _local_root()
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_playtally"
    return root.rstrip("/")


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-playtally-")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written to the shared folder and read again.

    Cuts the lineage: a lost executor costs no more than the step since the
    last stored table. The folder is left to whoever owns the shared folder.
    """
    path = f"{work_root(frame.sparkSession)}/playtally-{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of an Arrow batch. The default of 10,000 is made for numbers; as many
#: texts would be held several times over by every worker.
BATCH_ROWS = 2_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches; a smaller setting is left alone."""
    now = int(spark.conf.get(_BATCH_SETTING))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, so that no other column can clash."""
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row): as ``keyed_texts``, with all other columns beside."""
    text_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    # Never without a field; its name is longer than any.
    row = F.struct(*others, F.lit(True).alias("_" * (1 + max(map(len, docs.columns))))).alias("row")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), row)


def unpacked(rows: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns again, of rows with (text, row)."""
    return rows.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns])


def schema_with(docs: DataFrame, ddl: str) -> StructType:
    """``docs``' column ``row`` and the fields of ``ddl``."""
    return StructType([docs.schema["row"], *StructType.fromDDL(ddl).fields])


def with_text(
    rows: DataFrame, kept: str, columns: list[str], text_col: str = "text", size_col: str = "n_chars"
) -> DataFrame:
    """As ``unpacked``, with the text of column ``kept``; ``size_col``, if there is one, follows it.

    A null text stays null, and its size as it was.
    """
    empty = F.col("text").isNull()
    out = []
    for c in columns:
        if c == text_col:
            column = F.when(~empty, F.col(kept))
        elif c == size_col:
            column = F.when(empty, F.col(f"row.`{c}`")).otherwise(F.length(kept).cast("bigint"))
        else:
            column = F.col(f"row.`{c}`")
        out.append(column.alias(c))
    return rows.select(*out)


def fitted(sample: DataFrame, fit: Callable[[list[str], list[str]], dict], label: str) -> dict:
    """What ``fit`` makes of a bounded sample (text, ``label``), in one task.

    Rows come sorted and once each, so the outcome does not depend on their
    order. The driver receives the outcome only.
    """

    def run(batches):
        rows: set[tuple[str, str]] = set()
        for batch in batches:
            rows.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        ordered = sorted(rows)
        outcome = pickle.dumps(fit([t for t, _ in ordered], [x for _, x in ordered]))
        yield pa.RecordBatch.from_arrays([pa.array([outcome], pa.binary())], names=["model"])

    one = sample.select("text", F.col(label).cast("string").alias("label")).repartition(1)
    found = one.mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else fit([], [])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds more than ``size`` bytes of text, a single longer row apart."""
    for batch in batches:
        _, ends = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, ends[start] + size, "right")) - 1, start + 1)
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
