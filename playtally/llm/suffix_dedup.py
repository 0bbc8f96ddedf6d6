"""Removal of byte strings that occur more than once (7)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.llm.repeats import byte_units, referenced, repeated_starts, unpack
from playtally.llm.shared import documents, keyed_texts, packed, schema_with, slices, text_bytes, with_text

LENGTH = 200
#: Bytes of an anchor and starts of a cell; any values give the same result.
GRAM, CELL = 64, 16


def cover(places: pa.ListArray, ends: np.ndarray, length: int) -> np.ndarray:
    """Which units of the documents between ``ends`` lie in a window at one of the packed places."""
    doc = np.repeat(np.arange(len(places)), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low, count, _ = unpack(places.flatten().to_numpy(zero_copy_only=False))
    edge = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(edge, ends[doc] + low, 1)
    np.add.at(edge, ends[doc] + low + count - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(length: int):
    def cut(batches):
        for batch in slices(batches, 4_000_000):
            data, ends = text_bytes(batch.column("text"))
            gone = cover(batch.column("places"), ends, length)
            total = np.append(0, np.cumsum(gone))
            begins = gone & ~np.append(False, gone[:-1])
            begins[ends[:-1][ends[:-1] < len(gone)]] |= gone[ends[:-1][ends[:-1] < len(gone)]]
            spans = np.append(0, np.cumsum(begins))
            keep = data[~gone].tobytes()
            cuts = ends - total[ends]
            texts = [keep[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "ref": batch.column("ref"),
                    "n_bytes": np.diff(ends),
                    "n_removed": np.diff(total[ends]),
                    "n_spans": np.diff(spans[ends]),
                    "kept": pa.array(texts, pa.binary()),
                }
            )

    return cut


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = GRAM,
    cell: int = CELL,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, ref, n_bytes, n_removed, n_spans, kept).

    ``kept`` is the text's UTF-8 bytes without each byte covered by a string of
    ``length`` bytes that also starts anywhere else; it can be cut within a
    character. A null text counts as empty; texts below ``length`` are kept
    whole. Equal rows are repeats of each other. Other columns are ignored.

    Windows are named by content-sampled anchors rather than by a difference
    cover of places; see README for the reason and for the figures.
    """
    docs = referenced(keyed_texts(docs, id_col, text_col))
    places = repeated_starts(docs, byte_units, length, min(gram, length), cell)
    return docs.join(places, "ref", "left").mapInArrow(
        _kept(length),
        "doc_id bigint, ref bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary",
    )


def _rewritten(length: int):
    kept = _kept(length)

    def cut(batches):
        for batch in slices(batches, 4_000_000):
            for found in kept(iter([batch])):
                texts = [t.decode("utf-8", "ignore") for t in found.column("kept").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("text"), pa.array(texts, pa.string())], names=["row", "text", "kept"]
                )

    return cut


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes removed from each text; bytes of a character that was cut go as well.

    ``n_chars`` is made to fit. No row is dropped, also if no text is left.
    """
    rows = referenced(packed(docs, id_col, text_col))
    places = repeated_starts(rows, byte_units, length, min(GRAM, length), CELL)
    joined = rows.join(places, "ref", "left")
    changed = joined.mapInArrow(_rewritten(length), schema_with(joined, "text string, kept string"))
    return with_text(changed, "kept", docs.columns, text_col)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by a dictionary of all windows, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
