"""Windows of a fixed length that occur more than once in a collection, as Spark jobs.

All windows of all documents are compared, by runs of neighbouring starts:

1. every document is cut into runs of window starts with a common anchor
   (``windows.py``); runs are brought together by their anchor's hash, and runs
   with equal spans settle all their starts at once;
2. a run that differs from others of its anchor is cut into cells of ``cell``
   starts. The part that all windows of a cell share (the core) groups them; a
   core that occurs once ends the matter, equal cells settle their starts;
3. what is left is compared start by start within its core.

Only hashes, places and a few bytes beside a core are shuffled, never windows.
A task sends one of several equal runs; groups are read as sorted streams with
one row held, so a group of any size needs no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.llm.shared import mix, slices, stored, text_bytes
from playtally.llm.windows import Runs, Sums, runs

SLICE_BYTES = 2_000_000
#: Units in which windows are named at a time; a longer text goes piece by piece.
PIECE_UNITS = 1 << 22
#: A place in a document, a number of starts and the distance to the anchor share one number.
_BITS = 12
_MASK = (1 << _BITS) - 1
MAX_LENGTH = 1 << _BITS

_RUN = "g bigint, c bigint, ref bigint, place bigint, known boolean"
_CELL = _RUN + ", margin binary"

# (column of texts) -> units, ends
Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _table(rows: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, (rows, 256), np.uint64)


_BYTE = _table(1)[0]


def byte_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, ends = text_bytes(column)
    return _BYTE[data], ends


def pack(low: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (low.astype(np.int64) << (2 * _BITS)) | (count << _BITS) | offset


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> (2 * _BITS), (place >> _BITS) & _MASK, place & _MASK


def _known(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows equal to another one here, and of those all but one for each value."""
    order = np.lexsort((c, g))
    same = (g[order][1:] == g[order][:-1]) & (c[order][1:] == c[order][:-1])
    after, before = np.append(same, False), np.append(False, same)
    known, spare = np.empty(len(g), bool), np.empty(len(g), bool)
    known[order], spare[order] = after | before, before
    return known, spare


def _rows(g, c, ref, place, margin=None) -> pa.RecordBatch:
    """One of several equal rows stands for them; the others go along under a number of their own."""
    known, spare = _known(g, c)
    g = np.where(spare, mix(ref.view(np.uint64) + place.view(np.uint64)), g)
    columns = [g.view(np.int64), c.view(np.int64), ref, place, known]
    names = ["g", "c", "ref", "place", "known"]
    if margin is not None:
        columns.append(margin)
        names.append("margin")
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, c): ``hit`` if (g, c) occurs again, ``open`` for one row of each c where g has several."""
    held, same_before, class_before = None, False, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        out, held, same_before, class_before = _adjacent(batch, same_before, class_before, False)
        if out.num_rows:
            yield out
    if held is not None:
        yield _adjacent(held, same_before, class_before, True)[0]


def _adjacent(batch, same_before, class_before, last):
    g, c = batch.column("g").to_numpy(), batch.column("c").to_numpy()
    n = len(g)
    same_g = g[1:] == g[:-1]
    same_c = same_g & (c[1:] == c[:-1])
    before = np.append(same_before, same_c)
    after = np.append(same_c, False)
    # Whether the group has a class before the row's own.
    starts = np.flatnonzero(~np.append(True, same_c))
    earlier = np.empty(n, bool)
    first = int(starts[0]) if len(starts) else n
    earlier[:first] = class_before
    if len(starts):
        earlier[first:] = np.repeat(same_g[starts - 1], np.diff(np.append(starts, n)))
    ends = ~after
    open_ = ends & (earlier | np.append(same_g & ~same_c, False))
    hit = before | after | batch.column("known").to_numpy(zero_copy_only=False)
    stop = n if last else n - 1
    hit, open_ = hit[:stop], open_[:stop]
    keep = hit | open_
    out = batch.slice(0, stop).filter(pa.array(keep))
    out = out.append_column("hit", pa.array(hit[keep])).append_column("open", pa.array(open_[keep]))
    return out, None if last else batch.slice(n - 1), bool(before[-1]), bool(earlier[-1])


def _judged(rows: DataFrame, schema: str) -> DataFrame:
    ordered = rows.repartition("g").sortWithinPartitions("g", "c")
    return ordered.mapInArrow(_judge, schema + ", hit boolean, open boolean")


def referenced(docs: DataFrame) -> DataFrame:
    """Adds ``ref``: rows with equal id and text have equal results."""
    return docs.withColumn("ref", F.xxhash64("doc_id", "text"))


def runs_by_pieces(values: np.ndarray, ends: np.ndarray, length: int, gram: int, piece: int) -> Iterator[Runs]:
    """The runs of each ``piece`` starts; ``low`` counts from the beginning of the document.

    A run over a border comes as two. They have spans of their own, so their
    starts are compared in cells with those of whole runs.
    """
    for begin in range(0, max(1, len(values) - length + 1), piece):
        part = values[begin : begin + piece + length - 1]
        found = runs(part, np.clip(ends - begin, 0, len(part)), length, gram)
        if len(found.doc):
            yield replace(found, low=found.low + np.maximum(0, begin - ends[found.doc]))


def _runs_of(units: Units, length: int, gram: int, piece: int):
    def cut(batches):
        for batch in slices(batches, SLICE_BYTES):
            values, ends = units(batch.column("text"))
            for found in runs_by_pieces(values, ends, length, gram, piece):
                ref = batch.column("ref").to_numpy()[found.doc]
                yield _rows(found.anchor, found.span, ref, pack(found.low, found.count, found.offset))

    return cut


def _cells_of(units: Units, length: int, cell: int):
    def cut(batches):
        for batch in slices(batches, SLICE_BYTES):
            values, ends = units(batch.column("text"))
            lists = batch.column("opens")
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            anchor = flat.field("g").to_numpy().view(np.uint64)
            low, count, offset = unpack(flat.field("place").to_numpy())
            # Starts by their distance d to the anchor; cells are ranges of d.
            far, near = offset, offset - count + 1
            first, last = near // cell, far // cell
            repeat = last - first + 1
            row = np.repeat(np.arange(len(doc)), repeat)
            j = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            high = np.minimum(far[row], j * cell + cell - 1)
            least = np.maximum(near[row], j * cell)
            place = low[row] + offset[row]  # of the anchor
            at = ends[doc[row]] + place
            sums = Sums(values)
            core = sums(at - j * cell, at - (j * cell + cell - 1) + length)
            g = mix(anchor[row] ^ mix(core + j.astype(np.uint64)))
            c = mix(sums(at - high, at - least + length) ^ mix((high * MAX_LENGTH + least).astype(np.uint64)))
            margin = None
            if cell > 1:
                data, _ = text_bytes(batch.column("text"))
                side = np.arange(cell - 1)
                begin = (at - j * cell - cell + 1)[:, None] + side
                margin = np.concatenate([begin, begin + length], axis=1)
                margin = data[np.clip(margin, 0, len(data) - 1)]
                margin = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(2 * (cell - 1)), len(margin), [None, pa.py_buffer(np.ascontiguousarray(margin))]
                ).cast(pa.binary())
            else:
                c = np.zeros(len(g), np.uint64)
            ref = batch.column("ref").to_numpy()[doc[row]]
            yield _rows(g, c, ref, pack(place - high, high - least + 1, high), margin)

    return cut


def _starts_of(cell: int):
    weights = _table(2 * (cell - 1) + 1)

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy().view(np.uint64)
            low, count, high = unpack(batch.column("place").to_numpy())
            margin = np.frombuffer(b"".join(batch.column("margin").to_pylist()), np.uint8)
            margin = weights[np.arange(2 * (cell - 1)), margin.reshape(len(g), -1)]
            none = np.zeros((len(g), 1), np.uint64)
            left = np.concatenate([none, np.cumsum(margin[:, : cell - 1][:, ::-1], axis=1)], axis=1)
            right = np.concatenate([none, np.cumsum(margin[:, cell - 1 :], axis=1)], axis=1)
            row = np.repeat(np.arange(len(g)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            inner = (high[row] - step) % cell
            key = mix(left[row, inner] + mix(right[row, cell - 1 - inner] + inner.astype(np.uint64)))
            key = mix(g[row] ^ key)
            one = np.ones(len(row), np.int64)
            ref = batch.column("ref").to_numpy()[row]
            yield _rows(key, np.zeros(len(row), np.uint64), ref, pack(low[row] + step, one, one * 0))

    return cut


def repeated_starts(
    docs: DataFrame, units: Units, length: int, gram: int, cell: int, piece: int = PIECE_UNITS
) -> DataFrame:
    """Start ranges of all windows that occur at another place as well.

    ``docs`` has (doc_id, text, ref). Returns (ref, places), ``places`` for
    ``unpack``. A text without a repeated window gives no row; null and empty
    texts have no window. A row that is there twice repeats all its windows. A
    text may be of any length.
    """
    if not 1 <= gram <= length < MAX_LENGTH:
        raise ValueError(f"1 <= gram <= length < {MAX_LENGTH} is required")
    docs = docs.select("ref", "text")
    first = _judged(docs.mapInArrow(_runs_of(units, length, gram, piece), _RUN), _RUN)
    first = stored(first.select("g", "ref", "place", "hit", "open"), "runs")
    opens = first.where("open").groupBy("ref").agg(F.collect_set(F.struct("g", "place")).alias("opens"))
    schema = _CELL if cell > 1 else _RUN
    second = _judged(docs.join(opens, "ref").mapInArrow(_cells_of(units, length, cell), schema), schema)
    hits = [first.where("hit")]
    if cell > 1:
        second = stored(second, "cells")
        left = second.where("open").mapInArrow(_starts_of(cell), _RUN)
        hits.append(_judged(left, _RUN).where("hit"))
    hits.append(second.where("hit"))
    found = hits[0].select("ref", "place")
    for more in hits[1:]:
        found = found.unionByName(more.select("ref", "place"))
    return found.groupBy("ref").agg(F.collect_set("place").alias("places"))
