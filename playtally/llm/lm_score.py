"""Cross-entropy difference of two bigram models over one vocabulary (9).

Texts are put together to slices, each stored as one compressed row. A slice
sends the distinct words and bigrams it holds to buckets by their hash: one row
for a slice and bucket, of sorted hashes as packed differences, with the slice's
counts. A bucket adds up the counts of all slices and sends every slice the sums
for its own hashes, in the order in which they came. There the losses of each
word are worked out from the text. Neither model is ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.llm.decontaminate import _WORD_BYTES
from playtally.llm.shared import documents, keyed_texts, mix, slices, stored, text_bytes
from playtally.llm.windows import Sums

#: Weight of the unigram model, in words.
PRIOR = 50.0
#: Text that is turned into hashes at a time, and text of a slice, longer rows apart.
STEP_BYTES, SLICE_BYTES = 2_000_000, 8_000_000
#: Words of text whose hashes a bucket is made for.
BUCKET_WORDS = 1_000_000

_LOWER = np.frombuffer(_WORD_BYTES, np.uint8)
#: Kinds of counted entries: words, each also as the word before another, and bigrams.
_WORDS, _PAIRS = 0, 1


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, in order, and each word's text."""
    data, ends = text_bytes(column)
    raw, cuts = data.tobytes(), ends.tolist()
    line = b" " + b" ".join([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]) + b" "
    text = _LOWER[np.frombuffer(line, np.uint8)]
    inside = text != 0x20
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    stop = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    begins = ends[:-1] + 1 + np.arange(len(ends) - 1)
    doc = np.searchsorted(begins, first, "right") - 1
    return Sums(text.astype(np.uint64) + np.uint64(1))(first, stop), doc


def _all_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, of a large batch, some rows at a time."""
    parts, base = [], 0
    for part in slices(iter([batch]), STEP_BYTES):
        hashes, doc = word_hashes(part.column("text"))
        parts.append((hashes, (doc + base).astype(np.int32)))
        base += part.num_rows
    return np.concatenate([h for h, _ in parts]), np.concatenate([d for _, d in parts])


def _bigrams(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word before each word, 0 at a text's start, and of both together."""
    before = np.append(np.uint64(0), hashes[:-1])[: len(hashes)]
    before[np.append(True, doc[1:] != doc[:-1])[: len(hashes)]] = 0
    return before, mix(mix(before + np.uint64(1)) ^ hashes)


def pack_hashes(ordered: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences of as few bytes as the greatest needs; the first byte tells."""
    steps = np.diff(ordered, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_hashes(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count below 255, eight more behind for any other."""
    flat = counts.ravel()
    return np.minimum(flat, 255).astype(np.uint8).tobytes() + flat[flat >= 255].astype("<i8").tobytes()


def unpack_counts(blob: bytes, rows: int, size: int) -> np.ndarray:
    """(rows, size) counts."""
    out = np.frombuffer(blob, np.uint8, rows * size).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=rows * size)
    return out.reshape(rows, size)


_SLICE = (
    "slice bigint, doc_ids array<bigint>, targets array<boolean>, n_words array<bigint>, texts binary,"
    " n_target bigint, n_background bigint"
)


def _grouped(batches, most: int):
    """Batches put together until they hold a slice's text."""
    held, size = [], 0
    for batch in slices(batches, most):
        own = int(text_bytes(batch.column("text"))[1][-1])
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _slices(most: int):
    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in _grouped(batches, most):
            _, doc = _all_hashes(batch)
            words = np.bincount(doc, minlength=batch.num_rows)
            aim = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            data, ends = text_bytes(batch.column("text"))
            blob = np.diff(ends).astype("<i8").tobytes() + data.tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "slice": pa.array([number], pa.int64()),
                    "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "targets": pa.array([aim.tolist()], pa.list_(pa.bool_())),
                    "n_words": pa.array([words.tolist()], pa.list_(pa.int64())),
                    "texts": pa.array([squeeze.compress(blob)], pa.binary()),
                    "n_target": pa.array([int(words[aim].sum())], pa.int64()),
                    "n_background": pa.array([int(words.sum())], pa.int64()),
                }
            )
            number += 1

    return cut


def _texts(blob: bytes, rows: int) -> pa.RecordBatch:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.append(0, np.cumsum(np.frombuffer(raw, "<i8", rows)))
    column = pa.Array.from_buffers(
        pa.large_string(), rows, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(raw[8 * rows :])]
    )
    return pa.RecordBatch.from_arrays([column], names=["text"])


def _each_slice(batches):
    """(slice, doc_ids, targets, hashes, doc, before, pair, other columns) of each stored row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            hashes, doc = _all_hashes(_texts(row["texts"], len(row["doc_ids"])))
            yield row, hashes, doc, *_bigrams(hashes, doc)


def _entries(kind: int, hashes: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The distinct entries of a slice in order; those of kind _WORDS have the start, 0, among them."""
    return np.unique(pair) if kind == _PAIRS else np.union1d(hashes, before)


def _bounds(entries: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's entries begin: buckets are equal ranges of hashes."""
    shift = 64 - (buckets.bit_length() - 1)
    # A shift by all 64 bits is undefined.
    at = (entries >> np.uint64(shift - 1)) >> np.uint64(1)
    return np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))


def _ask(buckets: int):
    """Rows (bucket, slice, hashes, counts), the counts of target and background in the slice."""

    def ask(batches):
        for row, hashes, doc, before, pair in _each_slice(batches):
            aim = np.array(row["targets"], bool)[doc]
            for kind in (_WORDS, _PAIRS):
                entries = _entries(kind, hashes, before, pair)
                counts = []
                for keys in (pair,) if kind == _PAIRS else (hashes, before):
                    at = np.searchsorted(entries, keys)
                    counts += [np.bincount(at[aim], minlength=len(entries)), np.bincount(at, minlength=len(entries))]
                counts = np.stack(counts)
                bounds = _bounds(entries, buckets)
                have = np.flatnonzero(np.diff(bounds))
                spans = [(int(bounds[b]), int(bounds[b + 1])) for b in have]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(2 * have + kind, pa.int64()),
                        "slice": pa.array([row["slice"]] * len(have), pa.int64()),
                        "hashes": pa.array([pack_hashes(entries[a:b]) for a, b in spans], pa.binary()),
                        "counts": pa.array([pack_counts(counts[:, a:b]) for a, b in spans], pa.binary()),
                    }
                )

    return ask


def _answer(asked: pa.Table) -> pa.Table:
    """What the slices sent to one bucket, answered with the counts of all of them.

    ``n_new`` of a bucket's first row is the number of its distinct words.
    """
    bucket = asked.column("bucket")[0].as_py()
    kinds = 2 if bucket % 2 == _PAIRS else 4
    own = [unpack_hashes(x.as_buffer()) for x in asked.column("hashes")]
    bounds = np.append(0, np.cumsum([len(x) for x in own]))
    counts = [
        unpack_counts(x.as_buffer(), kinds, len(h)) for x, h in zip(asked.column("counts"), own, strict=True)
    ]
    entries, at = np.unique(np.concatenate(own), return_inverse=True)
    total = np.zeros((kinds, len(entries)), np.int64)
    for k in range(kinds):
        np.add.at(total[k], at, np.concatenate([c[k] for c in counts]))
    sums = [pack_counts(total[:, at[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    words = int((total[1] > 0).sum()) if bucket % 2 == _WORDS else 0
    return pa.table(
        {
            "slice": asked.column("slice"),
            "bucket": asked.column("bucket"),
            "sums": pa.array(sums, pa.binary()),
            "n_new": pa.array([words] + [0] * (len(own) - 1), pa.int64()),
        }
    )


def _score(buckets: int, vocabulary: int, totals: list[int], prior: float):
    scale = [1.0, totals[0] / totals[1] if totals[1] else 1.0]

    def score(batches):
        for row, hashes, doc, before, pair in _each_slice(batches):
            n = len(row["doc_ids"])
            known = {a["bucket"]: a["sums"] for a in row["answers"] or ()}
            found = []
            for kind in (_WORDS, _PAIRS):
                entries = _entries(kind, hashes, before, pair)
                bounds = _bounds(entries, buckets)
                rows = 2 if kind == _PAIRS else 4
                parts = [
                    unpack_counts(known[2 * int(b) + kind], rows, int(bounds[b + 1] - bounds[b]))
                    for b in np.flatnonzero(np.diff(bounds))
                ]
                found.append((entries, np.hstack(parts) if parts else np.zeros((rows, 0), np.int64)))
            (words, singles), (pairs, both) = found
            at, ahead, two = np.searchsorted(words, hashes), np.searchsorted(words, before), np.searchsorted(pairs, pair)
            mean = []
            for k in (0, 1):
                one = (singles[k][at] * scale[k] + 1.0) / (totals[k] * scale[k] + vocabulary + 1.0)
                p = (both[k][two] * scale[k] + prior * one) / (singles[2 + k][ahead] * scale[k] + prior)
                mean.append(np.bincount(doc, -np.log(p), n) / np.maximum(row["n_words"], 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["n_words"], pa.int64()),
                    *(pa.array(x, pa.float64()) for x in (*mean, mean[0] - mean[1])),
                ],
                names=["doc_id", "n_words", "loss_target", "loss_background", "score"],
            )

    return score


def cross_entropy_difference(
    docs: DataFrame,
    target: DataFrame,
    prior: float = PRIOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """(doc_id, n_words, loss_target, loss_background, score) for every row of ``docs``.

    ``target`` holds the doc_ids of the target texts; the background is all of
    ``docs``. Both bigram models have one vocabulary and one prior; all words and
    bigrams of all texts are in them. The background's counts are scaled to the
    target's size, so that the prior weighs the same in both. Losses are means
    over words, in nats; ``score`` is their difference, below 0 for texts more
    like the target. Texts without words, null or empty, have 0 in all.
    Repeated rows count as often as they occur, repeated target ids once.
    Without target texts the target model is uniform over the vocabulary.
    A text of any length is a row of its slice; other columns are ignored.

    The driver gets three sums. A bucket holds the hashes of about
    ``bucket_words`` words of text, and of a word that is in every slice one
    entry for each. Neither number changes the result.
    """
    docs = keyed_texts(docs, id_col, text_col)
    aims = target.select(F.col(id_col).alias("doc_id")).dropna().distinct().withColumn("target", F.lit(True))
    # The same join at every size: target ids are never few by nature.
    flagged = docs.join(aims.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    parts = stored(flagged.mapInArrow(_slices(slice_bytes), _SLICE), "slices")
    sums = parts.agg(F.sum("n_target"), F.sum("n_background")).first()
    totals = [x or 0 for x in sums]
    buckets = 1 << max(0, (totals[1] // bucket_words).bit_length())
    asked = parts.select("slice", "doc_ids", "targets", "texts").mapInArrow(
        _ask(buckets), "bucket bigint, slice bigint, hashes binary, counts binary"
    )
    answers = stored(
        asked.groupBy("bucket").applyInArrow(_answer, "slice bigint, bucket bigint, sums binary, n_new bigint"), "sums"
    )
    vocabulary = answers.agg(F.sum("n_new")).first()[0] or 0
    told = answers.groupBy("slice").agg(F.collect_list(F.struct("bucket", "sums")).alias("answers"))
    rows = parts.select("slice", "doc_ids", "targets", "n_words", "texts").join(told.hint("merge"), "slice", "left")
    return rows.mapInArrow(
        _score(buckets, vocabulary, totals, float(prior)),
        "doc_id bigint, n_words bigint, loss_target double, loss_background double, score double",
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cross_entropy_difference(documents(spark, sf_dir), labels.where("quality = 1").select("doc_id"))


def brute_force(texts: list[bytes], target: list[bool], prior: float):
    """The same with dictionaries, for tests."""
    from collections import Counter
    from math import log

    split = [t.translate(_WORD_BYTES).split() for t in texts]
    pairs, singles, before = ([Counter(), Counter()] for _ in range(3))
    for t, aim in zip(split, target, strict=True):
        for k in ([0, 1] if aim else [1]):
            pairs[k].update(zip([0, *t[:-1]], t, strict=True) if t else ())
            singles[k].update(t)
            before[k].update([0, *t[:-1]] if t else ())
    known = len(singles[1])
    sums = [sum(s.values()) for s in singles]
    scale = [1.0, sums[0] / sums[1] if sums[1] else 1.0]
    out = []
    for t in split:
        loss = [0.0, 0.0]
        for k in (0, 1):
            for a, b in zip([0, *t[:-1]], t, strict=True) if t else ():
                one = (singles[k][b] * scale[k] + 1) / (sums[k] * scale[k] + known + 1)
                two = pairs[k][a, b] * scale[k]
                loss[k] -= log((two + prior * one) / (before[k][a] * scale[k] + prior))
        n = max(1, len(t))
        out.append((len(t), loss[0] / n, loss[1] / n, loss[0] / n - loss[1] / n))
    return out
