"""SimHash fingerprints and their near-duplicates by covering locality-sensitive hashing (5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.llm.components import components
from playtally.llm.repeats import referenced
from playtally.llm.shared import documents, keyed_texts, mix, packed, slices, stored, text_bytes, unpacked

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Rows of a table's bucket above which it is dealt again by a second table.
BUCKET_ROWS = 4096
#: Groups up to this size are compared row by row in numpy shifts.
_SMALL = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(line[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last, strict=True)], np.uint64, len(last)
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def wide_print(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Majority bits of distinct shingle hashes: 64 for each of ``salts``, as 64-bit words.

    Where as many shingles have a bit as have it not, one shingle of them decides, the
    one with the smallest word: short texts have as many bits on as long ones. Not for no shingles.
    """
    ones = np.zeros(64 * len(salts), np.int64)
    least = np.full(len(salts), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 255):
        part = mix(hashes[at : at + 255, None] ^ salts)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        least = np.minimum(least, part.min(axis=0))
    ties = np.unpackbits(mix(least).view(np.uint8), bitorder="little")
    return np.packbits(2 * ones + ties > len(hashes), bitorder="little").view(np.uint64)


def _fingerprints(shingle: int):
    def compute(batches):
        for batch in slices(batches, 4_000_000):
            data, ends = text_bytes(batch.column("text"))
            raw, ends = data.tobytes(), ends.tolist()
            found = [fingerprint(raw[a:b], shingle) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            prints = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ref"), pa.array(prints)], names=["doc_id", "ref", "print"]
            )

    return compute


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ref, print) for every row; a null text has no words, ``ref`` is a hash of id and text."""
    docs = referenced(keyed_texts(docs, id_col, text_col))
    return docs.mapInArrow(_fingerprints(shingle), "doc_id bigint, ref bigint, print bigint")


def covering_masks(radius: int, seed: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; any ``radius`` bits are all off in one of them.

    Bit i has a vector of radius + 1 bits, and mask v is on where its inner
    product with v is odd. The vectors of ``radius`` bits span at most
    ``radius`` dimensions, so some v is orthogonal to all of them. Vectors are
    dealt evenly, so that every mask keeps about half of the bits.
    """
    dims = radius + 1
    vectors = np.resize(np.random.default_rng(seed).permutation(np.arange(1, 1 << dims)), 64)
    np.random.default_rng(seed + 1).shuffle(vectors)
    return [sum(1 << i for i, x in enumerate(vectors) if (v & int(x)).bit_count() % 2) for v in range(1, 1 << dims)]


def _tables(masks: np.ndarray):
    """One row for each table a fingerprint goes to: (key, print, mask)."""

    def spread(batches):
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            if "mask" in batch.schema.names:  # dealt again: what the first table kept, and more
                first = batch.column("mask").to_numpy().view(np.uint64)
                number = np.uint64(1 + len(masks))
            else:
                first, number = np.zeros(len(prints), np.uint64), np.uint64(0)
            for i, mask in enumerate(masks):
                both = first | mask
                key = mix((prints & both) ^ mix(first + np.uint64(i) + number))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (key, prints, both)], names=["key", "print", "mask"]
                )

    return spread


def _spanning(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A link to each row that is reached, by breadth first search over one bucket.

    A row is compared with rows not reached yet only, so a dense bucket costs a
    few passes, and no more links than rows are given.
    """
    left = np.arange(len(prints))
    a, b = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            row = front.pop()
            near = np.bitwise_count(prints[left] ^ prints[row]) <= radius
            if near.any():
                reached, left = left[near], left[~near]
                front.extend(reached.tolist())
                a.append(reached)
                b.append(np.full(len(reached), row))
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _links(radius: int):
    def bucket_links(keys, prints):
        n = len(keys)
        bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(bounds, n))
        size = np.repeat(sizes, sizes)
        small = size <= _SMALL
        for shift in range(1, min(_SMALL, n)):
            at = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:])
            if not len(at):
                break
            near = at[np.bitwise_count(prints[at] ^ prints[at + shift]) <= radius]
            if len(near):
                yield prints[near], prints[near + shift]
        for begin, count in zip(bounds[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
            own = np.unique(prints[begin : begin + count])
            a, b = _spanning(own, radius)
            if len(a):
                yield own[a], own[b]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys, prints):
            for a, b in bucket_links(keys, prints):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            prints = batch.column("print").to_numpy().view(np.uint64)
            if held and held[0][0][0] != keys[-1]:
                keys = np.concatenate([x[0] for x in held] + [keys])
                prints = np.concatenate([x[1] for x in held] + [prints])
                held = []
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if cut:
                yield from out(keys[:cut], prints[:cut])
            held.append((keys[cut:], prints[cut:]))
        if held:
            yield from out(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

    return link


_TABLE = "key bigint, print bigint, mask bigint"


def near_links(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct ``print`` values that connect all pairs within ``radius`` bits.

    Every such pair is in one bucket of some covering table. Buckets of more
    than ``bucket_rows`` are dealt again by a second covering, whose buckets
    share three quarters of the bits and so hold no more than some 2^16 values.
    """
    first = prints.mapInArrow(_tables(np.array(covering_masks(radius), np.uint64)), _TABLE)
    large = first.groupBy("key").count().where(F.col("count") > bucket_rows).select("key")
    large = stored(large, "large-buckets")
    if large.isEmpty():
        dealt = first
    else:
        again = np.array(covering_masks(radius, seed=7), np.uint64)
        dealt = first.join(large, "key", "left_anti").unionByName(
            first.join(large, "key").mapInArrow(_tables(again), _TABLE)
        )
    ordered = dealt.select("key", "print").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_links(radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(doc_id, print, component_id, ref, root) for every row of ``docs``.

    Texts are compared by 64-bit SimHash over shingles of lower-case words;
    prints within ``radius`` bits are linked, and ``component_id`` is the
    smallest doc_id reachable over links; ``root`` is the same print for all of
    a component. A text without words, null or empty,
    has print 0 and is linked like any other. Rows with a null doc_id take part
    and have the smallest id of the others, or null. Repeated rows stay.
    """
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "prints")
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("low"))
    classes = stored(classes, "classes")
    roots = components(near_links(classes.select("print"), radius, bucket_rows))
    rooted = classes.join(roots, classes["print"] == roots["node"], "left").select(
        "print", "low", F.coalesce("root", "print").alias("root")
    )
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(low, "root").select("print", "component_id", "root")
    return rows.join(named, "print").select("doc_id", "print", "component_id", "ref", "root")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the smallest doc_id of each group of near-duplicates, unchanged.

    Null ids come last. Of rows with that id, the text with the smallest hash
    stays, once.
    """
    return keep_first(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``first_of_each`` keeps of the groups ``found``."""
    found = stored(found, "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ref")).alias("first")
    kept = found.groupBy("root").agg(first).select(F.col("first.ref").alias("ref")).distinct()
    rows = referenced(packed(docs, id_col, text_col)).select("ref", "row", "text")
    # Equal rows have one ref.
    return rows.join(kept, "ref", "left_semi").dropDuplicates(["ref"]).transform(unpacked, docs.columns, text_col)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
