"""Document fingerprints by a randomised edit embedding (4).

A text is walked through with shared random steps: at each step the current
character is written down, and a random bit that belongs to the step and the
character says whether to go on to the next one. Walks over texts that differ
by an edit meet again soon, so the edit distance shows as Hamming distance. A
fingerprint samples what was written; texts of similar length sample the same
steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playtally.llm.components import components
from playtally.llm.shared import documents, keyed_texts, slices, stored

#: Random bits of a step and a character come again after so many steps. Characters
#: are told apart by one byte of their hash.
PERIOD, MARKS = 4096, 256
#: Characters of a text walked through at a time.
CHUNK = 1 << 20
#: Sampled steps, one byte each, and the bytes of a band.
SLOTS, BAND = 128, 8
SEED = 42
_FAR = 1 << 44


def _records(slot: int) -> np.ndarray:
    """Steps at which a slot's smallest random number so far is drawn.

    The first n steps have their smallest number at the last record below n,
    so texts of nearly equal length mostly agree on the step.
    """
    draw = np.random.Generator(np.random.PCG64([SEED, slot]))
    at, least, out = 0, draw.random(), [0]
    while at < _FAR:
        at += int(draw.geometric(max(least, 1e-15)))
        least *= draw.random()
        out.append(at)
    return np.array(out, np.int64)


class Embedding:
    """Fingerprints of texts, each by one walk from its first to its last character.

    At a step the walk stays or goes on by the random bit of the step and the
    character's mark. How long it stays on a character is thus known from the
    step (modulo ``PERIOD``) at which it comes there, and a walk is a finite
    automaton that reads marks: ``start`` is its first state, a state is the list
    of the states that follow, by mark, and its own number at the end.
    """

    def __init__(self) -> None:
        draw = np.random.Generator(np.random.PCG64(SEED))
        go = draw.integers(0, 2, (PERIOD, MARKS), np.uint8).astype(bool)
        go[-1] = True
        follows = np.empty((PERIOD, MARKS), np.int64)
        after = np.zeros(MARKS, np.int64)
        for t in range(PERIOD - 1, -1, -1):
            after = np.where(go[t], (t + 1) % PERIOD, after)
            follows[t] = after
        states: list[list] = [[] for _ in range(PERIOD)]
        for number, row in enumerate(follows.tolist()):
            states[number].extend([states[i] for i in row])
            states[number].append(number)
        self.states = states
        records = [_records(k) for k in range(SLOTS)]
        self.records = np.full((SLOTS, max(map(len, records))), np.iinfo(np.int64).max)
        for row, record in zip(self.records, records, strict=True):
            row[: len(record)] = record

    def sampled(self, n: int) -> np.ndarray:
        """The step of each slot, for a text of ``n`` characters, which take two steps on average."""
        last = (self.records < 2 * n).sum(axis=1) - 1
        return self.records[np.arange(SLOTS), last]

    def arrivals(self, marks: np.ndarray, step: int) -> np.ndarray:
        """Steps at which the walk comes to each character and, last, behind them; the first is ``step``."""
        walk = accumulate(marks.tobytes(), getitem, initial=self.states[step % PERIOD])
        numbers = np.fromiter(map(itemgetter(MARKS), walk), np.int64, len(marks) + 1)
        # No stay is longer than PERIOD; one of that length ends in the state it began in.
        stays = (np.diff(numbers) - 1) % PERIOD + 1
        return step + np.append(0, np.cumsum(stays))

    def print(self, chars: np.ndarray) -> np.ndarray:
        """SLOTS bytes: the marks written at the sampled steps, 0 beyond the end of the walk."""
        out = np.zeros(SLOTS, np.uint8)
        if not len(chars):
            return out
        steps = self.sampled(len(chars))
        step = 0
        for begin in range(0, len(chars), CHUNK):
            marks = (chars[begin : begin + CHUNK] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            came = self.arrivals(marks, step)
            own = np.flatnonzero((steps >= step) & (steps < came[-1]))
            out[own] = marks[np.searchsorted(came, steps[own], "right") - 1]
            step = int(came[-1])
        return out

    def prints(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, SLOTS) bytes; a text without characters has zeros."""
        out = np.zeros((len(texts), SLOTS), np.uint8)
        for row, text in zip(out, texts, strict=True):
            row[:] = self.print(text)
        return out


@cache
def embedding() -> Embedding:
    """The one of this worker."""
    return Embedding()


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def edited(own: np.ndarray, after: np.ndarray) -> np.ndarray:
    """``own`` with its last half replaced by the beginning of ``after``."""
    half = len(own) // 2
    return np.concatenate([own[: len(own) - half], after[:half]])


def _utf8(chars: np.ndarray) -> bytes:
    return chars.tobytes().decode("utf-32-le").encode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, by row."""
    return (a == b).mean(axis=1)


_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _judge(walks: Embedding | _Nothing, ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
    """Results of all texts but the last, each with the one after it."""
    own = walks.prints(texts)
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    other = walks.prints(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(_utf8(t)).hexdigest() for t in changed], pa.string()),
            pa.array([x.tobytes().hex() for x in own[:-1]], pa.string()),
            pa.array([x.tobytes().hex() for x in other], pa.string()),
            pa.array(likeness(own[:-1], other)),
            pa.array(likeness(own[:-1], own[1:])),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _with_edge(batch: pa.RecordBatch, edge: int | None, text: list, order: list) -> pa.RecordBatch:
    n = batch.num_rows
    return (
        batch.append_column("edge", pa.array([edge] * n, pa.int32()))
        .append_column("text", pa.array(text, pa.string()))
        .append_column("tie", pa.array(order, pa.int64()))
    )


def _bare(doc_id, edge: int, text: str, tie: int) -> pa.RecordBatch:
    row = _judge(_Nothing(), [doc_id], [np.empty(0, np.uint32)] * 2)
    return _with_edge(row, edge, [text], [tie])


class _Nothing:
    def prints(self, texts):
        return np.zeros((len(texts), SLOTS), np.uint8)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each judged with the next; a partition's first and last row go on as edges."""
    held = None
    for batch in slices(batches, 1_500_000):
        ids, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if held is None:
            yield _bare(ids[0], 0, texts[0], ties[0])
        else:
            ids, texts, ties = [held[0], *ids], [held[1], *texts], [held[2], *ties]
        held = ids[-1], texts[-1], ties[-1]
        if len(ids) > 1:
            n = len(ids) - 1
            yield _with_edge(_judge(embedding(), ids[:-1], [points(t) for t in texts]), None, [None] * n, [None] * n)
    if held is not None:
        yield _bare(held[0], 1, held[1], held[2])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, own, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True):
            yield _judge(embedding(), [doc_id], [points(own), points(after)])


def edit_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness.

    One row per row of ``docs``: (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next). The edited form has the last
    half of the code points replaced by the first as many of the next row, in
    order of doc_id (nulls first) and of a hash of the text among equal ids;
    the first row follows the last. ``near_*`` is the share of sampled
    steps on which two fingerprints agree. A null text counts as empty; empty
    texts have a fingerprint of zeros, two of them are alike.

    Rows are range-partitioned and streamed in order, a slice of texts held. A text is
    walked through unbroken, however long, a chunk at a time. Only the first and last row of each partition meet in a second, small step.
    """
    docs = keyed_texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    found = stored(ordered.mapInArrow(_walk, f"{_RESULT}, edge int, text string, tie bigint"), "prints")
    # Two rows for each partition.
    line = W.orderBy("doc_id", "tie", "edge")
    edges = found.where("edge is not null").select("doc_id", "tie", "edge", "text")
    ends = edges.select(
        "doc_id",
        "text",
        "edge",
        F.coalesce(F.lead("text").over(line), F.first("text").over(line)).alias("after"),
    ).where("edge = 1")
    done = found.where("edge is null").drop("edge", "text", "tie")
    return done.unionByName(ends.mapInArrow(_pairs, _RESULT))


def near_prints(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(fingerprint, root) of distinct fingerprints, alike ones under one root.

    Fingerprints that agree on all slots of some band are compared, and linked
    if ``least`` of all slots are equal. A band's bucket is read as a sorted
    stream; see ``_links``. ``root`` is a number, the same for a whole
    component; a fingerprint without a link has its own.
    """
    distinct = prints.select("fingerprint").distinct().withColumn("node", F.xxhash64("fingerprint"))
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1)),
        lambda i: F.xxhash64(i, F.substring("fingerprint", i * (2 * BAND) + 1, F.lit(2 * BAND))),
    )
    rows = distinct.select("fingerprint", "node", F.explode(bands).alias("key"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "fingerprint")
    roots = components(ordered.mapInArrow(_links(least), "a bigint, b bigint"))
    return distinct.join(roots, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("root"))


def _links(least: float, chunk: int = 4096):
    """Links within each bucket: every row is compared with one row for each component found so far,
    and with the others of the bucket only if none of those is alike."""

    def bucket(nodes: np.ndarray, prints: np.ndarray):
        left = np.arange(len(nodes))
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                row = front.pop()
                near = (prints[left] == prints[row]).mean(axis=1) >= least
                if near.any():
                    reached, left = left[near], left[~near]
                    front.extend(reached.tolist())
                    yield nodes[reached], np.full(len(reached), nodes[row])

    def link(batches):
        keys: list[int] = []
        nodes: list[int] = []
        prints: list[bytes] = []

        def out():
            if len(keys) > 1:
                table = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
                for a, b in bucket(np.array(nodes), table):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            keys.clear(), nodes.clear(), prints.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "node", "fingerprint"))
            for key, node, text in zip(*columns, strict=True):
                if keys and keys[0] != key:
                    yield from out()
                keys.append(key)
                nodes.append(node)
                prints.append(bytes.fromhex(text))
        yield from out()

    return link


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints(documents(spark, sf_dir))
