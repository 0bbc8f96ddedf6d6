"""Ranked lexical search: documents grouped by the mask of matched terms, masks taken by falling bound."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from playtally.llm.shared import documents, keyed_texts, slices, stored, text_bytes

TOP = 50
#: Text and number of the items answered in one pass; what a task holds is bounded by them.
BLOCK_BYTES = 1 << 20
BLOCK_ITEMS = 4_000
_SLICE_BYTES = 8_000_000
#: Documents, and entries of their term lists, that are grouped at a time.
_GROUP_DOCS = 8_192
_GROUP_ENTRIES = 2_000_000
#: Documents scored at least before the bound is looked at again.
_STEP = 64
_find_terms = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall


def terms_of(text: bytes) -> list[bytes]:
    return _find_terms(text.lower())


def _postings(held):
    """(doc_id, n, terms, tfs) of documents with terms; listed are those that some item has."""

    def run(batches):
        place = {t: i for i, t in enumerate(held.value)}
        for batch in slices(batches, _SLICE_BYTES):
            data, ends = text_bytes(batch.column("text"))
            raw, ends = data.tobytes(), ends.tolist()
            rows, sizes, ids, tfs, lengths = [], [], [], [], [0]
            for row in range(batch.num_rows):
                words = terms_of(raw[ends[row] : ends[row + 1]])
                if not words:
                    continue
                found = Counter(filter(place.__contains__, words))
                rows.append(row)
                sizes.append(len(words))
                ids.extend(map(place.__getitem__, found))
                tfs.extend(found.values())
                lengths.append(len(ids))
            offsets = pa.array(lengths, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


def _document_counts(size: int):
    """(term, n): documents of a task that hold each term; terms -1 and -2 count documents and their terms."""

    def run(batches):
        held, docs, words = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            docs += batch.num_rows
            words += pc.sum(batch.column("n")).as_py() or 0
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(([-1, -2], some)).astype(np.int32)),
                pa.array(np.concatenate(([docs, words], held[some])).astype(np.int64)),
            ],
            names=["term", "n"],
        )

    return run


def lengths_of(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """50 + (50 * n * docs) div words, for sizes beyond 64 bits too."""
    if 50 * int(n.max(initial=0)) * docs < 1 << 63:
        return 50 + (50 * n * docs) // words
    return np.array([50 + (50 * int(x) * docs) // words for x in n], np.int64)


def _part(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def groups_of(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First column and group number of equal columns of ``masks`` (bytes x documents)."""
    words = np.zeros((-(-len(masks) // 8) * 8, masks.shape[1]), np.uint8)
    words[: len(masks)] = masks
    number = np.zeros(masks.shape[1], np.int64)
    for word in np.ascontiguousarray(words.T).view(np.uint64).T:
        _, inverse = np.unique(word, return_inverse=True)
        # Equal in all words so far, and in this one.
        number = np.unique(number * (int(inverse.max(initial=0)) + 1) + inverse, return_inverse=True)[1]
    _, first = np.unique(number, return_index=True)
    return first, number


class Postings:
    """Term lists of some documents, turned to one list of documents per term."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray, m: np.ndarray, vocabulary: int):
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(m)), np.diff(ends))[order]
        self.tfs = tfs[order].astype(np.int64)
        self.begins = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.m = m

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, tie: np.ndarray):
        """Documents and scores of the ``k`` best, none of them below ``floor`` or 1; ties by ``tie``."""
        spans = [slice(self.begins[t], self.begins[t + 1]) for t in terms]
        sizes = [s.stop - s.start for s in spans]
        if not sum(sizes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, column = np.unique(np.concatenate([self.docs[s] for s in spans]), return_inverse=True)
        tf = np.zeros((len(terms), len(docs)), np.int64)
        tf[np.repeat(np.arange(len(terms)), sizes), column] = np.concatenate([self.tfs[s] for s in spans])
        # A bitmap for each term, turned into a mask for each document.
        first, number = groups_of(np.packbits(tf > 0, axis=0))
        top = weights * _part(tf.max(axis=1), int(self.m[docs].min()))
        bounds = top @ (tf[:, first] > 0)
        masks = np.argsort(-bounds, kind="stable")
        members = np.argsort(number, kind="stable")
        begins = np.searchsorted(number[members], np.arange(len(first) + 1))
        floor, at = max(floor, 1), 0
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while at < len(masks) and bounds[masks[at]] >= floor:
            take, some = [], 0
            # Whole masks, and no mask beyond the bound.
            while at < len(masks) and bounds[masks[at]] >= floor and some < _STEP:
                own = members[begins[masks[at]] : begins[masks[at] + 1]]
                take.append(own)
                some += len(own)
                at += 1
            columns = np.concatenate(take)
            score = weights @ _part(tf[:, columns], self.m[docs[columns]])
            good = score >= floor
            found = np.concatenate((found, docs[columns[good]]))
            scores = np.concatenate((scores, score[good]))
            if len(found) > k:
                keep = np.lexsort((tie[found], -scores))[:k]
                found, scores = found[keep], scores[keep]
            if len(found) == k:
                floor = max(floor, int(scores.min()))
        return found, scores


def _gathered(batches) -> Iterator[pa.Table]:
    """Batches put together, as far as the bounds of a group go; a batch beyond them is cut."""
    parts, rows, entries = [], 0, 0
    for batch in batches:
        ends = batch.column("terms").offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + _GROUP_ENTRIES - entries, "right")) - 1
            stop = min(max(stop, at + (not parts)), at + _GROUP_DOCS - rows, batch.num_rows)
            if stop > at:
                parts.append(batch.slice(at, stop - at))
                rows, entries = rows + stop - at, entries + int(ends[stop] - ends[at])
                at = stop
            if at < batch.num_rows:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts, rows, entries = [], 0, 0
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _ranked(held):
    """(item, doc_id, score): the best of a task's documents for every item."""

    def run(batches):
        items, vocabulary, docs, words, k = held.value
        best: list[list[tuple]] = [[] for _ in items]
        ids_type = None
        for rows in _gathered(batches):
            ids = rows.column("doc_id").combine_chunks()
            ids_type = ids.type
            tie = np.empty(len(ids), np.int64)
            tie[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            lists = [rows.column(c).combine_chunks() for c in ("terms", "tfs")]
            terms, tfs = (x.flatten().to_numpy() for x in lists)
            ends = lists[0].offsets.to_numpy()
            found = Postings(terms, tfs, ends - ends[0], lengths_of(rows.column("n").to_numpy(), docs, words), vocabulary)
            for item, (own, weights) in enumerate(items):
                held_best = best[item]
                floor = -held_best[-1][0] if len(held_best) == k else 0
                at, scores = found.best(own, weights, k, floor, tie)
                if len(at):
                    new = zip(scores.tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)
                    held_best += [(-s, i is None, i) for s, i in new]
                    held_best.sort(key=lambda x: x[:2] if x[1] else x)
                    del held_best[k:]
        if ids_type is None:
            return
        for begin in range(0, len(items), 200):
            part = [(i, b) for i in range(begin, min(begin + 200, len(items))) for b in best[i]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in part], pa.int32()),
                    pa.array([b[2] for _, b in part], ids_type),
                    pa.array([-b[0] for _, b in part], pa.int64()),
                ],
                names=["item", "doc_id", "score"],
            )

    return run


def _blocks(items: DataFrame, block_bytes: int, block_items: int) -> Iterator[list]:
    """The distinct items with text, block by block; a block is bounded by its bytes and rows, whatever the table."""
    some = items.where("octet_length(text) > 0").distinct()
    sizes = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    blocks = 1 + max(sizes.b // block_bytes, sizes.n // block_items)
    for block in range(blocks):
        own = some.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if own:
            yield own


def _answers(docs: DataFrame, own: list, id_field: StructField, k: int) -> DataFrame:
    """The rows of one block of items."""
    spark = docs.sparkSession
    wanted = [sorted(set(terms_of(r.text.encode()))) for r in own]
    vocabulary = sorted({t for w in wanted for t in w})
    place = {t: i for i, t in enumerate(vocabulary)}
    held = spark.sparkContext.broadcast(vocabulary)
    doc_id = docs.schema["doc_id"]
    schema = StructType([doc_id, *StructType.fromDDL("n bigint, terms array<int>, tfs array<int>").fields])
    postings = stored(docs.mapInArrow(_postings(held), schema), "postings")
    counts = postings.select("n", "terms").mapInArrow(_document_counts(len(vocabulary)), "term int, n bigint")
    # At most a row a term of the block, and two.
    counts = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_words = counts.pop(-1, 0), counts.pop(-2, 0)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in counts.items()}
    queries = []
    for terms in wanted:
        # A term that no document has, or of weight 0, adds nothing.
        places = [p for p in map(place.__getitem__, terms) if weight.get(p, 0) > 0]
        queries.append((np.array(places, np.int64), np.array([weight[p] for p in places], np.int64)))
    held = spark.sparkContext.broadcast((queries, len(vocabulary), n_docs, n_words, k))
    schema = StructType([*StructType.fromDDL("item int").fields, doc_id, StructField("score", LongType())])
    found = postings.mapInArrow(_ranked(held), schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = StructType([*StructType.fromDDL("item int").fields, id_field])
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], names)
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of highest score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z
    lowered. N documents have a term, L terms are in all of them, df documents
    hold the term; its weight is floor(1000 * ln((2N + 2) / (2df + 1))). A document
    of n terms has m = 50 + (50 * n * N) div L and the score
    sum(weight * ((10^9 * tf) div (1000 * tf + 20 * m))) over the item's distinct terms.
    Equal scores go by ``doc_id``, nulls last.

    Null and empty texts have no terms: such documents count nowhere, such items
    get no rows. Repeated documents are ranked one by one, repeated items once;
    an id with several texts is answered for each. Other columns are ignored.

    Each task groups its documents by the mask of an item's terms they hold. The
    bound of a mask is what a document with the highest counts and the least m in
    the group would score; masks are scored in falling order until the bound of the
    next is below the k-th best. Only each task's best rows are shuffled. The items
    are answered in blocks of bounded size, one pass over ``docs`` for each.
    """
    rows = keyed_texts(docs, id_col, text_col)
    table = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    answers = None
    for own in _blocks(table, block_bytes, block_items):
        found = _answers(rows, own, table.schema["item_id"], k)
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        fields = [table.schema["item_id"], *StructType.fromDDL("rank int").fields, rows.schema["doc_id"]]
        return rows.sparkSession.createDataFrame([], StructType([*fields, StructField("score", LongType())]))
    return answers


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _terms_sql(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_terms_sql("text")} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT rid, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM sized),
items AS (
  SELECT row_number() OVER () AS iid, item_id, {_terms_sql("text")} AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE text IS NOT NULL),
wanted AS (SELECT DISTINCT iid, item_id, unnest(terms) AS term FROM items),
tf AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, whole),
scores AS (
  SELECT iid, item_id, doc_id, rid,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (rid), whole
  GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}
"""


def brute_force(docs: list[tuple], items: list[tuple], k: int = TOP) -> list[tuple]:
    """The same by scoring every document, for tests."""
    docs = [(i, Counter(terms_of((t or "").encode()))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_words = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c in docs:
            m = 50 + (50 * c.total() * n_docs) // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms_of((text or "").encode())) & set(c)
            )
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return out
