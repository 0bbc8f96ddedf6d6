"""Ranked search against scoring every document."""

from __future__ import annotations

import random

import numpy as np
import pytest

from playtally.llm import mask_search
from playtally.llm.shared import documents
from tests.llm.cases import EDGE, clashing, ordered, table


def items_table(spark, items, kind="bigint"):
    return clashing(spark.createDataFrame(items, f"item_id {kind}, text string"))


def cases(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Ünï", "tür", "A1b"]
    text = lambda n: " ".join(rnd.choice(words[: rnd.randint(1, len(words))]) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 3, 20, 200]))) for i in range(300)]
    # A third of all rows are copies of one text; one row stands there three times.
    docs += [(1000 + i, "w1 w2, w3") for i in range(150)] + [(7, "w5-W5.w6")] * 3 + [*EDGE, (None, "w1 w7"), (None, "w1 w7")]
    # Items of more than 64 distinct terms take masks of several words.
    items = [(i, text(rnd.choice([1, 5, 40, 300]))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "zzz none"), (None, "w1 w2"), (93, "w1 w2 w3"), (93, "w1 w2 w3"), (93, "W5")]
    return docs, items


@pytest.mark.parametrize("seed, k, small", [(1, 50, False), (2, 3, True), (3, 1, False), (4, 1000, True)])
def test_search(spark, monkeypatch, seed, k, small):
    docs, items = cases(seed)
    if small:
        for name, value in (("_GROUP_DOCS", 37), ("_GROUP_ENTRIES", 200), ("_STEP", 1), ("_SLICE_BYTES", 2000)):
            monkeypatch.setattr(mask_search, name, value)
    found = mask_search.search(clashing(table(spark, docs)).repartition(3), items_table(spark, items), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(map(tuple, found.collect())) == ordered(mask_search.brute_force(docs, items, k))


def test_blocks_of_items(spark):
    docs, items = cases(9)
    found = mask_search.search(table(spark, docs), items_table(spark, items), 10, block_items=8)
    assert ordered(map(tuple, found.collect())) == ordered(mask_search.brute_force(docs, items, 10))


def test_text_ids(spark):
    docs, items = cases(5)
    docs = [(None if i is None else f"d{i}é", t) for i, t in docs]
    items = [(None if i is None else f"q{i}", t) for i, t in items]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    found = mask_search.search(frame, items_table(spark, items, "string"), 20)
    want = mask_search.brute_force([(i or "", t) for i, t in docs if i], items, 20)
    without = mask_search.search(frame.dropna(subset=["doc_id"]), items_table(spark, items, "string"), 20)
    assert ordered(map(tuple, without.collect())) == ordered(want)
    assert {r.score for r in found.collect()} and found.count() >= len(want)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = mask_search.op12_search(spark, sf_dir)
    assert [t for _, t in found.dtypes][1:] == ["int", "bigint", "bigint"]
    assert ordered(map(tuple, found.collect())) == ordered(mask_search.brute_force(docs, items))


def test_empty_tables(spark):
    some, items = table(spark, [(1, "a b"), (2, "c")]), items_table(spark, [(1, "a")])
    assert mask_search.search(table(spark, []), items).collect() == []
    assert mask_search.search(some, items.limit(0)).collect() == []
    assert mask_search.search(table(spark, [(1, None)]), items).collect() == []
    assert len(mask_search.search(some, items).collect()) == 1


def test_masks_are_skipped(monkeypatch):
    """Documents of masks below the best scores are not scored."""
    rare, common = 200, 5000
    terms = np.concatenate([np.zeros(rare, np.int32), np.ones(rare + common, np.int32)])
    docs = np.concatenate([np.arange(rare), np.arange(rare + common)])
    order = np.argsort(docs, kind="stable")
    ends = np.searchsorted(docs[order], np.arange(rare + common + 1))
    held = mask_search.Postings(terms[order], np.ones(len(terms), np.int32), ends, np.full(rare + common, 100), 2)
    scored = []
    plain = mask_search._part
    monkeypatch.setattr(mask_search, "_part", lambda tf, m: scored.append(tf.shape) or plain(tf, m))
    at, scores = held.best(np.array([0, 1]), np.array([5000, 10]), 50, 0, np.arange(rare + common))
    assert at.tolist() == list(range(50)) and len(set(scores.tolist())) == 1
    assert max(s[1] for s in scored[1:]) == rare and len(scored) == 2


def test_groups():
    rnd = np.random.default_rng(2)
    for rows in (1, 8, 30):
        masks = rnd.integers(0, 2, (rows, 500)).astype(np.uint8)
        first, number = mask_search.groups_of(masks)
        assert (masks[:, first][:, number] == masks).all() and len(first) == len({bytes(m) for m in masks.T})


def test_sizes_beyond_64_bits():
    n, docs, words = np.array([10**7, 3]), 5 * 10**10, 10**13
    want = [50 + (50 * int(x) * docs) // words for x in n]
    assert mask_search.lengths_of(n, docs, words).tolist() == want
