"""Shards against a draw-by-draw walk down the tree, and what moves when the tree changes."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playtally.llm import hash_tree as tree
from playtally.llm.shared import documents
from tests.llm.cases import EDGE, clashing, ordered, table

UNEVEN = (
    tree.Leaf(0, "north", "a", 1),
    tree.Leaf(1, "north", "a", 3),
    tree.Leaf(2, "north", "b", 2),
    tree.Leaf(3, "south", "a", 4),
    tree.Leaf(4, "south", "c", 0),
    tree.Leaf(5, "south", "c", 2),
)


def shards(frame, leaves):
    return {r.id: r.s for r in frame.select("id", tree.shard_of(F.col("id"), leaves).alias("s")).collect()}


def gapless(rows):
    slots: dict[int, list[int]] = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    return all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in documents(spark, sf_dir).collect()}
    rows = tree.op13_shards(spark, sf_dir).collect()
    assert ordered(r.doc_id for r in rows) == ordered(docs) and gapless(rows)
    before, after = tree.even_tree(24), tree.even_tree(25)
    for r in rows:
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key")
        assert (r.shard, r.grown_shard) == (tree.brute_shard(r.doc_id, before), tree.brute_shard(r.doc_id, after))
        assert r.grown_shard in (r.shard, 24)


@pytest.mark.parametrize("shards_before", [5, 24, 25, 40])
def test_one_more_takes_rows_only_into_itself(spark, shards_before):
    frame = spark.range(6000)
    before = shards(frame, tree.even_tree(shards_before, base=5))
    after = shards(frame, tree.even_tree(shards_before + 1, base=5))
    moved = Counter(after[k] for k in before if before[k] != after[k])
    assert set(moved) == {shards_before}
    assert abs(moved[shards_before] - 6000 / (shards_before + 1)) < 5 * (6000 / shards_before) ** 0.5


def test_weights(spark):
    found = shards(spark.range(20_000), UNEVEN)
    assert all(found[i] == tree.brute_shard(i, UNEVEN) for i in range(0, 20_000, 97))
    counts = Counter(found.values())
    assert set(counts) == {0, 1, 2, 3, 5}
    for leaf in UNEVEN:
        assert abs(counts[leaf.shard] - 20_000 * leaf.weight / 12) < 300


def test_changes_stay_in_the_subtree(spark):
    frame = spark.range(5000)
    before = shards(frame, UNEVEN)
    # Weight moves between two shards of one rack: no row leaves the rack.
    inside = (tree.Leaf(0, "north", "a", 3), tree.Leaf(1, "north", "a", 1), *UNEVEN[2:])
    after = shards(frame, inside)
    assert {(before[k], after[k]) for k in before if before[k] != after[k]} <= {(1, 0)}
    # A rack gains weight: rows only enter its region, and leave none of the other racks but for it.
    heavier = (*UNEVEN[:5], tree.Leaf(5, "south", "c", 6))
    after = shards(frame, heavier)
    changes = {(before[k], after[k]) for k in before if before[k] != after[k]}
    assert changes <= {(0, 3), (1, 3), (2, 3), (0, 5), (1, 5), (2, 5), (3, 5)} and (3, 5) in changes


def test_edge_rows(spark):
    rows = [*EDGE, (7, "é"), *[(9, "same")] * 500, *[(None, "n")] * 40]
    frame = clashing(table(spark, rows)).repartition(7)
    found = tree.place(frame, tree.even_tree(4), None).collect()
    assert gapless(found) and all(r.grown_shard is None for r in found)
    got = ordered((r.doc_id, r.size, r.text_crc32, r.shard) for r in found)
    assert got == ordered(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), tree.brute_shard(i, tree.even_tree(4)))
        for i, t in rows
    )
    # One id fills a shard; its rows are numbered by several parts.
    assert tree.place(table(spark, []), tree.even_tree(4)).collect() == []


def test_order_of_slots(spark):
    rows = [(i % 50, f"t{i}") for i in range(200)]
    one = tree.place(table(spark, rows), tree.even_tree(3)).collect()
    two = tree.place(table(spark, rows[::-1]).repartition(5), tree.even_tree(3)).collect()
    assert ordered(one) == ordered(two)
    for shard in range(3):
        own = sorted((r for r in one if r.shard == shard), key=lambda r: r.slot)
        assert [(r.doc_id, r.text_crc32) for r in own] == sorted((r.doc_id, r.text_crc32) for r in own)


def test_written_shards(spark, tmp_path):
    rows = [(i, "x" * 100) for i in range(60)] + [*EDGE, (1, "x" * 100)]
    path = str(tmp_path / "out")
    tree.write_shards(table(spark, rows), tree.even_tree(3), path, file_bytes=500)
    back = spark.read.parquet(path).collect()
    assert ordered((r.doc_id, r.text) for r in back) == ordered(rows)
    assert all(r.shard == tree.brute_shard(r.doc_id, tree.even_tree(3)) for r in back)
    with pytest.raises(ValueError):
        tree.write_shards(table(spark, rows, "shard int", 1), tree.even_tree(3), path)


def test_trees_that_make_no_sense():
    for leaves in ((), (tree.Leaf(0, "a", "b", 0),), (tree.Leaf(0, "a", "b"), tree.Leaf(0, "a", "c")), (tree.Leaf(0, "a", "b", -1),)):
        with pytest.raises(ValueError):
            tree.children(leaves)
