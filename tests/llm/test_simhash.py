"""SimHash prints and components against plain loops."""

from __future__ import annotations

import random

import pytest
import xxhash

from playtally.llm import simhash
from playtally.llm.components import components
from playtally.llm.shared import documents
from tests.llm.cases import EDGE, clashing, ordered, table


def plain_print(text: str | None) -> int:
    words = [w for w in _lower(text or "").split("\0") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _lower(text: str) -> str:
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join("\0" if c == " " or "\x09" <= c <= "\x0d" else c for c in out)


def plain_groups(prints, ids, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if ((a ^ prints[j]) & (2**64 - 1)).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rnd = random.Random(radius)
    for _ in range(2000):
        bits = rnd.sample(range(64), radius)
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_prints_and_edges(spark):
    docs = [*EDGE, (1, "A b c D e"), (2, "a b c d e"), (3, "ÉA b"), (3, "ÉA b")]
    found = simhash.near_duplicates(clashing(table(spark, docs))).collect()
    want = [plain_print(t) for _, t in docs]
    groups = plain_groups(want, [d for d, _ in docs], 4)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    assert ordered((r.doc_id, r.print, r.component_id) for r in found) == ordered(
        (d, signed(p), g) for (d, _), p, g in zip(docs, want, groups, strict=True)
    )


@pytest.mark.parametrize("bucket_rows", [4096, 6])
def test_query_against_all_pairs(spark, sf_dir, bucket_rows):
    found = simhash.near_duplicates(documents(spark, sf_dir), bucket_rows=bucket_rows).collect()
    assert [r.component_id for r in found] == plain_groups([r.print for r in found], [r.doc_id for r in found], 4)
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    for row in simhash.op5_simhash(spark, sf_dir).collect():
        assert int(row.fingerprint, 16) == plain_print(texts[row.doc_id])


@pytest.mark.parametrize("bucket_rows", [4096, 10])
def test_chains_of_near_prints(spark, bucket_rows):
    rnd = random.Random(9)
    values, at = set(), rnd.getrandbits(64)
    for _ in range(700):
        near = at
        for _ in range(rnd.randint(1, 5)):
            near ^= 1 << rnd.randrange(64)
        values.add(near - 2**64 if near >= 2**63 else near)
        at = near if rnd.random() < 0.3 else rnd.getrandbits(64) if rnd.random() < 0.03 else at
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "print bigint")
    found = {r.node: r.root for r in components(simhash.near_links(frame, 4, bucket_rows)).collect()}
    assert [found.get(v, v) for v in values] == plain_groups(values, values, 4)


def test_first_of_each(spark):
    docs = clashing(table(spark, [(5, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (9, "other words here now"), (None, None)]))
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert ordered((r.doc_id, r.text) for r in kept.collect()) == ordered(
        [(2, "A b c d e f"), (9, "other words here now"), (None, None)]
    )


def test_empty_table(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
