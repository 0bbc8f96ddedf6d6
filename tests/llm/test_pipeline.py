"""The stages, one after the other, each against a plain version of its decision."""

from __future__ import annotations

import pytest

import corpus_pipeline
from playtally.llm import decontaminate, near_copies, suffix_dedup, toxicity
from playtally.llm.shared import documents, stored


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out, docs = {}, documents(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "test")
        out[name] = before.collect(), docs.collect(), docs.columns
    return out


def test_columns(stages):
    names = list(stages)
    assert len(names) == 5
    for name in names[:-1]:
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(spark, sf_dir, stages):
    before, after, _ = stages["toxicity"]
    found = toxicity.op1_toxicity(spark, sf_dir).where("predicted = 0").collect()
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in found)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_near_copies(stages):
    before, after, _ = stages["simhash near-dedup"]
    first: dict[int, int] = {}
    for row, group in zip(before, near_copies.brute_force([r.text for r in before]), strict=True):
        first[group] = min(row.doc_id, first.get(group, row.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_repeats(stages):
    before, after, _ = stages["suffix dedup"]
    texts = [r.text.encode() for r in before]
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    want = {}
    for row, t in zip(before, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want[row.doc_id] = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    assert [w[0] for w in suffix_dedup.brute_force(texts[:3])] == [len(t) for t in texts[:3]]


def test_benchmark(spark, sf_dir, stages):
    before, after, _ = stages["benchmark decontamination"]
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = decontaminate.brute_force([r.text.encode() for r in before], items)
    clean = {r.doc_id: r.text for r, h in zip(before, hit, strict=True) if not h[4]}
    kept = {r.doc_id: r.text for r in after}
    assert all(kept[d] == t for d, t in clean.items())
    assert not any(h[4] for h in decontaminate.brute_force([t.encode() for t in kept.values()], items))
    covered = {r.doc_id for r, h in zip(before, hit, strict=True) if h[1] > 0.5 * h[0]}
    assert {r.doc_id for r in before} - set(kept) == covered


def test_tokens(stages):
    before, after, _ = stages["sentencepiece"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_run(spark, sf_dir, stages):
    want = stages["sentencepiece"][1]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, r.n_tokens) for r in want)
