"""Marginals against logarithms summed path by path; held-out accuracy of both models."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from playtally.llm import language, toxicity
from playtally.llm.crf import Words, _marginals, calibrate
from playtally.llm.shared import documents, text_bytes
from tests.llm.cases import EDGE, clashing, table


@pytest.mark.parametrize("block", [1, 3, 64])
def test_marginals_by_all_paths(block):
    rng = np.random.default_rng(2)
    k, fresh = 3, np.array([True, False, False, True, False, True, False, False, False])
    scores, start, step = rng.normal(size=(9, k)) * 2, rng.normal(size=k), rng.normal(size=(k, k))
    want = np.zeros((9, k))
    bounds = [*np.flatnonzero(fresh), 9]
    for a, b in itertools.pairwise(bounds):
        total = 0.0
        for path in itertools.product(range(k), repeat=b - a):
            value = start[path[0]] + sum(scores[a + i, y] for i, y in enumerate(path))
            value = np.exp(value + sum(step[x, y] for x, y in itertools.pairwise(path)))
            total += value
            for i, y in enumerate(path):
                want[a + i, y] += value
        want[a:b] /= total
    got = _marginals(scores, fresh, start, step, block)[0]
    assert np.allclose(got, want)


def test_words_and_offsets():
    import pyarrow as pa

    texts = ["Ñandú, a-B 3x", None, "", "É", " z"]
    words = Words(*text_bytes(pa.array(texts)))
    raw = [(t or "").encode() for t in texts]
    spans = [raw[d][o : o + n].decode() for d, o, n in zip(words.doc, words.offset, words.stop - words.first, strict=True)]
    assert spans == ["Ñandú", "a", "B", "x", "É", "z"]
    assert words.doc.tolist() == [0, 0, 0, 0, 3, 4]
    assert words.fresh.tolist() == [True, False, False, False, True, True]


def test_calibration_keeps_order():
    x = np.linspace(-5, 5, 50)
    slope, level = calibrate(x, (x > 1).astype(float))
    assert slope > 0 and 0.5 < 1 / (1 + np.exp(-(slope * 2 + level))) <= 1


def test_language_query(spark, sf_dir):
    found = language.op10_language(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    rows = [r for r in found.collect() if r.held_out]
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = [(i, "the and of to", "en") for i in range(8)] + [(20 + i, "der und die das", "de") for i in range(8)]
    train += [(90, None, "en"), (91, "x", None)]
    model = language.learn(spark.createDataFrame(train, "doc_id bigint, text string, lang string"), per_label=100)
    assert model.labels == ["de", "en"]
    docs = [*EDGE, (1, "The AND of"), (2, "und der Die"), (3, "12 -- 3"), (4, "— “”")]
    found = {r.doc_id: r for r in language.predict(clashing(table(spark, docs)), model).collect()}
    assert found[1].lang_pred == "en" and found[2].lang_pred == "de"
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (3, 4, 500, 501, 502))
    assert language.predict(table(spark, docs), language.learn(table(spark, [], "lang string", "x"))).where(
        "lang_pred <> 'und'"
    ).count() == 0


def test_toxicity_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.op1_toxicity(spark, sf_dir).collect()
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(found) == documents(spark, sf_dir).count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    toxic = [r.score for r in found if known.get(r.doc_id) == 1]
    clean = [r.score for r in found if known.get(r.doc_id) == 0]
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert wins > 0.8


def labelled_texts(spark):
    rnd = random.Random(6)
    text = lambda: [rnd.choice(["plain", "words", "here", *(f"{a}{b}o" for a in "bdkl" for b in "aeiou" * 3)]) for _ in range(30)]
    rows = [(100 + i, " ".join(text()), 0) for i in range(180)]
    for i in range(60):
        words = text()
        words[rnd.randrange(30)] = "vileword"
        rows.append((i, " ".join(words), 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxic_spans_and_edges(spark):
    model = toxicity.learn(labelled_texts(spark), {"1": 500, "0": 500})
    docs = clashing(table(spark, [*EDGE, (1, "É VILEWORD, plain"), (2, "plain words here")]))
    found = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert found[1].score > 0.3 > found[2].score
    assert found[1].offsets == [3, 11] and found[2].offsets == []
    assert found[500].score == found[501].score == found[502].score < 0.3
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {2, 500, 501, 502} <= ids and 1 not in ids


def test_no_labels(spark):
    model = toxicity.learn(labelled_texts(spark).where("toxic = 0"))
    assert {r.score for r in toxicity.scores(table(spark, EDGE), model).collect()} == {0.0}
    assert toxicity.scores(table(spark, []), model).count() == 0
