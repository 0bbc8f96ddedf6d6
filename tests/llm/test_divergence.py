"""Source profiles against dictionaries; encoded columns against plain sums."""

from __future__ import annotations

import random

import numpy as np
import pytest

from playtally.llm import divergence
from playtally.llm.shared import documents
from tests.llm.cases import clashing, ordered


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


@pytest.fixture(scope="module")
def cases():
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        # Source s0 holds a third of all rows, s7 few.
        source = "s0" if i % 3 == 0 else f"s{rnd.choice([1, 2, 3, 3, 3, 7])}"
        words = [rnd.choice("a b cc Dd é tür the the of".split()) for _ in range(rnd.randint(0, 30))]
        rows.append((" ".join(words) + rnd.choice(["", ".", "1x2 [Zed] \x7fQ"]), rnd.choice(["en", "de"]), source))
    rows += [("the the", None, None), (None, "en", "s9"), ("", "", "s1"), (None, None, "s1"), ("x " * 20_000, "en", "s1")]
    rows += [("Once more", "de", "s2")] * 40 + [("only", "xx", "lone")] * 5 + [("ÄÖ äö", "de", "Ünï")] * 31
    return rows


@pytest.mark.parametrize("min_docs, cells", [(30, 1 << 20), (5, 8), (1, 1)])
def test_audit(spark, cases, min_docs, cells):
    found = divergence.audit(clashing(frame(spark, cases)).repartition(5), min_docs, 3, cells=cells)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert ordered(map(tuple, found.collect())) == ordered(divergence.brute_force(cases, min_docs, 3))


def test_groups_handed_on_early(spark, cases, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    found = divergence.audit(frame(spark, cases), 10).collect()
    assert ordered(map(tuple, found)) == ordered(divergence.brute_force(cases, 10))


def test_query(spark, sf_dir):
    rows = [(r.text, r.lang, r.source) for r in documents(spark, sf_dir).collect()]
    found = divergence.op11_divergence(spark, sf_dir)
    assert [t for _, t in found.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    assert ordered(map(tuple, found.collect())) == ordered(divergence.brute_force(rows))


def test_no_rows(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    # Sources without any kept term still have their pairs.
    rows = divergence.audit(frame(spark, [("a", "en", "x"), (None, "en", "y")])).collect()
    assert ordered(map(tuple, rows)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_encoded_columns():
    rnd = np.random.default_rng(5)
    for terms, sources in ((1, 1), (1, 4), (50, 3), (400, 6)):
        table = rnd.integers(0, 3, (terms, sources)) ** 2
        table[:, 0] = 7
        encoded = divergence.runs(table)
        # The column of one value is one run, the next has a run for each value it takes.
        assert len(encoded[0][0]) == 1
        assert min(len(b) for b, _ in encoded[1:]) <= 3 if sources > 1 else True
        for a in range(sources):
            for b in range(sources):
                want = int(np.abs(table[:, a] - table[:, b]).sum())
                assert divergence.difference(encoded[a], encoded[b], terms) == want


def test_shares_are_exact(spark):
    n, total, terms = 9_300_000_000_000, 20_000_000_000_000, 30_000_000
    frame = spark.createDataFrame([(n, total, terms)], "n bigint, t bigint, v bigint")
    (row,) = frame.select(divergence.share("n", "t", "v").alias("p")).collect()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * terms)
