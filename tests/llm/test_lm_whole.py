"""Bigrams that are frequent in a small target only."""

from __future__ import annotations

import pytest

from playtally.llm import lm_score
from tests.llm.cases import table


def test_rare_bigrams_stay_in_the_models(spark):
    rare = "quorum sensing " * 3
    docs = [(1, rare), (2, "sensing quorum " * 3), *((10 + i, "common words all over " * 50_000) for i in range(8))]
    docs.append((3, rare))
    found = {r.doc_id: r for r in lm_score.cross_entropy_difference(table(spark, docs), table(spark, [(1, "")])).collect()}
    want = lm_score.brute_force([t.encode() for _, t in docs], [d == 1 for d, _ in docs], lm_score.PRIOR)
    for (doc, _), values in zip(docs, want, strict=True):
        row = found[doc]
        assert row.n_words == values[0] and tuple(row)[2:] == pytest.approx(values[1:], abs=1e-9)
