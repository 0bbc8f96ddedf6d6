"""Cleaning with items in many automata against one automaton."""

from __future__ import annotations

import random

import pytest

from playtally.llm import decontaminate
from tests.llm.cases import EDGE, clashing, ordered, table


@pytest.mark.parametrize("window, letters", [(3, 2), (4, 3), (2, 5)])
def test_shards_change_nothing(spark, window, letters):
    rnd = random.Random(window)
    text = lambda n: " ".join(rnd.choice("abcde"[:letters]) for _ in range(n))
    items = spark.createDataFrame([(i, text(rnd.randint(2, 8))) for i in range(8)], "item_id bigint, text string")
    docs = [(i, " Zq, ".join(text(rnd.randint(0, 12)) for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    docs += [*EDGE, docs[0], (900, docs[0][1])]
    frame = clashing(table(spark, docs, "n_chars bigint", 1))
    one = decontaminate.clean(frame, items, window)
    many = decontaminate.clean(frame, items, window, automaton_words=12)
    assert many.columns == one.columns
    assert ordered(map(tuple, many.collect())) == ordered(map(tuple, one.collect()))


def test_coverage_is_judged_over_all_shards(spark):
    halves = [(i, " ".join(f"v{i}w{k}" for k in range(12))) for i in range(8)]
    items = spark.createDataFrame(halves, "item_id bigint, text string")
    rest = " ".join(f"other{k}" for k in range(60))
    docs = table(spark, [(1, " ".join([rest, *(t for _, t in halves)])), (2, rest)])
    got = decontaminate.clean(docs, items, automaton_words=40).collect()
    assert [tuple(r) for r in got] == [(2, rest)]
