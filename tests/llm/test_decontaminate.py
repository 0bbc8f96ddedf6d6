"""Benchmark windows against a dictionary of windows."""

from __future__ import annotations

import hashlib
import random

import pytest

from playtally.llm import decontaminate
from playtally.llm.shared import documents
from tests.llm.cases import EDGE, clashing, ordered, table


def items_table(spark, items):
    return clashing(spark.createDataFrame(items, "item_id bigint, text string"))


@pytest.mark.parametrize("window, letters", [(3, 2), (10, 2), (1, 5), (5, 3)])
@pytest.mark.parametrize("automaton_words", [2_000_000, 60])
def test_matches(spark, window, letters, automaton_words):
    rnd = random.Random(window)
    text = lambda n: " ".join(rnd.choice("abcde"[:letters]) for _ in range(n))
    items = [(i, text(rnd.randint(0, 14))) for i in range(12)]
    items += [(99, None), (None, "a b"), (50, "a b c a"), (51, "A-b/c a")]
    docs = [(i, text(rnd.randint(0, 60)) + rnd.choice(["", " Zq-a é " + text(20)])) for i in range(40)]
    docs += [*EDGE, (3, "A,B;c a"), (3, "A,B;c a")]
    found = decontaminate.matches(clashing(table(spark, docs)), items_table(spark, items), window, automaton_words=automaton_words)
    got = [
        (
            r.doc_id,
            r.n_words,
            sum(r.ranges[1::2]) - sum(r.ranges[::2]),
            len(r["items"]),
            hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(),
            bool(r.ranges),
        )
        for r in found.collect()
    ]
    texts = [(t or "").encode() for _, t in docs]
    want = decontaminate.brute_force(texts, [(i, (t or "").encode()) for i, t in items if i is not None], window)
    assert ordered(got) == ordered((d, *w) for (d, _), w in zip(docs, want, strict=True))


def test_query(spark, sf_dir):
    docs = documents(spark, sf_dir).collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {r[0]: tuple(r)[1:] for r in decontaminate.op6_decontamination(spark, sf_dir).collect()}
    want = decontaminate.brute_force([r.text.encode() for r in docs], [(r.item_id, r.text.encode()) for r in items])
    assert got == {r.doc_id: w for r, w in zip(docs, want, strict=True)}


def test_cleaned_texts(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rest = " ".join(f"other{i}" for i in range(30))
    docs = [(1, f"{rest}. {item.upper()}, {rest}"), (2, item), (3, rest), (4, None), (5, "")]
    frame = clashing(table(spark, docs, "n_chars bigint", 1))
    found = decontaminate.clean(frame, items_table(spark, [(1, item)]))
    assert found.columns == frame.columns
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == {1, 3, 4, 5} and rows[3].text == rest and rows[4].text is None
    assert rows[1].text.split() == [*f"{rest}.".split(), ",", *rest.split()]
    assert rows[1].n_chars == len(rows[1].text)


def test_what_is_left_makes_no_new_window(spark):
    item = " ".join(f"w{i}" for i in range(20))
    words = item.split()
    text = " ".join([*words[:6], *words[2:14], *words[6:16], *(f"x{i}" for i in range(60))])
    (row,) = decontaminate.clean(table(spark, [(1, text)]), items_table(spark, [(1, item)])).collect()
    assert not decontaminate.brute_force([row.text.encode()], [(1, item.encode())])[0][4]


def test_empty_tables(spark):
    some, none = table(spark, [(1, "a b")]), table(spark, [])
    items = items_table(spark, [(1, "a b")])
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.matches(some, items.limit(0)).collect()[0].ranges == []
    assert decontaminate.clean(some, items.limit(0)).count() == 1


@pytest.mark.parametrize("automaton_words", [200_000, 4])
def test_item_ids_of_any_kind(spark, automaton_words):
    items = spark.createDataFrame([("it-1", "a b c"), ("9", "b c d"), ("10", "a b c"), ("é", "x"), ("none", "q r")], "item_id string, text string")
    docs = table(spark, [(1, "z a b c d"), (2, "x"), (3, "z")])
    found = decontaminate.matches(docs, items, 3, automaton_words=automaton_words).collect()
    assert {r.doc_id: r["items"] for r in found} == {1: ["10", "9", "it-1"], 2: ["é"], 3: []}
