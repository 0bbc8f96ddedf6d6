"""Removal of repeated bytes and words against dictionaries of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from playtally.llm import phrase_dedup, repeats, suffix_dedup
from playtally.llm.shared import documents
from tests.llm.cases import EDGE, ordered, table


def collection(seed: int, separator: str, alphabet: str) -> list[tuple]:
    rnd = random.Random(seed)
    base = [separator.join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(25)]
    docs = []
    for i in range(80):
        text = list(separator.join(rnd.choice(base) for _ in range(rnd.randint(0, 4))))
        for _ in range(rnd.randint(0, 3)):
            if text:
                text[rnd.randrange(len(text))] = rnd.choice(alphabet)
        docs.append((i, "".join(text)))
    return docs + [(3, docs[3][1]), (3, docs[3][1]), (3, docs[4][1]), *EDGE]


@pytest.mark.parametrize("length, gram, cell", [(20, 8, 4), (20, 20, 1), (5, 2, 2), (40, 16, 16)])
def test_bytes(spark, length, gram, cell):
    docs = collection(length, "", "abcdé ")
    found = suffix_dedup.remove_repeats(table(spark, docs), length, gram=gram, cell=cell).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found]
    want = suffix_dedup.brute_force([(t or "").encode() for _, t in docs], length)
    assert ordered(got) == ordered((d, *w) for (d, _), w in zip(docs, want, strict=True))


@pytest.mark.parametrize("length, gram", [(12, 4), (20, 20), (3, 1)])
def test_words(spark, length, gram):
    docs = collection(length, " ", "abcdé")
    found = phrase_dedup.remove_phrases(table(spark, docs), length, gram=gram).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found]
    want = phrase_dedup.brute_force([(t or "").encode() for _, t in docs], length)
    assert ordered(got) == ordered((d, *w) for (d, _), w in zip(docs, want, strict=True))


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_of_long_texts(spark, piece):
    """No border between pieces hides a repeated window."""
    docs = collection(9, "", "abcdé ")
    rows = repeats.referenced(table(spark, docs)).select("ref", "text")

    def starts(**more):
        found = repeats.repeated_starts(rows, repeats.byte_units, 20, 8, 4, **more).collect()
        out = set()
        for ref, places in found:
            for low, count, _ in zip(*(x.tolist() for x in repeats.unpack(np.array(places))), strict=True):
                out.update((ref, low + i) for i in range(count))
        return out

    assert starts(piece=piece) == starts()


def test_text_beyond_positions():
    """2^26 units and more in one text; every start belongs to one run."""
    units = np.random.default_rng(1).integers(0, 1 << 62, (1 << 26) + 5).astype(np.uint64)
    ends = np.array([0, 3, len(units)])
    counts = [int(r.count.sum()) for r in repeats.runs_by_pieces(units, ends, 200, 64, 1 << 22)]
    assert sum(counts) == len(units) - 3 - 199


def test_one_hot_passage(spark):
    """A passage in every document, alone and among other words."""
    passage = " ".join(f"w{i}" for i in range(50))
    docs = [(i, f"x{i} {passage} y{i}" if i % 2 else passage) for i in range(300)]
    found = phrase_dedup.remove_phrases(table(spark, docs)).collect()
    assert {(r.doc_id, r.n_removed, r.kept) for r in found} == {
        (i, 50, f"x{i} y{i}" if i % 2 else "") for i in range(300)
    }


def test_queries_at_production_settings(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    texts = [t.encode() for _, t in docs]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.op7_suffix_dedup(spark, sf_dir).collect()}
    assert got == dict(zip([d for d, _ in docs], suffix_dedup.brute_force(texts), strict=True))
    got = {r[0]: tuple(r)[1:] for r in phrase_dedup.op8_substring_dedup(spark, sf_dir).collect()}
    assert got == dict(zip([d for d, _ in docs], phrase_dedup.brute_force(texts), strict=True))


def test_rewritten_documents(spark):
    row = "0123456789" * 3
    docs = table(spark, [(1, f"a{row}é{row}b"), (2, None), (3, ""), (4, "kept")], "n_chars bigint, kept string", 7, "k")
    found = {r.doc_id: (r.text, r.n_chars, r.kept) for r in suffix_dedup.cut_repeats(docs, 20).collect()}
    assert found == {1: ("aéb", 3, "k"), 2: (None, 7, "k"), 3: ("", 0, "k"), 4: ("kept", 4, "k")}


def test_empty_table(spark):
    none = table(spark, [])
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert phrase_dedup.remove_phrases(none).count() == 0
