"""Segmentation against the SentencePiece library and a plain search; exact round trips."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece

from playtally.llm import pieces
from playtally.llm.shared import documents
from tests.llm.cases import EDGE, clashing, table

TEXTS = ["", "a", "  Hello  world\n\tñandú ☃", "   ", "日本語 テキスト 😀 z", "a  b   c ", "\n\n", "é" * 200, "x" * 300 + " y"]


@pytest.fixture(scope="module")
def merge():
    return pieces.Pieces.load()


@pytest.fixture(scope="module")
def viterbi():
    return pieces.Pieces.load(search=pieces.VITERBI)


def cut(table, texts):
    ids, bounds = table.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def samples(spark, sf_dir):
    return TEXTS + [r.text for r in documents(spark, sf_dir).limit(150).collect()]


def test_model_kind(merge):
    assert merge.search == pieces.MERGE and merge.prefix


def test_same_as_library(spark, sf_dir, merge):
    texts = samples(spark, sf_dir)
    assert cut(merge, texts) == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)


def test_long_words_same_as_rounds(merge):
    rnd = random.Random(4)
    words = ["e" * 700, "日本" * 300, "☃😀" * 200, "ab" * 400 + "é" * 50]
    words += ["".join(rnd.choice(letters) for _ in range(rnd.randint(257, 900))) for letters in ("ethan", "in", "aé日☃x", "0123/-")]
    for word in words:
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        assert merge.merged_alone(word).tolist() == merge.merged(points[None, :])[0].tolist(), word[:20]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert cut(merge, words) == library.encode(words)


def test_time_of_a_run_grows_with_its_length(merge):
    text = "e" * 400_000
    (ids,) = cut(merge, [text])
    # Rounds over the whole run took minutes here.
    assert ids == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
    assert merge.decode(np.array(ids), np.array([0, len(ids)])) == [text]


def plain_best(score, text, longest, unknown):
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[end - n] + score[text[end - n : end]] for n in range(1, min(end, longest) + 1) if text[end - n : end] in score]
        options.append(best[end - 1] + (unknown if text[end - 1] not in score else score[text[end - 1]]))
        best.append(max(options))
    return best[-1]


def test_viterbi_is_best(spark, sf_dir, viterbi):
    score = {viterbi.text[i].decode(): s for i, s in zip(viterbi.ids, viterbi.scores, strict=True)}
    of_id = {int(i): s for i, s in zip(viterbi.ids, viterbi.scores, strict=True)}
    words = sorted({w for t in samples(spark, sf_dir)[9:60] for w in t.split() if all(c in score for c in w)})[:1500]
    for word, ids in zip(words, cut(viterbi, words), strict=True):
        assert sum(of_id[i] for i in ids) == plain_best(score, f" {word}", viterbi.longest, viterbi.unknown), word


@pytest.mark.parametrize("search", [pieces.VITERBI, pieces.MERGE])
def test_round_trip(search, merge, viterbi):
    table_ = merge if search == pieces.MERGE else viterbi
    rnd = random.Random(4)
    letters = "ab ▁é\n\t日😀x\x00"
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))) for _ in range(200)]
    ids, bounds = table_.encode(texts)
    assert table_.decode(ids, bounds) == texts


def test_frames(spark):
    docs = table(spark, [*EDGE, (1, "a b"), (1, "a b")])
    found = pieces.decode(pieces.encode(clashing(docs).drop("ids"))).collect()
    assert all(r.decoded == (r.text or "") for r in found) and len(found) == 8
    assert all(r.ids == [] for r in found if not r.text)
    assert pieces.encode(table(spark, [])).count() == 0


def test_query(spark, sf_dir):
    found = pieces.op3_pieces(spark, sf_dir)
    assert found.where("not round_trip or n_tokens <> size(ids)").count() == 0
    assert found.count() == documents(spark, sf_dir).count()
