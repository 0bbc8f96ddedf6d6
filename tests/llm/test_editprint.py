"""Edit-embedding fingerprints."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from playtally.llm import editprint
from playtally.llm.shared import documents
from tests.llm.cases import EDGE, clashing, table


def test_query(spark, sf_dir):
    found = {r.doc_id: r for r in editprint.op4_fingerprints(spark, sf_dir).collect()}
    docs = sorted((r.doc_id, r.text) for r in documents(spark, sf_dir).collect())
    assert len(found) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        half = len(text) // 2
        changed = text[: len(text) - half] + docs[(i + 1) % len(docs)][1][:half]
        row = found[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= row.near_next <= 1
    long = [r for r in found.values() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
    assert abs(np.mean([r.near_edited for r in long]) - 0.55) < 0.1


def test_small_edits_show_as_small_distance():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    other = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    changed = list(text)
    for _ in range(6):
        changed.insert(rnd.randrange(len(changed)), "z")
    prints = editprint.Embedding().prints([editprint.points(t) for t in (text, text, "".join(changed), other)])
    assert (prints[0] == prints[1]).all()
    assert (prints[0] == prints[2]).mean() > 0.8 > 0.4 > (prints[0] == prints[3]).mean()


def plain_print(walks, text):
    """Step by step: where the walk is, and what it writes there."""
    marks = (editprint.points(text) * np.uint32(0x9E3779B1) >> np.uint32(24)).tolist()
    state, at, written = walks.states[0], 0, []
    while at < len(marks):
        after = state[marks[at]]
        stay = (after[-1] - state[-1] - 1) % editprint.PERIOD + 1
        written += [marks[at]] * stay
        state, at = after, at + 1
    steps = [max(s for s in r if s < 2 * len(marks)) for r in walks.records.tolist()]
    return [written[s] if s < len(written) else 0 for s in steps]


def test_chunks_do_not_break_a_walk(monkeypatch):
    rnd = random.Random(5)
    walks = editprint.Embedding()
    texts = ["".join(rnd.choice("abcdé 日😀") for _ in range(n)) for n in (1, 2, 3, 63, 64, 65, 1000, 9000)]
    whole = walks.prints([editprint.points(t) for t in texts])
    assert whole.tolist() == [plain_print(walks, t) for t in texts]
    monkeypatch.setattr(editprint, "CHUNK", 64)
    assert (walks.prints([editprint.points(t) for t in texts]) == whole).all()


def test_insertions_at_the_start_of_long_texts():
    rnd = random.Random(6)
    walks = editprint.Embedding()
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    text = lambda: " ".join(rnd.choice(words) for _ in range(4000))
    near = {change: [] for change in ("in 1", "in 10", "in 60", "out 10", "other 20", "unlike")}
    for _ in range(16):
        base, other = text(), text()
        own = walks.print(editprint.points(base))
        for change, changed in (
            ("in 1", other[:1] + base),
            ("in 10", other[:10] + base),
            ("in 60", other[:60] + base),
            ("out 10", base[10:]),
            ("other 20", other[:20] + base[20:]),
            ("unlike", other),
        ):
            near[change].append((own == walks.print(editprint.points(changed))).mean())
    mean = {change: np.mean(values) for change, values in near.items()}
    assert min(mean["in 1"], mean["other 20"]) > 0.9 and min(mean["in 10"], mean["out 10"]) > 0.75, mean
    # A walk that is 60 characters off meets the other one only after thousands of steps, or not at all.
    assert mean["in 60"] > 0.4 > 0.15 > mean["unlike"], mean


def test_edges(spark):
    docs = [*EDGE, (2, "zz"), (2, ""), (2, "")]
    found = editprint.edit_prints(clashing(table(spark, docs))).collect()
    assert len(found) == len(docs)
    empty = {r.fingerprint for r in found if not r.n_chars}
    assert empty == {"00" * editprint.SLOTS}
    assert editprint.edit_prints(table(spark, [])).count() == 0


def test_one_row_follows_itself(spark):
    (row,) = editprint.edit_prints(table(spark, [(1, "abcdef")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0


def test_bands_find_alike_texts(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(1500)) for _ in range(6)]
    docs = []
    for i, text in enumerate(base):
        for j in range(5):
            at = rnd.randrange(len(text))
            docs.append((10 * i + j, text[:at] + "!" * (j % 3) + text[at:]))
    prints = editprint.edit_prints(table(spark, docs))
    root = {r.fingerprint: r.root for r in editprint.near_prints(prints).collect()}
    groups = {}
    for row in prints.collect():
        groups.setdefault(row.doc_id // 10, set()).add(root[row.fingerprint])
    assert all(len(g) == 1 for g in groups.values())
    assert len(set.union(*groups.values())) == len(base)
