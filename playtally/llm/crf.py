"""A linear-chain conditional random field over the words of documents, in numpy.

Words are runs of letters in lower case. The features of a word are its
identity, if it is in the lexicon of the training sample, and the byte n-grams
in it and at its edges, so prefixes and suffixes are among them. Marginals are
exact: the words of many documents form one chain that is cut into equal
blocks, blocks advance together as products of transition matrices, and block
ends are then joined one after the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from playtally.llm.windows import Sums

BLOCK = 256
HASH_BITS = 18
_SIZES = {2: 1 << 16, 3: 1 << HASH_BITS, 4: 1 << HASH_BITS}

# ASCII letters in lower case, bytes of other characters as they are, the rest as spaces.
_LETTERS = np.array(
    [b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8
)


class Words:
    """The words of several texts: place of each, its document and its features."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        raw = data.tobytes()
        cuts = ends.tolist()
        # One space before, one between texts and some after.
        line = b" " + b" ".join([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]) + b"    "
        text = _LETTERS[np.frombuffer(line, np.uint8)]
        # Capital letters of the Latin-1 block.
        second = np.flatnonzero(text[:-1] == 0xC3) + 1
        text[second] = np.where((text[second] >= 0x80) & (text[second] <= 0x9E), text[second] | 0x20, text[second])
        letter = text != 0x20
        self.first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.stop = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        begins = ends[:-1] + 1 + np.arange(len(ends) - 1)
        self.doc = np.searchsorted(begins, self.first, "right") - 1
        self.offset = self.first - begins[self.doc]  # bytes from the text's start
        self.fresh = np.append(True, self.doc[1:] != self.doc[:-1])[: len(self.doc)]
        self.hash = Sums(text.astype(np.uint64) + np.uint64(1))(self.first, self.stop)
        n = text.astype(np.uint32)
        two = n[:-3] << np.uint32(8) | n[1:-2]
        three = two << np.uint32(8) | n[2:-1]
        four = three << np.uint32(8) | n[3:]
        spread = np.uint32(0x9E3779B1)
        down = np.uint32(32 - HASH_BITS)
        self.grams = {2: two, 3: (three * spread) >> down, 4: (four * spread) >> down}
        self.cuts = np.column_stack([self.first - 1, self.stop - 1]).ravel()

    def __len__(self) -> int:
        return len(self.first)

    def sum(self, values: np.ndarray) -> np.ndarray:
        """Sum of per-place values over the grams of each word."""
        return np.add.reduceat(values, self.cuts)[::2]


@dataclass
class Model:
    labels: list[str]
    grams: dict[int, np.ndarray]  # n -> (labels, hash)
    lexicon: np.ndarray  # sorted hashes
    known: np.ndarray  # (labels, lexicon + 1), the last for words out of it
    bias: np.ndarray
    start: np.ndarray
    step: np.ndarray
    gram_value: float = 1.0
    slope: float = 1.0
    level: float = 0.0

    def entries(self, words: Words) -> np.ndarray:
        at = np.searchsorted(self.lexicon, words.hash)
        size = len(self.lexicon)
        if not size:
            return np.zeros(len(words), np.int64)
        return np.where(self.lexicon[np.minimum(at, size - 1)] == words.hash, at, size)

    def scores(self, words: Words, entries: np.ndarray | None = None) -> np.ndarray:
        """(words, labels) emission scores."""
        if not len(words):
            return np.zeros((0, len(self.labels)))
        entries = self.entries(words) if entries is None else entries
        out = np.empty((len(words), len(self.labels)))
        for k in range(len(self.labels)):
            place = self.grams[2][k][words.grams[2]]
            for n in (3, 4):
                place += self.grams[n][k][words.grams[n]]
            out[:, k] = self.gram_value * words.sum(place) + self.known[k][entries] + self.bias[k]
        return out

    def marginals(self, words: Words) -> np.ndarray:
        return _marginals(self.scores(words), words.fresh, self.start, self.step)[0]


def _marginals(scores, fresh, start, step, block: int = BLOCK):
    """Marginals of every word, the forward and backward vectors and the emissions they come from."""
    n, k = scores.shape
    if not n:
        empty = np.zeros((0, k))
        return empty, empty, empty, empty
    emit = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0))
    start, step = np.exp(start - start.max()), np.exp(step - step.max())
    blocks = -(-n // block)
    padded = np.ones((blocks * block, k))
    padded[:n] = emit
    first = np.ones(blocks * block, bool)
    first[:n] = fresh
    padded = np.ascontiguousarray(padded.reshape(blocks, block, k).transpose(1, 0, 2))
    first = np.ascontiguousarray(first.reshape(blocks, block).T)
    anew = np.tile(start, (k, 1))  # whatever came before
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(block):
        now = product @ step
        if first[t].any():
            now[first[t]] = product[first[t]] @ anew
        now *= padded[t][:, None, :]
        product = now / now.max(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((blocks, k)), np.empty((blocks, k))
    vector = np.full(k, 1.0 / k)
    for b in range(blocks):
        ahead[b] = vector
        vector = vector @ product[b]
        vector /= vector.sum()
    vector = np.full(k, 1.0 / k)
    for b in range(blocks - 1, -1, -1):
        behind[b] = vector
        vector = product[b] @ vector
        vector /= vector.sum()
    forward, backward = np.empty((block, blocks, k)), np.empty((block, blocks, k))
    vector = ahead
    for t in range(block):
        now = vector @ step
        if first[t].any():
            now[first[t]] = start
        now *= padded[t]
        vector = now / now.sum(axis=1, keepdims=True)
        forward[t] = vector
    vector = behind
    for t in range(block - 1, -1, -1):
        backward[t] = vector
        ahead_of = padded[t] * vector
        now = ahead_of @ step.T
        if first[t].any():
            now[first[t]] = 1.0
        vector = now / now.sum(axis=1, keepdims=True)
    flat = lambda x: x.transpose(1, 0, 2).reshape(-1, k)[:n]
    forward, backward = flat(forward), flat(backward)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), forward, backward, emit


def calibrate(x: np.ndarray, positive: np.ndarray, rounds: int = 30, prior: float = 1.0) -> tuple[float, float]:
    """Slope and level of a logistic curve through ``x`` (Newton steps, prior on the slope)."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p) + 1e-6
        gradient = np.array([((positive - p) * x).sum() - prior * (a - 1), (positive - p).sum()])
        curve = np.array([[(v * x * x).sum() + prior, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(curve, gradient), -1, 1)
        a, b = a + move[0], b + move[1]
    return max(a, 1e-3), b


def fit(
    words: Words,
    target: np.ndarray,
    labels: list[str],
    weight: np.ndarray | None = None,
    rounds: int = 30,
    rate: float = 0.15,
    decay: float = 1e-4,
    least: int = 3,
    gram_value: float = 1.0,
) -> Model:
    """Maximum likelihood by Adam over all words of a sample in memory.

    ``target`` is each word's label. Words that occur ``least`` times make the
    lexicon. ``weight`` scales the words' part of the gradient, ``gram_value``
    is the value of a gram's feature, that of a word's being 1.
    """
    k = len(labels)
    found, counts = np.unique(words.hash, return_counts=True)
    lexicon = found[counts >= least]
    model = Model(
        labels,
        {n: np.zeros((k, size), np.float32) for n, size in _SIZES.items()},
        lexicon,
        np.zeros((k, len(lexicon) + 1)),
        np.zeros(k),
        np.zeros(k),
        np.zeros((k, k)),
        gram_value,
    )
    n = len(words)
    if not n or k < 2:
        return model
    weight = np.ones(n) if weight is None else weight
    entries = model.entries(words)
    gold = np.zeros((n, k))
    gold[np.arange(n), target] = 1.0
    inner = np.flatnonzero(~words.fresh)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (target[inner - 1], target[inner]), 1.0)
    firsts = np.bincount(target[words.fresh], minlength=k).astype(float)
    # The places of grams that belong to a word, and whose.
    spans = words.stop - words.first
    owner = np.repeat(np.arange(n, dtype=np.int32), spans)
    place = np.repeat(words.first - 1 - np.append(0, np.cumsum(spans)[:-1]), spans)
    place += np.arange(len(owner))
    grams = {m: words.grams[m][place].astype(np.int32) for m in _SIZES}
    del place
    # A feature's step is scaled by how often it occurs.
    parameters = [*(model.grams[m] for m in _SIZES), model.known, model.bias, model.start, model.step]
    seen = [np.zeros_like(p, dtype=np.float64) for p in parameters]
    for _ in range(rounds):
        probs, forward, backward, emit = _marginals(model.scores(words, entries), words.fresh, model.start, model.step)
        error = (gold - probs) * weight[:, None]
        expected = forward[inner - 1][:, :, None] * np.exp(model.step)[None] * (emit * backward)[inner][:, None, :]
        expected /= expected.sum(axis=(1, 2), keepdims=True)
        gradients = []
        for m, size in _SIZES.items():
            gradients.append(np.stack([np.bincount(grams[m], error[owner, j], size) for j in range(k)]))
        gradients.append(np.stack([np.bincount(entries, error[:, j], len(lexicon) + 1) for j in range(k)]))
        gradients += [error.sum(axis=0), firsts - probs[words.fresh].sum(axis=0), pairs - expected.sum(axis=0)]
        for i, (value, gradient) in enumerate(zip(parameters, gradients, strict=True)):
            gradient = gradient - decay * n * (np.abs(value) > 0) * value / max(1, k)
            seen[i] += gradient * gradient
            value += (rate * gradient / (np.sqrt(seen[i]) + 1e-8)).astype(value.dtype)
    return model
