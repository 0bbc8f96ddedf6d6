"""SentencePiece encoding and decoding by batched search in numpy (3).

All distinct words of one length in a batch advance together, and hashes of
their substrings are looked up among the sorted hashes of the pieces. How a
word is cut follows the kind of the model, as in the SentencePiece library:

* unigram: Viterbi search for the highest sum of piece scores; at each end
  place the best substring that ends there is kept as the way back;
* BPE: the best-scored neighbours of each word are joined, round by round; a word
  of more than ``_ALONE`` characters is joined by itself, with a heap of neighbours.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from playtally.llm.shared import documents, keyed_texts, mix, slices
from playtally.llm.windows import _BASE, _powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
VITERBI, MERGE = "viterbi", "merge"
_UNIGRAM_TYPE = 1
#: Longer words are first cut where no piece holds the two neighbours.
_LONG = 64
#: A round over a row costs its length, so a longer word does not join in rounds.
_ALONE = 256
#: No piece holds a space after another character, so words can be cut there.
_WORD = re.compile(" +[^ ]*")
_SPACE = "▁"
_UNKNOWN_PENALTY = 10.0


def _hash(rows: np.ndarray) -> np.ndarray:
    """Hashes of equally long rows of code points."""
    return (rows.astype(np.uint64) + np.uint64(1)) @ _powers(_BASE, rows.shape[1])


@dataclass
class Pieces:
    """A model's table: sorted hashes of pieces with their ids and scores, bytes of every id."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: float
    text: list[bytes]
    byte: np.ndarray  # id of each byte
    prefix: bool
    search: str
    together: frozenset[str]  # neighbours in some piece

    @classmethod
    def load(cls, path: str = MODEL, search: str | None = None) -> Pieces:
        """Read a model with the byte fallback; control pieces stand for no text.

        ``search`` is the way to cut words; by default the model's own.
        """
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        search = search or (VITERBI if proto.trainer_spec.model_type == _UNIGRAM_TYPE else MERGE)
        found: list[tuple[str, int, float]] = []
        text, byte = [b""] * model.get_piece_size(), np.full(256, -1, np.int32)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                text[i] = bytes([int(piece[3:5], 16)])
                byte[text[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain = piece.replace(_SPACE, " ")
                if re.search("[^ ] ", plain):
                    raise ValueError("pieces that hold a space after another character are not supported")
                text[i] = plain.encode()
                found.append((plain, i, model.get_score(i)))
        if (byte < 0).any():
            raise ValueError("the model has no byte pieces")
        by_size: dict[int, list] = {}
        for entry in found:
            by_size.setdefault(len(entry[0]), []).append(entry)
        keys, ids, scores = [], [], []
        for size, entries in by_size.items():
            points = np.frombuffer("".join(e[0] for e in entries).encode("utf-32-le"), np.uint32)
            keys.append(mix(_hash(points.reshape(-1, size)) + np.uint64(size)))
            ids += [e[1] for e in entries]
            scores += [e[2] for e in entries]
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        if (keys[order][1:] == keys[order][:-1]).any():
            raise ValueError("two pieces have one hash")
        scores = np.array(scores)[order]
        prefix = model.encode("a", out_type=str)[0].startswith(_SPACE)
        return cls(
            keys[order],
            np.array(ids, np.int32)[order],
            scores,
            max(by_size),
            scores.min() - _UNKNOWN_PENALTY,
            text,
            byte,
            prefix,
            search,
            frozenset(p[i : i + 2] for p, _, _ in found for i in range(len(p) - 1)),
        )

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each hash among the pieces, -1 for none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def best(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of equally long words, row by row, and their number in each row.

        A code point without a piece is the token -1 - code point. Of equal
        scores the longer last piece wins.
        """
        rows, size = words.shape
        weights, back = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        sums = np.zeros((size + 1, rows), np.uint64)
        np.cumsum((words.T.astype(np.uint64) + np.uint64(1)) * weights[:, None], axis=0, out=sums[1:])
        score = np.full((size + 1, rows), -np.inf)
        score[0] = 0.0
        piece = np.empty((size + 1, rows), np.int32)
        step = np.ones((size + 1, rows), np.int32)
        for end in range(1, size + 1):
            length = np.arange(min(self.longest, end), 0, -1)
            start = end - length
            key = (sums[end] - sums[start]) * back[start, None]
            at = self.find(mix(key + length.astype(np.uint64)[:, None]))
            value = np.where(at >= 0, score[start] + self.scores[at], -np.inf)
            # A single code point is always possible.
            lone = at[-1] < 0
            value[-1, lone] = score[end - 1, lone] + self.unknown
            choice = value.argmax(axis=0)
            lane = np.arange(rows)
            score[end] = value[choice, lane]
            step[end] = length[choice]
            found = at[choice, lane]
            piece[end] = np.where(found >= 0, self.ids[found], -1 - words[:, end - 1].astype(np.int32))
        tokens = np.empty((rows, size), np.int32)
        used = np.zeros((rows, size), bool)
        lane, end, column = np.arange(rows), np.full(rows, size), size
        while len(lane):
            column -= 1
            tokens[lane, column] = piece[end, lane]
            used[lane, column] = True
            end = end - step[end, lane]
            lane, end = lane[end > 0], end[end > 0]
        return tokens[used], used.sum(axis=1)

    def merged(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``best``, by joining the neighbours that make the best-scored piece, leftmost first."""
        rows, size = words.shape
        back = _powers(pow(_BASE, -1, 1 << 64), size)
        sums = np.zeros((rows, size + 1), np.uint64)
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size), axis=1, out=sums[:, 1:])

        def place(lane, begin, end):
            key = (sums[lane, end] - sums[lane, begin]) * back[begin]
            return self.find(mix(key + (end - begin).astype(np.uint64)))

        def score(lane, begin, end):
            at = place(lane, begin, end)
            return np.where((at >= 0) & (end - begin <= self.longest), self.scores[at], -np.inf)

        # Of each symbol, by its begin: end, symbol before, score with the next.
        stop = np.tile(np.arange(1, size + 1), (rows, 1))
        before = np.tile(np.arange(-1, size), (rows, 1))
        joint = np.full((rows, size), -np.inf)
        if size > 1:
            lane, begin = np.divmod(np.arange(rows * (size - 1)), size - 1)
            joint[:, :-1] = score(lane, begin, begin + 2).reshape(rows, -1)
        alive = np.ones((rows, size), bool)
        lane = np.arange(rows)
        while len(lane):
            begin = joint[lane].argmax(axis=1)
            more = joint[lane, begin] > -np.inf
            lane, begin = lane[more], begin[more]
            middle = stop[lane, begin]
            end = stop[lane, middle]
            stop[lane, begin] = end
            before[lane, end] = begin
            alive[lane, middle] = False
            joint[lane, middle] = -np.inf
            joint[lane, begin] = -np.inf
            go = end < size
            joint[lane[go], begin[go]] = score(lane[go], begin[go], stop[lane[go], end[go]])
            go = begin > 0
            first = before[lane[go], begin[go]]
            joint[lane[go], first] = score(lane[go], first, end[go])
        lane, begin = np.nonzero(alive)
        at = place(lane, begin, stop[lane, begin])
        lone = -1 - words[lane, begin].astype(np.int32)
        return np.where(at >= 0, self.ids[at], lone).astype(np.int32), alive.sum(axis=1)

    @cached_property
    def _table(self) -> dict[str, tuple[float, int]]:
        """Score and id of each piece."""
        ids, scores = self.ids.tolist(), self.scores.tolist()
        return {self.text[i].decode(): (score, i) for i, score in zip(ids, scores, strict=True)}

    def merged_alone(self, word: str) -> np.ndarray:
        """Tokens of one word, as ``merged`` finds them, in time n log n."""
        table, longest, size = self._table, self.longest, len(word)
        # Of each symbol, by its begin: end (0 once joined to another) and symbol before.
        stop, before = list(range(1, size + 1)), list(range(-1, size))
        heap: list[tuple[float, int, int, int]] = []

        def offer(begin: int, middle: int, end: int) -> None:
            if end - begin <= longest:
                found = table.get(word[begin:end])
                if found:
                    heapq.heappush(heap, (-found[0], begin, middle, end))

        for begin in range(size - 1):
            offer(begin, begin + 1, begin + 2)
        while heap:
            _, begin, middle, end = heapq.heappop(heap)
            if stop[begin] != middle or stop[middle] != end:
                continue
            stop[begin], stop[middle] = end, 0
            before[end] = begin
            if end < size:
                offer(begin, end, stop[end])
            if begin:
                offer(before[begin], begin, end)
        out, begin = [], 0
        while begin < size:
            found = table.get(word[begin : stop[begin]])
            out.append(found[1] if found else -1 - ord(word[begin]))
            begin = stop[begin]
        return np.array(out, np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words end to end and the n + 1 bounds."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        search = self.best if self.search == VITERBI else self.merged
        tokens, counts, rows = [], [], []
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(words) else ():
            length = int(size[own[0]])
            if length > _ALONE and self.search == MERGE:
                found = [self.merged_alone(words[i]) for i in own]
                tokens += found
                counts.append(np.array([len(x) for x in found]))
                rows.append(own)
                continue
            # Tables of one group stay small.
            for part in np.array_split(own, -(-len(own) * length // 500_000)):
                points = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32)
                found, n = search(points.reshape(len(part), length))
                tokens.append(found)
                counts.append(n)
                rows.append(part)
        if not tokens:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        flat, counts = self._bytes(np.concatenate(tokens), np.concatenate(counts))
        rows = np.concatenate(rows)
        number = np.zeros(len(words), np.int64)
        number[rows] = counts
        bounds = np.append(0, np.cumsum(number))
        begin = np.append(0, np.cumsum(counts))[:-1]
        out = np.empty(len(flat), np.int32)
        out[_ranges(bounds[rows], counts)] = flat[_ranges(begin, counts)]
        return out, bounds

    def _bytes(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points without a piece become the pieces of their UTF-8 bytes."""
        lone = tokens < 0
        if not lone.any():
            return tokens, counts
        point = np.where(lone, -1 - tokens, 0)
        size = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        total = np.append(0, np.cumsum(size))
        bounds = total[np.append(0, np.cumsum(counts))]
        at = np.repeat(np.arange(len(tokens)), size)
        nth = np.arange(len(at)) - total[at]
        shift = 6 * (size[at] - 1 - nth)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[at]]
        bits = point[at] >> shift
        value = np.where(size[at] == 1, bits, np.where(nth == 0, lead | bits, 0x80 | (bits & 0x3F)))
        return np.where(lone[at], self.byte[value & 0xFF], tokens[at]).astype(np.int32), np.diff(bounds)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts end to end and the n + 1 bounds."""
        number: dict[str, int] = {}
        owned: list[int] = []
        stops = [0]
        for text in texts:
            if text:
                line = f" {text}" if self.prefix else text
                owned += [number.setdefault(w, len(number)) for w in self._cut(line)]
            stops.append(len(owned))
        tokens, bounds = self.encode_words(list(number))
        which = np.array(owned, np.int64)
        counts = np.diff(bounds)[which] if len(which) else which
        ends = np.append(0, np.cumsum(counts))
        return tokens[_ranges(bounds[which], counts)] if len(which) else tokens[:0], ends[np.array(stops)]

    def _cut(self, line: str) -> list[str]:
        words = _WORD.findall(line)
        if line[0] != " ":
            words.insert(0, line.split(" ", 1)[0])
        if max(map(len, words)) <= _LONG:
            return words
        out = []
        for word in words:
            begin = 0
            if len(word) > _LONG:
                for i in range(1, len(word)):
                    if word[i - 1 : i + 1] not in self.together:
                        out.append(word[begin:i])
                        begin = i
            out.append(word[begin:])
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of token sequences; bytes that are no UTF-8 become U+FFFD."""
        text, all_ids, cuts = self.text, ids.tolist(), bounds.tolist()
        drop = 1 if self.prefix else 0
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            line = b"".join([text[i] for i in all_ids[a:b]])
            out.append((line[drop:] if line[:1] == b" " else line).decode("utf-8", "replace"))
        return out


def _ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``begin``, one after the other."""
    shift = begin - np.append(0, np.cumsum(counts))[:-1]
    return np.repeat(shift, counts) + np.arange(int(counts.sum()))


def _encode(table, check: bool):
    def encode(batches):
        pieces = Pieces(**table.value)
        for batch in slices(batches, 1_500_000):
            ids, bounds = pieces.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            columns = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "ids": lists}
            if check:
                columns["decoded"] = pa.array(pieces.decode(ids, bounds), pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return encode


def _decode(table):
    def decode(batches):
        pieces = Pieces(**table.value)
        for batch in batches:
            lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            lengths = lists.value_lengths().to_numpy().astype(np.int64)
            texts = pieces.decode(lists.flatten().to_numpy(), np.append(0, np.cumsum(lengths)))
            keep = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return decode


def encode(
    docs: DataFrame,
    model: str = MODEL,
    id_col: str = "doc_id",
    text_col: str = "text",
    search: str | None = None,
    decoded: bool = False,
) -> DataFrame:
    """(doc_id, text, ids) for every row of ``docs``; a null or empty text has no tokens.

    ``search`` is ``"viterbi"``, ``"merge"`` or, by default, the model's own.
    With ``decoded`` the ids are decoded again in the same pass, as ``decode``
    does.

    The model's file is read on the driver; its table, of a vocabulary's size,
    is broadcast. A word is a run of spaces and what follows up to the next
    space, and is searched as a whole, however long.
    """
    held = docs.sparkSession.sparkContext.broadcast(vars(Pieces.load(model, search)))
    rows = keyed_texts(docs, id_col, text_col)
    more = ", decoded string" if decoded else ""
    return rows.mapInArrow(_encode(held, decoded), f"{_ddl(rows)}, ids array<int>{more}")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``; null ids give an empty text.

    Ids outside of the vocabulary are an error. ``rows`` must not have a
    column ``decoded``.
    """
    held = rows.sparkSession.sparkContext.broadcast(vars(Pieces.load(model)))
    return rows.mapInArrow(_decode(held), f"{_ddl(rows)}, decoded string")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(documents(spark, sf_dir), decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
