"""Removal of word sequences that occur more than once, located with Aho-Corasick automata (8)."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.llm.repeats import referenced, repeated_starts, unpack
from playtally.llm.shared import documents, keyed_texts, slices, text_bytes

LENGTH = 35
#: Words of an anchor; any value gives the same result.
GRAM = 8
#: Text that a shard of documents holds, and so the bound of its automaton.
SHARD_BYTES = 2_000_000


def split(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, and where each text's words end."""
    data, ends = text_bytes(column)
    raw, cuts = data.tobytes(), ends.tolist()
    words: list[bytes] = []
    stops = [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        words += raw[a:b].split()
        stops.append(len(words))
    return words, np.array(stops, np.int64)


def word_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, stops = split(column)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), stops


def phrase_automaton(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """Automaton of the word sequences at ``begins`` to ``ends``; None without any."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        automaton.add_word(tuple(ids[a:b].tolist()), b - a)
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def occurrences(automaton, ids: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which words lie in a phrase, by streaming every document through the automaton."""
    edge = np.zeros(len(ids) + 1, np.int64)
    if automaton is not None:
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            for last, size in automaton.iter(tuple(ids[a:b].tolist())):
                edge[a + last + 1 - size] += 1
                edge[a + last + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _kept(length: int):
    def cut(batches):
        for batch in slices(batches, SHARD_BYTES):
            words, stops = split(batch.column("text"))
            number: dict[bytes, int] = {}
            ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
            places = batch.column("places")
            doc = np.repeat(
                np.arange(len(places)),
                places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
            )
            low, count, _ = unpack(places.flatten().to_numpy(zero_copy_only=False))
            begins = stops[doc] + low
            # Phrases without a word that ends a document; each text of the shard is searched for all of them.
            automaton = phrase_automaton(ids, begins, begins + count - 1 + length)
            gone = occurrences(automaton, ids, stops)
            total = np.append(0, np.cumsum(gone))
            bounds = stops.tolist()
            keep = (~gone).tolist()
            kept = [
                b" ".join([w for w, k in zip(words[a:b], keep[a:b], strict=True) if k])
                for a, b in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(stops)),
                    pa.array(np.diff(total[stops])),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return cut


def remove_phrases(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_removed, kept).

    Every word that lies in ``length`` consecutive words of one text that also
    start anywhere else is removed; ``kept`` joins the other words by a space.
    Words are parted by ASCII white space and compared as they are. A null text
    has no words; shorter texts lose none. Equal rows are repeats of each
    other. Other columns are ignored.

    Recurring passages are confirmed over the whole collection. Each shard of
    documents is sent the passages that occur in it, compiles them into one
    Aho-Corasick automaton over words and streams all its documents through
    it. An automaton so never exceeds its shard's text, and the work grows with
    the text, not with shards times documents. Passages are short spans, fewer
    than ``length`` of which can end at one word.
    """
    docs = referenced(keyed_texts(docs, id_col, text_col))
    places = repeated_starts(docs, word_units, length, min(gram, length), 1)
    return docs.join(places, "ref", "left").mapInArrow(
        _kept(length), "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_phrases(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """The same by a dictionary of all windows, for tests."""
    seen: dict[tuple, int] = {}
    for t in texts:
        words = t.split()
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for t in texts:
        words = t.split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if seen[tuple(words[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
