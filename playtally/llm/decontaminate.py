"""Benchmark items found in documents with a generalised suffix automaton (6)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.llm.shared import documents, keyed_texts, packed, schema_with, slices, stored, text_bytes, with_text

WINDOW = 10
#: Share of a text's words above which it is removed whole.
COVERAGE = 0.5
#: Item words in one automaton, which takes some 0.7 KB a word in every worker: 140 MB.
#: More items are dealt to several automata, each a pass of its own, so driver and
#: workers hold no more than one.
AUTOMATON_WORDS = 200_000

# Words are runs of digits, letters and non-ASCII characters, in lower case.
_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """A suffix automaton of several word sequences.

    A state stands for the words sequences that end at the same places of the
    items; ``longest`` is the length of the longest of them and ``link`` the
    state of the longest suffix with other ends. ``items`` gives the items in
    which a state's sequences occur, ``whole`` the short items that end there.
    """

    window: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    items: list[set[str]] = field(default_factory=lambda: [set()])
    whole: dict[int, tuple[int, list[str]]] = field(default_factory=dict)
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        self.items.append(set())
        return len(self.step) - 1

    def _extend(self, last: int, word: int) -> int:
        """State of ``last``'s sequence followed by ``word``."""
        had = self.step[last].get(word)
        if had is not None and self.longest[had] == self.longest[last] + 1:
            return had
        new = -1 if had is not None else self._state(self.longest[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][word]
            if self.longest[target] == self.longest[at] + 1:
                parent = target
            else:
                parent = self._state(self.longest[at] + 1, dict(self.step[target]), self.link[target])
                self.link[target] = parent
                while at >= 0 and self.step[at].get(word) == target:
                    self.step[at][word] = parent
                    at = self.link[at]
            if new < 0:
                return parent
            self.link[new] = parent
        return new

    @classmethod
    def of(cls, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> Automaton:
        """Items without words are left out."""
        auto = cls(window)
        numbered = [
            (item, [auto.vocabulary.setdefault(w, len(auto.vocabulary)) for w in text]) for item, text in items if text
        ]
        for _, text in numbered:
            state = 0
            for word in text:
                state = auto._extend(state, word)
        # Where items end and pass by, on the finished automaton.
        for item, text in numbered:
            state = 0
            for word in text:
                state = auto.step[state][word]
                auto.items[state].add(item)
            if len(text) < window:
                length, ids = auto.whole.setdefault(state, (len(text), []))
                ids.append(item)
        for state in sorted(range(1, len(auto.step)), key=lambda s: -auto.longest[s]):
            if auto.link[state] > 0:
                auto.items[auto.link[state]] |= auto.items[state]
        return auto

    def short(self) -> tuple[list[int], int]:
        """For each state the nearest one up its links where a short item ends, and the shortest item's length."""
        near = [-1] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=lambda s: self.longest[s]):
            near[state] = state if state in self.whole else near[self.link[state]]
        return near, min((n for n, _ in self.whole.values()), default=self.window)

    def pairs(self) -> np.ndarray:
        """Neighbouring words of all items, as sorted numbers."""
        size = len(self.vocabulary)
        found = {a * size + b for a, first in self.step[0].items() for b in self.step[first]}
        return np.array(sorted(found), np.int64)


class Matcher:
    """Follows documents through an automaton."""

    def __init__(self, automaton: Automaton):
        self.auto = automaton
        self.near, self.least = automaton.short()
        self.pairs = automaton.pairs()
        self.found: dict[int, frozenset[int]] = {}

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that can hold a window: known words whose neighbours also follow each other in some item."""
        if self.least == 1:
            known = ids >= 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
            return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        size = len(self.auto.vocabulary)
        both = ids[:-1] * size + ids[1:]
        at = np.searchsorted(self.pairs, both)
        known = np.zeros(len(ids) + 1, np.int8)
        if len(self.pairs):
            ok = self.pairs[np.minimum(at, len(self.pairs) - 1)] == both
            known[1:-1] = ok & (ids[:-1] >= 0) & (ids[1:] >= 0)
        edge = np.flatnonzero(np.diff(known))
        first, last = edge[::2], edge[1::2]
        keep = last - first >= self.least - 1
        return list(zip(first[keep].tolist(), (last[keep] + 1).tolist(), strict=True))

    def hits(self, ids: list[int], begin: int) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of hit words, and the items with a window in ``ids``."""
        auto, window = self.auto, self.auto.window
        step, link, longest = auto.step, auto.link, auto.longest
        state, length, ranges, items = 0, 0, [], set()
        for i, word in enumerate(ids, begin + 1):
            while state and word not in step[state]:
                state = link[state]
                length = longest[state]
            state = step[state].get(word, 0)
            length = length + 1 if state else 0
            if length >= window:
                ranges.append((i - window, i))
                top = state
                while longest[link[top]] >= window:
                    top = link[top]
                items |= auto.items[top]
            # Short items that end here; the nearest one may be longer than the match.
            end = self.near[state]
            while end > 0:
                size, own = auto.whole[end]
                if size <= length:
                    ranges.append((i - size, i))
                    items.update(own)
                end = self.near[link[end]] if link[end] > 0 else -1
        return ranges, items


def _scan(shards):
    """(document words, hit ranges, items) of each row for one shard's broadcast items."""

    def scan(batches):
        matcher = Matcher(Automaton.of(shards.value[1], shards.value[0]))
        vocabulary = matcher.auto.vocabulary
        for batch in slices(batches, 4_000_000):
            data, ends = text_bytes(batch.column("text"))
            raw = data.tobytes().translate(_WORD_BYTES)
            rows: dict[str, list] = {"n_words": [], "ranges": [], "items": []}
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                text = raw[a:b].split()
                ids = np.fromiter([vocabulary.get(w, -1) for w in text], np.int64, len(text))
                ranges, items = [], set()
                for begin, end in matcher.stretches(ids) if len(ids) else ():
                    more, own = matcher.hits(ids[begin:end].tolist(), begin)
                    ranges += more
                    items |= own
                rows["n_words"].append(len(text))
                rows["ranges"].append([x for r in _merged(ranges) for x in r])
                rows["items"].append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(rows["n_words"], pa.int64()),
                    pa.array(rows["ranges"], pa.list_(pa.int64())),
                    pa.array(rows["items"], pa.list_(pa.string())),
                ],
                names=["doc_id", "row", "n_words", "ranges", "items"],
            )

    return scan


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _texts_of(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return items.select(
        F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")
    ).dropna()


def _shard_count(items: DataFrame, item_col: str, text_col: str, automaton_words: int) -> int:
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    # A word takes two bytes at least, with what parts it from the next.
    return max(1, -(-_texts_of(items, item_col, text_col).agg(size).first()[0] // (2 * automaton_words)))


def _shards(docs: DataFrame, items: DataFrame, item_col: str, text_col: str, automaton_words: int):
    """The items' words, shard by shard."""
    shards = _shard_count(items, item_col, text_col, automaton_words)
    items = _texts_of(items, item_col, text_col)
    for shard in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).sort("item_id", "text").collect()
        yield [(i, words(t.encode())) for i, t in own]


_SCHEMA = "doc_id bigint, row bigint, n_words bigint, ranges array<bigint>, items array<string>"


def matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, ranges, items).

    ``ranges`` holds begin and end of the stretches of words that lie in an
    occurrence of a window, in order: ``window`` consecutive words of an item,
    or all words of a shorter one. ``items`` are the ids, as sorted strings, of the
    items with such an occurrence; ids may be of any type that casts to a string. Null and empty texts have no words; items without words and
    null items match nothing. Equal items are all reported. Other columns of
    either frame are ignored.

    One automaton serves all documents in one pass without a shuffle. Items of
    more than ``automaton_words`` words in total take several automata and as
    many passes, joined per document.
    """
    if window < 1:
        raise ValueError("window must be positive")
    docs = keyed_texts(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    parts = []
    for own in _shards(docs, items, item_col, item_text_col, automaton_words):
        held = docs.sparkSession.sparkContext.broadcast((window, own))
        parts.append(docs.mapInArrow(_scan(held), _SCHEMA))
    if len(parts) == 1:
        return parts[0].drop("row")
    every = parts[0].withColumn("first", F.lit(True))
    for more in parts[1:]:
        every = every.unionByName(more.withColumn("first", F.lit(False)))
    joined = every.groupBy("doc_id", "row", "n_words").agg(
        F.flatten(F.collect_set("ranges")).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if("first").alias("times"),
    )
    return joined.withColumn("n", F.explode(F.expr("sequence(1, times)"))).mapInArrow(
        _merge, "doc_id bigint, n_words bigint, ranges array<bigint>, items array<string>"
    )


def _merge(batches):
    for batch in batches:
        found = []
        for flat in batch.column("found").to_pylist():
            found.append([x for r in _merged(list(zip(flat[::2], flat[1::2], strict=True))) for x in r])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(found, pa.list_(pa.int64())), batch.column("items")],
            names=["doc_id", "n_words", "ranges", "items"],
        )


_find_words = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").finditer


def _without(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``text`` without the words of merged ``ranges``, and their number."""
    spans, parts, last, gone = [m.span() for m in _find_words(text)], [], 0, 0
    for begin, end in ranges:
        gone += end - begin
        parts.append(text[last : spans[begin][0]])
        last = spans[end - 1][1]
    return b" ".join([*parts, text[last:]]), gone


def _cleaned(held, coverage: float):
    def clean(batches):
        matcher = Matcher(Automaton.of(held.value[1], held.value[0]))
        vocabulary = matcher.auto.vocabulary
        for batch in slices(batches, 4_000_000):
            data, ends = text_bytes(batch.column("text"))
            raw = data.tobytes()
            texts, stay = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
            for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                text, gone, total = raw[a:b], 0, None
                # What is left may make a window anew.
                while True:
                    ids = np.fromiter([vocabulary.get(w, -1) for w in words(text)], np.int64)
                    total = len(ids) if total is None else total
                    ranges = [
                        r
                        for begin, end in (matcher.stretches(ids) if len(ids) else ())
                        for r in matcher.hits(ids[begin:end].tolist(), begin)[0]
                    ]
                    if not ranges:
                        break
                    text, more = _without(text, _merged(ranges))
                    gone += more
                if gone:
                    texts[row], stay[row] = text.decode(), gone <= coverage * total
            kept = pa.array(texts, pa.string())
            out = pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), kept], names=["row", "text", "kept"]
            )
            yield out.filter(pa.array(stay))

    return clean


def _removed(batches):
    for batch in batches:
        kept, gone = [], []
        rows = zip(batch.column("kept").to_pylist(), batch.column("ranges").to_pylist(), strict=True)
        for text, flat in rows:
            text, more = _without(text.encode(), list(zip(flat[::2], flat[1::2], strict=True)))
            kept.append(text.decode())
            gone.append(more)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(kept, pa.string()), batch.column("total"), pc.add(batch.column("gone"), pa.array(gone, pa.int64()))],
            names=_CHANGED,
        )


_CHANGED = ["key", "kept", "total", "gone"]


def _changed_texts(texts: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(key, kept, total, gone) of the ``texts`` (key, kept) that any shard of items hits.

    Every round removes the union of what all shards find in the same text;
    changed texts go through the next one, until nothing is found.
    """
    left, done = texts.withColumn("gone", F.lit(0).cast("bigint")), None
    while True:
        found = matches(left.select("key", "kept"), items, id_col="key", text_col="kept", **options)
        found = found.where(F.size("ranges") > 0).select(F.col("doc_id").alias("key"), F.col("n_words").alias("n"), "ranges")
        hit = left.join(found, "key")
        hit = hit.withColumn("total", F.col("total") if done is not None else F.col("n")).select(*_CHANGED, "ranges")
        hit = stored(hit.mapInArrow(_removed, "key bigint, kept string, total bigint, gone bigint"), "cleaned")
        if hit.isEmpty():
            return hit if done is None else done
        if done is not None:
            done = done.join(hit.select("key"), "key", "left_anti").unionByName(hit)
        done = stored(done, "changed") if done is not None else hit
        left = hit


def clean(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """``docs`` without the spans of words that lie in a window of some item.

    A text of whose words more than ``coverage`` are removed is dropped whole.
    Other rows stay as they are, with ``n_chars`` made to fit. Items that take
    several automata give what one for all of them would.
    """
    rows = packed(docs, id_col, text_col).select("row", "text")
    if _shard_count(items, item_col, item_text_col, automaton_words) == 1:
        (own,) = _shards(docs, items, item_col, item_text_col, automaton_words)
        held = docs.sparkSession.sparkContext.broadcast((window, own))
        changed = rows.mapInArrow(_cleaned(held, coverage), schema_with(rows, "text string, kept string"))
        return with_text(changed, "kept", docs.columns, text_col)
    keyed = rows.withColumn("key", F.xxhash64("text"))
    texts = keyed.select("key", F.col("text").alias("kept")).dropna().dropDuplicates(["key"])
    found = _changed_texts(
        texts, items, window=window, item_col=item_col, item_text_col=item_text_col, automaton_words=automaton_words
    )
    joined = keyed.join(found.withColumnRenamed("kept", "left"), "key", "left")
    stay = F.col("gone").isNull() | (F.col("gone") <= F.lit(coverage) * F.col("total"))
    return with_text(joined.where(stay).withColumn("kept", F.coalesce("left", "text")), "kept", docs.columns, text_col)


def hit_words(ranges: str = "ranges"):
    """Number of words in ``ranges``."""
    signed = f"transform({ranges}, (x, i) -> if(i % 2 = 0, -x, x))"
    return F.expr(f"aggregate({signed}, 0L, (s, x) -> s + x)")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join("items", ",")
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


def brute_force(texts: list[bytes], items: list[tuple[object, bytes]], window: int = WINDOW):
    """The same by a dictionary of windows, for tests."""
    grams: dict[tuple, set[int]] = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1)) if own else ():
            grams.setdefault(tuple(own[i : i + window]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for text in texts:
        own, hit, ids = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if (got := grams.get(tuple(own[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    ids |= got
        names = ",".join(sorted(map(str, ids)))
        out.append((len(own), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out
