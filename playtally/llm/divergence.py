"""How the sources of a language differ: smoothed term shares, compared over run-length encoded columns."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtally.llm.shared import documents, slices, stored, text_batches, text_bytes

MIN_DOCS = 30
TOP_TERMS = 50
#: Terms times sources of a block of the vocabulary, so that a language of few sources spreads too.
CELLS = 1 << 15
#: Terms of a block for each source at least, as a block sends a row for each pair of sources.
TERMS_OF_SOURCE = 8
#: Distinct (group, term) pairs that a task counts before it hands them on.
HELD_TERMS = 200_000
_SLICE_BYTES = 8_000_000
_find_terms = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
#: Begins the term of a row that stands for a group; no term has it.
_GROUP = b"\x01"


def _counts(batches):
    """(lang, source, term, n, docs) of a task's documents, pre-aggregated; a row of term \\x01 + source per group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed():
        for (lang, source), (n, docs) in held.items():
            terms = [_GROUP + source.encode(), *n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(docs[t] for t in n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in slices(batches, _SLICE_BYTES):
        data, ends = text_bytes(batch.column("text"))
        raw, ends = data.tobytes(), ends.tolist()
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for row, group in enumerate(groups):
            n, docs = held.setdefault(group, (Counter(), Counter()))
            terms = _find_terms(raw[ends[row] : ends[row + 1]].lower())
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) + len(held) > HELD_TERMS:
            yield from flushed()
    yield from flushed()


def term_counts(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(lang, source, term, n, total): occurrences of each kept term in each group and in the language.

    Kept are the terms in at least ``min_docs`` documents of their language.
    Null text, language and source are ''. A group without kept terms, and every
    other group too, has one row of null ``term``. The outcome is stored.
    """
    text_batches(docs.sparkSession)
    text = [
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
        for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))
    ]
    counted = docs.select(*text).mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint")
    # One exchange serves the sums of groups and those of languages. A group's own row goes by its source.
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source")
    summed = summed.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    summed = summed.withColumn("in_docs", F.sum("docs").over(whole)).withColumn("total", F.sum("n").over(whole))
    group = F.col("term").startswith(_GROUP.decode())
    kept = summed.where(group | (F.col("in_docs") >= F.lit(min_docs)))
    return stored(kept.select("lang", "source", F.when(~group, F.col("term")).alias("term"), "n", "total"), "terms")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(1000000000 * (n + 5) / (total + 5 * terms)), exact in 64 bits up to 2.8e14 tokens."""
    a, d = f"(({n} + 5) * 31250)", f"({total} + 5 * {terms})"
    return F.expr(f"1L + ({a} div {d}) * 32000L + (({a} % {d}) * 32000L) div {d}")


def groups_of(counts: DataFrame, cells: int = CELLS) -> DataFrame:
    """(lang, source, place, n_group, n_lang, terms, sources, blocks) of every group of ``term_counts``; stored.

    ``blocks`` is the number of parts that a language's vocabulary takes, so that a
    part's terms times the sources are about ``cells``, or what the pairs of very
    many sources warrant.
    """
    groups = counts.where("term is null").select("lang", "source")
    own = counts.where("term is not null").groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    # A term's total is in the row of each of its sources; the first row stands for the term.
    terms = (
        counts.where("term is not null")
        .groupBy("lang", "term")
        .agg(F.first("total").alias("total"))
        .groupBy("lang")
        .agg(F.count("*").alias("terms"), F.sum("total").alias("n_lang"))
    )
    whole = Window.partitionBy("lang")
    found = (
        groups.join(own, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .select(
            "lang",
            "source",
            (F.row_number().over(whole.orderBy("source")) - 1).alias("place"),
            F.coalesce("n_group", F.lit(0)).alias("n_group"),
            F.coalesce("n_lang", F.lit(0)).alias("n_lang"),
            F.coalesce("terms", F.lit(0)).alias("terms"),
            F.count("*").over(whole).alias("sources"),
        )
    )
    blocks = F.expr(f"1 + (terms * sources) div greatest({cells}L, {TERMS_OF_SOURCE} * sources * sources)")
    return stored(found.withColumn("blocks", blocks), "groups")


def runs(columns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Run-length encoded columns of a table (terms x sources): begins and values of each column's runs.

    Terms are first put in the order that clusters equal values: sorted by the
    column of fewest distinct values, within its runs by the next, and so on, as
    then the leading columns fall into few runs.
    """
    distinct = [len(np.unique(columns[:, j])) for j in range(columns.shape[1])]
    by = np.argsort(distinct, kind="stable")
    ordered = columns[np.lexsort([columns[:, j] for j in by[::-1]])]
    out = []
    for j in range(columns.shape[1]):
        column = ordered[:, j]
        begins = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1))
        out.append((begins, column[begins]))
    return out


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], terms: int) -> int:
    """Sum of absolute differences of two encoded columns, one product per stretch in which both are constant."""
    begins = np.union1d(a[0], b[0])
    lengths = np.diff(begins, append=terms)
    p = a[1][np.searchsorted(a[0], begins, "right") - 1]
    q = b[1][np.searchsorted(b[0], begins, "right") - 1]
    return int((np.abs(p - q) * lengths).sum())


def _block(sources: list[str], absent: np.ndarray, terms: np.ndarray, places: np.ndarray, shares: np.ndarray):
    """(source, item, value) for the pairs of ``sources`` over the terms of one block."""
    size = int(terms[-1]) + 1 if len(terms) else 0
    table = np.tile(absent, (size, 1))
    table[terms, places] = shares
    encoded = runs(table) if size else []
    first, second, values = [], [], []
    for a in range(len(sources)):
        for b in range(a + 1, len(sources)):
            value = difference(encoded[a], encoded[b], size) if size else 0
            first += (sources[a], sources[b])
            second += (sources[b], sources[a])
            values += (value, value)
    return first, second, values


def _pairs(batches):
    """Sums over blocks that come as sorted rows (lang, block, term, place, source, share), sources (null term) first."""
    key, parts = None, []

    def closed():
        rows = pa.Table.from_batches(parts).combine_chunks()
        heads = rows.column("term").null_count
        head, body = rows.slice(0, heads), rows.slice(heads)
        # Rows come sorted by term: a change of the term begins the next one.
        names = body.column("term").combine_chunks()
        codes = names.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(names) else np.empty(0, np.int64)
        first, second, values = _block(
            head.column("source").to_pylist(),
            head.column("share").to_numpy(),
            codes,
            body.column("place").to_numpy(),
            body.column("share").to_numpy(),
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]] * len(first), pa.string()),
                pa.array(first, pa.string()),
                pa.array(second, pa.string()),
                pa.array(values, pa.int64()),
            ],
            names=["lang", "source", "item", "value"],
        )

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        code, block = langs.indices.to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            now = (langs[a].as_py(), int(block[a]))
            if now != key:
                if parts:
                    yield closed()
                key, parts = now, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield closed()


_ROWS = ["lang", "block", "term", "place", "source", "share"]


def pair_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language.

    The vocabulary is dealt to blocks by hash; a block, with the list of its
    language's sources, is what one task holds. Blocks' sums are added up.
    """
    absent = F.when(F.col("terms") == 0, F.lit(1).cast("bigint")).otherwise(share("0", "n_group", "terms"))
    heads = groups.select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block")).select(
        "lang", "block", F.lit(None).cast("string").alias("term"), "place", "source", absent.alias("share")
    )
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    body = entries.select("lang", block.alias("block"), "term", "place", F.lit(None).cast("string").alias("source"), "share")
    rows = heads.unionByName(body).repartition("lang", "block").sortWithinPartitions("lang", "block", "term", "place")
    found = rows.select(*_ROWS).mapInArrow(_pairs, "lang string, source string, item string, value bigint")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cells: int = CELLS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source of a language apart.

    A kept term (in ``min_docs`` documents of the language) has in each group, and
    in the language as a whole, the share 1 + floor(10^9 * (n + 5) / (N + 5 * V)).
    Part ``pair`` gives for each other source the sum of absolute differences over
    all kept terms; part ``term`` the ``top`` terms whose share in the group exceeds
    that in the language most. Ranks go by value, ties by item (UTF-8).

    Null text, language and source are ''; groups without terms and languages
    without kept terms have pairs (of value 0, if no term is kept) and no terms.
    Repeated rows count as often as they stand there. No rows give no rows.
    Other columns are ignored.
    """
    counts = term_counts(docs, min_docs, text_col, lang_col, source_col)
    groups = groups_of(counts, cells)
    entries = counts.where("term is not null").join(groups, ["lang", "source"])
    entries = entries.select("*", share("n", "n_group", "terms").alias("share"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(entries, groups)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    over = F.col("share") - share("total", "n_lang", "terms")
    terms = entries.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value"))
    terms = terms.where("value > 0").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: every pair of sources, and 50 terms of each."""
    return audit(documents(spark, sf_dir))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
n AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n_lang FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS n_group FROM n GROUP BY lang, source),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(s.n_group, 0) + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n_lang + 5 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
sides AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sides s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""


def brute_force(rows: list[tuple], min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> list[tuple]:
    """The same of (text, lang, source) by dictionaries, for tests."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts: dict[tuple[str, str], Counter] = {}
    seen: dict[str, Counter] = {}
    for text, lang, source in rows:
        terms = [t.decode() for t in _find_terms(text.encode().lower())]
        counts.setdefault((lang, source), Counter()).update(terms)
        seen.setdefault(lang, Counter()).update(set(terms))
    kept = {lang: sorted(t for t, n in own.items() if n >= min_docs) for lang, own in seen.items()}

    def shares(lang: str, own: Counter) -> dict[str, int]:
        total = sum(own[t] for t in kept[lang]) + 5 * len(kept[lang])
        return {t: 1 + 10**9 * (own[t] + 5) // total for t in kept[lang]}

    p = {group: shares(group[0], own) for group, own in counts.items()}
    out = []
    for (lang, source), own in counts.items():
        whole = shares(lang, sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        mine = p[lang, source]
        pairs = [
            (sum(abs(mine[t] - p[lang, b][t]) for t in kept[lang]), b) for (x, b) in counts if x == lang and b != source
        ]
        terms = [(mine[t] - whole[t], t) for t in kept[lang] if own[t] and mine[t] > whole[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found, 1)]
    return out
