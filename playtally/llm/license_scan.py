"""Licence notices and texts in documents, by Dice coefficient over word bigrams (2)."""

from __future__ import annotations

from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.llm.shared import documents, keyed_texts, slices, text_bytes

THRESHOLD = 0.8
#: The template table is one of licences, not of documents; its rows are sent to every task.
MAX_TEMPLATES = 10_000

# Public notices and licence texts.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are ASCII letters and digits in lower case; all else parts them.
_WORDS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Matcher:
    """Templates by the sizes of texts that can be like them."""

    def __init__(self, templates: list[tuple[str, int, str]], threshold: float):
        self.threshold = threshold
        ratio = threshold / (2 - threshold)
        self.by_size: dict[int, list[tuple[str, int, frozenset]]] = {}
        for name, number, text in templates:
            own = words(text.encode())
            grams = frozenset(zip(own, own[1:], strict=False))
            # A small margin for rounding; the coefficient itself decides.
            low, high = max(1, ceil(len(grams) * ratio - 1e-6)), floor(len(grams) / ratio + 1e-6)
            for size in range(low, high + 1) if grams else ():
                self.by_size.setdefault(size, []).append((name, number, grams))
        self.least, self.most = min(self.by_size, default=1), max(self.by_size, default=0)

    def matches(self, own: list[bytes]) -> list[tuple[str, int, float]]:
        """(license_id, template_id, dice) of a text's words."""
        if len(own) <= self.least:
            return []
        # A long text is given up as soon as it has too many bigrams.
        grams: set[tuple[bytes, bytes]] = set()
        step = self.most + 1
        for at in range(0, len(own) - 1, step):
            grams.update(zip(own[at : at + step], own[at + 1 : at + step + 1], strict=False))
            if len(grams) > self.most:
                return []
        out = []
        for name, number, marks in self.by_size.get(len(grams), ()):
            dice = 2 * len(grams & marks) / (len(grams) + len(marks))
            if dice >= self.threshold:
                out.append((name, number, dice))
        return out


def _scan(held):
    def scan(batches):
        matcher = Matcher(*held.value)
        for batch in slices(batches, 4_000_000):
            data, ends = text_bytes(batch.column("text"))
            raw, cuts = data.tobytes(), ends.tolist()
            rows, found = [], []
            for row, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                lines = [words(x) for x in raw[a:b].split(b"\n")]
                whole = [w for x in lines for w in x]
                for number, own in enumerate([whole, *(lines if len(lines) > 1 else ())]):
                    for match in matcher.matches(own):
                        rows.append(row)
                        found.append((number, *match))
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                ],
                names=["doc_id", "line", "license_id", "template_id", "dice"],
            )

    return scan


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, template_id, text)."""
    rows = [(name, i, text) for i, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    return spark.createDataFrame(rows, "license_id string, template_id int, text string")


def scan(
    docs: DataFrame,
    templates: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, line, license_id, template_id, dice) of all matches.

    Each line of a text, and the whole text as line 0, is compared with every
    template whose number of distinct bigrams allows a Dice coefficient of
    ``threshold`` or more: a set of n bigrams can only reach it with one of
    n * t / (2 - t) to n * (2 - t) / t. A text of one line is compared once,
    as line 0. Null and empty texts, and lines below two words, match nothing.
    Equal templates match side by side; repeated rows are each reported. More
    than ``MAX_TEMPLATES`` templates are an error.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    size = templates.count()
    if size > MAX_TEMPLATES:
        raise ValueError(f"{size} templates; at most {MAX_TEMPLATES} are sent to every task")
    rows = [tuple(r) for r in templates.select("license_id", "template_id", "text").dropna().collect()]
    held = docs.sparkSession.sparkContext.broadcast((rows, threshold))
    return keyed_texts(docs, id_col, text_col).mapInArrow(
        _scan(held), "doc_id bigint, line int, license_id string, template_id int, dice double"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match for each document and licence."""
    found = scan(documents(spark, sf_dir), template_table(spark))
    return found.groupBy("doc_id", "license_id").agg(
        F.max("dice").alias("dice"), F.countDistinct("line").alias("n_lines"), F.min("line").cast("bigint").alias("first_line")
    )


def _sql() -> str:
    values = ", ".join(
        f"('{name}', {i}, '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES)
    )
    words = "list_filter(string_split(regexp_replace(translate({0}, '%s', '%s'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')" % (
        _UPPER,
        _LOWER,
    )
    grams = "list_distinct(list_transform(list_zip({0}[:-2], {0}[2:]), lambda p: p[1] || ' ' || p[2]))"
    return f"""
WITH t0(license_id, template_id, text) AS (VALUES {values}),
t1 AS (SELECT license_id, template_id, {words.format("text")} AS w FROM t0),
t AS (SELECT license_id, template_id, {grams.format("w")} AS t_grams FROM t1),
d0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
d1 AS (SELECT doc_id, CASE WHEN len(l) > 1 THEN list_concat([text], l) ELSE [text] END AS u FROM d0),
d2 AS (SELECT doc_id, unnest(u) AS unit, unnest(range(len(u))) AS line FROM d1),
d3 AS (SELECT doc_id, line, {words.format("unit")} AS w FROM d2),
d AS (SELECT doc_id, line, {grams.format("w")} AS grams FROM d3 WHERE len(w) > 1),
m AS (
  SELECT doc_id, line, license_id,
    (2 * len(list_intersect(grams, t_grams)))::DOUBLE / (len(grams) + len(t_grams)) AS dice
  FROM d JOIN t ON len(t_grams) >= len(grams) * {THRESHOLD / (2 - THRESHOLD)} - 1e-6
    AND len(t_grams) <= len(grams) / {THRESHOLD / (2 - THRESHOLD)} + 1e-6
)
SELECT doc_id, license_id, max(dice) AS dice, count(DISTINCT line) AS n_lines, min(line)::BIGINT AS first_line
FROM m WHERE dice >= {THRESHOLD} GROUP BY ALL
"""


ORACLE_SQL = _sql()
