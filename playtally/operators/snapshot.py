"""Snapshots: export, validation, migration and additive restore.

A snapshot is raw counters per minute, player and device (``grain``,
``minute_ms`` or ``name``, counters). Restoring adds, so a snapshot may come in
any number of documents: the export writes one per day and one per label
bucket instead of a single text that grows with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.functions.counters import all_used, merge_aggs, used
from playtally.functions.members import is_integer, is_object, is_text, let, member
from playtally.functions.minutes import calendar, day_of
from playtally.operators import rollups
from playtally.operators.validate import parse_whole
from playtally.schema import COUNTERS

# Document versions and the counters later versions added.
VERSION = 2
OLDEST_VERSION = 1
ADDED_IN = {"buffer_samples": 2}

# Calendar fields of a minute entry with their ranges.
CALENDAR = (("y", 1970, 9999), ("mo", 1, 12), ("d", 1, 31), ("h", 0, 23), ("mi", 0, 59))

SECTIONS = {"players": "player", "devices": "device"}

# Typed form of a document whose members all have the right JSON types.
_M = "m:struct<{}>".format(",".join(f"{c}:bigint" for c in COUNTERS))
_TYPED_DOC = (
    "struct<version:bigint,minutes:array<struct<{},{m}>>,players:array<struct<name:string,{m}>>,"
    "devices:array<struct<name:string,{m}>>>"
).format(",".join(f"{name}:bigint" for name, _, _ in CALENDAR), m=_M)

# JSON type of such a document; members come in alphabetical order.
_M_TYPE = rf"m: OBJECT<(?:(?:{'|'.join(COUNTERS)}): BIGINT(?:, )?+)++>"
_SEGMENT_TYPE = rf"ARRAY<(?:VOID|OBJECT<{_M_TYPE}, name: STRING>)>"
_MINUTE_TYPE = rf"ARRAY<(?:VOID|OBJECT<d: BIGINT, h: BIGINT, {_M_TYPE}, mi: BIGINT, mo: BIGINT, y: BIGINT>)>"
_DOC_TYPE = (
    rf"^OBJECT<(?:devices: {_SEGMENT_TYPE}, )?+(?:minutes: {_MINUTE_TYPE}, )?+"
    rf"(?:players: {_SEGMENT_TYPE}, )?+version: BIGINT>$"
)


def snapshot_rows(minutes: DataFrame, players: DataFrame, devices: DataFrame) -> DataFrame:
    """The three rollups as one table of raw counters."""
    none = F.lit(None)
    parts = [
        minutes.select(
            F.lit("minute").alias("grain"), "minute_ms", none.cast("string").alias("name"), *COUNTERS
        ),
        *[
            segments.select(
                F.lit(grain).alias("grain"), none.cast("bigint").alias("minute_ms"), "name", *COUNTERS
            )
            for grain, segments in (("player", players), ("device", devices))
        ],
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _counters(version: int) -> Column:
    kept = [c for c in COUNTERS if ADDED_IN.get(c, OLDEST_VERSION) <= version]
    return F.struct(*kept)


def to_documents(
    rows: DataFrame,
    version: int = VERSION,
    label_buckets: int = 256,
) -> DataFrame:
    """JSON documents (``doc_id``, ``body``) that together hold ``rows``.

    A minute document has at most the 1440 minutes of its day. Labels are dealt
    to ``label_buckets`` documents of a section by a hash of the name; raise it
    where labels are not capped.
    """
    section = F.when(F.col("grain") == "minute", F.lit("minutes"))
    for name, grain in SECTIONS.items():
        section = section.when(F.col("grain") == grain, F.lit(name))
    bucket = F.pmod(F.xxhash64("name"), F.lit(label_buckets))
    is_minute = F.col("grain") == "minute"
    parted = rows.withColumn("section", section).withColumn(
        "bucket", F.when(is_minute, day_of(F.col("minute_ms")).cast("string")).otherwise(bucket.cast("string"))
    )
    part = F.when(is_minute, F.col("bucket")).otherwise(F.concat_ws("-", "bucket", F.lit("0")))
    grouped = (
        parted.withColumn("part", part)
        .groupBy("section", "bucket", "part")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("minute_ms", "name", _counters(version).alias("m")))
            ).alias("sorted")
        )
    )
    minute = lambda x: F.struct(*calendar(x["minute_ms"]), x["m"].alias("m"))
    named = lambda x: F.struct(x["name"].alias("name"), x["m"].alias("m"))
    lists = [
        F.transform(
            F.when(F.col("section") == name, F.col("sorted")).otherwise(F.array()), entry
        ).alias(name)
        for name, entry in (("minutes", minute), *[(s, named) for s in SECTIONS])
    ]
    return grouped.select(
        F.concat_ws("-", "section", "part").alias("doc_id"),
        F.to_json(F.struct(F.lit(version).alias("version"), *lists)).alias("body"),
    )


def _counter_fault(m: str) -> str:
    """Name of the first counter of ``m`` that is absent or no count."""
    tests = []
    for name in COUNTERS:
        value = member(m, name)
        ok = f"{is_integer(value)} AND try_variant_get({m}, '$.{name}', 'bigint') >= 0"
        since = ADDED_IN.get(name, OLDEST_VERSION)
        if since > OLDEST_VERSION:
            ok = f"(({value} IS NULL AND version < {since}) OR ({ok}))"
        tests.append(f"named_struct('c', '{name}', 'ok', {ok})")
    first = f"get(filter(array({', '.join(tests)}), t -> NOT coalesce(t.ok, false)), 0).c"
    message = "concat('counter ', c, ' is absent or no count of 0 or more')"
    return (
        f"CASE WHEN NOT {is_object(m)} THEN 'metrics entry is not an object'"
        f" ELSE {let('c', first, message)} END"
    )


def _int_between(entry: str, name: str, low: int, high: int) -> str:
    return (
        f"({is_integer(member(entry, name))} AND"
        f" try_variant_get({entry}, '$.{name}', 'bigint') BETWEEN {low} AND {high})"
    )


def _is_day(y: str, mo: str, d: str) -> str:
    """Whether the month has that day."""
    leap = f"({y} % 4 = 0 AND {y} % 100 <> 0) OR {y} % 400 = 0"
    return (
        f"{d} <= CASE WHEN {mo} IN (4, 6, 9, 11) THEN 30"
        f" WHEN {mo} = 2 THEN IF({leap}, 29, 28) ELSE 31 END"
    )


def _minute_fault(e: str) -> str:
    cases = [f"WHEN NOT {is_object(e)} THEN 'minutes holds an entry that is not an object'"]
    cases.append(f"WHEN {member(e, 'm')} IS NULL THEN 'minute entry has no m'")
    for name, low, high in CALENDAR:
        cases.append(
            f"WHEN NOT {_int_between(e, name, low, high)}"
            f" THEN 'minute field {name} is not an integer within {low}..{high}'"
        )
    # The 31st of a short month would have no minute to add to.
    part = lambda n: f"try_variant_get({e}, '$.{n}', 'bigint')"
    cases.append(
        f"WHEN NOT ({_is_day(part('y'), part('mo'), part('d'))})"
        " THEN 'minute entry is no calendar day'"
    )
    return f"CASE {' '.join(cases)} ELSE {_counter_fault(member(e, 'm'))} END"


def _segment_fault(e: str, section: str) -> str:
    return (
        f"CASE WHEN NOT {is_object(e)} THEN '{section} holds an entry that is not an object'"
        f" WHEN NOT {is_text(member(e, 'name'))} THEN '{section} entry has no string name'"
        f" WHEN {member(e, 'm')} IS NULL THEN '{section} entry has no m'"
        f" ELSE {_counter_fault(member(e, 'm'))} END"
    )


def _section_fault(section: str, entry_fault: str) -> str:
    entries = f"try_variant_get(doc, '$.{section}', 'array<variant>')"
    first = f"get(filter(transform({entries}, e -> {entry_fault}), x -> x IS NOT NULL), 0)"
    return (
        f"CASE WHEN {member('doc', section)} IS NULL THEN NULL"
        f" WHEN {entries} IS NULL THEN '{section} is not a list' ELSE {first} END"
    )


def _sound_counters(m: str) -> str:
    tests = []
    for name in COUNTERS:
        ok = f"{m}.{name} >= 0"
        since = ADDED_IN.get(name, OLDEST_VERSION)
        if since > OLDEST_VERSION:
            ok = f"({ok} OR ({m}.{name} IS NULL AND t.version < {since}))"
        tests.append(ok)
    return " AND ".join(tests)


def _sound(typed: str) -> str:
    """Whether a document of the right types also has the right values."""
    fields = " AND ".join(f"x.{n} BETWEEN {low} AND {high}" for n, low, high in CALENDAR)
    minute = f"coalesce({fields} AND {_is_day('x.y', 'x.mo', 'x.d')} AND {_sound_counters('x.m')}, false)"
    named = f"coalesce(x.name IS NOT NULL AND {_sound_counters('x.m')}, false)"
    tests = [f"t.version BETWEEN {OLDEST_VERSION} AND {VERSION}"]
    for section, test in (("minutes", minute), *[(s, named) for s in SECTIONS]):
        tests.append(f"coalesce(forall(t.{section}, x -> {test}), true)")
    return let("t", typed, " AND ".join(tests))


def check_documents(documents: DataFrame) -> DataFrame:
    """Add ``version`` and ``reason``; a sound document has no reason.

    Decided within the row of the document, nothing is applied yet. A document
    of the usual type is cast as a whole and its values are compared; single
    members are looked at only to find out what is wrong with any other.
    """
    version = "try_variant_get(doc, '$.version', 'bigint')"
    sections = ", ".join(
        [_section_fault("minutes", _minute_fault("e"))]
        + [_section_fault(s, _segment_fault("e", s)) for s in SECTIONS]
    )
    content = let("version", version, f"coalesce({sections})")
    reason = let(
        "doc",
        "_doc",
        "CASE WHEN doc IS NULL THEN 'snapshot is not valid JSON'"
        f" WHEN NOT {is_object('doc')} THEN 'snapshot is not an object'"
        f" WHEN NOT {is_integer(member('doc', 'version'))} THEN 'the version is no integer'"
        f" WHEN {version} NOT BETWEEN {OLDEST_VERSION} AND {VERSION}"
        f" THEN concat('version ', {version}, ' is not supported')"
        f" ELSE {content} END",
    )
    typed = f"try_variant_get(_doc, '$', '{_TYPED_DOC}')"
    return (
        documents.selectExpr("*", f"{parse_whole('body')} AS _doc")
        .selectExpr(
            "*",
            f"coalesce(regexp_like(schema_of_variant(_doc), r'{_DOC_TYPE}')"
            f" AND {_sound(typed)}, false) AS _sound",
        )
        .selectExpr("*", f"IF(_sound, NULL, {reason}) AS reason")
        .selectExpr(
            *documents.columns,
            f"IF({is_integer(member('_doc', 'version'))},"
            " try_variant_get(_doc, '$.version', 'int'), NULL) AS version",
            "reason",
            "IF(reason IS NULL, _doc, NULL) AS doc",
        )
    )


def judged_rows(checked: DataFrame, *units: Column) -> DataFrame:
    """Counter rows of every sound document, and one row of ``reason`` alone for an unsound one.

    ``units`` are carried along. A counter that came with a later version than
    the document reads as 0, so a mean over it says "no data" rather than
    something made up. A sound document without entries leaves no row.
    """
    # Sound documents hold the right types throughout, so one cast is exact.
    # All entries go into one list: every document is exploded once.
    lists = [
        f"coalesce(transform(t.{section}, e -> named_struct('grain', '{grain}', 'minute_ms', {at},"
        f" 'name', {name}, 'm', e.m)), array())"
        for section, grain, at, name in (
            ("minutes", "minute", _minute_ms("e"), "CAST(NULL AS STRING)"),
            *[(s, g, "CAST(NULL AS BIGINT)", "e.name") for s, g in SECTIONS.items()],
        )
    ]
    typed = f"try_variant_get(doc, '$', '{_TYPED_DOC}')"
    entries = (
        checked.select(*units, "reason", F.expr(typed).alias("t"))
        .select("*", F.explode_outer(F.expr(f"IF(reason IS NULL, concat({', '.join(lists)}), NULL)")).alias("x"))
        .drop("t")
        .where("x IS NOT NULL OR reason IS NOT NULL")
    )
    kept = [c for c in entries.columns if c != "x"]
    return entries.selectExpr(
        *kept, "x.grain", "x.minute_ms", "x.name", *[f"coalesce(x.m.{c}, 0L) AS {c}" for c in COUNTERS]
    )


def document_rows(checked: DataFrame) -> DataFrame:
    """Counter rows of all snapshots whose documents are sound, see :func:`judged_rows`.

    A snapshot is all documents of one ``snapshot_id``, or all there are where
    the documents have no such column: it is applied whole or not at all. Every
    document is checked once: refusals and rows come out of one exchange, which
    the search for refused snapshots and the rows themselves both read.
    """
    # Not a literal, or the join below would have no key.
    every = F.coalesce(F.length("body") * 0, F.lit(0))
    unit = F.col("snapshot_id") if "snapshot_id" in checked.columns else every
    keys = ["grain", "minute_ms", "name"]
    rows = judged_rows(checked, unit.alias("_unit")).repartition("_unit", *keys)
    # All columns take part, as the exchange would differ without one.
    bad = rows.groupBy("_unit").agg(F.max("reason").alias("_reason"), *used(*keys, *COUNTERS))
    bad = bad.where(F.col("_reason").isNotNull() & all_used(*keys, *COUNTERS))
    bad = bad.select(F.col("_unit").alias("_bad"), F.lit(True).alias("_refused"))
    # An anti join would be pushed below the exchange, which then served one branch only.
    sound = rows.join(bad, F.col("_unit").eqNullSafe(F.col("_bad")), "left").where("_refused IS NULL")
    # Rows with a reason went with their snapshot; naming it here keeps the column.
    return sound.select(F.coalesce("grain", "reason").alias("grain"), "minute_ms", "name", *COUNTERS)


def _minute_ms(e: str) -> str:
    days = f"CAST(unix_date(make_date(CAST({e}.y AS INT), CAST({e}.mo AS INT), CAST({e}.d AS INT))) AS BIGINT)"
    return f"{days} * 86400000 + {e}.h * 3600000 + {e}.mi * 60000"


def require_sound(checked: DataFrame) -> None:
    """Raise with the reason if any document of a snapshot is unsound, so
    that a snapshot is applied as a whole or not at all."""
    bad = checked.where("reason IS NOT NULL").select("reason").limit(1).collect()
    if bad:
        raise ValueError(f"snapshot refused: {bad[0][0]}")


def restore(live: DataFrame, restored: DataFrame) -> DataFrame:
    """Live and restored rows added up per minute, player and device.

    An empty label is never a segment of live events, but a document may hold
    one; it is kept like any other name.
    """
    return rollups.merge_multi(live.unionByName(restored))


def platform_totals(rows: DataFrame) -> DataFrame:
    """Totals come from minutes alone: restored segments do not add to them."""
    return rows.where(F.col("grain") == "minute").agg(*merge_aggs())
