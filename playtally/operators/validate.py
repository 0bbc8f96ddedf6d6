"""Batch acceptance: one verdict per batch, decided inside its own row.

A batch is refused as a whole by its first failing check. Nothing is exploded,
joined or shuffled before the verdict is known: the stage is a narrow map over
``(batch_id, ingest_time_ms, body)`` rows, so it scales with the number of
input splits and one huge producer skews nothing.

Batches whose members all have the expected JSON types, which one look at the
type of the whole document tells, are read straight into typed events. Only the
others pay for looking at the type of every single member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.functions import jsonshape
from playtally.functions.members import integer, is_integer, is_text, let, text
from playtally.functions.minutes import LONG_MAX, LONG_MIN
from playtally.options import IngestLimits
from playtally.schema import EVENT_TYPES, QUARANTINE

ACCEPTED = "accepted"
INVALID_JSON = "invalid_json"
INVALID_SCHEMA = "invalid_schema"
TOO_LARGE = "too_large"

# Response code of each status.
HTTP_STATUS = {ACCEPTED: 202, INVALID_JSON: 400, INVALID_SCHEMA: 422, TOO_LARGE: 413}

VERDICT_FIELDS = ("status", "http_status", "first_idx", "reason", "message", "n_events")

_TEXTS = ("event_type", "session_id", "player", "device", "error_code")
_INTEGERS = (
    "timestamp",
    "startup_time_ms",
    "buffer_duration_ms",
    "bitrate_kbps",
    "watch_time_ms",
)
_TYPED = "array<struct<{}>>".format(
    ",".join([f"`{m}`:string" for m in _TEXTS] + [f"`{m}`:bigint" for m in _INTEGERS])
)
# Every member we look at, as it came; an element that is no object is NULL.
_MEMBERS = "array<struct<{}>>".format(",".join(f"`{m}`:variant" for m in _TEXTS + _INTEGERS))

# Type of a document that needs no look at single members.
_KNOWN = "|".join(_TEXTS + _INTEGERS)
_CLEAN_MEMBER = (
    rf"(?:(?:{'|'.join(_TEXTS)}): STRING|(?:{'|'.join(_INTEGERS)}): BIGINT"
    rf"|(?!(?:{_KNOWN}):)[A-Za-z0-9_]++: (?:STRING|BIGINT|DOUBLE|BOOLEAN|DECIMAL\(\d++, ?\d++\)))"
)
_CLEAN_LIST = rf"ARRAY<OBJECT<(?:{_CLEAN_MEMBER}(?:, (?=[A-Za-z0-9_]))?+)*+>>"
_CLEAN_DEPTH = 3

# Code point of a byte order mark, which may precede a document.
_BOM = 65_279


def scan_shape(batches: DataFrame) -> DataFrame:
    """Byte size, structural tokens and nesting depth of every body."""
    return batches.withColumn("_skel", F.expr(jsonshape.skeleton("body"))).selectExpr(
        "batch_id",
        "CAST(octet_length(body) AS BIGINT) AS n_bytes",
        f"CAST({jsonshape.token_count('_skel')} AS BIGINT) AS n_tokens",
        f"CAST({jsonshape.nesting('_skel')} AS BIGINT) AS depth",
    )


def parse_whole(body: str) -> str:
    """The document as VARIANT; NULL unless the whole text is one JSON value in UTF-8.

    The parser stops after the first complete value, so text behind it would
    go unnoticed. Parsed as a list that ends with a hash of the body, a body
    with anything behind its value no longer yields that list.
    """
    plain = f"CASE WHEN ascii({body}) = {_BOM} THEN substr({body}, 2) ELSE {body} END"
    listed = f"try_parse_json(concat('[', {plain}, ',', h, ']'))"
    sealed = "coalesce(try_variant_get(l, '$[1]', 'bigint') = h, false)"
    first = f"IF({sealed}, try_variant_get(l, '$[0]', 'variant'), NULL)"
    whole = let("h", f"xxhash64({body})", let("l", listed, first))
    return f"IF(is_valid_utf8({body}), {whole}, NULL)"


def from_list_or_envelope(doc: str, as_type: str) -> str:
    """The events of a bare list or of an object with an ``events`` member."""
    return (
        f"coalesce(try_variant_get({doc}, '$', '{as_type}'),"
        f" try_variant_get({doc}, '$.events', '{as_type}'))"
    )


def typed_members(members: str, wrong_number: str = "NULL", wrong_time: str = "NULL") -> str:
    """Typed events from a list of raw members, each looked at on its own."""
    fields = []
    for name in _TEXTS:
        absent = "NULL" if name in ("event_type", "error_code") else "''"
        wrong = "NULL" if name == "error_code" else "''"
        fields.append(f"'{name}', {text(f'm.{name}', absent, wrong)}")
    for name in _INTEGERS:
        wrong = wrong_time if name == "timestamp" else wrong_number
        fields.append(f"'{name}', {integer(f'm.{name}', wrong)}")
    typed = f"named_struct({', '.join(fields)})"
    return f"transform({members}, m -> IF(m IS NULL, NULL, {typed}))"


def _add(value: str, delta: int) -> str:
    """Saturating addition of a constant."""
    if delta >= 0:
        return f"IF({value} > {LONG_MAX - delta}, {LONG_MAX}, {value} + {delta})"
    return f"IF({value} < {_long(LONG_MIN - delta)}, {_long(LONG_MIN)}, {value} - {-delta})"


def _long(value: int) -> str:
    return f"CAST('{value}' AS BIGINT)"


def _oldest(limits: IngestLimits) -> str:
    # One above the smallest value, which marks a timestamp of another type.
    return f"greatest({_add('ingest_time_ms', -limits.max_lateness_ms)}, {_long(LONG_MIN + 1)})"


def _newest(limits: IngestLimits) -> str:
    return _add("ingest_time_ms", limits.max_future_skew_ms)


def _names() -> str:
    return ", ".join(f"'{t}'" for t in EVENT_TYPES)


def _sound(limits: IngestLimits) -> str:
    """Whether typed event ``e`` passes every check; never NULL."""
    known = f"coalesce(e.event_type IN ({_names()}), {str(not limits.require_event_type).lower()})"
    checks = ["e IS NOT NULL", known]
    checks.append("coalesce(e.timestamp BETWEEN w.oldest AND w.newest, true)")
    for label in ("player", "device"):
        checks.append(f"coalesce(octet_length(e.{label}) <= {limits.max_label_bytes}, true)")
    for field, largest in limits.numeric_ranges:
        checks.append(f"coalesce(e.{field} BETWEEN 0 AND {largest}, true)")
    return " AND ".join(checks)


def _fault(limits: IngestLimits) -> str:
    """(reason, detail) of raw event ``m``, known to fail some check."""
    cases = []

    def case(test: str, reason: str, detail: str) -> None:
        cases.append(
            f"WHEN {test} THEN named_struct('reason', '{reason}', 'detail', {detail})"
        )

    case("m IS NULL", "not_an_object", "'is not an object'")
    untyped = ("missing_event_type", "'has no event_type, or an empty one'")
    if limits.require_event_type:
        case("m.event_type IS NULL", *untyped)
    name = text("m.event_type")
    case(f"m.event_type IS NOT NULL AND {name} = ''", *untyped)
    case(
        f"m.event_type IS NOT NULL AND {name} NOT IN ({_names()})",
        "unknown_event_type",
        f"concat('has unknown event_type ', {name})",
    )
    case(
        f"m.timestamp IS NOT NULL AND NOT {is_integer('m.timestamp')}",
        "non_integer_timestamp",
        "'needs an integer as timestamp'",
    )
    stamp = integer("m.timestamp")
    case(
        f"{stamp} NOT BETWEEN w.oldest AND w.newest",
        "timestamp_outside_window",
        f"concat('has timestamp ', {stamp}, ', window is ', w.oldest, '..', w.newest)",
    )
    for label in ("player", "device"):
        case(
            f"{is_text(f'm.{label}')} AND octet_length({text(f'm.{label}')})"
            f" > {limits.max_label_bytes}",
            f"{label}_label_too_long",
            f"'has a {label} label over {limits.max_label_bytes} bytes'",
        )
    for field, largest in limits.numeric_ranges:
        value = integer(f"m.{field}")
        case(
            f"m.{field} IS NOT NULL AND NOT {is_integer(f'm.{field}')}",
            f"non_integer_{field}",
            f"'needs an integer as {field}'",
        )
        case(
            f"{value} NOT BETWEEN 0 AND {largest}",
            f"{field}_out_of_range",
            f"concat('has {field} ', {value}, ', range is 0..{largest}')",
        )
    return "CASE " + " ".join(cases) + " END"


def _verdict(
    status: str, reason: str, message: str, first_idx: str = "NULL", n_events: str = "0"
) -> str:
    return (
        f"named_struct('status', '{status}', 'http_status', {HTTP_STATUS[status]},"
        f" 'first_idx', CAST({first_idx} AS INT), 'reason', CAST({reason} AS STRING),"
        f" 'message', {message}, 'n_events', {n_events})"
    )


def _schema_error(reason: str, message: str, n_events: str = "0") -> str:
    return _verdict(INVALID_SCHEMA, f"'{reason}'", message, n_events=n_events)


def _token_check(limits: IngestLimits) -> str:
    """Structural tokens of a body within the size cap, NULL beyond it."""
    # A body has no more tokens than bytes: short ones need no count.
    return (
        f"CASE WHEN octet_length(body) <= {min(limits.max_structural_tokens, limits.max_body_bytes)}"
        f" THEN 0 WHEN octet_length(body) <= {limits.max_body_bytes}"
        f" THEN {jsonshape.token_count(jsonshape.skeleton('body'))} END"
    )


def _clean(limits: IngestLimits) -> str:
    """``list`` or ``envelope`` if every member has its expected JSON type."""
    if limits.max_json_depth < _CLEAN_DEPTH:
        return "CAST(NULL AS STRING)"
    # A JSON null leaves no trace in the type of a list, hence the first test.
    return (
        f"CASE WHEN _doc IS NULL OR contains(body, 'null') OR ascii(body) = {_BOM} THEN NULL"
        f" WHEN regexp_like(schema_of_variant(_doc), r'^{_CLEAN_LIST}$') THEN 'list'"
        f" WHEN regexp_like(schema_of_variant(_doc), r'^OBJECT<events: {_CLEAN_LIST}>$')"
        " THEN 'envelope' END"
    )


def _typed_events(limits: IngestLimits) -> str:
    marked = typed_members("members", "-1", _long(LONG_MIN))
    careful = let(
        "members",
        from_list_or_envelope("_doc", _MEMBERS),
        f"IF(size(members) <= {limits.max_events_per_batch}, CAST({marked} AS {_TYPED}), NULL)",
    )
    return (
        "CASE WHEN _doc IS NULL THEN NULL"
        # Quicker than a cast of the parsed document, and of known outcome.
        f" WHEN _clean = 'list' THEN from_json(body, '{_TYPED}')"
        f" WHEN _clean = 'envelope' THEN from_json(body, 'struct<events:{_TYPED}>').events"
        f" ELSE {careful} END"
    )


def _decision(limits: IngestLimits) -> str:
    """The verdict of a row whose document and typed events are at hand.

    Results of a lambda are copied, so the events themselves stay out of it.
    """
    fault = let(
        "f",
        let("m", f"get({from_list_or_envelope('doc', _MEMBERS)}, bad - 1)", _fault(limits)),
        _verdict(
            INVALID_SCHEMA,
            "f.reason",
            "concat('element ', bad - 1, ' ', f.detail)",
            first_idx="bad - 1",
            n_events="size(typed)",
        ),
    )
    accept = _verdict(
        ACCEPTED, "NULL", "concat('accepted ', size(typed), ' event(s)')", n_events="size(typed)"
    )
    judge = let(
        "w",
        f"named_struct('oldest', {_oldest(limits)}, 'newest', {_newest(limits)})",
        let(
            "bad",
            f"CAST(array_position(transform(typed, e -> {_sound(limits)}), false) AS INT)",
            f"CASE WHEN bad > 0 THEN {fault} ELSE {accept} END",
        ),
    )
    no_event = _schema_error("no_event", "'list of events is empty'")
    too_many = _schema_error(
        "too_many_events",
        f"'batch has more than {limits.max_events_per_batch} events'",
        n_events="size(list)",
    )
    # Without typed events the body has no list of events, or too long a one.
    listless = let(
        "list",
        from_list_or_envelope("doc", "array<variant>"),
        f"CASE WHEN list IS NOT NULL THEN {too_many}"
        " WHEN try_variant_get(doc, '$.events', 'variant') IS NULL THEN "
        + _schema_error("no_events", "'body is neither a list nor has a member events'")
        + " ELSE "
        + _schema_error("events_not_a_list", "'member events is not a list'")
        + " END",
    )
    counted = (
        f"CASE WHEN typed IS NULL THEN {listless} WHEN size(typed) = 0 THEN {no_event}"
        f" WHEN size(typed) > {limits.max_events_per_batch} THEN "
        + too_many.replace("size(list)", "size(typed)")
        + f" ELSE {judge} END"
    )
    # The exact depth is only worked out where the bound is too coarse.
    depth = let(
        "sk",
        jsonshape.skeleton("body"),
        f"IF({jsonshape.nesting_bound('sk')} <= {limits.max_json_depth}, 0,"
        f" {jsonshape.nesting('sk')})",
    )
    shaped = let(
        "depth",
        f"IF(clean, 0, {depth})",
        f"CASE WHEN depth > {limits.max_json_depth} THEN "
        + _schema_error(
            "too_deep", f"concat('body nests ', depth, ' levels, limit is {limits.max_json_depth}')"
        )
        + " WHEN doc IS NULL THEN "
        + _verdict(INVALID_JSON, "'not_json'", "'body is not valid JSON'")
        + f" ELSE {counted} END",
    )
    bound = let("doc", "_doc", let("clean", "_clean IS NOT NULL", let("typed", "_typed", shaped)))
    too_wide = _schema_error(
        "too_many_tokens", f"'body has more than {limits.max_structural_tokens} tokens'"
    )
    return (
        "CASE WHEN body IS NULL THEN "
        + _verdict(INVALID_JSON, "'not_json'", "'body is not valid JSON'")
        + " WHEN _tokens IS NULL THEN "
        + _verdict(TOO_LARGE, "'body_too_large'", f"'body exceeds {limits.max_body_bytes} bytes'")
        + f" WHEN _tokens > {limits.max_structural_tokens} THEN {too_wide} ELSE {bound} END"
    )


def with_verdict(batches: DataFrame, limits: IngestLimits = IngestLimits()) -> DataFrame:
    """Add the verdict of every batch and, for accepted ones, typed events.

    A body over the size cap is never scanned and one over the token budget
    never parsed. To keep only some verdicts, filter after an action boundary
    or use :func:`accepted_events`: a filter right on top of this projection
    is pushed below it and evaluates the verdict a second time.
    """
    steps = (
        ("_tokens", _token_check(limits)),
        ("_doc", f"IF(_tokens <= {limits.max_structural_tokens}, {parse_whole('body')}, NULL)"),
        ("_clean", _clean(limits)),
        ("_typed", _typed_events(limits)),
        ("_v", _decision(limits)),
    )
    judged = batches
    for name, sql in steps:
        judged = judged.selectExpr("*", f"{sql} AS {name}")
    return judged.selectExpr(
        *batches.columns,
        *[f"_v.{c}" for c in VERDICT_FIELDS],
        f"IF(_v.status = '{ACCEPTED}', _typed, NULL) AS events",
    )


def verdicts(batches: DataFrame, limits: IngestLimits = IngestLimits()) -> DataFrame:
    """One row per batch: was it accepted and, if not, why."""
    return with_verdict(batches, limits).select(
        "batch_id", *VERDICT_FIELDS
    )


def verdict_counts(judged: DataFrame) -> DataFrame:
    """Batches and events per status."""
    return judged.groupBy("status", "http_status").agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n_events").cast("bigint").alias("n_events")
    )


def judged_elements(judged: DataFrame) -> DataFrame:
    """Everything a judged batch comes to, in one pass: typed events, and what was refused.

    ``outcome`` is ``event``, ``element`` (of an accepted batch, of no known
    type) or ``batch`` (a refused one, in one row without ``idx``). Refused rows
    have ``reason``, ``message`` and the ``raw`` text; ``n_events`` is in the first row
    of a batch alone, and ``lost`` counts samples that a typed event cannot hold.
    An event without a timestamp gets the receipt time of its batch.
    """
    rows = judged.select(
        "batch_id",
        "ingest_time_ms",
        "body",
        *VERDICT_FIELDS,
        F.posexplode_outer("events").alias("idx", "e"),
    )
    outcome = f"CASE WHEN idx IS NULL THEN 'batch' WHEN e.event_type IN ({_names()}) THEN 'event' ELSE 'element' END"
    int32 = ("startup_time_ms", "buffer_duration_ms", "bitrate_kbps")
    lost = " + ".join(f"CAST(e.{m} IS NOT NULL AND try_cast(e.{m} AS INT) IS NULL AS INT)" for m in int32)
    return rows.selectExpr(
        "batch_id",
        "ingest_time_ms",
        "idx",
        f"{outcome} AS outcome",
        "status",
        "IF(coalesce(idx, 0) = 0, n_events, NULL) AS n_events",
        f"CASE {outcome} WHEN 'batch' THEN reason WHEN 'element' THEN 'unknown_event_type' END AS reason",
        f"CASE {outcome} WHEN 'batch' THEN message WHEN 'element' THEN concat('element ', idx, ' has no known event type') END AS message",
        f"CASE {outcome} WHEN 'batch' THEN body WHEN 'element' THEN coalesce(to_json(e), 'null') END AS raw",
        f"IF(idx IS NULL, 0, {lost}) AS lost",
        *_event_columns(),
    )


def _event_columns() -> list[str]:
    return [
        "e.event_type",
        "coalesce(e.session_id, '') AS session_id",
        "coalesce(e.player, '') AS player",
        "coalesce(e.device, '') AS device",
        "coalesce(e.timestamp, ingest_time_ms) AS timestamp_ms",
        "try_cast(e.startup_time_ms AS INT) AS startup_time_ms",
        "try_cast(e.buffer_duration_ms AS INT) AS buffer_duration_ms",
        "try_cast(e.bitrate_kbps AS INT) AS bitrate_kbps",
        "e.watch_time_ms",
        "e.error_code",
    ]


_ARRIVAL_FIELDS = ("batch_id", "ingest_time_ms", "idx")


def events_of(elements: DataFrame) -> DataFrame:
    """The typed events of :func:`judged_elements`, in the columns of :func:`accepted_events`."""
    named = [sql.rsplit(" AS ", 1)[-1].removeprefix("e.") for sql in _event_columns()]
    return elements.where("outcome = 'event'").select(*_ARRIVAL_FIELDS, *named)


def refused(elements: DataFrame) -> DataFrame:
    """Batches and elements that were refused, with reason and raw text."""
    return elements.where("outcome <> 'event'").select(*QUARANTINE.names)


def ledger_of(elements: DataFrame) -> DataFrame:
    """Ingest counters of :func:`judged_elements`, one row; folds of labels are counted elsewhere."""
    first = F.coalesce(F.col("idx"), F.lit(0)) == 0
    ok = F.col("status") == ACCEPTED
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return elements.agg(
        F.count_if(first).alias("batches"),
        F.count_if(first & ok).alias("accepted_batches"),
        F.count_if(first & ~ok).alias("rejected_batches"),
        F.count_if(first & (F.col("status") == INVALID_JSON)).alias("unparseable_batches"),
        F.count_if(F.col("outcome") == "event").alias("events"),
        F.count_if(F.col("outcome") == "element").alias("parse_failures"),
        whole("lost").alias("process_errors"),
    )


def accepted_events(judged: DataFrame) -> DataFrame:
    """Events of accepted batches, one row each, in arrival columns.

    An event without a timestamp gets the receipt time of its batch. A refused
    batch has no events and leaves one row without index, which is dropped
    after the explode: a filter on the status itself would be pushed below the
    projection and judge every batch twice.
    """
    rows = judged.select(
        "batch_id", "ingest_time_ms", F.posexplode_outer("events").alias("idx", "e")
    ).where(f"idx IS NOT NULL AND e.event_type IN ({_names()})")
    return rows.selectExpr(*_ARRIVAL_FIELDS, *_event_columns())


def untyped_events() -> str:
    """Number of elements of an accepted batch that are no events."""
    return f"size(filter(events, e -> NOT coalesce(e.event_type IN ({_names()}), false)))"


def within_freshness(events: DataFrame, limits: IngestLimits = IngestLimits()) -> DataFrame:
    """Keep events whose timestamp is neither too old nor in the future.

    Lateness counts from the receipt time and never from a watermark, so a
    replayed batch gets the same answer as it did the first time.
    """
    return events.where(f"timestamp_ms BETWEEN {_oldest(limits)} AND {_newest(limits)}")
