"""The registered queries once more, as SQL over the given tables.

Written from the rules, not from the operators: events and defects are derived
from the base columns and every result is computed from them directly.
"""

from __future__ import annotations

from playtally.plans import registry as R
from playtally.schema import COUNTERS, PLOTTABLE

_EVENTS = r"""
given AS (
  SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms
  FROM events
),
kinds AS (
  SELECT *, CASE event_type
    WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'video_start' ELSE 'startup_complete' END
    WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'buffer_start' ELSE 'buffer_end' END
    WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'playback_end' ELSE 'bitrate_change' END
    WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'drm_error' ELSE 'seek' END
    WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'pause' ELSE 'resume' END
  END AS kind
  FROM given
),
clean AS (
  SELECT event_id, kind AS event_type, 'u' || user_id AS session_id,
    CASE WHEN user_id % 7 = 0 THEN '' ELSE 'player' || (user_id % 5) END AS player,
    CASE WHEN user_id % 11 = 0 THEN '' ELSE 'device' || (user_id % 6) END AS device,
    ms AS timestamp_ms,
    CASE WHEN kind = 'startup_complete' THEN CAST(floor(value * 10) AS INTEGER) END AS startup_time_ms,
    CASE WHEN kind = 'buffer_end' THEN CAST(floor(value * 7) AS INTEGER) END AS buffer_duration_ms,
    CASE WHEN kind = 'bitrate_change'
      THEN CAST([400, 900, 1600, 2500, 3600, 4900][k % 6 + 1] AS INTEGER) END AS bitrate_kbps,
    CASE WHEN kind = 'playback_end' THEN CAST(floor(value * 1000) AS BIGINT) END AS watch_time_ms,
    CASE WHEN kind = 'drm_error' THEN 'E17' END AS error_code
  FROM kinds
),
pe AS (
  SELECT * REPLACE (
    CASE WHEN event_id % 89 = 0 OR startup_time_ms IS NULL THEN NULL
         WHEN event_id % 97 = 0 THEN -1 ELSE startup_time_ms END AS startup_time_ms,
    CASE WHEN event_id % 89 = 0 OR buffer_duration_ms IS NULL THEN NULL
         WHEN event_id % 97 = 0 THEN -1 ELSE buffer_duration_ms END AS buffer_duration_ms,
    CASE WHEN event_id % 89 = 0 OR bitrate_kbps IS NULL THEN NULL
         WHEN event_id % 97 = 0 THEN -1 ELSE bitrate_kbps END AS bitrate_kbps,
    CASE WHEN event_id % 89 = 0 OR watch_time_ms IS NULL THEN NULL
         WHEN event_id % 97 = 0 THEN -1 ELSE watch_time_ms END AS watch_time_ms)
  FROM clean
)"""

_FOLD = """
  CAST(count(*) AS BIGINT) AS total_events,
  CAST(count(*) FILTER (WHERE event_type = 'video_start') AS BIGINT) AS total_views,
  CAST(count(*) FILTER (WHERE event_type = 'startup_complete' AND startup_time_ms >= 0) AS BIGINT) AS startup_samples,
  CAST(coalesce(sum(startup_time_ms) FILTER (WHERE event_type = 'startup_complete' AND startup_time_ms >= 0), 0) AS BIGINT) AS startup_time_ms_sum,
  CAST(count(*) FILTER (WHERE event_type = 'buffer_start') AS BIGINT) AS buffer_count,
  CAST(count(*) FILTER (WHERE event_type = 'buffer_end' AND buffer_duration_ms >= 0) AS BIGINT) AS buffer_samples,
  CAST(coalesce(sum(buffer_duration_ms) FILTER (WHERE event_type = 'buffer_end' AND buffer_duration_ms >= 0), 0) AS BIGINT) AS buffer_duration_ms_sum,
  CAST(count(*) FILTER (WHERE event_type = 'drm_error') AS BIGINT) AS error_count,
  CAST(coalesce(sum(watch_time_ms) FILTER (WHERE event_type = 'playback_end' AND watch_time_ms >= 0), 0) AS BIGINT) AS watch_time_ms_sum,
  CAST(count(*) FILTER (WHERE event_type = 'bitrate_change' AND bitrate_kbps >= 0) AS BIGINT) AS bitrate_samples,
  CAST(coalesce(sum(bitrate_kbps) FILTER (WHERE event_type = 'bitrate_change' AND bitrate_kbps >= 0), 0) AS BIGINT) AS bitrate_kbps_sum"""

_MERGE = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTERS)
_LIST = ", ".join(COUNTERS)


def _mean(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST({total} AS DOUBLE) / CAST({n} AS DOUBLE) ELSE 0.0 END"


_STARTUP = _mean("startup_time_ms_sum", "startup_samples") + " AS startup_avg_ms"
_BUFFER = _mean("buffer_duration_ms_sum", "buffer_samples") + " AS buffer_avg_ms"
_RATIO = _mean("buffer_count", "total_views") + " AS buffer_ratio_per_view"
_WATCH = "CAST(watch_time_ms_sum AS DOUBLE) / 60000.0 AS watch_time_min"
_BITRATE = _mean("bitrate_kbps_sum", "bitrate_samples") + " AS bitrate_avg_kbps"

_MINUTE_METRICS = (
    f"total_events, total_views, startup_samples, {_STARTUP}, buffer_count, buffer_samples, {_BUFFER},"
    f" error_count, watch_time_ms_sum AS watch_time_ms, {_WATCH}, bitrate_samples, {_BITRATE}"
)
_METRICS = f"{_MINUTE_METRICS}, {_RATIO}"

_MINUTES = f"""
minutes AS (
  SELECT timestamp_ms // 60000 * 60000 AS minute_ms, {_FOLD} FROM pe GROUP BY 1
)"""


def _iso(ms: str) -> str:
    return f"strftime(make_timestamp(CAST({ms} AS BIGINT) * 1000), '%Y-%m-%dT%H:%M')"


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",".join((_EVENTS, *ctes)) + "\n" + body


def _minute_sql(body: str, *ctes: str) -> str:
    return _with(body, _MINUTES, *ctes)


def _labels(column: str) -> str:
    return f"SELECT {column} AS name, {_FOLD} FROM pe WHERE {column} <> '' GROUP BY 1"


_MULTI = f"""
multi AS (
  SELECT 'minute' AS grain, minute_ms, CAST(NULL AS VARCHAR) AS name, {_LIST} FROM minutes
  UNION ALL SELECT 'player', NULL, name, {_LIST} FROM ({_labels('player')})
  UNION ALL SELECT 'device', NULL, name, {_LIST} FROM ({_labels('device')})
)"""


def _capped(label: str, cap: int, extra: str = "") -> str:
    """Rollup of ``label`` (an expression over pe) under a cap."""
    named = f"named AS (SELECT *, {label} AS lab FROM pe WHERE {label} <> '')"
    slots = (
        "slots AS (SELECT lab AS slot FROM named WHERE lab <> '__other__'"
        f" GROUP BY lab ORDER BY min(event_id), lab LIMIT {cap})"
    )
    fold = (
        f"capped AS (SELECT coalesce(slot, '__other__') AS name, {_FOLD}"
        " FROM named LEFT JOIN slots ON lab = slot GROUP BY 1)"
    )
    return _with(f"SELECT name, {_METRICS} FROM capped", named, slots, fold)


def _recent(n: int) -> str:
    return f"recent AS (SELECT * FROM minutes ORDER BY minute_ms DESC LIMIT {n})"


_LO, _HI = R.RANGE_MS

# Events as the bodies carry them: the defect of their batch applied.
_BODIES = """
numbered AS (
  SELECT *, event_id // 50 AS batch_no, CAST(event_id % 50 AS INTEGER) AS idx FROM clean
),
receipts AS (SELECT batch_no, max(timestamp_ms) + 1000 AS ingest_time_ms FROM numbered GROUP BY 1),
flawed AS (
  SELECT n.*, ingest_time_ms, batch_no % 20 AS r, idx = (batch_no * 7) % 50 AS hit
  FROM numbered n JOIN receipts USING (batch_no)
),
sent AS (
  SELECT batch_no, ingest_time_ms, r, idx,
    NOT (r = 9 AND hit) AS is_object,
    CASE WHEN r = 8 AND hit THEN NULL
         WHEN (r = 1 AND hit) OR (r = 7 AND idx = 10) THEN 'bogus' ELSE event_type END AS event_type,
    session_id,
    CASE WHEN (r = 3 AND hit) OR (r = 7 AND idx = 3) THEN repeat('x', 129) ELSE player END AS player,
    r = 13 AND hit AS player_is_number,
    device,
    CASE WHEN r = 5 AND hit THEN timestamp_ms - 691200000 ELSE timestamp_ms END AS timestamp_ms,
    r = 12 AND hit AS stamp_absent,
    r = 2 AND hit AS stamp_is_text,
    CASE WHEN r = 4 AND hit THEN 600001 ELSE startup_time_ms END AS startup_time_ms,
    buffer_duration_ms, bitrate_kbps, watch_time_ms, error_code
  FROM flawed
),
faults AS (
  SELECT batch_no, idx, CASE
      WHEN NOT is_object THEN 'not_an_object'
      WHEN event_type IS NULL THEN 'missing_event_type'
      WHEN event_type = 'bogus' THEN 'unknown_event_type'
      WHEN stamp_is_text THEN 'non_integer_timestamp'
      WHEN NOT stamp_absent AND NOT timestamp_ms BETWEEN ingest_time_ms - 604800000 AND ingest_time_ms + 300000
        THEN 'timestamp_outside_window'
      WHEN strlen(player) > 128 AND NOT player_is_number THEN 'player_label_too_long'
      WHEN startup_time_ms > 600000 THEN 'startup_time_ms_out_of_range'
    END AS reason,
    CASE
      WHEN NOT is_object THEN 'is not an object'
      WHEN event_type IS NULL THEN 'has no event_type, or an empty one'
      WHEN event_type = 'bogus' THEN 'has unknown event_type bogus'
      WHEN stamp_is_text THEN 'needs an integer as timestamp'
      WHEN NOT stamp_absent AND NOT timestamp_ms BETWEEN ingest_time_ms - 604800000 AND ingest_time_ms + 300000
        THEN 'has timestamp ' || timestamp_ms || ', window is ' || (ingest_time_ms - 604800000)
          || '..' || (ingest_time_ms + 300000)
      WHEN strlen(player) > 128 AND NOT player_is_number THEN 'has a player label over 128 bytes'
      WHEN startup_time_ms > 600000 THEN 'has startup_time_ms ' || startup_time_ms || ', range is 0..600000'
    END AS detail
  FROM sent
),
firsts AS (
  SELECT batch_no, min(idx) AS first_idx, arg_min(reason, idx) AS reason, arg_min(detail, idx) AS detail
  FROM faults WHERE reason IS NOT NULL GROUP BY 1
),
sizes AS (SELECT batch_no, any_value(r) AS r, CAST(count(*) AS INTEGER) AS n FROM sent GROUP BY 1),
judged AS (
  SELECT s.batch_no, s.r, CAST(s.batch_no AS VARCHAR) AS batch_id,
    CASE WHEN s.r = 6 THEN 'invalid_json'
         WHEN s.r IN (10, 11) OR first_idx IS NOT NULL THEN 'invalid_schema' ELSE 'accepted' END AS status,
    CASE WHEN s.r IN (6, 10, 11) THEN NULL ELSE first_idx END AS first_idx,
    CASE s.r WHEN 6 THEN 'not_json' WHEN 10 THEN 'no_events' WHEN 11 THEN 'no_event' ELSE reason END AS reason,
    CASE WHEN s.r = 6 THEN 'body is not valid JSON'
         WHEN s.r = 10 THEN 'body is neither a list nor has a member events'
         WHEN s.r = 11 THEN 'list of events is empty'
         WHEN first_idx IS NOT NULL THEN 'element ' || first_idx || ' ' || detail
         ELSE 'accepted ' || n || ' event(s)' END AS message,
    CASE WHEN s.r IN (6, 10, 11) THEN 0 ELSE n END AS n_events
  FROM sizes s LEFT JOIN firsts USING (batch_no)
),
accepted AS (
  SELECT j.batch_id, s.ingest_time_ms, s.idx, s.event_type, s.session_id,
    CASE WHEN player_is_number THEN '' ELSE player END AS player, device,
    CASE WHEN stamp_absent THEN s.ingest_time_ms ELSE timestamp_ms END AS timestamp_ms,
    startup_time_ms, buffer_duration_ms, bitrate_kbps, watch_time_ms, error_code
  FROM sent s JOIN judged j USING (batch_no) WHERE j.status = 'accepted'
)"""

_HTTP = "CASE status WHEN 'accepted' THEN 202 WHEN 'invalid_json' THEN 400 WHEN 'too_large' THEN 413 ELSE 422 END"

# The JSON texts themselves, for their size and shape.
_TEXTS = r"""
texts AS (
  SELECT batch_no, any_value(r) AS r, string_agg(CASE WHEN NOT is_object THEN '7' ELSE
    '{' || concat_ws(',',
      CASE WHEN event_type IS NOT NULL THEN '"event_type":"' || event_type || '"' END,
      '"session_id":"' || session_id || '"',
      CASE WHEN player_is_number THEN '"player":5' ELSE '"player":"' || player || '"' END,
      '"device":"' || device || '"',
      CASE WHEN stamp_absent THEN NULL WHEN stamp_is_text THEN '"timestamp":"' || timestamp_ms || '"'
           ELSE '"timestamp":' || timestamp_ms END,
      '"startup_time_ms":' || startup_time_ms,
      '"buffer_duration_ms":' || buffer_duration_ms,
      '"bitrate_kbps":' || bitrate_kbps,
      '"watch_time_ms":' || watch_time_ms,
      '"error_code":"' || error_code || '"') || '}' END, ',' ORDER BY idx) AS joined
  FROM sent GROUP BY 1
),
bodies AS (
  SELECT batch_no, r, CASE r
    WHEN 6 THEN '[' || joined
    WHEN 10 THEN '{"data":[' || joined || ']}'
    WHEN 11 THEN '[]'
    WHEN 14 THEN '{"events":[' || joined || ']}'
    ELSE '[' || joined || ']' END AS body, joined
  FROM texts
),
shaped AS (
  SELECT batch_no, r, CASE r
    WHEN 15 THEN '[' || joined || ']' || repeat(' ', 70000)
    WHEN 16 THEN '{"note":' || repeat('[', 39) || repeat(']', 39) || ',"events":[' || joined || ']}'
    WHEN 17 THEN '{"note":[' || repeat('0,', 6000) || '0],"events":[' || joined || ']}'
    WHEN 18 THEN '[' || joined || ',' || joined || ']'
    ELSE body END AS body
  FROM bodies
)"""


def _raw(body: str, *ctes: str) -> str:
    return _with(body, _BODIES, *ctes)


_SPOOL = """
spool AS (
  SELECT batch_no AS spool_index, strlen(body) AS n_bytes, r,
    CASE WHEN batch_no % 9 = 0 THEN 'batch-' || lpad(CAST(batch_no AS VARCHAR), 8, '0') || '.json'
         ELSE 'batch-' || batch_no || '.json' END AS file_name
  FROM bodies WHERE batch_no % 9 NOT IN (4, 7)
)"""


def _fill(n: int, limit: int = 2000) -> str:
    """Last ``n`` buckets with the gaps between them as zero buckets."""
    zeroes = ", ".join("0" for _ in COUNTERS)
    return f"""
recent AS (SELECT * FROM minutes ORDER BY minute_ms DESC LIMIT {n}),
ends AS (SELECT min(minute_ms) AS lo, max(minute_ms) AS hi, count(*) AS n FROM recent),
filled AS (
  SELECT minute_ms, {_LIST} FROM recent
  UNION ALL
  SELECT g.m, {zeroes} FROM (
    SELECT unnest(generate_series(lo, hi, 60000)) AS m FROM ends
    WHERE n >= 2 AND (hi - lo) // 60000 + 1 <= {limit}
  ) g WHERE g.m NOT IN (SELECT minute_ms FROM recent)
)"""


def _panel(window: str, n: int) -> str:
    return _minute_sql(
        f"SELECT '{window}' AS window_name, points, {_METRICS} FROM"
        f" (SELECT {_MERGE}, CAST(count(*) AS BIGINT) AS points FROM filled)",
        _fill(n),
    )


_GAUGE = """
steps AS (
  SELECT timestamp_ms // 60000 * 60000 AS minute_ms, timestamp_ms, event_id,
    CASE WHEN event_type = 'video_start' THEN 1 ELSE -1 END AS step
  FROM pe WHERE event_type IN ('video_start', 'playback_end')
),
sums AS (SELECT *, sum(step) OVER (ORDER BY timestamp_ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM steps),
lows AS (SELECT *, min(s) OVER (ORDER BY timestamp_ms, event_id ROWS UNBOUNDED PRECEDING) AS low FROM sums),
gauge AS (
  SELECT minute_ms, CAST(arg_max(s - least(0, low), (timestamp_ms, event_id)) AS BIGINT) AS active_sessions
  FROM lows GROUP BY 1
)"""

_LINKED = """
linked AS (
  SELECT *, lag(value) OVER w AS pv, lag(ts_ms) OVER w AS pt FROM samples
  WINDOW w AS (PARTITION BY series ORDER BY ts_ms, event_id)
)"""
_RATE = """CASE WHEN pt IS NOT NULL AND ts_ms > pt AND value >= pv
  THEN CAST(value - pv AS DOUBLE) / (CAST(ts_ms - pt AS DOUBLE) / 1000.0) ELSE 0.0 END"""

_DOCS = """
docs AS (
  SELECT 'minutes-' || strftime(make_timestamp(minute_ms * 1000), '%Y-%m-%d') AS doc_id,
    day(make_timestamp(minute_ms * 1000)) % 8 AS kind
  FROM minutes GROUP BY 1, 2
  UNION ALL SELECT 'players-0-0', 0 UNION ALL SELECT 'devices-0-0', 0
)"""


def oracle() -> dict[str, str]:
    o: dict[str, str] = {}

    o["typed_events"] = _with("SELECT * FROM pe")
    o["minute_key"] = _with(
        f"""SELECT event_id, timestamp_ms // 60000 * 60000 AS minute_ms, {_iso('timestamp_ms')} AS minute,
          CAST(year(t) AS INTEGER) AS y, CAST(month(t) AS INTEGER) AS mo, CAST(day(t) AS INTEGER) AS d,
          CAST(hour(t) AS INTEGER) AS h, CAST(minute(t) AS INTEGER) AS mi,
          timestamp_ms // 60000 * 60000 AS label_ms
        FROM (SELECT *, make_timestamp(timestamp_ms * 1000) AS t FROM pe)"""
    )
    o["time_domain"] = _with(
        """SELECT event_id, timestamp_ms BETWEEN 0 AND 253402300799999 AS in_domain,
          m BETWEEN 0 AND 253402300799999 AS moved_in_domain,
          m - ((m % 60000) + 60000) % 60000 AS moved_minute_ms
        FROM (SELECT *, timestamp_ms - 1705500000000 AS m FROM pe)"""
    )
    samples = []
    for field in ("startup_time_ms", "buffer_duration_ms", "bitrate_kbps", "watch_time_ms"):
        samples += [
            f"CAST(count({field}) AS BIGINT) AS {field}_present",
            f"CAST(count(*) FILTER (WHERE {field} < 0) AS BIGINT) AS {field}_negative",
            f"CAST(count(*) FILTER (WHERE {field} >= 0) AS BIGINT) AS {field}_usable",
        ]
    o["negative_samples"] = _with(f"SELECT {', '.join(samples)} FROM pe")

    o["totals_direct"] = _with(f"SELECT {_FOLD} FROM pe")
    o["totals"] = o["totals_direct"]
    o["minute_rollup"] = _minute_sql(
        f"SELECT minute_ms, {_iso('minute_ms')} AS minute, {_LIST}, {_STARTUP}, {_BUFFER},"
        f" {_WATCH}, {_BITRATE} FROM minutes"
    )
    o["merge_partials"] = _minute_sql(f"SELECT minute_ms, {_LIST} FROM minutes")
    o["by_player"] = _with(f"SELECT name, {_METRICS} FROM ({_labels('player')})")
    o["by_device"] = _with(f"SELECT name, {_METRICS} FROM ({_labels('device')})")
    o["multi_rollup"] = _minute_sql("SELECT * FROM multi", _MULTI)
    o["minute_count"] = _minute_sql("SELECT CAST(count(*) AS BIGINT) AS minutes_tracked FROM minutes")
    o["overall"] = _with(
        f"SELECT minutes_tracked, {_METRICS} FROM (SELECT {_FOLD},"
        " CAST(count(DISTINCT timestamp_ms // 60000) AS BIGINT) AS minutes_tracked FROM pe)"
    )

    o["capped_players"] = _capped("session_id", R.PLAYER_CAP.max_segments)
    o["capped_unbroadcast"] = o["capped_players"]
    o["capped_devices"] = _capped("device", R.DEVICE_CAP.max_segments)
    o["capped_reserved"] = _capped(
        "CASE WHEN device = 'device1' THEN '__other__' ELSE session_id END",
        R.PLAYER_CAP.max_segments,
    )
    first = lambda c: (
        f"SELECT {c} FROM pe WHERE {c} <> '' GROUP BY 1 ORDER BY min(event_id), 1"
        f" LIMIT {R.DEVICE_CAP.max_segments}"
    )
    o["segment_overflows"] = _with(
        f"""SELECT CAST((SELECT count(*) FROM pe WHERE session_id NOT IN ({first('session_id')}))
          + (SELECT count(*) FROM pe WHERE device <> '' AND device NOT IN ({first('device')})) AS BIGINT)
          AS segment_overflows"""
    )

    rows = f"SELECT minute_ms, {_iso('minute_ms')} AS minute, {_MINUTE_METRICS}"
    o["minute_point"] = _minute_sql(
        f"{rows} FROM minutes WHERE minute_ms = {R.POINT_MS // 60000 * 60000}"
    )
    o["live_recent"] = _minute_sql(f"{rows} FROM recent", _recent(R.LIVE_BUCKETS))
    o["live_clamped"] = _minute_sql(f"{rows} FROM recent", _recent(R.CLAMP.max_minutes))
    in_range = f"minute_ms BETWEEN {_LO // 60000 * 60000} AND {_HI // 60000 * 60000}"
    bounds = f"{_iso(str(_LO))} AS from_minute, {_iso(str(_HI))} AS to_minute"
    o["minute_range"] = _minute_sql(f"{rows}, {bounds} FROM minutes WHERE {in_range}")
    o["fill_gaps"] = _minute_sql(f"{rows} FROM filled", _fill(R.FILL_BUCKETS))
    o["window_totals"] = _minute_sql(
        f"SELECT {_METRICS} FROM (SELECT {_MERGE} FROM recent)", _recent(R.FILL_BUCKETS)
    )
    o["kpi_panel"] = "\nUNION ALL\n".join(
        f"SELECT * FROM ({_panel(w, n)})"
        for w, n in (("15m", 15), ("1h", 60), ("6h", 360), ("24h", 1440))
    )
    o["segments_ranked"] = _with(
        f"SELECT name, CAST(watch_time_ms_sum AS DOUBLE) / 60000.0 AS value FROM ({_labels('player')})"
    )
    label = f"substr({_iso('minute_ms')}, 12, 5) AS label"
    o["chart_series"] = _minute_sql(
        f"SELECT minute_ms, {label}, {_mean('startup_time_ms_sum', 'startup_samples')} AS value FROM minutes"
    )
    long = " UNION ALL ".join(
        f"SELECT minute_ms, label, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM wide"
        for m in PLOTTABLE
    )
    o["chart_all"] = _minute_sql(
        long, f"wide AS (SELECT minute_ms, {label}, {_MINUTE_METRICS} FROM minutes)"
    )

    o["active_sessions"] = _with("SELECT * FROM gauge", _GAUGE)
    arrival = "timestamp_ms // 86400000, event_id % 1000, event_id // 1000"
    o["active_sessions_arrival"] = _with(
        "SELECT * FROM gauge", _GAUGE.replace("timestamp_ms, event_id ROWS", f"{arrival} ROWS").replace(
            "(timestamp_ms, event_id)) AS", f"({arrival})) AS"
        )
    )
    o["counter_rate"] = _with(
        f"SELECT series, ts_ms, event_id, value, {_RATE} AS rate FROM linked",
        "samples AS (SELECT device AS series, timestamp_ms AS ts_ms, event_id, event_id * 7 % 1000 AS value FROM pe)",
        _LINKED,
    )
    running = (
        "samples AS (SELECT 'p' AS series, minute_ms AS ts_ms, minute_ms AS event_id,"
        " CAST(sum(total_events) OVER (ORDER BY minute_ms) AS BIGINT) AS value FROM minutes)"
    )
    o["events_per_sec"] = _minute_sql(
        f"SELECT ts_ms AS minute_ms, value AS running_events, {_RATE} AS events_per_sec FROM linked",
        running,
        _LINKED,
    )
    o["status_row"] = _minute_sql(
        f"""SELECT total_events, error_count,
          CAST(error_count AS DOUBLE) / CAST(total_events AS DOUBLE) AS error_rate,
          (SELECT arg_max({_RATE}, ts_ms) FROM linked) AS events_per_sec,
          (SELECT arg_max(active_sessions, minute_ms) FROM gauge) AS active_sessions
        FROM (SELECT {_MERGE} FROM minutes)""",
        running,
        _LINKED,
        _GAUGE,
    )
    o["session_audit"] = _with(
        """SELECT session_id, CAST(n AS BIGINT) AS n_events, CAST(back AS BIGINT) AS steps_back,
          starts_ok, ends_ok, one_player, one_device, back = 0 AS in_order, watch_ok,
          starts_ok AND ends_ok AND one_player AND one_device AND back = 0 AND watch_ok AS well_formed
        FROM (
          SELECT session_id, count(*) AS n, count(*) FILTER (WHERE timestamp_ms < prev) AS back,
            arg_min(event_type = 'video_start', event_id) AS starts_ok,
            arg_max(event_type = 'playback_end', event_id) AS ends_ok,
            count(DISTINCT player) = 1 AS one_player, count(DISTINCT device) = 1 AS one_device,
            coalesce(arg_max(event_type = 'playback_end', event_id)
              AND max(CASE WHEN event_id = top THEN watch_time_ms END)
                = arg_max(timestamp_ms, event_id) - arg_min(timestamp_ms, event_id), false) AS watch_ok
          FROM (SELECT *, lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY event_id) AS prev,
                  max(event_id) OVER (PARTITION BY session_id) AS top FROM pe)
          GROUP BY 1)"""
    )

    o["verdicts"] = _raw(
        f"SELECT batch_id, status, {_HTTP} AS http_status, first_idx, reason, message, n_events FROM judged"
    )
    o["reject_reasons"] = _raw(
        "SELECT status, reason, CAST(count(*) AS BIGINT) AS n_batches,"
        " CAST(sum(first_idx) AS BIGINT) AS sum_first_idx FROM judged GROUP BY 1, 2"
    )
    o["verdict_counts"] = _raw(
        f"SELECT status, {_HTTP} AS http_status, CAST(count(*) AS BIGINT) AS n_batches,"
        " CAST(sum(n_events) AS BIGINT) AS n_events FROM judged GROUP BY 1, 2"
    )
    o["accepted_events"] = _raw("SELECT * FROM accepted")
    o["ingest_accept"] = _raw(
        f"SELECT timestamp_ms // 60000 * 60000 AS minute_ms, {_FOLD} FROM accepted GROUP BY 1"
    )
    o["duplicate_batches"] = _raw(
        f"SELECT timestamp_ms // 60000 * 60000 AS minute_ms, {_FOLD}"
        " FROM (SELECT * FROM accepted UNION ALL SELECT * FROM accepted) GROUP BY 1"
    )
    o["ts_default"] = _raw(
        "SELECT batch_id, idx, event_type, timestamp_ms FROM accepted WHERE timestamp_ms = ingest_time_ms"
    )
    shift, late = R.RECEIPT_SHIFT_MS, R.SHORT_WINDOW.max_lateness_ms
    o["freshness_filter"] = _raw(
        "SELECT batch_id, idx, timestamp_ms FROM accepted WHERE timestamp_ms BETWEEN"
        f" ingest_time_ms - {shift} - {late} AND ingest_time_ms - {shift} + 300000"
    )
    o["ingest_stats"] = _raw(
        """SELECT CAST(count(*) AS BIGINT) AS batches,
          CAST(count(*) FILTER (WHERE status = 'accepted') AS BIGINT) AS accepted_batches,
          CAST(count(*) FILTER (WHERE status <> 'accepted') AS BIGINT) AS rejected_batches,
          CAST(coalesce(sum(n_events) FILTER (WHERE status = 'accepted'), 0) AS BIGINT) AS events,
          CAST(count(*) FILTER (WHERE status = 'invalid_json') AS BIGINT) AS unparseable_batches
        FROM judged"""
    )
    elements = """
elements AS (
  SELECT CAST(batch_no AS VARCHAR) AS batch_id, ingest_time_ms, idx,
    is_object AND event_type IS NOT NULL AND event_type <> 'bogus' AS parsed,
    CASE WHEN is_object THEN event_type END AS event_type,
    CASE WHEN is_object THEN session_id ELSE '' END AS session_id,
    CASE WHEN is_object AND NOT player_is_number THEN player ELSE '' END AS player,
    CASE WHEN is_object THEN device ELSE '' END AS device,
    CASE WHEN is_object AND NOT stamp_absent AND NOT stamp_is_text THEN timestamp_ms ELSE 0 END AS timestamp_ms,
    CASE WHEN is_object THEN startup_time_ms END AS startup_time_ms,
    CASE WHEN is_object THEN buffer_duration_ms END AS buffer_duration_ms,
    CASE WHEN is_object THEN bitrate_kbps END AS bitrate_kbps,
    CASE WHEN is_object THEN watch_time_ms END AS watch_time_ms,
    CASE WHEN is_object THEN error_code END AS error_code
  FROM sent WHERE r NOT IN (6, 10, 11)
)"""
    o["parse_events"] = _raw("SELECT * FROM elements", elements)
    o["parse_counts"] = _raw(
        """SELECT CAST(count(*) AS BIGINT) AS n_elements,
          CAST(count(*) FILTER (WHERE parsed) AS BIGINT) AS n_events,
          CAST(count(*) FILTER (WHERE NOT parsed) AS BIGINT) AS parse_failures FROM elements""",
        elements,
    )
    o["scan_shape"] = _raw(
        r"""SELECT CAST(batch_no AS VARCHAR) AS batch_id, CAST(any_value(n_bytes) AS BIGINT) AS n_bytes,
          CAST(any_value(n_tokens) AS BIGINT) AS n_tokens, CAST(max(depth) AS BIGINT) AS depth
        FROM (
          SELECT batch_no, n_bytes, n_tokens, sum(CASE c WHEN '[' THEN 1 WHEN '{' THEN 1 WHEN ',' THEN 0 ELSE -1 END)
            OVER (PARTITION BY batch_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth
          FROM (SELECT batch_no, n_bytes, length(skel) AS n_tokens,
                  unnest(range(1, length(skel) + 1)) AS pos, unnest(string_split(skel, '')) AS c
                FROM skels))
        GROUP BY batch_no""",
        _TEXTS,
        r"""
skels AS (
  SELECT batch_no, strlen(body) AS n_bytes,
    regexp_replace(regexp_replace(body, '"[^"]*"', '', 'g'), '[^{}\[\],]', '', 'g') AS skel
  FROM shaped
)""",
    )
    o["verdicts_tight"] = _raw(
        f"""SELECT batch_id, status, {_HTTP} AS http_status, first_idx, reason, n_events FROM (
          SELECT batch_id,
            CASE r WHEN 15 THEN 'too_large' WHEN 16 THEN 'invalid_schema' WHEN 17 THEN 'invalid_schema'
              WHEN 18 THEN 'invalid_schema' ELSE status END AS status,
            first_idx,
            CASE r WHEN 15 THEN 'body_too_large' WHEN 16 THEN 'too_deep' WHEN 17 THEN 'too_many_tokens'
              WHEN 18 THEN 'too_many_events' ELSE reason END AS reason,
            CASE WHEN r IN (15, 16, 17) THEN 0 WHEN r = 18 THEN 2 * n_events ELSE n_events END AS n_events
          FROM judged)"""
    )
    o["backfill_batches"] = _raw(
        "SELECT spool_index, file_name, CAST(n_bytes AS INTEGER) AS n_bytes, r <> 6 AS usable FROM spool",
        _TEXTS,
        _SPOOL,
    )
    o["backlog_retain"] = _raw(
        f"SELECT spool_index, file_name FROM spool ORDER BY spool_index DESC LIMIT {R.BACKLOG}",
        _TEXTS,
        _SPOOL,
    )

    o["snapshot_roundtrip"] = o["multi_rollup"]
    counter = "counter {} is absent or no count of 0 or more"
    o["snapshot_validate"] = _minute_sql(
        f"""SELECT doc_id, CAST(CASE kind WHEN 1 THEN 3 WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE 2 END AS INTEGER) AS version,
          CASE kind WHEN 1 THEN 'version 3 is not supported'
            WHEN 2 THEN '{counter.format('total_views')}'
            WHEN 3 THEN '{counter.format('buffer_samples')}'
            WHEN 4 THEN 'minute field h is not an integer within 0..23'
            WHEN 5 THEN 'snapshot is not valid JSON'
            WHEN 6 THEN 'minutes is not a list'
            WHEN 7 THEN 'the version is no integer' END AS reason
        FROM docs""",
        _DOCS,
    )
    o["snapshot_load_json"] = _minute_sql(
        "SELECT * FROM multi WHERE grain <> 'minute' OR day(make_timestamp(minute_ms * 1000)) % 8 = 0",
        _MULTI,
    )
    o["snapshot_refused"] = o["snapshot_load_json"]
    o["snapshot_migrate_v1"] = _with(
        f"SELECT name, {_METRICS} FROM (SELECT * REPLACE (CAST(0 AS BIGINT) AS buffer_samples)"
        f" FROM ({_labels('device')}))"
    )
    o["restore_additive"] = _minute_sql(
        "SELECT grain, minute_ms, name, "
        + ", ".join(f"CAST(2 * {c} AS BIGINT) AS {c}" for c in COUNTERS)
        + " FROM multi",
        _MULTI,
    )
    o["restore_capped"] = _with(
        f"""SELECT name, {_METRICS} FROM (
          SELECT coalesce(slot, '__other__') AS name, {_MERGE}
          FROM (SELECT name AS lab, {_LIST} FROM old UNION ALL SELECT lab, {_LIST} FROM live)
          LEFT JOIN slots ON lab = slot GROUP BY 1)""",
        f"old AS ({_labels('player')})",
        f"live AS (SELECT session_id AS lab, min(event_id) AS seen, {_FOLD} FROM pe GROUP BY 1)",
        f"""slots AS (
          SELECT lab AS slot FROM (
            SELECT name AS lab, 0 AS live, 0 AS seen FROM old UNION ALL SELECT lab, 1, seen FROM live)
          ORDER BY live, seen, lab LIMIT {R.RESTORE_CAP.max_segments})""",
    )

    cap = R.STORE_CAP.max_segments
    added = lambda side: (
        f"SELECT '{side}' AS dimension, name, {_METRICS} FROM (SELECT coalesce(slot, '__other__') AS name, {_MERGE}"
        f" FROM {side}s LEFT JOIN {side}_slots ON lab = slot GROUP BY 1)"
    )
    o["restore_store_capped"] = _with(
        f"{added('player')} UNION ALL {added('device')}",
        f"old AS ({_labels('player')})",
        f"live AS (SELECT session_id AS lab, min(event_id) AS seen, {_FOLD} FROM pe GROUP BY 1)",
        f"dev AS ({_labels('device')})",
        f"""first_slots AS (SELECT name AS slot FROM old WHERE name <> '__other__' ORDER BY name LIMIT {cap})""",
        """later AS (SELECT lab AS slot, row_number() OVER (ORDER BY seen, lab) AS k FROM live
          WHERE lab NOT IN (SELECT slot FROM first_slots))""",
        f"""player_slots AS (SELECT slot FROM first_slots UNION ALL
          SELECT slot FROM later WHERE k <= {cap} - (SELECT count(*) FROM first_slots))""",
        f"device_slots AS (SELECT name AS slot FROM dev WHERE name <> '__other__' ORDER BY name LIMIT {cap})",
        f"""players AS (SELECT name AS lab, {_LIST} FROM old
          UNION ALL SELECT lab, {_LIST} FROM live UNION ALL SELECT lab, {_LIST} FROM live)""",
        f"""devices AS (SELECT name AS lab, {_LIST} FROM dev
          UNION ALL SELECT name, {_LIST} FROM dev UNION ALL SELECT name, {_LIST} FROM dev)""",
    )
    order = f"CAST(batch_id AS BIGINT) % {R.EPOCHS}, ingest_time_ms, batch_id, idx"
    folds = lambda side: (
        f"(SELECT count(*) FROM accepted WHERE {side} NOT IN ('', '__other__') AND {side} NOT IN (SELECT lab FROM"
        f" (SELECT {side} AS lab, min(({order})) AS seen FROM accepted"
        f" WHERE {side} NOT IN ('', '__other__') GROUP BY 1 ORDER BY seen, lab LIMIT {R.LEDGER_CAP.max_segments})))"
    )
    o["ingest_ledger"] = _raw(
        f"""SELECT CAST(count(*) AS BIGINT) AS batches,
          CAST(count(*) FILTER (WHERE status = 'accepted') AS BIGINT) AS accepted_batches,
          CAST(count(*) FILTER (WHERE status <> 'accepted') AS BIGINT) AS rejected_batches,
          CAST(count(*) FILTER (WHERE status = 'invalid_json') AS BIGINT) AS unparseable_batches,
          CAST(coalesce(sum(n_events) FILTER (WHERE status = 'accepted'), 0) AS BIGINT) AS events,
          CAST(0 AS BIGINT) AS parse_failures, CAST(0 AS BIGINT) AS process_errors,
          CAST({folds('player')} + {folds('device')} AS BIGINT) AS segment_overflows
        FROM judged"""
    )
    o["ingest_quarantine"] = _raw(
        f"""SELECT j.batch_id, CAST(NULL AS INTEGER) AS idx, j.reason, j.message, CAST(strlen(b.body) AS INTEGER) AS n_bytes,
          CAST(j.batch_no % {R.EPOCHS} AS BIGINT) AS epoch_id
        FROM judged j JOIN bodies b USING (batch_no) WHERE j.status <> 'accepted'""",
        _TEXTS,
    )
    o["store_recent"] = o["live_recent"]
    o["range_requests"] = _minute_sql(
        f"""SELECT request_id, outcome,
          CASE WHEN outcome = 'ok' THEN {_iso('lo')} END AS from_minute,
          CASE WHEN outcome = 'ok' THEN {_iso('hi')} END AS to_minute, buckets, {_METRICS}
        FROM (SELECT request_id, outcome, lo, hi, CAST(count(minute_ms) AS BIGINT) AS buckets, {_MERGE}
          FROM asked LEFT JOIN minutes ON outcome = 'ok'
            AND minute_ms BETWEEN lo // 60000 * 60000 AND hi // 60000 * 60000
          GROUP BY 1, 2, 3, 4)""",
        """texts AS (SELECT event_id AS request_id, event_id % 11 AS c,
          CAST(timestamp_ms - (event_id % 90) * 60000 AS VARCHAR) AS low,
          CAST(timestamp_ms + (event_id % 1500) * 60000 AS VARCHAR) AS high FROM pe)""",
        """bounds AS (SELECT request_id,
          CASE WHEN c IN (3, 5) THEN NULL WHEN c = 7 THEN CAST(high || '0' AS BIGINT)
               WHEN c = 9 THEN -1 ELSE CAST(low AS BIGINT) END AS lo,
          CASE WHEN c = 4 THEN NULL WHEN c = 8 THEN 1 ELSE CAST(high AS BIGINT) END AS hi FROM texts)""",
        """asked AS (SELECT request_id, lo, hi, CASE WHEN lo IS NULL OR hi IS NULL THEN 'missing_bound'
          WHEN lo < 0 OR lo > 253402300799999 OR hi < 0 OR hi > 253402300799999 THEN 'out_of_domain'
          WHEN lo > hi THEN 'reversed' WHEN (hi - lo) // 60000 + 1 > 1440 THEN 'too_wide' ELSE 'ok' END AS outcome
          FROM bounds)""",
    )

    o["doc_overall"] = o["overall"]
    pos = "CAST(row_number() OVER (ORDER BY minute_ms) - 1 AS INTEGER) AS pos"
    doc_rows = f"SELECT {pos}, {_iso('minute_ms')} AS minute, {_MINUTE_METRICS}"
    o["doc_live"] = _minute_sql(f"{doc_rows} FROM recent", _recent(R.LIVE_BUCKETS))
    o["doc_range"] = _minute_sql(f"{doc_rows}, {bounds} FROM minutes WHERE {in_range}")
    o["doc_players"] = _with(
        "SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS pos,"
        f" name, {_METRICS} FROM ({_labels('player')})"
    )
    return o
