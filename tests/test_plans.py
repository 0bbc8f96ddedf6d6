"""Shape of the physical plans: what is shuffled, broadcast and pushed down."""

from __future__ import annotations

import re

import pytest

from playtally.operators import gauge, labels, rates, rollups, timeseries
from playtally.operators.validate import accepted_events, verdicts, with_verdict
from playtally.options import RollupOptions
from playtally.plans.registry import registry
from playtally.schema import RAW_BATCHES
from tests.helpers import A, events


@pytest.fixture(scope="module")
def typed(spark, tmp_path_factory):
    """Stored typed events, a table a scan can be pushed into."""
    path = str(tmp_path_factory.mktemp("typed") / "events")
    made = [
        {"event_type": ("video_start", "playback_end")[i % 2], "player": f"p{i % 5}", "device": "d"}
        for i in range(50)
    ]
    events(spark, *made).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def stored_batches(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "batches")
    spark.createDataFrame([("0", A, "[]")], RAW_BATCHES).write.parquet(path)
    return spark.read.parquet(path)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame) -> str:
    frame.collect()
    return plan(frame).split("Initial Plan")[0]


def exchanges(text: str) -> int:
    return len(re.findall(r"- (?:\*\(\d+\) )?Exchange ", text))


@pytest.mark.parametrize(
    "make",
    [
        rollups.by_minute,
        rollups.totals_direct,
        rollups.multi_rollup,
        lambda e: rollups.by_label(e, "player"),
    ],
)
def test_a_rollup_is_one_shuffle_of_partial_hash_aggregates(typed, make):
    text = plan(make(typed))
    assert exchanges(text) == 1
    assert text.count("HashAggregate") == 2 and "partial_count" in text
    assert "SortAggregate" not in text and "Python" not in text


def test_combinations_are_folded_below_the_expansion(typed):
    text = plan(rollups.multi_rollup(typed, fold_first=True))
    # Printed from the top: the expansion reads aggregated rows, and aggregates are partial below each exchange.
    above, below = text.split("Expand", 1)
    assert exchanges(text) == 2 and exchanges(above) == exchanges(below) == 1
    assert "count_if" not in above and "partial_count" not in above
    assert below.count("HashAggregate") == 2 and text.count("FileScan") == 1


def test_a_rollup_reads_only_its_columns(typed):
    text = plan(rollups.by_minute(typed))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "session_id" not in schema and "player" not in schema and "error_code" not in schema


def test_judging_batches_shuffles_nothing(stored_batches):
    for frame in (verdicts(stored_batches), accepted_events(with_verdict(stored_batches))):
        text = plan(frame)
        assert "Exchange" not in text and "Python" not in text
        assert text.count("parseJson") == 1


def test_label_cap_reads_its_input_once(typed):
    text = final_plan(labels.capped_rollup(typed, "player", "event_id", RollupOptions(max_segments=3)))
    assert "TakeOrderedAndProject(limit=3" in text and "Join" not in text
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_overflows_read_each_dimension_once(typed):
    text = final_plan(labels.segment_overflows(typed, "event_id", RollupOptions(max_segments=3)))
    assert text.count("FileScan") == 2 and text.count("ReusedExchange") >= 2


def test_range_is_pushed_to_the_scan(typed):
    events_in = timeseries.within_minutes(typed, A, A + 60_000, "timestamp_ms")
    text = plan(rollups.by_minute(events_in))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(timestamp_ms", text)
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(timestamp_ms", text)


def test_recent_is_a_top_n(typed):
    text = plan(timeseries.recent(rollups.by_minute(typed), 5))
    assert "TakeOrderedAndProject(limit=5" in text
    assert "rangepartitioning" not in text


def test_gauge_splits_steps_by_range_and_reads_once(typed):
    text = final_plan(gauge.active_sessions(typed))
    assert "rangepartitioning(_order0" in text
    assert text.count("FileScan") == 1 and "ReusedExchange" in text
    # What meets in one task is one row per part: the aggregate right below.
    below = text[text.index("SinglePartition") :].splitlines()[1:3]
    assert any("HashAggregate(keys=[part" in line for line in below), below


def test_rates_share_one_exchange(typed):
    samples = typed.selectExpr("player AS series", "timestamp_ms AS ts_ms", "event_id AS value")
    text = final_plan(rates.counter_rate(samples))
    assert text.count("FileScan") == 1 and "ReusedExchange" in text
    assert "hashpartitioning(series" in text and ", slice" in text


def test_no_cross_joins_and_no_row_functions_in_python(spark, sf_dir):
    for name, query in registry().items():
        text = plan(query(spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_status_row_rolls_the_events_up_once(spark, sf_dir):
    """One scan for totals and rate together, one for the gauge."""
    frame = registry()["status_row"](spark, sf_dir)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2
