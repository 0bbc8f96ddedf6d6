"""Raw batches from files, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.operators.validate import parse_whole
from playtally.schema import RAW_BATCHES

# A spooled batch is named by its number; leading zeroes do not order it.
SPOOL_GLOB = "batch-*.json"
_SPOOL_NAME = r"^batch-(\d+)\.json$"
_LARGEST_INDEX = "18446744073709551615"


def _bodies(files: DataFrame, ingest_time_ms: int | None) -> DataFrame:
    received = (
        F.unix_millis(F.col("_metadata.file_modification_time"))
        if ingest_time_ms is None
        else F.lit(ingest_time_ms).cast("bigint")
    )
    return files.select(
        F.col("_metadata.file_name").alias("batch_id"),
        received.alias("ingest_time_ms"),
        F.col("value").alias("body"),
    )


def read_bodies(spark: SparkSession, path: str, ingest_time_ms: int | None = None) -> DataFrame:
    """One row per file. Receipt time is the file time unless given."""
    return _bodies(spark.read.format("text").option("wholetext", True).load(path), ingest_time_ms)


def stream_bodies(
    spark: SparkSession,
    path: str,
    ingest_time_ms: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """The same over files as they appear; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _bodies(reader.load(path), ingest_time_ms)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Raw batches kept as Parquet, the form to prefer for large backlogs."""
    return spark.read.schema(RAW_BATCHES).parquet(path)


def stream_batches(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_BATCHES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def kafka_batches(frame: DataFrame) -> DataFrame:
    """Raw batches from the columns of a Kafka source (``value`` ...)."""
    return frame.select(
        F.concat_ws("-", "topic", "partition", "offset").alias("batch_id"),
        F.unix_millis("timestamp").alias("ingest_time_ms"),
        F.col("value").cast("string").alias("body"),
    )


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """Files of a spool directory (``file_name``, ``body``)."""
    files = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", SPOOL_GLOB)
        .load(path)
    )
    return files.select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("body")
    )


def replayed(numbered: DataFrame, ingest_time_ms: int) -> DataFrame:
    """Raw batches of the usable files, oldest number first when sorted by ``batch_id``."""
    number = F.lpad(F.col("spool_index").cast("string"), 20, "0")
    return numbered.where("usable").select(
        F.concat_ws("-", number, "file_name").alias("batch_id"),
        F.lit(ingest_time_ms).cast("bigint").alias("ingest_time_ms"),
        "body",
    )


def backfill(spooled: DataFrame) -> DataFrame:
    """Numbered batches of a spool; other names are left out.

    ``spool_index`` orders the replay; ``usable`` is false for a text that is
    no JSON, which is counted and set aside without holding up the rest.
    """
    index = F.regexp_extract("file_name", _SPOOL_NAME, 1)
    numbered = spooled.where(F.col("file_name").rlike(_SPOOL_NAME)).withColumn(
        # Twenty digits hold any 64-bit number; longer ones are no index.
        "spool_index", index.try_cast("decimal(38,0)")
    )
    fits = F.col("spool_index") <= F.lit(_LARGEST_INDEX).cast("decimal(38,0)")
    return numbered.where(fits).select(
        F.col("spool_index").cast("decimal(20,0)").alias("spool_index"),
        "file_name",
        "body",
        F.expr(parse_whole("body")).isNotNull().alias("usable"),
    )


def retain_newest(spooled: DataFrame, index: str, max_batches: int = 1000) -> DataFrame:
    """The newest ``max_batches`` files of a backlog (at least one).

    Files may share a number (3, 03); of those the last name is the newest.
    The top-N runs over numbers and names alone; bodies are kept by a semi join
    on them and never pass through one task together.
    """
    keys = [index, "file_name"]
    newest = spooled.select(*keys).orderBy(*[F.col(c).desc() for c in keys]).limit(max(max_batches, 1))
    return spooled.join(newest, keys, "left_semi")


def backlog_counts(spooled: DataFrame, max_batches: int = 1000) -> DataFrame:
    """Numbered files of a spool, those that :func:`retain_newest` evicts, and unusable ones."""
    n = F.count(F.lit(1))
    return spooled.agg(
        n.alias("numbered"),
        F.greatest(n - F.lit(max(max_batches, 1)), F.lit(0)).cast("bigint").alias("evicted"),
        F.count_if(~F.col("usable")).alias("unusable"),
    )
