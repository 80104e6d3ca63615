"""Reading document change events, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One envelope: the event headers and the JSON body as text.
ENVELOPE_SCHEMA = "event_id string, event_type string, event_time string, body string"


# Gzip files are read whole by one task, so none holds more envelopes than this.
ENVELOPES_PER_FILE = 20_000


def write_envelopes(envelopes: DataFrame, path: str, mode: str = "error") -> None:
    """Deliver envelopes as JSON lines, compressed: their documents repeat every name."""
    envelopes.write.mode(mode).option("compression", "gzip").option(
        "maxRecordsPerFile", ENVELOPES_PER_FILE).json(path)


def read_change_events(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Envelopes from a folder of JSON lines.

    The schema is fixed, so neither form infers anything by reading the data.
    """
    if streaming:
        reader = spark.readStream.schema(ENVELOPE_SCHEMA)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.json(path)
    return spark.read.schema(ENVELOPE_SCHEMA).json(path)


def read_change_topic(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Envelopes from a Kafka topic whose record headers are the event headers."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return envelopes_from_records(reader.load())


def envelopes_from_records(records: DataFrame) -> DataFrame:
    """Kafka-shaped records (value, headers) to envelopes."""

    def header(name: str):
        found = F.filter("headers", lambda h: h["key"] == name)
        return F.get(found, 0)["value"].cast("string")

    return records.select(
        header("ce-id").alias("event_id"),
        header("ce-type").alias("event_type"),
        header("ce-time").alias("event_time"),
        F.col("value").cast("string").alias("body"),
    )
