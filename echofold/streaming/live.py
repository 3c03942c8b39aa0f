"""Recordings and airings as they arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timeparse import NAME_PATTERNS, name_time
from ..kernels.axis import Axis
from ..plans.mine import lay
from ..sources.audio import EXTENSIONS, decoded


def arrivals(spark: SparkSession, folder: str, zone: str = "UTC") -> DataFrame:
    """(path, start) of recordings as they appear in a folder; contents are not read here."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name_time(name, NAME_PATTERNS[0], zone).alias("start"))
    return rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*EXTENSIONS) & F.col("start").isNotNull())


def decode_arrivals(inputs: DataFrame, frames: str, table: str, checkpoint: str, timeout: float = 900.0) -> StreamingQuery:
    """Decodes each micro-batch of inputs and writes its rows under its own number, so that a batch that runs twice counts once."""

    def step(batch: DataFrame, number: int) -> None:
        decoded(batch, frames, timeout).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return inputs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def axis_so_far(spark: SparkSession, frames: str, table: str) -> Axis:
    """The axis of all that has been decoded; mining it again covers the whole period."""
    rows = spark.read.parquet(table).where("error is null").select("path", "start_us", "file", "n")
    return lay(frames, [r.asDict() for r in rows.toLocalIterator()])


def coverage(airings: DataFrame, at: str, key: Column, lateness: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Airings per window and key, for windows that the watermark has passed; tumbling, or sliding if slide is given."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return airings.withWatermark(at, lateness).groupBy(w.alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def sessions(airings: DataFrame, at: str, key: Column, gap: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Stretches of a key's airings without a gap."""
    return airings.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def once(airings: DataFrame, at: str, ids: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Drops what overlapping recordings report again within the watermark."""
    return airings.withWatermark(at, lateness).dropDuplicatesWithinWatermark(ids)
