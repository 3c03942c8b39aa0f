"""Reading listed airings and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparse import text_time

LISTED = "id long, result_id long, name string, dur double, record_path string, start_time double, end_time double"
RESULT = """Clusters array<struct<ID: long, DurationSec: double, Occurrences: array<struct<Start: string, End: string, File: string, OffsetSec: double>>,
 Representative: string, IsSpot: boolean, Reason: string>>, Skipped array<struct<Path: string, Reason: string>>, Warnings array<string>,
 Stats struct<Files: long, AudioSec: double, Frames: long, Windows: long, SeedPairs: long, VerifiedPairs: long, Matches: long, PeakRSSBytes: long, FeatureBytes: long, IndexBytes: long, WallSec: double>"""


def listed(spark: SparkSession, folder: str, zone: str = "UTC") -> DataFrame:
    """Airings of tab-separated lists, one list a file: file_no, name, dur, day, start_us, end_us.

    An airing begins at its recording's time, which the recording's name has, plus its offset.
    """
    rows = spark.read.csv(f"{folder}/*.tsv", sep="\t", header=True, schema=LISTED).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_file"))
    stamp = F.regexp_extract("record_path", r"(\d{4}-\d{2}-\d{2})[-_T](\d{2})[-:](\d{2})[-:](\d{2})", 0)
    day, clock = F.substring(stamp, 1, 10), F.regexp_replace(F.substring(stamp, 12, 8), "[-:]", ":")
    base = F.unix_micros(text_time(F.concat(day, F.lit(" "), clock), zone))
    at = lambda c: base + F.round(F.col(c) * 1_000_000).cast("long")
    return rows.select(F.regexp_extract("_file", r"(\d+)", 1).cast("long").alias("file_no"), "id", "name", "dur", day.alias("day"), at("start_time").alias("start_us"), at("end_time").alias("end_us"))


def result(spark: SparkSession, path: str) -> DataFrame:
    """Airings of a stored result, with their cluster: cluster_id, duration, is_spot, reason, start_us, end_us, file."""
    rows = spark.read.schema(RESULT).json(path, multiLine=True).select(F.explode("Clusters").alias("c"))
    o = rows.select("c.ID", "c.DurationSec", "c.IsSpot", "c.Reason", F.explode("c.Occurrences").alias("o"))
    us = lambda c: F.unix_micros(text_time(F.col(c)))
    return o.select(F.col("ID").alias("cluster_id"), F.col("DurationSec").alias("duration"), F.col("IsSpot").alias("is_spot"), F.col("Reason").alias("reason"), us("o.Start").alias("start_us"), us("o.End").alias("end_us"), F.col("o.File").alias("file"))
