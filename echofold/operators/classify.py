"""The verdict ladder: which clusters are spots, and by which rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPOT_MIN, SPOT_MAX = 8, 120
HOURLY_MIN, HOURLY_SHARE = 4, 0.8


def ladder(clusters: DataFrame) -> DataFrame:
    """clusters: d (seconds), unit (seconds of the unit it belongs to), n, top (airings in its commonest minute), accompanied.

    Adds rule, the first that holds, and is_spot. 8 and 120 seconds are spot-length.
    """
    rule = (
        F.when(F.col("unit") > SPOT_MAX, "long unit")
        .when(F.col("d") < SPOT_MIN, "short")
        .when(F.col("d") > SPOT_MAX, "long")
        .when((F.col("n") >= HOURLY_MIN) & (F.col("top") >= HOURLY_SHARE * F.col("n")), "hourly")
        .when(F.col("accompanied"), "accompanied")
        .otherwise("alone")
    )
    return clusters.withColumn("rule", rule).withColumn("is_spot", F.col("rule").isin("accompanied", "alone"))
