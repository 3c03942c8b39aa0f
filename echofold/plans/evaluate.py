"""Evaluation of a result against listed airings, and a summary of a result by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import range_join

BUCKET_US = 300_000_000
TIE_US = 500_000


def covered(listed: DataFrame, mined: DataFrame, tol: float = 3.0, days: list[str] | None = None) -> DataFrame:
    """Each listed airing with the mined one that overlaps it most; among those within half a second of the most, the tightest fit.

    listed: file_no, id, name, dur, day, start_us, end_us. mined: cluster_id, is_spot, start_us, end_us.
    Adds best (seconds), cluster_id, is_spot, offset, and verdict: covered, partial or missed.
    """
    if days:
        listed = listed.where(F.col("day").isin(days))
    o = mined.select("cluster_id", "is_spot", F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    met = range_join(listed.select("file_no", "id", "start_us", "end_us"), o, ("start_us", "end_us"), ("s", "e"), BUCKET_US)
    met = met.withColumn("shared", F.least("end_us", "e") - F.greatest("start_us", "s"))
    key = ["file_no", "id"]
    most = met.groupBy(*key).agg(F.max("shared").alias("most"))
    tight = met.join(most, key).where(F.col("shared") >= F.col("most") - TIE_US)
    pick = F.min(F.struct((F.col("e") - F.col("s")).alias("size"), "s", "cluster_id", "is_spot", "shared", (F.col("s") - F.col("start_us")).alias("off")))
    best = tight.groupBy(*key).agg(pick.alias("m")).select(*key, (F.col("m.shared") / 1e6).alias("best"), "m.cluster_id", "m.is_spot", (F.col("m.off") / 1e6).alias("offset"))
    rows = listed.join(best, key, "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    verdict = F.when(F.col("best") >= F.col("dur") - tol, "covered").when(F.col("best") > 0.5 * F.col("dur"), "partial").otherwise("missed")
    return rows.withColumn("verdict", verdict)


def totals(rows: DataFrame) -> DataFrame:
    """listed, covered, partial, recall, and the share of covered airings that are flagged as spots."""
    hit = F.col("verdict") == "covered"
    t = rows.agg(F.count(F.lit(1)).alias("listed"), F.count_if(hit).alias("covered"), F.count_if(F.col("verdict") == "partial").alias("partial"), F.count_if(hit & F.col("is_spot")).alias("flagged"))
    return t.withColumn("recall", F.col("covered") / F.greatest("listed", F.lit(1))).withColumn("flag_share", F.col("flagged") / F.greatest("covered", F.lit(1)))


def fragmentation(rows: DataFrame) -> DataFrame:
    """Per ad that is covered: clusters, airings, and the share of the largest cluster."""
    n = rows.where("verdict = 'covered'").groupBy("name", "cluster_id").agg(F.count(F.lit(1)).alias("k"))
    return n.groupBy("name").agg(F.count(F.lit(1)).alias("clusters"), F.sum("k").alias("airings"), (F.max("k") / F.sum("k")).alias("largest_share"))


def verdicts(listed: DataFrame, mined: DataFrame, tol: float = 3.0) -> DataFrame:
    """The report's own rule, by the greatest overlap alone: found, short, fragment or missing."""
    o = mined.select("cluster_id", F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    met = range_join(listed.select("file_no", "id", "start_us", "end_us"), o, ("start_us", "end_us"), ("s", "e"), BUCKET_US)
    most = met.groupBy("file_no", "id").agg((F.max(F.least("end_us", "e") - F.greatest("start_us", "s")) / 1e6).alias("best"))
    rows = listed.join(most, ["file_no", "id"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    kind = F.when(F.col("best") >= F.col("dur") - tol, "found").when(F.col("best") >= 0.5 * F.col("dur"), "short").when(F.col("best") > 1, "fragment").otherwise("missing")
    return rows.withColumn("verdict", kind)


def per_file(rows: DataFrame) -> DataFrame:
    """found and total of each list, from verdicts()."""
    return rows.groupBy("file_no").agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "found").alias("found")).withColumn("share", F.col("found") / F.col("total"))


def levels(files: DataFrame) -> DataFrame:
    """How many lists are found to each level or more."""
    pct = F.col("share") * 100
    rows = files.select(F.explode(F.filter(F.array(*map(F.lit, (100, 95, 90, 80, 50))), lambda x: x <= pct)).alias("level"))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("level"))


def profile(rows: DataFrame, name: str, top: int = 12) -> DataFrame:
    """What one ad is found as: its commonest (cluster, spot, offset in seconds)."""
    mine = rows.where((F.col("name") == name) & F.col("cluster_id").isNotNull())
    return mine.groupBy("cluster_id", "is_spot", F.round("offset").alias("offset")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id", "offset").limit(top)


def write_report(rows: DataFrame, folder: str) -> None:
    """CSV of all airings and of each list, and the missed ones as text."""
    rows.select("file_no", "id", "name", "dur", "best", "verdict").write.mode("overwrite").csv(f"{folder}/airings", header=True)
    per_file(rows).write.mode("overwrite").csv(f"{folder}/per_file", header=True)
    missed = rows.where("verdict = 'missing'").select(F.concat_ws("\t", "file_no", "id", "name", "start_us").alias("value"))
    missed.write.mode("overwrite").text(f"{folder}/missed")


# ---- a result by itself
def histogram(clusters: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Clusters per half-open bucket [edge, next edge); the last is open-ended, values below the first fall out."""
    value = F.col(column)
    low = F.array_max(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value))
    return clusters.select(low.alias("low")).where("low is not null").groupBy("low").agg(F.count(F.lit(1)).alias("n"))


def per_day(airings: DataFrame) -> DataFrame:
    """Spots' airings a day, and in how many clusters."""
    day = F.to_date(F.timestamp_micros("start_us"))
    return airings.where("is_spot").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("airings"), F.count_distinct("cluster_id").alias("clusters"))


def near_lengths(airings: DataFrame, slack: float = 0.4) -> DataFrame:
    """a, b: spots of nearly one length that never air in the same stretch of days, in which one ad may be parted."""
    c = airings.where("is_spot").groupBy("cluster_id").agg(F.max("duration").alias("d"), F.min("start_us").alias("s"), (F.max("end_us") + 1).alias("e"))
    left = c.select(F.col("cluster_id").alias("a"), F.col("d").alias("da"), F.col("s").alias("sa"), F.col("e").alias("ea"), F.explode(F.array(*[F.floor(F.col("d") / slack) + k for k in (-1, 0, 1)])).alias("k"))
    right = c.select(F.col("cluster_id").alias("b"), F.col("d").alias("db"), F.col("s").alias("sb"), F.col("e").alias("eb"), F.floor(F.col("d") / slack).alias("k"))
    apart = (F.col("ea") <= F.col("sb")) | (F.col("eb") <= F.col("sa"))
    return left.join(right, "k").where((F.col("a") < F.col("b")) & (F.abs(F.col("da") - F.col("db")) <= slack) & apart).select("a", "b", "da", "db")


def reasons(clusters: DataFrame, top: int = 8) -> DataFrame:
    """The commonest reasons, with numbers made N and cut to 70 characters."""
    text = F.substring(F.regexp_replace("reason", r"\d+(\.\d+)?", "N"), 1, 70)
    return clusters.groupBy(text.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(top)


def quantile(column: str, share: float):
    """The value at place floor(share * (n - 1)) of the sorted group; for bounded groups."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, (F.floor(F.lit(share) * (F.size(values) - 1)) + 1).cast("int"))
