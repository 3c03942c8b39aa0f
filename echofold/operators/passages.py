"""Repeated passages of texts: windows, seeds, matches on diagonals, host filter.

A document plays the part of a file, a token that of a frame, an eight-token window that of a descriptor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


WINDOW = 8
#: Windows that occur more often are dropped whole, as common phrases.
MAX_BUCKET = 256


def tokens(text: Column) -> Column:
    """White-space tokens of a text; none of a null or blank one."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def windows(docs: DataFrame, key: str, text: str = "text", size: int = WINDOW, out: str = "doc") -> DataFrame:
    """out, pos, h1, h2: each window of size consecutive tokens by 128 bits of hash, so that no text is shuffled.

    Tokens are hashed once; a window hashes its tokens' hashes.
    """
    t = docs.select(F.col(key).alias(out), F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w)).alias("t")).where(F.size("t") >= size)
    at = t.select(out, "t", F.explode(F.sequence(F.lit(1), F.size("t") - (size - 1))).alias("p"))
    words = F.slice("t", F.col("p"), size)
    return at.select(out, (F.col("p") - 1).cast("long").alias("pos"), F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(1), words).alias("h2"))


def bucket_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def seeds(rows: DataFrame, cap: int = MAX_BUCKET) -> DataFrame:
    """a, b (a < b), pa, pb: places of equal windows in two documents, of windows that occur at most cap times.

    Crowded windows are found by a partial aggregation and leave by a join before pairs are made.
    """
    fit = bucket_sizes(rows).where(F.col("n").between(2, cap)).select("h1", "h2")
    kept = rows.join(fit, ["h1", "h2"])
    left = kept.withColumnsRenamed({"doc": "a", "pos": "pa"})
    right = kept.withColumnsRenamed({"doc": "b", "pos": "pb"})
    return left.join(right, ["h1", "h2"]).where("a < b").select("a", "b", "pa", "pb")


def matches(rows: DataFrame, size: int = WINDOW, cap: int = MAX_BUCKET) -> DataFrame:
    """a, b, a_start, a_end, lag (pa - pb), len: seeds on one diagonal merge while they are consecutive.

    Each window knows its neighbours, so a seed whose neighbours on both sides are seeds too is dropped within the join
    that finds it: what moves on is the first and the last seed of every match.
    """
    fit = bucket_sizes(rows).where(F.col("n").between(2, cap)).select("h1", "h2")
    kept = rows.join(fit, ["h1", "h2"])
    w = Window.partitionBy("doc").orderBy("pos")
    whole = F.struct("h1", "h2")
    before = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lag(whole).over(w))
    after = F.when(F.lead("pos").over(w) == F.col("pos") + 1, F.lead(whole).over(w))
    known = kept.withColumn("before", before).withColumn("after", after)
    left = known.withColumnsRenamed({"doc": "a", "pos": "pa", "before": "ba", "after": "aa"})
    right = known.withColumnsRenamed({"doc": "b", "pos": "pb", "before": "bb", "after": "ab"})
    first, last = (~F.coalesce(F.col(x) == F.col(y), F.lit(False)) for x, y in (("ba", "bb"), ("aa", "ab")))
    edges = left.join(right, ["h1", "h2"]).where((F.col("a") < F.col("b")) & (first | last))
    edges = edges.select("a", "b", "pa", (F.col("pa") - F.col("pb")).alias("lag"), first.alias("first"), last.alias("last"))
    diagonal = Window.partitionBy("a", "b", "lag").orderBy("pa")
    end = F.when(F.col("last"), F.col("pa")).otherwise(F.lead("pa").over(diagonal)) + size
    found = edges.withColumn("a_end", end).where("first")
    return found.select("a", "b", F.col("pa").alias("a_start"), "a_end", "lag", (F.col("a_end") - F.col("pa")).alias("len"))


def without_hosted(found: DataFrame, host_min: int = 60, lag_slack: int = 2) -> DataFrame:
    """Anti-join: drops a match that a longer one of the pair covers on both sides at another lag.

    A host has at least host_min tokens and one and a half times the match's.
    """
    host = found.where(F.col("len") >= host_min).select(
        F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("a_start").alias("hs"), F.col("a_end").alias("he"), F.col("lag").alias("hl"), F.col("len").alias("hn")
    )
    covers = (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb"))
    covers &= (F.col("hs") <= F.col("a_start")) & (F.col("a_end") <= F.col("he"))
    covers &= (F.col("hs") - F.col("hl") <= F.col("a_start") - F.col("lag")) & (F.col("a_end") - F.col("lag") <= F.col("he") - F.col("hl"))
    covers &= (F.abs(F.col("hl") - F.col("lag")) > lag_slack) & (2 * F.col("hn") >= 3 * F.col("len"))
    return found.join(host, covers, "left_anti")


def votes(found: DataFrame) -> DataFrame:
    """doc, pos, n: how many match edges lie at a place, on either side."""
    ends = F.explode(F.array(*[F.struct(F.col(d).alias("doc"), (F.col(p) - (F.col("lag") if d == "b" else 0)).alias("pos")) for d in "ab" for p in ("a_start", "a_end")]))
    return found.select(ends.alias("v")).groupBy("v.doc", "v.pos").agg(F.count(F.lit(1)).alias("n"))


def sides(found: DataFrame) -> DataFrame:
    """doc, start, end of both sides of each match."""
    one = found.select(F.col("a").alias("doc"), F.col("a_start").alias("start"), F.col("a_end").alias("end"))
    return one.unionByName(found.select(F.col("b").alias("doc"), (F.col("a_start") - F.col("lag")).alias("start"), (F.col("a_end") - F.col("lag")).alias("end")))


def listed(items: DataFrame, docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """item, n_tokens, best: the longest stretch of each item's tokens that some document has, 0 if none.

    Items' windows meet the documents' in an equi-join; the item side is small and Spark may broadcast it
    by its measured size.
    """
    mine = windows(items, "item_id", size=size, out="item").withColumnRenamed("pos", "pi")
    common = mine.join(windows(docs, "doc_id", size=size), ["h1", "h2"]).withColumn("lag", F.col("pos") - F.col("pi"))
    w = Window.partitionBy("item", "doc", "lag").orderBy("pi")
    island = common.select("item", "doc", "lag", "pi", (F.col("pi") - F.row_number().over(w)).alias("k"))
    runs = island.groupBy("item", "doc", "lag", "k").agg(F.count(F.lit(1)).alias("n"))
    best = runs.groupBy("item").agg((F.max("n") + (size - 1)).alias("best"))
    whole = items.select(F.col("item_id").alias("item"), F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).cast("long").alias("n_tokens"))
    return whole.join(best, "item", "left").select("item", "n_tokens", F.coalesce("best", F.lit(0)).cast("long").alias("best"))


def verdict(share: Column) -> Column:
    """found, short, fragment or missing, by the share that is covered."""
    return F.when(share >= 0.9, "found").when(share >= 0.5, "short").when(share > 0, "fragment").otherwise("missing")
