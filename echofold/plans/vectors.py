"""Queries over embeddings: vectors as window descriptors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as vx
from ..kernels.dsp import int8

TABLES, BITS, DIMS, REACH = 8, 20, 64, 256


def vecs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def norms(spark, sf_dir):
    return vecs(spark, sf_dir).select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"))


NORMS = "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings"
Q = "list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE * 127)::INT)))"


def quantised(spark, sf_dir):
    q = vx.quantised(F.col("embedding"))
    return vecs(spark, sf_dir).select("vec_id", F.array_join(F.transform(q, lambda x: x.cast("string")), ",").alias("q"))


QUANTISED = f"SELECT vec_id, array_to_string({Q}, ',') AS q FROM embeddings"


def distances(spark, sf_dir):
    """Distance of each vector to the next one's quantised form."""
    v = vecs(spark, sf_dir)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), vx.quantised(F.col("embedding")).alias("q"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(vx.distance(F.col("embedding"), F.col("q")), 6).alias("distance"))


DISTANCES = f"""WITH q AS (SELECT vec_id - 1 AS vec_id, {Q} AS q FROM embeddings)
SELECT e.vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q.q), lambda p: power(p[1]::DOUBLE - p[2] / 127, 2)))), 6) AS distance FROM embeddings e JOIN q ON q.vec_id = e.vec_id"""


def planes() -> np.ndarray:
    """Integer planes (tables, bits, dimensions) by a formula."""
    t, b, i = np.ogrid[:TABLES, :BITS, :DIMS]
    return (i * 7 + b * 13 + t * 31 + i * b * 5 + i * i * (t + 1)) % 23 - 11


def hashes(spark, sf_dir) -> DataFrame:
    """vec_id, tbl, hash: sign bits of the quantised vectors against the planes, as one product a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes().reshape(-1, DIMS).T
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS).astype(np.float64)
            bits = (int8(x * vx.SCALE).astype(np.int64) @ p >= 0).reshape(-1, TABLES, BITS)
            h = (bits * (1 << np.arange(BITS))).sum(2)
            n = len(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), TABLES))), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n)), pa.array(h.reshape(-1).astype(np.int32))], names=["vec_id", "tbl", "hash"])

    whole = vecs(spark, sf_dir).where(F.size("embedding") == DIMS)
    return whole.mapInArrow(run, "vec_id long, tbl int, hash int")


def signatures(spark, sf_dir):
    return hashes(spark, sf_dir).select("vec_id", F.col("tbl").cast("long").alias("tbl"), F.col("hash").cast("long").alias("hash"))


HASHES = f"""q AS (SELECT vec_id, {Q} AS q FROM embeddings), tt AS (SELECT unnest(range({TABLES})) AS tbl), bb AS (SELECT unnest(range({BITS})) AS bit), ii AS (SELECT unnest(range({DIMS})) AS i),
pl AS (SELECT tbl, bit, list((((i * 7 + bit * 13 + tbl * 31 + i * bit * 5 + i * i * (tbl + 1)) % 23) - 11)::INT ORDER BY i) AS p FROM tt, bb, ii GROUP BY ALL),
hb AS (SELECT vec_id, tbl, bit, list_sum(list_transform(list_zip(q, p), lambda z: z[1] * z[2])) AS s FROM q, pl),
hh AS (SELECT vec_id, tbl, CAST(sum(CASE WHEN s >= 0 THEN 1::BIGINT << bit ELSE 0 END) AS BIGINT) AS hash FROM hb GROUP BY ALL)"""


def candidates(h: DataFrame, reach: int = REACH) -> DataFrame:
    """a < b that share a bucket in some table, at most reach places apart in its order of ids.

    Buckets are told apart by as many bits as keep some sixteen vectors in one on average, so they do not grow with the
    table. None is left out: in one of up to reach + 1 vectors all pairs meet; in a larger one, each vector meets the
    next ones, by an equi-join of stretches of reach places with themselves and those before.
    """
    n = h.where("tbl = 0").count()
    bits = min(BITS, max(6, math.ceil(math.log2(max(n, 1))) - 4))
    w = Window.partitionBy("tbl", "bucket").orderBy("vec_id")
    rows = h.withColumn("bucket", F.col("hash") % (1 << bits)).withColumn("k", F.row_number().over(w) - 1).withColumn("part", F.floor(F.col("k") / reach))
    left = rows.select("tbl", "bucket", "part", F.col("vec_id").alias("a"), F.col("k").alias("ka"))
    right = rows.select("tbl", "bucket", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("vec_id").alias("b"), F.col("k").alias("kb"))
    pairs = left.join(right, ["tbl", "bucket", "part"]).where((F.col("ka") < F.col("kb")) & (F.col("kb") <= F.col("ka") + reach))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_tables"))


def lsh_candidates(spark, sf_dir):
    c = candidates(hashes(spark, sf_dir))
    return c.groupBy("n_tables").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("b") - F.col("a")).alias("sum_gap"))


CANDIDATES = f"""{HASHES}, hb2 AS (SELECT least({BITS}, greatest(6, CAST(ceil(log2(greatest(count(*), 1))) AS BIGINT) - 4)) AS bits FROM hh WHERE tbl = 0),
hj AS (SELECT vec_id, tbl, hash % (1 << bits) AS bucket, row_number() OVER (PARTITION BY tbl, hash % (1 << bits) ORDER BY vec_id) AS k FROM hh, hb2),
cc AS (SELECT x.vec_id AS a, y.vec_id AS b, count(*) AS n_tables FROM hj x JOIN hj y ON x.tbl = y.tbl AND x.bucket = y.bucket AND x.k < y.k AND y.k <= x.k + {REACH} GROUP BY ALL)"""


def cosine_topk(spark, sf_dir):
    """Each vector's six nearest candidates of a larger id, at most."""
    v = vecs(spark, sf_dir)
    pairs = candidates(hashes(spark, sf_dir)).where("n_tables >= 2").select("a", "b")
    both = pairs.join(v.withColumnsRenamed({"vec_id": "a", "embedding": "x"}), "a").join(v.withColumnsRenamed({"vec_id": "b", "embedding": "y"}), "b")
    scored = both.select("a", "b", F.round(vx.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return scored.withColumn("k", F.row_number().over(w).cast("long")).where("k <= 6")


TOPK = f"""WITH {CANDIDATES}, sc AS (SELECT a, b, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
 / (sqrt(list_sum(list_transform(x.embedding, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(y.embedding, lambda v: v::DOUBLE * v::DOUBLE)))), 6) AS cosine
 FROM cc JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE n_tables >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS k FROM sc) SELECT a, b, cosine, k FROM r WHERE k <= 6"""


def dct(spark, sf_dir):
    """The first eight cosine coefficients, made a unit vector."""
    def coefficient(k: int):
        return vx.total(F.transform("embedding", lambda v, i: v.cast("double") * F.cos(F.lit(3.141592653589793) * (i + F.lit(0.5)) * k / DIMS)))

    coef = [coefficient(k) for k in range(8)]
    rows = vecs(spark, sf_dir).select("vec_id", F.array(*coef).alias("c"))
    n = vx.norm(F.col("c"))
    return rows.select("vec_id", *[F.round(F.col("c")[k] / n, 5).alias(f"c{k}") for k in range(8)])


DCT = "WITH c AS (SELECT vec_id, " + ", ".join(f"list_sum(list_transform(list_zip(embedding, range({DIMS})), lambda p: p[1]::DOUBLE * cos(3.141592653589793 * (p[2] + 0.5) * {k} / {DIMS}))) AS k{k}" for k in range(8)) + " FROM embeddings), n AS (SELECT *, sqrt(" + " + ".join(f"k{k} * k{k}" for k in range(8)) + ") AS n FROM c) SELECT vec_id, " + ", ".join(f"round(k{k} / n, 5) AS c{k}" for k in range(8)) + " FROM n"


QUERIES = {
    "emb_norms": (norms, NORMS),
    "emb_quantize": (quantised, QUANTISED),
    "emb_distance_q": (distances, DISTANCES),
    "emb_lsh_signature": (signatures, f"WITH {HASHES} SELECT vec_id, tbl, hash FROM hh"),
    "emb_lsh_candidates": (lsh_candidates, f"WITH {CANDIDATES} SELECT n_tables, count(*) AS pairs, CAST(sum(b - a) AS BIGINT) AS sum_gap FROM cc GROUP BY ALL"),
    "emb_cosine_topk": (cosine_topk, TOPK),
    "emb_dct_descriptor": (dct, DCT),
}
