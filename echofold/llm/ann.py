"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

Vectors have a cosine with those of their own length, so there is a tree for each length. Trees are fitted in
numpy on at most ``sample`` distinct vectors (the smallest hashes, shared evenly by the lengths, LEAST_SAMPLE a
length at least) and broadcast; every row is then sent down its tree to a leaf. A query walks the tree through a
priority queue, always opening the node whose centre is nearest, until it has visited W leaves and these hold
k + 1 ids. W is calibrated: it widens until, over the sample, the mean recall against brute force reaches the
target. More leaves (about the square root of the number of vectors) keep a leaf small as the data grows.

Equal vectors are one entry with their k + 1 smallest ids, which is all that any query can need of them;
equal query vectors are searched for once. Neighbouring leaves are packed together up to BLOCK entries, a leaf of more
is dealt to blocks of about that size. A query goes to a pack once, with the leaves that it visits there, and leaves it
with k + 1 entries, so neither its vector nor its hits are repeated by leaf. A pack's queries are dealt to blocks of about
QUERY_BLOCK, and every two blocks meet in a group of their own; of a group's rows only the entries are held, queries
stream past them, SCORES scores at a time.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
with a null id. A row that repeats (id and vector) counts once; rows of the query's own id are no candidates. Ties
go to the smaller id. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_tables, written

K = 5
SAMPLE = 20_000
BRANCH = 8
MAX_LEAVES = 4096
BLOCK = 16384
QUERY_BLOCK = 8192
SCORES = 1 << 21
#: Rows in which queries leave the task that opens their leaves.
SENT = 4096
LEAST_SAMPLE = 256
RECALL = 0.97
CALIBRATION = 256


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """Centres (unit vectors) of all nodes, root first; children by node; leaves are numbered by ``leaf``."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centre, self.children, self.leaf = [x.mean(0)], {}, {}
        size = max(1, math.ceil(len(x) / max(1, leaves)))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = self.split(x[rows], min(branch, math.ceil(len(rows) / size)), rng) if len(rows) > size else []
            if len(parts) < 2:
                self.leaf[node] = len(self.leaf)
                continue
            self.children[node] = []
            for centre, mine in parts:
                self.children[node].append(len(self.centre))
                todo.append((len(self.centre), rows[mine]))
                self.centre.append(centre)
        self.centres = np.array(self.centre)

    @staticmethod
    def split(x: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        """Spherical k-means: (centre, rows) of each part that has rows."""
        centre = x[rng.choice(len(x), max(2, k), replace=False)]
        for _ in range(8):
            owner = (x @ centre.T).argmax(1)
            for j in range(len(centre)):
                if (owner == j).any():
                    c = x[owner == j].sum(0)
                    centre[j] = c / max(np.sqrt((c * c).sum()), 1e-12)
        owner = (x @ centre.T).argmax(1)
        return [(centre[j].copy(), np.flatnonzero(owner == j)) for j in range(len(centre)) if (owner == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: down the nearest child."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = self.children[node]
                owner = (x[rows] @ self.centres[kids].T).argmax(1)
                todo += [(kid, rows[owner == j]) for j, kid in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray, width: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in the order in which best-bin-first search visits them, the first ``width``.

        With ``held`` (ids of each leaf) the search goes on until the leaves hold ``least`` ids.
        """
        near = self.centres @ q
        queue, out, n = [(0.0, 0)], [], 0
        while queue and (len(out) < width or held is not None and n < least):
            _, node = heapq.heappop(queue)
            if node in self.leaf:
                out.append(self.leaf[node])
                n += 0 if held is None else held[self.leaf[node]]
            else:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-near[kid], kid))
        return out

    def calibrate(self, x: np.ndarray, k: int, target: float, queries: int) -> int:
        """Leaf visits that reach the target recall of the k nearest in the sample, for spread-out queries."""
        n = len(self.leaf)
        take = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
        if len(x) <= k + 1:
            return n
        home = self.assign(x)
        ranks = []
        for i in take:
            s = x @ x[i]
            s[i] = -2
            order = {leaf: r for r, leaf in enumerate(self.visits(x[i], n))}
            ranks += [order[home[j]] for j in np.argpartition(-s, k)[:k]]
        found = np.cumsum(np.bincount(ranks, minlength=n)) / len(ranks)
        return int(np.searchsorted(found, target)) + 1


def vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """id, dim, v (float64 components as binary) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            rows, out = [], []
            live = ids.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
            for i in np.flatnonzero(live):
                x = flat[end[i] - size[i] : end[i]]
                if np.isfinite(x).all() and x.any():
                    rows.append(i)
                    out.append((x + 0.0).tobytes())  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())).cast(pa.int64()), pa.array(size[rows].astype(np.int32) if rows else [], pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "v"])

    return df.select(key, column).mapInArrow(run, "id long, dim int, v binary")


def matrix(column: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b) for b in column])


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, list[tuple]]]:
    """(first of its group, rows without key) for up to 512 consecutive rows with equal first columns and side.

    The column after the keys is the side; all rows of side 0, the first of a group, come at once.
    """
    now, rows, fresh = None, [], True
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = r[: keys + 1]
            if k != now or (k[keys] and len(rows) == 512):
                if rows:
                    yield fresh, rows
                fresh, now, rows = now is None or k[:keys] != now[:keys], k, []
            rows.append(r[keys:])
    if rows:
        yield fresh, rows


class Forest:
    """A tree and its calibrated width by length of vectors; lengths without a tree are one leaf."""

    def __init__(self, trees: dict[int, tuple[Tree, int]]):
        self.trees, self.held, self.packs = trees, {}, {}

    def assign(self, dim: int, x: np.ndarray) -> np.ndarray:
        return self.trees[dim][0].assign(x) if dim in self.trees else np.zeros(len(x), np.int32)

    def visits(self, dim: int, q: np.ndarray, least: int) -> list[int]:
        if dim not in self.trees:
            return [0]
        tree, width = self.trees[dim]
        return tree.visits(q, width, self.held[dim], least)

    def stops(self, dim: int, q: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(pack, leaves) that a query visits; leaves without entries are in no pack."""
        seen = np.sort(np.array(self.visits(dim, q, least), np.int32))
        pack = self.packs[dim][seen]
        for p in np.unique(pack[pack >= 0]):
            yield int(p), seen[pack == p]


def packed(sizes: dict[int, int], most: int) -> dict[int, int]:
    """The pack of each leaf: neighbouring leaves share one of at most ``most`` entries; a leaf of more is a pack by itself."""
    out, pack, held = {}, -1, most
    for leaf in sorted(sizes):
        if held + sizes[leaf] > most:
            pack, held = pack + 1, 0
        out[leaf] = pack
        held += sizes[leaf]
    return out


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit vectors) of the vectors (column v) of a batch, for each length (column dim) in it."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, unit(matrix(batch.column("v").take(pa.array(at)).to_pylist()))


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", column: str = "embedding", k: int = K, sample: int = SAMPLE, target: float = RECALL, leaves: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine) of each query's k nearest found.

    queries: a predicate on the column ``id`` that chooses the query rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors(df, key, column)
    by = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    entries = written(few.groupBy("v").agg(F.max("dim").alias("dim"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")), "entries")
    sizes = written(entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = {r.dim: r.n for r in sizes.collect()}  # one row a length
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not totals:
        return empty
    share = max(LEAST_SAMPLE, sample // len(totals))
    low = (F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("n") <= 3 * share + 50
    few = entries.join(F.broadcast(sizes), "dim").where(low).withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy("h", "v")))
    drawn = few.where(F.col("r") <= share).select("dim", "v").orderBy("dim", "r").toArrow()
    trees = {}
    for dim, _, x in by_length(drawn.combine_chunks().to_batches()[0]) if drawn.num_rows else ():
        tree = Tree(x, leaves or min(MAX_LEAVES, max(1, len(x) // 16), 1 << round(math.log2(math.sqrt(totals[dim])))))
        trees[dim] = tree, tree.calibrate(x, k, target, CALIBRATION)
    forest = Forest(trees)
    planted = spark.sparkContext.broadcast(forest)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = np.zeros(batch.num_rows, np.int32)
                for dim, at, x in by_length(batch):
                    home[at] = planted.value.assign(dim, x)
                yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(home, pa.int32()), batch.column("v"), batch.column("ids")], names=["dim", "leaf", "v", "ids"])

    homes = written(entries.select("dim", "v", "ids").mapInArrow(leaf, "dim int, leaf int, v binary, ids array<long>"), "homes")
    blocks = written(homes.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("n_ids")), "leaves")
    forest.held = {dim: np.zeros(len(tree.leaf), np.int64) for dim, (tree, _) in trees.items()}
    found: dict[int, dict[int, int]] = {}
    for r in blocks.collect():  # a row a leaf
        found.setdefault(r.dim, {})[r.leaf] = r.n
        if r.dim in trees:
            forest.held[r.dim][r.leaf] = r.n_ids
    plans = []
    for dim, sizes_of in found.items():
        pack = packed(sizes_of, BLOCK)
        forest.packs[dim] = np.full(max(pack) + 1 if dim not in trees else len(trees[dim][0].leaf), -1, np.int32)
        forest.packs[dim][list(pack)] = list(pack.values())
        total: dict[int, int] = {}
        for leaf_no, p in pack.items():
            total[p] = total.get(p, 0) + sizes_of[leaf_no]
        plans += [(dim, leaf_no, p, math.ceil(total[p] / BLOCK)) for leaf_no, p in pack.items()]
    packs = written(spark.createDataFrame(plans, "dim int, leaf int, pack int, n int"), "packs")  # a row a leaf
    weighed = spark.sparkContext.broadcast(forest)

    def open_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(batch: pa.RecordBatch, at: list[int], pack: list[int], leaves: list[np.ndarray]) -> pa.RecordBatch:
            rows = batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays([rows.column("dim"), pa.array(pack, pa.int32()), rows.column("qid"), rows.column("v"), pa.array(leaves, pa.list_(pa.int32()))], names=["dim", "pack", "qid", "v", "leaves"])

        for batch in batches:
            for dim, at, x in by_length(batch) if batch.num_rows else ():
                out: tuple[list, list, list] = ([], [], [])
                for i, q in zip(at, x, strict=True):
                    for pack, leaves in weighed.value.stops(dim, q, k + 1):
                        out[0].append(i)
                        out[1].append(pack)
                        out[2].append(leaves)
                    if len(out[0]) >= SENT:
                        yield send(batch, *out)
                        out = ([], [], [])
                if out[0]:
                    yield send(batch, *out)

    # queries: all members, also those beyond the ids that their entry keeps
    asked = written(rows.where(queries).select("id", "dim", "v").distinct(), "asked")
    numbered = written(asked.select("dim", "v").distinct().select(F.monotonically_increasing_id().alias("qid"), "dim", "v"), "queries")
    visits = written(numbered.mapInArrow(open_leaves, "dim int, pack int, qid long, v binary, leaves array<int>"), "visits")
    crowd = visits.groupBy("dim", "pack").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("m"))
    plan = packs.join(crowd, ["dim", "pack"])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda x, c: F.pmod(F.xxhash64(x), F.col(c)).cast("int")
    dealt = homes.join(F.broadcast(plan), ["dim", "leaf"]).withColumn("g", part("v", "n")).withColumn("f", every("m"))
    dealt = dealt.select("dim", "pack", "g", "f", F.lit(0).alias("side"), F.lit(None).cast("long").alias("qid"), "v", "ids", F.array("leaf").alias("leaves"))
    sent = visits.join(F.broadcast(plan.select("dim", "pack", "n", "m").distinct()), ["dim", "pack"]).withColumn("f", part("qid", "m")).withColumn("g", every("n"))
    sent = sent.select("dim", "pack", "g", "f", F.lit(1).alias("side"), "qid", "v", F.lit(None).cast("array<long>").alias("ids"), "leaves")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for fresh, group in grouped(batches, 4):
            if fresh:
                data = None
            if not group[0][0]:
                leaf_of = np.array([r[4][0] for r in group])
                order = np.argsort(leaf_of, kind="stable")
                data, ids = matrix([group[i][2] for i in order]), [group[i][3] for i in order]
                first, units = np.array([i[0] for i in ids]), unit(data)
                names, begins = np.unique(leaf_of[order], return_index=True)
                ends = {leaf: (a, b) for leaf, a, b in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(data)], strict=True)}
                continue
            if data is None:
                continue
            step = max(1, SCORES // len(data))
            for rows in (group[a : a + step] for a in range(0, len(group), step)):
                q = matrix([r[2] for r in rows])
                near_to, by_leaf = unit(q), {}
                for i, r in enumerate(rows):
                    for leaf in r[4]:
                        by_leaf.setdefault(leaf, []).append(i)
                scores = np.full((len(rows), len(data)), -2.0)
                seen = np.zeros(len(rows), np.int64)
                for leaf, who in by_leaf.items():
                    a, b = ends.get(leaf, (0, 0))
                    if b > a:
                        scores[who, a:b] = near_to[who] @ units[a:b].T
                        seen[who] += b - a
                out: tuple[list, list, list] = ([], [], [])
                for i, s in enumerate(scores):
                    keep = min(int(seen[i]), k + 1)
                    if not keep:
                        continue
                    # all within rounding of the last one kept are ranked by the exact measure
                    last = np.partition(s, len(s) - keep)[len(s) - keep]
                    near = np.flatnonzero(s >= last - 1e-9)
                    score = cosine(q[i], data[near])
                    for j in np.lexsort((first[near], -score))[:keep]:
                        out[0].append(rows[i][1])
                        out[1].append(score[j])
                        out[2].append(ids[near[j]])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64()))], names=["qid", "score", "ids"])

    met = dealt.unionByName(sent).repartition(parts, "dim", "pack", "g", "f").sortWithinPartitions("dim", "pack", "g", "f", "side")
    hits = met.mapInArrow(search, "qid long, score double, ids array<long>")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.element_at("ids", 1))
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    members = asked.join(numbered, ["dim", "v"]).select("qid", F.col("id").alias("query_id"))
    pairs = members.join(hits, "qid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = written(pairs.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    drop_tables(entries, sizes, homes, blocks, packs, asked, numbered, visits)
    return out


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """In double precision, on the vectors as they are; scaled only where squares would vanish or overflow."""
    norms = math.sqrt(float((q * q).sum())) * np.sqrt((x * x).sum(1))
    with np.errstate(all="ignore"):
        s = (x * q).sum(1) / norms
    odd = ~np.isfinite(s) | (norms < 1e-280)
    if odd.any():
        s[odd] = (unit(x[odd]) * unit(q[None])).sum(1)
    return s
