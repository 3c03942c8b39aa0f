"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is a bag of five-word shingles, each weighted 1 + ln(count). Its signature holds, for each of M
registers, the shingle whose Poisson process (rate: its weight) arrives there first; an element's arrivals
are drawn in order and stop once they come after every register's first. Two signatures agree in a register
with the probability Jaccard similarity of the bags. BANDS bands of ROWS registers give candidates.

Texts with the same words are one node, however often they occur; all that follows works on nodes:

1. Every bucket's *leader* is its member with the most company over all its buckets. Each other member is
   compared with the leader of each of its buckets: a star, linear in the bucket.
2. Verified pairs give components. Where a bucket holds members of several components, every pair of them
   that step 1 has not compared is compared in blocks of at most about BLOCK rows a side: the rows outside
   the leader's component against all rows, each pair in the first band that it shares.
3. The components of step 2's links over those of step 1 are the classes.

Every comparison first estimates the similarity from signatures and, unless it lies MARGIN below the
threshold (under 80 of 125 registers: at exactly 0.8 with probability 0.00001), decides on the exact
probability Jaccard similarity of the whole texts. No task holds a bucket, no pair is dropped for a bucket's size; leaders and outsiders travel
to blocks of the others, texts only where an estimate calls for them.

Defined results: texts of fewer than five words are one shingle. Word-less texts are alike if they are equal
texts; a null text is alike to none and its row a class by itself. Rows repeat as in the input; a null
doc_id takes the class of its text, and class ids are the smallest non-null doc_id of a class. Extra columns
are not read by ``classes``; ``keep_one`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import connected_components
from .common import byte_words, drop_tables, free_name, released, small_batches, splitmix, utf8_values, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
MARGIN = 0.162
BLOCK = 512
#: A crowded bucket's rows meet its size in so many parts.
SALTS = 8
SLICE_BYTES = 1_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, kept for the commonest; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: Hashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their weights."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    key = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        key = (key * PRIME) ^ w[k : len(w) - n + 1 + k]
        key = key ^ (key >> np.uint64(29))
    key, count = np.unique(splitmix(key), return_counts=True)
    return key, 1 + np.log(count)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> np.ndarray:
    """16-bit register values (bags, m) of all bags at once; an empty bag has zeros.

    Round i draws the i-th arrival of every element that is still awaited anywhere in its bag.
    """
    n = len(bags)
    first = np.full(n * m, np.inf)
    value = np.zeros(n * m, np.uint16)
    size = [len(k) for k, _ in bags]
    element = np.concatenate([k for k, _ in bags]) if n else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in bags]) if n else np.zeros(0)
    bag = np.repeat(np.arange(n), size)
    at = np.zeros(len(element))
    i = 0
    while len(element):
        r = splitmix(element + np.uint64((i * 0xD1342543DE82EF95 + 1) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = bag * m + ((splitmix(r) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        value[slot[won]] = (element[won] >> np.uint64(48)).astype(np.uint16)
        last = first.reshape(n, m).max(1)
        keep = at < last[bag]
        element, weight, bag, at = element[keep], weight[keep], bag[keep], at[keep]
        i += 1
    return value.reshape(n, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    (ka, wa), (kb, wb) = a, b
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    both = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    x, y = wa[both], wb[at[both]]
    if not len(x):
        return 0.0
    ratio = x / y
    order = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # elements with a ratio as large count with a, the others with b; one-sided ones are at the ends
    end = np.searchsorted(-ratio, -ratio, "right")
    sum_a, sum_b = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    return float((1 / ((only_a + sum_a[end]) / x + (only_b + sum_b[-1] - sum_b[end]) / y)).sum())


def text_key(text: bytes | None, words: list[bytes]) -> bytes | None:
    """The node of a text: 16 bytes of a hash of its words (of the text itself, if it has none)."""
    if text is None:
        return None
    data = b" ".join(words) if words else b"\0" + text
    return hashlib.blake2b(data, digest_size=16).digest()


def sketches(docs: DataFrame, key: str) -> DataFrame:
    """key, node, registers of every row; a node that a task meets again is not drawn again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = Hashes(), {}
        for batch in batches:
            values = utf8_values(batch.column(1))
            at = 0
            while at < len(values):
                end, size, todo, nodes = at, 0, {}, []
                while end < len(values) and size < SLICE_BYTES:
                    words = byte_words(values[end])
                    node = text_key(values[end], words)
                    nodes.append(node)
                    if node is not None and words and node not in done and node not in todo:
                        todo[node] = shingles(words, hashes)
                        size += len(values[end])
                    size += 64
                    end += 1
                drawn = signatures(list(todo.values())) if todo else np.zeros((0, M), np.uint16)
                done.update(zip(todo, (x.tobytes() for x in drawn), strict=True))
                sig = [done.get(x) for x in nodes]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(nodes, pa.binary()), pa.array(sig, pa.binary())], names=[key, "node", "sig"])
                if len(done) > 20_000:
                    done.clear()
                at = end

    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[key], T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    return docs.select(key, "text").mapInArrow(released(run), schema)


def buckets(nodes: DataFrame) -> DataFrame:
    """bucket, band, node for every band of every signature."""
    width = 2 * ROWS
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))).alias("bucket"))))
    return nodes.where("sig is not null").select("node", each.alias("b")).select("b.bucket", "b.band", "node")


class Rows:
    """One side of a group of compare(): rows of side, node, comp, sig, text."""

    def __init__(self, rows: list[tuple]):
        self.side, self.node, self.comp, sig, self.text = map(list, zip(*rows, strict=True))
        self.sig = np.stack([np.frombuffer(x, np.uint16) for x in sig])


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = r[:keys], []
            rows.append(r[keys:])
    if rows:
        yield now, rows


def compare(rows: DataFrame, band: bool, exact: bool, threshold: float) -> DataFrame:
    """Compares side 0 with sides 1 and 2 within each (bucket, f, g), over signatures or whole texts.

    rows: bucket, band, f, g, side, node, comp, sig, text (null unless exact). Side 2 holds the rows of side 0
    once more, so that they meet each other; of such a pair the smaller node is the left one. With
    ``band``, a pair counts only in the first band in which its signatures agree. Pairs within a component
    are skipped.
    Not exact: the rows that some pair may need, as bucket, band, node, side. Exact: links, as a, b, component
    of a, component of b; a pair whose components earlier links of the group have joined is skipped.
    """
    schema = "a binary, b binary, ca binary, cb binary" if exact else "bucket long, band int, node binary, side int"

    def pairs(left: Rows, right: Rows, at_band: int) -> Iterator[tuple[int, np.ndarray]]:
        comp = np.array(right.comp, object)
        twice, node = np.array(right.side) == 2, np.array(right.node, object)
        for i in range(len(left.node)):
            same = right.sig == left.sig[i]
            ok = (same.sum(1) >= (threshold - MARGIN) * M) & (comp != left.comp[i])
            if twice.any():
                ok &= ~twice | (node > left.node[i])
            if band and ok.any():
                j = np.flatnonzero(ok)
                whole = same[j].reshape(len(j), BANDS, ROWS).all(2)
                ok[j] = whole.argmax(1) == at_band
            j = np.flatnonzero(ok)
            if len(j):
                yield i, j[np.argsort(-same[j].sum(1), kind="stable")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out = Hashes(), []

        def flush():
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(),) * 4 if exact else (pa.int64(), pa.int32(), pa.binary(), pa.int32()))]
            batch = pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])
            out.clear()
            return batch

        for (bucket, at_band, _, _), group in grouped(batches, 4):
            sides = [r for r in group if r[0] == 0], [r for r in group if r[0] > 0]
            if not sides[0] or not sides[1]:
                continue
            left, right = map(Rows, sides)
            bags: dict[tuple[int, int], tuple] = {}
            parent: dict[bytes, bytes] = {}

            def bag(side: int, k: int, rows: Rows) -> tuple:
                if (side, k) not in bags:
                    bags[side, k] = shingles(byte_words(rows.text[k]), hashes)
                return bags[side, k]

            def root(c: bytes) -> bytes:
                while c in parent:
                    c = parent[c]
                return c

            need: tuple[set, set] = (set(), set())
            for i, js in pairs(left, right, at_band):
                if not exact:
                    need[0].add(i)
                    need[1].update(js.tolist())
                    continue
                for j in js:
                    x, y = root(left.comp[i]), root(right.comp[j])
                    if x != y and probability_jaccard(bag(0, i, left), bag(1, int(j), right)) >= threshold:
                        out.append((left.node[i], right.node[j], left.comp[i], right.comp[j]))
                        parent[max(x, y)] = min(x, y)
            if not exact:
                out += [(bucket, at_band, rows.node[k], rows.side[k]) for s, rows in enumerate((left, right)) for k in sorted(need[s])]
            if len(out) >= 5000:
                yield flush()
        if out:
            yield flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["bucket", "band", "f", "g"]
    dealt = rows.select(*keys, "side", "node", "comp", "sig", "text").repartition(n, "bucket", "f", "g").sortWithinPartitions(*keys, "side", "node")
    return dealt.mapInArrow(released(run), schema)


def blocked(members: DataFrame) -> DataFrame:
    """members (bucket, band, node, comp, side) dealt to blocks: f numbers blocks of side 0, g of the others.

    A row of side 0 goes to every block of the others in its bucket, and the other way about.
    """
    many = lambda test: F.ceil(F.sum(F.when(test, 1).otherwise(0)) / BLOCK).cast("int")
    left = F.col("side") == 0
    n = members.groupBy("bucket").agg(many(left).alias("nf"), many(~left).alias("ng")).where("nf > 0 and ng > 0")
    n = n.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    rows = members.withColumn("salt", F.pmod(F.xxhash64("node", "side"), F.lit(SALTS)).cast("int")).join(n, ["bucket", "salt"])
    zero = rows.where(left).withColumn("f", part("nf")).withColumn("g", every("ng"))
    one = rows.where(~left).withColumn("g", part("ng")).withColumn("f", every("nf"))
    cols = ["bucket", "band", "f", "g", "side", "node", "comp"]
    return zero.select(*cols).unionByName(one.select(*cols))


def links(members: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, band: bool, threshold: float) -> DataFrame:
    """Verified links between side 0 and the other sides of each bucket: a, b and their components.

    Signatures decide which rows need their texts; only those nodes' texts are fetched, one row a node.
    """
    sig = nodes.select("node", "sig")
    signed = blocked(members).join(sig, "node").withColumn("text", F.lit(None).cast("binary"))
    need = written(compare(signed, band, False, threshold).distinct(), "need")
    wanted = need.select("node").distinct().join(nodes.select("node", F.col("least").alias("_least")), "node")
    source = docs.where("text is not null").select(F.col(key).alias("_key"), F.col("text").cast("binary").alias("text"))
    texts = written(by_node(wanted.join(source, F.col("_least").eqNullSafe(F.col("_key"))).select("node", "text")), "texts")
    again = need.join(members.select("bucket", "node", "comp").distinct(), ["bucket", "node"])
    full = blocked(again).join(sig, "node").join(texts, "node")
    out = written(compare(full, band, True, threshold), "links")
    drop_tables(need, texts)
    return out


def by_node(rows: DataFrame) -> DataFrame:
    """One row per node, with its text: ids can repeat with other texts, whose rows go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [text_key(t, byte_words(t)) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(right, pa.bool_()))

    return rows.mapInArrow(run, "node binary, text binary").dropDuplicates(["node"])


def node_classes(docs: DataFrame, key: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(key, node of every row; node, least, class of every node), both tables in the shared folder.

    least is a node's smallest key, class the component's smallest node.
    """
    rows = written(sketches(docs, key), "sketches")
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.min(key).alias("least"), F.first("sig").alias("sig")), "nodes")
    all_buckets = buckets(nodes)
    company = all_buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(all_buckets.join(company, "bucket").select("bucket", "band", "node", "n"), "members")
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    leaders = written(members.join(fame, "node").groupBy("bucket").agg(F.max(F.struct("fame", "node")).alias("m"), F.max("n").alias("n")).select("bucket", F.col("m.node").alias("leader"), "n"), "leaders")

    # 1: stars
    pairs = members.select("bucket", "node").join(leaders.select("bucket", "leader"), "bucket").where("node <> leader").select("leader", "node").distinct()
    star = F.xxhash64("leader").alias("bucket"), F.lit(0).alias("band")
    others = pairs.select(*star, "node", F.col("node").alias("comp"), F.lit(1).alias("side"))
    heads = pairs.select("leader").distinct().select(*star, F.col("leader").alias("node"), F.col("leader").alias("comp"), F.lit(0).alias("side"))
    stars = written(heads.unionByName(others), "stars")
    first = links(stars, nodes, docs, key, False, threshold)
    comp = written(connected_components(first), "components").withColumnRenamed("component", "comp")

    # 2: what stars leave open
    crowded = leaders.where("n > 2").select("bucket", "leader")
    of = lambda df, name: df.join(comp.withColumnRenamed("node", name), name, "left").withColumn("comp", F.coalesce("comp", name))
    inside = of(members.join(crowded.select("bucket"), "bucket").select("bucket", "band", "node"), "node")
    head = of(crowded, "leader").withColumnRenamed("comp", "head")
    placed = written(inside.join(head, "bucket").where("node <> leader").withColumn("out", F.col("comp") != F.col("head")).select("bucket", "band", "node", "comp", "out"), "placed")
    open_buckets = placed.where("out").select("bucket").distinct()
    rest = placed.join(open_buckets, "bucket")
    sides = rest.where("out").withColumn("side", F.lit(0)).unionByName(rest.withColumn("side", F.when(F.col("out"), 2).otherwise(1)))
    second = links(sides.select("bucket", "band", "node", "comp", "side"), nodes, docs, key, True, threshold)

    # 3: classes
    joined = written(connected_components(second.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "joined")
    top = comp.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("component", "comp").alias("class"))
    lone = joined.join(comp.select("node"), "node", "left_anti").select("node", F.col("component").alias("class"))
    known = top.unionByName(lone)
    out = nodes.select("node", "least").join(known, "node", "left").withColumn("class", F.coalesce("class", "node"))
    out = written(out, "classes")
    drop_tables(nodes, members, leaders, stars, first, comp, placed, second, joined)
    return rows.drop("sig"), out


def with_ids(classes: DataFrame) -> DataFrame:
    """Adds class_id, the class's smallest key, and head, the node that has it."""
    order = F.struct(F.col("least").isNull().alias("none"), "least", F.col("node").alias("head"))
    ids = classes.groupBy("class").agg(F.min(order).alias("m")).select("class", F.col("m.least").alias("class_id"), F.col("m.head").alias("head"))
    return classes.join(ids, "class")


def classes(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, class_id (smallest key of its class) and copy_of (smallest key with the same words)."""
    rows, nodes = node_classes(docs, key, threshold)
    ids = with_ids(nodes).select("node", F.col("least").alias("copy_of"), "class_id")
    own: Column = F.when(F.col("node").isNull(), F.col(key))
    return rows.join(ids, "node", "left").select(key, F.coalesce(own, "class_id").alias("class_id"), F.coalesce(own, "copy_of").alias("copy_of"))


def marked(node: Column, key: Column) -> Column:
    """Node and key as one value that is never null."""
    key = key.cast("string")
    return F.concat(node, F.when(key.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), key)).cast("binary"))


def keep_one(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without near-duplicates: of each class one row, that of its smallest key. Rows with a null text stay.

    Texts move once: rows meet their class's choice by node and key together, so that copies spread, and rows that
    repeat are dropped where they lie then.
    """
    _, nodes = node_classes(docs, key, threshold)
    node, mark = (free_name(docs, c) for c in ("node", "mark"))
    heads = with_ids(nodes).where("node = head").select(marked(F.col("node"), F.col("least")).alias(mark))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [text_key(t, byte_words(t)) for t in utf8_values(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*names, node])

    noted = docs.where("text is not null").mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())]))
    kept = noted.withColumn(mark, marked(F.col(node), F.col(key))).drop(node).join(heads, mark, "left_semi")
    return kept.dropDuplicates([mark]).select(*names).unionByName(docs.where("text is null"))
