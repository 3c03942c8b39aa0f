"""Benchmark decontamination with suffix arrays over the training texts.

Each task lays the words of its documents on one axis (a *shard*), sorts the suffixes that could begin a
test passage into a suffix array, and binary-searches every test suffix in it, which gives its longest verbatim
match. Test suffixes whose match reaches their window are looked up again as a range, which gives every place of
the window; places on one diagonal join to the passages that a document shares with an item.

The test side is cut into blocks of about ``block_words`` words. Executors index the blocks and write them to the
shared folder; a task holds one block at a time, so its memory does not grow with the benchmark. Each shard of
documents meets all blocks, within one pass over the documents and without a shuffle of them.

Defined results: null, empty and word-less texts have no words, no hits and a longest match of 0. Equal rows give
equal rows. A null item_id makes words count as hit but is not listed among the items. Items without words are
ignored. Extra columns of either table are not read by ``score``; ``remove`` keeps those of the documents.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_words, free_name, released, shared_dir, small_batches, utf8_values

WINDOW = 13
DEPTH = 16
SHARD_WORDS = 2_000_000
#: Texts of about so many bytes are scanned together as a shard; more, if many windows are looked up in each.
SCAN_BYTES = 2_000_000
MOST_BYTES = 16_000_000
BLOCK_WORDS = 1_000_000
FILTER_BITS = 22
#: Shorter verbatim matches are not reported.
LEAST_MATCH = 3


class TestIndex:
    """The windows and suffixes of one block of test items, as packed word ids.

    Word ids start at 1; 0 stands for any word that no item has and for ends of texts, and matches nothing.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        texts = [
            np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64)
            for _, ws in items
        ]
        self.bits = max(1, int(len(self.vocab) + 1).bit_length())
        self.per_key = 63 // self.bits
        self.depth = max(DEPTH, window)
        self.n_keys = -(-self.depth // self.per_key)
        axis = np.concatenate([np.concatenate([t, np.zeros(1, np.int64)]) for t in texts] or [np.zeros(1, np.int64)])
        start = np.cumsum([0, *[len(t) + 1 for t in texts]])
        pos, length = [], []
        for k, t in enumerate(texts):
            if len(t):
                n = max(1, len(t) - window + 1)
                pos.append(start[k] + np.arange(n))
                length.append(np.full(n, min(window, len(t))))
        pos, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pos, length))
        self.min_len = int(length.min()) if len(length) else 0
        low = self.pack(axis, pos, length, 0)
        order = np.lexsort((length, *low.T[::-1]))
        low, pos, length = low[order], pos[order], length[order]
        new = np.ones(len(low), bool)
        if len(low) > 1:
            new[1:] = (low[1:] != low[:-1]).any(1) | (length[1:] != length[:-1])
        group = np.cumsum(new) - 1
        self.low, self.length = low[new], length[new]
        self.high = self.pack(axis, pos[new], length[new], (1 << self.bits) - 1)
        # a window's owners are the test suffixes that begin with it, by number
        self.owner_start = np.flatnonzero(new)
        self.owner_end = np.append(self.owner_start[1:], len(group))
        suffix = np.flatnonzero(axis)
        self.owner = np.searchsorted(suffix, pos)
        self.axis, self.suffix = axis, suffix
        self.suffix_item = np.searchsorted(start, suffix, "right") - 1
        self.suffix_at = suffix - start[self.suffix_item]
        self.suffix_low = self.pack(axis, suffix, np.full(len(suffix), self.depth), 0)
        pairs = axis[:-1] * (len(self.vocab) + 1) + axis[1:]
        self.pairs = self.table(pairs[(axis[:-1] > 0) & (axis[1:] > 0)])
        triples = self.triple(axis)
        self.triples = self.table(triples[(axis[:-2] > 0) & (axis[1:-1] > 0) & (axis[2:] > 0)]) if len(axis) > 2 else self.pairs

    def slot(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)

    def table(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << FILTER_BITS, bool)
        out[self.slot(x)] = True
        return out

    def triple(self, axis: np.ndarray) -> np.ndarray:
        n = np.uint64(len(self.vocab) + 1)
        a = axis.astype(np.uint64)
        return (a[:-2] * n + a[1:-1]) * n + a[2:]

    def pack(self, axis: np.ndarray, pos: np.ndarray, length: np.ndarray, pad: int) -> np.ndarray:
        """Keys whose order is the order of the words from pos on; beyond length, pad stands."""
        out = np.zeros((len(pos), self.n_keys), np.int64)
        for d in range(self.n_keys * self.per_key):
            at = np.minimum(pos + d, len(axis) - 1)
            inside = (d < length) & (pos + d < len(axis))
            k = d // self.per_key
            out[:, k] = (out[:, k] << self.bits) | np.where(inside, axis[at], pad)
        return out


class SuffixArray:
    """Sorted suffixes of a shard: those whose first words (three, or as many as the shortest window has) begin some test suffix."""

    def __init__(self, axis: np.ndarray, index: TestIndex):
        self.axis, self.index = axis, index
        pos = np.flatnonzero(axis[:-1]) if len(axis) else np.zeros(0, np.int64)
        if index.min_len >= 2:
            pos = pos[axis[pos + 1] > 0]
            pos = pos[index.pairs[index.slot(axis[pos] * (len(index.vocab) + 1) + axis[pos + 1])]]
        if index.min_len >= 3:
            pos = pos[pos + 2 < len(axis)]
            n = np.uint64(len(index.vocab) + 1)
            a, b, c = (axis[pos + d].astype(np.uint64) for d in range(3))
            pos = pos[(c > 0) & index.triples[index.slot((a * n + b) * n + c)]]
        keys = index.pack(axis, pos, np.full(len(pos), index.depth), 0)
        order = np.lexsort(keys.T[::-1])
        self.pos, self.keys = pos[order], keys[order]

    def rank(self, queries: np.ndarray) -> np.ndarray:
        """For each packed query, the number of suffixes that sort before it: a binary search in all at once."""
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.pos), np.int64)
        for _ in range(len(self.pos).bit_length()):
            mid = np.minimum((lo + hi) >> 1, max(len(self.pos) - 1, 0))
            less, same = np.zeros(len(queries), bool), np.ones(len(queries), bool)
            for k in range(queries.shape[1]):
                s = self.keys[mid, k]
                less |= same & (s < queries[:, k])
                same &= s == queries[:, k]
            go = lo < hi
            lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
        return lo

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position) of every occurrence of a test window.

        A window occurs if the longest match of a test suffix that begins with it is as long as the window.
        """
        index = self.index
        if not len(self.pos) or not len(index.low):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size, _ = self.longest(index.depth)
        live = np.flatnonzero(size[index.owner[index.owner_start]] >= index.length)
        # no word has the id that pads high, so its rank is the end of the range
        lo, hi = self.rank(index.low[live]), self.rank(index.high[live])
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(live, n), self.pos[at]

    def longest(self, enough: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each test suffix, the length of its longest verbatim match and where it starts (-1: none).

        Matches of at least ``enough`` words (at most the keys' depth) are not followed further.
        """
        q, n = self.index.suffix, len(self.index.suffix)
        best, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        if not len(self.pos) or not n:
            return best, where
        r = self.rank(self.index.suffix_low)
        # the longest match is that of the suffix before or after the place in the order
        for side in (-1, 0):
            at = r + side
            ok = (at >= 0) & (at < len(self.pos))
            p = self.pos[np.clip(at, 0, len(self.pos) - 1)]
            size = self.common(q, p, ok, enough)
            better = ok & (size > best)
            best, where = np.where(better, size, best), np.where(better, p, where)
        if enough is not None:
            return best, where
        # where more words agree than keys hold, several neighbours are tied up to there: look at each, distinct suffixes once
        deep = np.flatnonzero(best >= self.index.depth)
        if len(deep):
            low = self.index.suffix_low[deep]
            up = low.copy()
            up[:, -1] += 1
            for k, i, j in zip(deep, self.rank(low), self.rank(up), strict=True):
                p = self.pos[i:j]
                size = self.common(np.full(len(p), q[k]), p, np.ones(len(p), bool))
                if len(size) and size.max() > best[k]:
                    best[k], where[k] = size.max(), p[size.argmax()]
        return best, where

    def common(self, q: np.ndarray, p: np.ndarray, live: np.ndarray, enough: int | None = None) -> np.ndarray:
        """Words that agree from q on the test axis and p on the shard's, counted up to enough."""
        mine = self.index.axis
        size = np.zeros(len(q), np.int64)
        at = np.flatnonzero(live)
        d = 0
        while len(at) and d != enough:
            a, b = q[at] + d, p[at] + d
            at = at[(a < len(mine)) & (b < len(self.axis))]
            a, b = mine[q[at] + d], self.axis[p[at] + d]
            at = at[(a > 0) & (a == b)]
            size[at] += 1
            d += 1
        return size


def shards(texts: list[list[bytes]], get, limit: int = SHARD_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, axis, starts): word ids of the texts one after another, each ended by a 0."""
    first, parts, n = 0, [], 0
    for k, ws in enumerate(texts):
        ids = np.zeros(len(ws) + 1, np.int64)
        ids[:-1] = np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws))
        parts.append(ids)
        n += len(ids)
        if n >= limit or k == len(texts) - 1:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            yield first, k + 1, np.concatenate(parts), starts
            first, parts, n = k + 1, [], 0


def covered(n_axis: int, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which places of the axis lie in some [pos, pos + length)."""
    step = np.zeros(n_axis + 1, np.int64)
    np.add.at(step, pos, 1)
    np.add.at(step, pos + length, -1)
    return np.cumsum(step[:-1]) > 0


class Found:
    """What is known of one text: hit words (a mask, None without any), items, longest match and its first word."""

    __slots__ = ("hit", "items", "longest", "at")

    def __init__(self):
        self.hit, self.items, self.longest, self.at = None, set(), 0, -1


def scan(texts: list[list[bytes]], indexes: Iterable[TestIndex]) -> list[Found]:
    """What each text shares with the benchmark, whose blocks are taken one after another."""
    out = [Found() for _ in texts]
    for index in indexes:
        for first, _, axis, starts in shards(texts, index.vocab.get):
            window, pos = SuffixArray(axis, index).windows()
            if not len(pos):
                continue
            hit = covered(len(axis), pos, index.length[window])
            for d in np.unique(np.searchsorted(starts, pos, "right") - 1):
                mask, f = hit[starts[d] : starts[d + 1] - 1], out[first + int(d)]
                f.hit = mask if f.hit is None else f.hit | mask
            # each occurrence with each test suffix that begins with its window
            n = index.owner_end[window] - index.owner_start[window]
            at = np.repeat(index.owner_start[window] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            pos, length, suffix = np.repeat(pos, n), np.repeat(index.length[window], n), index.owner[at]
            doc = np.searchsorted(starts, pos, "right") - 1
            for d, o in zip(*np.divmod(np.unique(doc * len(index.items) + index.suffix_item[suffix]), len(index.items)), strict=True):
                out[first + int(d)].items.add(index.items[o])
            # consecutive windows of one item on one diagonal are one match
            order = np.lexsort((pos, pos - index.suffix[suffix], index.suffix_item[suffix], doc))
            pos, length, doc, suffix = pos[order], length[order], doc[order], suffix[order]
            same = (np.diff(doc) == 0) & (np.diff(index.suffix_item[suffix]) == 0) & (np.diff(pos) == 1) & (np.diff(suffix) == 1)
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            end = np.append(begin[1:], len(pos)) - 1
            size = pos[end] + length[end] - pos[begin]
            for d, s, p in zip(doc[begin].tolist(), size.tolist(), (pos[begin] - starts[doc[begin]]).tolist(), strict=True):
                f = out[first + d]
                if (s, -p) > (f.longest, -f.at if f.longest else 0):
                    f.longest, f.at = s, p
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Writes the benchmark as indexes of about block_words words each to the shared folder; returns their paths.

    Items are dealt by hash, so one item may exceed a block. Tasks write under names of their own, and only the
    names that a finished task returns count.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))  # six bytes a word, with its space
    folder = shared_dir(spark, "benchmark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        now, held = None, []

        def path() -> pa.RecordBatch:
            data = pickle.dumps(TestIndex(held, window), 5)
            name = f"{now}-{hashlib.sha256(data).hexdigest()}"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"], pa.string())], names=["path"])

        for batch in batches:
            for block, item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_values(batch.column(2)), strict=True):
                if block != now and held:
                    yield path()
                now = block
                words = byte_words(text)
                if words:
                    held.append((item, words))
        if held:
            yield path()

    dealt = items.select(F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int").alias("block"), "item", "text")
    dealt = dealt.repartition(min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").sortWithinPartitions("block", "item", "text")
    return sorted(r.path for r in dealt.mapInArrow(run, "path string").collect())  # one row a block


@lru_cache(maxsize=1)
def block(path: str) -> TestIndex:
    """A block as written; a worker keeps the one it read last."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        return pickle.loads(f.read())


SCORE_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_at long"


def score(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, share: float = 0.05, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: key (and the columns in keep), n_words, n_hit, n_items, items_sha256, contaminated, longest_match, match_at.

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive words of an item (of the
    whole item, if it is shorter); a document is contaminated if at least ``share`` of its words are hit.
    longest_match is the length in words of the longest passage that the document shares with an item, if it holds a
    window, else 0; match_at is the document's word where the first of them starts, else -1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [key, *(c for c in keep or [] if c != key)]
    paths = blocks(benchmark, window, block_words)
    text = free_name(docs.select(*names), "scan_text") if "text" not in names else "text"
    source = docs.select(*names) if "text" in names else docs.select(*names, F.col("text").alias(text))
    num, den = share.as_integer_ratio() if share != 0.05 else (1, 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block is read for each shard if there are several, so shards are as large as allowed then
        enough = MOST_BYTES if len(paths) > 1 else min(MOST_BYTES, max(SCAN_BYTES, *(64 * len(block(p).low) for p in paths), 0))
        held_batches: list[pa.RecordBatch] = []
        size = 0

        def judged() -> Iterator[pa.RecordBatch]:
            texts = [byte_words(v) for b in held_batches for v in utf8_values(b.column(b.schema.get_field_index(text)))]
            rows = scan(texts, map(block, paths))
            at = 0
            for part in held_batches:
                mine, n_words = rows[at : at + part.num_rows], [len(t) for t in texts[at : at + part.num_rows]]
                ids = [sorted(i for i in f.items if i is not None) for f in mine]
                hits = [0 if f.hit is None else int(f.hit.sum()) for f in mine]
                cols = [part.column(part.schema.get_field_index(c)) for c in names] + [
                    pa.array(n_words, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids], pa.string()),
                    pa.array([h > 0 and den * h >= num * n for h, n in zip(hits, n_words, strict=True)], pa.bool_()),
                    pa.array([f.longest for f in mine], pa.int64()),
                    pa.array([f.at for f in mine], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *(f.split()[0] for f in SCORE_SCHEMA.split(", "))])
                at += part.num_rows
            held_batches.clear()

        for batch in batches:
            held_batches.append(batch)
            size += batch.nbytes
            if size >= enough:
                yield from judged()
                size = 0
        if held_batches:
            yield from judged()

    schema = T.StructType([f for f in source.schema.fields if f.name in names] + T.StructType.fromDDL(SCORE_SCHEMA).fields)
    return source.mapInArrow(released(run), schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each suffix of each test item its longest verbatim match in the documents and one place of it.

    Columns item_id, item_word, n_words, <key>, doc_word. Shards report their best per suffix; the best of
    all shards (ties: smallest key, then place) is taken by a partial aggregation. Matches of fewer than
    LEAST_MATCH words are not reported, whatever the blocks hold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([*T.StructType.fromDDL("item_id string, item_word long, n_words long").fields, T.StructField(key, docs.schema[key].dataType), T.StructField("doc_word", T.LongType())])
    paths = blocks(benchmark, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            texts = [byte_words(v) for v in utf8_values(batch.column(1))]
            for index in map(block, paths):
                for first, _, axis, starts in shards(texts, index.vocab.get):
                    size, where = SuffixArray(axis, index).longest()
                    s = np.flatnonzero(size >= LEAST_MATCH)
                    doc = np.searchsorted(starts, where[s], "right") - 1
                    cols = [
                        pa.array([index.items[i] for i in index.suffix_item[s]], pa.string()),
                        pa.array(index.suffix_at[s]),
                        pa.array(size[s]),
                        keys.take(pa.array(first + doc)),
                        pa.array(where[s] - starts[doc]),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    out = docs.select(key, "text").mapInArrow(released(run), schema)
    best = out.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("n_words")).alias("n"), F.col(key), "doc_word")).alias("m"))
    return best.select("item_id", "item_word", (-F.col("m.n")).alias("n_words"), F.col(f"m.{key}").alias(key), F.col("m.doc_word").alias("doc_word"))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns."""
    names = docs.columns
    taken = {f.split()[0] for f in SCORE_SCHEMA.split(", ")}
    moved = {c: free_name(docs, f"own_{c}") for c in names if c in taken}
    scored = score(docs.withColumnsRenamed(moved), benchmark, keep=[moved.get(c, c) for c in names], **options)
    return scored.where(~F.col("contaminated")).select(*(F.col(moved.get(c, c)).alias(c) for c in names))
