"""Toxicity classification by a factorization machine over hashed terms.

A text's terms are the hash buckets of its distinct words and of their beginnings. The machine scores
``b + sum w_i + sum_{i<j} <v_i, v_j>`` over the terms that occur, so that a pair of terms can count for more
than the two alone. It is fitted in numpy on at most ``sample`` labelled rows (the smallest hashes of their
ids), over all buckets:

1. ``w`` by proximal Adam on the class-balanced logistic loss. The L1 penalty of a term grows with the
   standard deviation of its presence, as a lasso on standardised columns has it; no term is left out.
2. Interactions start where the loss still has a gradient: for two terms, the residual of the texts with both
   is compared with that of the texts with either. Pairs that stand out by PAIR_Z standard errors, and whose texts are misjudged by PAIR_EFFECT, get factors,
   whatever the two terms tell by themselves. The terms looked at are the ``PAIR_TERMS`` that most toxic texts
   of the sample have, a bound on the driver's memory.
3. ``w`` and ``v`` are fitted together, ``v`` with an L2 penalty.

Rounds are fixed numbers, whatever the number of rows. Scoring is one pass over the documents with the fitted
tables broadcast (their size is a parameter's).

Defined results: null, empty and word-less texts get the score of no terms. Rows with a null doc_id are
never learned from and not held out. Repeated rows score alike; repeated labels count once, contradictory
ones as toxic; of several texts of one id the one whose terms sort first is learned from. Without labelled rows
of both classes every score is 0 (to 13 digits). Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_words, crc_mod, free_name, give_back, released, small_batches, utf8_values

HASH_BITS = 18
#: Bytes of the beginnings of words that count as terms beside the words, so that inflected forms share a term.
BEGINNINGS = (4, 5, 6, 7)
SAMPLE = 12_000
RANK = 8
THRESHOLD = 0.7
PAIR_TERMS = 4096
PAIR_Z = 5.0
#: A pair's texts must be misjudged by so much on average, of 1.
PAIR_EFFECT = 0.25
#: Texts that a pair must share with some weight before it stands out; also smooths a term's share of the texts.
PAIR_LEAST = 8
ROUNDS, PAIR_ROUNDS, RATE = 160, 60, 0.1
#: Where in the gap between the classes of the sample the threshold lies, from the clean side.
GAP_SHARE = 0.4
#: Penalties in standard errors of a term's or a pair's gradient.
L1_W, L2_V = 0.35, 12.0
#: Terms and texts that are worked through at a time.
SLICE, LINES = 1 << 20, 256


def terms(text: bytes | None, bits: int = HASH_BITS) -> np.ndarray:
    """Hash buckets of the distinct words and of their beginnings, sorted, each once."""
    words = set(byte_words(text))
    if not words:
        return np.zeros(0, np.int32)
    hashes = list(map(zlib.crc32, words))
    for n in BEGINNINGS:
        hashes += [zlib.crc32(w, n) for w in {w[:n] for w in words if len(w) > n}]
    return np.unique(np.array(hashes, np.uint32) >> np.uint32(32 - bits)).astype(np.int32)


@dataclass
class Machine:
    """slot: bucket to row of w and v (0: not a term of the machine, its row is zero)."""

    slot: np.ndarray
    w: np.ndarray
    v: np.ndarray
    b: float
    scale: float
    shift: float
    bits: int

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        out = [np.zeros(0)]
        for k in range(0, len(rows), LINES):
            at = [s[s > 0] for s in (self.slot[r] for r in rows[k : k + LINES])]
            n = np.array([len(x) for x in at])
            out.append(linear_and_pairs(self.w, self.v, np.concatenate(at), n))
        return self.b + np.concatenate(out)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = self.scale * (self.logits(rows) - self.shift) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of n rows each; empty groups give zero."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    end = np.cumsum(n)
    return total[end] - total[end - n]


def linear_and_pairs(w: np.ndarray, v: np.ndarray, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = v[flat]
    s = sums(x, n)
    return sums(w[flat], n) + 0.5 * ((s * s).sum(1) - sums((x * x).sum(1), n))


class Adam:
    """Proximal Adam steps of one array; penalty is an L1 weight per entry."""

    def __init__(self, x: np.ndarray, penalty: np.ndarray | float = 0.0):
        self.x, self.penalty, self.t = x, penalty, 0
        self.m, self.u = np.zeros_like(x), np.zeros_like(x)

    def step(self, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.u += 0.01 * (grad * grad - self.u)
        rate = RATE / (np.sqrt(self.u / (1 - 0.99**self.t)) + 1e-8)
        x = self.x - rate * self.m / (1 - 0.9**self.t)
        self.x[...] = np.sign(x) * np.maximum(np.abs(x) - rate * self.penalty, 0)


class Texts:
    """The terms of all texts, one after another, worked through in slices of about SLICE terms."""

    def __init__(self, rows: Iterable[np.ndarray]):
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        parts = list(rows)
        if parts:
            self.size, self.flat = np.array([len(r) for r in parts]), np.concatenate(parts).astype(np.int32, copy=False)
        rows = parts
        end = np.cumsum(self.size)
        cut = np.unique(np.searchsorted(end, np.arange(SLICE, self.flat.size + SLICE, SLICE), "right"))
        edges = np.unique(np.concatenate([[0], cut, [len(rows)]]))
        self.parts = [(i, j, end[i] - self.size[i], end[j - 1]) for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def rows(self) -> list[np.ndarray]:
        return np.split(self.flat, np.cumsum(self.size)[:-1]) if len(self.size) else []

    def sums(self, w: np.ndarray) -> np.ndarray:
        """The sum of w over each text's terms."""
        return np.concatenate([sums(w[self.flat[a:b]], self.size[i:j]) for i, j, a, b in self.parts])

    def by_term(self, g: np.ndarray, n: int) -> np.ndarray:
        """The sum of g over each term's texts."""
        out = np.zeros(n)
        for i, j, a, b in self.parts:
            out += np.bincount(self.flat[a:b], np.repeat(g[i:j], self.size[i:j]), n)
        return out

    def only(self, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, term) of every occurrence of a term that keep (a mask of terms) admits, slice by slice."""
        for i, j, a, b in self.parts:
            at = np.flatnonzero(keep[self.flat[a:b]])
            yield np.repeat(np.arange(i, j, dtype=np.int32), self.size[i:j])[at], self.flat[a:b][at]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pairs(texts: Texts, y: np.ndarray, g: np.ndarray, by: np.ndarray, bits: int, seed: int) -> list[tuple[float, int, int]]:
    """(standard errors, term, term) of the pairs whose texts' residuals g differ from those of either term's texts.

    by: the texts' weights, which g holds as a factor. A pair counts if its texts are misjudged by PAIR_EFFECT on
    average and differ by PAIR_Z standard errors from each term's. Toxic texts are compared with at most twice as many others, drawn at random, which stand for all others.
    """
    n = 1 << bits
    toxic, other = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    drawn = np.random.default_rng(seed).permutation(other)[: 2 * len(toxic)]
    scale = np.zeros(len(y))
    scale[toxic], scale[drawn] = 1, len(other) / len(drawn)
    seen = texts.by_term(y, n)
    term = np.argsort(-seen, kind="stable")[:PAIR_TERMS]
    term = np.sort(term[seen[term] >= PAIR_LEAST])
    rows = np.flatnonzero(scale)
    place, column = np.zeros(len(y), np.int64), np.zeros(n, np.int64)
    place[rows], column[term] = np.arange(len(rows)), np.arange(len(term))
    mask = np.zeros(n, bool)
    mask[term] = True
    x = np.zeros((len(rows), len(term)), np.float32)
    for at, of in texts.only(mask):
        live = scale[at] > 0
        x[place[at[live]], column[of[live]]] = 1
    first, second, size = (v[rows].astype(np.float32) for v in (g * scale, g * g * scale * scale, by * scale))
    one, var = first @ x, np.maximum(second @ x, 1e-30)
    floor = PAIR_LEAST * float(second.mean())
    out = []
    for k in range(0, len(term), 256):
        a, s = x[:, k : k + 256], slice(k, k + 256)
        both, weight = (a * first[:, None]).T @ x[:, k:], (a * second[:, None]).T @ x[:, k:]
        z = None
        for share, alone in ((weight / var[s, None], one[s, None]), (weight / var[None, k:], one[None, k:])):
            t = (share * alone - both) / np.sqrt(weight * np.maximum(1 - share, 0) + floor)
            z = t if z is None else np.where(z * t <= 0, 0, np.where(np.abs(z) < np.abs(t), z, t))
        strong = np.abs(both) >= PAIR_EFFECT * np.maximum((a * size[:, None]).T @ x[:, k:], 1e-30)
        i, j = np.nonzero(np.triu((np.abs(z) >= PAIR_Z) & strong, 1))
        out += [(float(z[p, q]), int(term[k + p]), int(term[k + q])) for p, q in zip(i, j, strict=True)]
    return out


def fit(rows: list[np.ndarray] | Texts, y: np.ndarray, bits: int = HASH_BITS, rank: int = RANK, seed: int = 7) -> Machine:
    """The machine of all buckets, see above; buckets without weight and factors share its row of zeros."""
    y, n = y.astype(np.float64), 1 << bits
    slot = np.zeros(n, np.int32)
    if not len(y) or y.min() == y.max():
        return Machine(slot, np.zeros(1), np.zeros((1, rank)), 0.0, 1.0, 100.0, bits)
    texts = rows if isinstance(rows, Texts) else Texts(rows)
    n1, n0 = y.sum(), len(y) - y.sum()
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    share = (texts.by_term(np.ones(len(y)), n) + PAIR_LEAST) / (len(y) + 2 * PAIR_LEAST)
    error = 0.25 * np.sqrt(1 / n1 + 1 / n0)  # of a gradient, per standard deviation of a term's presence
    penalty = L1_W * error * np.sqrt(share * (1 - share))
    w, b = Adam(np.zeros(n), penalty), Adam(np.zeros(1))
    residual = lambda z: weight * (sigmoid(z) - y)
    z = np.zeros(len(y))
    for _ in range(ROUNDS):
        g = residual(z)
        w.step(texts.by_term(g, n))
        b.step(np.array([g.sum()]))
        z = texts.sums(w.x) + b.x[0]
    found = pairs(texts, y, residual(z), weight, bits, seed)
    # from here on the terms that have weight or a pair
    chosen = np.flatnonzero(w.x)
    chosen = np.unique(np.concatenate([chosen, np.array([t for _, *p in found for t in p], np.int64)]))
    slot[chosen] = np.arange(1, len(chosen) + 1)
    rng = np.random.default_rng(seed)
    v = np.zeros((len(chosen) + 1, rank))
    for z_pair, i, j in found:
        u = rng.normal(size=rank)
        u *= 0.5 / np.sqrt((u * u).sum())
        v[slot[i]] += u
        v[slot[j]] += np.sign(z_pair) * u
    factors = v.any(1)
    w = Adam(np.append(0.0, w.x[chosen]), np.append(0.0, penalty[chosen]))
    f, cost = Adam(v[factors]), (L2_V * error * np.append(0.0, share[chosen]))[factors, None]
    row = np.cumsum(factors) - 1
    kept = []
    for (i, j, *_), (at, term) in zip(texts.parts, texts.only(slot > 0), strict=True):
        at, flat = at - np.int32(i), slot[term]
        has = factors[flat]
        kept.append((weight[i:j], y[i:j], at, flat, at[has], row[flat[has]]))
    for _ in range(PAIR_ROUNDS):
        to_w, to_f, to_b = np.zeros_like(w.x), cost * f.x, 0.0
        for share_of, label, at, flat, who, which in kept:
            n = len(label)
            x = f.x[which]
            s = np.stack([np.bincount(who, x[:, k], n) for k in range(rank)], 1)
            z = b.x[0] + np.bincount(at, w.x[flat], n) + 0.5 * ((s * s).sum(1) - np.bincount(who, (x * x).sum(1), n))
            g = share_of * (sigmoid(z) - label)
            to_w += np.bincount(flat, g[at], len(w.x))
            to_b += g.sum()
            if len(f.x):
                pull = g[who, None] * (s[who] - x)
                to_f += np.stack([np.bincount(which, pull[:, k], len(f.x)) for k in range(rank)], 1)
        if len(f.x):
            f.step(to_f)
        w.step(to_w)
        b.step(np.array([to_b]))
    w.x[0] = 0
    v[factors] = f.x
    out = Machine(slot, w.x, v, float(b.x[0]), 1.0, 0.0, bits)
    z = out.logits(texts.rows())
    # the threshold: in the gap of the cut with the best F1 in the sample
    order = np.argsort(-z, kind="stable")
    tp = np.cumsum(y[order])
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + n1)
    k = int(f1.argmax())
    low = z[order[min(k + 1, len(y) - 1)]]
    out.shift = float(low + GAP_SHARE * (z[order[k]] - low))
    return out


def sample_ids(labels: DataFrame, learn: Column, n: int) -> DataFrame:
    """doc_id and toxic of the n labelled rows with the smallest hashes."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, bits: int = HASH_BITS) -> Machine:
    """Fits a machine on the labelled rows of docs that ``learn`` (a predicate on doc_id) admits.

    The sampled ids (at most ``sample``) are broadcast; terms are hashed by the executors and rows of one id
    become one before they are collected: at most ``sample`` rows, 2 ** bits terms of a row.
    """
    small_batches(docs.sparkSession)
    ids = sample_ids(labels.select("doc_id", "toxic"), F.lit(True) if learn is None else learn, sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [terms(t, bits).tobytes() for t in utf8_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(data, pa.binary())], names=["doc_id", "toxic", "data"])

    terms_of = rows.withColumn("toxic", F.col("toxic").cast("int")).mapInArrow(released(hashed), "doc_id long, toxic int, data binary")
    # one row a sampled id, however often it repeats and whatever its texts
    table = terms_of.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("data").alias("data")).toArrow()
    order = pc.sort_indices(table["doc_id"]).to_pylist()
    y = np.array(table["toxic"].to_pylist(), np.int64)[order] > 0
    texts = Texts(np.frombuffer(table["data"][k].as_buffer(), np.int32) for k in order)
    del table  # the texts are copies
    out = fit(texts, y, bits)
    del texts
    give_back()
    return out


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns in keep, then score (0 to 1) and predicted (1 if score >= 0.7)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    text = free_name(docs.select(*keep), "scan_text")
    source = docs.select(*keep, F.col("text").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            s = m.score([terms(t, m.bits) for t in utf8_values(batch.column(len(keep)))])
            cols = [*batch.columns[: len(keep)], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", "predicted"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(released(run), schema)


def held_out(docs: DataFrame, labels: DataFrame, mod: int = 3, fold: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the fold's labels are not learned from."""
    machine = train(docs, labels, crc_mod("doc_id", mod) != fold, sample)
    out = score(docs, machine, ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", mod) == fold, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns, whatever their names."""
    moved = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in ("score", "predicted")}
    kept = score(docs.withColumnsRenamed(moved), machine, [moved.get(c, c) for c in docs.columns]).where("predicted = 0")
    return kept.select(*(F.col(moved.get(c, c)).alias(c) for c in docs.columns))
