"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts is the number of byte n-grams (1 to 4 bytes, over words
and single spaces) that both have, divided by the root of the product of their numbers. A Nyström basis of
landmark texts stands for the kernel; one-versus-rest ridge regressions are fitted in it. As the kernel is
linear in n-gram presence, the landmarks' weights are folded into one table of n-gram slots by languages, and
BLOCK texts at a time are scored by one product of their presence matrix with that table.

N-grams are counted as presence in 2 ** SLOT_BITS hashed slots. Whole texts are read, by fit and score.

Every language that occurs is learned. The sample is shared evenly: each language has the rows with the smallest
hashes of their ids, ``per_lang`` at most and ``sample`` over all languages, yet never under LEAST a language;
landmarks likewise.

Defined results: ``und`` with score 0 for null texts and texts without a letter; also for all, if nothing
could be learned. Null lang or doc_id is not learned from; a null doc_id is not held out. A row that repeats
(id and language) is learned from once; of several texts of it the one whose slots sort first. Repeated rows
are judged alike; ties go to the smallest language. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import crc_mod, drop_tables, small_batches, utf8_values, written

SLOT_BITS = 18
PER_LANG = 400
SAMPLE = 40_000
LANDMARKS = 64
ALL_LANDMARKS = 4096
LEAST = 8
BLOCK = 32
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"
#: Letters lower-cased, non-ASCII bytes kept, all else a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SPACES = re.compile(rb" {2,}")
ASCII_LETTER = re.compile(rb"[A-Za-z]")
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def grams(text: bytes, scratch: np.ndarray) -> np.ndarray:
    """The slots of the text's n-grams, each once. scratch: 2 ** SLOT_BITS zeros, zero again after."""
    data = np.frombuffer(SPACES.sub(b" ", b" " + text.translate(TABLE) + b" "), np.uint8).astype(np.uint32)
    key = np.zeros(len(data), np.uint32)
    for n, m in enumerate(MULTIPLIERS):
        if len(data) <= n:
            break
        key = (key[: len(data) - n] << np.uint32(8)) | data[n:]
        scratch[((key + np.uint32(n)) * np.uint32(m)) >> np.uint32(32 - SLOT_BITS)] = True
    out = np.flatnonzero(scratch)
    scratch[out] = False
    return out


@dataclass
class Kernel:
    """place: slot to row of table (0: no landmark has it, its row is zero)."""

    langs: list[str]
    place: np.ndarray
    table: np.ndarray
    offset: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """One row a text: presence matrices of BLOCK texts each, scaled by the texts' norms, times the table."""
        presence = np.zeros((min(BLOCK, len(rows)), len(self.table)), np.float32)
        out = []
        for k in range(0, len(rows), BLOCK):
            mine = [self.place[r] for r in rows[k : k + BLOCK]]
            for line, r, at in zip(presence, rows[k : k + BLOCK], mine, strict=False):
                line[at] = 1 / np.sqrt(len(r))
            out.append(presence[: len(mine)] @ self.table)
            for line, at in zip(presence, mine, strict=False):
                line[at] = 0
        return np.concatenate(out) + self.offset

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        scratch = np.zeros(1 << SLOT_BITS, bool)
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        live = [k for k, t in enumerate(texts) if self.langs and has_letter(t)]
        if live:
            margin = self.margins([grams(texts[k], scratch) for k in live])
            p = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            for k, i, x in zip(live, margin.argmax(1), p.max(1), strict=True):
                lang[k], score[k] = self.langs[i], x
        return lang, score


def share(total: int, most: int, languages: int) -> int:
    """How many of total each language gets: most at most, LEAST at least."""
    return max(min(LEAST, most), min(most, total // max(1, languages)))


def fit(rows: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, seed: int = 5) -> Kernel:
    """rows: slots of each text. Landmarks are drawn evenly over the languages.

    Kernel values are computed LANDMARKS landmarks at a time and the normal equations row block by row block,
    so that the driver holds a table over the slots for so many landmarks only.
    """
    names = sorted(set(langs))
    if not names:
        return Kernel([], np.zeros(1 << SLOT_BITS, np.int32), np.zeros((1, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    number = {x: k for k, x in enumerate(names)}
    owner = np.array([number[x] for x in langs])
    each = share(ALL_LANDMARKS, max(LEAST, landmarks), len(names))
    order = rng.permutation(len(rows))
    order = order[np.argsort(owner[order], kind="stable")]
    nth = np.arange(len(rows)) - np.searchsorted(owner[order], owner[order])
    chosen = order[nth < each]
    norm = np.sqrt([len(r) for r in rows])
    k_nm = np.zeros((len(rows), len(chosen)), np.float32)
    for j in range(0, len(chosen), LANDMARKS):
        mine = chosen[j : j + LANDMARKS]
        basis = np.zeros((1 << SLOT_BITS, len(mine)), np.float32)
        for c, k in enumerate(mine):
            basis[rows[k], c] = 1 / norm[k]
        for i, r in enumerate(rows):
            k_nm[i, j : j + len(mine)] = basis[r].sum(0) / norm[i]
    k_mm = k_nm[chosen].astype(np.float64)
    y_mean = 2 * np.bincount(owner, minlength=len(names)) / len(rows) - 1
    left, right = np.zeros((len(chosen),) * 2), np.zeros((len(chosen), len(names)))
    for i in range(0, len(rows), 4096):
        part = k_nm[i : i + 4096].astype(np.float64)
        y = np.where(owner[i : i + 4096, None] == np.arange(len(names)), 1.0, -1.0) - y_mean
        left += part.T @ part
        right += part.T @ y
    left += RIDGE * len(rows) * (k_mm + k_mm.T) / 2
    alpha = np.linalg.solve(left + 1e-8 * np.trace(left) / len(left) * np.eye(len(left)), right)
    used = np.unique(np.concatenate([rows[k] for k in chosen]))
    place = np.zeros(1 << SLOT_BITS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    table = np.zeros((len(used) + 1, len(names)))
    for c, k in enumerate(chosen):
        table[place[rows[k]]] += alpha[c] / norm[k]
    return Kernel(names, place, table.astype(np.float32), y_mean)


def train(docs: DataFrame, learn: Column | None = None, per_lang: int = PER_LANG, sample: int = SAMPLE) -> Kernel:
    """Learns from each language's rows with the smallest hashes of their ids.

    Distinct (id, language) pairs are counted first, so that rows whose hash cannot be among a language's
    smallest leave before rows of one language meet in one task. What is collected is bounded by the sample.
    """
    small_batches(docs.sparkSession)
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn)).select("doc_id", "lang").distinct()
    counts = written(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    most = share(sample, per_lang, counts.count())
    place = F.xxhash64("doc_id")
    low = (place.cast("double") / 2.0**64 + 0.5) * F.col("n") <= 3 * most + 50
    by = Window.partitionBy("lang").orderBy(place, "doc_id")
    ids = ids.join(counts, "lang").where(low).select("doc_id", "lang")
    ids = ids.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).select("doc_id", "lang")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", "text")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(1 << SLOT_BITS, bool)
        for batch in batches:
            data = [grams(t, scratch).astype(np.int32).tobytes() if has_letter(t) else None for t in utf8_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["doc_id", "lang", "data"])

    found = rows.mapInArrow(slots, T.StructType([docs.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("data", T.BinaryType())]))
    # one row a sampled id and language, however often it repeats and whatever its texts
    got = found.where("data is not null").groupBy("lang", "doc_id").agg(F.min("data").alias("data")).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    drop_tables(counts)
    return fit([np.frombuffer(d.as_buffer(), np.int32) for d in got["data"]], got["lang"].to_pylist())


def predict(docs: DataFrame, kernel: Kernel, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = held.value.predict(utf8_values(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, "text").mapInArrow(run, T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(docs: DataFrame, mod: int = 5, fold: int = 0, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the fold's languages are not learned from."""
    kernel = train(docs, crc_mod("doc_id", mod) != fold, per_lang)
    out = predict(docs, kernel)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", mod) == fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
