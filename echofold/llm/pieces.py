"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary file is a byte-pair model. A segmentation is its encoding exactly if every two neighbouring
pieces, merged by themselves, give these two pieces again: merges inside a piece and across its edges do not
depend on anything further away. So an encoding is the one path of finite weight through the lattice of
pieces, where a piece may follow another if the two *fit* (else the weight is minus infinity) and each
piece weighs -1; and a max-plus product finds it.

A text longer than CHUNK characters is cut into chunks anywhere, also within words. The state at a cut is the
piece that reaches or crosses it. Each chunk gives a transfer matrix from states at its start to states at
its end (one task a chunk); the matrices of a text are combined associatively in a tree, whose descent fixes
the state at each cut; then each chunk is traced by itself. A shorter text is a single chunk. Words are cut
off from what precedes them (no piece has a space mark after another character), so the weights of a word's
path are kept per word.

Normalisation is that of the file: a space mark before the text, and for each space; characters without a
piece become byte pieces. Results equal the sentencepiece library's.

Defined results: null gives null ids, the empty text no pieces. A text that has the space mark U+2581 itself
decodes to a space there, as in the library. Repeated rows are encoded alike. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, small_batches, tokenizer_path, utf8_values, written

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = 32_768
WORDS_KEPT = 250_000
PAIRS_KEPT = 40_000
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
P = 0x9E3779B97F4A7C15 | 1
State = tuple[int, int]  # characters of the piece before the cut, and after it; (0, 0): start or end of the text
Matrix = dict[State, dict[State, int]]


class Pieces:
    """The pieces of a vocabulary file, and segmentation with them."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model with byte fallback, identity normalisation and a leading space mark is expected")
        self.id = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces with a space mark after another character are not supported")
        self.packed = {p: np.int32(k).tobytes() for p, k in self.id.items()}
        self.longest = max(map(len, self.id))
        self.byte_id = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() if p.type == 1 else b"" for p in model.pieces]
        self.known: dict[str, bytes] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.trie: dict = {}  # by characters; '' holds the piece that ends there
        for p in self.id:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p

    def merged(self, text: str) -> list[str]:
        """Characters merged by best score, leftmost first, until no neighbours make a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a ('' at the start)."""
        if a and b[0] == MARK and a[-1] != MARK:
            a = ""
        return self.merged(a + b) == ([a, b] if a else [b])

    def path(self, text: str) -> list[str]:
        """The one path of finite weight through a whole stretch, depth first, longer pieces first.

        The path to a place is unique, so a place from which the search has come back is never tried again.
        """
        size, at, a = len(text), 0, ""
        out: list[str] = []
        left: list[list[str]] = []
        dead: set[int] = set()
        pairs, longest = self.pairs, self.longest
        todo = None
        while at < size:
            if todo is None:
                node, todo = self.trie, []
                for c in text[at : at + longest]:
                    node = node.get(c)
                    if node is None:
                        break
                    if "" in node:
                        todo.append(node[""])
                if not todo or len(todo[0]) > 1:
                    todo.insert(0, text[at])
                known = pairs.get(a)
                if known is None:
                    if len(pairs) > PAIRS_KEPT:
                        pairs.clear()
                    known = pairs[a] = {}
            while todo:
                t = todo.pop()
                if at + len(t) in dead:
                    continue
                ok = known.get(t)
                if ok is None:
                    ok = known[t] = self.fits(a, t)
                if ok:
                    out.append(t)
                    left.append(todo)
                    at, a, todo = at + len(t), t, None
                    break
            else:
                dead.add(at)
                at -= len(out.pop())
                a, todo = out[-1] if out else "", left.pop()
                known = pairs.setdefault(a, {})
        return out

    def paths(self, text: str, start: int, before: str, stop: int) -> tuple[list[int], list[str], int]:
        """For each place from start to stop, counted from start, where the last piece of the path that ends there begins; -1: no path.

        Paths begin at start, after the piece ``before``. Of the pieces that end at a place at most one fits the
        path before it, so the first found stays. Also returns these last pieces and the furthest place reached.
        """
        size, far = stop - start, 0
        last, piece = [-1] * (size + 1), [""] * (size + 1)
        last[0], piece[0] = 0, before
        trie, pairs = self.trie, self.pairs
        for i in range(size):
            if last[i] < 0:
                if i > far:
                    break
                continue
            a = piece[i]
            known = pairs.get(a)
            if known is None:
                if len(pairs) > PAIRS_KEPT:
                    pairs.clear()
                known = pairs[a] = {}
            node, j = trie, i
            while j < size:
                node = node.get(text[start + j])
                if node is None:
                    if j > i:
                        break
                    t, node = text[start + j], {}  # a character without a piece
                else:
                    t = node.get("")
                j += 1
                if t is not None and last[j] < 0:
                    ok = known.get(t)
                    if ok is None:
                        ok = known[t] = self.fits(a, t)
                    if ok:
                        last[j], piece[j], far = i, t, max(far, j)
                elif j == i + 1 and t is None and last[j] < 0 and self.fits(a, text[start + i]):
                    last[j], piece[j], far = i, text[start + i], max(far, j)
        return last, piece, far

    def traced(self, found: tuple[list[int], list[str], int], end: int) -> bytes:
        """Ids of the path that ends at end, as int32 bytes."""
        last, piece, _ = found
        out = []
        while end > 0:
            out.append(self.packed.get(piece[end]) or self.spelt(piece[end]))
            end = last[end]
        return b"".join(reversed(out))

    def spelt(self, character: str) -> bytes:
        """The byte pieces of a character without a piece."""
        return np.array([self.byte_id[b] for b in character.encode()], np.int32).tobytes()

    def segment(self, text: str) -> bytes:
        """Ids of a stretch between cuts that no piece crosses, as int32 bytes."""
        got = self.known.get(text)
        if got is None:
            got = b"".join([self.packed.get(t) or self.spelt(t) for t in self.path(text)])
            if len(text) <= 48:
                if len(self.known) > WORDS_KEPT:
                    self.known.clear()
                self.known[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as int32 bytes."""
        if not text:
            return b""
        return b"".join(map(self.segment, SEGMENT.findall(MARK + text.replace(" ", MARK))))

    def raw_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces joined, marks to spaces, the first one dropped."""
        text = self.raw_bytes(ids).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    # ---- chunks: a window of text in which the cuts lie at ``a`` and ``b``
    def states(self, text: str, cut: int) -> list[State]:
        """Pieces that reach or cross a cut."""
        out = []
        for i in range(max(0, cut - self.longest), cut):
            out += [(cut - i, j - cut) for j in range(cut, min(len(text), i + self.longest) + 1) if j - i == 1 or text[i:j] in self.id]
        return out

    def word_starts(self, text: str, low: int, high: int) -> tuple[int, int]:
        """The first and the last place in [low, high) where a word starts; (-1, -1) if there is none."""
        first = text.find(MARK, low, high)
        while first > 0 and text[first - 1] == MARK:
            first = text.find(MARK, first + 1, high)
        last = text.rfind(MARK, low, high)
        while last > 0 and text[last - 1] == MARK:
            last = text.rfind(MARK, low, last)
        return (first, last) if first > 0 and last > 0 else (-1, -1)

    def exits(self, text: str, b: int, start: int, before: str, final: bool) -> dict[State, int]:
        """Weights to the states at b of the paths from start, after ``before``."""
        if final:  # the end of the text is the only exit
            last, _, _ = self.paths(text, start, before, b)
            return {(0, 0): -self.count(last, b - start)} if last[b - start] >= 0 else {}
        last, _, far = self.paths(text, start, before, min(len(text), b + self.longest - 1))
        return {(b - start - last[j], start + j - b): -self.count(last, j) for j in range(max(1, b - start), far + 1) if 0 <= last[j] < b - start}

    def count(self, last: list[int], end: int) -> int:
        n = 0
        while end > 0:
            end, n = last[end], n + 1
        return n

    def inner(self, text: str, a: int, b: int, final: bool) -> tuple[int, int]:
        """First and last word start of a chunk, clear of the pieces that cross its edges."""
        return self.word_starts(text, a + self.longest, b if final else b - self.longest)

    def transfer(self, text: str, a: int, b: int, first: bool, final: bool) -> Matrix:
        """From states at a to states at b.

        All paths meet at the start of a word; what lies between a chunk's first and last one adds the same
        weight to all of them and is left out.
        """
        out: Matrix = {}
        cut, again = self.inner(text, a, b, final)
        tail = self.exits(text, b, again, text[again - 1], final) if cut >= 0 else {}
        for s in [(0, 0)] if first else self.states(text, a):
            start, before = a + s[1], text[a - s[0] : a + s[1]]
            if cut < 0:
                row = self.exits(text, b, start, before, final)
            else:
                last, _, _ = self.paths(text, start, before, cut)
                row = {x: w - self.count(last, cut - start) for x, w in tail.items()} if last[cut - start] >= 0 else {}
            if row:
                out[s] = row
        return out

    def trace(self, text: str, a: int, b: int, enter: State, leave: State) -> np.ndarray:
        """Ids of a chunk's pieces: those after the entering one, up to the leaving one."""
        start, before, end = a + enter[1], text[a - enter[0] : a + enter[1]], b + leave[1]
        cut, again = self.inner(text, a, b, leave == (0, 0))
        if cut < 0:
            return np.frombuffer(self.traced(self.paths(text, start, before, end), end - start), np.int32)
        head = self.traced(self.paths(text, start, before, cut), cut - start)
        tail = self.traced(self.paths(text, again, text[again - 1], end), end - again)
        return np.frombuffer(head + b"".join(map(self.segment, SEGMENT.findall(text[cut:again]))) + tail, np.int32)


def product(x: Matrix, y: Matrix) -> Matrix:
    """Max-plus product of two transfer matrices."""
    out: Matrix = {}
    for s, row in x.items():
        best: dict[State, int] = {}
        for t, w in row.items():
            for u, v in y.get(t, {}).items():
                if w + v > best.get(u, -(1 << 62)):
                    best[u] = w + v
        if best:
            out[s] = best
    return out


def scan(matrices: list[Matrix]) -> list[State]:
    """States at the cuts, from the start (0, 0) to the end (0, 0): products up a tree, choices down it."""
    level, levels = matrices, [matrices]
    while len(level) > 1:
        level = [product(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        levels.append(level)
    cuts = [(0, 0), (0, 0)]
    if (0, 0) not in levels[-1][0].get((0, 0), {}):
        raise ValueError("the chunks of a text do not meet")
    for level in reversed(levels[:-1]):
        new = [cuts[0]]
        for k in range(0, len(level), 2):
            enter, leave = cuts[k // 2], cuts[k // 2 + 1]
            if k + 1 < len(level):
                row = level[k][enter]
                new.append(max((t for t in row if leave in level[k + 1].get(t, {})), key=lambda t: (row[t] + level[k + 1][t][leave], t)))
            new.append(leave)
        cuts = new
    return cuts


def packed(m: Matrix) -> str:
    return json.dumps([[*s, *t, w] for s, row in m.items() for t, w in row.items()])


def unpacked(text: str) -> Matrix:
    out: Matrix = {}
    for a, b, c, d, w in json.loads(text):
        out.setdefault((a, b), {})[c, d] = w
    return out


def powers(n: int, kept: list[np.ndarray] = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006  a cache
    if len(kept[0]) < n:
        kept[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, P, np.uint64)]))
    return kept[0][:n]


def digest(ids: np.ndarray) -> int:
    """sum (id + 1) P^k modulo 2^64, which chunks can be combined by."""
    return int(((ids.astype(np.uint64) + np.uint64(1)) * powers(len(ids))).sum()) if len(ids) else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_LOADED: dict[str, Pieces] = {}


def loaded(name: str, data: bytes) -> Pieces:
    """The pieces of a file, made once in a process, so that words stay known from task to task."""
    if name not in _LOADED:
        _LOADED[name] = Pieces(data)
    return _LOADED[name]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Consecutive rows of one uid."""
    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["uid"] != rows[0]["uid"]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


RESULTS = "n_tokens long, ids_hash long, round_trip boolean, ids binary"
ARROW = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())


def results(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(ARROW)]


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = MODEL, folder: str | None = None, chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """Per row: the columns in keep, n_tokens, ids_hash, round_trip (whether the ids decode to the text), and ids if asked for.

    ``ids`` are the int32 ids as binary; of a text of several chunks, all of them in order.
    """
    spark = docs.sparkSession
    path = tokenizer_path(model, folder)
    with open(path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    small_batches(spark)
    own = [c for c in keep if c != "text"]
    docs = docs.select(F.struct(*own, F.lit(0).alias("_")).alias("row"), "text")
    row = T.StructField("row", T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema["row"].dataType.fields]))
    ddl = lambda cols: T.StructType.fromDDL(cols).fields
    out_names = ["row", "text", *(f.name for f in ddl(RESULTS))]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path, held.value)
        mark, space = MARK.encode(), b" "
        for batch in batches:
            rows: list[tuple] = []
            for t in utf8_values(batch.column(1)):
                if t is None:
                    rows.append((None,) * 4)
                    continue
                data = pieces.encode(t.decode("utf-8", "replace"))
                ids = np.frombuffer(data, np.int32)
                ok = pieces.raw_bytes(ids).replace(mark, space) == (space + t if t else t)
                rows.append((len(ids), signed(digest(ids)), ok, data if with_ids else None))
            yield pa.RecordBatch.from_arrays([*batch.columns, *results(rows)], names=out_names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path, held.value)
        reach = 2 * pieces.longest
        for batch in batches:
            types = [pa.int64(), batch.schema.field("row").type, pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            for r in batch.to_pylist():
                text = MARK + r["text"].replace(" ", MARK)
                rows = []
                n = max(1, len(text) // chunk)
                for k in range(n):
                    a, b = k * chunk, len(text) if k == n - 1 else (k + 1) * chunk
                    low = max(0, a - reach)
                    # the row's columns travel with its first chunk; body: the part of the text itself
                    rows.append((r["uid"], None if k else r["row"], k, k == n - 1, MARK not in r["text"], a - low, b - low, text[low : b + reach], r["text"][max(0, a - 1) : b - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["uid", "row", "no", "final", "plain", "a", "b", "window", "text"])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path, held.value)
        for batch in batches:
            rows = [packed(pieces.transfer(r["window"], r["a"], r["b"], r["no"] == 0, r["final"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.string())], names=["uid", "no", "matrix"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            cuts = scan([unpacked(r["matrix"]) for r in rows])
            flat = [(r["uid"], r["no"], *s, *t) for r, s, t in zip(rows, cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], names=["uid", "no", "e0", "e1", "x0", "x1"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path, held.value)
        for batch in batches:
            rows = []
            for r in batch.select(["a", "b", "window", "plain", "e0", "e1", "x0", "x1"]).to_pylist():
                enter, leave = (r["e0"], r["e1"]), (r["x0"], r["x1"])
                ids = pieces.trace(r["window"], r["a"], r["b"], enter, leave)
                ok = r["plain"] and pieces.raw_bytes(ids) == r["window"][r["a"] + enter[1] : r["b"] + leave[1]].encode()
                rows.append((len(ids), signed(digest(ids)), ok, ids.tobytes() if with_ids else None))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "no", "row", "text")), *results(rows)], names=["uid", "no", *out_names])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, rows in grouped_typed(batches):
            n = h = 0
            for r in rows:
                h = (h + r["ids_hash"] * pow(P, n, 1 << 64)) % (1 << 64)
                n += r["n_tokens"]
            done = (n, signed(h), all(r["round_trip"] for r in rows), b"".join(r["ids"] for r in rows) if with_ids else None)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["row"]], kind), pa.array(["".join(r["text"] for r in rows)], pa.string()), *results([done])], names=out_names)

    done = T.StructType([row, *ddl("text string"), *ddl(RESULTS)])
    long = F.char_length("text") > chunk
    whole = docs.where(~F.coalesce(long, F.lit(False))).mapInArrow(released(short), done)
    big = docs.where(long).select(F.monotonically_increasing_id().alias("uid"), "row", "text")
    # a table, so that the numbers of texts and chunks are settled before they are joined
    chunks = written(big.mapInArrow(cut, T.StructType([*ddl("uid long"), row, *ddl("no long, final boolean, plain boolean, a long, b long, window string, text string")])), "chunks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    matrices = chunks.select("uid", "no", "window", "a", "b", "final").repartition(n, "uid", "no").mapInArrow(transfers, "uid long, no long, matrix string")
    cuts = matrices.repartition(n, "uid").sortWithinPartitions("uid", "no").mapInArrow(meet, "uid long, no long, e0 long, e1 long, x0 long, x1 long")
    traced = chunks.join(cuts, ["uid", "no"]).mapInArrow(trace, T.StructType([*ddl("uid long, no long"), *done.fields]))
    parts = traced.repartition(n, "uid").sortWithinPartitions("uid", "no").mapInArrow(joined, done)
    cols = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in keep]
    return whole.unionByName(parts).select(*cols, *(f.name for f in ddl(RESULTS) if with_ids or f.name != "ids"))


def grouped_typed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[dict]]]:
    """As grouped(), with the type of the column row."""
    kind: list[pa.DataType] = []

    def noted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind[:] = [batch.schema.field("row").type]
            yield batch

    for rows in grouped(noted()):
        yield kind[0], rows


def with_encoding(docs: DataFrame, **options) -> DataFrame:
    """docs with n_tokens, ids_hash, round_trip and ids; own columns of these names go."""
    taken = {f.split()[0] for f in RESULTS.split(", ")}
    return encode(docs, tuple(c for c in docs.columns if c.lower() not in taken), with_ids=True, **options)


def decode(encoded: DataFrame, key: str = "doc_id", model: str = MODEL, folder: str | None = None) -> DataFrame:
    """key and the text of ids (int32 as binary, as encode(with_ids=True) gives); null for null."""
    path = tokenizer_path(model, folder)
    with open(path, "rb") as f:
        held = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path, held.value)
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.frombuffer(x, np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, T.StructType([encoded.schema[key], T.StructField("text", T.StringType())]))
