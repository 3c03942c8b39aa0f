"""WARC archives with a two-level capture index.

``write`` stores one gzip member per record in archive files of the shared folder; a payload of at least
``min_revisit`` bytes that several pages share is stored once, with the page of the largest id, and the
others become revisit records. ``build_index`` sorts the captures by reversed-host URL key, packs them into
compressed blocks and keeps a sparse directory of first keys per shard, and one of shards above it.
A lookup binary-searches both, range-reads the block and the records: ``CaptureIndex.find`` for single URLs,
``lookup`` for tables of them, sorted, so that a directory is opened and a block is read once for all its keys.

Tasks write files under names of their own and only the files in the committed manifest count, so a task
that ran twice or was lost leaves no wrong record behind.

Defined results: a null html is an empty payload; a null url has the empty key and no WARC-Target-URI; a
null page_id is kept and never chosen as the response while another id exists. Repeated rows each get a
record; rows that share the largest page_id and the payload are all responses. Extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

MIN_REVISIT = 1000
BLOCK_LINES = 2048
#: Up to so many repeated payloads (some 30 bytes each) are known to every task; more are joined by shuffling.
KNOWN_PAYLOADS = 200_000
FILE_BYTES = 512 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "page_id long, url_key string, file string, offset long, length long, record_type string"
TRAILER = "<QQ"


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def url_key(url: str | None) -> str:
    """com,example,www)/path?query for http://www.example.com/path?query#part; the empty string for null."""
    if url is None:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    host, _, port = host.partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in key)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return headers, rest[:size]


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        headers += [("WARC-Refers-To", page_urn(refers_to)), ("WARC-Profile", PROFILE), ("X-Payload-Length", str(len(payload)))]
        return record("revisit", headers, b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("response", [*headers, ("Content-Type", "application/http; msgtype=response")], http + payload)


def read_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload SHA-1 in hex, record type, page referred to) of a gzip member."""
    headers, block = parse(zlib.decompress(data, 31))
    number = lambda urn: None if urn == "<urn:page:none>" else int(urn[10:-1])
    page_id, kind = number(headers["warc-record-id"]), headers["warc-type"]
    stated = base64.b32decode(headers["warc-payload-digest"][5:]).hex()
    if kind == "revisit":
        return page_id, int(headers["x-payload-length"]), stated, kind, number(headers["warc-refers-to"])
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"payload of page {page_id} does not have its digest")
    return page_id, len(payload), digest, kind, None


def decisions(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to (null: store as response).

    The largest id per payload is a partial aggregation over digests. Payloads that repeat are counted: up to
    KNOWN_PAYLOADS they are broadcast, so that html does not move; beyond, html moves once, keyed by digest, in a
    join whose hot keys AQE splits.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"))
    shared = written(
        d.where(F.octet_length("html") >= min_revisit)
        .groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "response_id"),
        "payloads",
    )
    if shared.count() <= KNOWN_PAYLOADS:
        shared = F.broadcast(shared)
    refers = F.when(F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return d.join(shared, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives below folder and returns the manifest, a committed Parquet table."""
    spark = pages.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(f"{root}/archive", recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{root}/archive/{name}", compression=None)
                        info = member(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)], b"format: WARC File Format 1.1\r\n"))
                        out.write(info)
                        at = len(info)
                    data = member(page_record(page_id, url, html, refers_to))
                    out.write(data)
                    rows.append((page_id, url_key(url), name, at, len(data), "response" if refers_to is None else "revisit"))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])
        finally:
            if out is not None:
                out.close()

    decisions(pages, min_revisit).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


SHARD = "shard string, first_key string, last_key string, blocks long, captures long"


def build_index(spark: SparkSession, folder: str, block_lines: int = BLOCK_LINES, shards: int | None = None) -> DataFrame:
    """Sorts the manifest by URL key into index shards; returns the directory of shards.

    The range partitioning is by key, then place, so captures of one hot URL spread over several shards.
    """
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["url_key", "file", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(f"{root}/index", recursive=True)
        name, directory, at, total, last, held = f"{uuid.uuid4().hex}.idx", [], 0, 0, "", []
        out = None

        def flush():
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{root}/index/{name}", compression=None)
            data = zlib.compress("\n".join(held).encode())
            out.write(data)
            directory.append((held[0].split("\t", 1)[0], at, len(data)))
            at += len(data)
            held.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(f"{key}\t{file}\t{offset}\t{length}")
                total, last = total + 1, key
                if len(held) >= block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + struct.pack(TRAILER, at, len(data)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (directory[0][0], pa.string()), (last, pa.string()), (len(directory), pa.int64()), (total, pa.int64()))], names=[x.split()[0] for x in SHARD.split(", ")])

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("url_key", "file", "offset", "length")
    manifest.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, SHARD).write.parquet(f"{folder}/shards")
    return spark.read.schema(SHARD).parquet(f"{folder}/shards")


class Shard:
    """One index shard: its sparse directory is read at opening, blocks on demand."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, length = struct.unpack(TRAILER, self.file.read_at(16, size - 16))
        self.directory = [tuple(x) for x in json.loads(zlib.decompress(self.file.read_at(length, at)))]
        self.first = [x[0] for x in self.directory]

    def block(self, k: int) -> list[tuple[str, str, int, int]]:
        _, at, length = self.directory[k]
        lines = (x.split("\t") for x in zlib.decompress(self.file.read_at(length, at)).decode().split("\n"))
        return [(key, file, int(offset), int(size)) for key, file, offset, size in lines]

    def places(self, key: str) -> range:
        """The blocks that may hold a key: from the last one that starts before it, as far as first keys reach."""
        return range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key))

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Captures of a key."""
        for k in self.places(key):
            yield from within(self.block(k), key)


def within(block: list[tuple[str, str, int, int]], key: str) -> list[tuple[str, int, int]]:
    """The captures of a key in a sorted block."""
    low, high = (side(block, key, key=lambda x: x[0]) for side in (bisect.bisect_left, bisect.bisect_right))
    return [x[1:] for x in block[low:high]]


class CaptureIndex:
    """Two-level lookup of URLs. The directory of shards holds one row a shard, a number set at building."""

    def __init__(self, folder: str, shards: list[tuple[str, str, str]]):
        self.folder, self.shards = folder, sorted(shards, key=lambda s: (s[1], s[2]))
        self.last = [s[2] for s in self.shards]
        self.open: dict[str, Shard] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> CaptureIndex:
        return cls(folder, [tuple(r) for r in spark.read.schema(SHARD).parquet(f"{folder}/shards").select("shard", "first_key", "last_key").collect()])

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def holders(self, key: str) -> list[str]:
        """The shards whose keys enclose a key, by binary search over the directory of shards."""
        out = []
        for name, first, _ in self.shards[bisect.bisect_left(self.last, key) :]:
            if first > key:
                break
            out.append(name)
        return out

    def shard(self, name: str) -> Shard:
        """An opened shard; of those that a worker met, the last few are kept open."""
        if name not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).file.close()
            fs, root = filesystem(self.folder)
            self.open[name] = Shard(fs, f"{root}/index/{name}")
        return self.open[name]

    def find(self, url: str | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of each capture of the url."""
        key = url_key(url)
        return [x for name in self.holders(key) for x in self.shard(name).find(key)]

    def records(self, url: str | None) -> list[tuple]:
        fs, root = filesystem(self.folder)
        out = []
        for file, offset, length in self.find(url):
            with fs.open_input_file(f"{root}/archive/{file}") as f:
                out.append(read_record(f.read_at(length, offset)))
        return out


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def lookup(urls: DataFrame, folder: str) -> DataFrame:
    """The records captured under the rows of urls (column url), each once: the columns of RECORDS.

    Keys are sorted and looked up in the directories of shards and blocks; what that gives, (shard, block, key), meets
    by block, which is read once; a key of many captures lies in many blocks, and so in many tasks. Captures are then
    ordered by archive and offset, so that each archive is read forwards in ranges. Two URLs can have one key.
    """
    spark = urls.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = CaptureIndex.of(spark, folder)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name, k, key) for key in batch.column(0).to_pylist() for name in index.holders(key) for k in index.shard(name).places(key)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["shard", "block", "key"])

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for name, k, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, k) != now:
                    now, held = (name, k), index.shard(name).block(k)
                out += within(held, key)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "offset", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, f = "", None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{root}/archive/{file}")
                rows.append(read_record(f.read_at(length, offset)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=[x.split()[0] for x in RECORDS.split(", ")])

    wanted = urls.select("url").mapInArrow(keys, "key string").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    at = wanted.mapInArrow(blocks, "shard string, block long, key string").repartition(n, "shard", "block").sortWithinPartitions("shard", "block", "key")
    found = at.mapInArrow(captures, "file string, offset long, length long")
    return found.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(records, RECORDS)
