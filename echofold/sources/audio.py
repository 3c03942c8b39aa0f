"""Recordings: finding them, reading their times, decoding them to frames of a shared folder."""

from __future__ import annotations

import json
import os
import shutil
import signal
import subprocess
import threading
import uuid
import wave
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparse import NAME_PATTERNS, name_time, text_time
from ..kernels import dsp

#: Fixed list of file extensions.
EXTENSIONS = (".mp3", ".flac", ".wav", ".m4a", ".aac", ".ogg", ".opus", ".ts", ".mp2", ".mp4", ".mkv")
PIECE = 1 << 20
#: Samples a second of stretches that are cut out of recordings other than WAV.
CUT_RATE = 44_100


def files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below a folder, by Hadoop's file systems; names beginning with a dot are passed over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.resolvePath(path).toString().rstrip("/")
    out, found = [], fs.listFiles(path, True)
    while found.hasNext():
        p = found.next().getPath().toString()
        if not any(x.startswith(".") for x in p[len(root) :].split("/")):
            out.append(p)
    return sorted(out)


def scan(spark: SparkSession, folder: str, pattern: str | None = None, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(path, start) of the recordings by start, and (path, reason) of those whose names have no time.

    pattern, a regular expression with groups date, hh, mm, ss and perhaps frac, replaces the usual ones.
    """
    rows = spark.createDataFrame([(p,) for p in files(spark, folder)], "path string")
    rows = rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*EXTENSIONS))
    name = F.element_at(F.split("path", "/"), -1)
    start = F.coalesce(*[name_time(name, p, zone) for p in ([pattern] if pattern else NAME_PATTERNS)])
    rows = rows.withColumn("start", start)
    bad = rows.where("start is null").select("path", F.lit("no time in the file's name").alias("reason"))
    return rows.where("start is not null").orderBy("start", "path"), bad


MANIFEST = "files array<struct<path: string, start: string>>"


def manifest(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """(path, start) of a JSON manifest, by start; relative paths count from its folder. A bad time fails with its index and path."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", MANIFEST)["files"]).alias("i", "f"))
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    whole = F.when(F.col("f.path").rlike("^([a-z0-9]+:)?/"), F.col("f.path")).otherwise(F.concat(F.lit(base + "/"), F.col("f.path")))
    start = text_time(F.col("f.start"), zone)
    fail = F.raise_error(F.format_string("manifest entry %d (%s): bad time %s", "i", "f.path", "f.start")).cast("timestamp")
    return rows.select("i", whole.alias("path"), F.coalesce(start, fail).alias("start")).orderBy("start", "i").select("path", "start")


# ---- decoding
class Resampler:
    """Resamples a stream piece by piece, with enough of the last piece kept for the filter."""

    def __init__(self, rate: int, taps: int = 32):
        self.step = rate / dsp.RATE
        self.cut = min(1.0, dsp.RATE / rate)
        self.half = int(np.ceil(taps / self.cut))
        self.buffer, self.base, self.done = np.zeros(self.half), -self.half, 0

    def feed(self, samples: np.ndarray, last: bool = False) -> np.ndarray:
        if self.step == 1:
            return samples
        self.buffer = np.concatenate([self.buffer, samples, np.zeros(self.half + 1 if last else 0)])
        end = self.base + len(self.buffer) - self.half - 1
        n = max(0, int(np.floor(end / self.step)) - self.done)
        out = np.empty(n)
        for k in range(0, n, 65536):
            at = (self.done + np.arange(k, min(n, k + 65536))) * self.step
            whole = np.floor(at).astype(np.int64)
            d = np.arange(-self.half + 1, self.half + 1)
            x = (at - whole)[:, None] - d
            w = self.cut * np.sinc(self.cut * x) * (0.5 + 0.5 * np.cos(np.pi * np.clip(x / self.half, -1, 1)))
            out[k : k + len(at)] = (self.buffer[whole[:, None] + d - self.base] * w).sum(1)
        self.done += n
        drop = max(0, int(self.done * self.step) - self.half - self.base)
        self.buffer, self.base = self.buffer[drop:], self.base + drop
        return out


def wav_pieces(file) -> Iterator[np.ndarray]:
    """Mono samples in [-1, 1] at the analysis rate, of a PCM WAV file."""
    with wave.open(file, "rb") as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        resample = Resampler(rate)
        while data := w.readframes(PIECE):
            if width == 1:
                x = np.frombuffer(data, np.uint8).astype(np.float64) / 128 - 1
            elif width == 3:
                raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) ^ 0x800000) - 0x800000
                x = x / float(1 << 23)
            else:
                x = np.frombuffer(data, "<i2" if width == 2 else "<i4").astype(np.float64) / float(1 << (8 * width - 1))
            yield resample.feed(x[: len(x) // channels * channels].reshape(-1, channels).mean(1))
        yield resample.feed(np.zeros(0), last=True)


def local_path(path: str) -> str | None:
    """The name of a file that this machine has, else None."""
    name = path.removeprefix("file://").removeprefix("file:")
    return name if os.path.exists(name) else None


def tool_output(path: str, timeout: float, options: list[str]) -> Iterator[bytes]:
    """What ffmpeg writes of a recording's audio, under options, piece by piece.

    A file of this machine is opened by the tool, any other is streamed to it from its file system. The tool runs in a
    process group of its own, which a timeout kills as a whole.
    """
    tool = shutil.which("ffmpeg")
    if tool is None:
        raise RuntimeError("only WAV can be read without ffmpeg")
    here = local_path(path)
    command = [tool, "-v", "error", *(["-nostdin"] if here else []), "-i", here or "pipe:0", "-map", "0:a:0", *options, "-"]
    p = subprocess.Popen(command, stdin=subprocess.DEVNULL if here else subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
    late, failed, errors = threading.Event(), [], []

    def kill():
        late.set()
        os.killpg(p.pid, signal.SIGKILL)

    def feed():
        try:
            fs, inner = pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(inner, compression=None) as f:
                while data := f.read(PIECE):
                    p.stdin.write(data)
        except BrokenPipeError:  # the tool has what it wants, or has ended: its status tells
            pass
        except Exception as e:
            failed.append(e)
        finally:
            try:
                p.stdin.close()
            except OSError:
                pass

    timer = threading.Timer(timeout, kill)
    timer.start()
    readers = [threading.Thread(target=lambda: errors.append(p.stderr.read()), daemon=True)] + ([] if here else [threading.Thread(target=feed, daemon=True)])
    for r in readers:
        r.start()
    try:
        while data := p.stdout.read(2 * PIECE):
            yield data
        code = p.wait()
        for r in readers:
            r.join(1)
        if late.is_set():
            raise TimeoutError(f"decoding took more than {timeout:g} s")
        if failed:
            raise failed[0]
        if code:
            raise RuntimeError(b"".join(errors).decode(errors="replace").strip()[-600:] or f"decoder ended with {code}")
    finally:
        timer.cancel()
        if p.poll() is None:
            os.killpg(p.pid, signal.SIGKILL)
            p.wait()


def tool_pieces(path: str, timeout: float) -> Iterator[np.ndarray]:
    """Mono samples in [-1, 1] at the analysis rate of any file that ffmpeg reads."""
    for data in tool_output(path, timeout, ["-ac", "1", "-ar", str(dsp.RATE), "-f", "s16le"]):
        yield np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float64) / 32768


class Params(NamedTuple):
    """What a WAV file's header says."""

    nchannels: int
    sampwidth: int
    framerate: int
    nframes: int
    comptype: str = "NONE"
    compname: str = "not compressed"


def cut(path: str, offset: float, length: float, timeout: float) -> tuple[Params, bytes]:
    """Parameters and frames of a stretch of a recording (in seconds; it ends with the file), of WAV files as they are."""
    if path.lower().endswith(".wav"):
        source, inner = pafs.FileSystem.from_uri(path)
        with source.open_input_file(inner) as f, wave.open(f, "rb") as w:
            rate = w.getframerate()
            w.setpos(min(w.getnframes(), int(offset * rate)))
            return Params(*w.getparams()), w.readframes(int(length * rate))
    data = b"".join(tool_output(path, timeout, ["-ss", f"{offset:.3f}", "-t", f"{length:.3f}", "-ac", "2", "-ar", str(CUT_RATE), "-f", "s16le"]))
    return Params(2, 2, CUT_RATE, len(data) // 4), data[: len(data) // 4 * 4]


def probe(path: str) -> dict:
    """codec, rate and channels of a WAV file, or by ffprobe."""
    if path.lower().endswith(".wav"):
        source, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
        with source.open_input_file(inner) as f, wave.open(f, "rb") as w:
            return {"codec": f"pcm_{8 * w.getsampwidth()}", "rate": w.getframerate(), "channels": w.getnchannels()}
    here, head = local_path(path), None
    if not here:
        fs, inner = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(inner, compression=None) as f:
            head = f.read(8 * PIECE)  # what names the codec is at the beginning
    command = ["ffprobe", "-v", "error", "-select_streams", "a:0", "-show_entries", "stream=codec_name,sample_rate,channels", "-of", "json", here or "pipe:0"]
    out = subprocess.run(command, input=head, capture_output=True, timeout=60, check=True)
    s = json.loads(out.stdout)["streams"][0]
    return {"codec": s["codec_name"], "rate": int(s["sample_rate"]), "channels": int(s.get("channels") or 1)}


DECODED = "path string, start_us long, file string, n long, error string"


def decoded(inputs: DataFrame, folder: str, timeout: float) -> DataFrame:
    """Decodes each input to a file of frames in the shared folder, one input a task at a time.

    A file that cannot be read, or has no frame, becomes a row with an error; the run goes on.
    """
    rows = inputs.select("path", F.unix_micros("start").alias("start_us"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, n, error = f"{uuid.uuid4().hex}.frames", 0, None
                try:
                    stream = dsp.Stream()
                    if path.lower().endswith(".wav"):
                        source, inner = pafs.FileSystem.from_uri(path)
                        with source.open_input_file(inner) as f:
                            for piece in wav_pieces(f):
                                stream.feed(piece)
                    else:
                        for piece in tool_pieces(path, timeout):
                            stream.feed(piece)
                    frames = stream.frames()
                    n = len(frames)
                    if not n:
                        error = "no frames"
                    else:
                        with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                            f.write(frames.tobytes())
                except Exception as e:  # one bad file never fails the run
                    error, n = f"{type(e).__name__}: {e}"[:600], 0
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((path, pa.string()), (start, pa.int64()), (name, pa.string()), (n, pa.int64()), (error, pa.string()))], names=[x.split()[0] for x in DECODED.split(", ")])

    parts = max(1, min(10_000, inputs.count()))
    return rows.repartition(parts, "path").mapInArrow(run, DECODED)
