"""Audio, features and likelihoods read by ranges of frames: one file in many tasks, no file as a row.

The driver lists files and their sizes. A task takes a range of frames of one file, or one of each of many small files: it reads the header and then the bytes
of its frames alone, which for audio reach into the next range by a window, and gives them in batches. Files are opened by
pyarrow's file systems, so a path may be local or a URI of a store that these know.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import AUDIO, FRAME_RATE, LIKELIHOODS, PRE_EMPHASIS

#: Frames that a task reads, and gives in one batch.
FRAMES, BATCH = 100_000, 4096
#: Bytes in which the header of a WAV file ends.
HEADER = 65_536
#: Frames that ranges of several files add up to in a task at most, as the files' sizes have it.
PACK = 32_768
NAME = "cadenza-ranged"


def uri(path: str) -> str:
    """A path as pyarrow takes it."""
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def write_contents(contents: DataFrame, folder: str) -> None:
    """One file in a folder for each row (path, content), named by its path; written by the tasks."""
    folder = uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with files.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    contents.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


@dataclass
class Layout:
    """Where frames are in a file: `first` bytes of header, then frame f in `size` bytes from the place of f on; `n` frames."""

    first: int
    n: int
    size: int

    def place(self, f: int) -> int:
        return self.first + f * self.size

    def rows(self, data: bytes, a: int, b: int) -> np.ndarray:
        raise NotImplementedError


@dataclass
class Pcm(Layout):
    """Samples of `bytes` each; a window begins every `advance` samples and is `width` samples long, and one before it."""

    channels: int = 1
    kind: str = "<i2"
    width: int = 0
    advance: float = 1.0
    bytes: int = 2

    def place(self, f: int) -> int:
        return self.first + int(f * self.advance) * self.bytes * self.channels

    def rows(self, data: bytes, a: int, b: int) -> np.ndarray:
        step = self.bytes * self.channels
        samples = np.frombuffer(data[: len(data) // step * step], self.kind)[:: self.channels].astype(float)
        x = samples[1:] - PRE_EMPHASIS * samples[:-1]
        zero = int(a * self.advance)
        return np.array([x[int(f * self.advance) - zero :][: self.width] for f in range(a, b)]).reshape(-1, self.width)


@dataclass
class Vectors(Layout):
    """Numbers of one kind, `dim` to a frame, divided by `unit`."""

    kind: str = "<f4"
    dim: int = 1
    unit: float = 1.0

    def rows(self, data: bytes, a: int, b: int) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.dim).astype(float) / self.unit


def wave_header(head: bytes) -> tuple[int, int, int, int, int]:
    """Rate, channels, the place of the first sample, samples per channel, and bytes of a sample of a WAV file of 16 or 32 bits."""
    with wave.open(io.BytesIO(head)) as w:
        if w.getsampwidth() not in (2, 4):
            raise ValueError("samples of 16 bits or of 32 are needed")
        at = 12
        while head[at : at + 4] != b"data":  # chunks of even length, one after the other
            at += 8 + (int.from_bytes(head[at + 4 : at + 8], "little") + 1) // 2 * 2
        return w.getframerate(), w.getnchannels(), at + 8, w.getnframes(), w.getsampwidth()


def layout(kind: str, head: bytes, size: int, options: dict[str, Any]) -> Layout:
    """The layout of a file of a kind (wav, raw, features, likelihoods) by its first bytes and its size."""
    if kind in ("wav", "raw"):
        rate, channels, first, each, code = int(options.get("rate", 16000)), 1, 0, 2, ">i2" if str(options.get("bigendian", "false")).lower() == "true" else "<i2"
        if kind == "wav":
            rate, channels, first, frames, each = wave_header(head)
            code, size = f"<i{each}", min(size, first + frames * each * channels)
        frame_rate = float(options.get("framerate", FRAME_RATE))
        width, advance = int(2 * rate / frame_rate), rate / frame_rate
        samples = (size - first) // (each * channels)
        n = max(0, math.floor((samples - width - 1) / advance) + 1)
        return Pcm(first, n, (width + 1) * each * channels, channels, code, width, advance, each)
    if kind == "features":
        short = str(options.get("shortheader", "false")).lower() == "true"
        dim, first = (head[0], 1) if short else (int.from_bytes(head[:4], "little"), 4)
        return Vectors(first, (size - first) // (4 * dim), 4 * dim, "<f4", dim)
    if kind == "likelihoods":
        states, width = int.from_bytes(head[:4], "big"), head[4]
        code, unit = {1: (">u1", -24.0), 2: (">u2", -1820.0), 4: (">f4", 1.0)}[width]
        return Vectors(5, (size - 5) // (states * width), states * width, code, states, unit)
    raise ValueError(f"unknown kind {kind}")


@dataclass
class Ranges(InputPartition):
    """Ranges that a task reads: of each file, which lies in `folder`, its size, the first frame and that behind the last one."""

    folder: str
    files: list[tuple[str, int, int, int]]


class RangedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.kind, self.frames = self.options["kind"], int(self.options.get("frames", FRAMES))

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(uri(self.options["path"]))
        info = files.get_file_info(path)
        found = [info] if info.is_file else [i for i in files.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and not i.base_name.startswith(("_", "."))]
        folder = path if not info.is_file else path.rpartition("/")[0]
        # a frame advances by two bytes at least, and by a known number where the header says nothing of it
        step = int(int(self.options.get("rate", 16000)) / float(self.options.get("framerate", FRAME_RATE))) * 2 if self.kind == "raw" else int(self.options.get("leastbytes", 2))
        out, group, held = [], [], 0

        def dealt(group: list[tuple[str, int, int]]) -> list[Ranges]:
            """Tasks of a group of files: the first range of each, the second of each, ..."""
            last = max((frames for _, _, frames in group), default=0)
            return [Ranges(folder, [(name, size, a, min(frames, a + self.frames)) for name, size, frames in group if a < frames]) for a in range(0, last, self.frames)]

        for path, size in sorted((i.path, i.size) for i in found):
            frames = max(1, -(-size // step))
            group.append((path[len(folder) :], size, frames))
            held += min(frames, self.frames)
            if held >= PACK:
                out += dealt(group)
                group, held = [], 0
        return out + dealt(group) or [Ranges(folder, [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(uri(self.options["path"]))
        parts, rows = [], 0
        for name, size, first, end in partition.files:
            path = partition.folder + name
            with files.open_input_file(path) as f:
                at = layout(self.kind, f.read(HEADER), size, self.options)
                stop = min(at.n, end)
                for a in range(first, stop, BATCH):
                    b = min(stop, a + BATCH)
                    f.seek(at.place(a))
                    parts.append((path, a, at.n, at.rows(f.read(at.place(b - 1) + at.size - at.place(a)), a, b)))
                    rows += b - a
                    if rows >= BATCH:
                        yield self.batch(parts)
                        parts, rows = [], 0
        if parts:
            yield self.batch(parts)

    def batch(self, parts: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
        """Rows of runs of frames: the file, the first frame, the file's number of frames, and vectors."""
        sizes = [len(x) for _, _, _, x in parts]
        width = np.repeat([x.shape[1] for _, _, _, x in parts], sizes)
        values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(np.concatenate([x.ravel() for _, _, _, x in parts])))
        file = pa.array([p for p, _, _, _ in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
        frame = np.concatenate([np.arange(a, a + k, dtype=np.int32) for (_, a, _, _), k in zip(parts, sizes, strict=True)])
        n = [pa.array(np.repeat([n for _, _, n, _ in parts], sizes).astype(np.int32))] if self.kind != "likelihoods" else []
        names = ["file", "frame", *("n" for _ in n), "x" if n else "logp"]
        return pa.RecordBatch.from_arrays([file, pa.array(frame), *n, values], names=names)


class RangedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LIKELIHOODS if self.options["kind"] == "likelihoods" else AUDIO

    def reader(self, schema: Any) -> RangedReader:
        return RangedReader(dict(self.options))


def read_ranged(spark: SparkSession, path: str, kind: str, frames: int = FRAMES, **options: Any) -> DataFrame:
    """file, frame, n, x (or file, frame, logp of likelihoods) of a file or a folder: wav, raw (rate, bigendian), features (shortheader) or likelihoods.

    Files are read `frames` frames at a time; a task takes one such range of a file, and of several files where these are small. `path` is absolute or a URI. Rows are those of the readers of whole files.
    """
    spark.dataSource.register(RangedSource)
    reader = spark.read.format(NAME).option("path", path).option("kind", kind).option("frames", str(frames))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
