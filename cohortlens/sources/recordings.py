"""Recordings in vendor formats (EDF, BDF, BrainVision) as a Python data source that splits files, and their writers.

The driver reads headers only. A partition is a range of a file's data records (EDF, BDF) or of its sample frames
(BrainVision), or a run of such ranges where they are many, and reads just these bytes; a row is one channel of one chunk, so no array holds a recording. Files
that do not parse, channels of other lengths and truncated data are rows with an error, not failed jobs.

Files are opened by path or by a URI that Arrow's file systems know. Not read: discontinuous EDF+ (its records have
times of their own), compressed or vectorised text forms of BrainVision, and MATLAB containers.
"""

from __future__ import annotations

import configparser
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, channel string, chunk bigint, rate double, samples array<double>, error string"
NOTES = "path string, onset double, duration double, description string, error string"
#: The widths of the fields of an EDF header, of the file and of each channel.
FILE_FIELDS = (("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("size", 8), ("kind", 44), ("records", 8), ("seconds", 8), ("channels", 4))
CHANNEL_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
NOTE_CHANNELS = ("EDF Annotations", "BDF Annotations")
#: Sample formats of BrainVision.
BINARY = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}


def open_file(path: str):
    """A file that can seek."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return files.open_input_file(name)


def list_files(path: str) -> list[str]:
    """The recordings at a path: it, or the .edf, .bdf and .vhdr files below a folder, sorted."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    about = files.get_file_info(name)
    if about.type == fs.FileType.File:
        return [path]
    if about.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = files.get_file_info(fs.FileSelector(name, recursive=True))
    head = path.rstrip("/")
    return sorted(head + f.path[len(name.rstrip("/")) :] for f in found if f.is_file and f.path.lower().endswith((".edf", ".bdf", ".vhdr")))


@dataclass
class Layout:
    """Where the numbers of a file are: blocks of bytes, each with some samples of every channel."""

    path: str
    data: str
    offset: int
    blocks: int
    block_bytes: int
    kind: str
    rates: list[float] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    shift: list[float] = field(default_factory=list)
    seconds: float = 0.0


def edf_layout(path: str) -> Layout:
    with open_file(path) as f:
        size, head, held = f.size(), f.read(256), {}
        at = 0
        for name, width in FILE_FIELDS:
            held[name], at = head[at : at + width], at + width
        text = lambda v: v.decode("latin-1").strip()
        wide = held["version"][:1] == b"\xff"
        if len(head) < 256 or not (wide or text(held["version"]) == "0"):
            raise ValueError("no EDF or BDF header")
        if text(held["kind"]).startswith(("EDF+D", "BDF+D")):
            raise ValueError("discontinuous records")
        n, seconds = int(text(held["channels"])), float(text(held["seconds"]))
        more, about, at = f.read(256 * n), {}, 0
        if len(more) < 256 * n or n < 1:
            raise ValueError("a header that ends early")
        for name, width in CHANNEL_FIELDS:
            about[name], at = [text(more[at + i * width : at + (i + 1) * width]) for i in range(n)], at + n * width
    counts, width = [int(v) for v in about["samples"]], 3 if wide else 2
    block = sum(counts) * width
    low, high, first, last = ([float(v) for v in about[k]] for k in ("low", "high", "digital_low", "digital_high"))
    if min(counts) < 0 or block < 1 or any(a == b for a, b in zip(first, last, strict=True)):
        raise ValueError("a header that makes no sense")
    gain = [(h - lo) / (b - a) for lo, h, a, b in zip(low, high, first, last, strict=True)]
    there, said = (size - 256 * (n + 1)) // block, int(text(held["records"]))
    if said > there:
        raise ValueError(f"{there} of {said} records")
    rates = [c / seconds if seconds > 0 else 0.0 for c in counts]
    return Layout(path, path, 256 * (n + 1), there if said < 0 else said, block, "i3" if wide else "<i2", rates, about["label"], counts, gain, [lo - a * g for lo, a, g in zip(low, first, gain, strict=True)], seconds)


def vision_layout(path: str, frames: int = 1 << 14) -> Layout:
    """A BrainVision header; its blocks are runs of sample frames."""
    with open_file(path) as f:
        raw = f.read()
    text = raw.decode("utf-8", "replace") if b"codepage=utf-8" in raw.lower() else raw.decode("latin-1")
    head = configparser.ConfigParser(interpolation=None, delimiters=("=",), comment_prefixes=(";",), strict=False, allow_no_value=True)
    head.optionxform = str
    body = text[text.find("[") :].partition("[Comment]")[0]
    head.read_string(body)
    common = head["Common Infos"]
    if common.get("DataFormat", "BINARY") != "BINARY" or common.get("DataOrientation", "MULTIPLEXED") != "MULTIPLEXED":
        raise ValueError("only multiplexed binary data are read")
    kind = BINARY[head["Binary Infos"]["BinaryFormat"]] if "Binary Infos" in head else BINARY["INT_16"]
    n, step = int(common["NumberOfChannels"]), float(common["SamplingInterval"])
    parts = [head["Channel Infos"][f"Ch{i + 1}"].split(",") for i in range(n)]
    data = os.path.join(os.path.dirname(path), common["DataFile"].replace("$b", os.path.basename(path).rpartition(".")[0]))
    with open_file(data) as f:
        size = f.size()
    width = n * np.dtype(kind).itemsize
    gain = [float(p[2]) if len(p) > 2 and p[2].strip() else 1.0 for p in parts]
    out = Layout(path, data, 0, -(-(size // width) // frames), frames * width, kind, [1e6 / step] * n, [p[0].replace("\\1", ",") for p in parts], [frames] * n, gain, [0.0] * n, frames * step / 1e6)
    if size % width:
        raise ValueError(f"{size % width} bytes after the last frame")
    return out


def layout_of(path: str, frames: int = 1 << 14) -> Layout:
    return vision_layout(path, frames) if path.lower().endswith(".vhdr") else edf_layout(path)


def numbers_of(raw: bytes, kind: str) -> np.ndarray:
    """Numbers of a block; three-byte integers are little-endian and signed."""
    if kind != "i3":
        return np.frombuffer(raw, kind)
    low = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    return low[:, 0] | low[:, 1] << 8 | (low[:, 2] ^ 128) - 128 << 16


def note_times(raw: bytes) -> list[tuple[float, float, str]]:
    """(onset, duration, description) of one record's annotation bytes; time-keeping notes have no description."""
    out = []
    for note in raw.split(b"\x00"):
        if not note:
            continue
        when, *texts = note.split(b"\x14")
        onset, _, duration = when.partition(b"\x15")
        for text in texts:
            if text:
                out.append((float(onset), float(duration or 0), text.decode("utf-8", "replace")))
    return out


class _Range(InputPartition):
    def __init__(self, layout: Layout | None, first: int, last: int, path: str = "", error: str | None = None):
        self.layout, self.first, self.last, self.path, self.error = layout, first, last, path, error


class _Ranges(InputPartition):
    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


#: Ranges that have a task each; of more, a task has several, up to so many bytes.
MOST_TASKS, TASK_BYTES = 256, 32 << 20


def bundled(items: list, size: int) -> list[list]:
    """items, whose sizes sum up to size, in runs: as many as items or MOST_TASKS, or more if runs held over TASK_BYTES."""
    count = min(len(items), max(MOST_TASKS, -(-size // TASK_BYTES)))
    return [items[len(items) * i // count : len(items) * (i + 1) // count] for i in range(count)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.channels = {c for c in options.get("channels", "").split(",") if c}
        self.bytes = int(options.get("rangebytes", 32 << 20))
        self.frames = int(options.get("frames", 1 << 14))
        self.notes = options.get("notes", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in list_files(self.path):
            try:
                at = layout_of(path, self.frames)
            except (ValueError, KeyError, configparser.Error, OSError) as e:
                out.append(_Range(None, 0, 0, path, f"{type(e).__name__}: {e}"))
                continue
            step = max(1, self.bytes // at.block_bytes)
            if self.notes and at.path.lower().endswith(".vhdr"):
                out.append(_Range(at, 0, 1, path))
                continue
            out += [_Range(at, a, min(a + step, at.blocks), path) for a in range(0, at.blocks, step)]
        size = sum((r.last - r.first) * r.layout.block_bytes for r in out if r.layout)
        return [_Ranges(run) for run in bundled(out, size)]

    def read(self, partition) -> Iterator[tuple]:
        for part in partition.ranges:
            yield from self._read(part)

    def _read(self, partition) -> Iterator[tuple]:
        if partition.error:
            yield (partition.path, None, None, None, partition.error) if self.notes else (partition.path, None, None, None, None, partition.error)
            return
        try:
            yield from (self._notes if self.notes else self._samples)(partition)
        except (ValueError, OSError) as e:
            yield (partition.path, None, None, None, str(e)) if self.notes else (partition.path, None, partition.first, None, None, str(e))

    def _blocks(self, partition) -> Iterator[tuple[int, bytes]]:
        at = partition.layout
        with open_file(at.data) as f:
            f.seek(at.offset + partition.first * at.block_bytes)
            for block in range(partition.first, partition.last):
                yield block, f.read(at.block_bytes)

    def _samples(self, partition) -> Iterator[tuple]:
        at = partition.layout
        for block, raw in self._blocks(partition):
            values = numbers_of(raw, at.kind)
            starts = np.cumsum([0, *at.counts])
            vision = at.path.lower().endswith(".vhdr")
            for c, label in enumerate(at.labels):
                if label not in NOTE_CHANNELS and (not self.channels or label in self.channels):
                    own = values[c :: len(at.labels)] if vision else values[starts[c] : starts[c + 1]]
                    yield at.path, label, block, at.rates[c], (own * at.gain[c] + at.shift[c]).tolist(), None

    def _notes(self, partition) -> Iterator[tuple]:
        at = partition.layout
        if at.path.lower().endswith(".vhdr"):
            yield from ((at.path, *note, None) for note in vision_notes(at))
            return
        width = 3 if at.kind == "i3" else 2
        starts = np.cumsum([0, *at.counts]) * width
        for _, raw in self._blocks(partition):
            for c, label in enumerate(at.labels):
                if label in NOTE_CHANNELS:
                    for note in note_times(raw[starts[c] : starts[c + 1]]):
                        yield (at.path, *note, None)


def vision_notes(at: Layout) -> list[tuple[float, float, str]]:
    """(onset, duration, description) of a BrainVision file's markers, if it has a marker file; new segments are none."""
    with open_file(at.path) as f:
        found = re.search(rb"(?m)^MarkerFile=(.*?)\s*$", f.read())
    if not found:
        return []
    name = found[1].decode("utf-8").replace("$b", os.path.basename(at.path).rpartition(".")[0])
    with open_file(os.path.join(os.path.dirname(at.path), name)) as f:
        text = f.read().decode("utf-8", "replace")
    out = []
    for kind, said, position, length in re.findall(r"(?m)^Mk\d+=([^,\r\n]*),([^,\r\n]*),(\d+),(\d+)", text):
        if kind != "New Segment":
            out.append(((int(position) - 1) / at.rates[0], int(length) / at.rates[0], f"{kind}/{said}" if kind.lower() not in ("comment", "") else said.replace("\\1", ",")))
    return out


class RecordingSource(DataSource):
    """spark.read.format("recordings").load(path): options channels, rangebytes, frames, notes."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return NOTES if self.options.get("notes", "false") == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_recordings(spark: SparkSession, path: str, channels: tuple[str, ...] = (), range_bytes: int = 32 << 20, frames: int = 1 << 14) -> DataFrame:
    """SCHEMA: a row for each channel and chunk. A chunk is a data record of EDF and BDF, frames sample frames of BrainVision."""
    spark.dataSource.register(RecordingSource)
    reader = spark.read.format("recordings").option("rangebytes", str(range_bytes)).option("frames", str(frames))
    return (reader.option("channels", ",".join(channels)) if channels else reader).load(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """NOTES: annotations of EDF+ and BDF+ files, markers of BrainVision files."""
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recordings").option("notes", "true").load(path)


# --- writers ----------------------------------------------------------------------------------------------------


def _padded(value, width: int) -> bytes:
    text = str(value).encode("ascii", "replace")
    if len(text) > width:
        raise ValueError(f"{value!r} does not fit {width} bytes")
    return text.ljust(width)


def edf_header(labels: list[str], counts: list[int], records: int, seconds: float, low: float, high: float, wide: bool = False, notes: bool = False) -> bytes:
    """The header of an EDF or BDF file whose channels share one physical range."""
    top = (1 << 23 if wide else 1 << 15) - 1
    n = len(labels)
    about = {"version": "0", "patient": "X X X X", "recording": "Startdate X X X X", "date": "01.01.00", "time": "00.00.00", "size": 256 * (n + 1), "kind": (("BDF+C" if wide else "EDF+C") if notes else "24BIT" if wide else ""), "records": records, "seconds": f"{seconds:g}", "channels": n}
    head = b"".join(_padded(about[name], width) for name, width in FILE_FIELDS)
    if wide:
        head = b"\xffBIOSEMI" + head[8:]
    each = {"label": labels, "transducer": [""] * n, "unit": ["uV"] * n, "low": [f"{low:g}"] * n, "high": [f"{high:g}"] * n, "digital_low": [-top - 1] * n, "digital_high": [top] * n, "filter": [""] * n, "samples": counts, "reserved": [""] * n}
    return head + b"".join(_padded(v, width) for name, width in CHANNEL_FIELDS for v in each[name])


def _target(path: str):
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    files.create_dir(os.path.dirname(name), recursive=True)
    return files, name


def write_recordings(df: DataFrame, folder: str, rate: float, kind: str = "edf", low: float = -1000.0, high: float = 1000.0) -> DataFrame:
    """Write a file for each recording and return (recording, path, chunks).

    df has recording, channel, chunk (from 0, without gaps) and samples; all channels have as many samples a chunk, and
    all chunks as many but the last, which EDF and BDF fill up with 0. kind is edf, bdf or vhdr (32-bit floats).
    A task writes the rows of a recording in their order and holds one chunk of it; a task that is repeated writes
    the same file again, and a file gets its name when it is whole.
    """
    channels = [r["channel"] for r in df.select("channel").distinct().orderBy("channel").limit(10_001).collect()]
    shape = df.groupBy("recording").agg((F.max("chunk") + 1).alias("chunks"), F.max(F.size("samples")).cast("long").alias("size"))
    rows = df.join(shape, "recording").select("recording", "chunks", "size", "chunk", "channel", F.col("samples").cast("array<double>").alias("samples"))
    top = (1 << 23 if kind == "bdf" else 1 << 15) - 1
    gain = (high - low) / (2 * top + 1)

    def block(held: dict[str, np.ndarray], size: int) -> bytes:
        if set(held) != set(channels) or len({len(v) for v in held.values()}) > 1:
            raise ValueError("channels differ within a chunk")
        x = np.stack([held[c] for c in channels])
        if kind == "vhdr":
            return x.T.astype("<f4").tobytes()
        x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
        digital = np.clip(np.floor((x - low) / gain + 0.5) - top - 1, -top - 1, top).astype("<i4")
        return digital.astype("<i2").tobytes() if kind == "edf" else np.ascontiguousarray(digital).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def start(recording, chunks, size):
            files, name = _target(f"{folder}/{recording}.{kind}")
            data = name if kind != "vhdr" else name.removesuffix(".vhdr") + ".eeg"
            state.update(recording=recording, chunks=chunks, size=size, files=files, name=name, data=data, at=0, held={}, out=files.open_output_stream(data + ".part"))
            if kind != "vhdr":
                state["out"].write(edf_header(channels, [size] * len(channels), chunks, size / rate, low, high, kind == "bdf"))

        def flush():
            if state.get("held"):
                state["out"].write(block(state["held"], state["size"]))
                state["held"], state["at"] = {}, state["at"] + 1

        def finish() -> tuple:
            flush()
            state["out"].close()
            if state["at"] != state["chunks"]:
                raise ValueError(f"{state['at']} of {state['chunks']} chunks")
            state["files"].move(state["data"] + ".part", state["data"])
            if kind == "vhdr":
                stem = os.path.basename(state["data"])
                lines = ["Brain Vision Data Exchange Header File Version 1.0", "[Common Infos]", "Codepage=UTF-8", f"DataFile={stem}", "DataFormat=BINARY", "DataOrientation=MULTIPLEXED", f"NumberOfChannels={len(channels)}", f"SamplingInterval={1e6 / rate:.12g}", "[Binary Infos]", "BinaryFormat=IEEE_FLOAT_32", "[Channel Infos]"]
                lines += [f"Ch{i + 1}={c.replace(',', chr(92) + '1')},,1,µV" for i, c in enumerate(channels)]
                with state["files"].open_output_stream(state["name"] + ".part") as out:
                    out.write(("\n".join(lines) + "\n").encode())
                state["files"].move(state["name"] + ".part", state["name"])
            return str(state["recording"]), f"{folder}/{state['recording']}.{kind}", state["chunks"]

        for batch in batches:
            done = []
            column = batch.column(5)
            values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, (recording, chunks, size, chunk, channel) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if state.get("recording") != recording or not state:
                    if state:
                        done.append(finish())
                        state.clear()
                    start(recording, chunks, size)
                if chunk != state["at"]:
                    flush()
                state["held"][channel] = values[edges[i] : edges[i + 1]].astype(float)
            if done:
                yield _written(done)
        if state:
            yield _written([finish()])

    # Dealt by a hash: an exchange by the key of the join above would be left out as done, and adaptive execution may then
    # read the join's own exchange mapper by mapper, which gives several tasks the rows of one recording.
    dealt = rows.repartition(F.xxhash64("recording")).sortWithinPartitions("recording", "chunk", "channel")
    return dealt.mapInArrow(run, "recording string, path string, chunks bigint")


def _written(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["recording", "path", "chunks"])
