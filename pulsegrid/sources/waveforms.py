"""Raw recordings as a Spark data source: WFDB records, a text header and samples of 16 bits, several channels in turn.

``spark.read.format("recordings")`` makes one partition of each recording, up to MOST, and shares out more than that; of a folder of
recordings inside the path, whose files only its task lists, it makes one too. Its options name the wanted recordings, so that other
recordings' files are not opened, and channels, so that others are not decoded. (Spark's push-down of filters into Python
sources is left out: in 4.1 a filter that one plan pushes holds in the other plans of the same DataFrame too, and a union of two
filtered reads gives wrong rows.) Segments of fixed length are read one after the other, small ones together; a recording is never held whole. Writing goes to files or folders
of each task's own, which take their names when all tasks are done, so that repeated or lost tasks leave nothing half written. The driver
renames every file of a plain folder; where there are many recordings, they go to folders of EACH, and it renames these.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "recording string, channel string, segment long, start_us long, rate double, values array<double>"
#: The digital value that stands for a missing sample in 16-bit records.
MISSING = -32768
#: Partitions of the recordings in one folder at most, and recordings in each folder that a task writes.
MOST, EACH = 1024, 1000
#: Bytes of a recording read at once (a segment at least), and rows and samples of a batch (what one read gives at least).
READ, ROWS, SAMPLES = 1 << 20, 8192, 1 << 18


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    if re.match(r"file:/", path):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Signal:
    name: str
    file: str
    gain: float
    baseline: int


@dataclass(frozen=True)
class Header:
    record: str
    rate: float
    samples: int
    signals: tuple[Signal, ...]

    @staticmethod
    def parsed(text: str) -> Header:
        lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
        first = lines[0].split()
        record, count = first[0].split("/")[0], int(first[1])
        signals = []
        for line in lines[1 : count + 1]:
            part = line.split(None, 8)
            if part[1] != "16":
                raise ValueError(f"record {record}: samples in format {part[1]}; only 16 is read")
            gain, baseline = re.match(r"([-\d.eE+]+)(?:\((-?\d+)\))?", part[2] if len(part) > 2 else "200").groups()
            zero = baseline if baseline is not None else part[4] if len(part) > 4 else 0
            signals.append(Signal(part[8].strip() if len(part) > 8 else f"{len(signals)}", part[0], float(gain) or 200.0, int(zero)))
        if len({s.file for s in signals}) > 1:
            raise ValueError(f"record {record}: signals in several files")
        return Header(record, float(first[2].split("/")[0]) if len(first) > 2 else 250.0, int(first[3]) if len(first) > 3 else 0, tuple(signals))

    def text(self) -> str:
        lines = [f"{self.record} {len(self.signals)} {self.rate:g} {self.samples}"]
        return "\n".join([*lines, *(f"{s.file} 16 {s.gain:g}({s.baseline})/unit 16 0 0 0 0 {s.name}" for s in self.signals)]) + "\n"


@dataclass
class Share(InputPartition):
    """Headers of recordings, or a folder of them."""

    paths: list[str]
    folder: str | None = None


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.seconds = options["path"], float(options.get("seconds", 60))
        self.names, self.channels = ({*json.loads(options[k])} if k in options else None for k in ("recordings", "channels"))

    def headers(self, found: list[fs.FileInfo]) -> list[str]:
        own = sorted(x.path for x in found if x.base_name.endswith(".hea"))
        return [x for x in own if self.names is None or x.rpartition("/")[2][:-4] in self.names]

    def partitions(self) -> list[Share]:
        files, at = opened(self.path)
        found = files.get_file_info(fs.FileSelector(at))
        own, folders = self.headers(found), sorted(x.path for x in found if x.type == fs.FileType.Directory and x.base_name[0] not in "._")
        size = -(-len(own) // MOST) or 1
        return [*(Share(own[i : i + size]) for i in range(0, len(own), size)), *(Share([], x) for x in folders)]

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read a source without partitions
            return
        files, _ = opened(self.path)
        held, rows, samples = [], 0, 0
        for path in self.headers(files.get_file_info(fs.FileSelector(partition.folder))) if partition.folder else partition.paths:
            for part in self.parts(files, path):
                held.append(part)
                rows, samples = rows + len(part[2]), samples + len(part[4])
                if rows >= ROWS or samples >= SAMPLES:
                    yield self.batch(held)
                    held, rows, samples = [], 0, 0
        if held:
            yield self.batch(held)

    def parts(self, files: fs.FileSystem, path: str) -> Iterator[tuple]:
        """Some segments of a recording at a time: its name, rate, and of each row channel, segment, start; values and what
        is missing of them, row after row, and the rows' lengths."""
        with files.open_input_stream(path) as f:
            header = Header.parsed(f.read().decode())
        own = [(i, s) for i, s in enumerate(header.signals) if self.channels is None or s.name in self.channels]
        if not own:
            return
        length, width = max(1, round(self.seconds * header.rate)), len(header.signals)
        many, first = max(1, READ // (2 * width * length)), 0
        with files.open_input_stream(f"{path.rpartition('/')[0]}/{header.signals[0].file}") as f:
            while data := f.read(2 * width * length * many):
                x = np.frombuffer(data[: len(data) // (2 * width) * 2 * width], "<i2").reshape(-1, width)
                n = -(-len(x) // length) or 1
                segment, sizes = first + np.arange(n), np.full(n, length)
                sizes[-1] = len(x) - length * (n - 1)
                start = np.rint(segment * length / header.rate * 1e6).astype(np.int64)
                values = np.concatenate([(x[:, i] - float(s.baseline)) / s.gain for i, s in own])
                yield (header.record, header.rate, [s.name for _, s in own for _ in range(n)], (np.tile(segment, len(own)), np.tile(start, len(own))), values, x[:, [i for i, _ in own]].T.ravel() == MISSING, np.tile(sizes, len(own)))
                first += n

    @staticmethod
    def batch(held: list[tuple]) -> pa.RecordBatch:
        names, rates, channels, places, values, missing, sizes = zip(*held, strict=True)
        counts = [len(c) for c in channels]
        segment, start = (np.concatenate(x) for x in zip(*places, strict=True))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), mask=np.concatenate(missing)))
        rows = {"recording": [n for n, k in zip(names, counts, strict=True) for _ in range(k)], "channel": [c for x in channels for c in x], "segment": segment, "start_us": start, "rate": np.repeat(np.array(rates, float), counts)}
        return pa.RecordBatch.from_arrays([*map(pa.array, rows.values()), lists], names=[*rows, "values"])


@dataclass
class Written(WriterCommitMessage):
    """Paths that files or folders have, and are to have."""

    moves: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Takes rows in order of recording, segment; every recording's rows in one task, each segment with all channels."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.channels, self.gain = options["path"], options["channels"].split(","), float(options.get("gain", 100))
        self.each = int(options.get("each", 0))  # recordings in a folder; 0: no folders

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = opened(self.path)
        files.create_dir(at)
        moves, stream, name, segment, held = [], None, None, None, {}
        samples, rate, base, inside = 0, 0.0, "", 0  # base: where the recording's files are, without their ends

        def flush() -> None:
            nonlocal samples, held
            if held:
                size = max(map(len, held.values()))
                x = np.full((size, len(self.channels)), np.nan)
                for i, c in enumerate(self.channels):
                    x[: len(held.get(c, ())), i] = held.get(c, ())
                whole = np.floor(x * self.gain + 0.5)
                if (np.abs(whole[np.isfinite(whole)]) > 32767).any():
                    raise ArithmeticError(f"recording {name}: values beyond 16 bits at gain {self.gain:g}")
                stream.write(np.where(np.isfinite(whole), whole, MISSING).astype("<i2").tobytes())
                samples += size
            held = {}

        def close() -> None:
            if stream is None:
                return
            flush()
            stream.close()
            header = Header(name, rate, samples, tuple(Signal(c, f"{name}.dat", self.gain, 0) for c in self.channels))
            with files.open_output_stream(f"{base}.hea") as f:
                f.write(header.text().encode())

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["recording"] != name:
                        close()
                        name, segment, samples, rate = row["recording"], None, 0, row["rate"]
                        own = uuid.uuid4().hex
                        if not self.each:
                            moves.append((f"{at}/_{own}", f"{at}/{name}"))
                        elif inside % self.each == 0:
                            moves.append((f"{at}/_{own}", f"{at}/part-{own}"))
                            files.create_dir(moves[-1][0])
                        base, inside = f"{moves[-1][0]}/{name}" if self.each else moves[-1][0], inside + 1
                        stream = files.open_output_stream(f"{base}.dat")
                    if row["segment"] != segment:
                        flush()
                        segment = row["segment"]
                    held[row["channel"]] = np.array([np.nan if v is None else v for v in row["values"]], float)
            close()
        except BaseException:
            self.removed(files, moves)
            raise
        return Written(moves)

    def removed(self, files: fs.FileSystem, moves: list[tuple[str, str]]) -> None:
        for own in (own + end for own, _ in moves for end in self.ends()):
            kind = files.get_file_info(own).type
            if kind != fs.FileType.NotFound:
                files.delete_dir(own) if kind == fs.FileType.Directory else files.delete_file(own)

    def ends(self) -> list[str]:
        return [""] if self.each else [".dat", ".hea"]  # a header is there only if its samples are

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = opened(self.path)
        for own, name in (m for message in messages if message for m in message.moves):
            for end in self.ends():
                files.move(own + end, name + end)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = opened(self.path)
        for message in messages:
            self.removed(files, message.moves if message else [])


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Recordings)
    return spark


def read_recordings(spark: SparkSession, path: str, seconds: float = 60, recordings: list[str] | None = None, channels: list[str] | None = None) -> DataFrame:
    """recording, channel, segment, start_us, rate, values of each segment, of all or the named recordings and channels;
    samples that are missing are null."""
    reader = registered(spark).read.format("recordings").option("path", path).option("seconds", seconds)
    for name, wanted in (("recordings", recordings), ("channels", channels)):
        reader = reader if wanted is None else reader.option(name, json.dumps(wanted))
    return reader.load()


def write_recordings(rows: DataFrame, path: str, channels: list[str], gain: float = 100, folders: bool = False) -> None:
    """``rows`` as in ``SCHEMA``, as a record for each recording; channels that a segment lacks are missing in it. With
    ``folders``, which suits many recordings, each task puts its records into folders of its own below ``path``."""
    spark = registered(rows.sparkSession)
    own = rows.select("recording", "channel", "segment", "start_us", "rate", "values")
    # small recordings are files all the same, so as many tasks write them as shuffles have partitions, however few their bytes
    dealt = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "recording").sortWithinPartitions("recording", "segment")
    writer = dealt.write.format("recordings").option("path", path).option("channels", ",".join(channels)).option("gain", gain)
    writer.option("each", EACH if folders else 0).mode("append").save()
