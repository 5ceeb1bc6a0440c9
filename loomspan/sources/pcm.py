"""Recordings in PCM files as a data source ``pcm``. Partitions are byte ranges, so neither a row nor a task holds a recording.

    spark.dataSource.register(PcmSource)
    spark.read.format("pcm").option("splitChannels", "true").load("/recordings")
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stores import files_under, store

SCHEMA = "path string, channel int, rate int, block_no long, samples array<float>, error string"
_ARROW = pa.schema([("path", pa.string()), ("channel", pa.int32()), ("rate", pa.int32()), ("block_no", pa.int64()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])

#: What a file's format number says of its samples.
INTEGERS, FLOATS, EXTENSIBLE = 1, 3, 0xFFFE


class BadRecording(ValueError):
    """A file that is no PCM recording."""


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file are, and how they are written."""

    kind: int
    channels: int
    rate: int
    width: int
    at: int
    frames: int

    def decode(self, raw: bytes) -> np.ndarray:
        """Whole frames in -1..1: (frames, channels)."""
        if self.kind == FLOATS:
            x = np.frombuffer(raw, f"<f{self.width}").astype(float)
        elif self.width == 1:
            x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
        elif self.width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
        else:
            x = np.frombuffer(raw, f"<i{self.width}") / float(1 << 8 * self.width - 1)
        return x.reshape(-1, self.channels)


def layout(f: BinaryIO, size: int) -> Layout:
    """Reads a file's chunks up to its samples. A file that ends early has the whole frames that are there."""
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise BadRecording("no RIFF WAVE file")
    described = None
    while len(head := f.read(8)) == 8:
        name, length = head[:4], int.from_bytes(head[4:], "little")
        if name == b"data":
            if described is None:
                raise BadRecording("samples before their format")
            kind, channels, rate, width = described
            return Layout(kind, channels, rate, width, f.tell(), min(length, size - f.tell()) // (width * channels))
        at = f.tell()
        if name == b"fmt ":
            body = f.read(min(length, 40))
            if len(body) < 16:
                break
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == EXTENSIBLE and len(body) >= 26:
                kind = int.from_bytes(body[24:26], "little")
            if (kind, bits) not in {(INTEGERS, 8), (INTEGERS, 16), (INTEGERS, 24), (INTEGERS, 32), (FLOATS, 32), (FLOATS, 64)} or not channels or not rate:
                raise BadRecording(f"format {kind} of {bits} bits")
            described = kind, channels, rate, bits // 8
        f.seek(at + length + length % 2)
    raise BadRecording("no samples")


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: ``(path, size, from, to)``."""

    parts: list[tuple[str, int, int, int]]


def ranges(found: list[tuple[str, int]], most: int) -> list[Ranges]:
    """Large files in ranges of ``most`` bytes, small ones together up to as many; each file counts for 4 kB at least."""
    out, held, total = [], [], 0
    for path, size in found:
        for lo in range(0, max(size, 1), most):
            hi = min(lo + most, max(size, 1))
            cost = max(hi - lo, 4096)
            if held and total + cost > most:
                out.append(Ranges(held))
                held, total = [], 0
            held.append((path, size, lo, hi))
            total += cost
    return [*out, Ranges(held)] if held else out


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.extensions = tuple("." + x for x in options.get("extensions", "wav").lower().split(","))
        self.most = int(options.get("partitionbytes", 64 << 20))
        self.block = int(options.get("blocksamples", 480_000))
        self.least = max(self.block, 1 << 16)
        self.split = options.get("splitchannels", "false").lower() == "true"
        self.mode = options.get("mode", "DROPMALFORMED").upper()
        if self.block < 1 or self.most < 1 or self.mode not in ("DROPMALFORMED", "PERMISSIVE", "FAILFAST"):
            raise ValueError("blockSamples and partitionBytes are positive, mode is DROPMALFORMED, PERMISSIVE or FAILFAST")

    def partitions(self) -> list[InputPartition]:
        found = {}
        for where in self.paths:
            system, path = store(where)
            prefix = where[: len(where.rstrip("/")) - len(path)] if where.rstrip("/").endswith(path) else ""
            found |= {prefix + p: size for p, size in files_under(system, path) if p.lower().endswith(self.extensions)}
        return ranges(sorted(found.items()), self.most) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """Rows in batches that end where they hold a block's samples, so that memory does not follow the files."""
        rows, held = [], 0
        for row in self.rows(partition):
            rows.append(row)
            held += len(row.get("samples", ())) + 64
            if held >= self.least:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def rows(self, partition: Ranges) -> Iterator[dict]:
        for path, size, lo, hi in partition.parts:
            system, there = store(path)
            with system.open_input_file(there) as f:
                try:
                    found = layout(f, size)
                except BadRecording as e:
                    if self.mode == "FAILFAST":
                        raise ValueError(f"{path}: {e}") from e
                    if self.mode == "PERMISSIVE" and lo == 0:
                        yield {"path": path, "error": str(e)}
                    continue
                yield from self.blocks(path, f, found, lo, hi)

    def blocks(self, path: str, f: BinaryIO, found: Layout, lo: int, hi: int) -> Iterator[dict]:
        """Blocks whose first byte is in the range; they are the same however files are cut."""
        wide = found.width * found.channels
        step = wide * self.block
        for no in range(max(0, -(-(lo - found.at) // step)), -(-found.frames // self.block)):
            at = found.at + no * step
            if at >= hi:
                return
            f.seek(at)
            x = found.decode(f.read(wide * min(self.block, found.frames - no * self.block)))
            for k, part in enumerate(x.T if self.split else [x.mean(axis=1)]):
                yield {"path": path, "channel": k, "rate": found.rate, "block_no": no, "samples": part.astype(np.float32)}


class PcmSource(DataSource):
    """``path, channel, rate, block_no, samples, error`` of PCM files (integers of 8 to 32 bits, floats) under a path.

    Options: ``paths`` (JSON list, in place of a path to load; what doesn't exist has no rows), ``extensions`` ("wav"), ``blockSamples``
    (480,000; the last block of a recording is shorter), ``splitChannels`` ("false": channels are averaged), ``partitionBytes`` (64 MB) and
    ``mode`` for files that are no recordings: DROPMALFORMED, PERMISSIVE (one row with ``error``) or FAILFAST. A recording without samples has no row.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PcmReader:
        return PcmReader({k.lower(): v for k, v in self.options.items()})
