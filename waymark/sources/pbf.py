"""A Spark data source for .osm.pbf files: `spark.read.format("osm_pbf").option("entity", "nodes").load(path)`.

A file is a row of blobs, each of which can be decoded alone. The driver reads the blob headers only and makes a
partition of every few blobs; tasks seek to theirs. Only the entity that is asked for is decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.sources.schema import RAW


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message: varints and fixed numbers as ints, the rest as bytes."""
    i = 0
    while i < len(raw):
        key, i = varint(raw, i)
        kind = key & 7
        if kind == 0:
            value, i = varint(raw, i)
        elif kind == 2:
            n, i = varint(raw, i)
            value, i = raw[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = int.from_bytes(raw[i : i + n], "little"), i + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def varint(raw: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[i]
        value |= (b & 127) << shift
        i += 1
        if b < 128:
            return value, i
        shift += 7


def packed(raw: bytes, zigzag: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(raw):
        v, i = varint(raw, i)
        out.append((v >> 1) ^ -(v & 1) if zigzag else v)
    return out


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def running(deltas: list[int]) -> list[int]:
    total, out = 0, []
    for d in deltas:
        total += d
        out.append(total)
    return out


def blob_data(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("a blob is compressed in a way that isn't supported")


def decode(block: bytes, entity: str) -> Iterator[tuple]:
    """Rows of one primitive block (see RAW)."""
    groups, strings, grain, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            lat0 = signed(v)
        elif k == 20:
            lon0 = signed(v)
    degrees = lambda v, offset: (offset + grain * v) / 1e9
    tags = lambda m: {strings[a]: strings[b] for a, b in zip(packed(m.get(2, b"")), packed(m.get(3, b"")), strict=True)}
    unzigzag = lambda v: (v >> 1) ^ -(v & 1)
    for group in groups:
        for k, raw in fields(group):
            if k == 1 and entity == "nodes":
                m = dict(fields(raw))
                yield unzigzag(m[1]), degrees(unzigzag(m[8]), lat0), degrees(unzigzag(m[9]), lon0), tags(m)
            elif k == 2 and entity == "nodes":
                m = dict(fields(raw))
                kv, at = packed(m.get(10, b"")), 0
                for id_, lat, lon in zip(*(running(packed(m.get(f, b""), True)) for f in (1, 8, 9)), strict=True):
                    own = {}
                    while at < len(kv) and kv[at]:
                        own[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield id_, degrees(lat, lat0), degrees(lon, lon0), own
            elif k == 3 and entity == "ways":
                m = dict(fields(raw))
                yield signed(m[1]), running(packed(m.get(8, b""), True)), tags(m)
            elif k == 4 and entity == "relations":
                m = dict(fields(raw))
                roles, refs, kinds = packed(m.get(8, b"")), running(packed(m.get(9, b""), True)), packed(m.get(10, b""))
                members = [(("node", "way", "relation")[t], r, strings[s]) for s, r, t in zip(roles, refs, kinds, strict=True)]
                yield signed(m[1]), members, tags(m)


@dataclass
class Blobs(InputPartition):
    places: tuple[tuple[int, int], ...]  # offset and size of each


class PbfReader(DataSourceReader):
    def __init__(self, path: str, entity: str, per_partition: int):
        self.path, self.entity, self.per_partition = path, entity, per_partition

    def _open(self):
        if "://" not in self.path and not self.path.startswith("file:"):
            return pyarrow.fs.LocalFileSystem().open_input_file(self.path)
        fs, path = pyarrow.fs.FileSystem.from_uri(self.path)
        return fs.open_input_file(path)

    def partitions(self) -> list[Blobs]:
        places = []
        with self._open() as f:
            at, size = 0, f.size()
            while at < size:
                n = struct.unpack(">I", f.read_at(4, at))[0]
                header = dict(fields(f.read_at(n, at + 4)))
                at += 4 + n
                if header[1] == b"OSMData":
                    places.append((at, header[3]))
                at += header[3]
        return [Blobs(tuple(places[i : i + self.per_partition])) for i in range(0, len(places), self.per_partition)]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        with self._open() as f:
            for at, size in partition.places:
                yield from decode(blob_data(f.read_at(size, at)), self.entity)


class PbfSource(DataSource):
    """Options: entity (nodes, ways, relations), blobs (per partition, 16)."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return RAW[f"osm_{self.options.get('entity', 'nodes')}"]

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], self.options.get("entity", "nodes"), int(self.options.get("blobs", "16")))


def read_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of a .pbf file, or of a folder of Parquet tables."""
    if path.endswith(".pbf"):
        spark.dataSource.register(PbfSource)
        return tuple(spark.read.format("osm_pbf").option("entity", e).load(path) for e in ("nodes", "ways", "relations"))
    return tuple(spark.read.schema(RAW[t]).parquet(f"{path}/{t}") for t in ("osm_nodes", "osm_ways", "osm_relations"))
