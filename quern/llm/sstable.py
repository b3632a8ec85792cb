"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order (the id, big-endian with the sign bit turned; a null id is the empty
key and comes first).  Its file is

    block*  index  filter  footer

A block is at most ``BLOCK`` bytes (or one entry): per entry the length of the prefix shared with the key before it,
the length of the rest of the key, the length of the value (all LEB128), the rest of the key, the value; the first
entry shares nothing.  Blocks are compressed with zstandard and end with a CRC-32.  The sparse index has each block's
last key, offset, length and entry count.  The Bloom filter has ten bits and seven probes a key.  The footer has fixed
width and ends with a magic word, so a reader starts from the file's end, bisects the index, and opens one block.
Values are token ids as little-endian unsigned integers of the width in the footer.

Writing is one range partitioning by id (rows of one id are spread by a hash and the row's place, so that no
id fills a task alone) and one pass per shard into the shared folder, under a temporary name that is renamed when
complete, so a repeated task leaves the same file.  Null text is an empty document with its end id.

:func:`lookup` sends ids to the shards whose key range holds them (one row per shard: as many as the write had
partitions, which the driver tracks one by one anyway) and opens, per id, at most the blocks that may have it.

Rows that repeat an id follow one another in any order; an empty table gives no shard.  Other columns are not looked at.
A long text is encoded in parts (see :mod:`~quern.llm.tokens`); its entry is a block of its own, held whole once.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import store, tokens
from quern.llm.arrow import column, text_slices, tidied

BLOCK = 64 << 10
#: Shards whose key ranges may be broadcast (40 bytes each); beyond it the ranges are joined without a broadcast.
RANGES = 1 << 18
BITS, PROBES = 10, 7
MAGIC = b"QSST0001"
_FOOTER = struct.Struct("<QQQQQQI8s")


def key_of(ident: int | None) -> bytes:
    return b"" if ident is None else struct.pack(">Q", (ident + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h, step = xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, seed=1) | 1
    return [(h + i * step) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.at = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.codec = zstandard.ZstdCompressor(level=1)
        self.block, self.entries, self.before = bytearray(), 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype(f"<u{self.width}").tobytes()
        if self.entries and len(self.block) + len(value) > BLOCK:
            self._end_block()
        if self.keys and key < self.before:
            raise ValueError("keys must ascend")
        same = 0
        if self.entries:
            while same < min(len(key), len(self.before)) and key[same] == self.before[same]:
                same += 1
        self.block += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        self.entries += 1
        self.before = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _end_block(self) -> None:
        body = self.codec.compress(bytes(self.block))
        self.index.append((self.before, self.at, len(body) + 4, self.entries))
        self._put(body + struct.pack("<I", zlib.crc32(body)))
        self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        if self.entries:
            self._end_block()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) + _varint(e) for k, o, n, e in self.index))
        bits = max(8, len(self.keys) * BITS)
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_probes(k, bits)] = True
        bloom_at = self.at
        self._put(np.packbits(bloom).tobytes())
        self._put(_FOOTER.pack(index_at, bloom_at, bits, self.docs, self.ids, len(self.index), self.width, MAGIC))


class Shard:
    """Reads one shard from a random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        index_at, bloom_at, self.bits, self.docs, self.ids, blocks, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at = self._read(index_at, bloom_at - index_at), 0
        self.last: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        for _ in range(blocks):
            n, at = _read_varint(raw, at)
            self.last.append(raw[at : at + n])
            o, at = _read_varint(raw, at + n)
            n, at = _read_varint(raw, at)
            e, at = _read_varint(raw, at)
            self.blocks.append((o, n, e))
        self.bloom_at = bloom_at
        self.bloom: np.ndarray | None = None
        self.codec = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        o, n, entries = self.blocks[i]
        raw = self._read(o, n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        b, at, key = self.codec.decompress(raw[:-4]), 0, b""
        for _ in range(entries):
            same, at = _read_varint(b, at)
            rest, at = _read_varint(b, at)
            size, at = _read_varint(b, at)
            key = key[:same] + b[at : at + rest]
            at += rest
            yield key, np.frombuffer(b, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_have(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = np.unpackbits(np.frombuffer(self._read(self.bloom_at, -(-self.bits // 8)), np.uint8)).astype(bool)
        return bool(self.bloom[_probes(key, self.bits)].all())

    def get(self, ident: int | None) -> list[np.ndarray]:
        """The ids of every document of that id, by Bloom filter, binary search and one block (or the next ones, for repeated ids)."""
        key, out = key_of(ident), []
        if not self.may_have(key):
            return out
        for i in range(bisect.bisect_left(self.last, key), len(self.blocks)):
            for k, ids in self.block(i):
                if k == key:
                    out.append(ids)
                elif k > key:
                    return out
        return out


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a URI; Hadoop's names of object stores are read as Arrow's."""
    return pafs.FileSystem.from_uri(re.sub(r"^(s3)[an]:", r"\1:", uri))


def write(docs: DataFrame, folder: str, tokenizer: str, ident: str = "doc_id", text: str = "text", end: int = 2, owner: str = "") -> DataFrame:
    """Writes shards into ``folder`` (a URI on a shared store) and returns (shard, path, docs, ids, first, last), shards in key order; ``first`` and ``last`` are the least and greatest key."""
    filesystem, root = open_store(folder)
    filesystem.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        context = TaskContext.get()
        shard = context.partitionId()
        path = f"{base}/shard-{shard:06d}.sst"
        part = f"{path}.{context.taskAttemptId()}.part"
        enc = tokens.encoder(tokenizer)
        writer = None
        sink = None
        for batch in batches:
            texts, names = column(batch, "text"), column(batch, "id").to_pylist()
            for lo, hi in text_slices(texts, tokens.SLICE):
                ids, at = enc.encode(texts.slice(lo, hi - lo))
                if writer is None:
                    sink = fs.open_output_stream(part)
                    writer = Writer(sink, np.dtype(enc.kind).itemsize)
                for i in range(hi - lo):
                    writer.add(key_of(names[lo + i]), np.append(ids[at[i] : at[i + 1]], enc.kind(end)))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, path, writer.docs, writer.ids, writer.keys[0], writer.keys[-1])], ["shard", "path", "docs", "ids", "first", "last"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(ident).cast("long").alias("id"), body.alias("text")).withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id()))
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_first(), "salt").sortWithinPartitions(F.col("id").asc_nulls_first(), "salt").select("id", "text")
    return store.table(ranged.mapInArrow(tidied(run, cached=True), "shard long, path string, docs long, ids long, first binary, last binary"), "shards", owner)


def scan(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the shards: start counts the ids of all documents before."""
    placed = shards.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = max(1, shards.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(folder)
        for batch in batches:
            for path, base in zip(column(batch, "path").to_pylist(), column(batch, "base").to_pylist(), strict=True):
                at, out = base, []
                with fs.open_input_file(path) as source:
                    for key, ids in Shard(source):
                        out.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("path", "base").repartition(parts).mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _key(ident: Column) -> Column:
    """:func:`key_of` as an expression: eight bytes, big-endian, with the sign bit turned; empty for null."""
    turned = F.lpad(F.hex(ident.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.coalesce(F.unhex(turned), F.unhex(F.lit("")))


def lookup(shards: DataFrame, folder: str, wanted: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(doc_id, ids: array<int>) of each document in the shards whose id is among those of ``wanted``; ids that are not there give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(folder)
        path, source, shard = None, None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for now, ident in zip(column(batch, "path").to_pylist(), column(batch, "id").to_pylist(), strict=True):
                if now != path:
                    if source:
                        source.close()
                    path, source = now, fs.open_input_file(now)
                    shard = Shard(source)
                for ids in shard.get(ident):
                    out[0].append(ident)
                    out[1].append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32()))], ["doc_id", "ids"])

    ranges = shards.select("path", "first", "last")
    if shards.count() <= RANGES:
        ranges = F.broadcast(ranges)
    asked = wanted.select(F.col(ident).cast("long").alias("id")).distinct().withColumn("key", _key(F.col("id")))
    routed = asked.join(ranges, (F.col("key") >= F.col("first")) & (F.col("key") <= F.col("last"))).select("path", "id")
    return routed.repartition("path").sortWithinPartitions("path", "id").mapInArrow(tidied(run), "doc_id long, ids array<int>")
