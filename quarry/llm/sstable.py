"""Sorted-string-table shards of token ids.

A file holds documents in ascending order of their key. Layout:

* data blocks, each compressed on its own. An entry is ``shared, rest, size`` (varints), the rest of
  the key after the ``shared`` bytes it has in common with the key before, and the value;
* the sparse index: for each block its first key (prefix-compressed), offset, stored size and entries;
* a Bloom filter of all keys;
* a footer of fixed size: offsets and sizes of index and filter, counts of entries and tokens, magic.

A key is a byte 1 and the document's id, big-endian with the sign bit flipped, so that bytes sort as
ids do; null is a single byte 0 and comes first. A value is the width of an id in bytes (2 or 4) and
the ids, little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, shared_dir, stored, table, text_or_empty
from quarry.llm.encoding import encoder

MAGIC = b"QSSTBL01"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES, FILE_BYTES = 1 << 16, 1 << 26
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    pairs = np.array([(x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF | 1) for x in map(xxhash.xxh3_64_intdigest, keys)], np.uint64).reshape(-1, 2)
    return ((pairs[:, :1] + pairs[:, 1:] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class Writer:
    """Writes entries, given in ascending order of their keys, to an open binary stream."""

    def __init__(self, out) -> None:
        self.out, self.at, self.tokens = out, 0, 0
        self.block, self.last, self.in_block = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.in_block:
            self.first, self.last = key, b""
        a = np.frombuffer(ids, "<u4")
        value = b"\2" + a.astype("<u2").tobytes() if not len(a) or a.max() < 1 << 16 else b"\4" + ids
        n = shared_prefix(self.last, key)
        self.block += varint(n) + varint(len(key) - n) + varint(len(value)) + key[n:] + value
        self.last, self.in_block, self.tokens = key, self.in_block + 1, self.tokens + len(a)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, b: bytes) -> tuple[int, int]:
        self.out.write(b)
        self.at += len(b)
        return self.at - len(b), len(b)

    def _flush(self) -> None:
        if self.in_block:
            self.index.append((self.first, *self._write(self.pack.compress(bytes(self.block))), self.in_block))
            self.block, self.in_block = bytearray(), 0

    def close(self) -> tuple[int, int]:
        """Writes index, filter and footer; entries and tokens of the file."""
        self._flush()
        index, last = bytearray(), b""
        for key, offset, size, entries in self.index:
            n = shared_prefix(last, key)
            index += varint(n) + varint(len(key) - n) + key[n:] + varint(offset) + varint(size) + varint(entries)
            last = key
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, np.uint8)
        if self.keys:
            bloom[_bloom_places(self.keys, bits).ravel()] = 1
        at_index, at_bloom = self._write(bytes(index)), self._write(np.packbits(bloom, bitorder="little").tobytes())
        self._write(FOOTER.pack(*at_index, *at_bloom, len(self.keys), self.tokens, MAGIC))
        return len(self.keys), self.tokens


class Reader:
    """Reads a table from a seekable binary stream of ``size`` bytes."""

    def __init__(self, f, size: int) -> None:
        self.f = f
        f.seek(size - FOOTER.size)
        at_index, n_index, self.at_bloom, self.n_bloom, self.entries, self.tokens, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of this format")
        f.seek(at_index)
        raw, at, last = f.read(n_index), 0, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        while at < len(raw):
            n, at = read_varint(raw, at)
            m, at = read_varint(raw, at)
            last = last[:n] + raw[at : at + m]
            at += m
            offset, at = read_varint(raw, at)
            stored_size, at = read_varint(raw, at)
            entries, at = read_varint(raw, at)
            self.index.append((last, offset, stored_size, entries))
        self.bloom: np.ndarray | None = None
        self.unpack = zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, size, _ = self.index[k]
        self.f.seek(offset)
        raw, at, key = self.unpack.decompress(self.f.read(size)), 0, b""
        while at < len(raw):
            n, at = read_varint(raw, at)
            m, at = read_varint(raw, at)
            v, at = read_varint(raw, at)
            key = key[:n] + raw[at : at + m]
            at += m
            yield key, np.frombuffer(raw, "<u2" if raw[at] == 2 else "<u4", (v - 1) // raw[at], at + 1)
            at += v

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The values of a document: filter, binary search in the index, then its blocks."""
        key = key_of(doc_id)
        if self.bloom is None:
            self.f.seek(self.at_bloom)
            self.bloom = np.frombuffer(self.f.read(self.n_bloom), np.uint8)
        bits = max(64, self.entries * BLOOM_BITS)
        places = _bloom_places([key], bits)[0]
        if not ((self.bloom[places >> 3] >> (places & 7)) & 1).all():
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block whose first key isn't below the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        found = []
        for k in range(max(0, lo - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [v for x, v in self.block(k) if x == key]
        return found


def write_tables(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes every row of ``docs`` (doc_id, text; other columns are ignored) into table files below ``path``.

    Rows are ordered by doc_id (null first; repeated ids in order of their texts' hashes), null texts
    count as empty, ``end_id`` closes each document. Returns the manifest: file, part and nth, which
    order the files, entries and tokens. A task writes under a name of its own and only tasks that
    succeed put their files into the manifest, so lost or repeated tasks leave it right.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task, e = TaskContext.get(), encoder(tokenizer)
        made: list[tuple] = []
        writer = out = None

        def close() -> None:
            entries, tokens = writer.close()
            out.close()
            made.append((name, task.partitionId(), len(made), entries, tokens))

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), e.packed_arrow(b.column(1)), strict=True):
                if writer is None:
                    name = f"{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.sst"
                    writer = Writer(out := fs.open_output_stream(f"{root}/{name}", compression=None))
                writer.add(key_of(doc_id), ids + end)
                if writer.at >= file_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        for row in made:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "part", "nth", "entries", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return stored(map_arrow(ordered, write, "file string, part long, nth long, entries long, tokens long"))


def read_tables(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, read from the files."""
    before = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    for key, ids in Reader(f, f.size()):
                        rows.append((id_of(key), base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(files.repartition(tasks, "file"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded, written to table files and read back."""
    import public_tokenizers

    path = shared_dir(spark)
    manifest = write_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_tables(manifest, path)
