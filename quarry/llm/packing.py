"""Sum-of-squares online packing into windows of fixed size.

Documents are cut into full windows and a rest shorter than a window. Each rest goes, as it comes,
to the fill level that leaves the sum of squared counts of partially filled windows smallest; a level
array holds these counts. Beyond ``MOST_OPEN`` open windows the fullest are filled up with pieces cut
from the emptiest until half as many are open, so what a task holds is bounded. When a partition ends,
all its open windows are closed so, and the one that stays partial is cut into windows of powers of
two, which need no padding.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, table, text_or_empty
from quarry.llm.encoding import encoder

#: Windows that a task keeps open at most.
MOST_OPEN = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs pieces (doc, start, ids) of one partition; ``closed`` gets windows as lists of pieces."""

    def __init__(self, size: int, most_open: int = MOST_OPEN) -> None:
        self.size, self.most_open, self.n_open = size, most_open, 0
        self.counts = np.zeros(size + 1, np.int64)  # open windows at each fill level; 0 and size stay 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(size)]
        self.closed: list[list[tuple]] = []

    def add(self, doc: tuple, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit; ``doc``: what identifies the document."""
        n, size = len(ids) // 4, self.size
        full = n - n % size
        for at in range(0, full, size):
            self.closed.append([(doc, at, ids[4 * at : 4 * (at + size)])])
        if full < n:
            self._place((doc, full, ids[4 * full :]))
            if self.n_open > self.most_open:
                self._close(self.most_open // 2)

    def _place(self, piece: tuple) -> None:
        n, size, c = len(piece[2]) // 4, self.size, self.counts
        # Moving a window from level h to h + n changes the sum of squares by 2 * (c[h + n] - c[h]) and a constant.
        change = c[n : size + 1] - c[: size - n + 1]
        usable = c[: size - n + 1] > 0
        usable[0] = True
        cost = np.where(usable, 2 * change + 2, np.iinfo(np.int64).max)
        cost[0] -= 1  # opening removes no window from a level
        if usable[-1]:
            cost[-1] -= 1  # filling adds none
        h = int(len(cost) - 1 - np.argmin(cost[::-1]))  # ties to the fullest
        window = self.open[h].pop() if h else []
        window.append(piece)
        if h:
            c[h] -= 1
            self.n_open -= 1
        if h + n == size:
            self.closed.append(window)
        else:
            c[h + n] += 1
            self.n_open += 1
            self.open[h + n].append(window)

    def _close(self, leave: int) -> None:
        """Fills up the fullest windows from the emptiest, until ``leave`` or one is open."""
        rest = [w for level in self.open for w in level]  # emptiest first
        k = 0
        while k < len(rest) - max(1, leave):
            fullest = rest.pop()
            room = self.size - sum(len(p[2]) // 4 for p in fullest)
            while room and k < len(rest):
                doc, start, ids = rest[k].pop()
                n = min(room, len(ids) // 4)
                if 4 * n < len(ids):  # the end of the piece moves
                    keep = len(ids) // 4 - n
                    rest[k].append((doc, start, ids[: 4 * keep]))
                    doc, start, ids = doc, start + keep, ids[4 * keep :]
                fullest.append((doc, start, ids))
                room -= n
                if not rest[k]:
                    k += 1
            if room:
                rest.append(fullest)
                break
            self.closed.append(fullest)
        self.open = [[] for _ in range(self.size)]
        for window in rest[k:]:
            self.open[sum(len(p[2]) // 4 for p in window)].append(window)
        self.counts[: self.size] = [len(level) for level in self.open]
        self.n_open = len(rest) - k

    def finish(self) -> None:
        """Closes all open windows, without padding."""
        self._close(0)
        for level in self.open:
            for window in level:
                self._in_powers(window)

    def _in_powers(self, window: list[tuple]) -> None:
        left = sum(len(p[2]) // 4 for p in window)
        pieces = window[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            part = []
            while room:
                doc, start, ids = pieces.pop()
                n = min(room, len(ids) // 4)
                part.append((doc, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    pieces.append((doc, start + n, ids[4 * n :]))
                room -= n
            self.closed.append(part)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int | None = 0) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text; other columns are ignored) into sequences of ``size`` tokens.

    One row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id and offset (gapless from 0 in its sequence). Null texts are empty; each document ends
    with ``end_id``. Rows are packed one by one, repeated or not; null doc_id stays null. Each task
    packs what it reads, without a shuffle; it leaves at most log2(size) sequences short, at powers of
    two. A sequence's id is its task's partition and its number there, the same if the task is repeated.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def batch(packer: Packer, made: int, first: int) -> tuple[pa.RecordBatch, int]:
        rows = []
        for window in packer.closed:
            offset = 0
            for (doc_id, tokens), start, ids in window:
                n = len(ids) // 4
                rows.append((doc_id, start, n, zlib.crc32(ids), tokens, first + made, offset))
                offset += n
            made += 1
        packer.closed.clear()
        cols = list(zip(*rows, strict=True)) or [()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names), made

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, made, e = Packer(size), 0, encoder(tokenizer)
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), e.packed_arrow(b.column(1)), strict=True):
                packer.add((doc_id, (len(ids) + len(end)) // 4), ids + end)
                if len(packer.closed) >= 4096:
                    out, made = batch(packer, made, first)
                    yield out
        packer.finish()
        yield batch(packer, made, first)[0]

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), pack, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
