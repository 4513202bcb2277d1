"""Packing token sequences into windows of fixed capacity by best-fit decreasing.

Every document becomes its token ids and one end id. Documents longer than a window are first cut into full windows;
the remainders are packed by best-fit decreasing, where a segment tree indexed by remaining capacity finds the tightest
open window. Windows that are still not full are then topped up with pieces cut from the emptiest windows, and the last
one is cut into sequences whose lengths are powers of two, which need no padding.

Each Spark partition packs its own documents while it tokenises them, so nothing is shuffled; remainders are packed in
blocks of BLOCK documents, which bounds the memory of a task whatever the size of a partition. A task that is run again
after the loss of an executor gives the same windows, because the order of the rows in a partition decides them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from strandgraph.llm import common
from strandgraph.llm.bytebpe import ByteBpe

CAPACITY, END_ID, BLOCK = 1024, 0, 65_536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Which remaining capacities open windows have: a segment tree over 0..capacity, of counts."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.width
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with room for length, taken out; None if there is none."""
        count, i = self.count, length + self.width
        while not count[i]:
            while i & 1:  # a right child: its parent has nothing more to the right
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.width:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.width
        window = self.open[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows as lists of indices into lengths (each at most capacity), longest first, ties in the given order."""
    tree, windows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found:
            room, w = found
            windows[w].append(i)
        else:
            room, w = capacity, len(windows)
            windows.append([i])
        if room > lengths[i]:
            tree.add(room - lengths[i], w)
    return windows


def top_up(windows: list[list[tuple[int, int, int]]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length) without padding: full ones and lengths that are powers of two.

    The fullest windows are topped up with what the emptiest hold; a piece that doesn't fit is cut.
    """
    used = [sum(n for *_, n in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda w: -used[w])
    low, high = 0, len(order) - 1
    while low < high:
        to, giver = windows[order[low]], windows[order[high]]
        room = capacity - used[order[low]]
        while room and giver:
            d, s, n = giver.pop()
            if n > room:
                giver.append((d, s + room, n - room))
                n = room
            to.append((d, s, n))
            room -= n
            used[order[low]] += n
            used[order[high]] -= n
        low += not room
        high -= not giver
    out = [w for w in windows if sum(n for *_, n in w) == capacity]
    for w in windows:
        total = sum(n for *_, n in w)
        if 0 < total < capacity:
            for bit in reversed(range(total.bit_length())):
                if total >> bit & 1:
                    room, part = 1 << bit, []
                    while room:
                        d, s, n = w.pop()
                        if n > room:
                            w.append((d, s + room, n - room))
                            n = room
                        part.append((d, s, n))
                        room -= n
                    out.append(part)
    return out


class Packer:
    """Packs documents as they come; rows() gives the pieces decided so far."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, block: int = BLOCK):
        self.next, self.capacity, self.block = first_sequence, capacity, block
        self.rows: list[tuple] = []
        self.tails: list[tuple[int, int, int, bytes]] = []  # document, tokens, start, ids from start on

    def add(self, doc_id: int, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.capacity
        full = total // self.capacity
        for k in range(full):
            self.rows.append((doc_id, k * self.capacity, self.capacity, zlib.crc32(ids[k * width : (k + 1) * width]), total, self.next, 0))
            self.next += 1
        if total > full * self.capacity:
            self.tails.append((doc_id, total, full * self.capacity, ids[full * width :]))
        if len(self.tails) >= self.block:
            self.flush()

    def flush(self) -> None:
        tails, self.tails = self.tails, []
        packed = best_fit_decreasing([len(t[3]) // 4 for t in tails], self.capacity)
        for window in top_up([[(i, 0, len(tails[i][3]) // 4) for i in w] for w in packed], self.capacity):
            offset = 0
            for i, s, n in window:
                doc_id, total, start, ids = tails[i]
                self.rows.append((doc_id, start + s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), total, self.next, offset))
                offset += n
            self.next += 1

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents (doc_id, text) in windows of at most capacity tokens.

    A null text counts as empty and gives the end id alone; repeated doc_ids are packed row by row; an empty table gives
    no rows; other columns are ignored. sequence_id holds the partition's number in its upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBpe.load(tokenizer), np.uint32(end_id).tobytes()
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, block)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.strings(batch.column(1)), strict=True):
                packer.add(doc_id, bpe.encode(text) + end)
            yield from _batches(packer.drain())
        packer.flush()
        yield from _batches(packer.drain())

    return common.map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([0 if v is None and i else v for v in c], pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
