"""Token ids in files of fixed-width bits, and back.

An image holds one segment of ids: a header, the byte offsets of its blocks, and the blocks, in which each id takes as many
bits as the largest id of the vocabulary needs. A full block has BLOCK ids, a multiple of 8, so blocks begin at bytes; any
run of ids is read by unpacking only the blocks it touches, and numpy unpacks these at once.

    magic "TIDS", version, bits, 2 bytes unused, ids, ids in a full block, blocks (little-endian, 32 bits each)
    blocks + 1 byte offsets (32 bits each), the last being the end
    the blocks: ids with the most significant bit first

A token file is a folder. segments/ has one row for each image with what lies in it, in ascending order of doc_id by
(shard, segment); a shard is what one task wrote. shards/ has the number of ids before each shard. A segment holds whole
documents, or one piece of a document of more than SEGMENT ids. Spark's writer commits the files, so a task that is
repeated after the loss of an executor leaves nothing double.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandgraph.llm import common
from strandgraph.llm.bytebpe import ByteBpe
from strandgraph.storage import fresh

END_ID, SEGMENT, BLOCK = 0, 65_536, 4096
HEADER, MAGIC, VERSION = struct.Struct("<4sBBHIII"), b"TIDS", 1
WHOLE = "doc_id long, start long, n_tokens long, ids binary"


def id_bits(tokenizer: str) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """The image of ids; an id that needs more bits is an error."""
    if block % 8 or not 0 < bits <= 32:
        raise ValueError("block must be a multiple of 8, bits lie in 1..32")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} needs more than {bits} bits")
    blocks = -(-len(ids) // block)
    ends = np.minimum(np.arange(blocks + 1, dtype=np.int64) * block, len(ids))
    offsets = HEADER.size + 4 * (blocks + 1) + (ends * bits + 7) // 8
    single = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return HEADER.pack(MAGIC, VERSION, bits, 0, len(ids), block, blocks) + offsets.astype("<u4").tobytes() + np.packbits(single).tobytes()


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first to last - 1 of an image (all by default) as unsigned 32-bit numbers; other blocks aren't touched."""
    magic, version, bits, _, n, block, blocks = HEADER.unpack_from(image)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not an image of token ids")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, "<u4")
    low, high = first // block, -(-last // block)
    offsets = np.frombuffer(image, "<u4", blocks + 1, HEADER.size)
    count = min(high * block, n) - low * block
    single = np.unpackbits(np.frombuffer(image, np.uint8, int(offsets[high] - offsets[low]), int(offsets[low])), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = single
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")[first - low * block : last - low * block]


class Segments:
    """Cuts a stream of documents into segments; rows() gives those that are full."""

    def __init__(self, shard: int, bits: int, segment: int = SEGMENT, block: int = BLOCK):
        self.shard, self.bits, self.segment, self.block = shard, bits, segment, block
        self.first = self.number = 0  # of the open segment
        self.open: list[tuple] = []  # (doc_id, ids)
        self.size = 0
        self.done: list[dict] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        if self.size + len(ids) > self.segment:
            self.close()
        if len(ids) <= self.segment:
            self.open.append((doc_id, ids))
            self.size += len(ids)
            return
        for at in range(0, len(ids), self.segment):
            piece = ids[at : at + self.segment]
            self._emit(piece, [doc_id], [at], [len(piece)], [len(ids)], True)

    def close(self) -> None:
        if self.open:
            lengths = [len(x) for _, x in self.open]
            self._emit(np.concatenate([x for _, x in self.open]), [d for d, _ in self.open], [0] * len(lengths), lengths, lengths, False)
            self.open, self.size = [], 0

    def _emit(self, ids: np.ndarray, docs: list, offsets: list[int], lengths: list[int], tokens: list[int], split: bool) -> None:
        row = {"shard": self.shard, "segment": self.number, "first": self.first, "n_ids": len(ids), "split": split}
        self.done.append(row | {"doc_ids": docs, "doc_offsets": offsets, "lengths": lengths, "doc_tokens": tokens, "image": pack(ids, self.bits, self.block)})
        self.first, self.number = self.first + len(ids), self.number + 1

    def rows(self) -> list[dict]:
        done, self.done = self.done, []
        return done


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, bits: int | None = None, segment: int = SEGMENT, block: int = BLOCK) -> None:
    """Encodes docs (doc_id, text), ends each document with end_id, and writes a token file in ascending order of doc_id.

    A null text is empty; null ids come first; rows of one id come in order of a hash of their texts. Texts are shuffled
    once, by ranges, and every task encodes, packs and writes what it has sorted; its memory holds one segment and one
    document, however long the partition. Other columns are ignored; an empty table gives an empty file. path must be new.
    """
    bits = bits or id_bits(tokenizer)
    text = F.coalesce("text", F.lit(""))
    keys = ["doc_id", "_h", "_m"]
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_m"))
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("split", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("doc_tokens", pa.list_(pa.int64())), ("image", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBpe.load(tokenizer), np.uint32(end_id).tobytes()
        out = Segments(TaskContext.get().partitionId(), bits, segment, block)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.strings(batch.column(1)), strict=True):
                out.add(doc_id, np.frombuffer(bpe.encode(text) + end, "<u4"))
                if len(out.done) > 8:
                    yield pa.RecordBatch.from_pylist(out.rows(), schema=schema)
        out.close()
        yield pa.RecordBatch.from_pylist(out.rows(), schema=schema)

    ddl = "shard int, segment int, first long, n_ids int, split boolean, doc_ids array<long>, doc_offsets array<long>, lengths array<int>, doc_tokens array<long>, image binary"
    common.map_batches(dealt, run, ddl).write.parquet(f"{path}/segments")
    spark = docs.sparkSession
    sizes = spark.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    sizes.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with base, the number of ids before their shard."""
    shards = spark.read.parquet(f"{path}/shards").select("shard", "base")
    return spark.read.parquet(f"{path}/segments").join(F.broadcast(shards), "shard")  # one row for each task that wrote


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a token file: ids as little-endian unsigned 32-bit numbers.

    start counts the ids of all documents before. Documents within a segment are read where it lies; pieces of longer
    ones are put together by a shuffle of these alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = unpack(row["image"]), np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"] + row["first"] - np.array(row["doc_offsets"])), pa.array(row["doc_tokens"], pa.int64()), pa.array(row["doc_offsets"], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "offset", "ids"])

    columns = ["base", "first", "doc_ids", "doc_offsets", "lengths", "doc_tokens", "image"]
    pieces = lambda which: common.map_batches(_segments(spark, path).where(which).select(*columns), run, WHOLE.replace("ids binary", "offset long, ids binary"))
    whole = pieces("NOT split").drop("offset")
    joined = pieces("split").groupBy("start", "doc_id", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = joined.select("doc_id", "start", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return whole.unionByName(joined)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(at, ids) of the ids first to last - 1 of the file, at their places, segment by segment: only blocks they lie in are unpacked."""
    touched = _segments(spark, path).withColumn("at", F.col("base") + F.col("first")).where((F.col("at") < last) & (F.col("at") + F.col("n_ids") > first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = max(first - at, 0)
                yield pa.RecordBatch.from_pylist([{"at": at + low, "ids": unpack(image, low, last - at).tobytes()}], schema=pa.schema([("at", pa.int64()), ("ids", pa.binary())]))

    return common.map_batches(touched.select("at", "image"), run, "at long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh(spark, "token-file")
    write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
