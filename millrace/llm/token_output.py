"""Token-ID output as bit-plane or byte-plane shuffled, zstandard-compressed chunks.

A table of this format has one row per segment. A segment holds whole documents in ascending
doc_id order; its ids are cut into fixed-size blocks, each block is transposed into planes (one per
byte or per bit of the id), every plane is compressed on its own, and the segment's header holds
the chunk index: for every block where each plane starts. Blocks can be read one at a time.

Nulls and empty texts are documents with no id but the end id. Rows with a null doc_id or with one
doc_id several times are kept as documents of their own (nulls first). An empty table makes no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import IdEncoder

MAGIC = b"MRT1"
#: Ids of a block; ids from which a segment is closed; bytes of text encoded at once.
BLOCK, SEGMENT, BATCH = 16_384, 262_144, 4 << 20
_HEAD = struct.Struct("<4sBBHIII")
_ENCODERS: dict[str, IdEncoder] = {}


def _shuffle(ids: np.ndarray, bits: bool) -> list[bytes]:
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [p.tobytes() for p in planes]
    return [np.packbits((p >> b) & 1).tobytes() for p in planes for b in range(8)]


def _unshuffle(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        a = np.frombuffer(plane, np.uint8)
        if bits:
            out[:, k // 8] |= np.unpackbits(a, count=n) << (k % 8)
        else:
            out[:, k] = a
    return out.view("<u4").ravel()


def pack(lengths: np.ndarray, ids: np.ndarray, bits: bool = False, block: int = BLOCK, level: int = 1) -> bytes:
    """A segment's bytes: header, compressed document lengths, chunk index, planes."""
    import zstandard

    put = zstandard.ZstdCompressor(level=level).compress
    lens = put(lengths.astype("<u8").tobytes())
    planes = [put(p) for i in range(0, len(ids), block) for p in _shuffle(ids[i : i + block], bits)]
    index = put(np.cumsum([0, *map(len, planes)]).astype("<u8").tobytes())
    head = _HEAD.pack(MAGIC, bits, 32 if bits else 4, 0, len(lengths), len(ids), block)
    return head + struct.pack("<II", len(lens), len(index)) + lens + index + b"".join(planes)


class Segment:
    """Reader of one segment; ``block(i)`` decodes the i-th block alone."""

    def __init__(self, data: bytes):
        import zstandard

        self.get = zstandard.ZstdDecompressor().decompress
        magic, self.bits, self.planes, _, self.n_docs, self.n_ids, self.size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of token planes")
        a, b = struct.unpack_from("<II", data, _HEAD.size)
        at = _HEAD.size + 8
        self.lengths = np.frombuffer(self.get(data[at : at + a]), "<u8").astype(np.int64) if self.n_docs else np.zeros(0, np.int64)
        self.index = np.frombuffer(self.get(data[at + a : at + a + b]), "<u8").astype(np.int64)
        self.data, self.base = data, at + a + b
        self.n_blocks = -(-self.n_ids // self.size)

    def block(self, i: int) -> np.ndarray:
        n = min(self.size, self.n_ids - i * self.size)
        cuts = self.index[i * self.planes : (i + 1) * self.planes + 1] + self.base
        return _unshuffle([self.get(self.data[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], n, bool(self.bits))

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *map(self.block, range(self.n_blocks))]).astype("<u4")


SEGMENTS = "part int, seq int, doc_ids array<long>, n_ids long, data binary"
_SEGMENTS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary())])


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = 0, bits: bool = False) -> DataFrame:
    """Segments of ``docs`` (doc_id, text) in ascending doc_id order over the rising ``part``, ``seq``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, IdEncoder(tokenizer))
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        width, held, names, size = np.dtype(enc.dtype).itemsize, [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.fromiter((len(x) // width for x in held), np.int64, len(held))
            ids = np.frombuffer(b"".join(held), enc.dtype)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "doc_ids": [names], "n_ids": [len(ids)], "data": [pack(lengths, ids, bits)]}, _SEGMENTS)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(ids), 256):
                got = enc.encode([t or "" for t in texts.slice(lo, 256).to_pylist()])
                for doc, data in zip(ids[lo : lo + 256], got, strict=True):
                    held.append(data + end)
                    names.append(doc)
                    size += len(data) // width + (end_id is not None)
                    if size >= SEGMENT:
                        yield flush()
                        held, names, size, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    n = common.buckets(docs, 64 << 20)
    return common.arrow(docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id"), run, SEGMENTS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, bits: bool = False) -> None:
    """Write the segments of ``docs`` as a table at ``path`` (any Hadoop file system; Spark's committer)."""
    encode(docs, tokenizer, end_id, bits).write.option("compression", "none").parquet(path)


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark, path: str) -> DataFrame:
    """Decode a written table: a row per document with where its ids start in the whole, how many they are and their crc32.

    A segment's start is the sum over the segments before it. Only the parts' totals (a row for
    each writing task) meet in one task; sums within a part are a window over that part's segments.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts.select("part", F.coalesce("base", F.lit(0)).alias("base")), "part").select("part", "seq", (F.col("base") + F.col("before")).alias("at"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.column("data")[i].as_py())
                ends = np.cumsum(segment.lengths)
                begins = ends - segment.lengths
                data = segment.ids().tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part")[i : i + 1].take(pa.array([0] * len(crc))), batch.column("seq")[i : i + 1].take(pa.array([0] * len(crc))), batch.column("doc_ids")[i].values, pa.array(begins), pa.array(segment.lengths), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    rows = common.arrow(segments.select("part", "seq", "doc_ids", "data"), digest, "part int, seq int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("at") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None = 0, bits: bool = False) -> DataFrame:
    """Write ``docs`` to the shared folder in this format and read the files back (see ``read``)."""
    spark = docs.sparkSession
    path = common.scratch(spark, "tokens")
    write(docs, path, tokenizer, end_id, bits)
    common.free(spark)
    return read(spark, path)
