"""Shared helpers of the training-data operators: scratch tables, word hashing, components.

Everything that has to outlive a stage goes to the folder named by ``spark.checkpoint.dir``
(through Spark's own writers, so any Hadoop file system works); only when that setting is absent and
the master is a single local JVM, as in tests, a folder of our own is used.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLE: np.ndarray | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder; removed when the driver's JVM exits."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors,
    and lets Spark drop the shuffle files that made it."""
    spark = df.sparkSession
    path, schema = scratch(spark, name), df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    free(spark)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``save`` that nothing lazy refers to any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy() -> None:
    """Give a worker's free memory back to the system, as workers live on after their task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(fn, schema)``; the worker is tidied up after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


def free(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of plans that nobody refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns of a table; others, whatever they are called, are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for scans); used only to size partitions."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def buckets(df: DataFrame, each: int = 8 << 20) -> int:
    """A number of partitions for what is derived from ``df``: the session's, or more for large input."""
    return int(min((1 << 31) - 1, max(partitions(df.sparkSession), input_bytes(df) // each if input_bytes(df) < 1 << 60 else 0)))


class Packer:
    """Collects records in a task and hands them out as one blob per bucket, so that millions of small
    records cross the shuffle as few rows. A record's bucket comes of its first field, a 64-bit hash,
    or of the hash of its document (field doc), as ``doc_bucket`` gives it."""

    SCHEMA = "bucket int, data binary"

    def __init__(self, dtype: np.dtype, n_buckets: int, most: int = 16 << 20):
        self.dtype, self.n, self.most, self.held, self.size = dtype, n_buckets, most, [], 0
        self.by_doc = dtype.names[0] == "doc"

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = np.empty(len(columns[0]), self.dtype)
        for name, column in zip(self.dtype.names, columns, strict=True):
            records[name] = column
        self.held.append(records)
        self.size += records.nbytes
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        import zstandard

        records = np.concatenate([np.zeros(0, self.dtype), *self.held])
        self.held, self.size = [], 0
        if not len(records):
            return
        bucket = long_hashes(records["doc"]) % self.n if self.by_doc else records[self.dtype.names[0]] % U64(self.n)
        bucket = bucket.astype(np.uint16 if self.n <= 65_536 else np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        put = zstandard.ZstdCompressor(level=1).compress
        names, blobs = bucket[starts].tolist(), []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
            part = records[order[a:b]]
            # byte planes: ids and places, which rise slowly, shrink; hashes stay as they are
            blobs.append(put(np.ascontiguousarray(part.view(np.uint8).reshape(len(part), -1).T).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])


def unpack(df: DataFrame, dtype: np.dtype, fn, schema: str, n_buckets: int) -> DataFrame:
    """``fn(records)`` over all records of each of ``n_buckets`` buckets of packed blobs; it yields record batches of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for name, blob in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if name != now and held:
                    yield from fn(decoded(held, dtype))
                    held = []
                now = name
                held.append(blob)
        if held:
            yield from fn(decoded(held, dtype))

    return arrow(df.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket"), run, schema)


def decoded(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    """The records of some blobs."""
    import zstandard

    get, width = zstandard.ZstdDecompressor().decompress, dtype.itemsize
    parts = [np.ascontiguousarray(np.frombuffer(get(b), np.uint8).reshape(width, -1).T).view(dtype).ravel() for b in blobs]
    return np.concatenate([np.zeros(0, dtype), *parts])


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def long_hashes(x: np.ndarray) -> np.ndarray:
    """What ``F.xxhash64`` gives for a long column (XXH64 of eight bytes, seed 42)."""
    p1, p2, p3, p4, p5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (U64(42) + p5 + U64(8)) ^ (rotated(x.astype(np.int64).view(U64) * p2, 31) * p1)
        h = rotated(h, 27) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
        return (h ^ (h >> U64(32))).view(np.int64)


def doc_bucket(doc: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(n)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hash_table() -> np.ndarray:
    """64 positions x 256 bytes of fixed pseudo-random 64-bit words (tabulation hashing)."""
    global _TABLE
    if _TABLE is None:
        _TABLE = mix((np.arange(64 * 256, dtype=U64) + U64(1)) * _MULT)
    return _TABLE


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(docs: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the whitespace-separated words of each document, one flat array, and the
    offsets at which each document's words begin (one more offset than documents)."""
    lens = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    a = np.frombuffer(b" ".join(docs) + b" ", np.uint8) if docs else np.zeros(0, np.uint8)
    if lower:
        a = _LOWER[a]
    word = ~_SPACE[a]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)]))
    if not len(starts):
        return np.zeros(0, U64), at
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    value = hash_table()[((inside & 63) << 8) | a[word]]
    if size.max() > 64:
        far = np.flatnonzero(inside > 63)
        value[far] = mix(value[far] + (inside[far] >> 6).astype(U64) * _MULT)
    return mix(np.add.reduceat(value, first)), at


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols that start at each place (polynomial, mixed); the last k-1 places fall away."""
    if len(symbols) < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        power, width, have, shift = symbols, 1, None, 0
        out, done, factor = None, 0, _MULT
        rest = k
        while rest:
            if rest & 1:
                n = len(symbols) - k + 1
                piece = power[done : done + n]
                out = piece.copy() if out is None else out * factor + piece
                done += width
            rest >>= 1
            if rest:
                power = power[:-width] * factor + power[width:]
                width *= 2
                factor = factor * factor
        return mix(out)


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with the bytes of its column text (null: empty), so that no whole batch is held as Python values."""
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        yield part, [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def sliced(texts: Iterable[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``size`` bytes together (one text at least)."""
    start = total = n = 0
    for n, text in enumerate(texts, 1):
        total += len(text)
        if total >= size:
            yield start, n
            start, total = n, 0
    if start < n:
        yield start, n


def connected(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has long columns a, b. Returns (id, component) for every id on an edge, component
    being the smallest id reachable. Each step is two aggregations over the edge table, which is
    written to the shared folder; nothing is collected.
    """
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = pairs.join(low, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    seen = None
    for _ in range(most):
        edges = save(star(star(edges, True), False), name)
        # a forest of stars in which nothing moves any more has the same number of edges and the same checksum
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    ).distinct()
