"""A keyed table that takes upserts: parts of rows in hash buckets, folded by key when they are read or compacted.

Each upsert writes one part, folded within itself, and then a version: a small table that names, for each bucket, the parts
that count. Readers see whole versions only. ``compact`` folds the parts of buckets that have several into one;
other buckets stay as they are. How a key's rows become one is a choice: the last by an order, or
sums and minima of columns, which merge in any order.

One writer at a time. A batch that comes with a number is applied once, however often it is sent, if numbers ascend.

Handling: null keys are a key; of rows with equal key and order the greatest by their other columns stays, so that reruns agree;
an empty upsert changes nothing; columns beyond the table's are left out; a bucket may hold a hot key's rows, as they
are folded before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table, and parts of a bucket that ``compact`` leaves alone.
BUCKETS, PARTS = 64, 4
_VERSION = "bucket int, part string, buckets int, batch long"
DELETED = "deleted"


class KeyedTable:
    """``schema`` holds the key columns and all others.

    With ``order`` the last row of a key counts, and one with ``deleted`` true removes it; with ``merged``, functions by column
    (``F.sum``, ``F.min``, ``F.max``), the columns are folded by them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str] = (), merged: dict | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.merged = spark, path.rstrip("/"), list(keys), list(order), merged
        fields = StructType.fromDDL(schema)
        self.columns = list(fields.names)
        if bool(order) == bool(merged):
            raise ValueError("either an order or merged columns")
        if merged and set(self.columns) != {*keys, *merged}:
            raise ValueError("every column is a key or merged")
        self.fields = fields if merged else fields.add(DELETED, "boolean")
        held = self._version()
        self.buckets = held[0].buckets if held else buckets

    # versions -----------------------------------------------------------

    def _numbers(self) -> list[int]:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(s.getPath().getParent().getName()) for s in found)

    def _version(self) -> list:
        """Rows of the last whole version: at most ``buckets`` times the parts that a bucket gathers between two compactions."""
        numbers = self._numbers()
        return self.spark.read.schema(_VERSION).parquet(f"{self.path}/versions/{numbers[-1]}").collect() if numbers else []

    def _next(self, rows: list[tuple[int, str]], batch: int | None) -> None:
        numbers = self._numbers()
        made = self.spark.createDataFrame([(b, p, self.buckets, batch) for b, p in rows] or [(None, None, self.buckets, batch)], _VERSION)
        # a folder without _SUCCESS is what a writer left that was killed
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{numbers[-1] + 1 if numbers else 0}")

    def parts(self) -> dict[int, list[str]]:
        """The parts of each bucket."""
        out: dict[int, list[str]] = {}
        for r in self._version():
            if r.part is not None:
                out.setdefault(r.bucket, []).append(r.part)
        return out

    def batch(self) -> int | None:
        """The number of the last batch that was applied."""
        return max((r.batch for r in self._version() if r.batch is not None), default=None)

    # rows ---------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folded(self, rows: DataFrame) -> DataFrame:
        if self.merged:
            return rows.groupBy(*self.keys).agg(*(f(F.col(c)).cast(self.fields[c].dataType).alias(c) for c, f in self.merged.items())).select(*self.columns)
        rest = [c for c in self.fields.names if c not in self.keys and c not in self.order]
        return rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("_last")).select(*(F.col(c) if c in self.keys else F.col(f"_last.{c}").alias(c) for c in self.fields.names))

    def _parts(self, wanted: list[tuple[int, str]]) -> DataFrame:
        """Rows of parts of buckets; the folders are given by name, so nothing else is listed."""
        if not wanted:
            return self.spark.createDataFrame([], self.fields)
        return self.spark.read.schema(self.fields).option("basePath", f"{self.path}/parts").parquet(*(f"{self.path}/parts/part={p}/bucket={b}" for b, p in wanted)).select(*self.fields.names)

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes folded rows as a part, one file a bucket, and gives its name and its buckets."""
        numbers = self._numbers()
        part = f"{numbers[-1] + 1 if numbers else 0:010d}"
        folder = f"{self.path}/parts/part={part}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(folder)
        glob = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket=*")
        found = glob.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(glob) or []
        return part, sorted(int(s.getPath().getName().split("=")[1]) for s in found)

    def upsert(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Puts rows in; false if the batch was applied before. Fits ``foreachBatch``."""
        done = self.batch()
        if batch is not None and done is not None and batch <= done:
            return False
        if not self.merged and DELETED not in rows.columns:
            rows = rows.withColumn(DELETED, F.lit(False))
        cast = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.fields.fields))
        part, buckets = self._write(self._folded(cast))
        held = [(b, p) for b, parts in self.parts().items() for p in parts]
        self._next(held + [(b, part) for b in buckets], batch if batch is not None else done)
        return True

    def compact(self, most: int = PARTS) -> list[int]:
        """Folds the buckets of more than ``most`` parts and gives them; rows that were removed go for good."""
        held, batch = self.parts(), self.batch()
        many = sorted(b for b, parts in held.items() if len(parts) > most)
        if not many:
            return []
        rows = self._folded(self._parts([(b, p) for b in many for p in held[b]]))
        part, written = self._write(rows if self.merged else rows.where(f"not coalesce({DELETED}, false)"))
        self._next([(b, p) for b, parts in held.items() if b not in many for p in parts] + [(b, part) for b in written], batch)
        return many

    def read(self) -> DataFrame:
        """One row a key, as of the last version now. A bucket of one part is folded as it is."""
        held = self.parts()
        once, more = ([(b, p) for b, parts in held.items() for p in parts if (len(parts) == 1) == one] for one in (True, False))
        rows = self._parts(once)
        if more:
            rows = self._folded(self._parts(more)).unionByName(rows) if once else self._folded(self._parts(more))
        return rows.select(*self.columns) if self.merged else rows.where(f"not coalesce({DELETED}, false)").select(*self.columns)

    def sweep(self) -> list[str]:
        """Deletes parts that the last version doesn't name, and older versions; gives the parts. For when nobody reads those."""
        used, numbers = {p for parts in self.parts().values() for p in parts}, self._numbers()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(path(f"{self.path}/parts/part=*")) or []
        gone = sorted(n for n in (s.getPath().getName().split("=")[1] for s in found) if n not in used)
        for name in gone:
            fs.delete(path(f"{self.path}/parts/part={name}"), True)
        for n in numbers[:-1]:
            fs.delete(path(f"{self.path}/versions/{n}"), True)
        return gone
