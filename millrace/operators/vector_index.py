"""An index of vectors in inverted lists: written once, searched in few of them, exact where asked.

``build`` fits centroids on a bounded sample (``SAMPLE`` vectors a list by hash of the id, k-means
on the driver) and assigns every row to its nearest centroid. A list is a folder of the table; its
rows are packed into blocks of at most ``BLOCK`` vectors, which several tasks write, so that a list
with a third of all rows is no single group. Each list's greatest distance from its centroid is kept.

How many lists a search looks into is measured on the sample as well.

``search`` takes the queries to their nearest lists, query blocks to vector blocks, and ranks by
exact distances: first to ``FIRST`` lists, then to the others, of which the distance of the k-th best
so far excludes some by the triangle inequality, and from which no farther vector is handed on. With
``exact`` no list goes unread that isn't excluded: the result is that of a search of all rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared, sinks

#: Sampled vectors for each list, most lists, rounds of k-means, vectors of a block, queries of a block.
SAMPLE, LISTS, ROUNDS, BLOCK, QUERIES = 64, 4_096, 10, 4_096, 256
#: Lists that a search looks into before it knows how near a k-th best is.
FIRST = 4
#: The share of near vectors that a search is to find.
SHARE = 0.95


def _matrix(lists, dim: int):
    """The rows of a list array as a matrix of doubles, and which of them are whole."""
    import numpy as np
    import pyarrow.compute as pc

    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False).to_numpy(zero_copy_only=False)
    out = np.full((len(lists), dim), np.nan)
    out[fits] = pc.list_flatten(lists.filter(pc.equal(pc.list_value_length(lists), dim))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return out, np.isfinite(out).all(1)


def _squares(a, b):
    """Squared distances by products, never negative."""
    import numpy as np

    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0.0)


def centroids(points, n: int, rounds: int = ROUNDS):
    """k-means of a sample from evenly spaced rows of it; empty lists stay where they are."""
    import numpy as np

    unique = np.unique(points, axis=0)
    centres = unique[np.linspace(0, len(unique) - 1, min(n, len(unique))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([_squares(points[i : i + 8_192], centres).argmin(1) for i in range(0, len(points), 8_192)])
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def enough(points, centres, k: int = 20, asked: int = 512) -> int:
    """So many lists hold ``SHARE`` of the k nearest in the sample of some of its vectors; those among all rows are nearer, and so in lists no farther."""
    import numpy as np

    queries = points[np.linspace(0, len(points) - 1, min(asked, len(points))).astype(int)]
    near = np.argsort(_squares(queries, points), axis=1, kind="stable")[:, 1 : k + 1]
    own = np.concatenate([_squares(points[i : i + 8_192], centres).argmin(1) for i in range(0, len(points), 8_192)])
    rank = np.argsort(np.argsort(_squares(queries, centres), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(SHARE * len(ranks)))]) + 1 if len(ranks) else len(centres)


def _packed(batches: Iterator, size: int) -> Iterator:
    """Rows (list, id, point, label), sorted by list, as blocks of at most ``size`` of one list."""
    import numpy as np
    import pyarrow as pa

    held, n, now = [], 0, None

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        points = np.ascontiguousarray(table["point"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8"))
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), one(table["id"].combine_chunks()), one(table["label"].combine_chunks()), pa.array([points.tobytes()], pa.binary())], names=["list", "ids", "labels", "data"])

    for batch in batches:
        lists = batch.column(0).to_numpy()
        ends = np.append(np.flatnonzero(lists[1:] != lists[:-1]) + 1, len(lists))
        lo = 0
        for end in ends.tolist() if len(lists) else []:
            while lo < end:
                if n and (lists[lo] != now or n == size):
                    yield flush()
                    held, n = [], 0
                now, take = int(lists[lo]), min(end - lo, size - n)
                held.append(batch.slice(lo, take))
                lo, n = lo + take, n + take
    if n:
        yield flush()


def _products(batches: Iterator, dim: int, k: int) -> Iterator:
    """The k nearest vectors of the block for each query of the query block, of each row; none beyond what the query has k of."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            names, labels = batch.column(0)[i].values, batch.column(1)[i].values
            asked = batch.column(3)[i].values.to_numpy()
            points, queries = (np.frombuffer(batch.column(c)[i].as_py(), "<f8").reshape(-1, dim) for c in (2, 4))
            vec = names.to_numpy()
            far = _squares(queries, points)
            far[asked[:, None] == vec] = np.inf
            bound = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(far), np.inf)
            bound = np.minimum(bound, batch.column(5)[i].values.to_numpy())
            slack = 1e-8 + 1e-12 * ((queries * queries).sum(1) + (points * points).sum(1).max())
            q, r = np.nonzero((far <= (bound + slack)[:, None]) & (far < np.inf))
            dist = np.round(((points[r] - queries[q]) ** 2).sum(1), 9)
            order = np.lexsort((vec[r], dist, q))
            q, r, dist = q[order], r[order], dist[order]
            near = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays([pa.array(asked[q[near]]), pa.array(vec[r[near]]), labels.take(pa.array(r[near])), pa.array(dist[near])], names=["query_id", "vec_id", "label", "dist"])


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        import numpy as np

        self.spark, self.path = spark, path
        size = json.loads(spark.read.text(f"{path}/size").first().value)
        self.dim, self.probes, self.label = size["dim"], size["probes"], size["label"]
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most LISTS
        self.centres, self.radius = np.array([r.centre for r in rows]), np.array([r.radius for r in rows])
        self.blocks = spark.read.schema(f"ids array<long>, labels array<{self.label}>, data binary, list int").parquet(f"{path}/blocks")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """Index (vec_id, embedding, label). Rows without an id, or whose vector isn't whole or not of the greatest length, have no distance and are left out.
        About the root of the number of rows is the number of lists, unless one is given; ``LISTS`` at most."""
        import numpy as np
        import pyarrow as pa

        spark = vectors.sparkSession
        wide = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        dim, label = max(1, wide.dim or 1), vectors.schema["label"].dataType.simpleString()
        n_lists = min(LISTS, max(1, lists or math.isqrt(wide.n)))
        rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("point"), "label")
        share = min(1.0, SAMPLE * n_lists / max(1, wide.n))
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40) < share).select("point").toArrow()["point"].combine_chunks()
        points, whole = _matrix(sample, dim)
        points = points[whole]
        if not len(points):  # a small table whose sample is empty
            points, whole = _matrix(rows.select("point").limit(SAMPLE * n_lists).toArrow()["point"].combine_chunks(), dim)
            points = points[whole]
        centres = centroids(points, n_lists) if len(points) else np.zeros((1, dim))
        sent = spark.sparkContext.broadcast(centres)

        def assign(batches):
            for whole_batch in batches:
                for lo in range(0, whole_batch.num_rows, 4_096):
                    batch = whole_batch.slice(lo, 4_096)
                    x, ok = _matrix(batch.column(1), dim)
                    batch, x = batch.filter(pa.array(ok, pa.bool_())), x[ok]
                    far = _squares(x, sent.value)
                    own = far.argmin(1)
                    away = np.sqrt(((x - sent.value[own]) ** 2).sum(1))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), flat, batch.column(2), pa.array(away)], names=["list", "id", "point", "label", "away"])

        found = shared.saved(rows.mapInArrow(assign, f"list int, id long, point array<double>, label {label}, away double"), "assigned")
        spread = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
        dealt = found.drop("away").repartition("list", spread).sortWithinPartitions("list")
        blocks = dealt.mapInArrow(lambda b: _packed(b, BLOCK), f"list int, ids array<long>, labels array<{label}>, data binary")
        blocks.write.mode("overwrite").partitionBy("list").option("compression", "zstd").parquet(f"{path}/blocks")
        radius = {r.list: r.radius for r in found.groupBy("list").agg(F.max("away").alias("radius")).collect()}
        table = [(i, [float(x) for x in c], float(radius.get(i, -1.0))) for i, c in enumerate(centres)]
        spark.createDataFrame(table, "list int, centre array<double>, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        size = {"dim": dim, "label": label, "probes": enough(points, centres) if len(points) else 1}
        spark.createDataFrame([(json.dumps(size),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/size")
        return cls(spark, path)

    @classmethod
    def build_or_load(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """The index at the path, built if there is none (``size`` is written last)."""
        if sinks.exists(vectors.sparkSession, f"{path}/size/_SUCCESS"):
            return cls(vectors.sparkSession, path)
        return cls.build(vectors, path, lists)

    def _pairs(self, queries: DataFrame, probes: int, most: int) -> DataFrame:
        """list, id, point, label of each query (query_id, query, least) at its nearest lists from the ``probes``-th to the ``most``-th, without those
        that can hold no vector at a distance of ``least`` or nearer, which goes on as the label."""
        import numpy as np
        import pyarrow as pa

        dim = self.dim
        sent = self.spark.sparkContext.broadcast((self.centres, self.radius))

        def run(batches):
            centres, radius = sent.value
            for whole in batches:
                for lo in range(0, whole.num_rows, 1_024):
                    batch = whole.slice(lo, 1_024)
                    x, ok = _matrix(batch.column(1), dim)
                    batch, x = batch.filter(pa.array(ok, pa.bool_())), x[ok]
                    far = np.sqrt(_squares(x, centres))
                    far[:, radius < 0] = np.inf  # lists without a row
                    place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
                    least = batch.column(2).fill_null(np.inf).to_numpy(zero_copy_only=False)
                    gap = np.maximum(far - radius - 1e-6 * (1 + np.sqrt((x * x).sum(1)))[:, None], 0.0)  # rounding
                    row, which = np.nonzero((place >= probes) & (place < most) & (far < np.inf) & (gap * gap <= least[:, None]))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * dim, pa.int32()), pa.array(x[row].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), batch.column(0).take(pa.array(row)), flat, pa.array(least[row])], names=["list", "id", "point", "label"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query", F.col("least").cast("double").alias("least")).where("query_id is not null")
        return asked.mapInArrow(run, "list int, id long, point array<double>, label double")

    def _near(self, pairs: DataFrame, k: int) -> DataFrame:
        """The k nearest of every two blocks that meet at a list."""
        pairs = shared.saved(pairs, "probes")
        lists = [r.list for r in pairs.select("list").distinct().collect()]  # at most LISTS
        spread = F.pmod(F.xxhash64("id"), F.lit(8))
        asked = pairs.repartition("list", spread).sortWithinPartitions("list").mapInArrow(lambda b: _packed(b, QUERIES), "list int, ids array<long>, labels array<double>, data binary")
        asked = asked.select("list", F.col("ids").alias("asked"), F.col("data").alias("queries"), F.col("labels").alias("least"))
        # queries times lists go from executor to executor: their files look small enough to be broadcast, through the driver, where equal vectors shrink
        met = self.blocks.where(F.col("list").isin(lists)).join(asked.hint("merge"), "list").select("ids", "labels", "data", "asked", "queries", "least")
        dim = self.dim
        return met.mapInArrow(lambda b: _products(b, dim, k), f"query_id long, vec_id long, label {self.label}, dist double")

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False) -> DataFrame:
        """From ``probes`` lists (as many as ``enough`` found at building, if none is given): query_id, vec_id, label, dist, rank of the k nearest indexed vectors of each query (query_id, query; ids are unique); a query's own row (vec_id = query_id) doesn't count, ties go to the smaller id."""
        w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
        best = lambda df: df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
        first, most = min(FIRST, probes or self.probes), len(self.centres) if exact else probes or self.probes
        found = shared.saved(best(self._near(self._pairs(queries.withColumn("least", F.lit(None)), 0, first), k)), "near")
        least = found.where(F.col("rank") == k).select("query_id", F.col("dist").alias("least"))
        more = self._near(self._pairs(queries.select("query_id", "query").join(least, "query_id", "left"), first, most), k)
        return best(found.drop("rank").unionByName(more))


    def nearest(self, queries: DataFrame, limit: float, slack: float) -> DataFrame:
        """query_id, vec_id, label, dist of each query's nearest indexed vectors, all within ``slack`` of its nearest, of those no farther than ``limit``
        (distances are squares). Exact: lists that the triangle inequality excludes go unread, the limit and what the first lists hold tell which."""
        best = lambda near: near.groupBy("query_id").agg(F.min("dist").alias("least"))
        asked = queries.select("query_id", "query")
        first = shared.saved(best(self._near(self._pairs(asked.withColumn("least", F.lit(limit)), 0, FIRST), 1)), "near")
        bound = asked.join(first, "query_id", "left").fillna(limit, ["least"])
        least = shared.saved(best(first.withColumnRenamed("least", "dist").unionByName(self._near(self._pairs(bound, FIRST, len(self.centres)), 1).select("query_id", "dist"))), "near")
        # the same lists once more, for what is as near as the nearest
        ties = asked.join(least.withColumn("least", F.col("least") + slack), "query_id")
        return self._near(self._pairs(ties, 0, len(self.centres)), BLOCK)

    def met(self, queries: DataFrame, limit: float) -> DataFrame:
        """query_id, lists: how many lists the limit alone leaves to each query, of ``len(self.centres)``; queries it leaves none to are left out."""
        return self._pairs(queries.withColumn("least", F.lit(limit)), 0, len(self.centres)).groupBy(F.col("id").alias("query_id")).agg(F.count("*").alias("lists"))


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, recall: the share of each query's wanted rows (query_id, vec_id) that are found."""
    hits = wanted.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
