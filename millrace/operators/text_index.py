"""A BM25 index that is written once and searched often: postings in blocks with their best scores.

``build`` tokenises the documents once. A task gathers the postings of some tens of thousands of
documents, a *shard* (counted a thousand documents at a time, so that their words are not held), and cuts each term's, in the order of ids, into blocks; only blocks are
shuffled, to files by hash of the term, so a term that most documents hold is spread over all
shards. Each block keeps the ids it lies between and the best score that a posting of it gives.

``search`` is exact and skips blocks. It reads the heads of the asked terms' blocks alone (files by
the terms' buckets, rows by pushed-down terms). Within a shard the ends of all blocks cut the ids into
intervals; what the blocks over an interval can give at most bounds every document in it. Postings
over the best intervals of each shard give some documents' scores, the k-th best of which no result
lies below; then only blocks over an interval that may reach it are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared, sinks
from . import plug

#: Postings of a block, documents and tokens of a shard (whichever comes first), folders that terms are dealt to.
BLOCK, SHARD_DOCS, SHARD_TOKENS, BUCKETS = 128, 65_536, 2 << 20, 64
#: Queries whose scores a task adds up together.
QUERIES = 256
#: Intervals of a shard, of greatest bound, whose documents' scores tell what the k-th best is at least.
SEEDS = 4
#: Terms up to which a search names them in the scan's filter.
NAMED = 2_000
_POSTINGS = "tok string, shard long, block int, lo long, hi long, doc_ids array<long>, tfs array<int>, dls array<int>"


def _shards(batches: Iterator, block: int, most_docs: int, most_tokens: int) -> Iterator:
    """The blocks of the documents (doc_id, tokens) of a task, a shard at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part, number, held, docs, tokens = TaskContext.get().partitionId(), 0, [], 0, 0

    def counted(batch: pa.RecordBatch) -> tuple:
        """Ids and lengths of some documents, and of each of their terms once the term, the document's place and how often."""
        lists = batch.column(1)
        dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        word = pc.list_flatten(lists).dictionary_encode()
        key, tf = np.unique(word.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
        tok, row = (x.astype(np.int32) for x in np.divmod(key, max(1, len(dl))))
        # copies, so that nothing of the batch is kept
        return batch.column(0).to_numpy().copy(), dl, pa.DictionaryArray.from_arrays(pa.array(tok), word.dictionary), row, tf.astype(np.int32)

    def flush() -> pa.RecordBatch:
        ids, dl = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int32)
        rank[by_id] = np.arange(len(ids))
        words = pa.chunked_array([h[2] for h in held]).unify_dictionaries().chunks
        first = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
        row = rank[np.concatenate([h[3] + f for h, f in zip(held, first.tolist(), strict=True)])]
        tok, tf = np.concatenate([w.indices.to_numpy() for w in words]), np.concatenate([h[4] for h in held])
        held.clear()
        order = np.argsort(tok.astype(np.int64) * max(1, len(ids)) + row)
        tok, row, tf, ids, dl = tok[order], row[order], tf[order], ids[by_id], dl[by_id]
        del order
        place = np.arange(len(tok)) - np.searchsorted(tok, tok)
        starts = np.flatnonzero(place % block == 0)
        cut = pa.array(np.append(starts, len(tok)), pa.int32())
        lists_of = lambda x, kind: pa.ListArray.from_arrays(cut, pa.array(x, kind))
        last = np.append(starts[1:], len(tok))[: len(starts)] - 1
        columns = [
            words[0].dictionary.take(pa.array(tok[starts])), pa.array(np.full(len(starts), (part << 24) | number), pa.int64()), pa.array(place[starts] // block, pa.int32()),
            pa.array(ids[row[starts]]), pa.array(ids[row[last]]), lists_of(ids[row], pa.int64()), lists_of(tf, pa.int32()), lists_of(dl[row], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _POSTINGS.split(", ")])

    for whole in batches:
        for lo in range(0, whole.num_rows, 1_024):
            batch = whole.slice(lo, 1_024)
            held.append(counted(batch))
            docs, tokens = docs + batch.num_rows, tokens + int(held[-1][1].sum())
            if docs >= most_docs or tokens >= most_tokens:
                yield flush()
                number, docs, tokens = number + 1, 0, 0
    if held:
        yield flush()


def _bounds(table):
    """The blocks (heads) of one query and shard with bound, the most that a document of theirs can get, and seed: whether they lie over one of the best intervals."""
    import numpy as np
    import pyarrow as pa

    lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
    give = np.maximum(table["weight"].to_numpy() * table["best"].to_numpy(), 0.0)
    cuts = np.unique(np.concatenate([lo, hi + 1]))
    a, b = np.searchsorted(cuts, lo), np.searchsorted(cuts, hi + 1)
    step = np.zeros(len(cuts))
    np.add.at(step, a, give)
    np.add.at(step, b, -give)
    at = np.append(np.cumsum(step)[:-1], -np.inf)  # of the interval from each cut on; of the last there is none
    most = np.maximum.reduceat(at, np.column_stack([a, b]).ravel())[::2]
    among = np.zeros(len(cuts) + 1, np.int64)
    among[np.argsort(-at, kind="stable")[:SEEDS] + 1] = 1
    among = np.cumsum(among)
    seed = (among[b] > among[a]) & (table["weight"].to_numpy().min() >= 0)
    return table.append_column("bound", pa.array(most)).append_column("seed", pa.array(seed))


def _added(blocks, heads, k: int):
    """The k best documents of a shard for each query, by the blocks that its heads name."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    blocks, heads = blocks.combine_chunks(), heads.combine_chunks()
    word = blocks["tok"].combine_chunks().dictionary_encode() if len(blocks) else pa.array([], pa.string()).dictionary_encode()
    name = lambda codes, numbers: (codes.to_numpy(zero_copy_only=False).astype(np.int64) << 32) | numbers.to_numpy().astype(np.int64)
    own = name(word.indices, blocks["block"])
    order = np.argsort(own)
    named = name(pc.fill_null(pc.index_in(heads["tok"].combine_chunks(), value_set=word.dictionary), -1), heads["block"])
    row = order[np.searchsorted(own[order], named)] if len(order) else np.zeros(0, np.int64)
    lists = blocks["doc_ids"].combine_chunks()
    ids, doc = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True)
    parts = pc.list_flatten(blocks["parts"].combine_chunks()).to_numpy()
    size = pc.list_value_length(lists).to_numpy()
    start = np.cumsum(size) - size
    query, weight = heads["query_id"].combine_chunks().dictionary_encode(), heads["weight"].to_numpy()
    code = query.indices.to_numpy()
    by_query = np.argsort(code, kind="stable")
    out_query, out_doc, out_score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for mine in np.split(by_query, np.flatnonzero(np.diff(code[by_query])) + 1) if len(row) else ():
        r = row[mine]
        at = np.arange(int(size[r].sum())) + np.repeat(start[r] - (np.cumsum(size[r]) - size[r]), size[r])
        score = np.round(np.bincount(doc[at], np.repeat(weight[mine], size[r]) * parts[at], len(ids)), 6)
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((ids[found], -score[found]))[:k]]
        out_query.append(np.full(len(found), code[mine[0]]))
        out_doc.append(ids[found])
        out_score.append(score[found])
    names = query.dictionary.take(pa.array(np.concatenate(out_query)))
    return pa.table([names, pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_score))], names=["query_id", "doc_id", "score"])


class TextIndex:
    """An index at a path; see the module. ``tokens`` must be the one it was built with."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = plug.latin_tokens):
        self.spark, self.path, self.tokens = spark, path, tokens
        self.size = json.loads(spark.read.text(f"{path}/size").first().value)
        self.blocks = spark.read.schema("tok string, shard long, block int, lo long, hi long, doc_ids array<long>, parts array<double>, best double, bucket int").parquet(f"{path}/blocks")
        self.terms = spark.read.schema("tok string, df long, idf double, bucket int").parquet(f"{path}/terms")

    @classmethod
    def build(cls, docs: DataFrame, path: str, tokens: Callable[[Column], Column] = plug.latin_tokens, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> TextIndex:
        """Index the documents (doc_id, text); ids are unique, and rows without one have no postings. Documents without tokens count in the statistics."""
        spark, (block, most_docs, most_tokens) = docs.sparkSession, (BLOCK, SHARD_DOCS, SHARD_TOKENS)
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
        found = shared.saved(rows.mapInArrow(lambda x: _shards(x, block, most_docs, most_tokens), _POSTINGS), "postings")
        counts = found.groupBy("tok").agg(F.sum(F.size("doc_ids")).alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("tokens"))
        counts, n = shared.saved(counts, "counts"), docs.count()
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        sums = counts.agg(F.sum("tokens").alias("tokens"), F.avg(raw).alias("mean")).first()
        size = {"n": n, "avgdl": (sums.tokens or 0) / n if n else 0.0, "mean": sums.mean or 0.0, "k1": k1, "b": b}
        bucket = F.pmod(F.xxhash64("tok"), F.lit(BUCKETS)).cast("int").alias("bucket")
        idf = F.when(raw < 0, epsilon * size["mean"]).otherwise(raw)
        counts.select("tok", "df", idf.alias("idf"), bucket).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "tok").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        part = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (size["avgdl"] or 1.0)))
        rows = found.withColumn("parts", F.zip_with("tfs", "dls", part)).withColumn("best", F.array_max("parts")).select("*", bucket)
        # a bucket's shards go to several tasks, so that no term is one task's alone
        spread = F.pmod(F.xxhash64("shard"), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))
        rows = rows.repartition("bucket", spread).sortWithinPartitions("bucket", "tok", F.desc("best"))
        rows.drop("tfs", "dls").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/blocks")
        spark.createDataFrame([(json.dumps(size),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/size")
        return cls(spark, path, tokens)

    @classmethod
    def build_or_load(cls, docs: DataFrame, path: str, **how) -> TextIndex:
        """The index at the path, built if there is none (``size`` is written last)."""
        if sinks.exists(docs.sparkSession, f"{path}/size/_SUCCESS"):
            return cls(docs.sparkSession, path, how.get("tokens", plug.latin_tokens))
        return cls.build(docs, path, **how)

    def stats(self) -> DataFrame:
        """tok, df, idf of every term."""
        return self.terms.select("tok", "df", "idf")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, Column]:
        """query_id, tok, weight of the queries (query_id, text), and the filter that keeps other terms from being read."""
        words = queries.select("query_id", F.explode(self.tokens(F.col("text"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("times"))
        words = shared.saved(words, "asked")
        # a term's name and its folder; of more terms the join alone decides
        named = words.select("tok", F.pmod(F.xxhash64("tok"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().limit(NAMED + 1).collect()
        keep = F.lit(True) if len(named) > NAMED else F.col("bucket").isin(*{r.bucket for r in named}) & F.col("tok").isin(*(r.tok for r in named))
        return words.join(self.terms.where(keep), "tok").select("query_id", "tok", (F.col("times") * F.col("idf")).alias("weight")), keep

    def heads(self, queries: DataFrame) -> tuple[DataFrame, Column]:
        """Every block of the queries' terms with its bound (no postings are read), and the filter."""
        asked, keep = self._asked(queries)
        heads = self.blocks.where(keep).select("tok", "shard", "block", "lo", "hi", "best").join(asked, "tok").select("query_id", "tok", "shard", "block", "weight", "lo", "hi", "best")
        schema = f"query_id {dict(asked.dtypes)['query_id']}, tok string, shard long, block int, weight double, lo long, hi long, best double, bound double, seed boolean"
        return heads.groupBy("query_id", "shard").applyInArrow(_bounds, schema), keep

    def _best(self, heads: DataFrame, keep: Column, k: int) -> DataFrame:
        """query_id, doc_id, score above 0 by the given blocks alone: of each query and shard the k best. A shard's blocks go to one task for every ``QUERIES`` queries, once."""
        slots = -(-heads.select("query_id").distinct().count() // QUERIES)
        asked = heads.select("shard", F.pmod(F.xxhash64("query_id"), F.lit(max(1, slots))).alias("slot"), "tok", "block", "query_id", "weight")
        wanted = asked.groupBy("tok", "shard", "block", "slot").agg(F.count("*").alias("queries"))
        blocks = self.blocks.where(keep).select("tok", "shard", "block", "doc_ids", "parts").join(wanted, ["tok", "shard", "block"])
        blocks = blocks.select("tok", "block", "doc_ids", "parts", F.col("shard").alias("of_shard"), F.col("slot").alias("of_slot"))
        both = blocks.groupBy("of_shard", "of_slot").cogroup(asked.groupBy("shard", "slot"))
        return both.applyInArrow(lambda x, y: _added(x, y, k), f"query_id {dict(heads.dtypes)['query_id']}, doc_id long, score double")

    def needed(self, queries: DataFrame, k: int) -> tuple[DataFrame, Column]:
        """The heads with needed: false for blocks none of whose documents can be among the k best."""
        heads, keep = self.heads(queries)
        heads = shared.saved(heads, "heads")
        best = self._best(heads.where("seed"), keep, k)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"))
        least = best.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
        need = F.col("bound") >= F.coalesce("least", F.lit(float("-inf"))) - 2e-6  # rounding
        return shared.saved(heads.join(least, "query_id", "left").withColumn("needed", need), "needed"), keep

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """query_id, doc_id, score, rank of the k best documents of each query (query_id, text); cut to k first, then scores of 0 or less go.
        Ties go to the smaller id. A term given twice counts twice."""
        heads, keep = self.needed(queries, k)
        scores = self._best(heads.where("needed"), keep, k)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)

    def skipped(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """query_id, blocks, read: how many blocks the query's terms have, and of how many the postings are read for results."""
        return self.needed(queries, k)[0].groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum(F.col("needed").cast("long")).alias("read"))
