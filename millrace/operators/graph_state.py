"""A knowledge graph that grows by batches of records: new records change only the buckets they fall into.

Two keyed tables hold what merges: instances of relations (counts add up, the first place is the least)
and seeds. Whether a triple counts depends on all seeds, and a seed may come after its triples, so that is settled when
the graph is read, by the same aggregation as for a whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.keyed import BUCKETS, PARTS, KeyedTable
from . import graph


class GraphState:
    """``add`` records (seq, question, answer), ``triples`` and ``nodes`` of all added so far. A record's seq is its place among all of them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.instances = KeyedTable(spark, f"{path}/instances", "head string, pred string, tail string, cnt long, first_seq long", ["head", "pred", "tail"], merged={"cnt": F.sum, "first_seq": F.min}, buckets=buckets)
        self.seeds = KeyedTable(spark, f"{path}/seeds", "seed string, n long", ["seed"], merged={"n": F.max}, buckets=buckets)

    def add(self, records: DataFrame, batch: int) -> bool:
        """False if this batch is in already. The tables take it one after the other; a batch that was cut off between them is sent again, and the first leaves it out."""
        done = self.instances.batch(), self.seeds.batch()
        if all(d is not None and batch <= d for d in done):
            return False
        # whatever the records come from is worked out once for both tables
        records = shared.saved(graph.counted(records), "records")
        first = self.instances.upsert(graph.instances(records), batch)
        asked = records.select("question").distinct().select(F.lit(0).cast("long").alias("seq"), "question", F.lit("").alias("answer"))
        return self.seeds.upsert(graph.seeds(asked).withColumn("n", F.lit(1)), batch) or first

    def compact(self, most: int = PARTS) -> tuple[list[int], list[int]]:
        return self.instances.compact(most), self.seeds.compact(most)

    def triples(self) -> DataFrame:
        return graph.seeded(self.instances.read(), self.seeds.read().select("seed"))

    def nodes(self) -> DataFrame:
        return graph.nodes(self.triples())
