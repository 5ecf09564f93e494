"""Substring joins: names that hold a query, by an index of grams; names that a query holds, by automata; and the lookup by tiers of both.

``held`` (query in name) writes postings of the names' grams in blocks, sorted and of bounded size, for the grams that
queries ask for: each query asks for its rarest gram only. A query of fewer than ``GRAM`` characters is a gram itself. Blocks meet groups
of queries, so neither a gram that a third of all names hold nor one that all queries ask for is a single task.

``holds`` (name in query) reads the queries once for each shard of names, of ``SHARD_CHARS`` characters: an Aho-Corasick
automaton, one shard at a time on the driver and the executors. Whole texts are read, however long.

Both hand on, for each query and block (or shard), the number of names found and the ``k`` least, never the pairs.

Null and empty names, null ids, and queries that are null or white space alone are left out. A name counts once however often
it is given; ids are unique. Names order by their bytes. Other columns of the tables are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared

#: Characters of a gram; names and characters of a block, queries that a block meets at once, blocks whose finds are put together first; characters of a shard.
GRAM, BLOCK, BLOCK_CHARS, ASKED, MERGED, SHARD_CHARS = 3, 1_024, 1 << 16, 4_096, 512, 4 << 20
FOUND = "n long, first array<string>"
#: White space, as ``str.isspace`` has it.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def _grams(text: Column, n: int) -> Column:
    """The different grams of n characters: what lies ahead of each place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _least(k: int) -> Column:
    return F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, k)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """id, n, first of parts (id, part, n, first) of different names, groups of parts first."""
    some = parts.groupBy("id", F.floor(F.col("part") / MERGED).alias("group")).agg(F.sum("n").alias("n"), _least(k).alias("first"))
    return some.groupBy("id").agg(F.sum("n").alias("n"), _least(k).alias("first"))


def _empty(queries: DataFrame) -> DataFrame:
    return queries.where("false").select("id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("first"))


def names_of(rows: DataFrame) -> DataFrame:
    """The different names (name) that aren't empty."""
    return rows.select("name").where("name <> ''").distinct()


def held(names: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """id, n, first of each query (id, query) that names (name, different) hold: how many do, and the k least of them."""
    longest = names.agg(F.max(F.char_length("name"))).first()[0]
    if longest is None:
        return _empty(queries)
    size = F.char_length("query")
    asked = queries.where(F.col("id").isNotNull() & (size >= 1) & (size <= longest)).select("id", "query")
    # grams that names hold, of every length that a query can ask for, with how much their blocks hold
    every = F.flatten(F.array(*(_grams(F.col("name"), n) for n in range(1, GRAM + 1))))
    parts = shared.saved(names.select("name", every.alias("grams")), "grams")  # worked out once
    counted = parts.select(F.explode("grams").alias("gram"), F.char_length("name").alias("chars")).groupBy("gram").agg(F.count("*").alias("df"), F.sum("chars").alias("chars"))
    counted = shared.saved(counted, "counts")
    wanted = F.when(size < GRAM, F.array("query")).otherwise(_grams(F.col("query"), GRAM))
    probed = asked.select("id", "query", F.size(wanted).alias("of"), F.explode(wanted).alias("gram")).join(counted.select("gram", "df"), "gram")
    rarest = probed.groupBy("id", "query", "of").agg(F.count("*").alias("met"), F.min(F.struct("df", "gram")).alias("rare")).where("met = of")
    probes = shared.saved(rarest.select("id", "query", F.col("rare.gram").alias("gram")), "probes")
    heads = probes.groupBy("gram").agg(F.count("*").alias("nq")).join(counted, "gram")
    heads = heads.select("gram", F.ceil(F.greatest(F.col("df") / BLOCK, F.col("chars") / BLOCK_CHARS)).alias("blocks"), F.ceil(F.col("nq") / ASKED).alias("teams"))
    heads = shared.saved(heads, "heads")
    # postings only of grams that are asked for
    postings = parts.select("name", F.explode("grams").alias("gram")).join(heads.select("gram", "blocks"), "gram")
    blocks = postings.groupBy("gram", F.pmod(F.xxhash64("name"), F.col("blocks")).alias("part")).agg(F.array_sort(F.collect_list("name")).alias("names"))
    blocks = blocks.join(heads.select("gram", "teams"), "gram").select("gram", "part", "names", F.explode(F.sequence(F.lit(0).cast("long"), F.col("teams") - 1)).alias("team"))
    teams = probes.join(heads, "gram").withColumn("team", F.pmod(F.xxhash64("id"), F.col("teams")))
    teams = teams.select("gram", "team", "id", "query", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    hits = blocks.join(teams, ["gram", "part", "team"]).select("id", "part", F.filter("names", lambda name: F.contains(name, F.col("query"))).alias("hits"))
    return _merged(hits.where(F.size("hits") > 0).select("id", "part", F.size("hits").cast("long").alias("n"), F.slice("hits", 1, k).alias("first")), k)


_automaton: tuple[str, object] | None = None


def _built(key: str, names: list[str]):
    """A worker's automaton of the shard it reads with, kept between tasks."""
    global _automaton
    if _automaton is None or _automaton[0] != key:
        import ahocorasick

        _automaton = None  # the former shard's goes first
        new = ahocorasick.Automaton()
        for name in names:
            new.add_word(name, name)
        new.make_automaton()
        _automaton = key, new
    return _automaton[1]


def _scanned(batches: Iterator, key: str, names: list[str], k: int) -> Iterator:
    import heapq

    import pyarrow as pa

    automaton = _built(key, names)
    for batch in batches:
        rows, n, first = [], [], []
        for i, text in enumerate(batch.column(1)):
            found = {name for _, name in automaton.iter(text.as_py())}
            if found:
                rows.append(i)
                n.append(len(found))
                first.append(heapq.nsmallest(k, found))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.string()))], names=["id", "n", "first"])


def holds(names: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """id, n, first of each query (id, query) that holds names (name, different): how many, and the k least of them."""
    chars = names.agg(F.sum(F.char_length("name"))).first()[0]
    if chars is None:
        return _empty(queries)
    shards = -(-chars // SHARD_CHARS)
    dealt = names if shards == 1 else shared.saved(names.select("name", F.pmod(F.xxhash64("name"), F.lit(shards)).alias("shard")), "names")
    texts = queries.where(F.col("id").isNotNull() & (F.col("query") != "")).select("id", "query")
    schema, path = f"id {queries.schema['id'].dataType.simpleString()}, {FOUND}", shared.folder(names.sparkSession, "shards")

    def scan(shard: DataFrame) -> tuple[DataFrame, object]:
        sent, key = names.sparkSession.sparkContext.broadcast(shard.select("name").toArrow()["name"].to_pylist()), uuid.uuid4().hex
        return texts.mapInArrow(lambda b: _scanned(b, key, sent.value, k), schema), sent

    if shards == 1:
        return scan(dealt)[0]
    for shard in range(shards):  # each shard's finds are written before the next one is sent
        found, sent = scan(dealt.where(F.col("shard") == shard))
        found.withColumn("part", F.lit(shard).cast("long")).write.mode("append").parquet(path)
        sent.destroy()
    return _merged(names.sparkSession.read.schema(f"{schema}, part long").parquet(path), k)


def lookup(names: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """id, tier, name, n_hits of each query (id, query), without the white space around it: the k least of the names that equal it (without theirs; tier 1);
    where there are none, of the names that hold it (2); where there are none, of those that it holds (3). n_hits counts all of the tier."""
    names = shared.saved(names_of(names), "distinct")
    asked = queries.select("id", _stripped(F.col("query")).alias("query")).where("id is not null and query <> ''")
    # names that are equal but for white space are few parts of one key: counted before they are gathered
    bare = names.select(_stripped(F.col("name")).alias("query"), "name").withColumn("part", F.pmod(F.xxhash64("name"), F.lit(MERGED)))
    same = bare.groupBy("query", "part").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("name")), 1, k).alias("first"))
    same = same.groupBy("query").agg(F.sum("n").alias("n"), _least(k).alias("first"))
    exact = shared.saved(asked.join(same, "query").select("id", "n", "first"), "exact")
    left = asked.join(exact.select("id"), "id", "left_anti")
    within = shared.saved(held(names, left, k), "held")
    rest = left.join(within.select("id"), "id", "left_anti")
    tiers = [df.withColumn("tier", F.lit(t).cast("long")) for t, df in ((1, exact), (2, within), (3, holds(names, rest, k)))]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).select("id", "tier", F.explode("first").alias("name"), F.col("n").alias("n_hits"))
