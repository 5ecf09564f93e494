"""Queries that search an index which they write to the shared folder first, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segment, substring, text_index, vector_index
from ..sources import shared
from . import catalogue as C

#: Letters of the conversations' languages, and the longest unit of them that is looked for.
LETTERS, LONGEST = "[a-zß-öø-ÿ]+", 6


def _text_index(spark, d):
    return text_index.TextIndex.build(C._t(spark, d, "documents").select("doc_id", "text"), shared.folder(spark, "text-index"))


def bm25_index_search(spark, d):
    asked = spark.createDataFrame([(0, " ".join(C.TERMS))], "query_id long, text string")
    return _text_index(spark, d).search(asked).select("doc_id", "score", "rank")


def bm25_index_items(spark, d):
    """Every benchmark item asks, with its whole text."""
    return _text_index(spark, d).search(C._t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10).select("query_id", "doc_id", "score", "rank")


def _vector_index(spark, d):
    vectors = C._t(spark, d, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.VectorIndex.build(vectors, shared.folder(spark, "vector-index")), queries


def vector_index_exact(spark, d):
    index, queries = _vector_index(spark, d)
    return index.search(queries, 20, exact=True).select("query_id", "vec_id", "label", F.round("dist", 6).alias("dist"), "rank")


def vector_index_search(spark, d):
    """By as many lists as the index finds to be enough; a test measures what is found."""
    index, queries = _vector_index(spark, d)
    return index.search(queries, 20).select("query_id", "vec_id", "label", F.round("dist", 6).alias("dist"), "rank")


def _units(spark, d):
    return segment.learn(C._t(spark, d, "conversations").select("text"), LETTERS, LONGEST)


def segment_words(spark, d):
    """The units of which the conversations' words are made."""
    return _units(spark, d).select("word", "n", F.round("cohesion", 6).alias("cohesion"), (F.round("entropy", 6) + 0.0).alias("entropy"))


def segment_conversations(spark, d):
    """Every message in these units."""
    rows = segment.segment(C._t(spark, d, "conversations").select("conv_id", "turn", "text"), _units(spark, d), LETTERS)
    return rows.select("conv_id", "turn", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(segment.joined(F.col("tokens")), 256).alias("tokens_sha256"))


def _words(df):
    return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({LETTERS})"), F.lit(1))).alias("name"))


def lookup_words(spark, d):
    """Every word of the documents asks among the words of the benchmark: equal, part of longer ones, or made of shorter ones."""
    words = shared.saved(_words(C._t(spark, d, "documents")).distinct(), "words")
    asked = words.select(F.col("name").alias("id"), F.col("name").alias("query"))
    return substring.lookup(_words(C._t(spark, d, "benchmark")), asked).select(F.col("id").alias("word"), "tier", "name", "n_hits")


def lookup_documents(spark, d):
    """Every whole document asks among the names of parts and the benchmark's words of eight letters and more."""
    names = C._t(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(_words(C._t(spark, d, "benchmark")).where(F.char_length("name") >= 8))
    asked = C._t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("query"))
    return substring.lookup(names, asked).select(F.col("id").alias("doc_id"), "tier", "name", "n_hits")


def oracle_sql() -> dict[str, str]:
    """Left out: ``vector_index_search``, which may miss neighbours, and ``segment_conversations``, which finds paths through a lattice; their tests compare with all rows and with all paths."""
    by_item = f"""with {C._TOK}, q as (select item_id as query_id, tok, count(*) as times from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as tok from benchmark) group by 1, 2),
s as (select query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join p using (tok) join id using (tok), sz group by 1, 2)"""
    units = f"""with runs as (select run, count(*) as c from (select unnest(regexp_extract_all(lower(text), '{LETTERS}')) as run from conversations) group by 1),
pl as (select run, c, i, unnest(range(1, least({LONGEST}, length(run) - i + 1) + 1)) as k from (select run, c, unnest(range(1, length(run) + 1)) as i from runs)),
g as (select run[i:i + k - 1] as gram, case when i > 1 then run[i - 1] else '' end as l, run[i + k:i + k] as r, c from pl),
lr as (select gram, sum(n) as n, ln(sum(n)) - sum(n * ln(n)) / sum(n) as e from (select gram, l, sum(c)::double as n from g group by 1, 2) group by 1),
rr as (select gram, ln(sum(n)) - sum(n * ln(n)) / sum(n) as e from (select gram, r, sum(c)::double as n from g group by 1, 2) group by 1),
b as materialized (select gram, lr.n::bigint as n, least(lr.e, rr.e) as entropy from lr join rr using (gram)), t as (select sum(n)::double as t from b where length(gram) = 1),
f as (select gram, n, entropy, unnest(range(1, length(gram))) as k from b where length(gram) > 1 and n >= 5 and entropy >= 0.5),
h as (select f.gram, any_value(f.n) as n, min(ln(f.n) + ln(t) - ln(x.n) - ln(y.n)) as cohesion, any_value(f.entropy) as entropy from f join b x on x.gram = f.gram[1:k] join b y on y.gram = f.gram[k + 1:], t group by 1)
select gram as word, n, round(cohesion, 6) as cohesion, round(entropy, 6) + 0.0 as entropy from (select * from h where cohesion >= 2 union all select gram, n, null, entropy from b where length(gram) = 1) order by n desc, gram limit 200000"""
    tiers = r"""c as (select id, name, case when regexp_replace(name, '^\s+|\s+$', '', 'g') = query then 1 when contains(name, query) then 2 when contains(query, name) then 3 end as tier from n, (select id, regexp_replace(query, '^\s+|\s+$', '', 'g') as query from q) where query <> '' and name <> ''),
m as (select *, min(tier) over (partition by id) as l from c where tier is not null), f as (select id, tier::bigint as tier, name, count(*) over (partition by id) as n_hits, row_number() over (partition by id order by name) as r from m where tier = l)"""
    words = f"unnest(regexp_extract_all(lower(text), '{LETTERS}'))"
    return {
        "lookup_words": f"with n as (select distinct {words} as name from benchmark), q as (select id, id as query from (select distinct {words} as id from documents)), {tiers} select id as word, tier, name, n_hits from f where r <= 5",
        "lookup_documents": f"with n as (select p_name as name from part union select * from (select {words} as name from benchmark) where length(name) >= 8), q as (select doc_id as id, lower(text) as query from documents), {tiers} select id as doc_id, tier, name, n_hits from f where r <= 5",
        "segment_words": units,
        "bm25_index_search": C.oracle_sql()["bm25_search"],
        "bm25_index_items": f"{by_item} select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 10 and score > 0",
        "vector_index_exact": C.oracle_sql()["knn_topk"],
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (bm25_index_search, bm25_index_items, vector_index_exact, vector_index_search, segment_words, segment_conversations, lookup_words, lookup_documents)}
