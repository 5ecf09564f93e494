"""Knowledge graphs from templated questions: extraction, denoising, counting, two-hop queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import shared
from . import vector_index

# Relation, type of head, type of tail, patterns; the first that matches counts.
RULES = (
    ("symptom_of", "symptom", "disease", ("是什么疾病的症状", "哪些疾病.{0,3}症状")),
    ("has_complication", "disease", "disease", ("并发症",)),
    ("has_drug", "disease", "drug", ("推荐药", "用药", "药物")),
    ("has_treatment", "disease", "treatment", ("手术治疗", "辅助治疗", "放射治疗", "化疗", "治疗方式", "治疗")),
    ("has_symptom", "disease", "symptom", ("临床表现", "症状")),
    ("has_examination", "disease", "examination", ("影像学检查", "检查")),
    ("belongs_to_department", "disease", "department", ("就诊科室", "科室")),
)
HEAD_TRIM = "的。，？? 可能会是：:"
FIRST_HOP = ("symptom_of",)
SECOND_HOP = ("has_drug", "has_treatment", "has_symptom", "has_examination", "has_complication", "belongs_to_department")


#: Cosines are equal that are so to six places.
ROUNDING = 1e-6


def relations(records: DataFrame, *others: str) -> DataFrame:
    """seq, pred, head, tails (and other columns) of (seq, question, answer); rows without a relation go."""
    q, found, head = F.col("question"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pred, _, _, patterns in reversed(RULES):
        for p in reversed(patterns):
            hit = q.rlike(p)
            found = F.when(hit, pred).otherwise(found)
            head = F.when(hit, F.substring(q, F.lit(1), F.regexp_instr(q, F.lit(p)) - 1)).otherwise(head)
    trimmed = T.strip(F.regexp_replace(head, f"[{HEAD_TRIM}]+$", ""))
    return records.select("seq", found.alias("pred"), trimmed.alias("head"), T.split_answer(F.col("answer")).alias("tails"), *others).where("pred is not null and head <> ''")


def counted(records: DataFrame) -> DataFrame:
    """seq (the least), question, answer, times: equal records as one, so that rules are tried once on each."""
    return records.groupBy("question", "answer").agg(F.min("seq").alias("seq"), F.count("*").alias("times")).select("seq", "question", "answer", "times")


def instances(records: DataFrame) -> DataFrame:
    """head, pred, tail, cnt, first_seq of every relation, seeds or not: counts add up and the first place is a minimum, so those of parts merge.
    Records may be counted (``times``)."""
    if "times" not in records.columns:
        records = records.withColumn("times", F.lit(1).cast("long"))
    flat = relations(records, "times").select("seq", "times", "pred", T.normalized(F.col("head")).alias("head"), F.posexplode("tails").alias("pos", "tail")).withColumn("tail", T.normalized(F.col("tail"))).where("tail <> ''")
    return flat.groupBy("head", "pred", "tail").agg(F.sum("times").alias("cnt"), F.min(F.col("seq") * 1000000 + F.col("pos") * 2).alias("first_seq"))


def seeds(records: DataFrame) -> DataFrame:
    """seed: diseases, as some record gives their department or, but for operations, complications."""
    return relations(records).where(F.col("pred").isin("belongs_to_department", "has_complication") & ~((F.col("pred") == "has_complication") & F.col("head").contains("术"))).select(T.normalized(F.col("head")).alias("seed")).distinct()


def seeded(found: DataFrame, seeds_: DataFrame) -> DataFrame:
    """head, pred, tail, cnt, first_seq of instances whose disease side is a seed; symptoms also count backwards."""
    head, tail = seeds_.select(F.col("seed").alias("_of")), seeds_.select(F.col("seed").alias("_also")).distinct()
    key = F.when(F.col("pred") == "symptom_of", F.col("tail")).otherwise(F.col("head"))
    kept = found.join(head, key == F.col("_of"), "left_semi")
    # of complications the tail is a disease too; of others it is not looked up
    kept = kept.join(tail, (F.col("pred") == "has_complication") & (F.col("tail") == F.col("_also")), "left").where("pred <> 'has_complication' or _also is not null")
    own = F.struct("head", "pred", "tail", "cnt", "first_seq")
    back = F.struct(F.col("tail").alias("head"), F.lit("symptom_of").alias("pred"), F.col("head").alias("tail"), "cnt", (F.col("first_seq") + 1).alias("first_seq"))
    both = F.when((F.col("pred") == "has_symptom") & T.valid_symptom(F.col("tail")), F.array(own, back)).otherwise(F.array(own))
    return kept.select(F.inline(both)).groupBy("head", "pred", "tail").agg(F.sum("cnt").alias("cnt"), F.min("first_seq").alias("first_seq"))


def triples(records: DataFrame) -> DataFrame:
    """head, pred, tail, cnt, first_seq: kept if the disease side is a seed; symptoms also count backwards."""
    return seeded(instances(records), seeds(records))


def nodes(tr: DataFrame) -> DataFrame:
    """name, type (of the first triple that names it), count, symptom_indegree."""
    types = tr.sparkSession.createDataFrame([(p, h, t) for p, h, t, _ in RULES], "pred string, head_type string, tail_type string")
    typed = tr.join(F.broadcast(types), "pred")
    ends = typed.select(F.explode(F.array(
        F.struct(F.col("head").alias("name"), F.col("head_type").alias("type"), (F.col("first_seq") * 2).alias("o"), F.lit(0).alias("indeg"), "cnt"),
        F.struct(F.col("tail").alias("name"), F.col("tail_type").alias("type"), (F.col("first_seq") * 2 + 1).alias("o"), (F.col("pred") == "symptom_of").cast("int").alias("indeg"), "cnt"),
    )).alias("e")).select("e.*")
    return ends.groupBy("name").agg(F.min_by("type", "o").alias("type"), F.sum("cnt").alias("count"), F.sum("indeg").cast("long").alias("symptom_indegree"))


def two_hop(tr: DataFrame, starts: DataFrame, top: int = 5, branch: int = 20, first: str = "symptom_of", ranked: bool = False) -> DataFrame:
    """start, disease, score, place, relation, name, cnt (and, with ``ranked``, r, the place within the relation): best diseases of a start with hub suppression, then each relation's best tails."""
    indeg = tr.where(F.col("pred") == first).groupBy("tail").agg(F.count("*").alias("indeg"))
    hop = tr.where(F.col("pred") == first).join(starts, F.col("head") == F.col("start"), "left_semi").join(indeg, "tail", "left")
    score = F.col("cnt") / (1 + 0.5 * F.log1p(F.coalesce("indeg", F.lit(1)).cast("double")))
    w = Window.partitionBy("start").orderBy(F.desc("score"), "first_seq")
    best = hop.select(F.col("head").alias("start"), F.col("tail").alias("disease"), F.round(score, 6).alias("score"), "first_seq")
    best = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= min(top, branch)).drop("first_seq")
    out = best.join(tr.where(F.col("pred").isin(*SECOND_HOP)), F.col("disease") == F.col("head"))
    w2 = Window.partitionBy("start", "disease", "pred").orderBy(F.desc("cnt"), "first_seq")
    return out.withColumn("r", F.row_number().over(w2)).where(F.col("r") <= branch).select("start", "disease", "score", F.col("place").cast("long").alias("place"), F.col("pred").alias("relation"), F.col("tail").alias("name"), "cnt", *(["r"] if ranked else []))


def stats(tr: DataFrame) -> DataFrame:
    return tr.groupBy("pred").agg(F.count("*").alias("triples"), F.count_distinct("head").alias("heads"), F.count_distinct("tail").alias("tails"), F.sum("cnt").alias("instances"))


def edges(tr: DataFrame) -> DataFrame:
    """head, tail, relation, count: the graph's edges, relation and count as attributes."""
    return tr.select("head", "tail", F.col("pred").alias("relation"), F.col("cnt").alias("count"))


def kept_per_record(tr: DataFrame, records: DataFrame) -> DataFrame:
    """Instances kept, records read, and the one by the other."""
    return tr.agg(F.sum("cnt").alias("instances")).crossJoin(records.agg(F.count("*").alias("records"))).withColumn("kept", F.bround(F.coalesce("instances", F.lit(0)) / F.greatest("records", F.lit(1)), 2))


def neighbors(tr: DataFrame, starts: DataFrame, allowed: tuple[str, ...] = SECOND_HOP) -> DataFrame:
    """start, tail, relation, count: out-edges of the starts (start) whose relation is allowed."""
    return tr.where(F.col("pred").isin(*allowed)).join(starts, F.col("head") == F.col("start")).select("start", "tail", F.col("pred").alias("relation"), F.col("cnt").alias("count"))


def _dot(x, y):
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _norm(x):
    return F.sqrt(_dot(x, x))


def _unit(vector):
    """The vector scaled to length 1, of doubles; null if it is zero or isn't finite."""
    norm = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(vector, lambda v: v.cast("double") / F.sqrt(norm)))


def resolve(queries: DataFrame, names: DataFrame, vectors: DataFrame, least: float = 0.6, aliases: dict[str, str] = T.ALIASES) -> DataFrame:
    """query, node, method, sim of each query (query, vector): its name, without white space and by alias, if it is a
    node of any type (name); else the symptom (name, vector) of greatest cosine, by name if equal, from ``least`` up.

    Only queries that are no nodes are held against the vectors, through an index of the different ones, scaled to length 1: there ``least``
    is a distance, and bounds of the lists exclude most of them. A vector that is zero or not whole has no cosine.
    """
    own = T.normalized(F.col("query"))
    asked = queries.select("query", "vector", own.alias("own"), T.canonical(own, aliases).alias("node"))
    exact = asked.join(names.select(F.col("name").alias("node")).distinct(), "node", "left_semi")
    found = exact.select("query", "node", F.when(F.col("own") == F.col("node"), "exact").otherwise("alias").alias("method"), F.lit(None).cast("double").alias("sim"))
    # ids of their own, fixed by being written: a query's is never a vector's
    rest = asked.join(exact.select("query"), "query", "left_anti").select("query", F.col("vector").alias("q"), (-1 - F.monotonically_increasing_id()).alias("query_id"))
    rest = shared.saved(rest, "unresolved")
    units = vectors.select("name", _unit(F.col("vector")).alias("embedding")).where("embedding is not null").groupBy("embedding").agg(F.min("name").alias("label"))
    units = shared.saved(units.withColumn("vec_id", F.monotonically_increasing_id()), "units")
    index = vector_index.VectorIndex.build(units, shared.folder(units.sparkSession, "unit-index"))
    unit = rest.select("query_id", _unit(F.col("q")).alias("query")).where("query is not null")
    near = index.nearest(unit, 2 - 2 * least + 4 * ROUNDING, 4 * ROUNDING).select("query_id", "vec_id")
    # cosines of the few that are nearest
    sims = near.join(rest, "query_id").join(units, "vec_id").select("query_id", F.col("label").alias("name"), F.round(_dot(F.col("q"), F.col("embedding")) / (_norm(F.col("q")) * _norm(F.col("embedding"))), 6).alias("sim"))
    best = sims.groupBy("query_id").agg(F.min(F.struct((-F.col("sim")).alias("far"), "name")).alias("best"))
    hit = F.col("best.far") <= -least
    close = rest.select("query", "query_id").join(best, "query_id", "left").select("query", F.when(hit, F.col("best.name")).alias("node"), F.when(hit, "nearest").alias("method"), F.when(hit, -F.col("best.far")).alias("sim"))
    return found.unionByName(close)


def coverage(tr: DataFrame, diseases: DataFrame, aliases: dict[str, str] = T.ALIASES) -> DataFrame:
    """disease, node and whether it has symptoms, drugs, departments, treatments; covered: symptoms, and drugs or treatments."""
    heads = tr.groupBy("head").agg(F.collect_set("pred").alias("preds"))
    both = diseases.withColumn("node", T.canonical(T.normalized(F.col("disease")), aliases)).join(heads, F.col("node") == F.col("head"), "left")
    has = lambda p: F.coalesce(F.array_contains("preds", p), F.lit(False))
    out = both.select("disease", "node", has("has_symptom").alias("symptoms"), has("has_drug").alias("drugs"), has("belongs_to_department").alias("departments"), has("has_treatment").alias("treatments"))
    return out.withColumn("covered", F.col("symptoms") & (F.col("drugs") | F.col("treatments")))


def expected(actual, wanted, aliases: dict[str, str] = T.ALIASES):
    """Whether a disease is the one expected: equal by alias, or one name within the other."""
    return (T.canonical(actual, aliases) == T.canonical(wanted, aliases)) | F.contains(actual, wanted) | F.contains(wanted, actual)


def symptom_names(nodes_: DataFrame) -> DataFrame:
    """name: the symptoms, in the order of names that settles ties."""
    return nodes_.where("type = 'symptom'").select("name").orderBy("name")
