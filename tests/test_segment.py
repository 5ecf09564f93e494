"""Word segmentation: counts and the path against brute force, and search over segmented text."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import segment, text_index

WORDS = ["头疼", "失眠", "高血压", "糖尿病", "咳嗽", "感冒", "怎么办", "吃", "药", "多久", "好", "医生", "检查", "胃炎", "发烧", "休息"]


def corpus(n=1_200):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices(WORDS, k=rng.randint(2, 9))) + rng.choice(["", "。", "，MRI 2次"])) for i in range(n)]
    return rows + [(5_000, None), (5_001, ""), (5_002, "abc 12"), (5_003, "龘龘"), (5_004, "头疼" * 300)]


def brute_words(texts, longest=4, least=5, cohesion=2.0, entropy=0.5):
    left, right, n = defaultdict(Counter), defaultdict(Counter), Counter()
    for t in texts:
        for run in "".join(c if "一" <= c <= "鿿" else " " for c in (t or "")).split():
            for i in range(len(run)):
                for j in range(i + 1, min(i + longest, len(run)) + 1):
                    n[run[i:j]] += 1
                    left[run[i:j]][run[i - 1 : i] if i else ""] += 1
                    right[run[i:j]][run[j : j + 1]] += 1
    total = sum(c for g, c in n.items() if len(g) == 1)
    h = lambda c: -sum(x / sum(c.values()) * math.log(x / sum(c.values())) for x in c.values())
    out = {g: (c, None) for g, c in n.items() if len(g) == 1}
    for g, c in n.items():
        if len(g) > 1 and c >= least and min(h(left[g]), h(right[g])) >= entropy:
            together = min(math.log(c * total / (n[g[:k]] * n[g[k:]])) for k in range(1, len(g)))
            if together >= cohesion:
                out[g] = c, round(together, 6)
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(*r, "clash") for r in corpus()], "doc_id long, text string, tokens string").repartition(3).cache()


@pytest.fixture(scope="module")
def words(texts):
    return segment.learn(texts).cache()


def test_learned(words):
    got = {r.word: (r.n, None if r.cohesion is None else round(r.cohesion, 6)) for r in words.collect()}
    assert got == brute_words([t for _, t in corpus()])
    assert {w for w in got if len(w) > 1} >= {w for w in WORDS if len(w) > 1}


def test_path():
    """Against every way to cut a run."""
    rng = random.Random(2)
    for _ in range(200):
        words = {"".join(rng.choices("abc", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
        lattice = segment.Lattice(list(words.items()))
        run, total = "".join(rng.choices("abcd", k=rng.randint(1, 9))), sum(words.values())
        cost = lambda w: math.log(words[w] / total) if w in words else lattice.unknown if len(w) == 1 else -math.inf
        ways = [[]]
        best = -math.inf
        stack = [(0, 0.0)]
        while stack:
            at, s = stack.pop()
            if at == len(run):
                best = max(best, s)
            stack += [(j, s + c) for j in range(at + 1, len(run) + 1) if (c := cost(run[at:j])) > -math.inf]
        path = lattice.path(run)
        assert "".join(path) == run and ways and abs(sum(map(cost, path)) - best) < 1e-9


def test_segmented(texts, words):
    got = {r.doc_id: r.tokens for r in segment.segment(texts, words).select("doc_id", "tokens").collect()}
    lattice = segment.Lattice([(r.word, r.n) for r in words.collect()])
    for i, t in corpus():
        assert got[i] is None if t is None else all(lattice.path(t[:30]) for _ in [0] if t) and "".join(got[i]) == "".join(c.lower() for c in t if c not in "。， ")
    assert got[5_002] == ["abc", "12"] and got[5_003] == ["龘", "龘"] and got[5_001] == [] and got[5_004] == ["头疼"] * 300
    rng, right = random.Random(1), 0
    for i in range(1_200):
        want = rng.choices(WORDS, k=rng.randint(2, 9))
        rng.choice([0, 0, 0])
        right += got[i][: len(want)] == want
    assert right > 1_000


def test_search_over_segments(spark, texts, words, tmp_path):
    """A word finds the documents that have it as a word; the SQL of BM25 holds on the segmented table."""
    import duckdb

    from millrace.plans import catalogue as C

    rows = segment.segment(texts, words).select("doc_id", segment.joined(F.col("tokens")).alias("text"))
    asked = segment.segment(spark.createDataFrame([(1, "糖尿病吃药"), (2, "龘")], "query_id long, text string"), words)
    index = text_index.TextIndex.build(rows, f"{tmp_path}/index", tokens=segment.spaced)
    found = index.search(asked.select("query_id", segment.joined(F.col("tokens")).alias("text")), 10).collect()
    assert [r.doc_id for r in found if r.query_id == 2] == [5_003]
    pdf = rows.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", pdf)
    tok = C._TOK.replace("regexp_extract_all(lower(text), '[a-z0-9]+')", "list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')")
    sql = f"with {tok} select doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from p join id using (tok), sz where tok in ('糖尿病', '吃', '药') group by 1 order by 2 desc, 1 limit 10"
    assert [(r.doc_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 1] == con.sql(sql).fetchall()


def test_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert segment.learn(none).collect() == [] and segment.segment(none, segment.learn(none)).collect() == []
