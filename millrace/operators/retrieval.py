"""Nearest neighbours, BM25, rank fusion, calibrated label vote, retrieval metrics."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import plug

#: Bytes of query vectors broadcast at once; more go through in blocks.
QUERY_BYTES = 16 << 20
#: Queries and rows of one matrix product.
TILE, ROWS = 2_048, 1_024
#: Text queries held by a task at once, documents of one product, and kinds of both. Of the so many most frequent words those whose shares of a kind of
#: documents and of a tile of queries make more than the square of this are scored by a matrix product.
TEXT_BLOCK, TEXT_ROWS, KINDS, OFTEN, MOST_OFTEN = 16_384, 512, 8, 0.04, 2_000


def _nearest(batches, given, k: int, label_type):
    """The k nearest rows of a task for every query, of (vec_id, embedding, label): query_id, vec_id, label, dist.

    Products of blocks find which rows can be among them; those rows' distances are then taken element by element.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, points, wanted, values = given.value
    n, dim = points.shape
    square, least = (points * points).sum(1), np.full(n, np.inf)
    none = np.zeros(0, np.int64)
    held = {lo: (none, none, np.zeros(0), np.zeros(0, object)) for lo in range(0, n, TILE)}
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            fits = pc.and_(pc.equal(pc.list_value_length(batch.column(1)), dim), pc.is_valid(batch.column(0)))
            batch = batch.filter(pc.fill_null(fits, False))
            rows = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            whole_rows = np.isfinite(rows).all(1)
            rows, batch = rows[whole_rows], batch.filter(pa.array(whole_rows, pa.bool_()))
            if not len(rows):
                continue
            vec, labels, row_square = batch.column(0).to_numpy(), batch.column(2), (rows * rows).sum(1)
            code = None if wanted is None else pc.fill_null(pc.index_in(labels, value_set=values), -1).to_numpy(zero_copy_only=False)
            for lo in held:
                hi = min(lo + TILE, n)
                far = square[lo:hi, None] + row_square - 2 * (points[lo:hi] @ rows.T)
                far[ids[lo:hi, None] == vec] = np.inf
                if code is not None:
                    far[wanted[lo:hi, None] != code] = np.inf
                bound = least[lo:hi]
                if len(rows) > k and np.isinf(bound).any():
                    bound = np.minimum(bound, np.partition(far, k - 1, axis=1)[:, k - 1])
                slack = 1e-8 + 1e-12 * (square[lo:hi].max() + row_square.max())  # rounding, of products and of distances
                q, r = np.nonzero((far <= (bound + slack)[:, None]) & (far < np.inf))
                if not len(q):
                    continue
                dist = np.empty(len(q))
                for i in range(0, len(q), 65_536):
                    away = rows[r[i : i + 65_536]] - points[lo + q[i : i + 65_536]]
                    dist[i : i + 65_536] = np.round((away * away).sum(1), 9)
                near = np.empty(len(q), object)
                near[:] = labels.take(pa.array(r)).to_pylist()
                q, v, dist, near = (np.concatenate(x) for x in zip(held[lo], (q, vec[r], dist, near), strict=True))
                order = np.lexsort((v, dist, q))
                q = q[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                order, q, place = order[place < k], q[place < k], place[place < k]
                held[lo] = q, v[order], dist[order], near[order]
                last = place == k - 1
                least[lo + q[last]] = held[lo][2][last]
    for lo, (q, v, dist, near) in held.items():
        columns = [pa.array(ids[lo + q], pa.int64()), pa.array(v, pa.int64()), pa.array(near.tolist(), label_type), pa.array(dist)]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "label", "dist"])


def knn(corpus: DataFrame, queries: DataFrame, k: int, filter_label: bool = False) -> DataFrame:
    """query_id, vec_id, label, dist, rank (and query_label) of the k nearest corpus vectors by squared L2 distance.

    ``queries`` (query_id, query[, query_label]) is a set that the caller states: it is held against all rows,
    a block of bounded bytes at a time, each of which reads the corpus once; a task hands on k rows per query.
    A query's own row (vec_id = query_id) doesn't count; ties go to the smaller id. Rows and queries without an
    id, with a null or an element that is no finite number, or not of the queries' (greatest) length have no distance.
    """
    wide = queries.agg(F.count("*").alias("n"), F.max(F.size("query")).alias("dim")).first()
    dim = max(1, wide.dim or 1)
    n = max(1, -(-wide.n * dim * 8 // QUERY_BYTES))
    blocks = [queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]
    found = functools.reduce(DataFrame.unionByName, [_knn(corpus, b, k, dim, filter_label) for b in blocks])
    if filter_label:
        found = found.withColumn("query_label", F.col("label"))
    w = Window.partitionBy("query_id", *(["query_label"] if filter_label else [])).orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _knn(corpus: DataFrame, block: DataFrame, k: int, dim: int, filter_label: bool) -> DataFrame:
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    label = corpus.schema["label"].dataType
    label_type = to_arrow_type(label)
    block = block.where(F.col("query_id").isNotNull() & (F.size("query") == dim))
    wanted = F.col("query_label").cast(label) if filter_label else F.lit(None).cast(label)
    given = block.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>"), wanted.alias("query_label")).toArrow().combine_chunks()
    points = given["query"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    whole = np.isfinite(points).all(1)
    codes = values = None
    if filter_label:
        coded = given["query_label"].combine_chunks().dictionary_encode()
        values = coded.dictionary
        codes = coded.indices.fill_null(-2).to_numpy(zero_copy_only=False)[whole]
    sent = corpus.sparkSession.sparkContext.broadcast((given["query_id"].to_numpy()[whole], points[whole], codes, values))
    rows = corpus.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    return rows.mapInArrow(lambda batches: _nearest(batches, sent, k, label_type), f"query_id long, vec_id long, label {label.simpleString()}, dist double")


def prior(corpus: DataFrame, missing: str = "未知科室") -> DataFrame:
    """label, prior: how many rows have each label; none is a label of its own."""
    return corpus.groupBy(F.coalesce("label", F.lit(missing)).alias("label")).agg(F.count("*").alias("prior"))


def vote(neighbours: DataFrame, prior: DataFrame, top: int = 5, invalid: tuple = ()) -> DataFrame:
    """Labels by count squared over expected count; counts leave invalid labels out, the number retrieved doesn't."""
    n = neighbours.groupBy("query_id").agg(F.count("*").alias("n"))
    valid = neighbours.where(~F.col("label").isin(*invalid)) if invalid else neighbours
    counts = valid.groupBy("query_id", "label").agg(F.count("*").alias("cnt"), F.min("rank").alias("first_rank"))
    total = prior.agg(F.sum("prior").alias("total"))
    scored = counts.join(n, "query_id").join(prior, "label", "left").crossJoin(F.broadcast(total))
    expected = F.col("n") * F.coalesce("prior", F.lit(1)) / F.col("total")
    scored = scored.withColumn("score", F.when(expected > 0, F.col("cnt") * F.col("cnt") / expected).otherwise(0.0))
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank"))).where(F.col("place") <= top)
    share = F.col("score") / F.sum("score").over(Window.partitionBy("query_id"))
    return ranked.select("query_id", "label", F.col("cnt").cast("long").alias("cnt"), F.round("score", 6).alias("score"), F.round(share, 6).alias("confidence"), F.col("place").cast("long").alias("place"))


def postings(docs: DataFrame, terms: list[str] | None = None, tokens: Callable[[Column], Column] = plug.latin_tokens) -> DataFrame:
    """doc_id, tok, tf, dl of the tokens (lower-cased alphanumeric ones by default), or of those among ``terms`` alone."""
    t = F.col("t") if terms is None else F.filter("t", lambda x: x.isin(*terms))
    rows = docs.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), t.alias("t"))
    return rows.select("doc_id", "dl", F.explode("t").alias("tok")).groupBy("doc_id", "tok").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_stats(docs: DataFrame, epsilon: float = 0.25, tokens: Callable[[Column], Column] = plug.latin_tokens) -> tuple[DataFrame, DataFrame]:
    """(tok, df, idf) with negative idf floored, and one row (n, avgdl). Documents without tokens count.

    Each document gives its distinct tokens once, counted before the shuffle; no postings are moved."""
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("text"))).cast("double")).alias("avgdl"))
    df = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    return _idf(df, size, epsilon), size


def _idf(df: DataFrame, size: DataFrame, epsilon: float = 0.25) -> DataFrame:
    raw = df.crossJoin(F.broadcast(size)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("tok", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_search(docs: DataFrame, terms: list[str], k: int = 20, k1: float = 1.5, b: float = 0.75, tokens: Callable[[Column], Column] = plug.latin_tokens) -> DataFrame:
    """doc_id, score, rank of the k best; cut to k first, then scores of 0 or less go. A term given twice counts twice."""
    idf, size = bm25_stats(docs, tokens=tokens)
    wanted = docs.sparkSession.createDataFrame([(t,) for t in terms], "tok string").groupBy("tok").agg(F.count("*").alias("times"))
    hits = postings(docs, terms, tokens).join(F.broadcast(wanted), "tok").join(idf.where(F.col("tok").isin(*terms)), "tok").crossJoin(F.broadcast(size))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    top = scores.orderBy(F.desc("score"), "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long")).where("score > 0")


def _counted(batches):
    """Texts in lower case (doc_id, text) by their words, as of ``plug.latin_tokens``: doc_id, dl (null without a text), words (different ones), tf.

    Words and counts are one value a text: lists of strings take longer to write and read than all else here."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    letter = np.zeros(256, bool)
    letter[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
    for whole in batches:
        for lo in range(0, whole.num_rows, 1_024):
            batch = whole.slice(lo, 1_024)
            text, n = batch.column(1).cast(pa.string()), batch.num_rows
            at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            at = at - at[0]
            within = letter[data]
            first = within.copy()
            first[1:] &= ~within[:-1]
            heads = at[:-1][at[:-1] < len(data)]
            first[heads] = within[heads]
            kept, cuts = data[within], np.append(np.flatnonzero(first[within]), within.sum()).astype(np.int32)
            words = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(kept)).dictionary_encode()
            row = np.searchsorted(at, np.flatnonzero(first), side="right") - 1
            key, tf = np.unique(row * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
            found, tok = np.divmod(key, max(1, len(words.dictionary)))
            cut = pa.array(np.searchsorted(found, np.arange(n + 1)), pa.int32())
            dl = pa.array(np.bincount(row, minlength=n), pa.int32(), mask=pc.is_null(text).to_numpy(zero_copy_only=False))
            joined = pc.binary_join(pa.ListArray.from_arrays(cut, words.dictionary.take(pa.array(tok))), " ")
            times = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cut.to_numpy() * np.int32(4)), pa.py_buffer(tf.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), dl, joined, times], names=["doc_id", "dl", "words", "tf"])


def _split(joined):
    """Words of texts as ``_counted`` joins them, and how many each has."""
    import pyarrow.compute as pc

    lists = pc.split_pattern(joined, " ")
    words, size = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).copy()
    size[pc.equal(joined, "").to_numpy(zero_copy_only=False)] = 0
    return words.filter(pc.not_equal(words, "")), size


def _times(values):
    """The counts of texts' words, in one row."""
    import numpy as np

    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer((values.buffers()[2] or b"")[at[0] : at[-1]] if at[-1] else b"", "<i4")


def _counts(docs: DataFrame) -> DataFrame:
    """doc_id, dl, words, tf of texts (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(_counted, "doc_id long, dl int, words string, tf binary")


def _terms(counts: DataFrame) -> DataFrame:
    """doc_id, tok, tf: a row for each word of each text."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                words, size = _split(some.column(1))
                ids = np.repeat(some.column(0).to_numpy(zero_copy_only=False), size)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), words, pa.array(_times(some.column(2)), pa.int32())], names=["doc_id", "tok", "tf"])

    return counts.select("doc_id", "words", "tf").mapInArrow(rows, "doc_id long, tok string, tf int")


def _held(batches):
    """How many documents of each batch hold each word: tok, df."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        found = pc.value_counts(_split(batch.column(0))[0])
        yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["tok", "df"])


def _scores(batches, given, k: int, k1: float, b: float, avgdl: float):
    """The k best documents of a task for every query, of (doc_id, dl, words, tf): query_id, doc_id, score.

    Sums in single precision, whose error is bounded, find which documents can be among them; those are then scored in double precision.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    vocabulary, idf, middles, tiles = given.value
    common, none = middles.shape[1], np.zeros(0, np.int64)
    held, fresh = [(none, none, np.zeros(0)) for _ in tiles], [[] for _ in tiles]
    least = [np.zeros(len(ids)) for ids, *_ in tiles]
    mixed = (idf < 0).any()

    def runs(starts, many):
        return np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)

    def merge(t):
        q, d, sc = (np.concatenate(x) for x in zip(held[t], *fresh[t], strict=True))
        order = np.lexsort((d, -sc, q))
        q, d, sc = q[order], d[order], sc[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        least[t][q[place == k - 1]] = sc[place == k - 1]
        held[t], fresh[t] = (q[place < k], d[place < k], sc[place < k]), []

    def score(docs, row, tok, part, kind, own):
        """One kind's documents against the tiles of queries of that kind, or of the others."""
        m, of = len(docs), tok < common
        often = np.zeros((m, common))
        often[row[of], tok[of]] = part[of]
        error = (np.bincount(row[of]).max(initial=0) + 8) * 2.0**-23  # twice that of a sum of as many products as are not 0
        for t, (ids, its_kind, by_kind, at, query, times, reach) in enumerate(tiles):
            if (its_kind == kind) != own:
                continue
            n, (dense, hot, columns) = len(ids), by_kind[kind]
            wide = often[:, columns]
            sums = wide.astype(np.float32) @ dense.T
            some = np.flatnonzero(~hot[np.minimum(tok, common)] & (at[tok + 1] > at[tok]))
            many = at[tok[some] + 1] - at[tok[some]]
            pos = runs(at[tok[some]], many)
            seldom = np.bincount(np.repeat(row[some] * n, many) + query[pos], np.repeat(part[some], many) * times[pos], m * n).astype(np.float64, copy=False).reshape(m, n)
            sums += seldom
            slack = lambda x, q: error * ((k1 + 1) * reach[q] if mixed else x) + 2e-6  # noqa: B023, E731 - scores are rounded to 6 digits
            low = np.maximum(least[t] - slack(least[t], slice(None)), 0).astype(np.float32)
            fits = sums >= low
            crowd = np.flatnonzero(np.count_nonzero(fits, axis=0) > k + 1) if m > k + 1 else none
            if len(crowd):  # k others of these documents are better than what is below
                enough = np.partition(sums[:, crowd], m - k - 1, axis=0)[m - k - 1]
                low[crowd] = np.maximum(low[crowd], enough - 2 * slack(enough, crowd))
                fits[:, crowd] = sums[:, crowd] >= low[crowd]
            r, q = np.divmod(np.flatnonzero(fits), n)
            other = docs[r] != ids[q]
            r, q = r[other], q[other]
            if not len(q):
                continue
            exact = seldom[r, q]
            if len(q) * 64 > m * n:
                exact += (wide @ dense.T.astype(np.float64))[r, q]
            else:
                for i in range(0, len(q), 64):
                    exact[i : i + 64] += (wide[r[i : i + 64]] * dense[q[i : i + 64]]).sum(1)
            exact = np.round(exact, 6)
            fine = (exact >= least[t][q]) & (exact > 0)
            fresh[t].append((q[fine], docs[r[fine]], exact[fine]))
            if 2 * sum(len(x[0]) for x in fresh[t]) >= len(held[t][0]):
                merge(t)

    for whole in batches:
        every = pc.fill_null(whole.column(1), 0).to_numpy(zero_copy_only=False)
        words, size = _split(whole.column(2))
        times_in = _times(whole.column(3))
        coded = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(size)])
        for start in range(0, whole.num_rows, TILE):
            docs, dl = whole.column(0).slice(start, TILE).to_numpy(zero_copy_only=False), every[start : start + TILE]
            held_in = slice(first[start], first[start + len(dl)])
            known = np.flatnonzero(coded[held_in] >= 0)
            row, tok, tf = np.repeat(np.arange(len(dl)), size[start : start + TILE])[known], coded[held_in][known], times_in[held_in][known]
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl)) * idf[tok]
            kinds, at = _kinds(row, tok, len(dl), middles), np.searchsorted(row, np.arange(len(dl) + 1))
            for own, kind in itertools.product((True, False), range(len(middles))):  # the best are mostly of a query's kind
                of_kind = np.flatnonzero(kinds == kind)
                for i in range(0, len(of_kind), TEXT_ROWS):
                    rows = of_kind[i : i + TEXT_ROWS]
                    many = at[rows + 1] - at[rows]
                    pos = runs(at[rows], many)
                    score(docs[rows], np.repeat(np.arange(len(rows)), many), tok[pos], part[pos], kind, own)
    for t, (ids, *_) in enumerate(tiles):
        merge(t)
        q, d, sc = held[t]
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(d, pa.int64()), pa.array(sc)], names=["query_id", "doc_id", "score"])


def _kinds(row, tok, n: int, middles):
    """The nearest middle of each of n texts, by which of the words that the middles weigh they hold; of (text, word), sorted by text."""
    import numpy as np

    common, kinds = middles.shape[1], np.zeros(n, np.int64)
    for lo in range(0, n, 512):
        a, z = np.searchsorted(row, [lo, min(n, lo + 512)])
        mine = tok[a:z] < common
        has = np.zeros((min(n, lo + 512) - lo, common), np.float32)
        has[row[a:z][mine] - lo, tok[a:z][mine]] = 1
        kinds[lo : lo + 512] = (has @ middles.T).argmax(1)
    return kinds


def _middles(row, tok, n: int, common: int):
    """Middles of kinds (of languages, say) of n texts, over their most frequent words: unit vectors, of a sample's rounds of nearest ones.

    Kinds decide what is scored by products and how fast, not the results."""
    import numpy as np

    mine = (row % -(-n // 2_048) == 0) & (tok < common)
    at, row = np.unique(row[mine], return_inverse=True)
    has = np.zeros((max(1, len(at)), common), np.float32)
    has[row, tok[mine]] = 1
    has *= np.log((len(has) + 1) / (has.sum(0) + 1))  # what all have tells nothing
    has /= np.maximum(np.sqrt((has * has).sum(1)), 1e-9)[:, None]
    middles = has[:1]
    while len(middles) < min(KINDS, len(has)):
        middles = np.vstack([middles, has[[(has @ middles.T).max(1).argmin()]]])
    for _ in range(8):
        kinds = (has @ middles.T).argmax(1)
        sums = np.array([has[kinds == i].sum(0) for i in range(len(middles)) if (kinds == i).sum() * 64 >= len(has)])
        middles = sums / np.maximum(np.sqrt((sums * sums).sum(1)), 1e-9)[:, None]
    return (middles * np.log((len(has) + 1) / ((has > 0).sum(0) + 1))).astype(np.float32)


def bm25_queries(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents of each query (query_id, text), as of ``bm25_search`` for its tokens.

    Every document is held against every query: words of many queries by a matrix product, the others
    by their postings. The documents' words, the statistics and the queries' words are worked out once; then a block of queries goes to the executors
    at a time, and a task hands on k rows per query. The work grows with documents times queries, what a task holds doesn't.
    A query's own document (doc_id = query_id) doesn't count. Ids are unique and not null.
    """
    counts = shared.saved(_counts(docs), "counts")
    size = counts.agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    held = counts.select("words").mapInArrow(_held, "tok string, df long").groupBy("tok").agg(F.sum("df").alias("df"))
    idf, avgdl = _idf(shared.saved(held, "held"), size), size.first().avgdl or 1.0
    n = queries.count()
    n = 1 if n <= TEXT_BLOCK else -(-n // TEXT_BLOCK) + 1
    terms = _terms(_counts(queries.select(F.col("query_id").alias("doc_id"), "text"))).join(idf.hint("merge"), "tok")
    terms = shared.saved(terms.select(F.col("doc_id").alias("query_id"), "tok", "tf", "idf", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("block")), "terms")
    best = functools.reduce(DataFrame.unionByName, [_bm25_block(counts, terms.where(F.col("block") == i), avgdl, k, k1, b) for i in range(n)])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _bm25_block(counts: DataFrame, terms: DataFrame, avgdl: float, k: int, k1: float, b: float) -> DataFrame:
    """query_id, doc_id, score: of each task's documents (doc_id, dl, words, tf) the k best of each query of a block (query_id, tok, tf, idf)."""
    import numpy as np
    import pyarrow as pa

    given = terms.select("query_id", "tok", "tf", "idf").toArrow().combine_chunks()
    word = given["tok"].combine_chunks().dictionary_encode() if len(given) else pa.array([], pa.string()).dictionary_encode()
    tok, times = word.indices.to_numpy(), given["tf"].to_numpy().astype(np.float32)
    idf = np.zeros(len(word.dictionary))
    idf[tok] = given["idf"].to_numpy()
    ids, query = np.unique(given["query_id"].to_numpy(), return_inverse=True)
    held_by = np.bincount(tok, minlength=len(idf))
    by_use = np.argsort(-held_by, kind="stable")
    tok, idf, vocabulary = np.argsort(by_use)[tok], idf[by_use], word.dictionary.take(pa.array(by_use))
    common = min(MOST_OFTEN, int((held_by > 1).sum()))
    order = np.lexsort((tok, query))
    tok, query, times = tok[order], query[order], times[order]
    middles = _middles(query, tok, len(ids), common)
    kinds = _kinds(query, tok, len(ids), middles)
    share = np.array([np.bincount(tok[kinds[query] == i], minlength=len(idf))[:common] / max(1, (kinds == i).sum()) for i in range(len(middles))])
    by_kind = np.argsort(kinds, kind="stable")
    cuts = np.unique([x for i in range(len(middles)) for x in range(np.searchsorted(kinds[by_kind], i), np.searchsorted(kinds[by_kind], i + 1), TILE)])
    tiles = []
    for members in np.split(by_kind, cuts[1:].astype(int)):
        n, place = len(members), np.full(len(ids), -1)
        place[members] = np.arange(n)
        mine = np.flatnonzero(place[query] >= 0)
        mine = mine[np.lexsort((place[query[mine]], tok[mine]))]
        tok_, query_, times_ = tok[mine], place[query[mine]], times[mine]
        at = np.concatenate([[0], np.cumsum(np.bincount(tok_, minlength=len(idf)))])
        dense = np.zeros((n, common), np.float32)
        dense[query_[tok_ < common], tok_[tok_ < common]] = times_[tok_ < common]
        own, products = np.diff(at)[:common] / max(1, n), []
        for i in range(len(middles)):
            hot = share[i] * own > OFTEN * OFTEN
            products.append((np.ascontiguousarray(dense[:, hot]), np.append(hot, False), np.flatnonzero(hot)))
        reach = np.bincount(query_, times_ * np.abs(idf[tok_]), n)
        tiles.append((ids[members].astype(np.int64), kinds[members[0]] if n else 0, products, at.astype(np.int32), query_.astype(np.int32), times_, reach))
    sent = counts.sparkSession.sparkContext.broadcast((vocabulary, idf, middles, tiles))
    return counts.mapInArrow(lambda batches: _scores(batches, sent, k, k1, b, avgdl), "query_id long, doc_id long, score double")


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, key, rank) lists: sum of 1 / (k + rank), ranks from 1; equal keys merge."""
    both = None
    for i, x in enumerate(lists):
        x = x.select("query_id", "key", "rank", F.lit(i).alias("list"))
        both = x if both is None else both.unionByName(x)
    fused = both.groupBy("query_id", "key").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen", "key")
    return fused.withColumn("place", F.row_number().over(w).cast("long")).select("query_id", "key", F.round("score", 9).alias("score"), "place")


def metrics(neighbours: DataFrame, expected: DataFrame) -> DataFrame:
    """Hit@1, 3, 5, mean reciprocal rank and miss rate of (query_id, rank, label) against (query_id, expected array)."""
    best = expected.join(neighbours, "query_id", "left").groupBy("query_id").agg(F.min(F.when(F.array_contains("expected", F.col("label")), F.col("rank"))).alias("r"))
    hit = lambda n: F.bround(F.avg(F.coalesce((F.col("r") <= n).cast("double"), F.lit(0.0))), 4)
    return best.agg(
        F.count("*").alias("cases"), hit(1).alias("hit1"), hit(3).alias("hit3"), hit(5).alias("hit5"),
        F.bround(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 4).alias("mrr"), F.bround(F.avg(F.col("r").isNull().cast("double")), 4).alias("miss"),
    )
