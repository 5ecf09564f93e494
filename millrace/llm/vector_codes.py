"""Product-quantisation codes of vectors, their codebooks fitted by the filtering variant of Lloyd's iteration.

Components become integers, floor(``SCALE`` * x), so every sum and distance is exact and the result
is the same however the rows are dealt out. A vector is cut into ``parts`` equal parts, each with a
codebook of its own.

Every task groups its rows into chunks and builds, for each part, a kd-tree over the chunk's parts:
a node holds its bounding box, the sum of its points and their number. The trees are written once
to the shared folder. A round hands them the codebooks (broadcast: parts x entries x length
integers, whatever the input). At a node, the entry nearest to the middle of the box is compared
with every other one: where the whole box is nearer to it, the other is eliminated for the whole
subtree. A node with one entry left is assigned at once by its cached sum and count; only leaves
with several left look at their points. A task returns one row for each entry used of each chunk
and part, which are added up before the shuffle; the driver gets parts x entries sums.

The codebooks start as the parts of the vectors of smallest id. Entries that no part uses stay. All
rows count in all rounds; none is sampled.

Rows whose vector is null or empty or holds null or non-finite components are left out, as are those whose
length isn't the greatest; a length that ``parts`` doesn't divide is filled up with zeros, which
change no distance. Integers beyond +-2^27 are cut there, as distances would leave 64 bits. Null ids
come last and rows with one id in the order of their vectors; repeated rows count one by one. Copies
end in one node, whose box is a point, however many they are. Ties go to the lower index. A null label is a label. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, LIMIT = 1024.0, 1 << 27
#: Rows of a chunk, points from which a node of a tree is cut.
CHUNK, LEAF = 8_192, 32


class Tree:
    """A kd-tree over some points, its nodes level by level; ``first`` is a node's left child (-1: a leaf), the right one follows."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        spans, lo, hi, total, first = [(0, len(points))], [], [], [], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            own = points[self.order[a:b]]
            lo.append(own.min(0))
            hi.append(own.max(0))
            total.append(own.sum(0))
            wide = int((hi[-1] - lo[-1]).argmax()) if own.shape[1] else 0
            if b - a <= LEAF or (lo[-1] == hi[-1]).all():
                first.append(-1)
            else:
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], half)]
                first.append(len(spans))
                spans += [(a, a + half), (a + half, b)]
            at += 1
        self.span, self.first = np.array(spans), np.array(first)
        self.lo, self.hi, self.total = np.array(lo), np.array(hi), np.array(total)

    FIELDS = ("order", "span", "first", "lo", "hi", "total")

    @classmethod
    def of(cls, arrays: dict, prefix: str) -> Tree:
        tree = cls.__new__(cls)
        for f in cls.FIELDS:
            setattr(tree, f, arrays[prefix + f])
        return tree


def _exact(points: np.ndarray, entries: np.ndarray) -> np.dtype:
    """Floats, whose products are fast, where they hold every intermediate result exactly; else integers."""
    most = max([1, *(int(np.abs(x).max()) for x in (points, entries) if x.size)])
    return np.dtype(np.float64 if 8 * max(1, points.shape[1]) * most * most < 1 << 53 else np.int64)


def filtered(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Nodes and the entry that all points of each are nearest to; then leaves with several entries left: nodes, none, and which are left."""
    kind = _exact(np.concatenate([tree.lo, tree.hi]), entries)
    z = entries.astype(kind)
    square = (z * z).sum(1)
    apart: dict[int, np.ndarray] = {}
    nodes, alive = np.array([0]), np.ones((1, len(z)), bool)
    while len(nodes):
        middle2, width = (tree.lo[nodes] + tree.hi[nodes]).astype(kind), (tree.hi[nodes] - tree.lo[nodes]).astype(kind)
        # twice the box's middle times each entry; 2 |m - z|^2 up to what all entries share
        product = middle2 @ z.T
        near = 2 * square - 2 * product
        near[~alive] = near.max() + 1
        best = near.argmin(1)
        # |x - z|^2 - |x - best|^2 is linear in x: its least value over the box, doubled by the doubled middle
        least = square - square[best][:, None] - (product - np.take_along_axis(product, best[:, None], 1))
        for b in np.unique(best).tolist():
            if b not in apart:
                apart[b] = np.abs(z - z[b]).T
            own = best == b
            least[own] -= width[own] @ apart[b]
        keep = (least < 0) | ((least == 0) & (np.arange(len(z)) < best[:, None]))
        alive &= keep
        alive[np.arange(len(nodes)), best] = True
        one = alive.sum(1) == 1
        yield nodes[one], best[one], None
        leaf = tree.first[nodes] < 0
        if (rest := leaf & ~one).any():
            yield nodes[rest], best[rest], alive[rest]
        down = ~leaf & ~one
        nodes = (tree.first[nodes[down]][:, None] + np.array([0, 1])).ravel()
        alive = np.repeat(alive[down], 2, axis=0)


def _nearest(points: np.ndarray, entries: np.ndarray, alive: np.ndarray) -> np.ndarray:
    kind = _exact(points, entries)
    z = entries.astype(kind)
    far = (z * z).sum(1) - 2 * (points.astype(kind) @ z.T)
    far[~alive] = far.max() + 1
    return far.argmin(1)


def _members(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of some nodes, and for each the index of its node among these."""
    a, b = tree.span[nodes].T
    size = b - a
    at = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
    return tree.order[at], np.repeat(np.arange(len(nodes)), size)


def sums(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the number and the sum of the points nearest to it."""
    count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    for nodes, best, alive in filtered(tree, entries):
        if alive is None:
            np.add.at(count, best, tree.span[nodes, 1] - tree.span[nodes, 0])
            np.add.at(total, best, tree.total[nodes])
        else:
            who, node = _members(tree, nodes)
            entry = _nearest(points[who], entries, alive[node])
            np.add.at(count, entry, 1)
            np.add.at(total, entry, points[who])
    return count, total


def assigned(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point."""
    out = np.zeros(len(points), np.int64)
    for nodes, best, alive in filtered(tree, entries):
        who, node = _members(tree, nodes)
        out[who] = best[node] if alive is None else _nearest(points[who], entries, alive[node])
    return out


def _packed(points: np.ndarray, parts: int) -> bytes:
    import zstandard

    width = points.shape[1] // parts
    small = np.int32 if np.abs(points).max(initial=0) < 1 << 31 else np.int64
    arrays = {"points": points.astype(small)}
    for p in range(parts):
        tree = Tree(points[:, p * width : (p + 1) * width])
        for f in Tree.FIELDS:
            a = getattr(tree, f)
            arrays[f"{p}{f}"] = a.astype(np.int32) if f in ("order", "span", "first") else a.astype(small) if f in ("lo", "hi") else a
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpacked(data: bytes, parts: int) -> tuple[np.ndarray, list[Tree]]:
    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as held:
        arrays = {k: held[k].astype(np.int64) for k in held.files}
    return arrays["points"], [Tree.of(arrays, str(p)) for p in range(parts)]


def kept(vectors: DataFrame) -> DataFrame:
    """The rows with a whole vector: vec_id, label and the components times ``SCALE``, rounded down, as integers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where("size(x) > 0").where(F.forall("x", finite))
    limit = F.lit(float(LIMIT))
    whole = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * SCALE, limit), -limit)).cast("long"))
    return rows.select("vec_id", "label", whole.alias("x"))


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The first codebooks, (parts, entries, length): of the greatest length, the vectors of smallest id (at most ``entries`` rows meet on the driver)."""
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    if dim is None:
        return None
    found = rows.where(F.size("x") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = np.array([r.x for r in found], np.int64)
    x = np.pad(x, ((0, 0), (0, -dim % parts)))
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()


def trees(rows: DataFrame, dim: int, parts: int) -> DataFrame:
    """A row for each chunk of a task's rows: their vec_ids and labels, and the blob of points and trees."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, labels, lists = (table.column(i).chunk(0) if table.num_rows else table.column(i) for i in range(3))
            points = np.asarray(lists.flatten()).reshape(len(ids), dim)
            points = np.pad(points, ((0, 0), (0, -dim % parts)))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays([one(ids), one(labels), pa.array([_packed(points, parts)], pa.binary())], names=["ids", "labels", "data"])

        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                while part.num_rows:
                    take = part.slice(0, CHUNK - n)
                    held.append(take)
                    n, part = n + take.num_rows, part.slice(take.num_rows)
                    if n == CHUNK:
                        yield flush()
                        held, n = [], 0
        if n:
            yield flush()

    return common.arrow(rows.where(F.size("x") == dim).select("vec_id", "label", "x"), run, f"ids array<long>, labels array<{label}>, data binary")


def improved(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all chunks."""
    parts, entries, width = books.shape
    sent = chunks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for data in batch.column(0):
                points, held = _unpacked(data.as_py(), parts)
                for p, tree in enumerate(held):
                    c, t = sums(tree, points[:, p * width : (p + 1) * width], sent.value[p])
                    count[p] += c
                    total[p] += t
        part, entry = np.nonzero(count)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), flat], names=["part", "entry", "n", "total"])

    found = common.arrow(chunks.select("data"), run, "part int, entry int, n long, total array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total")).collect()
    out = books.copy()
    for r in added:
        out[r.part, r.entry] = np.array(r.total, np.int64) // r.n
    return out


def encoded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row by the given codebooks."""
    parts, _, width = books.shape
    sent = chunks.sparkSession.sparkContext.broadcast(books)
    label = chunks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points, held = _unpacked(batch.column(2)[i].as_py(), parts)
                codes, error = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
                for p, tree in enumerate(held):
                    own = points[:, p * width : (p + 1) * width]
                    codes[:, p] = entry = assigned(tree, own, sent.value[p])
                    away = own - sent.value[p][entry]
                    error += (away * away).sum(1)
                text = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return common.arrow(chunks.select("ids", "labels", "data"), run, f"vec_id long, label {label}, code string, error long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(rows: DataFrame, most: int = 1_000) -> DataFrame:
    """label_error added: the errors of all rows of a label. Labels of over a ``most``-th of all rows, fewer than ``most``, are
    broadcast; the others, none of which is hot, are joined by a shuffle."""
    labels = common.save(rows.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error")), "labels")
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > total // most
    few = labels.where(often).select(F.col("label").alias("own"), "label_error")
    rare = labels.where(~often).select(F.col("label").alias("own"), "label_error")
    same = F.col("label").eqNullSafe(F.col("own"))
    hot = rows.join(F.broadcast(few), same, "inner")
    rest = rows.join(F.broadcast(few), same, "left_anti").join(rare, same, "inner")
    return hot.unionByName(rest).drop("own")


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code, error of every kept row of (vec_id, embedding, label), and the codebooks (parts, entries, length; none without a row).
    A code has two hexadecimal digits for each part, so there are at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code's part is one byte: 1 to 256 entries")
    rows = kept(vectors)
    books = first_entries(rows, parts, entries)
    if books is None:
        label = vectors.schema["label"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), None
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    chunks = common.save(trees(rows, dim, parts), "trees")
    for _ in range(rounds):
        books = improved(chunks, books)
    return common.save(encoded(chunks, books), "codes"), books


def code_table(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    rows, books = vector_codes(vectors, parts, entries, rounds)
    sha = F.lit(None if books is None else books_sha256(books)).cast("string")
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


def sql(rounds: int = 4, parts: int = 4) -> str:
    """The same by whole comparisons of parts with entries."""
    dist = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.z[i]) * (v.x[i] - c.z[i])))"
    out = f"""with k as materialized (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda e: floor(1024.0::double * e::double)::bigint) as w from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
v as materialized (select r, vec_id, label, p, w[p * len(w) // {parts} + 1 : (p + 1) * len(w) // {parts}] as x from k, range({parts}) t(p)),
c0 as materialized (select p, row_number() over (partition by p order by r) - 1 as e, x as z from v qualify e < 256)"""
    for i in range(rounds + 1):
        out += f""",
a{i} as materialized (select r, any_value(v.vec_id) as vec_id, any_value(v.label) as label, v.p, any_value(x) as x, min({dist} * 256 + e) as b from v join c{i} c on c.p = v.p group by r, v.p)"""
        if i < rounds:
            out += f""",
s{i} as materialized (select p, e, list(m order by d) as z from (select p, b % 256 as e, d, floor(sum(x[d])::hugeint / count(*))::bigint as m from a{i}, (select unnest(range(1, (select max(len(x)) from v) + 1)) as d) group by 1, 2, 3) group by 1, 2),
c{i + 1} as materialized (select p, e, coalesce(s{i}.z, c{i}.z) as z from c{i} left join s{i} using (p, e))"""
    return out + f""",
f as (select vec_id, label, string_agg(printf('%02x', b % 256), '' order by p) as code, sum(b // 256)::bigint as error from a{rounds} group by r, vec_id, label),
h as (select sha256(string_agg(array_to_string(z, ','), ',' order by p, e)) as codebooks_sha256 from c{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from f, h"""


SQL = sql()
