"""Exact n-gram Jaccard join in the metric space of shingle sets.

Documents with one and the same set are joined first. Sets that cannot have another within the radius
r = 1 - threshold then leave: two such sets share a shingle among the first n - ceil(threshold * n) + 1
of either in any common order, and their parity bitmaps (each shingle flips one bit) differ in no more
bits than the sets differ in shingles. Sets that share such a shingle and whose sizes and bitmaps fit
are put into one group; no two groups need to be compared. The order puts shingles that many
prefixes share last, so that a passage that is found everywhere gathers nothing. (Pivots cannot part the
whole corpus: nearly all documents are farther than 1 - 2r from all of them, and so in every window.)

Every group is joined by pivots. Sets go to the Voronoi cell of the nearest pivot, if that is within
``REACH``, and by the triangle inequality also to every cell whose pivot is at most 2r farther away and
within ``REACH`` + r; sets farther than ``REACH`` - r from all pivots are joined among themselves, by pivots of
their own. Cells are split again while that makes them smaller, and joined exactly otherwise, each set
against those whose distance to the pivot differs by at most r and that are not connected with it yet. A group of over ``REGION`` shingles is
parted by the same rule over many tasks: its pivots go to blocks of its sets, which give the distances,
and the cells are the next round's groups. Sets within the radius of a cell's pivot are linked by it, so
a cell that has no others is done. What is still too large after ``ROUNDS`` rounds is joined in blocks:
sets not linked to the cell's pivot against all of its sets.

Null and empty texts have the empty set and are linked with nothing. A null doc_id is a document of
its own. Repeated rows have the same set; rows with one doc_id are one document, linked, whatever their
texts. Ties (equal distances, equal hashes of different sizes) have no effect on the result. Texts of any
length are hashed whole, a megabyte at a time. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

#: Shingles of a group joined in one task; most shingles that the order may put last (8 bytes each, broadcast); least number of prefixes that share such a one.
REGION, LAST, OFTEN = 2_000_000, 1 << 20, 24
#: Members above which a group is split by Voronoi cells; pivots of a split; most splits of a task within each other; rounds of splits over many tasks.
CELL, PIVOTS, DEPTH, ROUNDS = 2, 8, 8, 3
#: Greatest distance of a set from the pivot whose cell it is in; sets farther from all pivots are the rest, which gets pivots of its own.
REACH = 0.5
#: Most members of groups (24 bytes each) that are broadcast to the texts.
FEW = 1_000_000
#: Least and most bits of a bitmap (powers of two; in between the least one that is not below the set's size).
BITS = 64, 1 << 16
_PREFIX = np.dtype([("key", "<u8"), ("set", "<u8"), ("n", "<u4")])
_COUNT = np.dtype([("key", "<u8"), ("n", "<u4")])


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; all its words as one if they are fewer."""
    hashes, at = common.word_hashes(texts, lower=True)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(common.gram_hashes(hashes[a:b], min(k, b - a))) if b > a else np.zeros(0, U64)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles at each place; a wider bitmap folds to a narrower one by XOR of its halves."""
    width = min(max(BITS[0], 1 << (len(s) - 1).bit_length()), BITS[1])
    return np.packbits((np.bincount((s & U64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps, as 64-bit words, folded to this many words."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch, raw in (piece for whole in batches for piece in common.pieces(whole)):
            n, digest, bits = [], [], []
            for lo, hi in common.sliced(raw):
                for s in shingle_sets(raw[lo:hi], k):
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bits.append(bitmap(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "n", "digest", "bits"])

    return common.arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, digest binary, bits binary")


def _name(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def _prefixes(docs: DataFrame, k: int, num: int, den: int, n_buckets: int, last=None) -> DataFrame:
    """Packed (shingle, set, set size) of every set's prefix in the order: ordinary shingles, then those put last, by hash.
    Without ``last``, in the order of hashes, and packed (shingle, how many prefixes of a stretch of the task have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        out, late = common.Packer(_COUNT if last is None else _PREFIX, n_buckets), last.value if last is not None else np.zeros(0, U64)
        keys, names, sizes, held = [], [], [], 0

        def put() -> Iterator[pa.RecordBatch]:
            key, name, n = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((U64, keys), (U64, names), (np.uint32, sizes)))
            order = np.lexsort((name, key))
            order = order[np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(name[order]) != 0)])[: len(order)]]
            if last is None:
                yield from out.add(*np.unique(key[order], return_counts=True))
            else:
                yield from out.add(key[order], name[order], n[order])
            for x in (keys, names, sizes):
                x.clear()

        for _, raw in (piece for whole in batches for piece in common.pieces(whole)):
            for lo, hi in common.sliced(raw):
                for s in shingle_sets(raw[lo:hi], k):
                    if not len(s):
                        continue
                    p = prefix_length(len(s), num, den)
                    name, n = _name(xxhash.xxh3_128_digest(s.tobytes())), len(s)
                    if len(late):
                        put_last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                        s = np.concatenate([s[~put_last], s[put_last]])
                    keys.append(s[:p])
                    names.append(np.full(p, name, U64))
                    sizes.append(np.full(p, n, np.uint32))
                    held += p
                    if held >= 500_000:
                        yield from put()
                        held = 0
        yield from put()
        yield from out.flush()

    return common.arrow(docs.select("text"), run, common.Packer.SCHEMA)


def _distinct(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records without repetition in the order of (key, hash of set), and where each key begins."""
    order = np.lexsort((common.mix(records["set"]), records["key"]))
    r = records[order]
    r = r[np.concatenate([[True], (r["key"][1:] != r["key"][:-1]) | (r["set"][1:] != r["set"][:-1])])]
    return r, np.flatnonzero(np.concatenate([[True], r["key"][1:] != r["key"][:-1]]))


def _often(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys, at = np.unique(records["key"], return_inverse=True)
    n = np.bincount(at, records["n"]).astype(np.int64)
    hit = n >= OFTEN
    yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), pa.array(n[hit], pa.int64())], names=["key", "n"])


def _gather(num: int, den: int):
    def run(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        r, starts = _distinct(records)
        group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(r)]])))
        # only sets with another of fitting size in the gathering can link there
        by_size = np.lexsort((r["n"], group))
        n, g = r["n"][by_size].astype(np.int64), group[by_size]
        fits = (g[1:] == g[:-1]) & (den * n[:-1] >= num * n[1:])
        keep = np.zeros(len(r), bool)
        keep[by_size[np.concatenate([fits, [False]]) | np.concatenate([[False], fits])]] = True
        r, group = r[keep], group[keep]
        if len(r):
            first = np.concatenate([[True], group[1:] != group[:-1]])
            pivot = r["set"][np.flatnonzero(first)][np.cumsum(first) - 1]
            pairs = np.unique(np.stack([pivot, r["set"]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["region", "set"])

    return run


class Region:
    """The exact join of some sets, as far as their components need it."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.radius = num, den, 1 - num / den
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.vocabulary, items = np.unique(np.concatenate(sets), return_inverse=True)
        self.items = items.astype(np.int32)
        self.component = np.arange(len(sets))
        often = np.bincount(self.items)
        self.central = np.add.reduceat(often[self.items], self.start[:-1]) / self.size
        self.flag = np.zeros(len(self.vocabulary), bool)

    def against(self, x: int, members: np.ndarray) -> np.ndarray:
        """Shingles that x shares with each member."""
        mine = self.items[self.start[x] : self.start[x + 1]]
        self.flag[mine] = True
        if len(members) == len(self.size):
            out = np.add.reduceat(self.flag[self.items].astype(np.int64), self.start[:-1])[members]
        else:
            size = self.size[members]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[members], size)
            out = np.add.reduceat(self.flag[self.items[at]].astype(np.int64), np.cumsum(size) - size)
        self.flag[mine] = False
        return out

    def distances(self, x: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from x, and which are within the radius: that is compared in whole numbers."""
        common_ = self.against(x, members)
        union = self.size[x] + self.size[members] - common_
        return 1 - common_ / union, self.den * common_ >= self.num * union

    def link(self, x: int, members: np.ndarray) -> np.ndarray:
        """Distances from x; members within the radius come to x's component."""
        distance, near = self.distances(x, members)
        self.component[np.isin(self.component, np.unique(self.component[members[near]]))] = self.component[x]
        return distance

    def cells(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distances (pivots, sets): the sets of each pivot's cell with its window, and those of the rest with its own."""
        near = d.min(0)
        return d <= np.minimum(near + 2 * self.radius, REACH + self.radius) + 1e-9, near > REACH - self.radius - 1e-9

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        while True:
            if len(members) < 2 or (self.component[members] == self.component[members[0]]).all():
                return
            members = members[np.argsort(-self.central[members], kind="stable")]
            pivot = int(members[0])
            first = self.link(pivot, members)
            if (self.component[members] == self.component[pivot]).all():
                return
            if len(members) <= CELL or depth >= DEPTH:
                break
            far, distances = first, [first]
            for _ in range(min(PIVOTS, len(members) - 1) - 1):  # farthest first
                p = int(members[np.argmax(far)])
                distances.append(self.link(p, members))
                far = np.minimum(far, distances[-1])
            cells, rest = self.cells(np.stack(distances))
            if cells.sum(1).max() == len(members) or rest.all() or cells.sum() > 1.5 * len(members):
                break
            for cell in cells:
                self.join(members[cell], depth + 1)
            members = members[rest]
        order = np.argsort(first, kind="stable")
        members, first = members[order], first[order]
        probes = np.argsort(-self.central[members], kind="stable")
        for i in probes.tolist():
            x = members[i]
            lo, hi = np.searchsorted(first, [first[i] - self.radius - 1e-9, first[i] + self.radius + 1e-9])
            rest = members[lo:hi]
            n, m = self.size[x], self.size[rest]
            rest = rest[(self.component[rest] != self.component[x]) & (self.den * np.minimum(n, m) >= self.num * np.maximum(n, m))]
            if len(rest):
                self.link(int(x), rest)


def fitting(sizes: np.ndarray, maps: list[bytes], num: int, den: int) -> np.ndarray:
    """A label for each set: sets whose sizes and bitmaps allow the threshold, directly or by way of others, have the same."""
    label, width = np.full(len(sizes), -1), np.fromiter(map(len, maps), np.int64, len(maps)) // 8
    rows = {w: np.frombuffer(b"".join(maps[i] for i in at), U64).reshape(len(at), w) for w in np.unique(width).tolist() for at in (np.flatnonzero(width == w).tolist(),)}
    place = np.zeros(len(sizes), np.int64)
    for w in rows:
        place[width == w] = np.arange(int((width == w).sum()))
    left = np.argsort(sizes, kind="stable")
    while len(left):
        first, left = int(left[0]), left[1:]
        label[first], waiting = first, [first]
        while waiting and len(left):
            x = waiting.pop()
            n, w, mine = int(sizes[x]), int(width[x]), rows[int(width[x])][place[x]][None]
            lo, hi = np.searchsorted(sizes[left], [-(-num * n // den), den * n // num + 1])
            some = left[lo:hi]
            near = np.zeros(len(some), bool)
            for v in np.unique(width[some]).tolist():
                at = np.flatnonzero(width[some] == v)
                u = min(v, w)
                apart = np.bitwise_count(folded(rows[v][place[some[at]]], u) ^ folded(mine, u)).sum(1, dtype=np.int64)
                near[at] = (num + den) * apart <= (den - num) * (n + sizes[some[at]])
            label[some[near]] = first
            waiting += some[near].tolist()
            left = np.concatenate([left[:lo], some[~near], left[hi:]])
    return label


def _by_part(fn, columns: tuple[str, ...]):
    """Calls ``fn(part, lists of the other columns)`` for the rows of each part, which come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in columns]
        now = None
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", *columns)), strict=True):
                    if part != now and held[0]:
                        yield from fn(now, *held)
                        held = [[] for _ in columns]
                    now = part
                    for x, v in zip(held, row, strict=True):
                        x.append(v)
        if held[0]:
            yield from fn(now, *held)

    return run


def _groups(num: int, den: int):
    def fn(part: int, names: list[int], sizes: list[int], maps: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(names) > 1:
            label = fitting(np.array(sizes, np.int64), maps, num, den)
            off, ids = np.flatnonzero(label != np.arange(len(label))), np.array(names, np.int64)
            if len(off):
                yield pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(ids[label[off]])], names=["a", "b"])

    return _by_part(fn, ("set", "n", "bits"))


def _distinct_sets(names: list[int], texts: list[str], k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the texts that have the set they came for are (rows with one id may differ), once each, and their sets."""
    import xxhash

    raw, at, sets, seen = [t.encode() if t else b"" for t in texts], [], [], set()
    i = 0
    for lo, hi in common.sliced(raw):
        for s in shingle_sets(raw[lo:hi], k):
            if len(s) and names[i] not in seen and np.array(_name(xxhash.xxh3_128_digest(s.tobytes())), U64).view(np.int64) == names[i]:
                seen.add(names[i])
                at.append(i)
                sets.append(s)
            i += 1
    return np.array(at, np.int64), sets


def _join_groups(k: int, num: int, den: int):
    def fn(part: int, names: list[int], docs: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        at, sets = _distinct_sets(names, texts, k)
        if len(at) < 2:
            return
        region = Region(sets, num, den)
        region.join(np.arange(len(at)))
        ids = np.array(docs, np.int64)[at]
        off = np.flatnonzero(region.component != np.arange(len(ids)))
        if len(off):
            yield pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(ids[region.component[off]])], names=["a", "b"])

    return _by_part(fn, ("set", "doc", "text"))


def _cells(k: int, num: int, den: int):
    """For a block of a group and the group's pivots: every set's cells (``near``: within the radius of the cell's pivot)
    and the links to pivots."""

    def fn(part: int, regions: list[int], pivots: list[int], names: list[int], docs: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        role = np.array(pivots) >= 0
        first, last = np.flatnonzero(role).tolist(), np.flatnonzero(~role).tolist()
        pa_, ps = _distinct_sets([names[i] for i in first], [texts[i] for i in first], k)
        at, sets = _distinct_sets([names[i] for i in last], [texts[i] for i in last], k)
        if not len(at) or not len(pa_):
            return
        p_ids, ids, name = (np.array(x, np.int64) for x in ([docs[first[i]] for i in pa_], [docs[last[i]] for i in at], [names[last[i]] for i in at]))
        region = Region([*ps, *sets], num, den)
        distance, exact = (np.stack(x, 1) for x in zip(*(region.distances(i, np.arange(len(ps), len(ps) + len(sets))) for i in range(len(ps))), strict=True))
        cells, rest = region.cells(distance.T)
        row, cell = np.nonzero(np.concatenate([cells, rest[None]]).T)
        out = cell == len(ps)  # the rest has no pivot
        cell = np.where(out, 0, cell)
        n, near = region.size[len(ps) :][row], exact[row, cell] & ~out
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), regions[0])), pa.array(p_ids[cell], mask=out), pa.array(name[row]), pa.array(ids[row]), pa.array(n), pa.array(near)], names=["region", "pivot", "set", "doc", "n", "near"])

    return _by_part(fn, ("region", "pivot", "set", "doc", "text"))


def _texts(rows: DataFrame, docs: DataFrame, n: int, few: bool = False) -> DataFrame:
    """The rows with the texts of their documents, the rows of a part together. Of few rows, all tasks get a
    copy and only their texts move; else all texts are dealt out by id to meet them."""
    return (F.broadcast(rows) if few else rows).join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").repartition(n, "part").sortWithinPartitions("part")


def _links(groups: DataFrame, docs: DataFrame, k: int, num: int, den: int, n: int) -> DataFrame:
    """a, b (documents) of groups (region, set, doc, n): links that connect whatever the threshold connects."""
    edges, tables, sum_n = [], [], F.sum("n").alias("all")
    groups = groups.withColumn("near", F.lit(False))
    for turn in range(ROUNDS + 1):
        sizes = groups.groupBy("region").agg(sum_n, F.sum(F.when(F.col("near"), 0).otherwise(F.col("n"))).alias("others")).where("others > 0")
        small = groups.join(sizes.where(F.col("all") <= REGION).select("region"), "region")
        few = groups.count() <= FEW
        edges.append(common.save(common.arrow(_texts(small.select("set", "doc", F.col("region").alias("part")), docs, n, few), _join_groups(k, num, den), "a long, b long"), "jaccard-edges"))
        large = common.save(groups.join(sizes.where(F.col("all") > REGION), "region"), "jaccard-large")
        if not large.head(1):
            common.drop(large)
            break
        tables.append(large)
        if turn == ROUNDS:
            # sets that the cell's pivot doesn't link, in blocks, against blocks of all
            rows = large.withColumn("nu", F.ceil(2 * F.col("others") / REGION).cast("int")).withColumn("na", F.ceil(2 * F.col("all") / REGION).cast("int"))
            own, every = F.pmod(F.xxhash64("set"), F.col("nu")), F.pmod(F.xxhash64("set"), F.col("na"))
            left = rows.where("not near").select("region", "set", "doc", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("j"))
            right = rows.select("region", "set", "doc", every.alias("j"), F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("i"))
            parts = left.unionByName(right).select("set", "doc", F.xxhash64("region", "i", "j").alias("part"))
            edges.append(common.save(common.arrow(_texts(parts, docs, n), _join_groups(k, num, den), "a long, b long"), "jaccard-edges"))
            break
        # a set of least hash in each of some hash classes; sets not linked yet come first
        order = F.struct("near", F.xxhash64("set", F.lit(turn)).alias("h"), "set", "doc")
        pivots = large.groupBy("region", F.pmod(F.xxhash64("set", F.lit(-turn - 1)), F.lit(PIVOTS)).alias("i")).agg(F.min(order).alias("p"), F.first("all").alias("all"))
        blocks = F.ceil(F.col("all") / REGION)
        members = large.select("region", F.lit(-1).cast("long").alias("pivot"), "set", "doc", F.pmod(F.xxhash64("set"), blocks).alias("block"))
        copies = pivots.select("region", F.lit(1).cast("long").alias("pivot"), "p.set", "p.doc", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"))
        rows = members.unionByName(copies).withColumn("part", F.xxhash64("region", "block")).drop("block")
        cells = common.save(common.arrow(_texts(rows, docs, n), _cells(k, num, den), "region long, pivot long, set long, doc long, n long, near boolean"), "jaccard-cells")
        tables.append(cells)
        edges.append(cells.where("near and doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
        groups = cells.select(F.xxhash64("region", "pivot").alias("region"), "set", "doc", "n", "near")
    return reduce(DataFrame.unionByName, edges)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document of (doc_id, text); two documents are linked if
    den * |intersection| >= num * |union| of their k-word shingle sets."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n_buckets = common.buckets(docs)
    sets = common.save(_sets(docs, k), "jaccard-sets")
    full = sets.where("digest is not null and doc_id is not null")
    reps = common.save(_named(full.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"))), "jaccard-classes")
    often = common.save(common.unpack(_prefixes(docs, k, num, den, n_buckets), _COUNT, _often, "key long, n long", n_buckets), "jaccard-often")
    held = often.agg(F.sum("n")).first()[0] or 0
    # as each counted prefix is counted for one shingle, at most LAST shingles reach this number
    least = max(OFTEN, -(-held // LAST))
    late = np.sort(np.array([r.key for r in often.where(F.col("n") >= least).select("key").collect()], np.int64).view(U64))
    last = spark.sparkContext.broadcast(late)

    gathered = common.unpack(_prefixes(docs, k, num, den, n_buckets, last), _PREFIX, _gather(num, den), "region long, set long", n_buckets).distinct()
    maps = gathered.join(reps.select("set", "n", "bits"), "set").select(F.col("region").alias("part"), "set", "n", "bits")
    fits = common.save(common.arrow(maps.repartition(n_buckets, "part").sortWithinPartitions("part"), _groups(num, den), "a long, b long"), "jaccard-fits")
    groups = common.connected(fits, "jaccard-groups").select(F.col("id").alias("set"), F.col("component").alias("region"))
    groups = common.save(groups.join(reps.select("set", "doc", "n"), "set").select("region", "set", "doc", "n"), "jaccard-members")
    edges = _links(groups, docs, k, num, den, n_buckets)
    # rows with one id and different sets: the id is linked with the first document of each set
    shared = full.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    shared = full.select("doc_id", "digest").join(shared, "doc_id").join(reps.select("digest", "doc"), "digest").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    components = common.connected(edges.unionByName(shared), "jaccard-links")
    # copies of one set: the class's smallest id, then the component's
    classes = reps.join(components.withColumnRenamed("id", "doc"), "doc", "left").select("digest", F.coalesce("component", "doc").alias("component_id"))
    alone = sets.where("digest is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.join(classes, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def _named(reps: DataFrame) -> DataFrame:
    """The 64-bit name of each class: the first eight bytes of its digest, least first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([_name(d) for d in batch.column("digest").to_pylist()], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), *(batch.column(c) for c in ("digest", "doc", "n", "bits"))], names=["set", "digest", "doc", "n", "bits"])

    return reps.mapInArrow(run, "set long, digest binary, doc long, n long, bits binary")


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.id)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(c) as component_id from documents join r on r.id = doc_id left join n using (doc_id) group by doc_id
"""
