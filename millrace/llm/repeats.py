"""Repeated passages: what the suffix-array and the suffix-tree operator share.

Suffixes that cannot start a passage of ``length`` symbols found elsewhere need no sorting. A window
of that length always holds the same anchor: the k-gram of least hash in it. Anchors are counted
over the whole corpus; only stretches around anchors that occur again become ``reads``: the symbols
of all windows that have the anchor. Equal windows lie in reads of one anchor, at one place before
or after it, so an anchor's reads can be sorted apart from all others, and equal reads stand for each
other with their first occurrence. A read whose neighbourhood on neither side of the anchor (half of
what a window has beside it) is that of a different read shares no window with one: it needs no sorting
either. Only the others, once each, travel with their symbols.

Reads count as equal if their anchors' and their own 64-bit hashes are. Anchors, reads and spans
cross the shuffle packed, many in a row of Spark's, and are sorted in numpy a bucket at a time.

Documents are told apart by id, null being one document after all others, and rows with one id by their
texts (``mark``). All texts are taken whole, hashed a megabyte (one text at least) at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

_OCCURRENCE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("a", "<u4"), ("none", "u1")])
_PLACE = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("a", "<u4"), ("none", "u1")])
_READ = np.dtype([("key", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("a", "<u4"), ("n", "<u2"), ("none", "u1"), ("left", "<u4"), ("right", "<u4")])
_WANTED = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("a", "<u4"), ("none", "u1"), ("n", "<u2"), ("key", "<u8"), ("hash", "<u8")])
_SPAN = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("a", "<u4"), ("none", "u1"), ("b", "<u4")])
_CONTENT = np.dtype([("key", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("a", "<u4"), ("none", "u1"), ("size", "<u4")])
_LOW = U64(0xFFFFFFFF)
_ODD = 0xD6E8FEB86659FD93
#: Reads sorted at once, an anchor's always together; if an anchor has more than so many times that, its windows are parted by their hashes.
TOGETHER, CROWDED = 16_384, 4
#: What rows of the tables between the steps hold.
SPANS, WANTED, READS = 0, 1, 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out


def anchors(grams: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the hashes of all k-grams of a document: anchor places, and the first and last window start of each."""
    width = length - k + 1
    none = np.zeros(0, np.int64)
    if len(grams) < width:
        return none, none, none
    code = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
    at = (sliding_min(code, width) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.concatenate([first[1:], [len(at)]]) - 1


class Stretches:
    """Hashes of stretches of an array of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        with np.errstate(over="ignore"):
            # powers of an odd number and of its inverse; the sum up to a place tells every stretch's
            power = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(_ODD))]), dtype=U64)
            self.back = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(pow(_ODD, -1, 1 << 64)))]), dtype=U64)
            self.upto = np.concatenate([[U64(0)], np.cumsum(symbols * power[:n], dtype=U64)])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return common.mix((self.upto[end] - self.upto[begin]) * self.back[begin] + (end - begin).astype(U64))


#: A symbol for each byte.
LETTERS = common.mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Bytes:
    """Documents as bytes."""

    def split(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, Callable[[int, int], bytes]]]:
        for text in texts:
            yield LETTERS[np.frombuffer(text, np.uint8)], self.cutter(text)

    @staticmethod
    def cutter(text: bytes) -> Callable[[int, int], bytes]:
        return lambda a, b: text[a:b]


class Words:
    """Documents as white-space separated words; a stretch is its words joined by one space."""

    def split(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, Callable[[int, int], bytes]]]:
        hashes, at = common.word_hashes(texts)
        for text, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield hashes[a:b], self.cutter(text)

    @staticmethod
    def cutter(text: bytes) -> Callable[[int, int], bytes]:
        words: list[bytes] = []

        def cut(i: int, j: int) -> bytes:
            if not words:
                words.extend(text.split())
            return b" ".join(words[i:j])

        return cut


def marked(docs: DataFrame) -> DataFrame:
    """doc, none (1 for a null id, whose doc is 0), mark, text."""
    doc = F.coalesce("doc_id", F.lit(0)).cast("long")
    return docs.select(doc.alias("doc"), F.col("doc_id").isNull().cast("long").alias("none"), F.xxhash64("text").alias("mark"), "text")


def _texts(batch: pa.RecordBatch) -> list[tuple[int, int, int, bytes]]:
    return list(zip(*(batch.column(c).to_pylist() for c in ("doc", "none", "mark")), [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], strict=True))


def beside(docs: DataFrame, side: DataFrame, dtype: np.dtype, fn, schema: str, exact: bool = True) -> DataFrame:
    """Runs ``fn(rows, records_of)`` over slices of ``docs`` (doc, none, mark, bytes), ``records_of(row)`` being the
    records of that document (with ``exact``, of that row of it) among the packed ones of ``side``; one shuffle by document."""
    n = doc_buckets(docs)
    texts = docs.select("doc", "none", "mark", "text", common.doc_bucket(F.col("doc"), n).alias("bucket"), F.lit(None).cast("binary").alias("data"))
    null = F.lit(None).cast("long")
    both = texts.unionByName(side.select(null.alias("doc"), null.alias("none"), null.alias("mark"), F.lit(None).cast("string").alias("text"), "bucket", "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        records, where = None, {}
        for batch in batches:
            cut = batch.num_rows - batch.column("data").null_count
            if cut:
                held += batch.column("data").slice(0, cut).to_pylist()
            if cut < batch.num_rows:
                if records is None:
                    records = common.decoded(held, dtype)
                    records = records[np.lexsort((records["a"], records["mark"], records["doc"], records["none"]))]
                    names = np.stack([records[c].astype(np.int64) for c in ("doc", "none", "mark")], 1)
                    starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(1)])[: len(names)])
                    ends = [*starts[1:].tolist(), len(names)]
                    where = {tuple(k): slice(a, b) for k, a, b in zip(names[starts].tolist(), starts.tolist(), ends, strict=False)}
                    held, empty = [], records[:0]
                for lo in range(cut, batch.num_rows, 256):
                    rows = _texts(batch.slice(lo, 256))
                    for a, b in common.sliced(r[3] for r in rows):
                        yield from fn(rows[a:b], lambda r: records[s] if (s := where.get((r[0], r[1], r[2] if exact else 0))) else empty)
        yield from fn(None, None)

    return common.arrow(both.repartitionById(n, F.col("bucket")).sortWithinPartitions(F.col("data").isNull()), run, schema)


def doc_buckets(docs: DataFrame) -> int:
    return common.buckets(docs, 16 << 20)


def places(docs: DataFrame, symbols, k: int, length: int, across: bool) -> DataFrame:
    """Packed (doc, place) of anchors that occur again (``across``: in another document) of ``marked`` documents."""
    n_buckets, n_docs = common.buckets(docs), doc_buckets(docs)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.Packer(_OCCURRENCE, n_buckets)
        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids, none = batch.column("doc").to_numpy(), batch.column("none").to_numpy()
            for lo, hi in common.sliced(raw):
                keys, at = [], []
                for values, _ in symbols.split(raw[lo:hi]):
                    grams = common.gram_hashes(values, k)
                    places = anchors(grams, k, length)[0]
                    keys.append(grams[places])
                    at.append(places)
                n = np.fromiter(map(len, at), np.int64, len(at))
                yield from out.add(np.concatenate(keys), np.repeat(ids[lo:hi], n), np.concatenate(at), np.repeat(none[lo:hi], n))
        yield from out.flush()

    def repeated(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        r = records[np.argsort(records["key"], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], r["key"][1:] != r["key"][:-1]]))
        n = np.diff(np.concatenate([starts, [len(r)]]))
        again = n > 1
        if across:
            apart = [np.minimum.reduceat(r[c], starts) != np.maximum.reduceat(r[c], starts) for c in ("doc", "none")]
            again = apart[0] | apart[1]
        r = r[np.repeat(again, n)]
        out = common.Packer(_PLACE, n_docs)
        yield from out.add(r["doc"], np.zeros(len(r), np.int64), r["a"], r["none"])
        yield from out.flush()

    packed = common.arrow(docs.select("doc", "none", "text"), occurrences, common.Packer.SCHEMA)
    return common.save(common.unpack(packed, _OCCURRENCE, repeated, common.Packer.SCHEMA, n_buckets), "repeat-places")


def reads(docs: DataFrame, found: DataFrame, symbols, k: int, length: int) -> DataFrame:
    """Packed reads around the places found."""
    n_buckets, half = common.buckets(docs), (length - k) // 2

    def cutter():
        out = common.Packer(_READ, n_buckets)

        def cut(rows, records_of) -> Iterator[pa.RecordBatch]:
            if rows is None:
                yield from out.flush()
                return
            wanted = [records_of(r)["a"] for r in rows]
            some = [i for i, w in enumerate(wanted) if len(w)]
            columns: list[list] = [[] for _ in _READ.names]
            for i, (values, _) in zip(some, symbols.split([rows[i][3] for i in some]), strict=True):
                grams = common.gram_hashes(values, k)
                at, first, last = anchors(grams, k, length)
                hit = np.flatnonzero(np.isin(at, wanted[i]))
                at, begin, end = at[hit], first[hit], last[hit] + length
                stretch = Stretches(values)
                left = np.where(at - half >= begin, stretch.hashes(np.maximum(at - half, 0), at) | U64(1), U64(0))
                right = np.where(at + k + half <= end, stretch.hashes(at + k, np.minimum(at + k + half, len(values))) | U64(1), U64(0))
                full = [np.full(len(at), v) for v in (rows[i][0], rows[i][2], rows[i][1])]
                for column, x in zip(columns, (grams[at], stretch.hashes(begin, end), full[0], full[1], begin, end - begin, full[2], left & _LOW, right & _LOW), strict=True):
                    column.append(x)
            if some:
                yield from out.add(*map(np.concatenate, columns))

        return cut

    return beside(docs, found, _PLACE, _once(cutter), common.Packer.SCHEMA, exact=False)


def _once(make):
    """A function that makes itself anew in each worker's task, with packers of its own."""
    state: list = []

    def fn(rows, records_of):
        if not state:
            state.append(make())
        yield from state[0](rows, records_of)
        if rows is None:
            state.clear()

    return fn


def _kinds(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reads in the order of (anchor, hash, document, place), and where each kind (of equal ones) and each anchor begins."""
    r = r[np.lexsort((r["a"], r["doc"], r["none"], r["hash"], r["key"]))]
    new = r["key"][1:] != r["key"][:-1]
    kind = np.concatenate([[True], new | (r["hash"][1:] != r["hash"][:-1])])[: len(r)]
    return r, np.flatnonzero(kind), np.flatnonzero(np.concatenate([[True], new])[: len(r)])


def _earlier(first: np.ndarray, own: np.ndarray, shift: np.ndarray | int, across: bool) -> np.ndarray:
    """Whether the first occurrence (doc, none, a) lies before one's own place plus shift."""
    before = (first["none"] < own["none"]) | ((first["none"] == own["none"]) & (first["doc"] < own["doc"]))
    if across:
        return before
    return before | ((first["none"] == own["none"]) & (first["doc"] == own["doc"]) & (first["a"] < own["a"].astype(np.int64) + shift))


def _shared(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another kind of the anchor has the same neighbourhood on a side (0: none)."""
    order = np.lexsort((side, key))
    same = (key[order][1:] == key[order][:-1]) & (side[order][1:] == side[order][:-1]) & (side[order][1:] != 0)
    out = np.zeros(len(key), bool)
    out[order] = np.concatenate([same, [False]])[: len(key)] | np.concatenate([[False], same])[: len(key)]
    return out


def settled(packed: DataFrame, n_buckets: int, n_docs: int, across: bool) -> DataFrame:
    """(what, bucket, data): spans of reads that need no sorting; of the others, the first of each kind, and all of them."""

    def run(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        r, starts, _ = _kinds(records)
        times = np.diff(np.concatenate([starts, [len(r)]]))
        first = r[starts]
        contested = _shared(first["key"], first["left"]) | _shared(first["key"], first["right"])
        member = np.repeat(contested, times)
        mine, lead = r[~member], np.repeat(first, times)[~member]
        gone = _earlier(lead, mine, 0, across)
        spans = mine[gone]
        w, rest = first[contested], r[member]
        for what, dtype, n, columns in (
            (SPANS, _SPAN, n_docs, [spans["doc"], spans["mark"], spans["a"], spans["none"], spans["a"] + spans["n"]]),
            (WANTED, _WANTED, n_docs, [w[c] for c in _WANTED.names]),
            (READS, _READ, n_buckets, [rest[c] for c in _READ.names]),
        ):
            out = common.Packer(dtype, n)
            for batch in (*out.add(*columns), *out.flush()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, what, np.int32)), *batch.columns], names=["what", *batch.schema.names])

    return common.save(common.unpack(packed, _READ, run, "what int, " + common.Packer.SCHEMA, n_buckets), "repeat-kinds")


def contents(docs: DataFrame, wanted: DataFrame, symbols, n_buckets: int) -> DataFrame:
    """Packed reads with their symbols: data as of a Packer, and text, the reads' bytes one after another."""

    def fetcher():
        held: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            import zstandard

            if not held:
                return
            put = zstandard.ZstdCompressor(level=1).compress
            rows = np.concatenate([x[0] for x in held])
            texts = [t for x in held for t in x[1]]
            held.clear()
            bucket = (rows["key"] % U64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            names, data, text = [], [], []
            for part in np.split(order, cuts[1:]):
                records = np.empty(len(part), _CONTENT)
                some = [texts[i] for i in part.tolist()]
                for c in ("key", "hash", "doc", "a", "none"):
                    records[c] = rows[c][part]
                records["size"] = list(map(len, some))
                names.append(int(bucket[part[0]]))
                data.append(put(np.ascontiguousarray(records.view(np.uint8).reshape(len(records), -1).T).tobytes()))
                text.append(put(b"".join(some)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary()), pa.array(text, pa.binary())], names=["bucket", "data", "text"])

        def fetch(rows, records_of) -> Iterator[pa.RecordBatch]:
            if rows is not None:
                for row in rows:
                    if len(part := records_of(row)):
                        stretch = symbols.cutter(row[3])
                        held.append((part.copy(), [stretch(a, a + n) for a, n in zip(part["a"].tolist(), part["n"].tolist(), strict=True)]))
            if rows is None or sum(len(x[1]) for x in held) > 200_000:
                yield from flush()

        return fetch

    return beside(docs, wanted, _WANTED, _once(fetcher), "bucket int, data binary, text binary")


def spans(docs: DataFrame, symbols, k: int, length: int, group, across: bool) -> DataFrame:
    """Packed spans: symbol ranges of ``marked`` documents covered by windows that start earlier elsewhere.

    ``group(reads, document, place)`` is the exact method: for distinct reads, with the rank of the document
    and the place of the first occurrence of each, it returns arrays (read, from, to, document, place - from):
    for runs of windows of a read, where their first occurrence is. It runs over all reads of some anchors at a time.
    """
    n_buckets, n_docs = common.buckets(docs), doc_buckets(docs)
    found = places(docs, symbols, k, length, across)
    # saved, so that the shuffle of the texts is gone before the reads are dealt out
    packed = common.save(reads(docs, found, symbols, k, length), "repeat-reads")
    common.drop(found)
    kinds = settled(packed, n_buckets, n_docs, across)
    common.drop(packed)
    blobs = contents(docs, kinds.where(F.col("what") == WANTED).select("bucket", "data"), symbols, n_buckets)
    both = blobs.unionByName(kinds.where(F.col("what") == READS).select("bucket", "data", F.lit(None).cast("binary").alias("text")))

    def parted(texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """``group`` over the windows of too many reads, by parts of the windows' hashes: equal ones are in one part."""
        import xxhash

        cuts = [symbols.cutter(t) for t in texts]
        n = [len(t) if isinstance(symbols, Bytes) else t.count(b" ") + 1 for t in texts]
        parts: dict[int, list[tuple[int, int]]] = {}
        n_parts = -(-sum(x - length + 1 for x in n) // TOGETHER)
        for i, cut in enumerate(cuts):
            for w in range(n[i] - length + 1):
                parts.setdefault(xxhash.xxh3_64_intdigest(cut(w, w + length)) % n_parts, []).append((i, w))
        out = []
        for part in parts.values():
            read, window = np.array([p[0] for p in part]), np.array([p[1] for p in part])
            own, _, _, first, shift = group([cuts[i](w, w + length) for i, w in part], doc[read], at[read] + window)
            out.append((read[own], window[own], window[own], first, shift - window[own]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def sort(rows: np.ndarray, texts: list[bytes], own: np.ndarray) -> Iterator[np.ndarray]:
        """Spans of the reads ``own`` by the contents ``rows`` of all kinds of some anchors."""
        names, rank = np.unique(np.stack([rows["none"].astype(np.int64), rows["doc"]], 1), axis=0, return_inverse=True)
        many = len(texts) > CROWDED * TOGETHER
        read, a, b, first, shift = (parted if many else group)(texts, rank.ravel(), rows["a"].astype(np.int64))
        # runs of a kind, and the reads of that kind
        kind = np.lexsort((rows["hash"], rows["key"]))
        place = np.empty(len(kind), np.int64)
        place[kind] = np.arange(len(kind))
        pair = np.zeros(len(rows) + len(own), [("key", "<u8"), ("hash", "<u8")])
        for c in ("key", "hash"):
            pair[c] = np.concatenate([rows[c][kind], own[c]])
        order = np.lexsort((np.arange(len(pair)), pair["hash"], pair["key"]))
        head = order < len(rows)
        at = np.full(len(pair), -1)
        at[order] = np.cumsum(head) - 1
        of = at[len(rows) :]  # the kind of each read, as a place in the sorted kinds
        own, of = (x[(of >= 0) & (pair[np.maximum(of, 0)] == pair[len(rows) :])] for x in (own, of))
        by = np.argsort(of, kind="stable")
        lo, hi = np.searchsorted(of[by], [place[read], place[read] + 1])
        n = hi - lo
        who = by[np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)]
        run = np.repeat(np.arange(len(read)), n)
        mine = own[who]
        lead = np.zeros(len(who), [("none", "<i8"), ("doc", "<i8"), ("a", "<i8")])
        lead["none"], lead["doc"] = names[first[run]].T
        # the run's first window, wherever it is first; later ones move in step
        lead["a"] = shift[run] + a[run]
        gone = _earlier(lead, mine, a[run], across)
        mine, run = mine[gone], run[gone]
        out = np.empty(len(mine), _SPAN)
        for c in ("doc", "mark", "none"):
            out[c] = mine[c]
        out["a"], out["b"] = mine["a"] + a[run], mine["a"] + b[run] + length
        yield out

    def bucket(data: list[bytes], texts: list[bytes], own: list[bytes]) -> Iterator[np.ndarray]:
        import zstandard

        get = zstandard.ZstdDecompressor().decompress
        rows, at, cut = [common.decoded([d], _CONTENT) for d in data], [], []
        for part, blob in zip(rows, texts, strict=True):
            ends = np.cumsum(part["size"].astype(np.int64)).tolist()
            blob = get(blob) if ends else b""
            at += [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]
        rows = np.concatenate([np.zeros(0, _CONTENT), *rows])
        order = np.lexsort((rows["hash"], rows["key"]))
        key, name = rows["key"][order], rows["hash"][order]
        order = order[np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])[: len(order)]]  # repeated rows of the table
        rows, at = rows[order], [at[i] for i in order.tolist()]
        mine = common.decoded(own, _READ)
        mine = mine[np.argsort(mine["key"], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])[: len(rows)]).tolist()
        lo = 0
        for hi in [*starts[1:], len(rows)]:
            if hi - lo >= TOGETHER or hi == len(rows):
                if hi > lo:
                    a, b = np.searchsorted(mine["key"], rows["key"][lo]), np.searchsorted(mine["key"], rows["key"][hi - 1], "right")
                    yield from sort(rows[lo:hi], at[lo:hi], mine[a:b])
                lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, data, texts, own = common.Packer(_SPAN, n_docs), None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            for found in bucket(data, texts, own):
                yield from out.add(*(found[c] for c in _SPAN.names))

        for batch in batches:
            for name, blob, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "data", "text")), strict=True):
                if name != now:
                    yield from done()
                    now, data, texts, own = name, [], [], []
                if text is None:
                    own.append(blob)
                else:
                    data.append(blob)
                    texts.append(text)
        yield from done()
        yield from out.flush()

    sorted_ = common.save(common.arrow(both.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket"), run, common.Packer.SCHEMA), "repeat-spans")
    return kinds.where(F.col("what") == SPANS).select("bucket", "data").unionByName(sorted_)


def as_runs(read: np.ndarray, window: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(read, window, first doc, first place) of all windows, put together to runs that move in step."""
    order = np.lexsort((window, read))
    read, window, doc, shift = read[order], window[order], doc[order], at[order] - window[order]
    new = np.concatenate([[True], (read[1:] != read[:-1]) | (doc[1:] != doc[:-1]) | (shift[1:] != shift[:-1]) | (window[1:] != window[:-1] + 1)])[: len(read)]
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(read)]]) - 1
    return read[starts], window[starts], window[ends], doc[starts], shift[starts]


def merged(rows: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal ranges covered by span records (in the order of a), within n symbols."""
    if not len(rows):
        return []
    a, top = rows["a"], np.maximum.accumulate(rows["b"])
    new = np.concatenate([[True], a[1:] > top[:-1]])
    ends = np.concatenate([np.flatnonzero(new)[1:], [len(a)]]) - 1
    return list(zip(a[new].tolist(), np.minimum(top[ends], n).tolist(), strict=True))
