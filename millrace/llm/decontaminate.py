"""Benchmark decontamination with an FM-index for each shard of the training text.

A shard is a few megabytes of consecutive documents of one partition. Its words are mapped to the
symbols of the benchmark's vocabulary; stretches that cannot hold a window (a foreign word, or too
few words in a row) are left out, a separator standing for each. Over what is left the shard builds
a suffix array, the Burrows-Wheeler transform and its wavelet tree; all windows are backward-searched
at once by ranks, their occurrences located by walking to the next sampled suffix position, and the
spans merged per document.

A benchmark is searched in blocks of about ``BLOCK_WORDS`` words (one item at least). The driver and
each worker hold one block at a time: with more than one, a pass over the documents each, the hits so far being saved between them.

Null and empty texts have no words. Items without words match nothing; several items with one id
count as one in the digest. Repeated documents are treated one by one, rows with one id or none too. A text
longer than a shard is a shard of its own, searched whole. Overlapping and equal occurrences merge, so ties don't
matter. Only the named columns are read; those to keep must not be called as the results are. Empty tables give
no rows, or no hits. Items without an id are searched under the empty id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window; words of a benchmark block; bytes of text of a shard; distance of sampled suffix positions.
WINDOW, BLOCK_WORDS, SHARD, SAMPLE = 10, 2_000_000, 2 << 20, 8
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; letters, digits and everything beyond ASCII belong to words."""
    return text.encode().translate(_KEEP).split() if text else []


class FMIndex:
    """Suffix order, wavelet tree and sampled positions of an array of symbols (0 separates)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        n = self.n = len(symbols) + 1
        text = np.concatenate([symbols.astype(np.int64) + 1, [0]])
        order = self._suffixes(text)
        last = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 2))])
        self.levels, self.zeros, values = [], [], last
        for bit in reversed(range(int(alphabet + 1).bit_length())):
            one = (values >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            self.zeros.append(n - int(one.sum()))
            values = np.concatenate([values[one == 0], values[one == 1]])
        self.bits, self.last = len(self.levels), last
        self.marked = np.concatenate([[0], np.cumsum(order % SAMPLE == 0)])
        self.sampled = order[order % SAMPLE == 0]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Prefix doubling; the end symbol is unique and least, so all suffixes come to differ."""
        n, rank, width = len(text), text, 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            width *= 2
            if rank[order[-1]] == n - 1 or width >= 2 * n:
                return order

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``upto`` of the transform."""
        lo, hi = np.zeros(len(upto), np.int64), upto.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns (symbols >= 1; a row's last ``length`` columns count)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1]):
            on = np.flatnonzero((k < lengths) & (lo < hi))
            if not len(on):
                break
            symbol = patterns[on, patterns.shape[1] - 1 - k].astype(np.int64) + 1
            base = self.first[symbol]
            lo[on], hi[on] = base + self.rank(symbol, lo[on]), base + self.rank(symbol, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the preceding suffix until one is sampled."""
        rows, steps, out, left = rows.astype(np.int64), 0, np.empty(len(rows), np.int64), np.arange(len(rows))
        while len(left):
            hit = self.marked[rows + 1] > self.marked[rows]
            out[left[hit]] = self.sampled[self.marked[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            symbol = self.last[rows]
            rows, steps = self.first[symbol] + self.rank(symbol, rows), steps + 1
        return out


class Windows:
    """The distinct windows of a block of benchmark items, as symbols of the block's vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, ws in items:
            ids = [self.vocabulary[w] for w in ws]
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i : i + window]), set()).add(name)
        self.names = [sorted(v) for v in found.values()]
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.patterns = np.zeros((len(found), window), np.int32)
        for row, ids in zip(self.patterns, found, strict=True):
            row[window - len(ids) :] = ids
        self.least = int(self.lengths.min()) if len(found) else 0

    def occurrences(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence in a shard: document, first word, window."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        ends = np.cumsum(sizes)
        ids = np.fromiter((i for ws in docs for i in map(self.vocabulary.get, ws, repeat(0))), np.int32, int(sizes.sum()))
        known = np.flatnonzero(ids)
        none = np.zeros(0, np.int64)
        if not len(known) or not len(self.names):
            return none, none, none
        doc = np.searchsorted(ends, known, side="right")
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(known) != 1) | (np.diff(doc) != 0)]))
        length = np.diff(np.concatenate([starts, [len(known)]]))
        keep = np.repeat(length >= self.least, length)
        known, run = known[keep], np.repeat(np.arange(len(starts)), length)[keep]
        if not len(known):
            return none, none, none
        place = np.arange(len(known)) + np.cumsum(np.concatenate([[0], np.diff(run) != 0]))
        symbols, origin = np.zeros(place[-1] + 1, np.int32), np.zeros(place[-1] + 1, np.int64)
        symbols[place], origin[place] = ids[known], known
        index = FMIndex(symbols, len(self.vocabulary))
        lo, hi = index.search(self.patterns, self.lengths)
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = origin[index.locate(rows)]
        doc = np.searchsorted(ends, at, side="right")
        return doc, at - (ends - sizes)[doc], which


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Windows]:
    items, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        if ws := words(row.text):
            items.append((row.item_id or "", ws))
            n += len(ws)
        if n >= BLOCK_WORDS:
            yield Windows(items, window)
            items, n = [], 0
    if items:
        yield Windows(items, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (merged word ranges) of every document.

    ``keep`` names further columns of ``docs`` to carry along, ``keep_text`` carries the text.
    """
    sc = docs.sparkSession.sparkContext
    found = docs.select("doc_id", *keep, "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    schema = found.schema
    kept = ["doc_id", *keep, *(["text"] if keep_text else [])]
    result = ", ".join(f"`{n}` {schema[n].dataType.simpleString()}" for n in kept) + ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>"

    def search(block, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
                texts = whole.column("text").to_pylist()
                for lo, hi in common.sliced((t or "" for t in texts), SHARD):
                    batch = whole.slice(lo, hi - lo)
                    tokens = [words(t) for t in texts[lo:hi]]
                    doc, at, which = block.value.occurrences(tokens)
                    hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                    order = np.argsort(doc, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
                        d = int(doc[part[0]])
                        spans = np.stack([at[part], at[part] + block.value.lengths[which[part]]], 1)
                        hits[d] = (hits[d] or b"") + spans.astype("<i8").tobytes()
                        items[d] = sorted({*(items[d] or ()), *(n for w in set(which[part].tolist()) for n in block.value.names[w])})
                    put = {"n_words": pa.array(list(map(len, tokens)), pa.int64())}
                    if last:
                        merged = [merge(np.frombuffer(h, "<i8").reshape(-1, 2)) if h else [] for h in hits]
                        n_hit, items = [sum(b - a for a, b in m) for m in merged], [i or [] for i in items]
                        put |= {n: batch.column(n) for n in kept} | {"n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(list(map(len, items)), pa.int64())}
                        put |= {"items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), "contaminated": pa.array([n > 0 for n in n_hit])}
                        put["spans"] = pa.array([[list(s) for s in m] for m in merged], pa.list_(pa.list_(pa.int64())))
                        names = [*kept, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
                    else:
                        put |= {"hits": pa.array(hits, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
                        names = batch.schema.names
                    yield pa.RecordBatch.from_arrays([put[n] if n in put else batch.column(n) for n in names], names=names)

        return run

    blocks = _blocks(benchmark, window)
    block = sc.broadcast(next(blocks, None) or Windows([], window))
    for after in blocks:
        found = common.save(common.arrow(found, search(block, False), schema), "contamination")
        block.destroy()
        block = sc.broadcast(after)
    return common.arrow(found, search(block, True), result)


def merge(spans: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SQL = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id::varchar as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as s from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
hit as (select r, item_id, i, dw.n from dw join bw on dw.n = bw.n and dw.s = bw.s),
cover as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from hit)) group by r),
its as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct r, item_id from hit) group by r)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover using (r) left join its using (r)
"""
