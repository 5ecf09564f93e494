"""Suffix-array dedup by column-wise construction over many documents.

The bytes covered by a string of ``length`` bytes that also starts in a document with a smaller
doc_id are removed. Reads (stretches whose anchor is found in several documents, see ``repeats``) are
sorted column by column: they lie with their anchors in one column, so equal windows begin in one column too, and round
by round, from the last column to the first, the suffixes of all reads from a column on are put in order by that column's symbols
and the order of the column behind. Neighbours in a column that share ``length`` symbols are equal strings, and the least
doc_id of a run of them tells which to remove. A round costs as much as there are reads, whatever their length,
and nothing is held but the reads of the group.

``column_wise`` is the form for texts without a common column: in round j the suffixes of length j of all texts are inserted at
once into the order of all shorter ones, where ranks in the Burrows-Wheeler transform so far say; its files lie in a folder of the caller's.
The operator doesn't need it: an insertion costs as much as all suffixes so far.

Null and empty texts have no bytes. A null doc_id counts as one document after all others, that of id
2^63 - 1 too. Rows with one doc_id are the same document, and don't remove each other's strings; each has
its own text's result. Ties, and repeated rows, are that. Reads are whole stretches of whole texts, however
long. Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

LENGTH, GRAM = 50, 24


def column_wise(texts: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection in order, as (text, length), and the Burrows-Wheeler transform.

    Equal suffixes are in the order of their texts. Symbols are 1 and up, 0 where a text begins.
    """
    m = len(texts)
    size = np.fromiter(map(len, texts), np.int64, m)
    start = np.concatenate([[0], np.cumsum(size)])
    symbols, data = np.unique(np.frombuffer(b"".join(texts), np.uint8), return_inverse=True)
    kind = np.uint8 if len(symbols) < 255 else np.uint16
    data = (data + 1).astype(kind)
    step = 1 << int(size.max()).bit_length() if m else 1
    name_kind = np.uint32 if m * step < 1 << 32 else np.uint64
    bwt_file, name_file = Path(folder, "bwt"), Path(folder, "names")

    def before(who: np.ndarray, length: int) -> np.ndarray:
        """The symbol in front of each text's suffix of this length; 0 if that is the whole text."""
        out = np.zeros(len(who), kind)
        more = size[who] > length
        out[more] = data[start[who[more] + 1] - length - 1]
        return out

    who = np.arange(m)
    place = np.arange(m)
    before(who, 0).tofile(bwt_file)
    (who * step).astype(name_kind).tofile(name_file)
    for length in range(1, int(size.max()) + 1 if m else 0):
        bwt, names = np.fromfile(bwt_file, kind), np.fromfile(name_file, name_kind)
        going = size[who] >= length
        who, place = who[going], place[going]
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int32 if len(bwt) < 1 << 31 else np.int64)
        rank[order] = np.arange(len(bwt), dtype=rank.dtype)
        # after the m empty suffixes come those that each known symbol makes, in the order of (symbol, what follows)
        place = m + rank[place] - int((bwt == 0).sum())
        by = np.argsort(place)
        who, place = who[by], place[by]
        old = np.ones(len(bwt) + len(who), bool)
        old[place] = False
        for file, values, new in ((bwt_file, bwt, before(who, length)), (name_file, names, (who * step + length).astype(name_kind))):
            out = np.empty(len(old), values.dtype)
            out[old], out[place] = values, new
            out.tofile(file)
    names = np.fromfile(name_file, name_kind).astype(np.int64)
    return names // step, names % step, np.fromfile(bwt_file, kind)


def columns(texts: list[bytes], shift: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The column-wise rounds over texts that lie ``shift`` columns in: from the last column to the first, each column, the suffixes
    from there on in order, and the table of symbols (0 outside of a text) with the number of columns of each row that lie before its text.

    A round's order is the one of the column behind, sorted stably by the column's symbols; equal suffixes are in the order of their texts."""
    m = len(texts)
    size = np.fromiter(map(len, texts), np.int64, m)
    data = np.frombuffer(b"".join(texts), np.uint8)
    known = np.bincount(data, minlength=256) > 0
    code = np.cumsum(known).astype(np.uint8 if known.sum() < 256 else np.uint16)
    table = np.zeros((m, int((shift + size).max(initial=0))), code.dtype)
    row = np.repeat(np.arange(m), size)
    table[row, np.arange(len(data)) - np.repeat(np.cumsum(size) - size - shift, size)] = code[data]
    by_column, order = np.ascontiguousarray(table.T), np.arange(m)
    for column in range(table.shape[1] - 1, -1, -1):
        order = order[np.argsort(by_column[column][order], kind="stable")]
        yield column, order, table, size


def anchored(texts: list[bytes], gram: int) -> np.ndarray:
    """Where each read's anchor is: of all windows of a read it is the least gram, so of the whole read too."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    grams = common.gram_hashes(repeats.LETTERS[np.frombuffer(b"".join(texts), np.uint8)], gram)
    inside = np.arange(len(grams)) - np.repeat(start, size)[: len(grams)]
    code = (grams & ~repeats._LOW) | inside.astype(np.uint64)
    code[inside > np.repeat(size - gram, size)[: len(grams)]] = np.uint64(0xFFFFFFFFFFFFFFFF)  # reaches into the next read
    return (np.minimum.reduceat(code, start) & repeats._LOW).astype(np.int64)


def first_documents(length: int, gram: int):
    """The exact method for ``repeats.spans``."""

    def group(texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        anchor = anchored(texts, gram)
        shift = anchor.max() - anchor
        out: list[list[np.ndarray]] = [[], [], []]
        for column, order, table, size in columns(texts, shift):
            # equal windows lie in one column
            own = order[(shift[order] <= column) & (column + length <= shift[order] + size[order])]
            if not len(own):
                continue
            same = np.zeros(len(own), bool)  # the common prefix with the neighbour before has the full length
            views = table[own, column : column + length]
            same[1:] = (views[1:] == views[:-1]).all(1)
            least = np.minimum.reduceat(doc[own], np.flatnonzero(~same))
            for held, x in zip(out, (own, column - shift[own], least[np.cumsum(~same) - 1]), strict=True):
                held.append(x)
        read, window, first = map(np.concatenate, out)
        # only documents count here; a place that moves in step keeps runs together
        return repeats.as_runs(read, window, first, window + np.where(first == doc[read], at[read], -1))

    return group


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every document of (doc_id, text)."""
    docs = repeats.marked(docs)
    found = repeats.spans(docs, repeats.Bytes(), gram, length, first_documents(length, gram), across=True)

    def finish(rows, spans_of) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], [], []]
        for row in rows or ():
            doc, none, _, data = row
            cuts = repeats.merged(spans_of(row), len(data))
            kept, at = hashlib.sha256(), 0
            for a, b in [*cuts, (len(data), len(data))]:
                kept.update(data[at:a])
                at = b
            values = (None if none else doc, len(data), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest(), [list(c) for c in cuts])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return repeats.beside(docs, found, repeats._SPAN, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
g as (select doc_id, i, substring(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from d where n >= 50)),
f as (select s, min(doc_id) as m from g group by 1 having min(doc_id) <> max(doc_id)),
c as (select doc_id, i from g join f using (s) where m < doc_id),
r as (select doc_id, i, i > coalesce(max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), -100) + 50 as fresh from c),
k as (select doc_id, sum(fresh::int) over (partition by doc_id order by i) as k, i from r),
sp as (select doc_id, min(i) as a, max(i) + 50 as b from k group by doc_id, k),
rem as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, list(a order by a) as s, list(b order by a) as e from sp group by 1)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when n_removed is null then h else array_to_string(list_transform(range(0, len(s) + 1), lambda j:
    substring(h, (case when j = 0 then 0 else e[j] end) * 2 + 1, ((case when j = len(s) then n else s[j + 1] end) - (case when j = 0 then 0 else e[j] end)) * 2)), '') end)) as kept_sha256
from d left join rem using (doc_id)
"""
