"""Substring dedup by prefix-partitioned suffix trees over words.

The words covered by a window of ``length`` words that starts earlier (in a smaller doc_id, or
earlier in the same document) are removed. Suffixes of the candidate reads (see ``repeats``) are split
by variable-length prefixes: a prefix is made longer, a word at a time, for just the suffixes that
still share it with too many others, so that every group fits in memory. Each group is one subtree (or a few that are still together):
its suffixes are parted at each depth by the next word, a branch with one suffix left is a leaf
and followed no farther, and the branches that reach ``length`` words are the deep internal nodes, whose
leaves are all places of a repeat.

Null and empty texts have no words. A null doc_id counts as one document after all others, that of id
2^63 - 1 too. Rows with one doc_id are the same document, place for place; each has its own text's result.
Ties, and repeated rows, are that. Texts are read whole, however long. Columns other than doc_id and text
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats

LENGTH, GRAM = 20, 6
#: Most suffixes of one subtree.
SUBTREE = 8_192


def prefix_groups(suffixes: np.ndarray, words: np.ndarray, length: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of suffixes (places in ``words``) that share a prefix, with its length; lone suffixes fall away."""
    todo = [(0, suffixes)]
    while todo:
        depth, group = todo.pop()
        if len(group) < 2:
            continue
        if len(group) <= most or depth == length:
            yield depth, group
            continue
        letter = words[group + depth]
        order = np.argsort(letter, kind="stable")
        cuts = np.flatnonzero(np.diff(letter[order])) + 1
        parts = [p for p in np.split(group[order], cuts) if len(p) > 1]
        # small neighbours share a subtree task as they are; they are parted again by its first branching
        todo += [(depth + 1, p) for p in parts if len(p) > most]
        held, n = [], 0
        for p in parts:
            if len(p) <= most:
                held.append(p)
                n += len(p)
                if n >= most:
                    yield depth, np.concatenate(held)
                    held, n = [], 0
        if held:
            yield depth, np.concatenate(held)


def deep_nodes(group: np.ndarray, depth: int, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of a group: suffixes under nodes at ``length`` words, and the node of each."""
    node = np.zeros(len(group), np.int64)
    while depth < length and len(group):
        order = np.lexsort((words[group + depth], node))
        letter, node = words[group + depth][order], node[order]
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])])
        node = np.cumsum(new) - 1
        inner = np.bincount(node)[node] > 1  # the others are leaves
        group, node = group[order][inner], node[inner]
        depth += 1
    return group, node


def first_places(length: int):
    """The exact method for ``repeats.spans``."""

    def group(texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        split = [t.split(b" ") for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        vocabulary: dict[bytes, int] = {}
        words = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for ws in split for w in ws), np.int64, int(size.sum()))
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        count = np.maximum(size - length + 1, 0)
        read = np.repeat(np.arange(len(texts)), count)
        window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        first_doc, first_at = doc[read].copy(), at[read] + window
        own_doc, own_at = first_doc.copy(), first_at.copy()
        suffix = start[read] + window
        number = np.zeros(len(words), np.int64)
        number[suffix] = np.arange(len(suffix))
        for depth, some in prefix_groups(suffix, words, length, SUBTREE):
            leaves, node = deep_nodes(some, depth, words, length)
            if not len(leaves):
                continue
            w = number[leaves]
            order = np.lexsort((own_at[w], own_doc[w], node))
            w, node = w[order], node[order]
            head = np.concatenate([[True], node[1:] != node[:-1]])
            lead = w[head][np.cumsum(head) - 1]
            first_doc[w], first_at[w] = own_doc[lead], own_at[lead]
        return repeats.as_runs(read, window, first_doc, first_at)

    return group


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (word ranges) of every document of (doc_id, text)."""
    docs = repeats.marked(docs)
    found = repeats.spans(docs, repeats.Words(), gram, length, first_places(length), across=False)

    def finish(rows, spans_of) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        for row in rows or ():
            doc, none, _, data = row
            words = data.split()
            cuts = repeats.merged(spans_of(row), len(words))
            kept, at = [], 0
            for a, b in cuts:
                kept += words[at:a]
                at = b
            kept += words[at:]
            values = (None if none else doc, len(words), sum(b - a for a, b in cuts), hashlib.sha256(b" ".join(kept)).hexdigest(), [list(c) for c in cuts])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return repeats.beside(docs, found, repeats._SPAN, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>")


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
c as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from g) where k > 1),
p as (select distinct doc_id, unnest(range(i, i + 20)) as p from c),
rem as (select doc_id, count(*) as n_removed, list(p) as ps from p group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(array_to_string(case when ps is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda j: not list_contains(ps, j)), lambda j: w[j]) end, ' ')) as kept_sha256
from d left join rem using (doc_id)
"""
