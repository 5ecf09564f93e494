"""Quality rules by cross-document line frequency.

Lines are normalised (lower case, digits as 0, white space squeezed) and hashed; for every host
(``source`` of a document, or the host of its url) the distinct documents that hold a line are
counted. Lines in more documents of a host than the limit are removed; a document that keeps too
few of its words is rejected. Counts are exact over all documents; a line's copies within one
document are put together before the shuffle, and copies in many documents by partial sums.

The limit is the larger of ``MIN_DOCS`` documents and ``MAX_SHARE`` of the host's documents.

Null texts have no words and no lines. A null host is a host of its own. Repeated rows are documents of their own. An
empty table gives no rows. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A line is boilerplate of a host if more documents than either hold it; a document must keep this share of its words.
MIN_DOCS, MAX_SHARE, KEEP_SHARE, MIN_WORDS = 20, 0.02, 0.3, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGITS = {ord(c): "0" for c in "123456789"}


def repeated_words(grams: np.ndarray, n: int, width: int) -> int:
    """Words covered by windows (hashes of all windows of one text) found at least twice."""
    if len(grams) < 2:
        return 0
    order = np.sort(grams)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    hit = twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams
    cover = np.zeros(n, bool)
    for k in range(width):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base figures of each text and, per distinct normalised line, its hash and its words."""
    import xxhash

    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in common.sliced(t or "" for t in texts):
            raw = [(t or "").encode() for t in texts[lo:hi]]
            hashes, at = common.word_hashes(raw)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            out: dict[str, list] = {k: [] for k in (*names, "lines", "line_words", "line_at")}
            for text, data, a, b in zip(texts[lo:hi], raw, at[:-1], at[1:], strict=True):
                view = np.frombuffer(data, np.uint8)
                space = common._SPACE[view]
                out["n_words"].append(int(b - a))
                out["word_chars"].append(int((~space & ((view & 0xC0) != 0x80)).sum()))
                out["n_symbols"].append(int(_SYMBOL[view].sum()))
                out["n_repeat_words"].append(repeated_words(common.gram_hashes(hashes[a:b], 3), int(b - a), 3))
                seen, dup, lines, places = set(), 0, {}, {}
                for i, (line, plain) in enumerate(zip(data.split(b"\n"), (text or "").lower().translate(_DIGITS).split("\n"), strict=True)):
                    if n := len(line.split()):
                        dup += line in seen
                        seen.add(line)
                        key = xxhash.xxh3_64_intdigest(" ".join(plain.split()).encode())
                        lines[key] = lines.get(key, 0) + n
                        places.setdefault(key, []).append(i)
                out["n_dup_lines"].append(dup)
                out["lines"].append(list(lines))
                out["line_words"].append(list(lines.values()))
                out["line_at"].append(list(places.values()))
            arrays = [pa.array(out[k], pa.int64()) for k in names]
            arrays += [pa.array([(np.array(x, np.uint64).view(np.int64)).tolist() for x in out["lines"]], pa.list_(pa.int64())), pa.array(out["line_words"], pa.list_(pa.int64())), pa.array(out["line_at"], pa.list_(pa.list_(pa.int32())))]
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(lo, hi - lo) for n in keep), *arrays], names=[*keep, *names, "lines", "line_words", "line_at"])


def cleaned(text: Column, removed_lines: Column) -> Column:
    """The text without the lines of these numbers."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed_lines, i)), "\n")


def quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Base figures, base_failed, removed_words, kept and removed_lines (line numbers from 0, for ``cleaned``) of every document of (doc_id, text, <host>)."""
    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    key = F.coalesce(F.concat(F.lit("s"), F.col(host).cast("string")), F.lit("n"))
    source = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(key).alias("host"), "text")
    rows = common.save(common.arrow(source, _measure, f"doc_id long, row long, host long, {names}, lines array<long>, line_words array<long>, line_at array<array<int>>"), "quality-rows")
    lines = rows.select("row", "host", F.explode(F.arrays_zip("lines", "line_words", "line_at")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"), F.col("x.line_at").alias("at"))
    hosts = rows.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), max_share * F.count("*")).alias("limit"))
    common_lines = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    common_lines = common_lines.join(hosts, "host").where("n > limit").select("host", "line")
    removed = lines.join(common_lines, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("removed"), F.sort_array(F.flatten(F.collect_list("at"))).alias("removed_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed_words = F.coalesce("removed", F.lit(0)).cast("long")
    ok = F.col("n_words") - removed_words >= keep_share * F.col("n_words")
    return rows.drop("lines", "line_words", "line_at").join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ok).alias("kept"), removed_words.alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, source from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
li as (select r, source, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
    array_to_string(regexp_extract_all(regexp_replace(lower(line), '[1-9]', '0', 'g'), '\S+'), ' ') as norm
  from (select r, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, sum(n - 1)::bigint as n_dup_lines from (select r, line, count(*) as n from li group by all) group by r),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from (select r, i, count(*) over (partition by r, s) as n from g) where n > 1) group by r),
lf as (select source, norm from (select source, norm, count(distinct r) as n from li group by all) f
  join (select source as src, greatest(20, 0.02 * count(*)) as lim from d group by 1) h on f.source is not distinct from h.src where n > lim),
rem as (select r, sum(words)::bigint as removed_words from li join lf on li.norm = lf.norm and li.source is not distinct from lf.source group by r),
b as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(removed_words, 0)::bigint as removed_words
  from w left join dup using (r) left join rep using (r) left join rem using (r)),
c as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and n_words - removed_words >= 0.3 * n_words as kept, removed_words from c
"""
