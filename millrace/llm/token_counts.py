"""Token counts by a map-side two-tier lookup.

First tier: the token counts of the most frequent chunks (space-delimited, lower-cased pre-token
runs) of a bounded sample of documents (``SAMPLE_DOCS`` by id hash), broadcast as one compact table (at most ``FREQUENT``
entries). Second tier: each worker's own cache of the library's answers for all other chunks.
Counts depend on neither tier, as both hold the library's answers; no pre-token is shuffled.

Null and empty texts have no bytes and no tokens; repeated rows are counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import LengthCounter

#: Documents (about) and characters of each sampled for the first tier, entries of the first tier.
SAMPLE_DOCS, SAMPLE_CHARS, FREQUENT = 1_000, 20_000, 65_536
_COUNTERS: dict[tuple, LengthCounter] = {}


def frequent_lengths(docs: DataFrame, tokenizer: str) -> tuple[bytes, bytes]:
    """The first tier, from about ``SAMPLE_DOCS`` documents of small id hash: chunks as one blob, lengths as 16-bit integers."""
    # by a share instead of a sort: no partition sends more texts to the driver than its part of the sample
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.where("text is not null").where(place < share).select(F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).limit(4 * SAMPLE_DOCS).collect()
    counter = LengthCounter(tokenizer)
    found = Counter(c for r in rows if not counter.odd(r.text) for c in r.text.lower().split())
    chunks = sorted(c for c, _ in found.most_common(FREQUENT))
    lengths = [n if n < 65_536 else 0 for n in counter.count(chunks)]
    return "\n".join(chunks).encode(), np.array(lengths, np.uint16).tobytes()


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document (doc_id, text)."""
    first = frequent_lengths(docs, tokenizer)
    tier, stamp = docs.sparkSession.sparkContext.broadcast(first), zlib.crc32(first[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, stamp)
        if key not in _COUNTERS:
            _COUNTERS.clear()
            chunks, lengths = tier.value
            table = dict(zip(chunks.decode().split("\n"), np.frombuffer(lengths, np.uint16).tolist(), strict=True)) if lengths else {}
            _COUNTERS[key] = LengthCounter(tokenizer, {c: n for c, n in table.items() if n})
        counter = _COUNTERS[key]
        for batch in batches:
            texts = batch.column("text")
            counts = [n for lo in range(0, len(texts), 256) for n in counter.count([t or "" for t in texts.slice(lo, 256).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("n_bytes")], names=["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = common.arrow(rows, run, "doc_id long, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
