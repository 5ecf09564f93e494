"""Byte-level BPE by the ranks of a tiktoken file, encoded by the tokenizers library over Arrow batches, and decoded.

A rank file holds byte strings. Each byte stands for one printable character in the library's
model, and each string of several bytes for the merge of the two strings that the merges of lower
rank make of it, so the library's model gives the ids that merging by ranks gives. The text is split
by the pattern of the ranks first; each match is encoded separately.

A match never goes from a character that is no white space to a space: a text may be cut there. The
library encodes the distinct pieces of a slice of texts that the worker's cache doesn't hold yet, all
of them as one text; pieces of over ``LONG`` characters are encoded each time. No whole text goes to
the library unless it has no such place.

Offsets come of the bytes: a token's length in bytes is known, and a table of which character each
byte of the text belongs to gives the characters it covers. Tokens that share a character (one split
among them) all cover it. Decoding puts the tokens' bytes together and reads them as UTF-8 only then;
``token_texts`` gives each character to the token that ends it.

Null and empty texts have no tokens. Rows are worked on alone, so null ids and repeated rows are like
others. Very long texts are encoded whole, piece by piece. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Fixed value: the pattern that splits a text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker's cache holds, characters from which a piece isn't kept in it, bytes of text worked on at once.
CACHE, LONG, SLICE = 400_000, 64, 1 << 20
#: A place where no match goes on: white space, as Python has it, holds all that the patterns have.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts of which not every space is such a place.
_UNEVEN = re.compile(r"\s\s|\s$")
_CODECS: dict[str, Codec] = {}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file and their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two strings whose merge makes the token, when all merges of lower rank are done."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(r, i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if (r := ranks.get(a + b, most)) < most]
        if not found:
            raise ValueError(f"no two tokens of lower rank make {token!r}")
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def library_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's tokenizer of the ranks, as JSON."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_chars()
    shown = lambda token: "".join([table[b] for b in token])
    merges = [tuple(map(shown, halves(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    made.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


class Codec:
    """Encodes texts to ids, as bytes of little-endian unsigned 32-bit integers, and back."""

    def __init__(self, library: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(library)
        back = {c: b for b, c in enumerate(byte_chars())}
        vocabulary = self.library.get_vocab()
        self.tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for shown, i in vocabulary.items():
            self.tokens[i] = bytes([back[c] for c in shown])
        self.size = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Put the ids of pieces, each after a space, into the cache. Those that end in no white space go to the
        library as one text, as they might stand in one; the bytes of its tokens tell where each ends."""
        outer = [p for p in new if p[-1].isspace()]
        inner = list(set(new).difference(outer)) if outer else new
        whole, *rest = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast([f" {p}" for p in (" ".join(inner), *outer)], add_special_tokens=False)]
        if inner:
            ends = np.searchsorted(np.cumsum(self.size[whole]), np.cumsum([len(p.encode()) + 1 for p in inner])) + 1
            data, ends = whole.tobytes(), (4 * ends).tolist()
            self.cache.update(zip(inner, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        self.cache.update(zip(outer, (ids.tobytes() for ids in rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) if _UNEVEN.search(t) else t.split(" ") for t in texts]
        first = [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast([p.pop(0) for p in cut], add_special_tokens=False)]
        flat = list(chain.from_iterable(cut))
        if new := list(set(flat).difference(self.cache)):
            self._learn(new)
        found = list(map(self.cache.__getitem__, flat))
        for p in new:
            if len(p) > LONG:
                del self.cache[p]
        if len(self.cache) > CACHE:  # those met first go, and come back if they are met again
            self.cache = dict(islice(self.cache.items(), len(self.cache) - CACHE // 2, None))
        ends = np.cumsum([len(p) for p in cut]).tolist()
        return [f + b"".join(found[a:b]) for f, a, b in zip(first, [0, *ends], ends, strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids together."""
        size = self.size[ids]
        at = np.arange(int(size.sum())) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.flat[at].tobytes()

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each token the first character of the text that it covers some of, and the one after the last."""
        end = np.cumsum(self.size[ids])
        character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
        return character[end - self.size[ids]], character[end - 1] + 1

    def token_texts(self, ids: np.ndarray) -> list[str]:
        """Each token's part of the decoded text; what is no UTF-8 is replaced."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.tokens[i]) for i in ids.tolist()]
        if out:
            out[-1] += reader.decode(b"", True)
        return out


def codec(key: str, library: str) -> Codec:
    """The worker's codec, kept from task to task."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(library)
    return _CODECS[key]


class ByteBPE:
    """``encode`` and ``decode`` of tables by a rank file, which the driver reads; workers get the library's tokenizer (a few MB, as large as the vocabulary)."""

    def __init__(self, spark, path: str, pattern: str):
        self.key = f"{path}\0{pattern}"
        self.sent = spark.sparkContext.broadcast(library_json(read_ranks(path), pattern))

    def encode(self, docs: DataFrame, offsets: bool = False) -> DataFrame:
        """doc_id, n_tokens, ids of every document (doc_id, text): little-endian unsigned 32-bit integers; and,
        if asked for, starts and ends, each token's characters."""
        key, sent = self.key, self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = codec(key, sent.value)
            for batch in batches:
                for part, raw in common.pieces(batch):
                    for lo, hi in common.sliced(raw, SLICE):
                        found = c.encode([t.decode() for t in raw[lo:hi]])
                        columns = [part.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())]
                        if offsets:
                            pairs = [c.offsets(np.frombuffer(x, "<u4"), t) for x, t in zip(found, raw[lo:hi], strict=True)]
                            columns += [pa.array([p[i] for p in pairs], pa.list_(pa.int32())) for i in range(2)]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "starts", "ends"][: len(columns)])

        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary"
        return common.arrow(docs.select("doc_id", "text"), run, schema + (", starts array<int>, ends array<int>" if offsets else ""))

    def decode(self, rows: DataFrame) -> DataFrame:
        """The rows (ids and any other columns) with data, the decoded bytes; null of null ids."""
        key, sent = self.key, self.sent
        rows = rows.drop("data")
        at = rows.columns.index("ids")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = codec(key, sent.value)
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    data = [None if x is None else c.decode(np.frombuffer(x, "<u4")) for x in batch.column(at).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "data"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return common.arrow(rows, run, f"{fields}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: its ids, and the bytes that these decode to."""
    bpe = ByteBPE(docs.sparkSession, path, pattern)
    return bpe.decode(bpe.encode(docs)).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
