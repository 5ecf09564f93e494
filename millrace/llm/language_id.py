"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct byte
n-grams, n = 1 to 4, that both have, over the root of the product of how many each has. N-grams
are hashed to ``2 ** BITS`` places. Landmarks (Nyström) are labelled texts taken evenly from every
language; a text is described by its kernel values with them, whitened by the landmarks' own
kernel matrix, and one ridge regression per language against the rest gives its scores. As all of
that is linear in the n-grams, a batch of texts is scored by one product of its (sparse) presence
matrix with a matrix of places by languages. A score is the softmax of the regressions' outputs.

The model is fitted on a bounded sample of labelled rows, whole texts: of the different rows of each
language about ``PER_LANG`` by the hash of id and text, all if there are fewer, of which the
``LANDMARKS_PER_LANG`` of least hash are landmarks (fewer, at least two, where that would make over
``LANDMARKS`` in all). The sample is written once. Its n-grams are taken on the executors; the
driver gets the landmarks' places and a row of kernel values of each sampled text. Every language met
is learned, also one of a single text that many rows repeat; the model has 1 MiB for each.

All documents are scored over their whole texts, however long. Null texts and texts without a letter
are ``und`` with score 0, as is everything if there is no labelled text. Ties go to the language that
comes first by code point. Repeated rows are scored one by one, and count once in the sample; a null
doc_id is like others. Columns named lang_pred or score are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS, ORDERS = 18, (1, 2, 3, 4)
PER_LANG, LANDMARKS_PER_LANG, LANDMARKS, RIDGE = 300, 40, 640, 1e-3
UNKNOWN = "und"


class Presence:
    """The places of texts' n-grams."""

    def __init__(self):
        self.flag = np.zeros(1 << BITS, bool)

    def places(self, text: str) -> np.ndarray:
        a = np.frombuffer(text.lower().encode(), np.uint8)
        for at in range(0, len(a), 1 << 20):
            part = a[at : at + (1 << 20) + max(ORDERS) - 1].astype(np.uint32)
            code = np.zeros(len(part), np.uint32)
            for n in range(1, max(ORDERS) + 1):
                if len(part) < n:
                    break
                code = code[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
                if n in ORDERS:
                    self.flag[((code * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x5BD1)) >> np.uint32(32 - BITS)] = True
        out = np.flatnonzero(self.flag)
        self.flag[out] = False
        return out


class Landmarks:
    """Places of some texts, by place; ``kernel`` gives a text's kernel values with them."""

    def __init__(self, places: list[np.ndarray]):
        self.size = np.fromiter(map(len, places), np.int64, len(places))
        who, flat = np.repeat(np.arange(len(places)), self.size), np.concatenate(places)
        order = np.argsort(flat, kind="stable")
        self.who = who[order].astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=1 << BITS))])

    def kernel(self, places: np.ndarray) -> np.ndarray:
        first, n = self.start[places], np.diff(self.start)[places]
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.bincount(self.who[at], minlength=len(self.size)) / np.sqrt(np.maximum(1, self.size * len(places)))


class Kernels:
    """A fitted model; ``scores`` gives softmax scores of texts' places over ``langs``."""

    def __init__(self, landmarks: list[np.ndarray], values: np.ndarray, langs: list[str]):
        """From the landmarks' places, and the kernel values and languages of the sampled texts."""
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        known = Landmarks(landmarks)
        y = np.array([self.langs.index(lang) for lang in langs])
        value, vector = np.linalg.eigh(np.stack([known.kernel(p) for p in landmarks]))
        good = value > 1e-6 * value[-1]
        whiten = vector[:, good] / np.sqrt(value[good])
        features = values.astype(np.float64) @ whiten
        mean = features.mean(0)
        z = features - mean
        # classes weigh alike, however many texts stand for them
        weight = (1 / np.bincount(y))[y]
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        base = (weight[:, None] * target).sum(0) / weight.sum()
        a = (z * weight[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
        beta = np.linalg.solve(a, (z * weight[:, None]).T @ (target - base))
        self.project = np.zeros((1 << BITS, len(self.langs)), np.float32)
        for p, row in zip(landmarks, whiten @ beta, strict=True):
            self.project[p] += (row / np.sqrt(max(1, len(p)))).astype(np.float32)
        self.base = (base - mean @ beta).astype(np.float32)

    def scores(self, places: list[np.ndarray]) -> np.ndarray:
        """One sparse product for the batch. Every text has a place."""
        n = np.fromiter(map(len, places), np.int64, len(places))
        total = np.add.reduceat(self.project[np.concatenate(places)], np.cumsum(n) - n, axis=0)
        s = 4 * (total / np.sqrt(n)[:, None] + self.base)
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def sampled(labelled: DataFrame) -> DataFrame:
    """lang, h, text: about ``PER_LANG`` different rows of each language by their hash; all of a language that has no more."""
    has = labelled.where("text is not null and lang is not null and text <> ''").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    # of different rows, as repeats share a hash, and are in or out together
    counts = {r["lang"]: r["n"] for r in has.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    # a row is in if its hash is below its language's share: a map over the rows, no shuffle of others' texts
    share = F.try_element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, 1.0 if n <= PER_LANG else PER_LANG / n)]), F.col("lang")) if counts else F.lit(0.0)
    return has.where(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < share).dropDuplicates(["lang", "h"])


def fit(labelled: DataFrame) -> Kernels:
    """A model of (doc_id, text, lang), on the bounded sample described above."""
    spark = labelled.sparkSession
    texts = common.save(sampled(labelled), "labelled")
    langs = texts.agg(F.count_distinct("lang")).first()[0]
    if not langs:
        return Kernels([], np.zeros((0, 0)), [])
    each = max(2, min(LANDMARKS_PER_LANG, LANDMARKS // langs))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in (whole.slice(lo, 64) for whole in batches for lo in range(0, whole.num_rows, 64)):
            found = [presence.places(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(found, pa.list_(pa.int32()))], names=["lang", "h", "places"])

    order = [("lang", "ascending"), ("h", "ascending")]
    marks = texts.join(texts.select("lang", "h", F.row_number().over(Window.partitionBy("lang").orderBy("h")).alias("k")).where(F.col("k") <= each), ["lang", "h"]).select("lang", "h", "text")
    landmarks = [p.values.to_numpy().astype(np.int64) for p in common.arrow(marks, places, "lang string, h long, places array<int>").toArrow().sort_by(order)["places"]]
    given = spark.sparkContext.broadcast(landmarks)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence, known = Presence(), Landmarks(given.value)
        for batch in (whole.slice(lo, 64) for whole in batches for lo in range(0, whole.num_rows, 64)):
            found = [known.kernel(presence.places(t)).astype(np.float32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(found, pa.list_(pa.float32()))], names=["lang", "h", "k"])

    rows = common.arrow(texts, values, "lang string, h long, k array<float>").toArrow().sort_by(order)
    common.drop(texts)
    return Kernels(landmarks, np.stack([k.values.to_numpy() for k in rows["k"]]), rows["lang"].to_pylist())


def predict(docs: DataFrame, model: Kernels) -> DataFrame:
    """``docs`` with lang_pred and score added; every other column is carried along."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, m, presence = regex.compile(r"\p{L}"), model.value, Presence()
        for batch in (whole.slice(lo, 128) for whole in batches for lo in range(0, whole.num_rows, 128)):
            texts = batch.column(at).to_pylist()
            ok = [i for i, t in enumerate(texts) if t and m.langs and letter.search(t)]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if ok:
                s = m.scores([presence.places(texts[i]) for i in ok])
                for i, best, row in zip(ok, s.argmax(1).tolist(), s, strict=True):
                    langs[i], scores[i] = m.langs[best], float(row[best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.arrow(docs, run, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """True for the test fold: crc32 of the id as text, modulo 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; fitted on the rows that aren't held out."""
    fold = held_out(F.col("doc_id"))
    model = fit(docs.where(~fold).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", fold.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
