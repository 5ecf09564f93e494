"""Words of text that is written without spaces: a dictionary learned from the corpus, and the most likely path through the lattice of its words.

``learn`` counts the grams of all runs of letters, in DataFrame functions. A gram is a word if it
stands there often enough, holds together (it is more frequent than any two parts of it would make
it by chance) and stands in free neighbourhood (the entropy of the letters beside it, on the side
where it is less). ``segment`` broadcasts the dictionary, whose size is a parameter, as a trie and
finds for each run the path of greatest probability by dynamic programming, in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared

#: Runs of letters that are segmented, and what else is a token. Of Chinese text, by default.
HAN, OTHER = "[一-鿿]+", "[a-z0-9]+"
#: Runs whose words a worker remembers.
REMEMBERED = 100_000


def grams(texts: DataFrame, letters: str = HAN, longest: int = 4) -> DataFrame:
    """gram, left, right, n: how often the grams of all runs of letters in (text) stand between two letters; the empty text stands for an end.
    Equal runs are counted before they are cut."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(letters), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("c"))
    size = F.length("run")
    at = runs.select("run", "c", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    cut = at.select("run", "c", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("i") + 1))).alias("k"))
    beside = lambda i: F.when(i < 1, "").otherwise(F.substring("run", i, F.lit(1)))
    rows = cut.select(F.substring("run", F.col("i"), F.col("k")).alias("gram"), beside(F.col("i") - 1).alias("left"), beside(F.col("i") + F.col("k")).alias("right"), "c")
    return rows.groupBy("gram", "left", "right").agg(F.sum("c").alias("n"))


def learn(texts: DataFrame, letters: str = HAN, longest: int = 4, least: int = 5, cohesion: float = 2.0, entropy: float = 0.5, most: int = 200_000) -> DataFrame:
    """word, n, cohesion, entropy of the words in (text): single letters (cohesion null), and longer grams above the three limits; the ``most`` most frequent, ties by code point.

    Cohesion is the least logarithm, over all ways to cut the gram in two, of its frequency by what the frequencies
    of the two would give; entropy, in nats, is of the letters on that side where it is less."""
    counted = shared.saved(grams(texts, letters, longest), "grams")

    def side(c: str) -> DataFrame:
        e = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
        return counted.groupBy("gram", c).agg(F.sum("n").alias("n")).groupBy("gram").agg(F.sum("n").alias("n"), e.alias(f"{c}_entropy"))

    both = shared.saved(side("left").join(side("right").drop("n"), "gram").select("gram", "n", F.least("left_entropy", "right_entropy").alias("entropy")), "counts")
    total = both.where("length(gram) = 1").agg(F.sum("n")).first()[0] or 0
    free = both.where((F.length("gram") > 1) & (F.col("n") >= least) & (F.col("entropy") >= entropy))
    cut = free.select("gram", "n", "entropy", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    cut = cut.select("gram", "n", "entropy", F.substring("gram", F.lit(1), F.col("k")).alias("a"), F.substring("gram", F.col("k") + 1, F.length("gram")).alias("b"))
    parts = cut.join(both.select(F.col("gram").alias("a"), F.col("n").alias("na")), "a").join(both.select(F.col("gram").alias("b"), F.col("n").alias("nb")), "b")
    held = parts.groupBy("gram").agg(F.first("n").alias("n"), F.min(F.log("n") + math.log(max(1, total)) - F.log("na") - F.log("nb")).alias("cohesion"), F.first("entropy").alias("entropy"))
    single = both.where("length(gram) = 1").select("gram", "n", F.lit(None).cast("double").alias("cohesion"), "entropy")
    return held.where(F.col("cohesion") >= cohesion).unionByName(single).withColumnRenamed("gram", "word").orderBy(F.desc("n"), "word").limit(most)


class Lattice:
    """The words of a dictionary in a trie, each with the logarithm of its probability; a letter that is no word has less than the rarest."""

    def __init__(self, words: list[tuple[str, int]]):
        total = max(1, sum(n for _, n in words))
        self.unknown = math.log(0.5 / total)
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = math.log(n / total)
        self.known: dict[str, list[str]] = {}

    def path(self, run: str) -> list[str]:
        """The words of greatest probability together; of equal ones those whose last words are longer."""
        if run in self.known:
            return self.known[run]
        score, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for i in range(len(run)):
            node = self.root
            for j in range(i, len(run)):
                node = node.get(run[j])
                if node is None:
                    break
                if "" in node and score[i] + node[""] > score[j + 1]:
                    score[j + 1], back[j + 1] = score[i] + node[""], i
            if score[i] + self.unknown > score[i + 1]:
                score[i + 1], back[i + 1] = score[i] + self.unknown, i
        out, at = [], len(run)
        while at:
            out.append(run[back[at] : at])
            at = back[at]
        out.reverse()
        if len(self.known) < REMEMBERED and len(run) <= 64:
            self.known[run] = out
        return out


def segment(texts: DataFrame, words: DataFrame, letters: str = HAN, other: str = OTHER) -> DataFrame:
    """``texts`` with tokens: the words of each run of letters by the dictionary (word, n), and the other tokens, in the order of the lower-cased text (null of a null text)."""
    import pyarrow as pa

    sent = texts.sparkSession.sparkContext.broadcast([(r.word, r.n) for r in words.select("word", "n").toLocalIterator()])
    texts = texts.drop("tokens")
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, find = Lattice(sent.value), re.compile(f"({letters})|{other}")
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch, out = whole.slice(lo, 256), []
                for text in batch.column(at).to_pylist():
                    out.append(None if text is None else [w for m in find.finditer(text.lower()) for w in (lattice.path(m[0]) if m[1] else (m[0],))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], names=[*batch.schema.names, "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{fields}, tokens array<string>")


def joined(tokens: Column) -> Column:
    """Tokens as one text, which ``spaced`` takes apart again: for what wants a text and a tokeniser, as the BM25 index."""
    return F.array_join(tokens, " ")


def spaced(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")
