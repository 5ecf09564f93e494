"""Fill-in-the-middle, vector codes and byte-level BPE against brute force, on odd and on repeated input."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, fill_middle, queries, vector_codes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def texts():
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", "\t\t", "Ende", "é", "日本語", "😀", "😀😀", " ", " x", "\u0085", "\x1c", "<", "P>", "<S", "it's", "'ll", "12", "²", "!", "é", "\r\n", "\x0b", "ａ"]
    out = [None, "", " ", "\n \n", "a", "😀", "a<P>b", "<S>", "x <M> y", "<P", "<S><", "< P>", "�", "​ a", "don't 'S", " a  b ", "x" * 5_000, "  \n" * 400 + "end"]
    out += ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300)]
    long = " ".join(f"w{rng.randrange(10**6)}é" for _ in range(200_000))  # over 1 MiB
    return [*out, long, "😀" * 300_000, *out[20:24], *out[20:24]]


@pytest.fixture(scope="module")
def rows():
    ids = [None, (1 << 63) - 1, -5, 7, 7, *range(100, 1000)]
    return list(zip(ids, texts(), strict=False))


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = "text2 string, n string, form string, units string, ids string, data string, digest string, h1 string"
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], f"doc_id long, text string, {clash}").repartition(5).cache()


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_fill_middle(docs, rows):
    def brute(doc, text):
        text, h = text or "", sha("42:" + ("" if doc is None else str(doc)))
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        u = WORD.findall(text)
        assert "".join(u) == text
        i, j = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        a, b, z = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
            return doc, len(u), "plain", None, None, sha(text), sha(text)
        if h4 % 100 < 80:
            return doc, len(u), "spm", len(a), len(b), sha(f"<S>{z}<P>{a}<M>{b}"), sha(text)
        return doc, len(u), "psm", len(a), len(b), sha(f"<P>{a}<S>{z}<M>{b}"), sha(text)

    got = fill_middle.digests(fill_middle.fill_in_middle(docs)).collect()
    assert in_order(got) == in_order(brute(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", sorted(fill_middle.UNITS))
def test_units(docs, unit):
    """The pieces between boundaries are the grammar's matches."""
    grammar = re.compile(fill_middle.UNITS[unit][0])
    for r in docs.where("text is not null").select("text", fill_middle.units(F.col("text"), unit).alias("u")).collect():
        assert r.u == grammar.findall(r.text)


def test_fill_middle_of_other_marks(docs):
    marks = ("[p.", "$s$", "\\m")
    got = fill_middle.fill_in_middle(docs, unit="line", rate=100, spm=50, marks=marks)
    back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert in_order(back) == in_order((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


def nearest(part, book):
    far = [sum((int(a) - int(b)) ** 2 for a, b in zip(part, z, strict=True)) for z in book]
    return min(range(len(book)), key=lambda e: (far[e], e)), min(far)


def brute_codes(rows, parts, entries, rounds):
    """By whole comparisons, one part at a time."""
    fits = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [min(max(math.floor(x * 1024), -(1 << 27)), 1 << 27) for x in v], lab) for i, v, lab in rows if fits(v)]
    dim = max(len(v) for _, v, _ in kept)
    kept = sorted([(i, v + [0] * (-dim % parts), lab) for i, v, lab in kept if len(v) == dim], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = -(-dim // parts)
    cut = [[v[p * w : (p + 1) * w] for _, v, _ in kept] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    for _ in range(rounds):
        for c, book in zip(cut, books, strict=True):
            mine = [nearest(x, book)[0] for x in c]
            for e in set(mine):
                own = [x for x, m in zip(c, mine, strict=True) if m == e]
                book[e] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    got = [[nearest(x, b) for x in c] for c, b in zip(cut, books, strict=True)]
    errors = [sum(g[i][1] for g in got) for i in range(len(kept))]
    labels = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        labels[lab] = labels.get(lab, 0) + e
    digest = sha(",".join(str(x) for b in books for z in b for x in z))
    return [(i, "".join(f"{g[n][0]:02x}" for g in got), errors[n], labels[lab], digest) for n, (i, _, lab) in enumerate(kept)]


def vectors(dim=8, n=400):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-4, 5, dim) / 64 + 0.0003], int(i % 7)) for i in range(n)]
    rows += [(5_000 + i, [0.25] * dim, 3) for i in range(n // 2)]  # a third are copies
    rows += [(9_000, None, 1), (9_001, [0.1, None, *[0.0] * (dim - 2)], 1), (9_002, [float("nan")] * dim, 1), (9_003, [float("inf")] * dim, None), (9_004, [], 1), (9_005, [0.5] * (dim - 1), 1)]
    rows += [(9_006, [1e30, -1e30, *[0.0] * (dim - 2)], None), (None, [0.5] * dim, None), (3, [0.1] * dim, 2), rows[3], rows[3], ((1 << 63) - 1, [-0.0] * dim, 2)]
    return rows


ROWS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("dim", "parts", "entries", "rounds", "leaf", "chunk"), [(8, 4, 16, 4, 32, 8_192), (8, 2, 256, 2, 3, 50), (7, 4, 5, 3, 1, 64), (8, 4, 1, 1, 4, 100), (8, 4, 12, 0, 4, 100)])
def test_vector_codes(spark, monkeypatch, dim, parts, entries, rounds, leaf, chunk):
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in vectors(dim)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{ROWS}, code string, error int").repartition(3)
    assert in_order(vector_codes.code_table(df, parts, entries, rounds).collect()) == in_order(brute_codes(rows, parts, entries, rounds))


def test_whole_subtrees():
    """Far clusters are assigned by nodes, whose points no one looks at; each point once, to the nearest entry."""
    rng = np.random.default_rng(6)
    entries = rng.integers(-10**5, 10**5, (40, 4))
    points = np.concatenate([z + rng.integers(-60, 60, (200, 4)) for z in entries])
    tree = vector_codes.Tree(points)
    seen = np.zeros(len(points), int)
    at_once = 0
    for nodes, best, alive in vector_codes.filtered(tree, entries):
        who, node = vector_codes._members(tree, nodes)
        seen[who] += 1
        if alive is None:
            at_once += len(who)
            assert (best[node] == ((points[who][:, None] - entries) ** 2).sum(2).argmin(1)).all()
    assert (seen == 1).all() and at_once > 0.8 * len(points) and len(tree.first) < len(points) / 4
    count, total = vector_codes.sums(tree, points, entries)
    near = ((points[:, None] - entries) ** 2).sum(2).argmin(1)
    assert (count == np.bincount(near, minlength=40)).all() and all((total[e] == points[near == e].sum(0)).all() for e in range(40))


def test_vector_codes_of_many_labels(spark):
    """Labels over and under a share of the rows are added up alike."""
    rows = [(i, i % 3 if i % 2 else None if i % 10 == 0 else i, float(i)) for i in range(3_000)]
    df = spark.createDataFrame([(i, lab, int(e)) for i, lab, e in rows], "vec_id long, label int, error long")
    total = {}
    for _, lab, e in rows:
        total[lab] = total.get(lab, 0) + int(e)
    assert {r.vec_id: r.label_error for r in vector_codes.with_label_errors(df, most=50).collect()} == {i: total[lab] for i, lab, _ in rows}


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.Codec(byte_bpe.library_json(ranks, byte_bpe.PATTERN))


@pytest.fixture(scope="module")
def tiktoken_encode(ranks):
    import public_tokenizers
    import tiktoken

    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize(("cache", "size"), [(400_000, 1 << 20), (20, 300)])
def test_byte_bpe(docs, rows, tiktoken_encode, monkeypatch, cache, size):
    monkeypatch.setattr(byte_bpe, "CACHE", cache)
    monkeypatch.setattr(byte_bpe, "SLICE", size)
    got = byte_bpe.round_trip(docs, queries.tokenizer_file("byte_bpe_50k.tiktoken"), byte_bpe.PATTERN).collect()
    want = [(doc, len(ids := tiktoken_encode(text or "")), sha(np.array(ids, "<u4").tobytes()), sha(text or "")) for doc, text in rows]
    assert in_order(got) == in_order(want)


def test_every_character(codec, tiktoken_encode):
    """All code points, between letters, digits, spaces and themselves."""
    for lo in range(0, 0x110000, 512):
        if 0xD800 <= lo < 0xE000:
            continue
        text = "".join(f"a{c}1{c} {c}{c}  {c}!" for c in map(chr, range(lo, lo + 512)))
        ids = np.frombuffer(codec.encode([text])[0], "<u4")
        assert ids.tolist() == tiktoken_encode(text)
        assert codec.decode(ids) == text.encode()


def test_offsets_and_split_characters(codec):
    """As the library gives them; a character split over tokens belongs to the one that ends it when texts are put together."""
    texts_ = [t for t in texts()[1:-12] if len(t) < 4_000] + ["日本😀́é"]
    for t in texts_:
        whole = codec.library.encode(t, add_special_tokens=False)
        ids = np.frombuffer(codec.encode([t])[0], "<u4")
        assert ids.tolist() == whole.ids
        a, b = codec.offsets(ids, t.encode())
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == [tuple(o) for o in whole.offsets]
        assert "".join(codec.token_texts(ids)) == t and len(codec.token_texts(ids)) == len(ids)
    half = np.frombuffer(codec.encode(["😀"])[0], "<u4")[:-1]
    assert "".join(codec.token_texts(half)) == codec.decode(half).decode(errors="replace") != ""


def test_encode_with_offsets(spark, docs, rows, codec):
    bpe = byte_bpe.ByteBPE(spark, queries.tokenizer_file("byte_bpe_50k.tiktoken"), byte_bpe.PATTERN)
    found = bpe.encode(docs, offsets=True).collect()
    assert len(found) == len(rows) and all(len(r.starts) == len(r.ends) == r.n_tokens == len(r.ids) // 4 for r in found)
    nulls = spark.createDataFrame([(1, None, 5), (2, b"", 6)], "doc_id long, ids binary, data int")
    assert [(r.doc_id, r.data) for r in bpe.decode(nulls).collect()] == [(1, None), (2, b"")]


def test_nothing(spark):
    docs_, none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], ROWS)
    assert fill_middle.digests(fill_middle.fill_in_middle(docs_)).collect() == []
    assert byte_bpe.round_trip(docs_, queries.tokenizer_file("byte_bpe_50k.tiktoken"), byte_bpe.PATTERN).collect() == []
    assert vector_codes.code_table(none).collect() == []
    assert vector_codes.code_table(spark.createDataFrame([(1, None, 1)], ROWS)).collect() == []


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_vector_codes"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert in_order(tuple(r[c] for c in columns) for r in df.collect()) == in_order(want.project(", ".join(columns)).fetchall())
