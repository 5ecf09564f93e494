"""The training-data operators against brute force, on odd and on repeated input."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import common, decontaminate, jaccard_join, language_id, licenses, mixing, pipeline, quality, queries, repeats, substring_dedup, suffix_dedup, token_counts, token_output

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = ["the", "Ende", "élan", "of", "x1", "a,b", "…", "日本", "foo", "bar", "baz", "qux"] + [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choices(words, k=40))
    rows = [(None, None, None, None, None), (1000, "", "en", "s1", 0), (1001, " \n\t ", None, None, 3), (1002, "?! 42", "en", "s2", 5), (1003, "one", "en", "s2", 3)]
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(1, 90)))
        if i % 5 == 0:
            text = rows[rng.randrange(5, len(rows))][1] if len(rows) > 5 else text
        if i % 7 == 0:
            text += "\n" + passage + "  " + " ".join(rng.choices(words, k=3))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None]), len(text)))
    rows.append((2000, "é" * 300 + " " + "ab " * 400 + passage, "fr", "s1", 1))
    # the largest id, a null id with a text, one id with two texts, a long text, a repeated row
    rows += [((1 << 63) - 1, rows[20][1] + " " + passage, "en", "s2", 1), (None, passage + " Ende", "de", None, 2), (8, passage + " the Ende", "de", "s1", 2)]
    rows.append((3000, " ".join(rng.choices(words, k=6_000)), "en", "s3", 9))
    return rows + [rows[12], rows[12]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = "mark string, size long, score double, lang_pred string, n_words string, taken string, component_id string, spans string, data string, bucket string"
    return spark.createDataFrame([(*r, "clash", 7, 0.5, *["clash"] * 7) for r in rows], f"{SCHEMA}, {extra}").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_output(docs, rows):
    from tokenizers import Tokenizer

    tk, at, want = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json")), 0, []
    got = [tuple(r) for r in token_output.token_table(docs.select("doc_id", "text"), queries.tokenizer_file("byte_bpe_50k.json"), bits=True).collect()]
    for doc, text, *_ in rows:
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([(a, c, d) for a, _, c, d in got], key=key) == sorted(want, key=key)
    last = -1
    for doc, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at and (doc if doc is not None else -1) >= last
        at, last = at + n, doc if doc is not None else -1


def test_planes_round_trip():
    ids = np.random.default_rng(0).integers(0, 1 << 31, 50_000).astype("<u4")
    for bits in (False, True):
        s = token_output.Segment(token_output.pack(np.array([20_000, 30_000]), ids, bits, block=4096))
        assert (s.ids() == ids).all() and (s.block(3) == ids[3 * 4096 : 4 * 4096]).all() and s.lengths.tolist() == [20_000, 30_000]


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, queries.tokenizer_file("word_bpe_49k.json"), limit=50).collect())
    want = sorted((str(r[0]), len((r[1] or "").encode()), n := len(tk.encode(r[1] or "", add_special_tokens=False)), n > 50) for r in rows)
    assert got == want


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, num):
    """doc_id: (set sizes, component) by brute force; rows with one id are one document."""
    sets = [(r[0], shingles(r[1], k)) for r in rows if r[0] is not None]
    group = {d: d for d, _ in sets}
    for _ in group:
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= num * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    return sorted((d, len(s), group[d]) for d, s in sets)


def joined(df, k, num):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, k, num, 100).collect()]
    assert all(r[2] is None for r in got if r[0] is None)
    return sorted(r for r in got if r[0] is not None)


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard(docs, rows, k, num):
    assert joined(docs, k, num) == components(rows, k, num)


@pytest.mark.parametrize("rounds", [0, 2])
def test_jaccard_of_large_groups(spark, monkeypatch, rounds):
    """Chains of near copies over several tasks; rows with one id and different texts."""
    rng, rows, text = random.Random(5), [(None, None)], []
    for i in range(60):
        if i % 20 == 0:
            text = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        text = text[:]
        text[rng.randrange(60)] = f"x{i}"
        rows.append((100 + i, " ".join(text)))
    rows += [(5, "a b c d e f"), (7, "a b c d e f"), (7, "g h i j k l"), (9, "g h i j k l"), (3, rows[30][1]), (3, "g h i j k l"), (4, rows[10][1]), (4, rows[50][1])]
    monkeypatch.setattr(jaccard_join, "REGION", 150)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "FEW", 1_000_000 if rounds else 0)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), 2, 70) == components(rows, 2, 70)


def test_bitmaps():
    """No pair that reaches the threshold is told apart; most others are."""
    rng = np.random.default_rng(2)
    base, apart = rng.integers(0, 1 << 60, (20, 400)).astype(np.uint64), 0
    for b in base:
        x, y = np.unique(b), np.unique(np.concatenate([b[: rng.integers(330, 400)], rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64)]))
        c = len(np.intersect1d(x, y))
        label = jaccard_join.fitting(np.array([len(x), len(y), 390]), [*map(jaccard_join.bitmap, (x, y, rng.integers(0, 1 << 60, 390).astype(np.uint64)))], 85, 100)
        assert label[0] == label[1] or 100 * c < 85 * (len(x) + len(y) - c)
        apart += label[2] != label[0]
    assert apart == 20


def test_region_by_cells():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(60)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.06], rng.integers(0, 1 << 60, 2).astype(np.uint64)])) for b in base for _ in range(8)]
    region = jaccard_join.Region(sets, 80, 100)
    region.join(np.arange(len(sets)))
    group = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                group[group == group[i]] = group[j]
    pairs = lambda g: {(i, int(np.flatnonzero(g == g[i])[0])) for i in range(len(g))}
    assert pairs(region.component) == pairs(group)


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert sum(r.taken for r in got) == int(1.5 * sum(r["size"] for r in got) + 1e-6)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


@pytest.mark.parametrize(("together", "crowded"), [(16_384, 4), (3, 1)])
def test_suffixes(docs, rows, together, crowded, monkeypatch):
    monkeypatch.setattr("millrace.llm.repeats.TOGETHER", together)
    monkeypatch.setattr("millrace.llm.repeats.CROWDED", crowded)
    where = {}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            s = data[i : i + 50]
            where[s] = min(where.get(s, 1 << 65), doc if doc is not None else 1 << 64)
    want = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        cover = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if where[data[i : i + 50]] < (doc if doc is not None else 1 << 64):
                cover[i : i + 50] = True
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        n_spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        want.append((str(doc), len(data), int(cover.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()) == sorted(want)


def test_column_wise(tmp_path):
    texts = [b"banana", b"ananas", b"nan", b"banana", b"a"]
    read, left, bwt = suffix_dedup.column_wise(texts, str(tmp_path))
    want = sorted((t[len(t) - n :], i, n) for i, t in enumerate(texts) for n in range(len(t) + 1))
    assert [texts[r][len(texts[r]) - n :] for r, n in zip(read, left, strict=True)] == [w[0] for w in want]
    letters = sorted(set(b"".join(texts)))
    assert [texts[r][len(texts[r]) - n - 1] if n < len(texts[r]) else None for r, n in zip(read, left, strict=True)] == [letters[b - 1] if b else None for b in bwt]


def test_reads_by_columns(monkeypatch):
    """Windows of reads by rounds over columns, without files and without sorting shorter suffixes among longer ones."""
    import tempfile

    import numpy as np

    monkeypatch.setattr(tempfile, "TemporaryDirectory", None)
    length, gram, rng, at = 12, 5, random.Random(3), {}
    letters = [bytes(rng.choices(b"ab", k=40)) + bytes(rng.choices(range(256), k=20)) for _ in range(30)]
    stretches = [t[: rng.randint(30, 60)] + rng.choice(letters)[rng.randint(0, 20) :] for t in letters for _ in range(8)]
    for n, text in enumerate(stretches):
        places, first, last = repeats.anchors(common.gram_hashes(repeats.LETTERS[np.frombuffer(text, np.uint8)], gram), gram, length)
        for p, a, b in zip(places.tolist(), first.tolist(), last.tolist(), strict=True):
            at.setdefault(text[a : b + length], (n, a, p - a))
    texts = list(at)
    doc, place, anchor = (np.array(x) for x in zip(*at.values(), strict=True))
    assert (suffix_dedup.anchored(texts, gram) == anchor).all()
    least = {}
    for t, d in zip(texts, doc.tolist(), strict=True):
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(least.get(w, d), d)
    got = {}
    for read, a, b, first, _ in zip(*(x.tolist() for x in suffix_dedup.first_documents(length, gram)(texts, doc, place)), strict=True):
        got |= {(read, i): first for i in range(a, b + 1)}
    assert got == {(r, i): least[t[i : i + length]] for r, t in enumerate(texts) for i in range(len(t) - length + 1)}
    assert len(texts) > 1_000 and sum(least[t[i : i + length]] < d for t, d in zip(texts, doc.tolist(), strict=True) for i in range(len(t) - length + 1)) > 1_000


@pytest.mark.parametrize(("together", "crowded"), [(16_384, 4), (3, 1)])
def test_substrings(docs, rows, together, crowded, monkeypatch):
    monkeypatch.setattr("millrace.llm.repeats.TOGETHER", together)
    monkeypatch.setattr("millrace.llm.repeats.CROWDED", crowded)
    monkeypatch.setattr(substring_dedup, "SUBTREE", 8_192 if together > 3 else 3)
    first = {}
    for doc, text, *_ in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 19):
            at = (doc if doc is not None else 1 << 64, i)
            first[tuple(w[i : i + 20])] = min(first.get(tuple(w[i : i + 20]), at), at)
    want = []
    for doc, text, *_ in rows:
        w = (text or "").encode().split()
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (doc if doc is not None else 1 << 64, i) for j in range(i, i + 20)}
        want.append((str(doc), len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()) == sorted(want)


def test_subtrees():
    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9, 9, 9, 9])
    for most in (1, 3, 100):
        nodes = []
        for depth, group in substring_dedup.prefix_groups(np.arange(11), words, 3, most):
            leaves, node = substring_dedup.deep_nodes(group, depth, words, 3)
            nodes += [tuple(sorted(leaves[node == n].tolist())) for n in np.unique(node)]
        assert sorted(nodes) == [(0, 6), (9, 10)]


def test_decontamination(spark, docs, rows, monkeypatch):
    passage = next(r[1] for r in rows if r[0] == 7).split("\n")[-1]
    items = [("a", passage), ("b", "ONE"), ("c", None), ("d", "nothing of the kind"), (None, "w3 w4"), ("a", passage)]
    for block in (2_000_000, 5):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect())
        want = []
        for doc, text, *_ in rows:
            w, hit, names = decontaminate.words(text), set(), set()
            for name, item in items:
                v = decontaminate.words(item)
                for i in range(max(1, len(v) - 9) if v else 0):
                    s = v[i : i + 10]
                    for j in range(len(w) - len(s) + 1):
                        if w[j : j + len(s)] == s:
                            hit |= set(range(j, j + len(s)))
                            names.add(name or "")
            want.append((str(doc), len(w), len(hit), len(names)))
        assert got == sorted(want)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(("repeats", "others"), [(3_000, 400), (1_000, 0)])
def test_languages_of_repeats(spark, repeats, others):
    """A language of one text, however often it stands there, is learned as others are."""
    rng = random.Random(2)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(80)] for lang, letters in (("aa", "abcdefg"), ("bb", "hijklmn"), ("cc", "opqrstu"))}
    text = lambda lang: " ".join(rng.choices(words[lang], k=60))
    rows = [(None, x, "cc") for x in [text("cc")] * repeats]
    for lang in ("aa", "bb"):
        rows += [(i, text(lang), lang) for i in range(others)] if others else [(None, x, lang) for x in [text(lang)] * repeats]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "cc"]
    asked = spark.createDataFrame([(text(lang), lang) for lang in words for _ in range(20)], "text string, lang string")
    assert all(r.lang == r.lang_pred for r in language_id.predict(asked, model).collect())


def test_language_of_odd_texts(docs, rows):
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in language_id.languages(docs).collect())
    assert len(got) == len(rows)
    by_id = {d: (p, x) for d, p, x in got}
    assert by_id["1000"] == by_id["1001"] == by_id["1002"] == ("und", 0.0) and by_id["1003"][0] in ("en", "de", "fr")
    assert set(language_id.predict(docs, language_id.fit(docs)).columns) == set(docs.columns)


def test_kernels():
    """Kernel values against sets of n-grams, and scores against the dense formula."""
    texts = ["der Hund bellt laut", "the dog barks", "el perro ladra", "ein Hund", "a dog", "un perro", "é" * 9]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}
    presence = language_id.Presence()
    places, sets = [presence.places(t) for t in texts], [grams(t.lower().encode()) for t in texts]
    assert not presence.flag.any() and [len(p) for p in places] == [len(x) for x in sets]
    known = language_id.Landmarks(places[:4])
    values = np.array([known.kernel(p) for p in places])
    want = [[len(x & y) / (len(x) * len(y)) ** 0.5 for y in sets[:4]] for x in sets]
    assert np.allclose(values, want)
    model = language_id.Kernels(places[:4], values[:6], ["de", "en", "es", "de", "en", "es"])
    scores = model.scores(places)
    k = np.array(want)
    for i in range(len(texts)):
        dense = np.zeros(1 << language_id.BITS)
        dense[places[i]] = 1 / len(places[i]) ** 0.5
        s = 4 * (dense @ model.project + model.base)
        assert np.allclose(scores[i], np.exp(s) / np.exp(s).sum(), atol=1e-5)
    value, vector = np.linalg.eigh(k[:4])
    z = (k @ (vector / value**0.5))[:6]
    y = np.array([0, 1, 2, 0, 1, 2])
    target = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    w = 1 / np.bincount(y)[y]
    base, mean = (w[:, None] * target).sum(0) / w.sum(), z.mean(0)
    beta = np.linalg.solve(((z - mean) * w[:, None]).T @ (z - mean) + language_id.RIDGE * np.eye(4), ((z - mean) * w[:, None]).T @ (target - base))
    e = np.exp(4 * ((z - mean) @ beta + base))
    assert np.allclose(scores[:6], e / e.sum(1, keepdims=True), atol=1e-4)


def test_licenses(spark):
    texts = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "All rights reserved."), (3, "driver's licence test is on monday"), (4, None), (5, "Released under the MIT License.\n\nfoo\n" + licenses.TEMPLATES["GPL-3.0"])]
    got = {r.doc_id: (r.n_blocks, r.n_licensed, r.licenses) for r in licenses.licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1, "Apache-2.0"), 2: (1, 1, "proprietary"), 3: (1, 0, ""), 4: (0, 0, ""), 5: (2, 2, "GPL-3.0,MIT")}


def test_every_license_of_a_block(spark):
    t = licenses.TEMPLATES
    mit, filler = t["MIT"], " ".join(f"word{i}" for i in range(120))
    texts = [(1, f"{mit}\n{t['proprietary']}"), (2, "\n".join(t[n] for n in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"))), (3, f"{filler} {mit} {filler}"), (4, f"licensed {filler} {t['MPL-2.0'].replace('Form', 'File')} {filler}")]
    got = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in (1, 2, 3)] == ["MIT,proprietary", "Apache-2.0,CC-BY-NC-4.0,GPL-3.0,MIT", "MIT"]
    assert {(m.license, m.difference, m.wording) for m in got[4].matches} == {("MPL-2.0", 0.0625, "form > file")}


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    filler, wide = "\n".join(f"line {i} of the text" for i in range(150)), gpl.replace("\n", "\n *" + " " * 900)
    texts = [(1, mit), (2, bsd), (3, gpl), (4, f"{filler}\n# {bsd}\n{filler}"), (5, f"foo\n\n{mit}\n \nbar\n\n{bsd}"), (6, f"{filler}\n{wide}\n{filler}")]
    got = {r.doc_id: (r.licenses, r.n_blocks) for r in licenses.licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1, 2, 3, 5)] == [("MIT-grant", 1), ("BSD-3-Clause", 1), ("GPL-3.0-header", 1), ("BSD-3-Clause,MIT-grant", 2)]
    assert got[4][0] == "BSD-3-Clause" and got[6][0] == "GPL-3.0-header"


def test_whole_paragraphs(spark):
    """No length of a paragraph or a wording hides a notice, and a version tells notices apart."""
    t, filler = licenses.TEMPLATES, " ".join(f"word{i}" for i in range(3_000))
    long = " ".join(f"clause{i} of the license" for i in range(700))
    texts = [(1, f"{filler} {t['BSD-disclaimer']} {filler} {t['MIT']} {filler}"), (2, f"{filler}\n{long}\n{filler}"), (3, t["GPL-2.0-header"]), (4, t["AGPL-3.0-header"]),
             (5, "\n".join((t["GPL-2.0-header"], t["GPL-3.0-header"]))), (6, "\n\n".join(t[n] for n in ("MIT-grant", "MIT-condition", "MIT-disclaimer")))]
    got = {r.doc_id: (r.licenses, r.n_blocks) for r in licenses.licenses(spark.createDataFrame(texts, "doc_id long, text string"), {**t, "long": long}).collect()}
    assert got == {1: ("BSD-disclaimer,MIT", 1), 2: ("long", 1), 3: ("GPL-2.0-header", 1), 4: ("AGPL-3.0-header", 1), 5: ("GPL-2.0-header,GPL-3.0-header", 1), 6: ("MIT-condition,MIT-disclaimer,MIT-grant", 3)}


def test_every_template_finds_itself():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert licenses.blocks(text) == [text] and name in [m[0] for m in scanner.scan(text) if m[2] == 0]


def test_licenses_of_odd_rows(spark, docs, rows):
    """Per row, whatever other rows and columns there are; notices are put into the odd texts."""
    from pyspark.sql import functions as F

    notice = f"\n\n{licenses.TEMPLATES['MIT']}\nfoo"
    odd = docs.withColumn("licenses", F.lit(1)).withColumn("matches", F.lit("clash")).withColumn("text", F.when(F.length("text") % 2 == 0, F.concat("text", F.lit(notice))).otherwise(F.col("text")))
    got = [(r.doc_id, r.n_blocks, r.n_licensed, r.licenses, len(r.matches)) for r in licenses.licenses(odd).collect()]
    want = [(d, 1, 1, "MIT", 1) if t is not None and len(t) % 2 == 0 else (d, 0, 0, "", 0) for d, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def quality_of(rows, min_docs, max_share):
    """Brute force: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed words, removed lines) of rows (doc_id, text, host)."""
    import re

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda line: " ".join(re.sub("[1-9]", "0", line.lower()).split())
    lines = [[x for x in (t or "").split("\n")] for _, t, _ in rows]
    size, held, out = {}, {}, []
    for (_, _, host), own in zip(rows, lines, strict=True):
        size[host] = size.get(host, 0) + 1
        for x in {norm(x) for x in own if words(x)}:
            held[host, x] = held.get((host, x), 0) + 1
    for (doc, text, host), own in zip(rows, lines, strict=True):
        w = words(text or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)} if len(w) < 1_000 or len(set(windows)) < len(windows) else set()
        real = [x for x in own if words(x)]
        gone = [i for i, x in enumerate(own) if words(x) and held[host, norm(x)] > max(min_docs, max_share * size[host])]
        removed = sum(len(words(own[i])) for i in gone)
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(real) - len(set(real)), len(repeated), failed, not failed and len(w) - removed >= 0.3 * len(w), removed, gone))
    return out


def test_quality_by_brute_force(docs, rows):
    got = [tuple(r) for r in quality.quality(docs, min_docs=2, max_share=0.01).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "removed_lines").collect()]
    want = quality_of([(d, t, s) for d, t, _, s, _ in rows], 2, 0.01)
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(x[-1] for x in want)


def test_wordings():
    """Against all runs of all blocks."""
    rng, found = random.Random(4), 0
    for _ in range(300):
        template = rng.choices("abcdefghijklm", k=rng.randint(1, 24))
        block = template[:] if rng.random() < 0.8 else []
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(block))
            block[at : at + rng.randint(0, 1)] = rng.choices("abcxyz", k=rng.randint(0, 1))
        block = rng.choices("abcdefghijklm", k=rng.randint(0, 9)) + block + rng.choices("abcdefghijklm", k=rng.randint(0, 9))
        least = len(template)
        for lo in range(len(block)):
            row = [0] * (len(template) + 1)
            for hi in range(lo, len(block)):
                new = [0]
                for i, word in enumerate(template):
                    new.append(max(row[i] + (word == block[hi]), row[i + 1], new[i]))
                row = new
                least = min(least, max(len(template), hi + 1 - lo) - row[-1])
        got = licenses.Wordings({"t": " ".join(template)}).find(block)
        assert ("t" in got) == (least <= 0.1 * len(template)) and (not got or got["t"][0] == least)
        found += bool(got)
    assert 50 < found < 300


def test_quality(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "Menu 3 home\n" + (clean.replace("w", f"d{i}x") if i % 2 else "Menu 3 home"), "s") for i in range(60)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame([*rows, (99, None, None)], "doc_id long, text string, source string")).collect()}
    assert got[1].kept and got[1].removed_words == 3 and got[1].n_words == 63 and got[2].n_dup_lines == 1 and got[2].base_failed and not got[2].kept
    assert got[99].n_words == 0 and got[99].base_failed


def test_lines_removed(spark):
    rows = [(i, f"Menu {i} home\n" + " ".join(f"{chr(97 + i % 26)}{'y' * (i // 26)}x{j}" for j in range(60)) + ("\n\n MENU 4  home\nlast" if i % 2 else ""), "s") for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, None, None)], "doc_id long, text string, source string")
    got = quality.quality(docs).join(docs, "doc_id").select("doc_id", "removed_lines", quality.cleaned(docs.text, "removed_lines").alias("text")).collect()
    for r in got:
        lines = rows[r.doc_id][1].split("\n") if r.doc_id < 99 else []
        gone = [i for i, line in enumerate(lines) if "menu" in line.lower()]
        assert r.removed_lines == gone and r.text == ("\n".join(x for i, x in enumerate(lines) if i not in gone) if lines else None)


def test_empty(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    tokenizer = queries.tokenizer_file("word_bpe_49k.json")
    for df in (
        token_output.token_table(empty, queries.tokenizer_file("byte_bpe_50k.json")), jaccard_join.near_duplicates(empty), mixing.mix(empty), suffix_dedup.suffix_dedup(empty), token_counts.token_counts(empty, tokenizer),
        decontaminate.contamination(empty, bench), language_id.languages(empty), licenses.licenses(empty), quality.quality(empty), substring_dedup.substring_dedup(empty),
    ):
        assert df.count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (30, 29), (29, 28), (28, 27), (27, 26), (3, 1)]
    got = {r.id: r.component for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 30: 26, 29: 26, 28: 26, 27: 26, 26: 26}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.save(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.count()
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
rowset = lambda df: sorted(map(repr, map(tuple, df.select(*COLUMNS).collect())))
wanted = lambda rows: sorted(repr(tuple(r)) for r in rows)


def test_stage_language(spark, docs, rows):
    import regex

    got = pipeline.language(spark, docs, SF)
    assert got.columns == COLUMNS and rowset(got) == wanted(r for r in rows if r[1] and regex.search(r"\p{L}", r[1]))


def test_stage_near_duplicates(spark, docs, rows):
    gone = {d for d, _, c in components(rows, 5, 80) if d != c}
    got = pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == COLUMNS and rowset(got) == wanted(r for r in rows if r[0] not in gone or r[0] is None)


def test_stage_decontamination(spark, docs, rows, tmp_path):
    item = " ".join(next(r[1] for r in rows if r[0] == 7).split("\n")[-1].split()[3:18])
    spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    w = decontaminate.words(item)
    windows = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    bad = lambda t: any(tuple(x[i : i + 10]) in windows for x in [decontaminate.words(t)] for i in range(len(x) - 9))
    assert any(bad(r[1]) for r in rows)
    got = pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == COLUMNS and rowset(got) == wanted(r for r in rows if not bad(r[1]))


def mixed(rows):
    """(row, taken) of the weighted fair queue, by brute force."""
    size = lambda r: len((r[1] or "").encode().split())
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    entries = []
    for s in sources:
        queue = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5((str(r[0]) if r[0] is not None else "").encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r)))
        for turn in (0, 1):
            sent = turn * total[s]
            for r in queue:
                sent += size(r)
                if size(r):
                    entries.append((sent / target[s], "n" if s is None else f"s{s}", sent - turn * total[s], turn, id(r), size(r)))
    budget, taken = int(sum(target.values()) + 1e-6), {}
    for *_, name, n in sorted(entries):
        part = max(0, min(n, budget))
        taken[name] = taken.get(name, 0) + part
        budget -= part
    return [(r, size(r), total[r[3]], target[r[3]], taken.get(id(r), 0)) for r in rows]


def test_mixing_by_brute_force(docs, rows):
    rows = [tuple(list(r)) if i else r for i, r in enumerate(map(list, rows))]
    want = mixed(rows)
    got = mixing.mix(docs).collect()
    # rows with one id and size are interchangeable
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == sorted((str(r[0]), n, t, round(g, 6), k) for r, n, t, g, k in want)


def test_stage_mixture(spark, docs, rows):
    want, most = [], {}
    for r, n, _, _, k in mixed([list(r) for r in rows]):
        most[r[0], n] = max(most.get((r[0], n), 0), -(-k // n) if n else 0)
        want.append((r, n))
    got = pipeline.mixture(spark, docs, SF)
    assert got.columns == COLUMNS and rowset(got) == wanted(r for r, n in want for _ in range(most[r[0], n]))


def test_stage_tokens(spark, docs, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    got = pipeline.tokens(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), len(tk.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)


def test_stages_of_nothing(spark, empty):
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
