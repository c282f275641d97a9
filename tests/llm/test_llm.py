"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import itertools
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridbrook.llm import bpe_automaton, decontam, licenses, mtree, near_dup, quality, sharding, shared, token_count, token_store, url_filter
from gridbrook.llm.pretokens import public_path

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, size string"
ODD = [
    (1, "a b c d e f", "en", "s", 11, None, "x"), (2, "a b c d e f", None, None, None, 1, None), (3, None, "en", "s", 0, None, None), (4, "", "en", "s", 0, None, None), (5, "  \n ", "en", "s", 4, None, None),
    (6, "one", "en", "s", 3, None, None), (7, "ONE", "en", "s", 3, None, None), (8, "long words " * 30000, "en", "s", 330000, None, None), (9, "<|endoftext|> İ é́ 日本 '’s", "fr", "t", 9, None, None),
    (1, "a b c d e f", "en", "s", 11, None, "x"), (None, "a b c d e f", "en", "s", 11, None, "x"), (10, "A  b c D e f", "en", "s", 12, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def brute_components(rows, size, percent=80):
    sets = {i: near_dup.shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near(df, size):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, size).collect()}


@pytest.mark.parametrize("crowd", [32, 0])  # 0: every pair of the last step is held against its rarest shingles
def test_near_duplicates(spark, docs, crowd, monkeypatch):
    monkeypatch.setattr("gridbrook.llm.near_dup.CROWD", crowd)
    monkeypatch.setattr("gridbrook.llm.near_dup.ROUNDS", 2 if crowd else 0)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    for k in range(40):  # a group of near copies around the threshold
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df, 2) == brute_components(rows, 2)


def test_near_duplicates_odd_rows(spark, odd):
    got = near_dup.near_duplicates(odd, 2)
    assert got.count() == len(ODD)
    want = brute_components([(r[0], r[1]) for r in ODD if r[0] is not None], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.where("doc_id is not null").collect()} == want
    kept = near_dup.keep_one(odd, 2)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9]
    assert near_dup.near_duplicates(odd.limit(0), 2).count() == 0


def test_near_duplicates_of_shared_ids(spark):
    """Rows that share an id are judged by their own texts; no text is lost and no copy stays."""
    texts = ["a b c d e f g h i j k l", "x y z u v w", "a b c d e f g h i j k m", "q r s t", "", None, "x y z u v w"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[3]), (3, texts[4]), (3, texts[5]), (4, texts[6]), (4, texts[6]), (2, texts[3])]
    df = spark.createDataFrame([(*r, k, "c") for k, r in enumerate(rows)], "doc_id long, text string, count long, place string").withColumn("node", F.lit(0)).withColumn("kept_id", F.lit("k"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, 2, 60).collect())
    assert got == sorted([(1, 11, 1, True), (1, 5, 1, True), (2, 11, 1, False), (2, 3, 2, True), (2, 3, 2, True), (3, 0, 3, True), (3, 0, 3, True), (4, 5, 1, False), (4, 5, 1, False)])
    kept = near_dup.keep_one(df, 2, 60)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[3]), (3, ""), (3, "")])
    once = df.where("count in (0, 2, 4, 5) or count = 3").dropDuplicates(["doc_id"])
    assert near_dup.keep_one(once, 2, 60).columns == df.columns


@pytest.mark.parametrize("part, tile", [(2, 3)])
def test_near_duplicates_dealt_out(spark, part, tile, monkeypatch):
    """Leaders' pairs and crowded keys are cut into small parts with equal results."""
    monkeypatch.setattr("gridbrook.llm.near_dup.PART", part)
    monkeypatch.setattr("gridbrook.llm.near_dup.TILE", tile)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(50):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    for rounds in (2, 0):
        monkeypatch.setattr("gridbrook.llm.near_dup.ROUNDS", rounds)
        assert near(spark.createDataFrame(rows, "doc_id long, text string"), 2) == brute_components(rows, 2)


def test_components_agree(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "a long, b long")
    assert sorted(map(tuple, shared.components(edges).collect())) == sorted(map(tuple, shared.components(edges, task_edges=0).collect()))


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_bpe(spark, which, request):
    df = request.getfixturevalue(which)
    tok = library("word_bpe_49k.json")
    rows = texts_of(df)
    want = []
    for (i, _), e in zip(rows, tok.encode_batch([t for _, t in rows], add_special_tokens=False)):
        text = tok.decode(e.ids, skip_special_tokens=False)
        want.append((i, len(e.ids), hashlib.sha256(struct.pack(f"<{len(e.ids)}I", *e.ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe_automaton.encode_decode(df, keep_ids=False).collect()]
    key = lambda r: (r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe_automaton.encode_decode(df.limit(0)).count() == 0


def test_automaton_on_random_words():
    rng, tok = random.Random(3), library("word_bpe_49k.json")
    codec = bpe_automaton.codec(public_path("word_bpe_49k.json"))
    for _ in range(2000):
        w = "".join(rng.choice("aeinrstthhoé1!") for _ in range(rng.randrange(1, 40)))
        assert np.frombuffer(codec.encode(w), "<u4").tolist() == tok.encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_counts(spark, which, request):
    df = request.getfixturevalue(which)
    tok = library("byte_bpe_50k.json")
    rows = texts_of(df)
    want = [(i, len(t.encode()), len(e.ids), len(e.ids) > 1024) for (i, t), e in zip(rows, tok.encode_batch([t for _, t in rows], add_special_tokens=False))]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, token_count.token_counts(df).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_files(spark, which, request):
    df = request.getfixturevalue(which)
    tok = library("byte_bpe_50k.json")
    rows = sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for (i, _), e in zip(rows, tok.encode_batch([t for _, t in rows], add_special_tokens=False)):
        ids = [*e.ids, 0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, token_store.token_files(df).collect()), key=lambda r: r[1]) == want
    assert token_store.token_files(df.limit(0)).count() == 0


def test_segments():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 3000):
        ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32 - 1, n), rng.integers(100, 300, n)).astype(np.uint32)
        s = token_store.Segment(token_store.write_segment([1, None], [n // 2, n - n // 2], ids))
        assert (s.ids() == ids).all() and (s.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all() and s.doc_ids == [1, None]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=8).round(2).tolist() for i in range(700)}
    for i in range(300, 600):
        vectors[i] = vectors[300]  # a third of all rows
    vectors[601], vectors[602], vectors[603], vectors[604] = None, [None] + [0.0] * 7, [float("nan")] + [0.0] * 7, [float("inf")] + [0.0] * 7
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    fine = {i: np.floor(np.array(v, np.float32).astype(float) * 64) for i, v in vectors.items() if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in fine:
        if q % 20 == 0:
            best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = mtree.top_k(df)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert mtree.top_k(df.limit(0)).count() == 0 and mtree.top_k(df.where("vec_id < 5")).count() == 4


def test_urls(spark):
    rows = [
        (1, "http://a.org/x", '<link rel="canonical" href="https://b.example.com/en/1">'), (2, "http://c.org/#f", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'), (3, None, None),
        (4, "http://z.net/de/", "<link href=/es/1 rel=canonical>"), (5, "http://www.example.com/en/", "<link href=http://q.org rel=canonical>"), (6, "http://q.org", '<link rel=canonical href="http://b.example.com/en/7">'),
        (7, "HTTP://NET/es/x?y", ""), (8, "no scheme", "<link rel=canonical href=http://x.net/es/>"), (9, "http://k.com", None), (9, "http://k.com/", None), (10, "http://xcom/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("r", F.lit(1))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df).collect() if r.page_id != 9)
    assert got == [
        (1, "a.org", "/x", None, "block"), (2, "c.org", "/", None, "block"), (3, "", "", None, "allow"), (4, "z.net", "/de/", None, "block"), (5, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (6, "q.org", "", None, "allow"), (7, "net", "/es/x", "net/es/", "block"), (8, "", "", None, "allow"), (10, "xcom", "/", None, "allow"),
    ]
    assert {r.rule for r in url_filter.url_verdicts(df).where("page_id = 9").collect()} == {None, "com/"}
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def test_urls_resolved(spark):
    """Against the standard library's resolution."""
    import html
    from urllib.parse import urldefrag, urljoin

    bases = ["http://a.org", "http://a.org/", "http://a.org/b/c/d;p?q", "https://x.y/z", "http://a.org/b/?k=/u/v"]
    refs = ["g", "./g", "g/", "/g", "//h/i", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "http://o.net/p", "/login?next=http://c.net/es/", "a&amp;b=1", "&lt;x&gt;"]
    rows = [(k, b, r) for k, (b, r) in enumerate(itertools.product(bases, refs))]
    got = {r.k: r.u for r in spark.createDataFrame(rows, "k int, b string, r string").select("k", url_filter.resolved(F.col("b"), url_filter.decoded(F.col("r"))).alias("u")).collect()}
    for k, b, r in rows:
        want = urldefrag(urljoin(b, html.unescape(r)))[0]
        assert got[k] == want or got[k].replace("a.org/", "a.org") == want.replace("a.org/", "a.org"), (b, r, got[k], want)


def test_url_components(spark):
    """Pages linked at random, by relative, absolute, canonical and refresh targets, against a union-find."""
    rng = random.Random(7)
    hosts = ["a.org", "b.net", "c.example.com", "www.example.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'x'])}/{k}.html" for k in range(80)]
    rows, links = [], []
    for k, u in enumerate(urls):
        body = ""
        if rng.random() < 0.5:
            to = rng.choice(urls)
            same = to.split("/")[:4] == u.split("/")[:4]
            told = to.split("/")[-1] if same else to
            body = f'<link rel="alternate canonical" href="{told}">' if rng.random() < 0.5 else f"<META HTTP-EQUIV=Refresh content='0;URL={told}'>"
            links.append((u, to))
        rows.append((k, u, body))
    rows += [(900, None, "<link rel=canonical href=http://b.net/es/1>"), (901, None, None), (902, "", "")] + [(k, None, "") for k in range(1000, 1050)]
    root = {u: u for u in urls}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)

    def rule(u):
        host, path = u.split("/", 3)[2], "/" + u.split("/", 3)[3]
        fit = [(len(h + p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1] if fit else None

    own = {u: rule(u) for u in urls}
    spread = {}
    for u in urls:
        spread.setdefault(find(u), set()).add(own[u])
    want = {k: own[u] or ("allow" if "allow" in spread[find(u)] else "block" if "block" in spread[find(u)] else "allow") for k, u in enumerate(urls)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(df).collect()}
    assert {k: got[k] for k in want} == want and len(got) == len(rows) and got[900] == "allow"
    many = [("allow", f"h{k}.test", "/") for k in range(1200)] + url_filter.RULES
    assert {r.page_id: r.verdict for r in url_filter.url_verdicts(df, many).collect()} == got  # joined instead of put into the plan


def test_licenses(spark, odd):
    rows = [(1, "Released under the MIT License.", "a/LICENSE"), (2, "plain text", "a/b/x"), (3, "code\nLicensed under the Apache License, Version 2.0.\nmore words that are no licence at all and so on", "a/b/y"), (4, "text", "c/z"), (5, None, "a/q"), (6, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p string")
    got = {r.doc_id: (r.licence, r.found_in) for r in licenses.scan(df, F.col("p")).collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "directory"), 3: ("Apache-2.0", "header"), 4: (None, None), 5: ("MIT", "directory"), 6: (None, None)}
    assert licenses.scan(odd, F.col("source")).count() == len(ODD) and licenses.scan(odd.limit(0), F.col("source")).count() == 0


def test_licence_texts(spark):
    texts = {t: k for k, t in licenses.TEMPLATES}
    gpl, mit = (licenses.Path(licenses.__file__).parent / "licence_texts/GPL-3.0.txt").read_text(), f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{licenses._GRANT}\n\n{licenses._NOTICE}\n\n{licenses._AS_IS}\n"
    code = "".join(f"\n\ndef some_code_{k}(x):\n    return x{k} + y{k} * z{k}\n" for k in range(60))
    comment = lambda t: "".join(f"# {' '.join(t.split()[k : k + 9])}\n" for k in range(0, len(t.split()), 9))
    gnu = next(t for t, k in texts.items() if k == "GPL-2.0" and t.startswith("This program is free") and "WARRANTY" in t)
    cases = [
        ("SPDX-License-Identifier: MIT", "p/1", "MIT", "header"), ("// SPDX-License-Identifier: GPL-2.0-only OR MIT\n" + code, "p/2", "GPL-2.0 OR MIT", "header"),
        ("MIT License", "p/3", "MIT", "file"), ("Licensed under the MIT License.\n" + code, "p/4", "MIT", "header"), (comment(gnu) + code, "p/5", "GPL-2.0", "header"),
        ("Creative Commons Attribution 4.0 International\n" + code, "p/6", "CC-BY-4.0", "header"), (gpl, "q/COPYING", "GPL-3.0", "file"), (mit, "r/text", "MIT", "file"),
        (comment(licenses._GRANT) + code, "s/1", "MIT", "header"), (comment(f"{licenses._BSD} {licenses._THIRD} {licenses._BSD_AS_IS}") + code, "s/2", "BSD-3-Clause", "header"),
        ("Project X\n\nReleased under the ISC License.\n" + code, "t/LICENSE.md", "ISC", "file"), (code, "q/a/b", "GPL-3.0", "directory"), (code, "r/b", "MIT", "directory"), (code, "s/3", None, None), (code, "t/u", "ISC", "directory"),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _, _) in enumerate(cases)] + [(99 + i, f"plain prose number {i} with the words of a text that is free to use", f"z/{i}") for i in range(60)], "doc_id long, text string, p string")
    got = {r.doc_id: (r.licence, r.found_in) for r in licenses.scan(df, F.col("p")).where("doc_id < 99").collect()}
    assert got == {i: (k, f) for i, (_, _, k, f) in enumerate(cases)}


def test_licences_equal_brute_force(spark):
    """Scores of single statements against a plain computation over the same documents."""
    from collections import Counter

    templates = [("A", "use it freely under licence alpha"), ("B", "all rights reserved by beta and gamma"), ("B", "beta gamma rights")]
    rng = random.Random(11)
    words = sorted({w for _, t in templates for w in t.split()} | {"code", "plain", "text"})
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(120)] + [t for _, t in templates] + ["", None]
    rows = [(k, t, f"d{k % 7}/f{k}") for k, t in enumerate(texts)]
    rows += rows[:3] + [(None, "use it freely under licence alpha", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p string").withColumn("licence", F.lit("x")).withColumn("b", F.lit(1)).withColumn("dir", F.lit("y"))
    got = licenses.scan(df, F.col("p"), templates).collect()
    assert len(got) == len(rows)
    every = [t for _, t, _ in rows]
    vocab = {w for _, t in templates for w in t.split()}
    df_ = {w: sum(w in (t or "").split() for t in every) for w in vocab}
    n = len(every)
    idf = lambda w: math.log((1 + n) / (1 + df_[w])) + 1 if w in vocab else math.log(1 + n) + 1

    def cosine(a, b):
        x, y = ({w: (1 + math.log(f)) * idf(w) for w, f in Counter(t.split()).items()} for t in (a, b))
        return sum(x[w] * y.get(w, 0) for w in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    best = {}
    for k, t, _ in rows:
        if t:
            scored = [(-round(cosine(t, s), 6), name) for name, s in templates]
            fit = [x for x in scored if -x[0] >= 0.8]
            best[k] = min(fit) if fit else None
    files_of = {}
    for k, t, p in rows:
        if p and best.get(k):
            files_of.setdefault(p.split("/")[0], []).append(best[k])
    seen = 0
    for r in got:
        want = best.get(r.doc_id)
        if want:
            assert (r.licence, r.score) == (want[1], pytest.approx(-want[0], abs=2e-6)) and r.found_in == "file"
            seen += 1
        else:
            above = min(files_of.get((r.path or "").split("/")[0], []), default=None)
            assert (r.licence, r.found_in) == ((above[1], "directory") if above else (None, None))
    assert seen > 3


def test_quality(spark, docs, odd):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.quality_scores(big, train).join(held, "doc_id").toPandas()
    assert ((got.keep) == (got.quality == 1)).mean() > 0.95
    assert quality.keep_good(big, train).columns == big.columns
    assert quality.quality_scores(odd, labels.limit(0)).where("keep").count() == len(ODD)
    assert quality.quality_scores(odd, train).count() == len(ODD) and quality.keep_good(odd.limit(0), train).count() == 0
    clash = big.withColumn("t", F.lit(1)).withColumn("m", F.lit("x")).withColumn("deal", F.lit(2)).withColumn("y", F.lit(0))
    both = quality.keep_good(clash.union(clash), train)
    assert both.columns == clash.columns and both.count() == 2 * quality.keep_good(big, train).count()


def test_quality_equals_brute_force(spark):
    """The co-trained model against the same steps over plain arrays in one process."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, rows = quality.fit(big, labels)
    data = rows.toPandas()
    bins = [np.array(data[c].tolist()) for c in ("t", "m")]
    y = data.y.fillna(-1).astype(int).to_numpy()
    import pyarrow as pa

    fold = quality._fold(pa.array(data.doc_id, pa.int64()))
    groups, sizes = (quality.SHAPES, len(quality.META)), (quality.SHAPES * quality.BINS, sum(quality.META))

    def counts(v, mask, weight=1.0):
        out = np.zeros((sizes[v], 2))
        for k in np.flatnonzero(mask):
            out[bins[v][k], y[k]] += weight
        return out

    lent = [np.zeros((s, 2)) for s in sizes]
    for r in range(quality.ROUNDS + 1):
        views = [quality.View(counts(v, y >= 0) + lent[v], groups[v]) for v in (0, 1)]
        apart = [[quality.View(counts(v, (y >= 0) & (fold != f)) + lent[v], groups[v]) for v in (0, 1)] for f in range(quality.FOLDS)]
        hist = [np.zeros((len(quality.GRID) - 1, 2)) for _ in sizes]
        for v in (0, 1):
            for k in np.flatnonzero(y >= 0):
                hist[v][quality._cell(apart[fold[k]][v].score(bins[v][k : k + 1]))[0], y[k]] += 1
        if r < quality.ROUNDS:
            new = []
            for v in (0, 1):
                sure = [quality._sure(hist[1 - v], up) for up in (False, True)]
                add = np.zeros((sizes[v], 2))
                for k in np.flatnonzero(y < 0):
                    cell = quality._cell(views[1 - v].score(bins[1 - v][k : k + 1]))[0]
                    for c in (0, 1):
                        add[bins[v][k], c] += sure[c][cell]
                new.append(quality.PSEUDO_WEIGHT * add)
            lent = new
    for v in (0, 1):
        assert np.allclose(model.views[v].table, views[v].table) and np.allclose(model.lines[v], quality._calibrated(hist[v]))


@pytest.mark.parametrize("words", [200_000, 0])  # 0: joined instead of broadcast
def test_decontamination(spark, docs, odd, words, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
    monkeypatch.setattr(decontam, "BITS", 20)
    bench = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(30))), (2, "x y z"), (3, None), (4, "p1 p2 p3 p4 p5 p6"), (4, "p1 p2 p3 p4 p5 p6")], "item_id long, text string")
    noise = [f"n{k}" for k in range(50)]
    item = [f"b{k}" for k in range(30)]
    sub = list(item)
    sub[3] = sub[15] = sub[21] = "zz"
    rows = [(1, noise + item + noise), (2, noise + sub), (3, noise + item[:8]), (4, noise + "x y z".split()), (5, "Q P1 p2 p3 p4 p5 p6".split()), (6, item[5:25]), (7, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect())
    assert got == [(1, 1), (2, 1), (5, 4), (6, 1)]
    assert sorted(r.doc_id for r in decontam.decontaminate(df, bench).collect()) == [3, 4, 7]
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    flat = lambda t: " " + " ".join((t or "").lower().split()) + " "
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items if len(b.text.split()) >= 5 and flat(b.text) in flat(d.text)}
    assert want <= {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}


@pytest.mark.parametrize("words", [200_000, 0])
def test_decontamination_odd_rows(spark, odd, words, monkeypatch):
    """Repeated rows give repeated results, rows without an id none, clashing columns stay, and texts of one word over and over are whole."""
    monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
    monkeypatch.setattr(decontam, "BITS", 20)
    bench = spark.createDataFrame([(1, "again " * 20), (2, "one two three four five six"), (None, "one two three four five six"), (3, "")], "item_id long, text string")
    long = "again " * 20000
    df = spark.createDataFrame([(1, long, "a"), (2, "x " * 500 + "one two three four five SIX", "b"), (2, "x " * 500 + "one two three four five SIX", "b"), (None, long, "c"), (4, None, "d"), (5, "one two", "e")], "doc_id long, text string, item_id string")
    got = sorted((r.doc_id, r.item_id, r.matched, r.aligned, r.doc_start) for r in decontam.contaminated(df, bench).collect())
    assert got == [(1, 1, 20, 20, 0), (2, 2, 6, 6, 500), (2, 2, 6, 6, 500)]
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.item_id for r in kept.collect()) == ["d", "e"]
    assert decontam.decontaminate(odd, bench).count() == len(ODD)


@pytest.mark.parametrize("n", range(5, 14))
def test_decontamination_masks(n):
    blocks, changes = decontam.blocks_of(n), n - -(-80 * n // 100)
    kept = [{p for k in mask for p in blocks[k]} for mask in decontam.masks_of(n)]
    assert all(any(not mask & set(out) for mask in kept) for out in itertools.combinations(range(n), changes))
    item = [f"w{k}" for k in range(n)]
    texts = [" ".join(["a", "b"] + [f"z{p}" if p in out else w for p, w in enumerate(item)] + ["c"]) for c in range(changes + 2) for out in itertools.combinations(range(n), c)]
    near = sum(math.comb(n, c) for c in range(changes + 1))
    found = decontam.Index([(1, " ".join(item))]).find([decontam._hashes(t, near_dup._Hashes()) for t in texts])
    assert all(x and x[0][2:] == (n, 2) for x in found[:near]) and not any(found[near:])


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [(i, [f"v{w}" for w in rng.integers(0, 40, n)]) for i, n in enumerate([5, 6, 9, 10, 11, 12, 13, 20, 40, 60] * 3)]
    texts = [[f"v{w}" for w in rng.integers(0, 40, n)] for n in rng.integers(0, 90, 150)]
    for t in texts[::2]:
        for _, item in (items[k] for k in rng.integers(0, len(items), 2)):
            t[len(t) // 2 : len(t) // 2] = [w if rng.random() > 0.2 else "x" for w in item]
    texts.append(["x" if p % 5 == 0 else w for p, w in enumerate(items[9][1])])

    def brute(t):
        best = {}
        for i, item in items:
            need = min(13, len(item))
            for d in range(need - len(item), len(t) - need + 1):
                a, b = max(0, -d), min(len(item), len(t) - d)
                same = [item[p] == t[p + d] for p in range(a, b)]
                if any(100 * sum(same[p : p + need]) >= 80 * need for p in range(b - a - need + 1)):
                    one = (sum(same), b - a, -(a + d))
                    best[i] = max(one, best.get(i, one))
        return [(i, m, n, -s) for i, (m, n, s) in sorted(best.items())]

    want = [brute(t) for t in texts]
    monkeypatch.setattr(decontam, "AT_ONCE", 200)
    index = decontam.Index([(i, " ".join(w)) for i, w in items])
    assert index.find([decontam._hashes(" ".join(t), near_dup._Hashes()) for t in texts]) == want
    assert want[-1] and sum(map(len, want)) > 50
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 0)
    monkeypatch.setattr(decontam, "BITS", 16)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    joined = decontam.contaminated(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert sorted(map(tuple, joined.collect())) == sorted((k, *x) for k, xs in enumerate(want) for x in xs)


def test_shards(spark, docs, odd):
    out, folder = sharding.shard_documents(docs)
    stored = sharding.read_map(spark, folder)
    rows = out.toPandas()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(s == len(texts[i]) + 1 and c == zlib.crc32(texts[i]) for i, s, c in zip(rows.doc_id, rows["size"], rows.text_crc32))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    total = rows.groupby("shard")["size"].sum()
    assert len(total) == 16 and total.max() - total.min() <= rows["size"].max()
    old = {r.virtual_slot: r.shard for r in stored.collect()}
    # the stored map is read, edited for one more shard and written as the next version, which places the rows
    after = sharding.reshard_documents(docs, folder, 17).toPandas()
    new = {r.virtual_slot: r.shard for r in sharding.read_map(spark, folder).collect()}
    assert sharding.read_map(spark, folder).first().version == 2 and {r.virtual_slot: r.shard for r in sharding.read_map(spark, folder, 1).collect()} == old
    assert all(new[s] == old[s] or new[s] == 16 for s in old) and 16 in new.values() and set(after.version) == {2}
    assert all(new[s] == k for s, k in zip(after.virtual_slot, after["shard"])) and all(sorted(g.slot) == list(range(len(g))) for _, g in after.groupby("shard"))
    fewer = sharding.reshard_documents(docs, folder, 12).toPandas()
    assert set(fewer["shard"]) <= set(range(12)) and set(fewer.version) == {3} and all(sorted(g.slot) == list(range(len(g))) for _, g in fewer.groupby("shard"))
    clash = odd.withColumn("shard", F.lit(1)).withColumn("slot", F.lit("x")).withColumn("virtual_slot", F.lit(2))
    got, where = sharding.shard_documents(clash)
    assert sorted((r.doc_id or 0, r["size"]) for r in got.collect()) == sorted((r[0] or 0, len((r[1] or "").encode()) + 1) for r in ODD)
    grown = sharding.reshard_documents(docs.select("doc_id", "text").union(odd.select("doc_id", "text")), where, 16)  # slots that the old map lacks
    assert grown.count() == docs.count() + len(ODD)
    assert sharding.shard_documents(odd.limit(0))[0].count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Stages against brute force on a small input with odd rows, repeated ids and clashing columns; an empty input gives no rows."""
    import corpus_pipeline

    noise = lambda k, n: " ".join(f"t{k}x{i}" for i in range(n))
    item = " ".join(f"bench{i}" for i in range(30))
    rows = [(1, noise(1, 40)), (2, noise(1, 40)), (3, noise(3, 40) + " " + item), (4, None), (5, ""), (None, noise(6, 20)), (7, noise(7, 3)), (7, noise(8, 3)), (9, noise(9, 30000))]
    docs = spark.createDataFrame([(i, t, None, None, None, 5, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, count long, group string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = library("word_bpe_49k.json")
    left = [(i, t) for i, t in rows if i not in (2, 3)]  # no labels of both classes: quality keeps all
    want = sorted((i or 0, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in left)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == want
    empty = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        after = shared.save(after, name)
        assert 0 < after.count() <= docs.count()
        docs = after
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in range(1, 11) if sum(k.startswith(f"op{n}_") for k in names) == 1] == list(range(1, 11)) and "pipeline" in names
    assert os.path.exists(public_path("word_bpe_49k.json"))
