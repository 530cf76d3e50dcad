"""Clustering, BPE by tree concatenation and fill-in-middle against plain forms, with odd rows."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe, fill_middle, jaccard_join, language, lm_scoring, queries, sort_means
from factloom.llm.queries import word_vocabulary

DATA = "/root/testdata/sf0.001"
hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()


# -- centroids

VECTORS = "vec_id long, embedding array<float>, cluster string, distance string, parts string"


def odd_vectors():
    rng = np.random.default_rng(5)
    good = [(i, (rng.normal(size=64) / 8).astype(np.float32).tolist()) for i in range(300)]
    good += [(7, good[7][1])] * 3 + [(8, good[20][1]), (None, good[1][1]), (None, good[1][1])] + [(1000 + i, [0.25] * 64) for i in range(150)]
    bad = [(2000, None), (2001, []), (2002, [0.1] * 63), (2003, [0.1] * 65), (2004, [0.1] * 63 + [None]), (2005, [0.1] * 63 + [float("nan")]), (2006, [float("-inf")] + [0.1] * 63)]
    return good, bad


def plain_clusters(good, k, rounds):
    ints = [tuple(int(np.floor(np.float64(x) * 64)) for x in v) for _, v in good]
    order = sorted(range(len(good)), key=lambda n: (hexed(f"1:{'' if good[n][0] is None else good[n][0]}"), ints[n]))
    centroids = [ints[n] for n in order[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        at = [min(range(len(centroids)), key=lambda c: (d(v, centroids[c]), c)) for v in ints]
        if r < rounds:
            for c in range(len(centroids)):
                mine = [v for v, a in zip(ints, at) if a == c]
                if mine:
                    centroids[c] = tuple(sum(x) // len(mine) for x in zip(*mine))
    return Counter((i, a, d(v, centroids[a]), hexed(",".join(map(str, centroids[a])))) for (i, _), v, a in zip(good, ints, at))


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 0), (1000, 1)])
def test_clusters_against_plain_loop(spark, k, rounds):
    good, bad = odd_vectors()
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in good + bad], VECTORS).repartition(5)
    out = sort_means.with_inertia(*sort_means.cluster(table, k=k, rounds=rounds)).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in out) == plain_clusters(good, k, rounds)
    each = Counter()
    for r in out:
        each[r["cluster"]] += r["distance"]
    assert all(r["cluster_inertia"] == each[r["cluster"]] and r["inertia"] == sum(each.values()) for r in out)


def test_no_vectors(spark):
    table = spark.createDataFrame([(1, None, "", "", "")], VECTORS)
    for some in (table, table.limit(0)):
        assert sort_means.with_inertia(*sort_means.cluster(some)).count() == 0


def test_too_wide_a_component_is_named(spark):
    table = spark.createDataFrame([(1, [1e30] * 64, "", "", "")], VECTORS)
    with pytest.raises(Exception, match="a component beyond"):
        sort_means.cluster(table)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 9), st.integers(1, 4))
def test_scan_from_any_previous_centroid(seed, k, d):
    rng = np.random.default_rng(seed)
    vectors, centroids = rng.integers(-4, 5, (40, d)), rng.integers(-4, 5, (k, d))  # many ties
    best, least = sort_means.nearest(vectors, rng.integers(0, k, 40), centroids)
    all_ = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == all_.argmin(axis=1)).all() and (least == all_.min(axis=1)).all()


def test_scan_stops_early():
    centroids = np.array([[0, 0], [100, 0], [300, 0], [500, 0]])
    seen = []
    real = sort_means.squared
    try:
        sort_means.squared = lambda a, b: seen.append(np.asarray(b)) or real(a, b)
        sort_means.nearest(np.array([[1, 0], [2, 0]]), np.zeros(2, int), centroids)
    finally:
        sort_means.squared = real
    assert [b.tolist() for b in seen[1:]] == [[0, 0]]  # after the distances between centroids, only the previous one was looked at


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_clusters_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    mine, other = queries.op11_clustering(spark, DATA).toPandas(), con.sql(queries.ORACLE["op11_clustering"]).df()
    by = ["vec_id"]
    assert mine.sort_values(by, ignore_index=True).equals(other[mine.columns].astype(dict(mine.dtypes)).sort_values(by, ignore_index=True))


# -- BPE

def odd_texts():
    rng = np.random.default_rng(9)
    letters = list("etaoinshrdlu")
    run = lambda n: "".join(rng.choice(letters, n))
    out = [None, "", " \t\n", "a", "Hello wörld's <|endoftext|> x", "<|startoftext|>" * 3, run(17), run(40) + " and " + run(3000), run(9001), "ab" * 700 + "'s " + "é" * 500]
    out += ["日本語の文章" * 300, "a" * 5000, "-" * 2000 + "x" * 2000, "0123456789abcdef" * 200, "H̱" * 400, "x<|endoftext|>" * 200, "İ" * 300 + " " + "ß" * 300, "😀" * 400, "\x00" * 300]
    out += ["word " * 50 + run(1500) + "　" + run(50), "don't" * 300, "A1b2" * 400 + "́" * 50, run(1024), run(1023), "the" * 2000 + "!" * 1500]
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


@pytest.mark.parametrize("spread", [64, 1024])
def test_ids_and_texts_are_the_librarys(spark, library, monkeypatch, spread):
    texts = odd_texts()
    rows = [(n // 2 if n % 5 else None, t, "i", "r") for n, t in enumerate(texts)] + [(3, texts[8], "i", "r")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row string").repartition(3)
    got = bpe.decode(bpe.encode(docs, word_vocabulary(), spread=spread), word_vocabulary()).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "ids", "row", "decoded"}
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False), (r["text"] or "")[:40]
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r[:2] for r in rows)


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, word_vocabulary()), word_vocabulary()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("etaoinshrxyz", min_size=1, max_size=200), st.sampled_from([2, 3, 5, 16]))
def test_tree_concatenation_of_letters(text, leaf):
    """Any halves, however short, join to what one step gives."""
    words = bpe.encoder(word_vocabulary())
    leaves = bpe.halves(text, leaf)
    assert "".join(leaves) == text and all(leaves) and max(map(len, leaves)) <= leaf
    parts = [words.step(x, k + 1 == len(leaves)) for k, x in enumerate(leaves)]
    assert bpe.tree(parts, True, words.names, words.step) == words.step(text, True)
    parts = [words.step(x, False) for x in leaves]
    assert bpe.tree(parts, False, words.names, words.step) == words.step(text, False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("international understand ing the re of compress ation s antidis establish ment arian ism".split()), min_size=2, max_size=30))
def test_tree_concatenation_of_words(words_):
    words, text = bpe.encoder(word_vocabulary()), "".join(words_)
    parts = [words.step(x, k + 1 == len(words_)) for k, x in enumerate(words_)]
    assert bpe.tree(parts, True, words.names, words.step) == words.step(text, True)


def test_long_runs_are_cut_where_pretokens_end(library):
    words = bpe.encoder(word_vocabulary())
    text = ("abc-def'll42é½x" * 40 + "q" * 90) * 3
    want = library.encode(text, add_special_tokens=False).ids
    block, bpe.BLOCK = bpe.BLOCK, 16
    try:
        got = np.frombuffer(words._whole(text), words.dtype).tolist()
    finally:
        bpe.BLOCK = block
    assert got == want


# -- fill-in-middle

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hexed(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark):
    texts = [None, "", " ", "\n\n", "one", " a  b\tc ", "x<P>y", "<S", "> <", "é😀 日本 語\x0b", "no break \x1c sign", "<M", "P> < S>", "word " * 30000, "w" * 50000, "<<P <<S> x"]
    rows = [(i, t, "f", "o") for i in range(60) for t in texts[i % 16 :][:1]] + [(i, texts[i % 16], "f", "o") for i in range(60, 400)] + [(None, "a b c", "f", "o"), (5, "a b c", "f", "o"), (-9, "q r s", "f", "o")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string, output string").repartition(4)
    got = fill_middle.transform(docs, into="made").collect()
    assert Counter((r["doc_id"], r["text"], *r["made"]) for r in got) == Counter((i, t, *plain_fim(i, t)) for i, t, *_ in rows)
    assert {r["made"]["form"] for r in got} == {"plain", "spm", "psm"}
    assert all(fill_middle.restored(r["made"]["output"], r["made"]["form"]) == (r["text"] or "") for r in got)
    assert fill_middle.transform(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("<PSM> a"), st.integers(-5, 500))
def test_restoring_texts_that_look_like_sentinels(text, doc_id):
    import regex

    n, form, _, _, output = fill_middle.transformed(text, doc_id, 42, 100, 50, regex.compile(fill_middle.UNIT))
    assert fill_middle.restored(output, form) == text


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_of_round_three(spark, library):
    docs = {r[0]: r[1] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    coded, made = queries.op12_bpe(spark, DATA).collect(), queries.op13_fill_middle(spark, DATA).collect()
    assert len(coded) == len(made) == len(docs)
    for r in coded:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), hexed(" ".join(map(str, ids))), hexed(library.decode(ids, skip_special_tokens=False)))
    for r in made:
        n, form, p, m, output = plain_fim(r["doc_id"], docs[r["doc_id"]])
        assert tuple(r)[1:] == (n, form, p, m, hexed(output), hexed(docs[r["doc_id"]]))


# -- mended this round

def plain_judgement(model, text):
    """The rule as a loop over words: a known word's log frequency, else the mean over its longest known n-grams from the left."""
    import math

    counts = language.words_of(text or "")
    if not counts:
        return "und", 0.0
    sums = [0.0] * len(model.languages)
    for w, m in counts.items():
        if w in model.words.at:
            logs = [model.words.logs[model.words.at[w]]]
        else:
            logs, rest = [], f"^{w}$"
            while rest:
                n = next((n for n in (4, 3, 2, 1) if rest[:n] in model.grams[n - 1].at and len(rest) >= n), 0)
                if n:
                    logs.append(model.grams[n - 1].logs[model.grams[n - 1].at[rest[:n]]])
                rest = rest[max(n, 1) :]
        for k in range(len(sums)):
            sums[k] += m * (sum(float(x[k]) for x in logs) / len(logs) if logs else 0.0)
    best = max(range(len(sums)), key=lambda k: (sums[k], -k))
    total = sum(counts.values())
    return model.languages[best], 1 / sum(math.exp((s - sums[best]) / math.sqrt(total)) for s in sums)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_language_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.filter(~language.held_out(docs["doc_id"], 3, 1))
    model = language.train(train)
    sample = [(r["text"], r["lang"]) for r in train.filter("lang is not null and text is not null").distinct().collect()]
    by = {}
    for text, lang in {(t, k) for t, k in sample}:
        by.setdefault(lang, Counter())
    assert model.languages == sorted(by)
    for r in language.identify(docs).collect():
        text = next(t for i, t in [(x["doc_id"], x["text"]) for x in docs.filter(docs["doc_id"] == r["doc_id"]).collect()])
        want = plain_judgement(model, text)
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], rel=1e-4), r["doc_id"]
        if r["doc_id"] > 60:
            break


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_language_is_in_the_sample_where_ids_are_missing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang")
    many = docs.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(8)))).drop("n")
    some = language.train(many, rows_per_language=5)
    assert some.languages == sorted(r[0] for r in docs.select("lang").distinct().collect() if r[0])
    one = spark.createDataFrame([(None, "der die das", "de")] * 500 + [(None, f"the {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxy'[i // 100]} and", "en") for i in range(500)], "doc_id long, text string, lang string")
    model = language.train(one, rows_per_language=20)
    assert model.languages == ["de", "en"] and 10 <= len(model.words.at) <= 100  # the repeated row counts once, and is in


def jaccard_brute(rows):
    """component_id by plain pairs; rows: (doc_id, text), ids unlike."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in rows]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_jaccard_of_large_identifiers(spark):
    base = " ".join(f"w{i}" for i in range(60))
    big = 1 << 62
    rows = [(big + 5, base), (big + 9, base + " more"), (3, "alone in the world of texts"), (big + 77, "another one that is by itself here"), (-4, base + " less"), (2**63 - 1, None), (-(2**63), "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(table).collect()} == jaccard_brute(rows)
    one = jaccard_join.join(spark.createDataFrame([(big + 5, "a b c d e f")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == [(big + 5, 2, big + 5)]
    null = jaccard_join.join(spark.createDataFrame([(None, base), (big + 1, base), (big + 2, "q r s t u v")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in null} == {(None, big + 1), (big + 1, big + 1), (big + 2, big + 2)}


@pytest.mark.parametrize("kind", ["own", "shared"])
def test_jaccard_of_families_that_almost_link(spark, monkeypatch, kind):
    """Texts with most words in common, just under the threshold: by tokens of their own, and by tokens that others share too."""
    monkeypatch.setattr(jaccard_join, "SLICE", 16)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(130)]
    rows = []
    for i in range(120):
        tail = [f"t{i}x{k}" for k in range(23)] if kind == "own" else [f"s{int(x)}" for x in rng.integers(0, 40, 23)]
        rows.append((i, " ".join(base + tail)))
    rows += [(200, rows[7][1] + " end"), (201, rows[7][1] + " other end"), (202, " ".join(base))]
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == jaccard_brute(rows)


def test_mean_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FAN_IN", 3)
    rng = np.random.default_rng(1)
    rows = [(k, t, int(rng.integers(1, 9)), rng.normal(size=4).astype(np.float32)) for t in range(25) for k in range(2)]
    run = spark.createDataFrame([(k, t, n, bytearray(d.tobytes())) for k, t, n, d in rows], lm_scoring.FIT_SCHEMA).repartition(4)
    got = {r["part"]: (r["n"], np.frombuffer(r["data"], np.float32)) for r in lm_scoring.mean_of_tasks(run).collect()}
    for k in range(2):
        mine = [(n, d) for p, _, n, d in rows if p == k]
        assert got[k][0] == sum(n for n, _ in mine)
        assert got[k][1] == pytest.approx(sum(n * d for n, d in mine) / got[k][0], rel=1e-5, abs=1e-6)
