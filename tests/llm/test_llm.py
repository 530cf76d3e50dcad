"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import exact_dedup, jaccard_join, language, licenses, lm_scoring, media, mixing, packing, private_data, token_files, webp
from factloom.llm.queries import word_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, component string"
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = sentence(rng, 300).split()
    out = [(0, None, "en", None), (1, "", "en", "a"), (2, " \t\n", None, "a"), (3, "!!! 123", "en", "b"), (4, "one two", "en", "b"), (5, "one  two ", "en", "b"), (6, "one two", "en", "a")]
    for i in range(7, 60):
        words = list(base)
        for j in rng.integers(0, 300, int(rng.integers(1, 25))):
            words[j] = f"x{j}{i}"
        out.append((i, " ".join(words), "en", "abc"[i % 3]))
    out += [(i, sentence(rng, int(rng.integers(1, 60))) + (" die und der" * (i % 2)), "de" if i % 2 else "en", "abc"[i % 3]) for i in range(60, 120)]
    out.append((120, sentence(rng, 9000), "en", "c"))
    out.append((121, out[7][1], "en", "c"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty):
    path = word_vocabulary()
    for df in (
        mixing.mix(empty), exact_dedup.exact_groups(empty), jaccard_join.join(empty), licenses.scan(empty), language.identify(empty), media.as_media(empty),
        private_data.find(empty), lm_scoring.score(empty), packing.pack(empty, path), token_files.read_tokens(*token_files.write_tokens(empty, path, 2)),
    ):
        assert df.count() == 0


def test_mixing(docs, rows):
    out = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert {k: r["taken"] for k, r in out.items()} == again and len(out) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    total, targets = Counter(), {}
    for i, _, _, s in rows:
        assert out[i]["size"] == size[i] and 0 <= out[i]["taken"] <= 2 * size[i]
        total[s] += size[i]
    weights = dict(zip([*sorted(s for s in total if s is not None), None], (5, 2, 1) * 9))
    open_, left = set(total), 1.5 * sum(total.values())
    while True:  # plain water filling
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * total[s]}
        if not over:
            break
        left -= sum(2 * total[s] for s in over)
        targets |= {s: 2 * total[s] for s in over}
        open_ -= over
    targets |= {s: weights[s] * level for s in open_}
    for s in total:
        mine = [out[i] for i, _, _, x in rows if x == s]
        assert mine[0]["target"] == pytest.approx(targets[s])
        # one document may be left to round: where a single one is most of its source, that is by half of it
        assert abs(sum(r["taken"] for r in mine) - targets[s]) <= max(60, 0.02 * targets[s], max(r["size"] for r in mine) / 2)


def test_mixing_of_repeated_ids(spark):
    """Each doc_id four times, also with other sizes: targets are met, and rows are taken as planned."""
    rows = [(i // 4, " ".join(["w"] * (50 + (i % 4 if i % 3 else 0))), "abc"[i // 4 % 3], f"t{i}") for i in range(2400)] + [(None, "x y z", "a", "n")] * 8 + [(None, None, None, "n")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mix(table).collect()
    again = mixing.mix(table.repartition(5)).collect()
    count = lambda rs: Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in rs)
    assert count(out) == count(again) and len(out) == len(rows)
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 60 for s in target)
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixing.mixed(table).collect())
    want = Counter()
    for r in out:
        want[r["doc_id"], r["size"]] += r["copies"] if r["size"] else 1
    assert got == +want


def test_exact_groups(docs, rows):
    key = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, *_ in rows}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[key[i]].append((-len(t or ""), i))
    for r in exact_dedup.exact_groups(docs).collect():
        g = sorted(groups[key[r["doc_id"]]])
        assert (r["keep_id"], r["group_size"], r["kept"]) == (g[0][1], len(g), g[0][1] == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(key[r["doc_id"]].encode()).hexdigest()


def test_exact_dedup_of_repeated_rows(spark):
    twice = spark.createDataFrame([(1, "a b"), (1, "ab"), (2, "ab"), (None, None), (None, "")], "doc_id long, text string")
    out = exact_dedup.exact_groups(twice).collect()
    assert len(out) == 5 and {r["group_size"] for r in out} == {3, 2}
    assert Counter((r["doc_id"], r["kept"]) for r in out) == {(1, True): 1, (1, False): 1, (2, False): 1, (None, True): 1, (None, False): 1}
    left = [(r["doc_id"], r["text"]) for r in exact_dedup.deduplicated(twice).collect()]
    assert sorted(left, key=str)[0] == (1, "a b") and len(left) == 2 and {i for i, _ in left} == {1, None}
    some = [(1, "x"), (1, "ab"), (2, "a b"), (3, "same"), (3, "same"), (None, "same")]
    left = Counter((r["doc_id"], r["text"]) for r in exact_dedup.deduplicated(spark.createDataFrame(some, "doc_id long, text string")).collect())
    assert left == {(1, "x"): 1, (2, "a b"): 1, (3, "same"): 1}


def test_index_probe_and_levels(spark):
    index = exact_dedup.LogStructuredIndex(spark, fan_in=2, memtables=4)
    for k in range(3):
        index.add(spark.createDataFrame([(bytearray([1]), k, -k), (bytearray([2 + k]), k, 0)], "digest binary, doc_id long, neg_points int"))
    (r,) = index.probe([b"\x01"]).collect()
    assert (r["doc_id"], r["neg_points"], r["n_rows"]) == (2, -2, 3)
    last = index.compact_all()
    assert last == 4 and {x["run"] for x in index.runs(last).select("run").distinct().collect()} == {0}  # 12 runs, 6, 3, 2, 1
    got = {bytes(x["digest"]): (x["doc_id"], x["n_rows"]) for x in index.runs(last).collect()}
    assert got == {b"\x01": (2, 3), b"\x02": (0, 1), b"\x03": (1, 1), b"\x04": (2, 1)}


def test_exact_dedup_comes_from_the_index(spark, docs, monkeypatch):
    """A filter that is full, or an empty one, and a compaction that loses entries all show."""
    want = {tuple(r) for r in exact_dedup.exact_groups(docs).collect()}
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 64)  # nearly every row may be a hit
    assert {tuple(r) for r in exact_dedup.exact_groups(docs).collect()} == want
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "maybe_hit", lambda words, digest, bits: exact_dedup.F.lit(False))
        assert {tuple(r) for r in exact_dedup.exact_groups(docs).collect()} != want
    with monkeypatch.context() as m:
        m.setattr(exact_dedup.LogStructuredIndex, "merged", staticmethod(lambda runs, *by: runs.select(*by, "digest", "doc_id", "neg_points", "row", "n_rows")))
        assert {tuple(r) for r in exact_dedup.exact_groups(docs).collect()} != want


def test_exact_dedup_of_a_hot_text_and_of_clashing_digests(spark, monkeypatch):
    rows = [(i, "hot  text" if i % 3 else f"text {i}") for i in range(1500)] + [(2000, " hot   text ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(i, 2000 if "hot" in t else i, 1001 if "hot" in t else 1, i == 2000 or "hot" not in t) for i, t in rows}
    assert {tuple(r)[:4] for r in exact_dedup.exact_groups(table).collect()} == want
    # all digests alike: byte verification finds it out
    monkeypatch.setattr(exact_dedup, "digest_of", lambda text: exact_dedup.F.unhex(exact_dedup.F.sha2(exact_dedup.F.lit(""), 256)))
    assert {tuple(r)[:4] for r in exact_dedup.exact_groups(table).collect()} == want


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join(docs, rows):
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_prefixes_lose_no_link():
    rng = np.random.default_rng(5)
    for k in range(600):
        n = int(rng.integers(1, 200 if k % 2 else 20))
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        freq = dict(zip(pool.tolist(), rng.choice([1, 2, 10, 30, 140, 200], 400).tolist()))
        a = np.unique(rng.choice(pool, n, replace=False))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.75, 1)))], rng.choice(pool, int(rng.integers(0, 10)))]))
        if not jaccard_join.similar(a, b) or len(a) == len(b) == jaccard_join.similar(a, b):
            continue
        common = set(a.tolist()) & set(b.tolist())
        classes = lambda s: np.array([max(freq[int(t)], 2 if int(t) in common else 1) for t in s], np.uint8)  # noqa: B023, E731
        x, y = jaccard_join.prefix_keys(a, classes(a)), jaccard_join.prefix_keys(b, classes(b))
        assert x is not None and y is not None and np.intersect1d(x, y).size


def test_tokens_and_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_vocabulary())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, *_ in rows}
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    at = 0
    got = {r["doc_id"]: r for r in token_files.read_tokens(*token_files.write_tokens(docs, word_vocabulary(), 2, shard_bytes=5000)).collect()}
    for i in sorted(ids):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids[i]) + 1, crc(ids[i] + [2]))
        at += len(ids[i]) + 1
    pieces = packing.pack(docs, word_vocabulary(), 1, 512).collect()
    spans = defaultdict(list)
    for p in pieces:
        part = (ids[p["doc_id"]] + [1])[p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == crc(part) and p["start"] == 512 * p["piece"]
        spans[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == at
    for s in spans.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 512
    least = max(math.ceil(at / 512), sum(p["length"] > 256 for p in pieces))  # no two of over a half meet
    assert len(spans) <= least * 1.05 + 1


def test_columns_are_generated_until_none_prices_in(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = sorted(set(rng.integers(1300, 4000, 32).tolist()), reverse=True)
    demand = rng.integers(50, 5000, len(sizes)).tolist()
    seen, real = [], packing._best_pattern
    monkeypatch.setattr(packing, "_best_pattern", lambda *a: seen.append(real(*a)) or seen[-1])
    used = packing.configurations(sizes, demand, 4096)
    assert seen[-1][0] <= 1 + 1e-7  # the price of the best column, so the sum is the programme's least
    for i, d in enumerate(demand):
        assert sum(p[i] * x for p, x in used) == pytest.approx(d)


def test_repeated_and_missing_ids_in_files_and_packing(spark):
    texts = [(3, "one two"), (3, "three"), (3, "three"), (None, "four five"), (None, None), (1, "")]
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, length int, ids string")
    out = token_files.read_tokens(*token_files.write_tokens(table, word_vocabulary(), 2)).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, None, 1, 3, 3, 3]
    assert [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out])[:-1].tolist()
    pieces = packing.pack(table, word_vocabulary(), 1, 4).collect()
    assert Counter(p["doc_id"] for p in pieces) == Counter(i for i, _ in texts) and all(p["start"] == 0 for p in pieces)
    spans = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    assert all(o == 0 or (s, o) in {(a, b + n) for a, b, n in spans} for s, o, _ in spans)


def test_repeated_rows_of_media_private_data_and_scores(spark):
    rows = [(1, "mail a@b.cd"), (1, "mail a@b.cd"), (1, "other"), (None, "mail a@b.cd"), (None, None), (2, "x " * 400_000)]
    table = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, feature string, score double")
    for f, columns in ((media.as_media, ["media_sha256", "feature", "n_bytes"]), (private_data.find, ["n_email", "spans"]), (lm_scoring.score, ["n_tokens", "base_score"])):
        out = f(table).collect()
        assert Counter(r["doc_id"] for r in out) == {1: 3, None: 2, 2: 1}, f
        same = [tuple(r[c] for c in columns) for r in out if (r["doc_id"], r[columns[-1]]) in {(x["doc_id"], x[columns[-1]]) for x in out if x["doc_id"] == 1}]
        assert len(set(same)) == 2, f


def test_other_vocabularies_go_to_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from factloom.llm.wordpieces import WordEncoder

    other = Tokenizer(models.WordLevel({"Two": 0, "words": 1, "[UNK]": 2}, "[UNK]"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    encoder = WordEncoder(str(tmp_path / "other.json"))
    assert not encoder.known and [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(["Two words", None, "two"])] == [[0, 1], [], [2]]
    assert WordEncoder(word_vocabulary()).known


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    sizes = Counter((rng.lognormal(5.5, 1, 20_000).astype(int) % 4096 + 1).tolist())
    classes = packing.plan(sizes, 4096)
    used = Counter()
    for pieces, n in classes:
        assert sum(k * c for k, c in pieces.items()) <= 4096 and n > 0
        for k, c in pieces.items():
            used[k] += c * n
    assert used == sizes
    assert sum(n for _, n in classes) <= math.ceil(sum(k * c for k, c in sizes.items()) / 4096) * 1.01 + 1


def test_licenses(spark):
    texts = ["CC BY cc-by", None, "x All rights   RESERVED; all rights reserved", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (out[0]["n_words"], out[0]["n_base"], out[0]["first_word"], out[0]["last_word"]) == (4, 2, 0, 2)
    assert (out[1]["n_words"], out[1]["n_base"], out[1]["first_word"], out[1]["labels"]) == (0, 0, None, "")
    assert (out[2]["n_base"], out[2]["first_word"], out[2]["last_word"], out[2]["base_labels"]) == (2, 1, 4, "reserved")
    assert out[3]["labels"] == "apache-2.0" and out[4]["labels"] == "mit" and out[5]["labels"] == "" and out[5]["score"] == 0


def brute_licenses(text, least=0.6, gap=3):
    """Words, base places and labels, and the best coverage of a template, by plain loops."""
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found, best = {label for _, label in places}, 0.0
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            t = re.findall(r"[a-z0-9]+", t.lower())
            n = len(t) - 3
            at = defaultdict(set)
            for i in range(len(words) - 3):
                for j in range(n):
                    if words[i : i + 4] == t[j : j + 4]:
                        at[i - j].add(j)
            spans, last = [], None
            for d in sorted(at):
                if last is None or d - last > gap:
                    spans.append(set())
                spans[-1] |= at[d]
                last = d
            for span in spans:
                best = max(best, len(span) / n)
                found |= {label} if len(span) / n >= least else set()
    base = sorted({label for _, label in places})
    ends = (min(i for i, _ in places), max(i for i, _ in places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(base), ",".join(sorted(found)), 1.0 if places else best


def test_licenses_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 7)  # so that spans go over pieces
    rng = np.random.default_rng(9)
    parts = [t for texts in licenses.TEMPLATES.values() for t in texts] + ["CC BY", "General Public License", "all rights reserved", "cc", "by", "Kelvin \u212a É½", "nothing of the kind here at all"]
    texts = [None, "", " .,", "a b c"]
    for _ in range(120):
        words = " ".join(rng.choice(parts, int(rng.integers(1, 5)))).split()
        for _ in range(int(rng.integers(0, 6))):
            i = int(rng.integers(0, len(words)))
            words[i : i + int(rng.integers(0, 3))] = ["odd"] * int(rng.integers(0, 3))
            words = words or ["x"]
        texts.append(" ".join(words[int(rng.integers(0, len(words))) :] if rng.random() < 0.3 else words))
    rows = list(enumerate(texts)) + [(7, texts[20]), (7, texts[20]), (None, texts[21]), (None, texts[22])]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], *tuple(r)[1:7], round(r["score"], 9)) for r in out)
    assert got == Counter((i, *brute_licenses(t)[:6], round(brute_licenses(t)[6], 9)) for i, t in rows)


def test_licenses_keep_rows_apart(spark):
    """Rows of one doc_id vote for themselves; a match of hashes, or of the outer words alone, is none."""
    half = "Redistribution and use in source and binary forms, with or without modification"
    rows = [(1, half), (1, half), (1, "nothing of the kind here at all")]
    out = [(r["labels"], round(r["score"], 3)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out) == [("", 0), ("", round(brute_licenses(half)[6], 3)), ("", round(brute_licenses(half)[6], 3))]
    same_ends = licenses.template_grams(spark).withColumn("t_gram", licenses.F.lit(1).cast("long"))
    assert same_ends.count() > 50


def test_language(docs):
    out = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (0, 1, 2, 3))
    long = [i for i in range(60, 120)]
    assert sum(out[i]["lang_pred"] == ("de" if i % 2 else "en") for i in long) >= 45


def test_language_of_numbers_and_strange_scripts(spark):
    assert language.words_of("½ ² Ⅷ 12 _ a½b x2") == Counter(["a", "b", "x"])
    rows = [(i, f"the house {i} is red and old", "en") for i in range(40)] + [(i, "das haus ist rot und alt", "de") for i in range(40, 80)]
    rows += [(100, "½ ² Ⅷ", "en"), (101, "слово", "en"), (102, "слово haus", None), (None, "the old house", None), (103, "das rot", "de"), (103, "das rot", "de")]
    table = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    held = [r["doc_id"] for r in language.identify(table).filter("held_out").collect()]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held) and held
    out = {r["doc_id"]: r for r in language.predict(table, language.train(table.filter("doc_id < 100"))).collect()}
    assert (out[100]["lang_pred"], out[100]["score"]) == ("und", 0) and out[102]["lang_pred"] == out[103]["lang_pred"] == "de" and out[None]["lang_pred"] == "en"
    assert out[101]["lang_pred"] == "de" and out[101]["known"] == 0  # no word or letter of it is known: the first language
    left = {r["doc_id"] for r in language.identified(table.withColumn("lang", licenses.F.when(table.doc_id < 100, table.lang))).collect()}
    assert 100 not in left and 101 not in left and {102, 103, None} <= left


def test_language_backs_off_to_ngrams():
    """Words that were never seen are told by their letters alone, longest known n-grams first."""
    counts = {"en": Counter({"nothing": 9, "something": 8, "though": 9, "washing": 4}), "de": Counter({"schreiben": 9, "bleiben": 8, "zwischen": 9, "treiben": 4})}
    model = language.Model(counts, 4)
    for w, said in (("bathing", "en"), ("reiben", "de"), ("thought", "en"), ("schein", "de")):
        assert w not in model.words.at and model.judge(w)[0] == said
    by = {w: model.grams[len(w) - 1].logs[model.grams[len(w) - 1].at[w]] for w in ("ing$", "hing")}
    score, known = model.backoff("xhing")
    assert known and np.allclose(score, (model.grams[3].logs[model.grams[3].at["hing"]]))  # no x, no ^ before it, and no $ alone
    assert by and not model.backoff("ж")[1]


def test_media_round_trip(docs, rows):
    for r in media.as_media(docs).collect():
        raw = (rows[r["doc_id"]][1] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    big = bytes(range(256)) * 9 * 4096
    assert webp.read_payload(webp.store_payload(big))[0] == big


def _plain(w, values):
    """Prefix codes of one symbol each for red, blue, alpha and distance; green of 256 symbols."""
    w.put(0, 1)
    used = webp.LENGTH_ORDER.index(8) + 1
    w.put(used - 4, 4)
    w.put(1 << 3 * (used - 1), 3 * used)
    w.put(1, 1)
    w.put(3, 3)
    w.put(254, 8)
    for s in (0, 0, 255, 0):
        w.single(s)
    for v in values:
        w.put(int(webp.REVERSED[v]) >> 7, 8)


def _start(width, height):
    w = webp.Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    return w


def _file(w):
    return webp.riff(w.value.to_bytes((w.n + 7) // 8, "little"))


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    rng = np.random.default_rng(mode)
    want = rng.integers(0, 256, (9, 7))
    full = np.stack([np.zeros_like(want), want, np.zeros_like(want), np.full_like(want, 255)], -1)
    residual = np.zeros((9, 7), int)
    for y in range(9):
        for x in range(7):
            if not x and not y:
                guess = np.array([0, 0, 0, 255])
            elif not y:
                guess = full[0, x - 1]
            elif not x:
                guess = full[y - 1, 0]
            else:
                guess = webp.predicted(mode, *webp._neighbours(full, x, y, 7))
            residual[y, x] = (full[y, x, 1] - guess[1]) % 256
    w = _start(7, 9)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(2, 3)  # tiles of 16
    w.put(0, 1)
    _plain(w, [mode])
    w.put(0, 1)
    w.put(0, 2)  # no cache, one group
    # alpha residual: 255 where the prediction has none, so the first pixel's is 0 throughout
    start = w.n
    _plain(w, residual.ravel().tolist())
    got = webp.decode(_file(w))
    assert start and ((got >> 8) & 255).tolist() == want.tolist()


def test_palette_and_subtract_green():
    w = _start(5, 2)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(1, 8)  # two colours: eight pixels to a byte
    w.put(0, 1)
    _plain(w, [10, 30])  # gaps: 10, then 40
    w.put(0, 1)
    w.put(0, 2)
    _plain(w, [0b01101, 0b10010])
    got = (webp.decode(_file(w)) >> 8) & 255
    assert got.tolist() == [[40, 10, 40, 40, 10], [10, 40, 10, 10, 40]]
    w = _start(2, 1)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(0, 1)
    w.put(0, 2)
    _plain(w, [7, 9])
    assert webp.decode(_file(w)).tolist() == [[0xFF070707, 0xFF090909]]


def test_back_references_and_cache():
    w = _start(6, 1)
    w.put(0, 1)  # no transform
    w.put(1, 1)
    w.put(1, 4)  # a cache of two colours
    w.put(0, 1)
    # green: two symbols of 8 bits would not do, so four symbols of two bits: 1, 2, length 3 (258), cache entry
    size = 256 + 24 + 2
    pixel = lambda g: 0xFF000000 | g << 8
    slot = lambda g: (webp.CACHE_FACTOR * pixel(g) & 0xFFFFFFFF) >> 31
    symbols = sorted([1, 2, 258, 280 + slot(1)])
    lengths = [2 if s in symbols else 0 for s in range(size)]
    w.put(0, 1)
    w.put(webp.LENGTH_ORDER.index(2) + 1 - 4, 4)
    for k in webp.LENGTH_ORDER[: webp.LENGTH_ORDER.index(2) + 1]:
        w.put(1 if k in (0, 2) else 0, 3)
    w.put(0, 1)
    for n in lengths:
        w.put(1 if n else 0, 1)
    w.single(0)
    w.single(0)
    w.single(255)
    w.single(1)  # distance symbol 1: code 2, one pixel back
    put = lambda s: w.put(int(f"{symbols.index(s):02b}"[::-1], 2), 2)
    put(1)
    put(258)  # three more of it
    put(2)
    if slot(1) != slot(2):
        put(280 + slot(1))
        last = 1
    else:
        put(1)
        last = 1
    got = (webp.decode(_file(w)) >> 8) & 255
    assert got.tolist() == [[1, 1, 1, 1, 2, last]]


def test_cross_colour():
    p = np.array([[0xFF20C010, 0xFF014080]], np.uint32)
    tiles = np.array([[0xFF000000 | 0x15 << 16 | 0xF0 << 8 | 0x07]], np.uint32)
    green_to_red, green_to_blue, red_to_blue = 7, -16, 21
    want = []
    for v in p[0].tolist():
        r, g, b = v >> 16 & 255, v >> 8 & 255, v & 255
        sg = g - 256 * (g > 127)
        r = (r + (green_to_red * sg >> 5)) & 255
        b = (b + (green_to_blue * sg >> 5) + (red_to_blue * (r - 256 * (r > 127)) >> 5)) & 255
        want.append(0xFF000000 | r << 16 | g << 8 | b)
    assert webp._undo_cross_colour(p, tiles, 2).tolist() == [want]


PII = [
    "mail a.b@c.org, x@y @z.de p@q.r.s-t", "ip 1.2.3.4 and 256.1.1.1 then 10.20.30.40.50", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (555) 123-4567 or +12", "none", "", "9" * 4000, "+1 " * 50,
    "0" * 5000 + ".1.2.3 and 1.2.3." + "0" * 4400 + "9, 0255.000.0.1 and 0256.1.1.1 and 1" + "0" * 4400 + ".1.1.1",
]


@pytest.mark.parametrize("text", PII)
def test_base_spans(text):
    assert private_data.base_spans(text) == brute_spans(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(10)
    for letters in ("ab@.-+%_", "0123456789.. ", "0123456789- ", "+0123456789 ().-", "+a1@. -()", "12.@+ é\n"):
        for _ in range(400):
            text = "".join(rng.choice(list(letters), int(rng.integers(1, 60))))
            assert private_data.base_spans(text) == brute_spans(text), text


def brute_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    want = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x[-400:]) <= 255 and not x[:-400].strip("0") for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and private_data.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            want += [(kind, *m.span())] * ok
    return want


def brute_transduced(text):
    """Look-alikes, bracketed signs and spoken ones undone, with the source of each character, by one plain scan."""
    out = []
    i = 0
    while i < len(text):
        for pattern, to in ((r"[ ]?[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]?", "@"), (r"[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?", ".")):
            if m := re.compile(pattern, re.I).match(text, i):
                out.append((to, i, m.end()))
                i = m.end()
                break
        else:
            out.append((private_data._TWINS.get(text[i], text[i]), i, i + 1))
            i += 1
    return out


def test_added_spans_against_a_plain_scan():
    """Brackets and look-alikes in every mixture: added spans are what the base patterns find once these are undone."""
    rng = np.random.default_rng(11)
    parts = ["jane", "mail", "org", "[at]", " (at) ", "{dot}", " [dot] ", "<.>", "(@)", "а", "е", "１", "２", ".", "@", " ", "10", "+49", "1515", "-", "4111", "1111"]
    n = 0
    for _ in range(1500):
        text = "".join(rng.choice(parts, int(rng.integers(3, 14))))
        base, every = private_data.all_spans(text)
        plain = brute_transduced(text)
        want = list(base)
        for kind, a, b in brute_spans("".join(c for c, _, _ in plain)):
            a, b = plain[a][1], plain[b - 1][2]
            while b > a and text[b - 1] == " ":
                b -= 1
            if not any(k == kind and a < y and x < b for k, x, y in base):
                want.append((kind, a, b))
                n += 1
        assert every == sorted(want, key=lambda s: (private_data.KINDS.index(s[0]), s[1])), text
    assert n > 100


def test_disguises_map_back():
    text = "write to jane [at] mail [dot] org or call +four nine one five one two three four five six"
    base, every = private_data.all_spans(text)
    found = {k: text[a:b] for k, a, b in every}
    assert base == [] and found["email"] == "jane [at] mail [dot] org"
    text = "аnna@mail.org"  # begins with a Cyrillic letter
    assert private_data.all_spans(text)[1][0][0] == "email"
    assert private_data.all_spans("we met at noon, dot")[1] == []
    assert private_data.masked("a@b.cd!") == "[EMAIL]!"


def test_lm_base_score_and_normalisation(docs, rows):
    train = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for i, t, *_ in rows}
    for i, ts in toks.items():
        if not held[i]:
            train.update(ts)
    n, v = sum(train.values()), len(train)
    for r in lm_scoring.score(docs).collect():
        ts = toks[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ts), sum(train[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts))
        assert r["score"] < 0
    cells = np.zeros(lm_scoring.CELLS, np.int64)
    cells[[1, 66, 4097]] = 50
    table = lm_scoring.train_classes(cells, steps=200)
    assert np.allclose(np.exp(table).sum(-1), 1)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns, name
    left = {r["doc_id"] for r in docs.collect()}
    assert left and not left & {0, 1, 2, 3, 4, 6, 121}  # no letter; shorter or later copies


def test_pipeline_run_against_plain_loops(spark, docs, rows, tmp_path):
    """Each stage's decisions from what the one before it kept, by the plain loops of the operators' tests, to the last token."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {i: (t, s) for i, t, _, s in rows if any(c.isalpha() for c in t or "")}
    groups = defaultdict(list)
    for i, (t, _) in left.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    left = {i: left[i] for g in groups.values() for _, i in [min(g)]}
    of = brute_components([(i, t) for i, (t, _) in left.items()])
    left = {i: x for i, x in left.items() if of[i][1] == i}
    mixed = mixing.mix(spark.createDataFrame([(i, t, s) for i, (t, s) in left.items()], "doc_id long, text string, source string")).collect()
    copies = {r["doc_id"]: r["copies"] for r in mixed}
    size = Counter()
    for i, (t, s) in left.items():
        size[s] += len(t.split())
    assert abs(sum(r["taken"] for r in mixed) - 1.5 * sum(size.values())) <= 0.05 * sum(size.values()) + max(len(t.split()) for t, _ in left.values()) / 2 and len(left) < len(rows)
    t = Tokenizer.from_file(word_vocabulary())
    ids = {i: t.encode(left[i][0], add_special_tokens=False).ids + [1] for i in left}
    want, got, spans = Counter(), Counter(), defaultdict(list)
    for i, n in copies.items():
        for k in range(0, len(ids[i]), 4096):
            want[i, k, zlib.crc32(np.array(ids[i][k : k + 4096], "<u4").tobytes())] += n
    for p in pieces:
        got[p["doc_id"], p["start"], p["ids_crc32"]] += 1
        spans[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == +want
    for s in spans.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(spans) <= math.ceil(sum(p["length"] for p in pieces) / 4096) * 1.05 + 1


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lm_tells_words_of_one_class_apart(spark):
    pairs = ("winning morning", "running evening", "running morning", "winning evening")
    assert len({lm_scoring.class_of(w.encode()) for p in pairs for w in p.split()}) == 1
    learned = [(None, " ".join([pairs[k % 2]] * 20)) for k in range(200)]
    asked = [(i, " ".join([p] * 20)) for i, p in enumerate(pairs)]
    out = {r["doc_id"]: r for r in lm_scoring.score(spark.createDataFrame(learned + asked, "doc_id long, text string")).collect() if r["doc_id"] is not None}
    seen, unseen = (min(out[0]["score"], out[1]["score"]), max(out[2]["score"], out[3]["score"]))
    assert seen > unseen + 1


def test_lm_probabilities_sum_to_one_over_units():
    tokens, types = np.zeros(lm_scoring.CLASSES), np.zeros(lm_scoring.CLASSES)
    tokens[[0, 3, 9]], types[[0, 3, 9]] = (5, 90, 40), (1, 6, 2)
    units = lm_scoring.Units([5, 6, 7], [3, 9, 3], [30, 38, 20], tokens, types)
    cells = np.zeros(lm_scoring.CELLS, np.int64)
    cells[[3, 9, 3 * 64 + 9]] = 40
    net = lm_scoring.Network(units, cells)
    rng = np.random.default_rng(1)
    assert lm_scoring.train(net, units, (tuple(rng.integers(0, units.n, (3, 50))) for _ in range(40)), 256) == 2000
    scorer = lm_scoring.Scorer(units, net, 135, 9)
    every = np.arange(units.n)
    for a, b in ((0, 0), (3, int(units.number[0])), (int(units.number[2]), 9)):
        assert (10 ** scorer.logs(np.full(units.n, a), np.full(units.n, b), every)).sum() == pytest.approx(1, abs=1e-4)


def test_lm_score_against_a_plain_loop():
    """A text's score is the sum over its tokens of the logs of class, unit and, for rare words, token."""
    rng = np.random.default_rng(14)
    words = [b""] + [f"w{i}".encode() for i in range(40)]
    classes = np.array([lm_scoring.class_of(w) for w in words])
    hashes = np.array([lm_scoring.xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    counts = rng.integers(0, 30, 41)
    counts[0] = 25
    tokens, types = np.bincount(classes, counts, lm_scoring.CLASSES), np.bincount(classes[counts > 0], minlength=lm_scoring.CLASSES)
    often = np.flatnonzero(counts >= 15)
    often = often[np.argsort(hashes[often])]
    units = lm_scoring.Units(hashes[often], classes[often], counts[often], tokens, types)
    net = lm_scoring.Network(units, rng.integers(0, 3, lm_scoring.CELLS))
    scorer = lm_scoring.Scorer(units, net, int(counts.sum()), int((counts > 0).sum()))
    texts = [np.append(rng.integers(1, 41, n), 0) for n in (0, 1, 2, 30)]
    unit_of = units.of(hashes, classes)
    known, base, score = scorer.score(np.concatenate(texts), np.array([len(t) for t in texts]), counts, unit_of)
    first, second, target, bias, word, word_bias = (p.astype(float) for p in net.params)
    for k, t in enumerate(texts):
        total, u = 0.0, [unit_of[0], unit_of[0], *unit_of[t]]
        for i, w in enumerate(t.tolist()):
            q = first[u[i]] + second[u[i + 1]]
            c = classes[w]
            p = np.exp(target @ q + bias)
            total += math.log10(p[c] / p.sum())
            mine = [j for j in range(units.n) if units.classes[j] == c]
            p = np.exp(word[mine] @ q + word_bias[mine])
            total += math.log10(p[mine.index(unit_of[w])] / p.sum())
            if w not in often:
                rare = [j for j in range(41) if classes[j] == c and j not in often]
                total += math.log10((counts[w] + 1) / (counts[rare].sum() + (counts[rare] > 0).sum() + 1))
        assert score[k] == pytest.approx(total, rel=1e-4) and known[k] == (counts[t] > 0).sum()
        assert base[k] == pytest.approx(sum(math.log10((counts[w] + 1) / (counts.sum() + (counts > 0).sum() + 1)) for w in t))


def test_media_columns_are_coded_images(docs, rows, monkeypatch):
    monkeypatch.setattr(media, "BATCH_BYTES", 5000)
    for r in media.as_columns(docs).collect():
        payload = media.padded((rows[r["doc_id"]][1] or "").encode())
        assert b"".join(webp.samples(np.frombuffer(bytes(i["argb"]), "<u4")) for i in r["images"]) == payload
        assert all(len(i["argb"]) == 4 * i["width"] * i["height"] for i in r["images"])
        assert len(r["media"]) < len(payload)  # a raw copy is longer


def test_writer_uses_what_the_format_has(monkeypatch):
    seen = set()
    for name in ("_undo_predictor", "_undo_palette", "_add_green", "_read_group", "_from_cache", "_copy"):
        def spy(*a, f=getattr(webp, name), name=name):
            seen.add(name)
            return f(*a)
        monkeypatch.setattr(webp, name, spy)
    rng = np.random.default_rng(4)
    text = sentence(rng, 2000).encode()[:5760]
    passage = (sentence(rng, 40) + " " + "".join(map(chr, rng.integers(33, 126, 90)))) * 30
    walk = rng.integers(0, 2, (240, 24)).cumsum(0).astype(np.uint8).tobytes()  # like the row above
    few = rng.integers(0, 3, 5760).astype(np.uint8)
    few = np.stack([few, few, few], 1).tobytes()
    grey = np.repeat(rng.integers(0, 256, 5760).astype(np.uint8), 3).tobytes()
    noise = rng.integers(0, 256, 576 * 200).astype(np.uint8).tobytes()
    one = b"\xff" * 576
    for payload in (text, passage.encode()[:5760], walk, few, grey, noise, one):
        assert webp.read_payload(webp.store_payload(payload))[0] == payload
    assert seen == {"_undo_predictor", "_undo_palette", "_add_green", "_read_group", "_from_cache", "_copy"}
    assert len(webp.store_payload(text)) < len(text) // 2 and len(webp.back_references(np.arange(40) % 9))
    skewed = [2**k for k in range(30)]
    assert max(webp.code_lengths(skewed)) <= 15 and sum(2.0 ** -int(n) for n in webp.code_lengths(skewed)) == 1


def test_round_trips_of_odd_payloads(monkeypatch):
    """Long runs, copies that overlap, images cut into steps, cache entries beside copies."""
    rng = np.random.default_rng(6)
    for k in range(60):
        n = 576 * int(rng.integers(1, 12))
        unit = rng.integers(0, int(rng.choice([2, 20, 256])), int(rng.integers(1, 400))).astype(np.uint8).tobytes()
        payload = (unit * (n // len(unit) + 1))[:n]
        if k % 3 == 0:
            payload = rng.integers(97, 123, n).astype(np.uint8).tobytes()
        assert webp.read_payload(webp.store_payload(payload))[0] == payload
    monkeypatch.setattr(webp._read_group, "__defaults__", (64,))
    for payload in (b"".join(rng.choice([b"abc", b"xyz", b"the"], 1920).tolist()), (sentence(rng, 60) * 40).encode()[:5760], rng.integers(0, 99, 5760).astype(np.uint8).tobytes()):
        assert webp.read_payload(webp.store_payload(payload))[0] == payload


#: Worked by hand from left (10, 20, 30), top (50, 40, 200), top right (7, 250, 90) and top left (40, 25, 100).
PREDICTED = [
    (0, 0, 0), (10, 20, 30), (50, 40, 200), (7, 250, 90), (40, 25, 100), (29, 87, 130), (25, 22, 65), (30, 30, 115), (45, 32, 150), (28, 145, 145), (26, 83, 105), (50, 40, 200), (20, 35, 130), (25, 32, 122),
]


@pytest.mark.parametrize("mode", range(14))
def test_predictions_by_hand(mode):
    near = [np.array([*v, 255]) for v in ((10, 20, 30), (50, 40, 200), (7, 250, 90), (40, 25, 100))]
    assert webp.predicted(mode, *near).tolist() == [*PREDICTED[mode], 255]


@pytest.mark.parametrize("number, after", [("+four nine five one five one two three four five six", x) for x in (", Ohio", ". Ones", " sixteen", ", 7th", "")])
def test_spelled_number_before_a_word_that_begins_like_one(number, after):
    text = "call " + number + after
    (kind, a, b), = private_data.all_spans(text)[1]
    assert (kind, text[a:b]) == ("phone", number)


def test_spoken_dots_and_at():
    cases = {"host 10 dot 0 dot 0 dot 1 is up": ("ip", "10 dot 0 dot 0 dot 1"), "ask jane at mail.org today": ("email", "jane at mail.org"), "ask jane at mail.co.uk.": ("email", "jane at mail.co.uk"), "ask jane at mail.co dot uk.": ("email", "jane at mail.co dot uk")}
    for text, want in cases.items():
        base, every = private_data.all_spans(text)
        assert base == [] and [(k, text[a:b]) for k, a, b in every] == [want]
    assert private_data.all_spans("we met at noon. Then 3 dot 5 left")[1] == []


def test_jaccard_join_of_shared_and_missing_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c, d, e = (" ".join(f"{k}{w}" for w in rng.integers(0, 10**6, 120)) for k in "abcde")
    near = lambda t: t + " and more"
    rows = [(5, a), (5, b), (5, None), (6, near(a)), (7, near(b)), (2, c), (9, c), (9, d), (4, near(d)), (None, e), (None, near(c)), (8, "alone in this table with words"), (10, "")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # 2 and 9 have c, 9 brings d, and with it 4; a row without doc_id is near c, another one has e alone; 5 has a and b
    assert got == {(5, 5), (6, 5), (7, 5), (2, 2), (9, 2), (4, 2), (None, 2), (None, None), (8, 8), (10, 10)}
    some = [(1, a), (1, b), (2, near(a)), (3, near(b)), (-1, c), (None, d), (None, near(d)), (None, "x"), (None, None)]
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(some, "doc_id long, text string")).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (-1, -1): 1, (None, None): 4}


def test_jaccard_join_of_large_groups(spark, monkeypatch):
    """Copies, near copies on both sides of the threshold and shared passages, with every list long enough for combinations."""
    monkeypatch.setattr(jaccard_join, "FREQUENT_CLASS", {2: 3, 3: 6})
    rng = np.random.default_rng(12)
    base = [f"b{w}" for w in rng.integers(0, 10**6, 90)]
    texts = []
    for i in range(150):
        words = list(base)
        for j in rng.integers(0, 90, int(rng.integers(0, 7))):
            words[j] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(words[: int(rng.integers(60, 91))]))
    texts += [" ".join(base[:k]) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) for _ in range(4)]
    texts += [texts[0]] * 40
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
