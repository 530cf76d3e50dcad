"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fill_middle, jaccard_join, language, licenses, lm_scoring, media, mixing, packing, private_data, sort_means, token_files
from .scratch import documents


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text"), total_share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return token_files.read_tokens(*token_files.write_tokens(docs, word_vocabulary(), end_id=2))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir, "doc_id", "text"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir, "doc_id", "text"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.as_media(documents(spark, sf_dir, "doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), word_vocabulary(), end_id=1, capacity=4096)


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find(documents(spark, sf_dir, "doc_id", "text"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir, "doc_id", "text"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return sort_means.with_inertia(*sort_means.cluster(vectors, k=16, rounds=3, seed=1, scale=64, dimension=64))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(documents(spark, sf_dir, "doc_id", "text"), word_vocabulary()), word_vocabulary())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(documents(spark, sf_dir, "doc_id", "text"), seed=42, rate=50, spm_rate=80)
    made = made.select("doc_id", "fim.*").withColumn("d", fill_middle.digest_columns(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.*")


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_token_files, op3_licenses, op4_language, op5_exact_dedup, op6_jaccard_join, op7_media, op8_packing, op9_private_data, op10_lm_scoring,
    op11_clustering, op12_bpe, op13_fill_middle,
)}


def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds one after the other; floors by the remainder's sign, since whole-number division truncates."""
    near = lambda n: f"""a{n} as (select v.r, arg_min(c.c, {{'d': list_sum(list_transform(range(1, 65), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i]))), 'c': c.c}}) c,
        cast(min(list_sum(list_transform(range(1, 65), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i])))) as bigint) d from v, c{n} c group by v.r)"""  # noqa: E731
    mean = lambda n: f"""m{n} as (select c, list((s - ((s % n) + n) % n) // n order by i) p from (
        select a.c, i, cast(sum(v.p[i]) as bigint) s, cast(count(*) as bigint) n from a{n} a join v on a.r = v.r, range(1, 65) t(i) group by all) group by c),
      c{n + 1} as (select c{n}.c, coalesce(m{n}.p, c{n}.p) p from c{n} left join m{n} on c{n}.c = m{n}.c)"""  # noqa: E731
    steps = ",\n".join(f"{near(n)}, {mean(n)}" for n in range(rounds))
    return f"""with v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) p from embeddings
        where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
      c0 as (select cast(row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), '')), p) - 1 as int) c, p from v qualify c < {k}),
      {steps}, {near(rounds)}
      select v.vec_id, a.c as "cluster", a.d distance, cast(sum(a.d) over (partition by a.c) as bigint) cluster_inertia, cast(sum(a.d) over () as bigint) inertia,
        sha256(array_to_string(c.p, ',')) centroid_sha256
      from a{rounds} a join v on a.r = v.r join c{rounds} c on a.c = c.c"""


ORACLE = {
    "op11_clustering": _clustering_sql(),
    "op5_exact_dedup": r"""
        with n as (
            select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') k from documents
        )
        select doc_id,
               first_value(doc_id) over w as keep_id,
               count(*) over (partition by k) as group_size,
               row_number() over w = 1 as kept,
               sha256(k) as text_sha256
        from n window w as (partition by k order by length(t) desc, doc_id)
    """,
}
