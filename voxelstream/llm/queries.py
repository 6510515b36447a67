"""The dealt operators over the driver's tables: one thin query each, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
import xxhash

from . import alignment, bpe, centroids, decontamination, exact_dedup, hidden_markov, quality, secrets, simhash, suffix_dedup, token_counts, token_store, toxicity
from .common import shared_dir, table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache stays with the shared folder and serves later runs over the same tables."""
    cache = f"{shared_dir(spark)}/token-counts-{xxhash.xxh64_hexdigest(sf_dir)}"
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignments(table(spark, sf_dir, "documents"), a, b)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_texts(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.lloyd(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, salt="2:")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_token_store": op8_token_store,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_centroid_clustering": op13_centroid_clustering,
}


def _lloyd_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd's rounds one after the other; ids are taken as unique."""
    parts = [
        f"""kept as materialized (
            select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
            where len(embedding) = {dims} and len([x for x in embedding if isfinite(x)]) = {dims})""",
        f"""centroids0 as materialized (
            select row_number() over (order by digest) - 1 as cluster, v as c
            from (select sha256('2:' || vec_id) as digest, v from kept order by digest limit {k}))""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""near{r} as materialized (
            select vec_id, any_value(v) as v, min(struct_pack(distance := distance, cluster := cluster)) as best
            from (select vec_id, v, cluster, cast(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, c)]) as bigint) as distance
                  from kept, centroids{r})
            group by vec_id)"""
        )
        if r < rounds:
            parts.append(
                f"""centroids{r + 1} as materialized (
            select o.cluster, coalesce(m.c, o.c) as c
            from centroids{r} o left join (
                select cluster, list(mean order by place) as c
                from (select best.cluster as cluster, place, cast(floor(sum(v[place]) / count(*)) as bigint) as mean
                      from near{r}, (select unnest(range(1, {dims + 1})) as place) group by all) group by cluster) m using (cluster))"""
            )
    return f"""with {", ".join(parts)}
        select n.vec_id, cast(best.cluster as integer) as cluster, best.distance as distance,
               cast(sum(best.distance) over (partition by best.cluster) as bigint) as cluster_inertia,
               cast(sum(best.distance) over () as bigint) as inertia, sha256(array_to_string(o.c, ',')) as centroid_sha256
        from near{rounds} n join centroids{rounds} o on o.cluster = n.best.cluster"""


ORACLE_SQL: dict[str, str] = {
    "op13_centroid_clustering": _lloyd_sql(),
    "op7_decontamination": r"""
        with words as (
            select 'd' as kind, doc_id as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word,
                   generate_subscripts(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1) as pos
            from documents
            union all
            select 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')),
                   generate_subscripts(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1)
            from benchmark),
        lengths as (select kind, id, count(*) as n from words group by kind, id),
        starts as (
            select w.kind, w.id, w.pos, l.n,
                   string_agg(w.word, ' ') over (partition by w.kind, w.id order by w.pos rows between current row and 9 following) as gram
            from words w join lengths l using (kind, id)),
        windows as (
            select distinct id as item_id, least(n, 10) as size, gram from starts where kind = 'b' and (pos + 9 <= n or (n < 10 and pos = 1))),
        sizes as (select distinct size from windows),
        places as (
            select s.id as doc_id, s.pos, z.size,
                   array_to_string(list_slice(string_split(s.gram, ' '), 1, z.size), ' ') as gram
            from starts s join sizes z on s.kind = 'd' and s.pos + z.size - 1 <= s.n),
        found as (select p.doc_id, p.pos, p.size, w.item_id from places p join windows w using (size, gram)),
        hit as (select doc_id, count(distinct word_pos) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as word_pos from found) group by doc_id),
        items as (select doc_id, count(distinct item_id) as n_items, string_agg(item, ',' order by item) as joined
                  from (select distinct doc_id, item_id, cast(item_id as varchar) as item from found) group by doc_id)
        select d.doc_id, coalesce(l.n, 0) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
               sha256(coalesce(i.joined, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
        from documents d left join lengths l on l.kind = 'd' and l.id = d.doc_id
        left join hit h on h.doc_id = d.doc_id left join items i on i.doc_id = d.doc_id""",
    "op10_exact_dedup": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) as n_cp,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
            from documents)
        select doc_id,
               first_value(doc_id) over (partition by text_sha256 order by n_cp desc, doc_id) as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               row_number() over (partition by text_sha256 order by n_cp desc, doc_id) = 1 as kept,
               text_sha256
        from d""",
}
