"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loanloom.llm import (
    byte_bpe, conversations, importance, minhash, mixing, pieces, pii, quality_classifier, quality_rules, secrets, sharding,
    spotsigs, token_counts,
)
from loanloom.llm.common import documents


def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(documents(spark, sf_dir).select("doc_id", "text"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return minhash.near_duplicates(docs, width=2, numerator=80, denominator=100)


def piece_model() -> bytes:
    return pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_report(documents(spark, sf_dir).select("doc_id", "text"), piece_model())


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir).select("doc_id", "text"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir).select("doc_id", "text"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir).select("doc_id", "text", "source"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text"), piece_model())


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir).select("doc_id", "text", "source"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance.resample(documents(spark, sf_dir).select("doc_id", "text"), target)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = pieces.read_model(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_report(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversations.repaired(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_spot_signatures,
        op2_minhash_dedup,
        op3_sentencepiece,
        op4_bootstrapped_pii,
        op5_feistel_shards,
        op6_secret_ownership,
        op7_token_counts,
        op8_pivotal_mix,
        op9_quality_classifier,
        op10_quality_rules,
        op11_importance_resampling,
        op12_byte_bpe,
        op13_conversation_repair,
    )
}

ORACLE = {
    "op2_minhash_dedup": r"""
        with recursive words as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
            from documents
        ),
        sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
                else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
            from words
        ),
        shingles as (select doc_id, unnest(s) as g from sets),
        shared as (
            select a.doc_id as u, b.doc_id as v, count(*) as common from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id
            group by all
        ),
        links as (
            select u, v from shared join sets a on a.doc_id = u join sets b on b.doc_id = v
            where 100 * common >= 80 * (len(a.s) + len(b.s) - common)
        ),
        ways as (select u, v from links union select v, u from links),
        reach as (
            select doc_id, doc_id as other from sets
            union
            select reach.doc_id, ways.v from reach join ways on ways.u = reach.other
        ),
        least as (select doc_id, min(other) as component_id from reach group by doc_id)
        select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join least using (doc_id)
    """,
    # checksums of distinct words by a table of 256 remainders, byte by byte
    "op11_importance_resampling": r"""
        with recursive remainder as (
            select range::bigint as byte, range::bigint as value, 0 as bit from range(256)
            union all
            select byte, case when value & 1 = 1 then xor(value >> 1, 3988292384) else value >> 1 end, bit + 1 from remainder where bit < 8
        ),
        steps as (select list(value order by byte) as step from remainder where bit = 8),
        texts as (
            select doc_id as id, coalesce(text, '') as text, true as document from documents
            union all select item_id, coalesce(text, ''), false from benchmark
        ),
        words as (
            select id, document, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
            from texts
        ),
        counted as (select id, document, word, count(*) as n from words group by all),
        spelled as (select word, hex(encode(word)) as code from (select distinct word from counted)),
        hashed as (
            select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(code) // 2),
                lambda i: ('0x' || code[2 * i + 1 : 2 * i + 2])::bigint)),
                lambda crc, byte: xor(crc >> 8, step[(xor(crc, byte) & 255) + 1])), 4294967295) % 10000 as bucket
            from spelled, steps
        ),
        features as (select id, document, bucket, n from counted join hashed using (word)),
        buckets as (
            select bucket, coalesce(sum(n) filter (document), 0)::double as s, coalesce(sum(n) filter (not document), 0)::double as t
            from features group by bucket
        ),
        gains as (
            select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + 10000)) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain
            from buckets
        ),
        weighed as (
            select d.doc_id, coalesce(sum(n), 0)::bigint as n_features, coalesce(sum(n * gain), 0)::bigint as weight
            from documents d left join (select * from features join gains using (bucket) where document) f on f.id = d.doc_id group by d.doc_id
        ),
        scored as (
            select *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
            from weighed
        ),
        placed as (
            select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
                count(*) over (partition by n_features >= 20) as able
            from scored
        )
        select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * able // 100 then place end as rank from placed
    """,
}
