"""One registered query per training-data operator, over the whole given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import byte_pairs, decontaminate, imatch, lexical_search, line_dedup, mixing, quality, secrets_scan, simhash, token_shards, url_filter, vector_codes, warc
from citeloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"), per_edit=line_dedup.PER_EDIT)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.sequences(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), decontaminate.split_items(table(spark, sf_dir, "benchmark")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.secrets(table(spark, sf_dir, "documents")))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited(table(spark, sf_dir, "documents"))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.listed(warc.resolve(warc.captures(table(spark, sf_dir, "pages"))))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_line_dedup, op3_token_shards, op4_decontaminate, op5_url_filter, op6_quality, op7_secrets, op8_imatch, op9_revisits, op10_mixing,
        op11_lexical_search, op12_byte_pairs, op13_vector_codes,
    )
}
ORACLES = {"op7_secrets": secrets_scan.ORACLE, "op9_revisits": warc.ORACLE, "op10_mixing": mixing.ORACLE, "op11_lexical_search": lexical_search.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
