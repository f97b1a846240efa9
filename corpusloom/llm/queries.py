"""The registered queries: each operator applied to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import frames, language, lexical, mixing, packing, periodic, perplexity, placement, rules, simhash, substrings, warc, winnow
from corpusloom.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The id behind every document that op13 writes.
WORD_END = 2


def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op2_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substrings.repeats(table(spark, d, "documents"))


def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


def op4_kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    return perplexity.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    placed = placement.place(table(spark, d, "documents"), placement.shard_names())
    return placed.select("doc_id", "slot", "shard")


def op6_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, d, "documents"))


def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(table(spark, d, "documents"))


def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.judge(table(spark, d, "documents"))


def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def op10_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), TOKENIZER)


def op11_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.rank(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return periodic.report(periodic.runs(table(spark, d, "documents"), periodic.repeated_tail))


def op13_token_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames.round_trip(table(spark, d, "documents"), WORD_TOKENIZER, WORD_END)


QUERIES = {
    q.__name__: q
    for q in (
        op1_simhash, op2_substring_dedup, op3_warc, op4_kneser_ney, op5_sharding, op6_fingerprints, op7_language_id, op8_quality_rules,
        op9_mixing, op10_packing, op11_lexical_search, op12_periodic_runs, op13_token_frames,
    )
}
ORACLES = {
    "op3_warc": warc.ORACLE,
    "op5_sharding": placement.oracle(placement.shard_names()),
    "op8_quality_rules": rules.oracle(),
    "op9_mixing": mixing.oracle(),
    "op11_lexical_search": lexical.ORACLE,
}
