"""A training corpus in five stages, from documents to packed sequences.

Every stage takes what its predecessor kept and writes it as Parquet in the folder named by
``spark.checkpoint.dir``, so a lost executor repeats tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing, packing, perplexity, simhash, substrings
from corpusloom.llm.common import table
from corpusloom.llm.queries import TOKENIZER
from corpusloom.operators.scratch import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity, by a model of words, lies within the bounds of their language; all others go.

    Null and empty texts go; a null language is one of its own; rows that repeat an id are judged by their own
    text each; without any trusted document all other texts stay.  An empty table stays empty.
    """
    return perplexity.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: that with the smallest doc_id.

    Null and empty texts are near-duplicates of each other; of rows that repeat an id and a text one stays, and
    rows without an id come last.  An empty table stays empty.
    """
    return simhash.distinct_documents(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur earlier; those left without words go.

    A text that had no words stays.  Rows that repeat an id and a text lose the same words each; rows without an id
    come after all others.  An empty table stays empty.
    """
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest sample whose expected shares of sources, languages and topics meet their targets within mixing.TOLERANCE.

    A null source or language is a value of its own.  Null and empty texts go.  Rows that repeat an id are drawn
    alike.  Where no budget meets the targets, the nearest is taken and the gap logged.  An empty table stays empty.
    """
    return mixing.sampled(docs, budget=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence.

    A null text is its end id alone; a null id stays null; repeated rows are packed as often as they are given.
    An empty table gives no sequences.
    """
    return packing.packed(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", passages),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Fingerprints, Kneser-Ney tables and token ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
