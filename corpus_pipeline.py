"""Corpus pipeline: documents to tokens in five stages, each a Spark job over all rows of its predecessor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.llm import bpe, mixing, repeats, rules, simhash
from quarterlight.llm.common import documents, materialize
from quarterlight.llm.registry import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_first(docs)


#: Bytes of the strings that the repeated-strings stage cuts: passages of some fifty short words have as many.
PASSAGE = 240


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that occur elsewhere are cut out of the texts; all documents stay."""
    cut = repeats.without_repeats(docs, PASSAGE)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text decoded from them."""
    return bpe.tokenize_documents(docs, bpe.read_vocabulary(spark, tokenizer_file()))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("source mix", source_mix),
    ("tokens", tokens),
]

#: SimHash components and byte-level repeats are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each stage's result written before the next reads it.

    Null and empty texts fail the rules and go. Equal rows are one near-duplicate group, of which one stays; null ids are
    ordinary rows that come last in a group. Ties stand by id and a digest of the row. An empty table gives no rows.
    Columns of any other names travel along until the tokens.
    """
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
