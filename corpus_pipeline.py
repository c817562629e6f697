"""From raw documents to token files: five stages, each one of the operators of tessera.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
into the shared folder, reads it back as the next stage's docs, and deletes all else that the
stage wrote; only the input of the last stage stays. All stages but the last return the columns
of documents.

Defined results: rows are told apart by a number, so null and repeated ids lose no text;
nulls, ties, empty and very long texts are treated as the operators define; extra columns
are passed on, whatever their names; empty tables give empty tables. The mix repeats and
drops whole documents only, and documents without a word, of which no budget takes a word, go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, near_dedup, toxicity
from tessera.llm.common import Leftovers, free_name, numbered, small_batches, staged, table, unstage
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.queries import BPE_TOKENIZER


def _chosen(keyed: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The rows of keyed whose number is the row_key of a row of `rows`, without the number."""
    return keyed.join(rows.select(F.col("row_key").alias(row)), row, "left_semi").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, rejects go."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays."""
    keyed, row = numbered(docs)
    return _chosen(keyed, row, exact_duplicates(keyed, row).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    small_batches(spark)
    keyed, row = numbered(docs)
    return _chosen(keyed, row, near_dedup.near_duplicates(keyed, width=5, percent=80, row_column=row).filter("kept_row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget begins a pass over it, always whole."""
    keyed, row = numbered(docs)
    times, turn = free_name(keyed, "times"), free_name(keyed, "turn")
    taken = mixing.mix(keyed, row).filter("taken > 0").select(F.col("row_key").alias(row), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times))
    return keyed.join(taken, row).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(row, times, turn)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the text decoded from them."""
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path(BPE_TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the trained classifier nor the tokenizer's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Leftovers(spark) as made:
            before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        made.drop(but=docs)
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
