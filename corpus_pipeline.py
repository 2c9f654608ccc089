"""A training-corpus pipeline over ``documents``: five stages, each one operator.

Every stage is written as Parquet and read again as the next one's input, so a
lost executor costs part of one stage.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logpipe.llm import decontaminate, langid, linededup, pack, simhash
from logpipe.llm.common import table
from logpipe.llm.queries import tokenizer
from logpipe.session import checkpoint_root


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; texts without letters and undecided ones go.

    NULL texts have no letters.  Repeated rows share one fate; without any
    labelled row nothing can be found and all go; an empty table stays empty.
    Columns come back as they were, whatever their names.
    """
    return langid.drop_unidentified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; ``n_chars`` follows a text that changed.

    NULL texts stay NULL.  Of the documents that share a line the one with the
    smallest id keeps it; repeated rows have one id and keep it together.  A
    document may end up with an empty text, none is dropped; an empty table
    stays empty.  Other columns come back as they were, whatever their names.
    """
    return linededup.drop_recurring_lines(docs, length_col="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates (four words, four bits): the smallest id.

    NULL and empty texts are one group (fingerprint zero).  Ids that are NULL
    come after all others; of repeated rows one stays, of equal ids with
    different texts the smaller text hash.  An empty table stays empty;
    columns come back as they were, whatever their names.
    """
    return simhash.keep_one(docs, shingle=4, distance=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    NULL texts have no words and stay; repeated rows share one fate; an empty
    table or an empty benchmark changes nothing.  Columns come back as they
    were, whatever their names.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of 4096 tokens.

    NULL and empty texts are an end token alone; repeated rows and ids are
    packed as they come; an empty table gives no pieces.
    """
    return pack.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", identify_language), ("lines", drop_lines), ("near_copies", drop_near_copies),
          ("benchmark", drop_benchmark), ("packing", pack_sequences)]

#: Language scores, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
