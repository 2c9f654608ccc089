"""The operators applied to the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logpipe.llm import (decontaminate, langid, linededup, mixing, negatives, pack, passages, quality,
                         simhash, spelling, substrings, tokencount, topk)
from logpipe.llm.common import prepare, table
from logpipe.llm.sql import DECONTAMINATION_SQL, HARD_NEGATIVES_SQL, LINE_DEDUP_SQL, SPELLING_SQL, TOP_K_SQL

#: Where the public tokenizer files are; the package that describes them lies there itself.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def tokenizer(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZERS, name)
    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 400-byte repeats cover, as digests and as text.

    A cut may leave part of a character; the text has U+FFFD there, the digest is of the bytes.
    """
    out = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose templates recur."""
    out = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more of all documents that are alike to one elsewhere."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify_with_own_labels(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                        carry=["doc_id"])
    return found.select("doc.doc_id", *(c for c in found.columns if c != "doc"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def words_with_misspellings(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts' runs of letters, one in 199 of them without one letter.

    NULL texts have no words; a NULL id counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all("text", F.lit(r"[A-Za-z\u00C0-\u00FF]{6,}"), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = runs.select("id", F.translate("run", upper, upper.lower()).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    word = F.when(F.col("h") % 199 == 0, F.concat(F.left("run", at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.char_length("word") >= 6)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    prepare(spark)
    return spelling.variant_groups(words_with_misspellings(table(spark, sf_dir, "documents")))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, one label in seven rows moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source targets of 150% of their words."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_substrings, op3_line_dedup, op4_passages, op5_token_counts, op6_language,
                                   op7_pack, op8_top_k, op9_decontaminate, op10_quality, op11_spelling,
                                   op12_negatives, op13_mix)}
ORACLE_SQL = {"op3_line_dedup": LINE_DEDUP_SQL, "op8_top_k": TOP_K_SQL, "op9_decontaminate": DECONTAMINATION_SQL,
              "op11_spelling": SPELLING_SQL, "op12_negatives": HARD_NEGATIVES_SQL}
