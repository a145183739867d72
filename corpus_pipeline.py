"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; other columns of docs are kept with them. Every stage
takes empty tables (and returns one), null ids, sources, languages and texts, texts of any length (whole), and rows that
repeat; what becomes of them is said with each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import bpe, language_id, mixing, near_dedup, secret_scan
from sedimenta.llm.common import materialize, release, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no text, no letter, or evidence below the calibrated threshold.

    The model learns from the documents with a language that op3 may learn from. Where there are none, nothing can be
    told and all stay. Repeated rows all stay or all go; only texts are sent to Python.
    """
    model = language_id.fit(docs, F.col("doc_id").isNotNull() & ~language_id.held_out())
    return docs if model is None else docs.where(language_id.identified(F.col("text"), model)["accepted"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that with the smallest id, ties to the smallest hash of the text.

    Of rows that repeat it one stays. A group whose documents have no id keeps one of them. Texts that are null or
    have no word are near nothing: they all stay, but for repeated rows of one id.
    """
    return near_dedup.distinct_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific live-looking secrets are replaced by a mark; widely copied examples and all documents stay."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: a document for each time it is served, cut after its last word taken if it ends the mix.

    Documents without a word are never served and go.
    """
    served = mixing.mixed_rows(mixing.weighted_fair_mix(docs))
    own = mixing.free_prefix(docs.columns)
    # possessive, so that a repetition of thousands of words takes no stack
    word = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++)"
    pattern = F.concat(F.lit(f"^{word}{{"), F.col(own + "words"), F.lit("}+"))
    first = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(0))
    text = F.when(F.col(own + "words") < F.col(own + "size"), first).otherwise(F.col("text"))
    return served.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids (little-endian unsigned 32-bit), a row for each document of the mix; a null text has no ids."""
    done = docs.select("doc_id", "source", bpe.encoded(public_tokenizers.path("byte_bpe_50k.json"), F.col("text")).alias("ids"))
    return done.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: Language identification and BPE can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted when the next one's is written; the last is the result's."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        done = materialize(stage(spark, docs, sf_dir), f"stage{n}")
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
