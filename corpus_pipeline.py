"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet
in the shared folder and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, lines, minhash, mixing, quality
from tidewatch.llm.common import Scratch, read
from tidewatch.llm.queries import DOMAIN, WEIGHTS, vocabulary_text
from tidewatch.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the classifier is trained on labelled documents of this stage's input."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), model).where("score >= 0.3").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines with a word and of runs of two lines or more go; so do documents of which nothing is left."""
    out = lines.dedup_lines(docs.select(COLUMNS), min_lines=2, min_words=1).where("text is not null")
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of smallest doc_id stays.
    Repeated doc_ids are one document; rows without a doc_id stay."""
    docs = docs.select(COLUMNS)
    kept = minhash.near_duplicates(docs, width=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by the weights of domains and languages; no document comes twice."""
    return mixing.mix(docs.select(COLUMNS), [F.expr(DOMAIN), "lang", "source"], WEIGHTS, fraction=0.9, epochs=1).select(COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")), vocabulary_text(), exact="exact")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "exact")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("bpe", bpe_encode),
]

#: The classifier can't be written in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
        if hasattr(before, "scratch_path"):
            scratch.drop(before)
    return docs
