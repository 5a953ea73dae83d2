"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, jpeg, licences, lines, minhash, mixing, phrases, quality, search, sharding, substring, toxicity, vptree
from tidewatch.llm.common import read
from tidewatch.llm.oracle import ORACLE  # noqa: F401
from tidewatch.session import ship

#: Name of the vocabulary file that op1 uses, found through the installed package of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_text(name: str = VOCABULARY) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary_text())


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op3_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, factor=1.0)


#: Weights of domains (four groups of sources, by number) and, below each, of languages, for op4 and the pipeline.
DOMAIN = "concat('domain', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0) % 4)"
WEIGHTS = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0} | {(f"domain{d}", lang): w for d in range(4) for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), [F.expr(DOMAIN), "lang", "source"], WEIGHTS, epochs=2)
    return mixed.select("doc_id", "lang", "source", "epoch")


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence", F.round("dice", 6).alias("dice"), "licence_lines")


def op7_licence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_licences compares single lines, as its SQL does; here all runs of words of a template's size."""
    return licences.scan_runs(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence", F.round("dice", 6).alias("dice"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2)
    return out.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_lines takes runs of two lines or more, as its SQL does; here every line with a word is a run by itself too."""
    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2, min_words=1)
    return out.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_maximal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common prefix with any other place of each text's lines: its longest maximal repeated run."""
    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2)
    return out.select("doc_id", "n_lines", "longest_repeat")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"), width=35, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _shipped(f) for f in (op1_bpe, op2_minhash, op3_vptree, op4_mixing, op5_jpeg, op6_sharding, op7_licences, op7_licence_runs, op8_quality, op9_lines, op9_repeated_lines, op9_maximal_runs, op10_substring, op11_phrases, op12_toxicity, op13_search)}
