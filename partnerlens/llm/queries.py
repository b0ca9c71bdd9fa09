"""Registered queries of the operators and of the pipeline, each over the
whole of its table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partnerlens.llm import divergence as source_divergence, hard_negatives as negatives, ngram_join
from partnerlens.llm.ann import nearest
from partnerlens.llm.common import scratch_path
from partnerlens.llm.encoder import tokenizer_path
from partnerlens.llm.hmm import lm_scores
from partnerlens.llm.html_crf import main_text
from partnerlens.llm.mixing import mix
from partnerlens.llm.packing import pack
from partnerlens.llm.quality import quality
from partnerlens.llm.sharding import sharded
from partnerlens.llm.simhash import simhash_groups
from partnerlens.llm.substring_dedup import substring_dedup
from partnerlens.llm.token_files import read_token_index, write_token_files

# quotas of the sources; what is not listed shares the quota of one
TARGETS = {"src0": 4, **{f"src{i}": 1 for i in range(1, 20)}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mixture."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), TARGETS)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_index(write_token_files(docs, scratch_path(spark, "tokens"), tokenizer_path("byte_bpe_50k.json")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier elsewhere."""
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and groups of near copies."""
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every document."""
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op9_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by the Jaccard similarity of their shingles."""
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its five best positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0, label)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of every language, and the terms behind them."""
    return source_divergence.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_files, op3_substring_dedup, op4_simhash, op5_packing, op6_quality,
                                   op7_nearest, op8_main_text, op9_hmm_score, op10_rendezvous, op11_ngram_join,
                                   op12_hard_negatives, op13_divergence)}
SQL: dict[str, str] = {"op11_ngram_join": ngram_join.SQL, "op12_hard_negatives": negatives.SQL,
                        "op13_divergence": source_divergence.SQL}
