"""Pipeline over ``documents``: quality rules, SimHash near-dedup, substring
dedup, mixing sources to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``; the mixing
stage adds ``mix_position``, the place of a document in the mixture, in whose
order the packing stage takes the documents.  Null and empty texts have no
words and end with the quality stage; every row is judged by its own text, also
where ids repeat or are missing, and of rows equal in id and text one stays;
an empty table passes through as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partnerlens.llm.common import scratch
from partnerlens.llm.encoder import tokenizer_path
from partnerlens.llm.mixing import mix
from partnerlens.llm.packing import pack
from partnerlens.llm.quality import quality
from partnerlens.llm.queries import TARGETS
from partnerlens.llm.simhash import one_per_group
from partnerlens.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules do not reject, every row by its own text."""
    judged = quality(docs, carry=tuple(COLUMNS)).filter("kept")
    return judged.select(*[F.col(f"c_{c}").alias(c) for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest id."""
    return one_per_group(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words and more that start earlier
    elsewhere; a text that loses nothing stays as it is."""
    cut = substring_dedup(docs, carry=("text", "lang", "source", "n_chars"))
    whole = F.col("n_removed") == 0
    return cut.select("doc_id", F.when(whole, F.col("c_text")).otherwise(F.col("kept_text")).alias("text"),
                      F.col("c_lang").alias("lang"), F.col("c_source").alias("source"),
                      F.when(whole, F.col("c_n_chars")).otherwise(
                          F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])).alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, placed so that every source has its target share."""
    return mix(docs.select(*COLUMNS), TARGETS).select(*COLUMNS, "mix_position")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, in the order of the mixture."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), order="mix_position")


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeated_passages),
          ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None  # EM, automata and online packing have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
