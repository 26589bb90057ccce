"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that the
stage before kept, and returns the columns of ``documents``; only the last one
returns pieces of sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm.common import documents, drop_shared, write_shared
from loglattice.llm.minhash import keep_one_near
from loglattice.llm.mixing import mix
from loglattice.llm.packing import pack
from loglattice.llm.suffix_dedup import remove_repeats
from loglattice.llm.toxicity import fold, learn, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; learned from the training fold of the labels.

    Where these teach nothing, for want of examples of both classes, all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold() != 0)
    index = learn(docs, labels)
    if not index.learned:
        return docs
    scored = score_toxicity(docs, index)
    return scored.filter(F.col("__score") < 0.5).select("__doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more between sets of five-word shingles.

    The one with the least id stays, a null id last; null texts are empty, texts
    without words are copies of one another, of wholly repeated rows one stays.
    Candidates are linked by SimHash fingerprints within three bits; since these miss
    most texts at 0.8, also those that agree in a band of MinHash values.  All of
    them are gone through, and true similarity decides.
    """
    return keep_one_near(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the bytes of 200-byte strings that start at two places or more; ``n_chars`` follows the text."""
    left = remove_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))
    return left


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    taken = mix(docs).filter("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("packing", packing)]

#: No SQL expresses these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if kept is not None:
            drop_shared(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
