"""A corpus pipeline over ``documents``: each stage's output is written and read again as the next one's input.

Every stage works on all rows that its predecessor kept. All but the last return the columns of their input, whatever
they are; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import gam, packing, rules, simhash, windows
from tidewatch.llm.queries import GOOD, tokenizer_file
from tidewatch.llm.tables import table
from tidewatch.session import staged


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted to the labelled ones that are not held out, scores as good."""
    score = gam.scorer(gam.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) >= GOOD)


def check_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor a risk-controlled cutoff rejects.

    Cutoffs are proven on the held-out labels alone: the classifier before was fitted to the others, so among these the
    documents that it left are no fair sample.
    """
    return rules.keep(docs, table(spark, sf_dir, "labels").where(gam.held_out(F.col("doc_id"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity from 0.8."""
    return simhash.keep_one(docs, simhash.SIMILAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 50 words that a document with a smaller id holds; ``n_chars`` follows the text."""
    out = windows.cut(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece, as ``op5_packing`` returns them."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, keep_ids=False)


STAGES = [("quality classifier", classify), ("quality rules", check_rules), ("simhash near-dedup", drop_near_copies),
          ("substring dedup", cut_repeats), ("packing", pack)]

#: A learned score decides which documents stay, which SQL cannot express. The tests of the operators hold
#: them against brute force; run() as a whole is tested by properties only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
