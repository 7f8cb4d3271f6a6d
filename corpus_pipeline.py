"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm import langid, minhash, mixing, packing, pii
from symlake.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has a language; it becomes lang. Rejected are texts that are null or have no letter."""
    model = langid.learn(docs)
    rows = langid.identify_rows(_documents(docs), model)
    return _documents(rows.filter(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the one with the smallest doc_id."""
    docs = _documents(docs)
    gone = minhash.near_duplicates(docs, width=5, percent=80).filter("not kept").select("doc_id").distinct()
    # Rows that repeat as a whole are one document.
    return _documents(docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with marks in place of personal data and of the terms that reveal it."""
    found = pii.find(_documents(docs))
    return _documents(found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("redacted").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come up to their weights by repetition: every document at least once, so none is lost."""
    return _documents(mixing.mix(_documents(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row becomes pieces in sequences of at most 2048 tokens; repeated rows and rows without a doc_id are documents of their own."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("remove_pii", remove_pii), ("mix_sources", mix_sources), ("pack", pack)]
#: No SQL can express the tokenizer, the language model or the permutations: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Each result is written once as a table in the shared folder, so no later stage repeats what is before it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
