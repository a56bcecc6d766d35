"""Corpus pipeline: five stages, each applying one operator of ``fluxsieve.llm`` to all its predecessor kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All stages but
the last return the columns of ``documents``.  Counted as part of the ``llm`` subpackage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxsieve.llm import bpe, mixing, ordinal, simhash, suffix
from fluxsieve.llm.queries import graded, table, vocabulary
from fluxsieve.session import ensure_checkpoint_dir

#: SQL cannot express the fitted classifier, the fingerprints or the byte-pair encoding; the
#: stages are tested against brute force instead (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose probability of the best grade reaches one half (all, without ratings)."""
    cols = docs.columns
    model = ordinal.fit(docs, graded(table(spark, sf_dir, "labels")), n_grades=3)
    scored = ordinal.score(docs.select(F.struct(*cols).alias("row"), "text"), model, tail_grade=2, carry=["row"])
    return scored.filter("selected").select(*[F.col("row").getField(c).alias(c) for c in cols])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies."""
    return simhash.keep_one(docs, words=3, radius=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 200 bytes or more that occur twice (a character cut apart goes as a whole);
    documents of which nothing but white space is left go."""
    cols = docs.columns
    out = suffix.remove_repeated(docs.select(F.struct(*cols).alias("row"), "doc_id", "text"), length=200, carry=["row"],
                                 whole_characters=True)
    left = F.col("kept").cast("string")
    blank = F.trim(F.translate(left, mixing.WHITE, " " * len(mixing.WHITE))) == ""
    changed = {"text": left, "n_chars": F.length(left).cast("long")}
    return out.filter((F.col("n_removed") == 0) | ~blank).select(*[
        (F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col("row").getField(c)) if c in changed
         else F.col("row").getField(c)).alias(c) for c in cols])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents to their sources' targets, in training order."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return bpe.encode_documents(docs, vocabulary()).select("doc_id", "n_tokens", "ids")


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("mixing to target weights", mixing_stage), ("bpe encoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table; what each returns is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
