"""A cleaning pipeline over ``documents``: language, toxicity, near copies, secrets, packing.

Every stage but the last keeps the columns of ``documents`` and decides on all rows that
the stage before it kept. Null and empty texts have no letter, so the first stage drops them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import language_id, minhash_dedup, packing, secret_scans, toxicity
from pairforge.llm.common import id_remainder
from pairforge.llm.queries import TOKENIZERS, table, toxic_labels
from pairforge.operators.scaling import checkpoint_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language; texts without a letter go."""
    profiles = language_id.learn_profiles(docs.where(id_remainder("doc_id", 4) != 2))
    named = language_id.identify(docs.select(*COLUMNS), profiles, COLUMNS)
    return named.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier does not take for toxic."""
    model = toxicity.fit(docs, toxic_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs.select(*COLUMNS), model, COLUMNS)
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of every group of near copies.

    Texts are near copies at a likeness of 0.8 of their 5-word shingles. Repeated rows become
    one. Rows without an id can't be named in a group and stay.
    """
    groups = minhash_dedup.near_duplicates(docs, likeness=80, least_matches=25)
    kept = groups.where("kept").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every document stays, with its new length."""
    clean = secret_scans.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into windows."""
    return packing.pack(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("toxicity", toxic),
    ("minhash_dedup", near_copies),
    ("secret_scans", secrets),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
