"""From scored candidates to the preference-pair table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.pairs import (
    RANKED,
    align_pairs,
    assign_roles,
    attach_texts,
    deduplicate,
    order_for_pairing,
)
from pairforge.operators.scaling import durable
from pairforge.settings import PairSettings

MINIMAL = ("anchor_text", "chosen_text", "rejected_text", "label")


def build_pairs(
    sources: DataFrame,
    scored: DataFrame,
    settings: PairSettings = PairSettings(),
    texts: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Aligned pairs of all sources; sources without candidates give none.

    Ranking runs on scores alone. ``texts`` supplies the texts of the winners as ``attach_texts``
    describes; by default they come from ``scored``, which otherwise may carry a ``text_digest``
    in place of the text.
    """
    pool = durable(deduplicate(scored, keep_text=False).select(*RANKED))
    slim = align_pairs(order_for_pairing(assign_roles(pool, settings), settings), settings)
    pairs = attach_texts(durable(slim), scored if texts is None else texts)
    anchors = sources.select(
        "source_id", F.col("text1").alias("anchor_text"), F.col("label").cast("int").alias("label")
    )
    return (
        pairs.join(anchors, "source_id")
        .withColumnRenamed("source_id", "train_id")
        .withColumn("pair_mode", F.lit("aligned"))
    )


def minimal_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(*MINIMAL)
