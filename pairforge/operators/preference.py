"""Export of preference pairs as chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import clean_completion
from pairforge.operators.contracts import require
from pairforge.operators.prompts import render_prompts


def message(role: str, parts: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), parts.alias("content")))


def text_part(value: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), value.alias("text"))


def shuffle_key(seed: int, *parts: Column | str) -> Column:
    """Order key of a seeded shuffle; it travels as a column instead of a sort order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def preference_records(
    pairs: DataFrame, templates: DataFrame, seed: int, strict: bool = True
) -> DataFrame:
    """``shuffle_key, prompt, chosen, rejected`` message arrays, one record per pair.

    ``templates(label, template)``. Strict mode refuses empty texts and completions with
    role markers; otherwise they keep a ``status`` other than ``ok``.
    """
    chosen, chosen_status = clean_completion(F.col("chosen_text"))
    rejected, rejected_status = clean_completion(F.col("rejected_text"))
    rows = render_prompts(pairs, templates, keys=("label",), text="anchor_text")
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    records = rows.select(
        "train_id",
        "pair_rank",
        shuffle_key(
            seed, F.col("train_id").cast("string"), F.col("pair_rank").cast("string")
        ).alias("shuffle_key"),
        F.when(F.col("prompt_status") != "ok", F.col("prompt_status"))
        .when(chosen_status != "ok", chosen_status)
        .otherwise(rejected_status)
        .alias("status"),
        message("user", F.array(image, text_part(F.col("prompt")))).alias("prompt"),
        message("assistant", F.array(text_part(chosen))).alias("chosen"),
        message("assistant", F.array(text_part(rejected))).alias("rejected"),
    )
    if strict:
        broken = records.where(F.col("status") != "ok").select("train_id", "pair_rank", "status")
        require(broken, "pairs cannot be exported")
    return records
