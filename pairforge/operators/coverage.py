"""Region coverage of texts: similarity, fusion, breadth and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.vectors import dots_with, unit
from pairforge.settings import ScoringSettings

MAX_REGION_CELLS = 4_000_000


def region_similarity(
    texts: DataFrame, chunks: DataFrame, regions: DataFrame
) -> DataFrame:
    """Whole-text and best-chunk similarity of every text with every region.

    ``texts(text_id, vec)``, ``chunks(text_id, vec)``, ``regions(region, vec)``. The
    region table is a fixed inventory; its size is checked before it is shipped to the
    tasks as a matrix. Chunk scores are maximised before the shuffle.
    """
    size = regions.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not size["n"]:
        raise ValueError("the region inventory is empty")
    if size["n"] * size["d"] > MAX_REGION_CELLS:
        raise ValueError("the region inventory is too large to ship to every task")
    fixed = regions.select("region", unit("vec").alias("vec")).orderBy("region").collect()
    names = F.array(*[F.lit(r["region"]) for r in fixed])
    products = dots_with([r["vec"] for r in fixed])

    def long(df: DataFrame) -> DataFrame:
        scores = df.select("text_id", products(unit("vec")).alias("scores"))
        return scores.select("text_id", F.posexplode("scores").alias("pos", "score"))

    best = long(chunks).groupBy("text_id", "pos").agg(F.max("score").alias("chunk_score"))
    whole = long(texts).withColumnRenamed("score", "global_score")
    return whole.join(best, ["text_id", "pos"]).select(
        "text_id",
        F.element_at(names, F.col("pos") + 1).alias("region"),
        "global_score",
        "chunk_score",
    )


def fused(global_score: Column, chunk_score: Column, chunk_weight: float = 0.8) -> Column:
    if not 0.0 <= chunk_weight <= 1.0:
        raise ValueError("chunk_weight must lie in [0, 1]")
    return F.lit(1.0 - chunk_weight) * global_score + F.lit(chunk_weight) * chunk_score


def fuse_scores(scores: DataFrame, settings: ScoringSettings = ScoringSettings()) -> DataFrame:
    return scores.withColumn(
        "final_score", fused(F.col("global_score"), F.col("chunk_score"), settings.chunk_weight)
    )


def breadth_depth(
    scores: DataFrame,
    key: str = "text_id",
    settings: ScoringSettings = ScoringSettings(),
) -> DataFrame:
    """Share of regions hit and mean excess over the threshold among the hits."""
    limit = settings.hit_threshold
    excess = F.when(F.col("final_score") >= limit, F.col("final_score") - F.lit(limit))
    return scores.groupBy(key).agg(
        (F.count(excess) / F.count("final_score")).alias("breadth"),
        F.coalesce(F.avg(excess), F.lit(0.0)).alias("depth"),
        F.count(excess).alias("hit_count"),
        F.count("final_score").alias("total_count"),
    )


def breadth_depth_arrays(
    scores: Column, settings: ScoringSettings = ScoringSettings()
) -> tuple[Column, Column]:
    """The same for one array of fused scores per row; empty arrays give zeros."""
    limit = F.lit(settings.hit_threshold)
    hits = F.filter(scores, lambda s: s >= limit)
    excess = F.aggregate(hits, F.lit(0.0), lambda total, s: total + (s - limit))
    breadth = F.coalesce(
        F.size(hits) / F.nullif(F.size(scores), F.lit(0)).cast("double"), F.lit(0.0)
    )
    depth = F.coalesce(excess / F.nullif(F.size(hits), F.lit(0)), F.lit(0.0))
    return breadth, depth
