"""Candidate pools, role ranking and aligned preference pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.text import strip, text_key
from pairforge.operators.scaling import top_k
from pairforge.settings import PairSettings, PoolSettings

SCORES = ("residual_cos", "yz_utilization", "yz_violation_score", "origin_cos")
RANKED = ("source_id", "ordinal", "yz_pass", "bucket_name", "prompt_type", *SCORES)  # what pairing reads


def route_pool(
    trials: DataFrame, settings: PoolSettings = PoolSettings()
) -> DataFrame:
    """First ``target`` distinct texts per (source, route), in trial order.

    ``trials(source_id, prompt_route, generation_trial, candidate_text)``. Copies are
    reduced to their first trial before any per-source ranking.
    """
    limit = max(settings.target, settings.target * settings.trials_multiplier)
    text = F.col("candidate_text")
    keyed = trials.where((F.col("generation_trial") <= limit) & (strip(text) != "")).withColumn(
        "_key", F.sha2(text_key(text), 256)
    )
    first = top_k(
        keyed, ["source_id", "prompt_route", "_key"], [F.col("generation_trial")], 1, "_first"
    ).drop("_first", "_key")
    return top_k(
        first,
        ["source_id", "prompt_route"],
        [F.col("generation_trial")],
        settings.target,
        "candidate_index",
    )


def text_digest(text: Column) -> Column:
    """Digest of a normalised text, NULL for an empty one."""
    return F.when(strip(text) != "", F.unhex(F.sha2(text_key(text), 256)))


def deduplicate(candidates: DataFrame, keep_text: bool = True) -> DataFrame:
    """Keep the first candidate (by ``ordinal``) per source and normalised text.

    Without ``keep_text`` only a digest of the text takes part in the shuffle. Candidates that
    carry their ``text_digest`` need no text; it goes with the duplicates.
    """
    if "text_digest" in candidates.columns:
        keyed = candidates.withColumnRenamed("text_digest", "_key")
    else:
        keyed = candidates.withColumn("_key", text_digest(F.col("candidate_text")))
    keyed = keyed.where(F.col("_key").isNotNull())
    if not keep_text:
        keyed = keyed.drop("candidate_text")
    return top_k(keyed, ["source_id", "_key"], [F.col("ordinal")], 1, "_first").drop(
        "_first", "_key"
    )


def _score(name: str, missing: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(missing))


def chosen_order(origin: bool = True, missing_residual: float = 0.0) -> list[Column]:
    """Passing first, then low residual, high utilisation and high plain cosine."""
    keys = [
        F.when(F.col("yz_pass"), 0).otherwise(1).asc(),
        _score("residual_cos", missing_residual).asc(),
        _score("yz_utilization").desc(),
    ]
    return [*keys, _score("origin_cos").desc()] if origin else keys


def rejected_order(origin: bool = True) -> list[Column]:
    """Failing first by violation, then passing by residual."""
    passes = F.coalesce(F.col("yz_pass"), F.lit(False))
    residual = _score("residual_cos")
    keys = [
        F.when(passes, 1).otherwise(0).asc(),
        F.when(passes, -residual).otherwise(-_score("yz_violation_score")).asc(),
        F.when(passes, _score("yz_utilization")).otherwise(residual).asc(),
    ]
    return [*keys, _score("origin_cos").asc()] if origin else keys


def rank_chosen(pool: DataFrame, k: int) -> DataFrame:
    return top_k(pool, ["source_id"], [*chosen_order(), F.col("ordinal")], k, "role_rank")


def rank_rejected(pool: DataFrame, k: int) -> DataFrame:
    return top_k(pool, ["source_id"], [*rejected_order(), F.col("ordinal")], k, "role_rank")


def assign_roles(pool: DataFrame, settings: PairSettings = PairSettings()) -> DataFrame:
    """Roles per source over a deduplicated pool: ``role`` and ``role_rank``.

    The best ``chosen + rejected`` rows of the rejected order are enough: at most
    ``chosen`` of them are taken away by the other role.
    """
    chosen = rank_chosen(pool, settings.chosen_count)
    reach = settings.chosen_count + settings.rejected_count
    spare = rank_rejected(pool, reach).join(
        chosen.select("source_id", "ordinal"), ["source_id", "ordinal"], "left_anti"
    )
    window = Window.partitionBy("source_id").orderBy("role_rank")
    rejected = spare.withColumn("role_rank", F.row_number().over(window)).where(
        F.col("role_rank") <= settings.rejected_count
    )
    return chosen.withColumn("role", F.lit("chosen")).unionByName(
        rejected.withColumn("role", F.lit("rejected"))
    )


def order_for_pairing(roles: DataFrame, settings: PairSettings = PairSettings()) -> DataFrame:
    """Position of every candidate in its role's pairing order (0-based ``pair_rank``)."""
    parts = []
    for role, order, cap in (
        ("chosen", chosen_order(origin=False, missing_residual=999.0), settings.max_chosen),
        ("rejected", rejected_order(origin=False), settings.max_rejected),
    ):
        window = Window.partitionBy("source_id").orderBy(*order, "role_rank")
        part = roles.where(F.col("role") == role)
        part = part.withColumn("pair_rank", F.row_number().over(window) - 1)
        parts.append(part.where(F.col("pair_rank") < cap))
    return parts[0].unionByName(parts[1])


def strictly_worse(chosen: str, rejected: str) -> Column:
    """Is the rejected side strictly worse? Arguments are column prefixes."""

    def value(side: str, name: str, missing: float = 0.0) -> Column:
        return F.coalesce(F.col(f"{side}{name}"), F.lit(missing))

    good = F.coalesce(F.col(f"{chosen}yz_pass"), F.lit(False))
    bad = F.coalesce(F.col(f"{rejected}yz_pass"), F.lit(False))
    residual_c = value(chosen, "residual_cos", 999.0)
    residual_r = value(rejected, "residual_cos", 999.0)
    return (
        F.when(good & ~bad, F.lit(True))
        .when(~good & bad, F.lit(False))
        .when(good & bad & (residual_c != residual_r), residual_r > residual_c)
        .when(good & bad, value(rejected, "yz_utilization") < value(chosen, "yz_utilization"))
        .otherwise(value(rejected, "yz_violation") > value(chosen, "yz_violation"))
    )


def pair_margin(chosen: str, rejected: str) -> Column:
    """Weighted gap between the two sides. Arguments are column prefixes."""

    def gap(name: str, first: str, second: str) -> Column:
        return F.coalesce(F.col(f"{first}{name}"), F.lit(0.0)) - F.coalesce(
            F.col(f"{second}{name}"), F.lit(0.0)
        )

    def flag(side: str) -> Column:
        return F.when(F.col(f"{side}yz_pass"), 1.0).otherwise(0.0)

    return (
        F.lit(10.0) * (flag(chosen) - flag(rejected))
        + F.lit(2.0) * gap("residual_cos", rejected, chosen)
        + F.lit(2.0) * gap("yz_violation", rejected, chosen)
        + gap("yz_utilization", chosen, rejected)
    )


def align_pairs(ordered: DataFrame, settings: PairSettings = PairSettings()) -> DataFrame:
    """Join equal ranks of the two roles; keep strictly worse pairs with enough margin.

    ``pair_rank`` counts before the filter, so gaps are right. Both sides hold at most
    a few dozen rows per source here.
    """

    def side(role: str) -> DataFrame:
        return ordered.where(F.col("role") == role).select(
            "source_id",
            "pair_rank",
            F.col("ordinal").alias(f"{role}_ordinal"),
            F.col("yz_pass").alias(f"{role}_yz_pass"),
            F.col("bucket_name").alias(f"{role}_bucket"),
            F.col("prompt_type").alias(f"{role}_prompt_type"),
            F.coalesce("residual_cos", F.lit(0.0)).alias(f"{role}_residual_cos"),
            F.coalesce("yz_utilization", F.lit(0.0)).alias(f"{role}_yz_utilization"),
            F.coalesce("yz_violation_score", F.lit(0.0)).alias(f"{role}_yz_violation"),
            F.col("residual_cos").isNull().alias(f"_{role}_unknown"),
        )

    pairs = side("chosen").join(side("rejected"), ["source_id", "pair_rank"])
    for role in ("chosen", "rejected"):
        # An unknown residual counts as 999 in the comparison and as 0 in the margin.
        pairs = pairs.withColumn(
            f"_{role}_residual_cos",
            F.when(F.col(f"_{role}_unknown"), 999.0).otherwise(F.col(f"{role}_residual_cos")),
        )
        for name in ("yz_pass", "yz_utilization", "yz_violation"):
            pairs = pairs.withColumn(f"_{role}_{name}", F.col(f"{role}_{name}"))
    pairs = pairs.where(strictly_worse("_chosen_", "_rejected_")).withColumn(
        "pair_margin", pair_margin("chosen_", "rejected_")
    )
    pairs = pairs.where(F.col("pair_margin") >= settings.minimum_margin)
    return pairs.drop(*[c for c in pairs.columns if c.startswith("_")])


def attach_texts(pairs: DataFrame, texts: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fetch the texts of both sides, for the few candidates that made it into a pair.

    ``texts`` is ``(source_id, ordinal, candidate_text)``, or a function that adds
    ``candidate_text`` to rows of ``(source_id, ordinal)``. The texts found are shuffled once, by
    source, and the columns of their pair go with them.
    """
    sides = [F.struct(F.lit(role).alias("_role"), F.col(f"{role}_ordinal").alias("ordinal")) for role in ("chosen", "rejected")]
    carried = [c for c in pairs.columns if c not in ("source_id", "pair_rank", "chosen_ordinal", "rejected_ordinal")]
    wanted = pairs.select("source_id", "pair_rank", *carried, F.inline(F.array(*sides)))
    if isinstance(texts, DataFrame):
        found = wanted.join(texts.select("source_id", "ordinal", "candidate_text"), ["source_id", "ordinal"])
    else:
        found = texts(wanted)
    return (
        found.select("source_id", "pair_rank", *carried, "_role", "candidate_text")
        .repartition("source_id")
        .groupBy("source_id", "pair_rank")
        .agg(
            *[F.first(c).alias(c) for c in carried],
            *[
                F.max(F.when(F.col("_role") == role, F.col("candidate_text"))).alias(f"{role}_text")
                for role in ("chosen", "rejected")
            ],
        )
    )


def hard_filter(scored: DataFrame, k: int = 2) -> DataFrame:
    """Best ``k`` candidates per source by bucket, then by the chosen order."""
    return top_k(
        deduplicate(scored, keep_text=False),
        ["source_id"],
        [F.col("bucket_id"), *chosen_order(), F.col("ordinal")],
        k,
        "filter_rank",
    )
