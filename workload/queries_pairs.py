"""Pool, ranking and pairing queries (R1-R12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.operators import pairs as P
from pairforge.operators.scaling import durable
from pairforge.plans.pairing import build_pairs
from pairforge.settings import PoolSettings
from workload.registry import query, rounded
from workload.views import Views

KEY_SQL = "regexp_replace(trim(lower(candidate_text), e' \\t\\n\\r'), '\\s+', ' ', 'g')"


@query(
    "R1_route_pool",
    f"""with keyed as (select source_id, prompt_route, ordinal as generation_trial, candidate_text,
          {KEY_SQL} as k from candidates where ordinal <= 20),
        firsts as (select * from (select *, row_number() over (
            partition by source_id, prompt_route, k order by generation_trial) as first_copy
          from keyed where k <> '') where first_copy = 1)
      select source_id, prompt_route, generation_trial, candidate_index from (
        select *, row_number() over (partition by source_id, prompt_route
          order by generation_trial) as candidate_index from firsts)
      where candidate_index <= 5""",
)
def route_pool(v: Views):
    trials = v.candidates.withColumnRenamed("ordinal", "generation_trial")
    pool = P.route_pool(trials, PoolSettings(target=5))
    return pool.select("source_id", "prompt_route", "generation_trial", "candidate_index")


@query("R2_deduplicate", "select source_id, ordinal, cand_doc from pool")
def deduplicate(v: Views):
    return P.deduplicate(v.candidates).select("source_id", "ordinal", "cand_doc")


@query("R3_chosen_order", "select source_id, ordinal, chosen_rank as role_rank from ranked where chosen_rank <= 6")
def chosen_order(v: Views):
    return P.rank_chosen(P.deduplicate(v.scored(text=True), keep_text=False), 6).select(
        "source_id", "ordinal", "role_rank"
    )


@query(
    "R4_rejected_order",
    "select source_id, ordinal, rejected_order as role_rank from ranked where rejected_order <= 36",
)
def rejected_order(v: Views):
    return P.rank_rejected(P.deduplicate(v.scored(text=True), keep_text=False), 36).select(
        "source_id", "ordinal", "role_rank"
    )


def _roles(v: Views):
    return P.assign_roles(durable(P.deduplicate(v.scored(text=True), keep_text=False)))


@query("R5_roles", "select source_id, ordinal, role, role_rank from roles")
def roles(v: Views):
    return _roles(v).select("source_id", "ordinal", "role", "role_rank")


@query("R6_pair_order", "select source_id, ordinal, role, pair_rank from pairing")
def pair_order(v: Views):
    return P.order_for_pairing(_roles(v)).select("source_id", "ordinal", "role", "pair_rank")


def _rank_joined(v: Views):
    ordered = P.order_for_pairing(_roles(v))
    fields = ("yz_pass", "residual_cos", "yz_utilization")

    def side(role: str):
        return ordered.where(F.col("role") == role).select(
            "source_id",
            "pair_rank",
            *[F.col(f).alias(f"{role}_{f}") for f in fields],
            F.col("yz_violation_score").alias(f"{role}_yz_violation"),
        )

    return side("chosen").join(side("rejected"), ["source_id", "pair_rank"])


@query("R7_strictly_worse", "select source_id, pair_rank, worse from judged_pairs")
def strictly_worse(v: Views):
    return _rank_joined(v).select(
        "source_id", "pair_rank", P.strictly_worse("chosen_", "rejected_").alias("worse")
    )


@query("R8_pair_margin", "select source_id, pair_rank, r6(pair_margin) as pair_margin from judged_pairs")
def pair_margin(v: Views):
    return rounded(
        _rank_joined(v).select(
            "source_id", "pair_rank", P.pair_margin("chosen_", "rejected_").alias("pair_margin")
        )
    )


@query(
    "R9_aligned_pairs",
    """select source_id, pair_rank, chosen_bucket, rejected_bucket, r6(pair_margin) as pair_margin
      from pairs""",
)
def aligned_pairs(v: Views):
    pairs = P.align_pairs(P.order_for_pairing(_roles(v)))
    return rounded(
        pairs.select("source_id", "pair_rank", "chosen_bucket", "rejected_bucket", "pair_margin")
    )


PAIR_COLUMNS = (
    "train_id pair_mode pair_rank label chosen_yz_pass rejected_yz_pass chosen_bucket "
    "rejected_bucket chosen_prompt_type rejected_prompt_type chosen_residual_cos "
    "rejected_residual_cos chosen_yz_utilization rejected_yz_utilization chosen_yz_violation "
    "rejected_yz_violation pair_margin"
).split()


@query(
    "R10_all_pairs",
    """select p.source_id as train_id, 'aligned' as pair_mode, p.pair_rank, p.label,
        s.text1 as anchor_text, p.chosen_text, p.rejected_text, p.chosen_yz_pass,
        p.rejected_yz_pass, p.chosen_bucket, p.rejected_bucket, p.chosen_prompt_type,
        p.rejected_prompt_type, r6(p.chosen_residual_cos) as chosen_residual_cos,
        r6(p.rejected_residual_cos) as rejected_residual_cos,
        r6(p.chosen_yz_utilization) as chosen_yz_utilization,
        r6(p.rejected_yz_utilization) as rejected_yz_utilization,
        r6(p.chosen_yz_violation) as chosen_yz_violation,
        r6(p.rejected_yz_violation) as rejected_yz_violation, r6(p.pair_margin) as pair_margin
      from pairs p join sources s using (source_id)""",
)
def all_pairs(v: Views):
    pairs = build_pairs(v.sources, v.scored(text=True), texts=v.candidate_texts)
    return rounded(pairs.select(*PAIR_COLUMNS, "anchor_text", "chosen_text", "rejected_text"))


@query(
    "R12_hard_filter",
    """select source_id, ordinal, bucket_id, filter_rank from (select *, row_number() over (
        partition by source_id order by bucket_id, (not yz_pass)::int, residual_cos,
          -yz_utilization, -origin_cos, ordinal) as filter_rank from pool)
      where filter_rank <= 2""",
)
def hard_filter(v: Views):
    return P.hard_filter(v.scored(text=True)).select(
        "source_id", "ordinal", "bucket_id", "filter_rank"
    )
