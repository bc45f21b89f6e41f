"""Audit and representation queries (A), and the report tables built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.operators import audit as A
from pairforge.operators import bootstrap as B
from pairforge.operators import representation as R
from pairforge.operators import report as T
from pairforge.operators.contracts import complete_left_join
from pairforge.operators.scaling import written
from pairforge.plans.evaluation import seed_summary
from workload.queries_evaluation import SETTINGS, _boot, r
from workload.registry import query, rounded
from workload.views import EXTERNAL, Views

FILE_KEYS = "method, seed"
MEANS = [f"{m}_mean" for m in A.MEASURES]
MEDIANS = [f"{m}_median" for m in A.MEASURES]
RATES = ("yz_pass_rate", "x_pass_rate", "joint_pass_rate", "yz_fail_rate", "x_fail_rate")


@query(
    "A1_file_audit",
    f"""select method, seed, count(*) as n_samples, r6(avg(yz_pass::int)) as yz_pass_rate,
      r6(avg(x_pass::int)) as x_pass_rate, r6(avg(joint_pass::int)) as joint_pass_rate,
      r6(avg((not yz_pass)::int)) as yz_fail_rate, r6(avg((not x_pass)::int)) as x_fail_rate,
      {", ".join(f"r6(avg({c})) as {n}_mean, r6(median({c})) as {n}_median" for n, c in A.MEASURES.items())}
      from audit group by method, seed""",
)
def file_audit(v: Views):
    return rounded(A.file_audit(v.audit))


COUPLING = ("x_pass_within_yz_pass", "x_pass_within_yz_fail", "x_pass_difference", "phi")


@query("A2_coupling", f"select {r(*COUPLING, keys=FILE_KEYS)} from coupling")
def coupling(v: Views):
    return rounded(A.coupling(v.audit))


@query(
    "A3_directional_failure",
    f"select {r('over_completion', 'evidence_loss', keys=FILE_KEYS)} from directional",
)
def directional_failure(v: Views):
    return rounded(A.directional_failure(v.audit))


SUMMARY = (
    "yz_pass_rate",
    "x_pass_rate",
    "joint_pass_rate",
    *COUPLING,
    "over_completion",
    "evidence_loss",
    "residual_similarity_mean",
    "overall_contamination",
    "f1",
)


@query(
    "A4_method_summary",
    "select method, count(*) as n_seeds, "
    + ", ".join(f"r6(avg({c})) as {c}_mean, r6(stddev_samp({c})) as {c}_sd" for c in SUMMARY)
    + " from bridge group by method",
)
def method_summary(v: Views):
    return rounded(A.method_summary(v.bridge(), SUMMARY))


@query(
    "A5_joint_pass_by_label",
    """select method, source_label, r6(avg(rate)) as mean, r6(stddev_samp(rate)) as sd,
      count(*) as n_seeds from (select method, seed, source_label, avg(joint_pass::int) as rate
        from audit group by all) group by method, source_label""",
)
def joint_pass_by_label(v: Views):
    return rounded(A.joint_pass_by_label(v.audit))


@query(
    "A6_bucket_mix",
    """select method, bucket_name, count(*) as n, r6(avg(residual_cos)) as residual_mean,
      r6(avg(joint_pass::int)) as joint_pass_rate,
      r6(100.0 * count(*) / sum(count(*)) over (partition by method)) as percent
      from audit group by method, bucket_name""",
)
def bucket_mix(v: Views):
    return rounded(A.bucket_mix(v.audit))


@query(
    "A7_knn_contamination",
    "select method, source_id, aug_round, r6(opposite_rate) as opposite_rate from contamination",
)
def knn_contamination(v: Views):
    return rounded(v.contamination().select("method", "source_id", "aug_round", "opposite_rate"))


@query(
    "A7_nearest_sources",
    """select vec_id as query_id, ref_id, rank from (select a.vec_id, s.source_id as ref_id,
        row_number() over (partition by a.vec_id order by
          round(1 - list_dot_product(a.vec, b.vec), 9), s.source_id) as rank
      from unit_vecs a, sources s join unit_vecs b
        on b.vec_id = s.source_id % (select n from n_vecs)) where rank <= 10""",
)
def nearest_sources(v: Views):
    """Small blocks on purpose: several reference blocks have to be merged."""
    queries = v.vectors.select(F.col("vec_id").alias("query_id"), "vec")
    found = R.nearest_shared(queries, v.source_references, v.vectors, 10, block_rows=256)
    return found.select("query_id", "ref_id", "rank")


@query(
    "A8_contamination_summary",
    """select method, source_label, count(*) as n, r6(avg(opposite_rate)) as mean,
      r6(stddev_samp(opposite_rate)) as sd, r6(median(opposite_rate)) as median,
      r6(100 * avg((opposite_rate >= 0.5)::int)) as percent_ge_50,
      r6(100 * avg((opposite_rate >= 0.8)::int)) as percent_ge_80,
      case source_label when 0 then '0-to-1' else '1-to-0' end as direction
      from contamination group by method, source_label""",
)
def contamination_summary(v: Views):
    return rounded(A.contamination_summary(v.contamination()))


@query(
    "A9_cap_sample",
    """select event_type, event_id, sample_rank from (select event_type, event_id, row_number()
        over (partition by event_type order by md5('2024:' || event_id), event_id) as sample_rank
      from events) where sample_rank <= 800""",
)
def cap_sample(v: Views):
    return R.cap_sample(v.table("events"), ["event_type"], "event_id").select(
        "event_type", "event_id", "sample_rank"
    )


@query("A10_pca_2d")
def pca_2d(v: Views):
    coordinates, _ = R.pca(v.vectors, "vec_id", 2)
    return rounded(
        coordinates.select(
            "vec_id", *[F.element_at("coordinates", i).alias(f"dim{i}") for i in (1, 2)]
        )
    )


@query("A10_explained_variance")
def explained_variance(v: Views):
    return rounded(R.pca(v.vectors, "vec_id", 2)[1])


@query("A11_pca_50d")
def pca_50d(v: Views):
    coordinates, _ = R.pca(v.vectors, "vec_id", 50, scale="l2")
    return coordinates.select("vec_id", F.posexplode("coordinates").alias("component", "value"))


PAIRS = {
    "over_completion": ("over_completion", "one_to_zero_contamination"),
    "evidence_loss": ("evidence_loss", "zero_to_one_contamination"),
    "contamination": ("overall_contamination", "f1"),
    "residual": ("residual_similarity_mean", "f1"),
}
PAIR_SQL = " union all ".join(
    f"select '{name}' as pair, {x} as x, {y} as y, method from bridge" for name, (x, y) in PAIRS.items()
)
RANK_CORR = """select {g}, count(*) as n, r6(corr(rx, ry)) as rho from (select *,
    rank() over (partition by {g} order by x)
      + (count(*) over (partition by {g}, x) - 1) / 2.0 as rx,
    rank() over (partition by {g} order by y)
      + (count(*) over (partition by {g}, y) - 1) / 2.0 as ry
  from {t} where x is not null and y is not null) group by {g}"""


@query(
    "A12_predictor_utility",
    f"with p as materialized ({PAIR_SQL}) " + RANK_CORR.format(g="pair", t="p"),
)
def predictor_utility(v: Views):
    table = A.spearman(A.named_pairs(v.bridge(), PAIRS), ["pair"])
    return rounded(table.drop("p_value"))


@query(
    "A13_attach_coordinates",
    """select a.method, a.source_id, a.aug_round, r6(v.vec[1]) as dim1, r6(v.vec[2]) as dim2
      from audit a join vectors v on v.vec_id = a.cand_doc % (select n from n_vecs)""",
)
def attach_coordinates(v: Views):
    coordinates = v.vectors.select(
        "vec_id", F.element_at("vec", 1).alias("dim1"), F.element_at("vec", 2).alias("dim2")
    )
    rows = v.audit.withColumn("vec_id", F.col("cand_doc") % v.n_vecs)
    out = R.attach_coordinates(rows, coordinates, "vec_id")
    return rounded(out.select("method", "source_id", "aug_round", "dim1", "dim2"))


@query(
    "A14_held_out_regression",
    """with pts as materialized (select * from points),
      near as (select q.point_id, sqrt((q.dim1 - t.dim1) * (q.dim1 - t.dim1)
            + (q.dim2 - t.dim2) * (q.dim2 - t.dim2)) as d, t.value as tv, t.point_id as tid
        from pts q join pts t on q.label = t.label and q.fold <> t.fold),
      best as (select * from (select *, row_number() over (partition by point_id
          order by round(d, 9), tid) as rank from near) where rank <= 40),
      pred as (select point_id, coalesce(avg(tv) filter (d = 0),
          sum(tv / nullif(d, 0)) / sum(1 / nullif(d, 0))) as predicted from best group by point_id)
      select label, count(*) as n, r6(1 - sum((value - predicted) * (value - predicted))
          / (var_pop(value) * count(*))) as r2, r6(avg(abs(value - predicted))) as mae
      from pts join pred using (point_id) group by label""",
)
def held_out_regression(v: Views):
    return rounded(R.regression_quality(R.held_out_regression(v.points())))


@query("A15_held_out_classifier")
def held_out_classifier(v: Views):
    return rounded(R.held_out_classifier(v.points()))


@query(
    "A16_spearman_scopes",
    """with p as materialized (select 'with_reference' as scope, residual_cos as x, yz_utilization as y from audit
        union all select 'without_reference', residual_cos, yz_utilization from audit
        where method <> 'paired') """
    + RANK_CORR.format(g="scope", t="p"),
)
def spearman_scopes(v: Views):
    scopes = F.explode(
        F.when(F.col("method") == "paired", F.array(F.lit("with_reference"))).otherwise(
            F.array(F.lit("with_reference"), F.lit("without_reference"))
        )
    )
    rows = v.audit.select(
        scopes.alias("scope"), F.col("residual_cos").alias("x"), F.col("yz_utilization").alias("y")
    )
    return rounded(A.spearman(rows, ["scope"]).drop("p_value"))


@query(
    "A17_regression_lines",
    f"""with p as materialized ({PAIR_SQL}) select pair, count(*) as n, r6(regr_slope(y, x)) as slope,
      r6(regr_intercept(y, x)) as intercept from p where x is not null and y is not null
      group by pair having count(distinct x) > 1""",
)
def regression_lines(v: Views):
    return rounded(A.regression_lines(A.named_pairs(v.bridge(), PAIRS), ["pair"]))


DOMAINS = {
    "yz_pass_rate": "coverage",
    "x_pass_rate": "residual",
    "joint_pass_rate": "coverage",
    "over_completion": "direction",
    "evidence_loss": "direction",
    "overall_contamination": "neighbourhood",
}
DEVIATION_SQL = f"""bm as materialized (select method, metric, avg(value) as value from (
      select method, seed, {", ".join(f"{m}::double as {m}" for m in DOMAINS)} from bridge)
    unpivot (value for metric in ({", ".join(DOMAINS)})) group by method, metric),
  ref as (select metric, value from bm where method = 'paired'),
  spread as (select metric, stddev_pop(value) as s from bm group by metric),
  dev as (select method, metric, bm.value, ref.value as reference_value,
      (bm.value - ref.value) / nullif(s, 0) as deviation
    from bm join ref using (metric) join spread using (metric))"""


@query(
    "A18_balance_distance",
    f"""with {DEVIATION_SQL}, d as (select method,
        {", ".join(f"sqrt(avg(deviation * deviation) filter (metric in ({', '.join(repr(m) for m, x in DOMAINS.items() if x == n)}))) as {n}_distance" for n in sorted(set(DOMAINS.values())))},
        sqrt(avg(deviation * deviation)) as overall_distance from dev group by method)
      select method, r6(overall_distance) as overall_distance,
        {", ".join(f"r6({n}_distance) as {n}_distance" for n in sorted(set(DOMAINS.values())))},
        case when method = 'paired' then 'reference' else
          {" ".join([f"case when {n}_distance = greatest({', '.join(f'{m}_distance' for m in sorted(set(DOMAINS.values())))}) then '{n}' else" for n in sorted(set(DOMAINS.values()))])}
          null {"end " * len(set(DOMAINS.values()))} end as dominant_domain from d""",
)
def balance_distance(v: Views):
    deviations = A.standardized_deviation(v.bridge(), list(DOMAINS), "paired")
    return rounded(A.balance_distance(deviations, DOMAINS, "paired"))


@query(
    "A19_matched_contrasts",
    f"""with {DEVIATION_SQL} select method,
        {", ".join(f"r6(max(value - reference_value) filter (metric = '{m}')) as delta_{m}, r6(max(deviation) filter (metric = '{m}')) as standardized_{m}" for m in DOMAINS)},
        arg_max(metric, abs(deviation)) as dominant_metric,
        r6(arg_max(deviation, abs(deviation))) as dominant_deviation
      from dev where method <> 'paired' group by method""",
)
def matched_contrasts(v: Views):
    bridge, columns = v.bridge(), list(DOMAINS)
    deviations = A.standardized_deviation(bridge, columns, "paired")
    summary = A.method_summary(bridge, columns)
    return rounded(A.matched_contrasts(summary, deviations, columns, "paired"))


@query(
    "A20_residual_table",
    """select method, count(*) as n, r6(avg(residual_cos)) as mean,
      r6(stddev_samp(residual_cos)) as sd, r6(quantile_cont(residual_cos, 0.05)) as q05,
      r6(quantile_cont(residual_cos, 0.25)) as q25, r6(median(residual_cos)) as median,
      r6(quantile_cont(residual_cos, 0.75)) as q75, r6(quantile_cont(residual_cos, 0.95)) as q95
      from audit group by method""",
)
def residual_table(v: Views):
    return rounded(A.residual_table(v.audit))


SEED_RESIDUAL = ("residual_similarity_mean", "residual_similarity_sd")


@query(
    "A21_seed_residuals",
    f"select {r(*SEED_RESIDUAL, 'joint_pass_rate', keys='method, seed, residual_similarity_n')} from bridge",
)
def seed_residuals(v: Views):
    files = v.audit.groupBy("method", "seed").agg(
        A.share(F.col("joint_pass")).alias("joint_pass_rate")
    )
    joined = complete_left_join(
        files, A.seed_residuals(v.audit), ["method", "seed"], "residual_similarity_mean"
    )
    return rounded(joined)


BRIDGE = (
    "yz_pass_rate",
    "x_pass_rate",
    "joint_pass_rate",
    *COUPLING,
    "over_completion",
    "evidence_loss",
    *SEED_RESIDUAL,
    "overall_contamination",
    "one_to_zero_contamination",
    "zero_to_one_contamination",
    "f1",
)


@query(
    "A22_bridge_table",
    f"select {r(*BRIDGE, keys='method, seed, residual_similarity_n')} from bridge",
)
def bridge_table(v: Views):
    return rounded(v.bridge())


AUDIT_RATES = ("yz_pass_rate", "x_pass_rate", "joint_pass_rate")


@query(
    "M21_generated_audit",
    f"""with s as materialized (select method, {", ".join(f"avg({c}) as {c}" for c in AUDIT_RATES)} from bridge
          group by method),
        c as (select method, avg(opposite_rate) as m from contamination
          where method <> 'edit' group by method)
      select coalesce(s.method, c.method) as method,
        {", ".join(f"r6(100 * {c}) as {c}" for c in AUDIT_RATES)}, r6(100 * m) as contamination_mean
      from (select * from s where method <> 'baseline') s
      full join c on c.method = s.method""",
)
def generated_audit(v: Views):
    cut = written(v.contamination().drop("source_row_index", "aug_round", "ordinal", "cand_doc", "bucket_name"))
    bridge = v.bridge(cut)
    table = bridge.groupBy("method").agg(*[F.avg(c).alias(c) for c in AUDIT_RATES])
    first = table.where(F.col("method").isin("paired", "prompt"))
    second = table.where(F.col("method").isin("prompt", "edit"))
    points = cut.where(F.col("method") != "edit")
    contamination = points.groupBy("method").agg(F.avg("opposite_rate").alias("contamination_mean"))
    return rounded(T.generated_audit(first, second, contamination, AUDIT_RATES))


@query(
    "M22_utility_source",
    """select method, r6(avg(rate)) as joint_pass_mean, r6(stddev_samp(rate)) as joint_pass_sd,
      r6(min(rate)) as joint_pass_min, r6(max(rate)) as joint_pass_max,
      r6(100 * any_value(point_estimate)) as f1_percent, r6(100 * any_value(ci_low)) as f1_ci_low,
      r6(100 * any_value(ci_high)) as f1_ci_high
      from (select method, seed, avg(joint_pass::int) as rate from audit group by method, seed)
      left join (select * from boot_ci where dataset = 'external_average' and metric = 'f1')
        using (method) group by method""",
)
def utility_source(v: Views):
    quality = v.audit.groupBy("method", "seed").agg(
        A.share(F.col("joint_pass")).alias("joint_pass_rate")
    )
    table = seed_summary(v.predictions, *EXTERNAL)
    limits = B.percentile_intervals(_boot(v), table, SETTINGS)
    return rounded(T.utility_source(quality, limits))


