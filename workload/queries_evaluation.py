"""Evaluation queries: metrics (M), ranks (W), bootstrap and effects (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.operators import bootstrap as B
from pairforge.operators import effects as E
from pairforge.operators import metrics as M
from pairforge.operators import report as T
from pairforge.plans.evaluation import seed_detail, seed_summary
from pairforge.settings import BootstrapSettings
from workload.registry import query, rounded
from workload.sqlmetrics import BOOT, EFFECT_REPLICATES, METRICS, REPLICATES
from workload.views import EXTERNAL, METHODS, Views, h

SETTINGS = BootstrapSettings(replicates=REPLICATES)
EFFECT_SETTINGS = BootstrapSettings(replicates=EFFECT_REPLICATES)
COHORTS = ("val", *EXTERNAL)


def r(*names: str, keys: str) -> str:
    """SELECT list with keys first and rounded values after."""
    return ", ".join([keys, *[f"r6({n}) as {n}" for n in names]])


WEIGHT_KEYS = "method, dataset, weight_id"


@query("M1_confusion_metrics", f"select {r(*METRICS[:6], keys=WEIGHT_KEYS)} from weight_metrics")
def confusion_metrics(v: Views):
    return rounded(M.weight_metrics(v.predictions).select(*M.WEIGHT, *METRICS[:6]))


@query(
    "M2_zero_filled_metrics",
    """select method, dataset, weight_id, r6(coalesce(accuracy, 0)) as accuracy,
      r6(coalesce(precision, 0)) as precision, r6(coalesce(sensitivity, 0)) as recall,
      r6(coalesce(f1, 0)) as f1 from weight_metrics""",
)
def zero_filled(v: Views):
    return rounded(M.zero_filled(M.weight_metrics(v.predictions)))


@query("M3_brier_score", f"select {r('brier', keys=WEIGHT_KEYS)} from weight_metrics")
def brier(v: Views):
    return rounded(M.weight_metrics(v.predictions).select(*M.WEIGHT, "brier"))


@query("M4_calibration_error", f"select {r('ece', keys=WEIGHT_KEYS)} from ece_metrics")
def calibration(v: Views):
    return rounded(M.calibration_error(M.order_statistics(v.predictions)))


@query("M5_auroc", f"select {r('auroc', keys=WEIGHT_KEYS)} from rank_metrics")
def auroc(v: Views):
    return rounded(M.ranking_metrics(M.order_statistics(v.predictions)).drop("auprc"))


@query(
    "M5_auroc_mid_ranks",
    f"""select {WEIGHT_KEYS}, r6((sum(rk) filter (y_true = 1)
        - sum(y_true) * (sum(y_true) + 1) / 2.0) / (sum(y_true) * (count(*) - sum(y_true))))
        as auroc
      from (select *, rank() over (partition by {WEIGHT_KEYS} order by y_prob)
          + (count(*) over (partition by {WEIGHT_KEYS}, y_prob) - 1) / 2.0 as rk from predictions)
      group by {WEIGHT_KEYS}""",
)
def auroc_mid_ranks(v: Views):
    return rounded(M.auroc_mid_ranks(v.predictions))


@query("M6_average_precision", f"select {r('auprc', keys=WEIGHT_KEYS)} from rank_metrics")
def average_precision(v: Views):
    return rounded(M.ranking_metrics(M.order_statistics(v.predictions)).drop("auroc"))


@query("M7_seed_groups", f"select {WEIGHT_KEYS}, seed_group, group_basis from seed_groups")
def seed_groups(v: Views):
    return M.seed_groups(v.predictions)


SEED_KEYS = "method, dataset, seed_group, group_basis"


@query("M8_seed_level_means", f"select {r(*METRICS, keys=SEED_KEYS)} from seed_level")
def seed_level(v: Views):
    return rounded(M.seed_level(M.all_metrics(v.predictions), M.seed_groups(v.predictions)))


@query("M9_external_average", f"select {r(*METRICS, keys=SEED_KEYS)} from external_rows")
def external_average(v: Views):
    return rounded(seed_detail(v.predictions, *EXTERNAL).where(F.col("dataset") == M.AVERAGE))


@query(
    "M10_seed_summary",
    f"""select {r('mean', 'sd', keys='method, dataset, group_basis, metric')}, n_groups
      from seed_summary""",
)
def summary(v: Views):
    return rounded(seed_summary(v.predictions, *EXTERNAL))


@query(
    "M11_family_lock",
    """select method, f.family, f.method_group from (select method,
        min({'family': family, 'method_group': method_group}) as f from predictions
        group by method)""",
)
def family_lock(v: Views):
    return M.family_lock(v.repeated_predictions)


@query(
    "M12_best_cells",
    """select method, dataset, metric from (select *,
        max(mean) over (partition by dataset, metric) as top from seed_summary)
      where abs(mean - top) <= 1e-8 + 1e-5 * abs(top)""",
)
def best_cells(v: Views):
    return T.best_cells(seed_summary(v.predictions, *EXTERNAL))


@query(
    "B1_resample_plan",
    "select replicate::int as replicate, dataset, unit, y_true, mult from plan",
)
def resample_plan(v: Views):
    return B.resample_plan(v.predictions, SETTINGS)


@query(
    "B2_replicate_metrics",
    "select method, dataset, replicate::int as replicate, metric, r6(value) as value from boot_cohort",
)
def replicate_metrics(v: Views):
    return rounded(B.replicate_metrics(v.predictions, SETTINGS))


def _boot(v: Views):
    return B.add_external(B.replicate_metrics(v.predictions, SETTINGS), EXTERNAL)


@query(
    "B3_external_replicates",
    """select method, dataset, replicate::int as replicate, metric, r6(value) as value from boot
      where dataset = 'external_average'""",
)
def external_replicates(v: Views):
    # Multiplicities depend on their own cohort alone, so the others need no replicates.
    outside = B.replicate_metrics(v.predictions.where(F.col("dataset").isin(*EXTERNAL)), SETTINGS)
    return rounded(B.add_external(outside, EXTERNAL).where(F.col("dataset") == M.AVERAGE))


CI = ("bootstrap_mean", "bootstrap_sd", "ci_low", "ci_high", "point_estimate")


@query(
    "B4_percentile_intervals",
    f"select {r(*CI, keys='method, dataset, metric')}, n_bootstrap from boot_ci",
)
def intervals(v: Views):
    return rounded(
        B.percentile_intervals(_boot(v), seed_summary(v.predictions, *EXTERNAL), SETTINGS)
    )


DELTA = ("bootstrap_mean_delta", "bootstrap_sd_delta", "ci_low", "ci_high", "p_two_sided", "observed_delta")


@query(
    "B5_paired_contrasts",
    f"""select {r(*DELTA, keys='comparator, dataset, metric')}, target_method, n_bootstrap
      from boot_contrasts""",
)
def contrasts(v: Views):
    return rounded(
        B.contrasts(_boot(v), seed_summary(v.predictions, *EXTERNAL), "paired", SETTINGS)
    )


def _units(v: Views):
    cover = v.coverage.select(
        F.col("text_id").alias("unit"), F.col("breadth").alias("y"), F.col("depth").alias("z")
    )
    return v.sources.select(
        F.col("lang").alias("dataset"), F.col("source_id").alias("unit"), F.col("label").alias("y_true")
    ).join(cover, "unit")


def _effect_values(v: Views):
    joint = E.joint_index(_units(v), "dataset", "y", "z")
    return joint.unpivot(["dataset", "unit", "y_true"], ["y", "z", "joint_index"], "metric", "value")


def _gappy_values(v: Views):
    """The values, a seventh of one metric missing."""
    gap = (F.col("metric") == "y") & (F.col("unit") % 7 == 3)
    return _effect_values(v).withColumn("value", F.when(~gap, F.col("value")))


@query(
    "W1_joint_index",
    f"select {r('y_percentile', 'z_percentile', 'joint_index', keys='dataset, unit')} from joint",
)
def joint_index(v: Views):
    joint = E.joint_index(_units(v), "dataset", "y", "z")
    return rounded(joint.select("dataset", "unit", "y_percentile", "z_percentile", "joint_index"))


@query(
    "B6_mean_difference",
    """select dataset, metric, r6(mean_difference) as mean_difference,
      r6(mean_difference_ci_low) as mean_difference_ci_low,
      r6(mean_difference_ci_high) as mean_difference_ci_high from effects""",
)
def mean_difference(v: Views):
    table = B.effect_table(_gappy_values(v), EFFECT_SETTINGS)
    names = [f"mean_difference{s}" for s in ("", "_ci_low", "_ci_high")]
    return rounded(table.select("dataset", "metric", *names))


@query(
    "B7_standardized_difference",
    """select dataset, metric, r6(standardized_difference) as standardized_difference,
      r6(standardized_difference_ci_low) as standardized_difference_ci_low,
      r6(standardized_difference_ci_high) as standardized_difference_ci_high from effects""",
)
def standardized_difference(v: Views):
    table = B.effect_table(_gappy_values(v), EFFECT_SETTINGS)
    names = [f"standardized_difference{s}" for s in ("", "_ci_low", "_ci_high")]
    return rounded(table.select("dataset", "metric", *names))


EFFECTS = [
    f"{e}{s}"
    for e in ("mean_difference", "standardized_difference")
    for s in ("", "_ci_low", "_ci_high")
] + ["mean_0", "mean_1"]


@query("B8_effect_table", f"select {r(*EFFECTS, keys='dataset, metric, n_0, n_1')} from effects")
def effect_table(v: Views):
    return rounded(B.effect_table(_gappy_values(v), EFFECT_SETTINGS))


@query(
    "B9_rank_test",
    f"select {r('u', 'rank_biserial', 'z', keys='dataset, metric, n_0, n_1')} from rank_tests",
)
def rank_test(v: Views):
    return rounded(E.rank_test(_effect_values(v)).drop("p_value"))


@query(
    "B10_false_discovery",
    """with tests as (select user_id, abs(avg(value) filter (event_type in ('error', 'signup'))
            - avg(value)) / 100 as p_value from events group by user_id),
        steps as (select *, p_value * count(*) over () / row_number() over (
            order by p_value, user_id) as step from tests)
      select user_id, r6(p_value) as p_value, r6(least(1.0, min(step) over (
        order by p_value, user_id rows between current row and unbounded following))) as q_value
      from steps""",
)
def false_discovery(v: Views):
    chosen = F.avg(F.when(F.col("event_type").isin("error", "signup"), F.col("value")))
    tests = v.table("events").groupBy("user_id").agg(
        (F.abs(chosen - F.avg("value")) / 100).alias("p_value")
    )
    return rounded(E.false_discovery(tests, ["user_id"]))


@query(
    "B11_describe_groups",
    """select dataset, metric, y_true, count(value) as n, r6(avg(value)) as mean,
      r6(stddev_samp(value)) as sd, r6(quantile_cont(value, 0.25)) as q1,
      r6(median(value)) as median, r6(quantile_cont(value, 0.75)) as q3
      from effect_values group by dataset, metric, y_true""",
)
def describe(v: Views):
    return rounded(E.describe(_effect_values(v)))


@query(
    "B12_covariance_ellipse",
    """with m as (select dataset, y_true, count(*) as n, avg(y) as cx, avg(z) as cy,
          var_samp(y) as a, var_samp(z) as b, covar_samp(y, z) as c
        from effect_units group by dataset, y_true having count(*) >= 5),
      e as (select *, (a + b) / 2 as half, sqrt(((a - b) / 2) * ((a - b) / 2) + c * c) as gap
        from m)
      select dataset, y_true, n, r6(cx) as center_x, r6(cy) as center_y,
        r6(2 * sqrt(greatest(half + gap, 0))) as width,
        r6(2 * sqrt(greatest(half - gap, 0))) as height,
        r6(degrees(atan2(2 * c, a - b) / 2)) as angle from e""",
)
def covariance_ellipse(v: Views):
    return rounded(E.covariance_ellipse(_units(v), ["dataset", "y_true"], "y", "z"))


@query(
    "M13_main_table",
    """with best as (select method, dataset, metric from (select *,
        max(mean) over (partition by dataset, metric) as top from seed_summary)
      where abs(mean - top) <= 1e-8 + 1e-5 * abs(top))
      select s.method, s.dataset, s.metric, r6(s.mean) as mean, r6(s.sd) as sd,
        r6(b.ci_low) as ci_low, r6(b.ci_high) as ci_high, t.method is not null as is_best
      from seed_summary s join boot_ci b using (method, dataset, metric)
      left join best t using (method, dataset, metric)
      where s.metric in ('accuracy', 'f1')""",
)
def main_table(v: Views):
    table = seed_summary(v.predictions, *EXTERNAL)
    return rounded(T.main_table(table, B.percentile_intervals(_boot(v), table, SETTINGS)))


@query(
    "M14_ablation_table",
    """select 'cell' as part, s.method, s.dataset, s.metric, r6(s.mean) as value, r6(s.sd) as sd,
        r6(b.ci_low) as ci_low, r6(b.ci_high) as ci_high
      from seed_summary s join boot_ci b using (method, dataset, metric)
      where s.metric = 'f1' or (s.dataset = 'external_average' and s.metric = 'accuracy')
      union all select 'contrast', comparator, dataset, metric, r6(observed_delta), null,
        r6(ci_low), r6(ci_high) from boot_contrasts
      where dataset = 'external_average' and metric = 'f1'""",
)
def ablation_table(v: Views):
    table, boot = seed_summary(v.predictions, *EXTERNAL), _boot(v)
    limits = B.percentile_intervals(boot, table, SETTINGS)
    return rounded(T.ablation_table(table, limits, B.contrasts(boot, table, "paired", SETTINGS)))


OPERATING = ("sensitivity", "specificity", "brier", "ece")


@query(
    "M15_operating_table",
    "select method, dataset, "
    + ", ".join(
        f"r6(max(mean) filter (metric = '{m}')) as {m}_mean, r6(max(sd) filter (metric = '{m}')) as {m}_sd"
        for m in OPERATING
    )
    + """, any_value(position)::int as position from seed_summary join (select unnest(['paired',
      'prompt', 'edit', 'baseline']) as method, unnest([0, 1, 2, 3]) as position) using (method)
      group by method, dataset""",
)
def operating_table(v: Views):
    order = T.order_table(v.spark, METHODS[::-1], "method", "position")
    return rounded(T.pivot_metrics(seed_summary(v.predictions, *EXTERNAL), OPERATING, order))


def _k_runs(v: Views):
    return v.predictions.groupBy(
        (F.col("unit") % 10 + 1).cast("int").alias("k"),
        "method",
        "dataset",
        F.col("weight_id").alias("run"),
    ).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("score"))


@query(
    "M16_k_scaling_table",
    "select k, "
    + ", ".join(
        f"r6(max(score_mean) filter (method = '{m}')) as {m}_mean, "
        f"r6(max(score_sd) filter (method = '{m}')) as {m}_sd"
        for m in METHODS
    )
    + " from k_table group by k",
)
def k_scaling_table(v: Views):
    return rounded(T.k_scaling_table(T.k_scaling(_k_runs(v), EXTERNAL), METHODS))


@query(
    "M17_k_scaling_delta",
    """select k, dataset, r6(100 * (max(score) filter (method = 'paired')
        - max(score) filter (method <> 'paired'))) as delta
      from (select k, dataset, method, avg(score) as score from k_runs
        group by k, dataset, method) group by k, dataset""",
)
def k_scaling_delta(v: Views):
    return rounded(T.k_scaling_delta(_k_runs(v), "paired"))


@query(
    "M18_performance_source",
    """select method, dataset, metric, r6(100 * point_estimate) as point_percent,
        r6(100 * ci_low) as ci_low_percent, r6(100 * ci_high) as ci_high_percent,
        'average_with_interval' as point_role, upper(method) as label
      from boot_ci where dataset = 'external_average' and metric in ('f1', 'accuracy', 'auroc')
      union all select method, dataset, metric, r6(100 * mean), null, null, 'cohort_mean',
        upper(method)
      from seed_summary where dataset <> 'external_average'
        and metric in ('f1', 'accuracy', 'auroc')""",
)
def performance_source(v: Views):
    table = seed_summary(v.predictions, *EXTERNAL)
    limits = B.percentile_intervals(_boot(v), table, SETTINGS)
    names = T.order_table(v.spark, METHODS, "method", "position").withColumn(
        "label", F.upper("method")
    )
    return rounded(
        T.performance_source(limits, table, names, ("f1", "accuracy", "auroc"), COHORTS)
    )


def _traits(v: Views):
    event = F.col("event_id")
    return v.table("events").select(
        F.element_at(
            F.array(*[F.lit(c) for c in COHORTS]), (F.col("user_id") % 3 + 1).cast("int")
        ).alias("dataset"),
        event.alias("unit"),
        F.col("event_type").isin("error", "signup").cast("int").alias("y_true"),
        (h("age", event) % 50 + 40).cast("int").alias("age"),
        F.when(h("sex", event) % 2 == 0, "f").otherwise("m").alias("sex"),
        F.col("value").alias("length"),
    )


@query(
    "M19_subgroup_support",
    """select dataset, subgroup_type, subgroup, count(*) as n, count(*) filter (y_true = 0) as n_0,
      count(*) filter (y_true = 1) as n_1 from subgroups group by all""",
)
def subgroup_support(v: Views):
    return T.subgroup_support(T.subgroup_rows(_traits(v)))


SUBGROUP = ("balanced_accuracy", "f1", "sensitivity", "specificity")


def _subgroup_sql() -> str:
    from workload.sqlmetrics import COUNTS, RATES

    keys = "method, dataset, subgroup_type, subgroup"
    return f"""select {keys}, {", ".join(f"r6(avg({m})) as {m}" for m in SUBGROUP)}
      from (select {keys}, {RATES} from (select {keys}, weight_id, {COUNTS}
        from (select p.*, g.subgroup_type, g.subgroup from predictions p
          join subgroups g on g.dataset = p.dataset and g.unit = p.unit)
        group by {keys}, weight_id)) group by {keys}"""


@query("M19_subgroup_metrics", _subgroup_sql())
def subgroup_metrics(v: Views):
    return rounded(T.subgroup_metrics(T.subgroup_rows(_traits(v)), v.predictions))


@query(
    "M20_tertile_cells",
    """with cuts as (select dataset, quantile_cont(y, 1/3::double) as y1,
          quantile_cont(y, 2/3::double) as y2, quantile_cont(z, 1/3::double) as z1,
          quantile_cont(z, 2/3::double) as z2 from effect_units group by dataset)
      select dataset, y_cell, z_cell, count(*) as n, sum(y_true)::bigint as n_1,
        case when count(*) < 10 then 'exploratory' else 'evaluated' end as status
      from (select dataset, y_true,
          case when y <= y1 then 'low' when y <= y2 then 'mid' else 'high' end as y_cell,
          case when z <= z1 then 'low' when z <= z2 then 'mid' else 'high' end as z_cell
        from effect_units join cuts using (dataset))
      group by dataset, y_cell, z_cell having count(*) >= 5""",
)
def tertile_cells(v: Views):
    return T.tertile_cells(_units(v))


@query(
    "W5_first_predictions",
    "select method, dataset, weight_id, unit, y_true, y_pred, r6(y_prob) as y_prob from predictions",
)
def first_predictions(v: Views):
    kept = M.keep_first(v.repeated_predictions)
    return rounded(kept.select(*M.WEIGHT, "unit", "y_true", "y_pred", "y_prob"))
