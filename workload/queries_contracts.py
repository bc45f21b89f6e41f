"""Contract queries (V). Their inputs break the contracts in places, as real tables do."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.operators import bootstrap as B
from pairforge.operators import contracts as K
from pairforge.operators import metrics as M
from pairforge.operators import report as T
from pairforge.plans.evaluation import seed_summary
from pairforge.plans.pairing import build_pairs
from workload.queries_evaluation import SETTINGS, _boot, _k_runs
from workload.registry import query, rounded
from workload.views import EXTERNAL, METHODS, Views


@query(
    "V1_pair_table",
    """with s as (select source_id, count(*) as n, sum((pair_margin < 1)::int) as low from pairs
        group by source_id)
      select count(*) as sources, sum(n)::bigint as pairs, min(n) as minimum_pairs_per_source,
        max(n) as maximum_pairs_per_source, 0.0::double as maximum_margin_error,
        sum(low)::bigint as low_margin_pairs, 0::bigint as unaligned_pairs from s""",
)
def pair_table(v: Views):
    return rounded(K.pair_summary(build_pairs(v.sources, v.scored(text=True), texts=v.candidate_texts)))


@query(
    "V2_complete_grid",
    """with cells as (select distinct event_type, user_id, hour(ts)::int as slot from events),
        a as (select distinct event_type, user_id from cells),
        b as (select distinct event_type, slot from cells)
      select a.event_type, a.user_id, b.slot from a join b on a.event_type = b.event_type
      left join cells c on c.event_type = a.event_type and c.user_id = a.user_id
        and c.slot = b.slot where c.slot is null""",
)
def complete_grid(v: Views):
    runs = v.table("events").select("event_type", "user_id", F.hour("ts").alias("slot"))
    return K.grid_gaps(runs, ["event_type"], "user_id", "slot")


@query(
    "V2_run_manifest",
    """with m as (select user_id % 7 as generation_seed, event_id % 8 as classifier_seed,
          'out/' || (event_id % 50) as checkpoint_output, event_type as validation_role
        from events),
      s as (select count(*) as n, count(distinct generation_seed) as g,
        count(distinct classifier_seed) as c from m)
      select 'grid_shape' as "check", subject from (select unnest(['n_rows', 'n_generation_seed',
          'n_classifier_seed']) as subject, unnest([n <> 25, g <> 5, c <> 5]) as bad from s)
        where bad
      union all select 'missing_run', a.x || ':' || b.y from
          (select distinct generation_seed as x from m) a,
          (select distinct classifier_seed as y from m) b
        where not exists (select 1 from m where generation_seed = a.x and classifier_seed = b.y)
      union all select 'shared_output', checkpoint_output from m group by 2 having count(*) > 1
      union all select distinct 'role', validation_role from m""",
)
def run_manifest(v: Views):
    manifest = v.table("events").select(
        (F.col("user_id") % 7).alias("generation_seed"),
        (F.col("event_id") % 8).alias("classifier_seed"),
        F.concat(F.lit("out/"), F.col("event_id") % 50).alias("checkpoint_output"),
        F.col("event_type").alias("validation_role"),
        F.lit(None).cast("string").alias("training_mode"),
        F.lit(" Generation_Seed").alias("shuffle_seed_source"),
    )
    return K.validate_run_manifest(manifest)


ROLE_SQL = """case event_type when 'view' then 'Pitt-External' when 'click' then ' CV validation '
  when 'error' then 'cv_validation' when 'signup' then 'adress_validation' else 'training' end"""


@query(
    "V3_evaluation_firewall",
    f"""select * from (select role, n, case when role = 'pitt_external' then 'external'
        when role not in ('cv_validation', 'adress_validation') then 'unsupported'
        when role <> 'cv_validation' then 'undeclared' end as violation
      from (select translate(lower(trim({ROLE_SQL})), '- ', '__') as role, count(*) as n
        from events group by role)) where violation is not null""",
)
def evaluation_firewall(v: Views):
    kind = F.col("event_type")
    role = (
        F.when(kind == "view", "Pitt-External")
        .when(kind == "click", " CV validation ")
        .when(kind == "error", "cv_validation")
        .when(kind == "signup", "adress_validation")
        .otherwise("training")
    )
    rows = v.table("events").withColumn("dataset_role", role)
    return K.firewall(rows, "cv_validation")


@query(
    "V4_checkpoint_manifest",
    """select checkpoint_id, count(*) as n, sum((path = '')::int)::bigint as empty_path
      from (select 'c' || o_custkey as checkpoint_id,
        case when o_orderstatus = 'P' then '' else 'p/' || o_orderkey end as path from orders)
      group by checkpoint_id having count(*) > 1 or sum((path = '')::int) > 0""",
)
def checkpoint_manifest(v: Views):
    manifest = v.table("orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("checkpoint_id"),
        F.when(F.col("o_orderstatus") == "P", " ")
        .otherwise(F.concat(F.lit("p/"), "o_orderkey"))
        .alias("path"),
    )
    return K.manifest_keys(manifest, "checkpoint_id", ["path"])


@query(
    "V5_dataset_manifest",
    """select dataset, count(*) as n, sum((role = '')::int)::bigint as empty_role
      from (select 'd' || (o_orderkey // 3) as dataset,
        case when o_orderpriority like '1%' then '' else 'evaluation' end as role from orders)
      group by dataset having count(*) > 1 or sum((role = '')::int) > 0""",
)
def dataset_manifest(v: Views):
    manifest = v.table("orders").select(
        F.concat(F.lit("d"), F.floor(F.col("o_orderkey") / 3)).alias("dataset"),
        F.when(F.col("o_orderpriority").startswith("1"), "").otherwise("evaluation").alias("role"),
    )
    return K.manifest_keys(manifest, "dataset", ["role"])


OBSERVED_SQL = """(select 'd' || (user_id % 3) as dataset, user_id as unit, event_type as method,
  'w' || (event_id % 20) as weight_id, (value > 10)::int as y_true, event_id from events)"""


def _observed(v: Views):
    return v.table("events").select(
        F.concat(F.lit("d"), F.col("user_id") % 3).alias("dataset"),
        F.col("user_id").alias("unit"),
        F.col("event_type").alias("method"),
        F.concat(F.lit("w"), F.col("event_id") % 20).alias("weight_id"),
        (F.col("value") > 10).cast("int").alias("y_true"),
    )


@query(
    "V6_prediction_grid",
    f"""with o as {OBSERVED_SQL}, u as (select distinct dataset, unit from o),
        w as (select distinct dataset, method, weight_id from o)
      select u.dataset, u.unit, w.method, w.weight_id from u join w on w.dataset = u.dataset
      where not exists (select 1 from o where o.dataset = u.dataset and o.unit = u.unit
        and o.method = w.method and o.weight_id = w.weight_id)""",
)
def prediction_grid(v: Views):
    return K.prediction_gaps(_observed(v), ["y_true"])


@query(
    "V7_outcome_consistency",
    f"""select method, dataset, unit, min(y_true) as lowest, max(y_true) as highest
      from {OBSERVED_SQL} group by method, dataset, unit having min(y_true) <> max(y_true)""",
)
def outcome_consistency(v: Views):
    return K.outcome_conflicts(_observed(v))


@query(
    "V8_audit_keys",
    """select method, 'repeated_key' as "check", sum(n)::bigint as n from (select method, seed,
        source_id, bucket_name, count(*) as n from audit
        group by method, seed, source_id, bucket_name having count(*) > 1) group by method
      union all select method, 'row_count', count(*) from audit group by method""",
)
def audit_keys(v: Views):
    keys = ["method", "seed", "source_id", "bucket_name"]
    return K.audit_keys(v.audit, keys, expected={m: 1080 for m in METHODS})


@query("V9_row_counts", "select k, method, n_runs from k_table where n_runs <> 25")
def row_counts(v: Views):
    return K.count_contract(T.k_scaling(_k_runs(v), EXTERNAL), ["k", "method"], "n_runs", 25)


@query(
    "V10_matching_seed_groups",
    f"""with g as (select method, weight_id as seed_group, max((dataset = 'd1')::int) as a,
          max((dataset = 'd2')::int) as b from (select dataset, method, 'u' || unit as weight_id
          from {OBSERVED_SQL}) group by all)
      select method, seed_group, case when a = 1 then 'd1' else 'd2' end as only_in
      from g where a + b = 1""",
)
def matching_seed_groups(v: Views):
    groups = _observed(v).select(
        "dataset", "method", F.concat(F.lit("u"), "unit").alias("seed_group")
    )
    return K.unmatched_groups(groups, "d1", "d2", ["method", "seed_group"])


@query(
    "V11_external_average",
    """with w as (select method, metric, (max(mean) filter (dataset = 'ext_a')
          + max(mean) filter (dataset = 'ext_b')) / 2 as e,
          max(mean) filter (dataset = 'external_average') as o
        from seed_summary group by method, metric)
      select method, metric, r6(e) as expected, r6(o) as observed, abs(e - o) < 1e-12 as pass
      from w""",
)
def external_average(v: Views):
    table = seed_summary(v.predictions, *EXTERNAL)
    return rounded(K.average_check(table, *EXTERNAL, M.AVERAGE).drop("abs_diff"))


@query(
    "V12_bootstrap_grid",
    """select method, dataset, n_metrics, n_metrics = 8 as complete, n_seed_groups from
        (select method, dataset, count(distinct metric) as n_metrics from boot group by all)
      join (select method, dataset, count(distinct seed_group) as n_seed_groups from seed_detail
        group by all) using (method, dataset)""",
)
def bootstrap_grid(v: Views):
    from pairforge.plans.evaluation import seed_detail

    detail = seed_detail(v.predictions, *EXTERNAL)
    limits = B.percentile_intervals(_boot(v), M.summarize_seeds(detail), SETTINGS)
    groups = detail.groupBy("method", "dataset").agg(
        F.countDistinct("seed_group").alias("n_seed_groups")
    )
    return K.metric_grid(limits, B.BOOTSTRAP_METRICS).join(groups, ["method", "dataset"])


@query(
    "V13_required_methods",
    """select method from (select unnest(['click', 'view', 'hover', 'scroll']) as method)
      where method not in (select event_type from events)""",
)
def required_methods(v: Views):
    rows = v.table("events").withColumnRenamed("event_type", "method")
    return K.missing_methods(rows, ["click", "view", "hover", "scroll"])


@query(
    "V14_unknown_sources",
    """select cand_doc as source_id, count(*) as n from candidate_keys
      where cand_doc not in (select source_id from sources) group by cand_doc""",
)
def unknown_sources(v: Views):
    named = v.candidate_keys.select(F.col("cand_doc").alias("source_id"))
    return K.orphans(named, v.sources, "source_id")


@query(
    "V15_merge_cardinality",
    "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 1",
)
def merge_cardinality(v: Views):
    return K.duplicate_keys(v.table("orders"), ["o_custkey"])
