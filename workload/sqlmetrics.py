"""Check SQL of the evaluation and bootstrap views."""

from __future__ import annotations

from pairforge.functions.resampling import DIGITS, MIX, SPREAD, TREE

REPLICATES = 100  # of every weight's metrics
EFFECT_REPLICATES = 1000  # of group differences
SEED = 20260621
METRICS = (
    "accuracy balanced_accuracy precision sensitivity specificity f1 auroc auprc brier ece".split()
)
BOOT = METRICS[:8]

_RATES = """(tp + tn) / nullif(tp + tn + fp + fn, 0) as accuracy,
  (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as balanced_accuracy,
  tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as sensitivity,
  tn / nullif(tn + fp, 0) as specificity, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1"""


def _counts(weight: str = "1") -> str:
    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return ", ".join(
        f"sum(case when y_true = {y} and y_pred = {p} then {weight} else 0 end)::double as {n}"
        for n, (y, p) in cells.items()
    )


def _mixed(x: str) -> str:
    """The finishing step of a 32-bit hash; one-element lists bind what is read twice."""
    steps = [f"(xor(a, a >> {shift})::hugeint * {factor} % 4294967296)::bigint" for shift, factor in zip((16, 13), MIX)]
    inner = f"list_transform(list_transform([{x}], lambda a: {steps[0]}), lambda a: {steps[1]})"
    return f"list_transform({inner}, lambda a: xor(a, a >> 16))[1]"


def _heads(node: str, kind: str, tosses: str) -> str:
    """Heads among coins, 32 to a hash, as ``functions.resampling.heads`` counts them."""
    name = f"({node} * {SPREAD[0]} + ({kind}) * {SPREAD[1]} + w * {SPREAD[2]}) % 4294967296"
    bits = _mixed(f"xor(base, {_mixed(name)})")
    mask = f"((1::bigint << least(32, {tosses} - 32 * w)::int) - 1)"
    return f"coalesce(list_sum(list_transform(range(0, ({tosses} + 31) // 32), lambda w: bit_count({bits} & {mask}))), 0)::bigint"


def _multiplicities(prefix: str, strata: str, key: str, replicates: int) -> dict[str, str]:
    """Views of the tree over each stratum of ``strata``: blocks, halves, and places that are drawn."""
    return {
        f"{prefix}_blocks": f"""
        select {key}, y_true, replicate, h('{SEED}:' || replicate || ':' || name || ':' || y_true) as base,
            0::bigint as start, size as rest, floor(log2(size))::bigint as power, size as c,
            0::bigint as digit, size as open, 0::bigint as inside
        from (select distinct {key}, name, y_true, size::bigint as size from {strata}), range(0, {replicates}) r(replicate)
        union all
        select {key}, y_true, replicate, base, case when more then start else start + (1::bigint << power::int) end,
            case when more then rest else left_size end,
            case when more then power else floor(log2(left_size))::bigint end,
            case when more then c else c - inside end, case when more then digit + 1 else 0 end,
            case when not more then c - inside when bit then ones else open - ones end,
            case when not more then 0 when bit then inside + open - ones else inside end
        from (select *, rest - (1::bigint << power::int) as left_size, digit < {DIGITS} and open > 0 as more,
              ((((1::bigint << (power + {DIGITS})::int) // rest) >> ({DIGITS - 1} - digit)::int) & 1) = 1 as bit,
              case when digit < {DIGITS} and open > 0 then {_heads("digit", "power", "open")} else 0 end as ones
            from {prefix}_blocks where rest > (1::bigint << power::int))""",
        f"{prefix}_tree": f"""
        select {key}, y_true, replicate, base, start, power, 1::bigint as node,
            case when rest = (1::bigint << power::int) then c else inside end as c
        from {prefix}_blocks where (rest = (1::bigint << power::int) or digit = {DIGITS} or open = 0)
          and case when rest = (1::bigint << power::int) then c else inside end > 0
        union all
        select * from (select {key}, y_true, replicate, base, start, power, 2 * node + side as node,
            case side when 0 then ones else c - ones end as c
          from (select *, unnest([0, 1]) as side from (select *, {_heads("node", f"{TREE} + power", "c")} as ones
            from {prefix}_tree where node < (1::bigint << power::int)))) where c > 0""",
        f"{prefix}_drawn": f"""
        select {key}, y_true, replicate, start + node - (1::bigint << power::int) as place, c as mult
        from {prefix}_tree where node >= (1::bigint << power::int)""",
    }


COUNTS, RATES = _counts(), _RATES
_AVG = ", ".join(f"avg({m}) as {m}" for m in METRICS)
_LIST = ", ".join(METRICS)
_W = "method, dataset, weight_id"

EVALUATION_VIEWS = {
    "weight_metrics": f"""select {_W}, brier, {_RATES} from (select {_W}, {COUNTS},
          avg((y_prob - y_true) * (y_prob - y_true)) as brier from predictions group by {_W})""",
    "placed": f"""select *, row_number() over o - 1 as n_before, count(*) over g as n_all,
          coalesce(sum(y_true) over (o rows between unbounded preceding and 1 preceding), 0)
            as pos_before, sum(y_true) over g as pos_all, ntile(10) over o as bin
        from predictions window o as (partition by {_W} order by y_prob, unit),
          g as (partition by {_W})""",
    "rank_metrics": f"""select {_W}, (rs - p * (p + 1) / 2) / nullif(p * (n - p), 0) as auroc,
          ps / nullif(p, 0) as auprc
        from (select {_W}, sum(case when y_true = 1 then n_before + 1 end)::double as rs,
            sum(case when y_true = 1 then (pos_all - pos_before)::double / (n_all - n_before) end)
              as ps, max(pos_all)::double as p, max(n_all)::double as n
          from placed group by {_W})""",
    "ece_metrics": f"""select {_W}, sum(c / n::double * gap) as ece
        from (select {_W}, bin, count(*) as c, max(n_all) as n,
            abs(avg(y_true) - avg(y_prob)) as gap from placed group by {_W}, bin)
        group by {_W}""",
    "all_metrics": f"""select {_W}, {_LIST} from weight_metrics
        join rank_metrics using ({_W}) join ece_metrics using ({_W})""",
    "seed_groups": f"""select {_W},
          case when gen then 'aug_seed_' || aug_seed
            when train_seed is not null then 'train_seed_' || train_seed
            else 'weight_' || weight_id end as seed_group,
          case when gen then 'generation_seed' else 'classifier_seed' end as group_basis
        from (select *, bool_or(aug_seed is not null) over (partition by method, dataset) as gen
          from (select {_W}, max(aug_seed) as aug_seed, max(train_seed) as train_seed
            from predictions group by {_W}))""",
    "seed_level": f"""select method, dataset, seed_group, group_basis, {_AVG}
        from all_metrics join seed_groups using ({_W})
        group by method, dataset, seed_group, group_basis""",
    "external_rows": f"""select method, 'external_average' as dataset, seed_group, group_basis,
          {", ".join(f"(a.{m} + b.{m}) / 2 as {m}" for m in METRICS)}
        from (select * from seed_level where dataset = 'ext_a') a
        join (select * from seed_level where dataset = 'ext_b') b
          using (method, seed_group, group_basis)""",
    "seed_detail": f"""select method, dataset, seed_group, group_basis, {_LIST} from seed_level
        union all select method, dataset, seed_group, group_basis, {_LIST} from external_rows""",
    "seed_long": f"""select * from seed_detail unpivot include nulls (value for metric in ({_LIST}))""",
    "seed_summary": """select method, dataset, group_basis, metric, avg(value) as mean,
          stddev_samp(value) as sd, count(value) as n_groups
        from seed_long group by method, dataset, group_basis, metric""",
    "strata": """select dataset, dataset as name, unit, y_true,
          row_number() over (partition by dataset, y_true order by unit) - 1 as place,
          count(*) over (partition by dataset, y_true) as size
        from (select distinct dataset, unit, y_true from predictions)""",
    **_multiplicities("plan", "strata", "dataset", REPLICATES),
    "plan": """select replicate, dataset, unit, y_true, mult
        from plan_drawn join strata using (dataset, y_true, place)""",
    "boot_rows": f"""select p.{_W.replace(", ", ", p.")}, replicate, p.y_true, p.y_pred, mult,
          sum(mult) over o - mult as wb, sum(mult * p.y_true) over o - mult * p.y_true as pb,
          sum(mult) over g as wa, sum(mult * p.y_true) over g as pa
        from predictions p join plan using (dataset, unit)
        window o as (partition by method, dataset, weight_id, replicate order by y_prob, unit
            rows between unbounded preceding and current row),
          g as (partition by method, dataset, weight_id, replicate)""",
    "boot_weight": f"""select {_W}, replicate, {_RATES},
          (rs - (tp + fn) * (tp + fn + 1) / 2) / nullif((tp + fn) * (tn + fp), 0) as auroc,
          ps / nullif(tp + fn, 0) as auprc
        from (select {_W}, replicate, {_counts("mult")},
            sum(case when y_true = 1 then mult * wb + mult * (mult + 1) / 2.0 end)::double as rs,
            sum(case when y_true = 1 then list_sum(list_transform(range(1, mult + 1), lambda j:
              (pa - pb - mult + j)::double / (wa - wb - mult + j)::double)) end)::double as ps
          from boot_rows group by {_W}, replicate)""",
    "boot_cohort": f"""select method, dataset, replicate, metric, value from (
          select method, dataset, replicate, {", ".join(f"avg({m}) as {m}" for m in BOOT)}
          from boot_weight group by method, dataset, replicate)
        unpivot include nulls (value for metric in ({", ".join(BOOT)}))""",
    "boot": """select method, dataset, replicate, metric, value from boot_cohort union all
        select method, 'external_average', replicate, metric,
          case when count(value) = 2 then avg(value) end
        from boot_cohort where dataset in ('ext_a', 'ext_b') group by method, replicate, metric""",
    "boot_ci": f"""select method, dataset, metric, avg(b.value) as bootstrap_mean,
          stddev_samp(b.value) as bootstrap_sd, quantile_cont(b.value, 0.025) as ci_low,
          quantile_cont(b.value, 0.975) as ci_high, any_value(s.mean) as point_estimate,
          {REPLICATES} as n_bootstrap
        from boot b join seed_summary s using (method, dataset, metric)
        group by method, dataset, metric""",
    "boot_delta": """select o.method as comparator, o.dataset, o.metric, o.replicate,
          case when abs(t.value - o.value) <= 1e-12 then 0.0::double else t.value - o.value end as value
        from boot o join boot t on t.method = 'paired' and t.dataset = o.dataset
          and t.metric = o.metric and t.replicate = o.replicate where o.method <> 'paired'""",
    "boot_contrasts": f"""select comparator, d.dataset, d.metric, avg(value) as bootstrap_mean_delta,
          stddev_samp(value) as bootstrap_sd_delta, quantile_cont(value, 0.025) as ci_low,
          quantile_cont(value, 0.975) as ci_high,
          least(1.0, 2.0 * least((count(*) filter (value <= 0) + 1)::double / (count(value) + 1),
            (count(*) filter (value >= 0) + 1)::double / (count(value) + 1))) as p_two_sided,
          any_value(t.mean - s.mean) as observed_delta, 'paired' as target_method,
          {REPLICATES} as n_bootstrap
        from boot_delta d join seed_summary s on s.method = comparator and s.dataset = d.dataset
          and s.metric = d.metric
        join seed_summary t on t.method = 'paired' and t.dataset = d.dataset
          and t.metric = d.metric
        group by comparator, d.dataset, d.metric""",
    "effect_units": """select s.lang as dataset, s.source_id as unit, s.label as y_true,
          c.breadth as y, c.depth as z
        from sources s join coverage c on c.text_id = s.source_id""",
    "joint": """select *, sqrt(y_percentile * z_percentile) as joint_index from (select *,
          (rank() over (partition by dataset order by y)
            + (count(*) over (partition by dataset, y) - 1) / 2.0)
            / (count(*) over (partition by dataset) + 1) as y_percentile,
          (rank() over (partition by dataset order by z)
            + (count(*) over (partition by dataset, z) - 1) / 2.0)
            / (count(*) over (partition by dataset) + 1) as z_percentile
        from effect_units)""",
    "effect_values": """select dataset, unit, y_true, metric, value
        from (select dataset, unit, y_true, y, z, joint_index from joint)
        unpivot (value for metric in (y, z, joint_index))""",
    "effect_known": """select dataset, unit, y_true, metric, value from effect_values
        where not (metric = 'y' and unit % 7 = 3)""",
    "effect_strata": """select dataset, metric, dataset || ':' || metric as name, unit, y_true, value,
          row_number() over (partition by dataset, metric, y_true order by unit, value) - 1 as place,
          count(*) over (partition by dataset, metric, y_true) as size from effect_known""",
    **_multiplicities("effect", "effect_strata", "dataset, metric", EFFECT_REPLICATES),
    "effect_moments": """select dataset, metric, y_true, replicate, sum(mult) as n,
          sum(mult * value) as s, sum(mult * value * value) as q
        from effect_strata join effect_drawn using (dataset, metric, y_true, place)
        group by dataset, metric, y_true, replicate union all
        select dataset, metric, y_true, null, count(*), sum(value), sum(value * value)
        from effect_known group by dataset, metric, y_true""",
    "effect_diffs": """select dataset, metric, replicate, m0 - m1 as mean_difference,
          (m0 - m1) / case when pooled > 1e-9 then pooled end as standardized_difference,
          n0::bigint as n_0, n1::bigint as n_1, m0 as mean_0, m1 as mean_1
        from (select *, sqrt(greatest(q0 - n0 * m0 * m0 + q1 - n1 * m1 * m1, 0)
            / nullif(n0 + n1 - 2, 0)) as pooled
          from (select *, s0 / n0 as m0, s1 / n1 as m1 from (
            select dataset, metric, replicate,
              max(n::double) filter (y_true = 0) as n0, max(n::double) filter (y_true = 1) as n1,
              max(s) filter (y_true = 0) as s0, max(s) filter (y_true = 1) as s1,
              max(q) filter (y_true = 0) as q0, max(q) filter (y_true = 1) as q1
            from effect_moments group by dataset, metric, replicate)))""",
    "effects": """select o.*, lo.* exclude (dataset, metric) from
          (select * exclude (replicate) from effect_diffs where replicate is null) o
        join (select dataset, metric,
            quantile_cont(mean_difference, 0.025) as mean_difference_ci_low,
            quantile_cont(mean_difference, 0.975) as mean_difference_ci_high,
            quantile_cont(standardized_difference, 0.025) as standardized_difference_ci_low,
            quantile_cont(standardized_difference, 0.975) as standardized_difference_ci_high
          from effect_diffs where replicate is not null group by dataset, metric) lo
          on lo.dataset = o.dataset and lo.metric = o.metric""",
    "rank_tests": """select dataset, metric, n0::bigint as n_0, n1::bigint as n_1, u,
          2 * u / (n0 * n1) - 1 as rank_biserial,
          greatest(0.0, (abs(u - n0 * n1 / 2) - 0.5)
            / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1))))) as z
        from (select dataset, metric, n0, n1, ties, r0 - n0 * (n0 + 1) / 2 as u
          from (select dataset, metric, sum(r) filter (y_true = 0) as r0,
              (count(*) filter (y_true = 0))::double as n0,
              (count(*) filter (y_true = 1))::double as n1, sum(c * c - 1)::double as ties
            from (select *, rank() over (partition by dataset, metric order by value)
                + (count(*) over (partition by dataset, metric, value) - 1) / 2.0 as r,
                count(*) over (partition by dataset, metric, value) as c from effect_values)
            group by dataset, metric))""",
    "k_runs": f"""select (unit % 10 + 1)::int as k, method, dataset, weight_id as run,
          avg((y_true = y_pred)::int) as score from predictions
        group by k, method, dataset, weight_id""",
    "k_table": """select k, method, avg(score) as score_mean, stddev_samp(score) as score_sd,
          count(score) as n_runs
        from (select k, method, run, avg(score) as score from k_runs
          where dataset in ('ext_a', 'ext_b') group by k, method, run) group by k, method""",
    "unit_traits": """select ['val', 'ext_a', 'ext_b'][user_id % 3 + 1] as dataset,
          event_id as unit, (event_type in ('error', 'signup'))::int as y_true,
          (h('age:' || event_id) % 50 + 40)::int as age,
          case when h('sex:' || event_id) % 2 = 0 then 'f' else 'm' end as sex, value as length
        from events""",
    "subgroups": """select dataset, unit, y_true, k.t as subgroup_type, k.s as subgroup from (
          select dataset, unit, y_true, unnest([{'t': 'overall', 's': 'all'},
            {'t': 'sex', 's': sex},
            {'t': 'age_group', 's': case when age < 65 then '<65' when age < 75 then '65-74'
              else '>=75' end},
            {'t': 'text_length_group', 's': case when length <= lo then 'short'
              when length <= hi then 'intermediate' else 'long' end}]) as k
          from unit_traits, (select quantile_cont(length, 1/3::double) as lo,
            quantile_cont(length, 2/3::double) as hi from unit_traits))""",
}
