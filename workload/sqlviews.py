"""The fixture views as DuckDB SQL, pulled in by name."""

from __future__ import annotations

import re

from workload.sqlmetrics import EVALUATION_VIEWS

MACROS = {
    "h(": lambda a: f"cast('0x' || substr(md5({a}), 1, 8) as bigint)",
    "u(": lambda a: f"((cast('0x' || substr(md5({a}), 1, 8) as bigint) % 10000) / 10000.0::double)",
    "r6(": lambda a: f"(floor(cast({a} as double) * 1e6 + 0.5137) / 1e6)",
    # hexd(key, i): eight hex digits of the draw at 1-based position i, four per digest
    "hexd(": lambda a: "substr(md5({0} || ':' || (({1} - 1) // 4)), (({1} - 1) % 4) * 8 + 1, 8)".format(
        *(part.strip() for part in a.rsplit(",", 1))
    ),
}

# view -> SQL; a view may use any other view
VIEWS = {
    "n_docs": "select count(*) as n from documents",
    "n_vecs": "select count(*) as n from embeddings",
    "sources": """select d.doc_id as source_id, d.text as text1, d.lang, l.quality::int as label
        from documents d join labels l using (doc_id)""",
    "candidate_keys": """select source_id, ordinal,
          (source_id * 7 + base * 13) % (select n from n_docs) as cand_doc,
          case when base <= 8 then 'chosen' else 'rejected' end as prompt_route
        from (select source_id, ordinal::int as ordinal,
                case ordinal when 17 then 1 when 18 then 9 else ordinal end as base
              from sources, range(1, 19) k(ordinal))""",
    "candidates": """select c.*, case when ordinal > 16 then '  ' || d.text || ' ' else d.text end
          as candidate_text
        from candidate_keys c join documents d on d.doc_id = c.cand_doc""",
    "region_scores": """select text_id, region,
          0.14::double + 0.10::double * u('g:' || text_id || ':' || region) as global_score,
          0.14::double + 0.10::double * u('c:' || text_id || ':' || region) as chunk_score
        from (select doc_id as text_id, region::int as region
              from documents, range(0, 12) k(region))""",
    "fused_scores": """select *, (1.0::double - 0.8::double) * global_score
          + 0.8::double * chunk_score as final_score from region_scores""",
    "coverage": """select text_id, count(e) / count(*)::double as breadth,
          coalesce(avg(e), 0.0::double) as depth, count(e) as hit_count, count(*) as total_count
        from (select text_id, case when final_score >= 0.19::double
                then final_score - 0.19::double end as e from fused_scores)
        group by text_id""",
    "vectors": """select vec_id, embedding::double[] as vec, (label >= 5)::int as label
        from embeddings""",
    "source_rows": """select s.*, c.breadth, c.depth, v.vec
        from sources s join coverage c on c.text_id = s.source_id
        join vectors v on v.vec_id = s.source_id % (select n from n_vecs)""",
    "candidate_rows": """select k.*, c.breadth as candidate_y, c.depth as candidate_z,
          v.vec as candidate_vec
        from candidate_keys k join coverage c on c.text_id = k.cand_doc
        join vectors v on v.vec_id = k.cand_doc % (select n from n_vecs)""",
    "class_mid": """select label, median(breadth) as y_center, median(depth) as z_center,
          quantile_cont(breadth, 0.1) as y_lower_risk, quantile_cont(breadth, 0.9) as y_upper_risk,
          quantile_cont(depth, 0.1) as z_lower_risk, quantile_cont(depth, 0.9) as z_upper_risk
        from (select s.label, c.breadth, c.depth from sources s
              join coverage c on c.text_id = s.source_id) group by label""",
    "class_stats": """select m.*,
          greatest(1.4826::double * a.y_mad, 1e-6::double) as y_scale,
          greatest(1.4826::double * a.z_mad, 1e-6::double) as z_scale
        from class_mid m join (
          select s.label, median(abs(c.breadth - m.y_center)) as y_mad,
            median(abs(c.depth - m.z_center)) as z_mad
          from sources s join coverage c on c.text_id = s.source_id
          join class_mid m on m.label = s.label group by s.label) a using (label)""",
    "banded": """select s.source_id, s.text1, s.lang, s.label, c.breadth, c.depth,
          case s.label when 1 then 0.4::double else 1.0::double end * t.y_scale as eps_y_plus,
          case s.label when 1 then 1.0::double else 0.4::double end * t.y_scale as eps_y_minus,
          case s.label when 1 then 0.4::double else 1.0::double end * t.z_scale as eps_z_plus,
          case s.label when 1 then 1.0::double else 0.4::double end * t.z_scale as eps_z_minus
        from sources s join coverage c on c.text_id = s.source_id
        join class_stats t on t.label = s.label""",
    "bands": """select *, breadth - eps_y_minus as y_lower, breadth + eps_y_plus as y_upper,
          depth - eps_z_minus as z_lower, depth + eps_z_plus as z_upper from banded""",
    "projection": """select pos, avg(x) as center,
          avg(case when label = 1 then x end) - avg(case when label = 0 then x end) as difference
        from (select label, unnest(vec) as x, generate_subscripts(vec, 1) as pos from source_rows)
        group by pos""",
    "projection_row": """select list(center order by pos) as center,
          list(difference / (select sqrt(sum(difference * difference)) from projection)
               order by pos) as direction from projection""",
    "residuals": """select vec_id, list_transform(s, lambda x, i: x - t * direction[i]) as res
        from (select vec_id, s, direction, list_dot_product(s, direction) as t
              from (select vec_id, list_transform(vec, lambda x, i: x - center[i]) as s, direction
                    from vectors, projection_row))""",
    "deltas": """select k.source_id, k.ordinal, k.cand_doc, k.prompt_route, b.label,
          b.breadth as source_y, b.depth as source_z,
          y.breadth as candidate_y, y.depth as candidate_z,
          y.breadth - b.breadth as delta_y, y.depth - b.depth as delta_z,
          greatest(b.eps_y_plus, 1e-8::double) as yp, greatest(b.eps_y_minus, 1e-8::double) as ym,
          greatest(b.eps_z_plus, 1e-8::double) as zp, greatest(b.eps_z_minus, 1e-8::double) as zm,
          b.y_lower, b.y_upper, b.z_lower, b.z_upper
        from candidate_keys k join bands b using (source_id)
        join coverage y on y.text_id = k.cand_doc""",
    "checked": """select *, 0.5::double * (y_util + z_util) as yz_utilization,
          y_violate_low + y_violate_high + z_violate_low + z_violate_high as yz_violation_score,
          (y_violate_low + y_violate_high + z_violate_low + z_violate_high) = 0.0 as yz_pass
        from (select *,
          least(abs(delta_y) / case when delta_y >= 0 then yp else ym end, 1.0::double) as y_util,
          least(abs(delta_z) / case when delta_z >= 0 then zp else zm end, 1.0::double) as z_util,
          greatest(0.0::double, (-delta_y - ym) / ym) as y_violate_low,
          greatest(0.0::double, (delta_y - yp) / yp) as y_violate_high,
          greatest(0.0::double, (-delta_z - zm) / zm) as z_violate_low,
          greatest(0.0::double, (delta_z - zp) / zp) as z_violate_high
        from deltas)""",
    "cosines": """select c.*,
          case when sqrt(list_dot_product(rs.res, rs.res)) < 1e-6
                 or sqrt(list_dot_product(rc.res, rc.res)) < 1e-6 then 1.0::double
            else list_dot_product(rs.res, rc.res) / (sqrt(list_dot_product(rs.res, rs.res))
              * sqrt(list_dot_product(rc.res, rc.res)) + 1e-12) end as residual_cos,
          list_dot_product(vs.vec, vc.vec) / (sqrt(list_dot_product(vs.vec, vs.vec))
            * sqrt(list_dot_product(vc.vec, vc.vec)) + 1e-12) as origin_cos,
          case c.label when 1 then 0.14::double else 0.16::double end as cosine_threshold
        from checked c
        join vectors vs on vs.vec_id = c.source_id % (select n from n_vecs)
        join vectors vc on vc.vec_id = c.cand_doc % (select n from n_vecs)
        join residuals rs on rs.vec_id = vs.vec_id
        join residuals rc on rc.vec_id = vc.vec_id""",
    "scored": """select *, residual_cos < cosine_threshold as x_pass,
          greatest(0.0::double, (residual_cos - cosine_threshold) / cosine_threshold)
            as x_violation_score,
          case when yz_pass and residual_cos < cosine_threshold then 0 when yz_pass then 1
            when residual_cos < cosine_threshold then 2 else 3 end as bucket_id,
          case when yz_pass and residual_cos < cosine_threshold then 'yz_pass_x_pass'
            when yz_pass then 'yz_pass_x_fail'
            when residual_cos < cosine_threshold then 'yz_fail_x_pass'
            else 'yz_fail_x_fail' end as bucket_name,
          prompt_route || '_prompt' as prompt_type from cosines""",
    "pool": """select * from (select s.*, c.candidate_text, row_number() over (
            partition by s.source_id,
              regexp_replace(trim(lower(c.candidate_text), e' \\t\\n\\r'), '\\s+', ' ', 'g')
            order by s.ordinal) as first_copy
          from scored s join candidates c using (source_id, ordinal)
          where trim(c.candidate_text, e' \\t\\n\\r') <> '') where first_copy = 1""",
    "ranked": """select *,
          row_number() over (partition by source_id order by (not yz_pass)::int, residual_cos,
            -yz_utilization, -origin_cos, ordinal) as chosen_rank,
          row_number() over (partition by source_id order by yz_pass::int,
            case when yz_pass then -residual_cos else -yz_violation_score end,
            case when yz_pass then yz_utilization else residual_cos end,
            origin_cos, ordinal) as rejected_order from pool""",
    "roles": """select *, 'chosen' as role, chosen_rank as role_rank from ranked
          where chosen_rank <= 6
        union all
        select * from (select *, 'rejected' as role, row_number() over (
            partition by source_id order by rejected_order) as role_rank
          from ranked where chosen_rank > 6) where role_rank <= 30""",
    "pairing": """select * from (select *, row_number() over (partition by source_id, role order by
            case when role = 'chosen' then (not yz_pass)::int else yz_pass::int end,
            case when role = 'chosen' then residual_cos
              when yz_pass then -residual_cos else -yz_violation_score end,
            case when role = 'chosen' then -yz_utilization
              when yz_pass then yz_utilization else residual_cos end,
            role_rank) - 1 as pair_rank from roles)
        where pair_rank < case role when 'chosen' then 10 else 40 end""",
    "joined_pairs": """select c.source_id, c.label, c.pair_rank,
          c.candidate_text as chosen_text, r.candidate_text as rejected_text,
          c.yz_pass as chosen_yz_pass, r.yz_pass as rejected_yz_pass,
          c.bucket_name as chosen_bucket, r.bucket_name as rejected_bucket,
          c.prompt_type as chosen_prompt_type, r.prompt_type as rejected_prompt_type,
          c.residual_cos as chosen_residual_cos, r.residual_cos as rejected_residual_cos,
          c.yz_utilization as chosen_yz_utilization, r.yz_utilization as rejected_yz_utilization,
          c.yz_violation_score as chosen_yz_violation,
          r.yz_violation_score as rejected_yz_violation
        from pairing c join pairing r on r.source_id = c.source_id and r.pair_rank = c.pair_rank
        where c.role = 'chosen' and r.role = 'rejected'""",
    "judged_pairs": """select *,
          case when chosen_yz_pass <> rejected_yz_pass then chosen_yz_pass
            when chosen_yz_pass and rejected_residual_cos <> chosen_residual_cos
              then rejected_residual_cos > chosen_residual_cos
            when chosen_yz_pass then rejected_yz_utilization < chosen_yz_utilization
            else rejected_yz_violation > chosen_yz_violation end as worse,
          10.0::double * (chosen_yz_pass::int - rejected_yz_pass::int)
            + 2.0::double * (rejected_residual_cos - chosen_residual_cos)
            + 2.0::double * (rejected_yz_violation - chosen_yz_violation)
            + (chosen_yz_utilization - rejected_yz_utilization) as pair_margin
        from joined_pairs""",
    "pairs": "select * from judged_pairs where worse and pair_margin >= 1.0",
    "audit": """select ['baseline', 'edit', 'prompt', 'paired'][ordinal % 4 + 1] as method,
          (h('s:' || source_id) % 5)::int as seed, source_id, source_id as source_row_index,
          label as source_label, (ordinal // 4)::int as aug_round, ordinal, cand_doc, bucket_name,
          yz_pass, x_pass, yz_pass and x_pass as joint_pass, residual_cos, origin_cos,
          delta_y, delta_z, y_violate_low, y_violate_high, z_violate_low, z_violate_high,
          yz_violation_score, x_violation_score, yz_utilization from scored""",
    "predictions": """select * exclude (row_idx) from repeated_predictions
        qualify row_number() over (partition by method, dataset, weight_id, unit order by row_idx) = 1""",
    "repeated_predictions": """select row_idx, dataset, unit,
          ['baseline', 'edit', 'prompt', 'paired'][m + 1] as method,
          case when m < 2 then 'reference' else 'generated' end as family,
          case when m % 2 = 0 then 'plain' else 'tuned' end as method_group,
          'm' || m || '_g' || g || '_t' || t as weight_id,
          case when m > 0 then g end as aug_seed, t as train_seed, y_true, y_prob,
          (y_prob >= 0.5)::int as y_pred
        from (select * exclude (p), case when row_idx = 0 then p else 1 - p end as y_prob
          from (select *, unnest(case when unit % 16 = 3 then [0, 1] else [0] end) as row_idx
          from (select *, 0.7::double * u('p:' || m || ':' || g || ':' || t || ':' || unit)
            + y_true * (0.1::double + 0.05::double * m) as p
          from (select ['val', 'ext_a', 'ext_b'][user_id % 3 + 1] as dataset, event_id as unit,
              (event_type in ('error', 'signup'))::int as y_true, m::int as m, g::int as g,
              t::int as t
            from events, range(0, 4) a(m), range(0, 3) b(g), range(0, 2) c(t)))))""",
    "metric_cells": """select 'run' || (user_id % 40) || '.pt' as checkpoint,
          (event_id % 10 + 1)::int as epoch, sum((value > 20)::int)::bigint as a,
          sum((event_type in ('click', 'view'))::int)::bigint as b, count(*) as n
        from events group by all""",
    "metric_rows": """select checkpoint, epoch, 'cv_validation' as dataset_role,
          'accuracy' as metric_name, ((20 * a) // n) / 20.0::double as metric_value
        from metric_cells union all
        select checkpoint, epoch, 'cv_validation', 'f1', ((20 * b) // n) / 20.0::double
        from metric_cells""",
    "vocabulary": """select distinct word from (select unnest(string_split(
          trim(regexp_replace(regexp_replace(lower(replace(replace(text1, '''', ''), '’', '')),
            '[^a-z]', ' ', 'g'), ' +', ' ', 'g')), ' ')) as word from sources) where word <> ''""",
    "lemmas": """select word, unnest([reverse(word) || '_Er', word || '-like',
          'Re' || word || '2', word]) as lemma from vocabulary where h('syn:' || word) % 3 <> 0""",
}

VIEWS |= EVALUATION_VIEWS
VIEWS |= {
    "unit_vecs": """select vec_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)))
        as vec from vectors""",
    "neighbours": """select q, ref_id, ref_label from (select a.vec_id as q,
          s.source_id as ref_id, s.label as ref_label, row_number() over (partition by a.vec_id
            order by round(1 - list_dot_product(a.vec, b.vec), 9), s.source_id) as rank
        from unit_vecs a, sources s join unit_vecs b
          on b.vec_id = s.source_id % (select n from n_vecs)) where rank <= 10""",
    "label_rates": """select q, avg((ref_label <> 0)::int) as r0, avg((ref_label <> 1)::int) as r1
        from neighbours group by q""",
    "contamination": """select a.*, case source_label when 0 then r0 else r1 end as opposite_rate
        from audit a join label_rates on q = a.cand_doc % (select n from n_vecs)""",
    "points": """select vec_id as point_id, label, (h('f:' || vec_id) % 5)::int as fold,
          vec[1] as dim1, vec[2] as dim2, case label when 0 then r0 else r1 end as value
        from vectors join label_rates on q = vec_id""",
    "coupling": """select method, seed, a / nullif(a + b, 0) as x_pass_within_yz_pass,
          c / nullif(c + d, 0) as x_pass_within_yz_fail,
          a / nullif(a + b, 0) - c / nullif(c + d, 0) as x_pass_difference,
          (a * d - b * c) / nullif(sqrt((a + b) * (c + d) * (a + c) * (b + d)), 0) as phi
        from (select method, seed, (count(*) filter (yz_pass and x_pass))::double as a,
            (count(*) filter (yz_pass and not x_pass))::double as b,
            (count(*) filter (not yz_pass and x_pass))::double as c,
            (count(*) filter (not yz_pass and not x_pass))::double as d
          from audit group by method, seed)""",
    "directional": """select method, seed,
          avg(y_violate_high + z_violate_high) filter (source_label = 1) as over_completion,
          avg(y_violate_low + z_violate_low) filter (source_label = 0) as evidence_loss
        from audit group by method, seed""",
    "seed_residuals": """select method, seed, avg(residual_cos) as residual_similarity_mean,
          stddev_samp(residual_cos) as residual_similarity_sd,
          count(*) as residual_similarity_n from audit group by method, seed""",
    "bridge": """select * from (select method, seed, avg(yz_pass::int) as yz_pass_rate,
            avg(x_pass::int) as x_pass_rate, avg(joint_pass::int) as joint_pass_rate
          from audit group by method, seed)
        join coupling using (method, seed) join directional using (method, seed)
        join seed_residuals using (method, seed)
        join (select method, seed, avg(opposite_rate) as overall_contamination,
            avg(opposite_rate) filter (source_label = 1) as one_to_zero_contamination,
            avg(opposite_rate) filter (source_label = 0) as zero_to_one_contamination
          from contamination group by method, seed) using (method, seed)
        left join (select method, string_split(seed_group, '_')[-1]::int as seed, f1
          from external_rows) using (method, seed)""",
}


def _expand(sql: str) -> str:
    """Replace the macros, innermost first."""
    for name, build in MACROS.items():
        pattern = re.compile(rf"(?<![\w]){re.escape(name)}")
        while (found := pattern.search(sql)) is not None:
            depth, end = 1, found.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[: found.start()] + build(sql[found.end() : end - 1]) + sql[end:]
    return sql


def _needs(sql: str, skip: str = "") -> list[str]:
    words = set(re.findall(r"\b\w+\b", sql))
    return [v for v in VIEWS if v in words and v != skip]


def with_views(sql: str) -> str:
    """Prefix a query with the views it uses, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in _needs(VIEWS[name], skip=name):
            if other not in ordered:
                visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in _needs(sql):
        visit(name)
    body = sql.strip()
    parts = [f"{name} as ({VIEWS[name]})" for name in ordered]
    if body.lower().startswith("with "):
        lead = "with recursive " if body.lower().startswith("with recursive ") else "with "
        return _expand("with recursive " + ",\n".join([*parts, body[len(lead) :]]))
    return _expand(("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body)
