"""Scoring queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.functions.vectors import cosine
from pairforge.operators import bands, coverage, residual
from pairforge.plans.scoring import score_candidates
from workload.registry import query, r6, rounded
from workload.views import Views


def _chunks(v: Views):
    """Four chunk vectors per document."""
    keys = v.table("documents").select(
        F.col("doc_id").alias("text_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("j")
    )
    return keys.withColumn("vec_id", (F.col("text_id") * 3 + F.col("j") * 17) % v.n_vecs).join(
        v.vectors.select("vec_id", "vec"), "vec_id"
    ).select("text_id", "vec")


def _regions(v: Views):
    """One region vector per embedding class: the class mean."""
    parts = v.table("embeddings").select(
        F.col("label").cast("int").alias("region"), F.posexplode("embedding").alias("pos", "x")
    )
    means = parts.groupBy("region", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("region").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec")
    )


def _doc_vectors(v: Views):
    keys = v.table("documents").select(
        F.col("doc_id").alias("text_id"), (F.col("doc_id") % v.n_vecs).alias("vec_id")
    )
    return keys.join(v.vectors.select("vec_id", "vec"), "vec_id").select("text_id", "vec")


@query(
    "C1_region_similarity",
    """with unit_vectors as (select vec_id,
        list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) as vec from vectors),
      means as (select label, pos, avg(x) as x from (select label, unnest(embedding)::double as x,
        generate_subscripts(embedding, 1) as pos from embeddings) group by label, pos),
      raw_regions as (select label::int as region, list(x order by pos) as vec from means
        group by label),
      regions as (select region, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)))
        as vec from raw_regions),
      chunk_best as (select d.doc_id as text_id, r.region,
          max(list_dot_product(w.vec, r.vec)) as chunk_score
        from documents d, range(1, 5) k(j), unit_vectors w, regions r
        where w.vec_id = (d.doc_id * 3 + j * 17) % (select n from n_vecs) group by 1, 2)
      select d.doc_id as text_id, r.region, r6(list_dot_product(w.vec, r.vec)) as global_score,
        r6(c.chunk_score) as chunk_score
      from documents d join unit_vectors w on w.vec_id = d.doc_id % (select n from n_vecs)
      join chunk_best c on c.text_id = d.doc_id join regions r on r.region = c.region""",
)
def region_similarity(v: Views):
    return rounded(coverage.region_similarity(_doc_vectors(v), _chunks(v), _regions(v)))


@query("C2_fuse_scores", "select text_id, region, r6(final_score) as final_score from fused_scores")
def fuse(v: Views):
    return rounded(coverage.fuse_scores(v.region_scores).select("text_id", "region", "final_score"))


@query(
    "C3_breadth_depth",
    """select text_id, r6(breadth) as breadth, r6(depth) as depth, hit_count, total_count
      from coverage""",
)
def breadth_depth(v: Views):
    return rounded(coverage.breadth_depth(coverage.fuse_scores(v.region_scores)))


@query(
    "C4_projection_fit",
    """select pos::int - 1 as pos, r6(center) as center,
      r6(difference / (select sqrt(sum(difference * difference)) from projection)) as direction
      from projection""",
)
def projection_fit(v: Views):
    fit = residual.fit_projection(v.source_rows)
    rows = F.arrays_zip(
        F.array(*[F.lit(x) for x in fit.center]).alias("center"),
        F.array(*[F.lit(x) for x in fit.direction]).alias("direction"),
    )
    one = v.spark.range(1).select(F.posexplode(rows).alias("pos", "row"))
    return rounded(one.select("pos", "row.center", "row.direction"))


@query(
    "C5_residualize",
    """select vec_id, unnest(list_transform(res, lambda x: r6(x))) as x,
      generate_subscripts(res, 1)::int - 1 as pos from residuals""",
)
def residualize(v: Views):
    fit = residual.fit_projection(v.source_rows)
    out = v.vectors.select("vec_id", residual.residualize(fit, F.col("vec")).alias("res"))
    return rounded(out.select("vec_id", F.posexplode("res").alias("pos", "x")))


def _pairs_of_vectors(v: Views):
    left = v.source_rows.select("source_id", F.col("vec").alias("source_vec"))
    return v.candidate_rows().join(left, "source_id")


@query("C6_residual_cosine", "select source_id, ordinal, r6(residual_cos) as residual_cos from scored")
def residual_cosine(v: Views):
    fit = residual.fit_projection(v.source_rows)
    value = residual.residual_cosine(fit, F.col("source_vec"), F.col("candidate_vec"))
    return rounded(_pairs_of_vectors(v).select("source_id", "ordinal", value.alias("residual_cos")))


@query("C7_plain_cosine", "select source_id, ordinal, r6(origin_cos) as origin_cos from cosines")
def plain_cosine(v: Views):
    value = cosine("source_vec", "candidate_vec")
    return rounded(_pairs_of_vectors(v).select("source_id", "ordinal", value.alias("origin_cos")))


@query(
    "C8_scaled_mad",
    """with m as (select event_type, median(value) as center from events group by event_type)
      select e.event_type, r6(any_value(m.center)) as center,
        r6(greatest(1.4826 * median(abs(e.value - m.center)), 1e-6)) as scale
      from events e join m using (event_type) group by e.event_type""",
)
def scaled_mad(v: Views):
    return rounded(bands.scaled_mad(v.table("events"), ["event_type"], "value"))


@query(
    "C9_class_statistics",
    """select label, r6(y_center) as y_center, r6(y_scale) as y_scale,
      r6(y_lower_risk) as y_lower_risk, r6(y_upper_risk) as y_upper_risk,
      r6(z_center) as z_center, r6(z_scale) as z_scale, r6(z_lower_risk) as z_lower_risk,
      r6(z_upper_risk) as z_upper_risk from class_stats""",
)
def class_statistics(v: Views):
    rows = v.sources.join(v.coverage.withColumnRenamed("text_id", "source_id"), "source_id")
    return rounded(bands.class_statistics(rows))


@query(
    "C10_directional_bands",
    """select source_id, label, r6(eps_y_plus) as eps_y_plus, r6(eps_y_minus) as eps_y_minus,
      r6(eps_z_plus) as eps_z_plus, r6(eps_z_minus) as eps_z_minus, r6(y_lower) as y_lower,
      r6(y_upper) as y_upper, r6(z_lower) as z_lower, r6(z_upper) as z_upper from bands""",
)
def directional_bands(v: Views):
    return rounded(v.bands.drop("text1", "lang", "breadth", "depth"))


def _checked(v: Views):
    cover = v.coverage.select(
        F.col("text_id").alias("cand_doc"),
        F.col("breadth").alias("candidate_y"),
        F.col("depth").alias("candidate_z"),
    )
    joined = v.candidate_keys.join(cover, "cand_doc").join(v.bands.drop("text1", "lang"), "source_id")
    return bands.check_bands(joined)


@query(
    "C11_utilization_violation",
    """select source_id, ordinal, r6(y_util) as y_util, r6(y_violate_low) as y_violate_low,
      r6(y_violate_high) as y_violate_high from checked""",
)
def utilization_violation(v: Views):
    return rounded(
        _checked(v).select("source_id", "ordinal", "y_util", "y_violate_low", "y_violate_high")
    )


@query(
    "C12_band_check",
    """select source_id, ordinal, r6(delta_y) as delta_y, r6(delta_z) as delta_z,
      r6(z_violate_low) as z_violate_low, r6(z_violate_high) as z_violate_high,
      r6(yz_violation_score) as yz_violation_score, r6(yz_utilization) as yz_utilization, yz_pass
      from checked""",
)
def band_check(v: Views):
    columns = "delta_y delta_z z_violate_low z_violate_high yz_violation_score yz_utilization".split()
    return rounded(_checked(v).select("source_id", "ordinal", *columns, "yz_pass"))


@query(
    "C13_candidate_evaluation",
    """select source_id, ordinal, yz_pass, x_pass, r6(x_violation_score) as x_violation_score,
      bucket_id, bucket_name from scored""",
)
def candidate_evaluation(v: Views):
    columns = "yz_pass x_pass x_violation_score bucket_id bucket_name".split()
    return rounded(v.scored().select("source_id", "ordinal", *columns))


@query(
    "C14_score_candidates",
    """select source_id, ordinal, cand_doc, prompt_route, label, lang,
      r6(source_y) as source_y, r6(source_z) as source_z, r6(candidate_y) as candidate_y,
      r6(candidate_z) as candidate_z, r6(residual_cos) as residual_cos,
      r6(origin_cos) as origin_cos, cosine_threshold, yz_pass, x_pass,
      r6(yz_violation_score) as yz_violation_score, r6(yz_utilization) as yz_utilization,
      bucket_name from scored join (select source_id, lang from sources) using (source_id)""",
)
def score(v: Views):
    columns = (
        "source_id ordinal cand_doc prompt_route label lang source_y source_z candidate_y "
        "candidate_z residual_cos origin_cos cosine_threshold yz_pass x_pass yz_violation_score "
        "yz_utilization bucket_name"
    ).split()
    scored = score_candidates(v.source_rows, v.candidate_rows(), carry=("lang",)).select(*columns)
    return rounded(scored).withColumn("cosine_threshold", r6("cosine_threshold"))
