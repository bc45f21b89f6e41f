"""Source, sink and provenance queries (S), model hook and detections (C15, C16).

Round trips write to a fresh folder next to the session's checkpoints.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from pairforge.operators.coverage import breadth_depth_arrays
from pairforge.operators.detections import suppress
from pairforge.operators.embed import embed_texts
from pairforge.operators.metrics import keep_first
from pairforge.operators.scaling import checkpoint_folder, durable
from pairforge.plans.pairing import build_pairs
from pairforge.sources import files as X
from pairforge.sources import tables as S
from workload.registry import query, rounded
from workload.views import EXTERNAL, Views


def _folder(v: Views) -> str:
    return f"{checkpoint_folder(v.spark)}/exchange-{uuid4().hex}"


def _digest(name: str):
    return F.md5(F.col(name).cast("binary")).alias("digest")


@query("S1_labelled_table", "select source_id, label, md5(text1) as digest from sources")
def labelled_table(v: Views):
    raw = v.table("documents").join(v.table("labels"), "doc_id")
    table = S.labelled_table(raw, text="text", label="quality", key="doc_id")
    return table.select("source_id", "label", _digest("text1"))


@query(
    "S1_generated_id",
    """select row_number() over (order by doc_id) - 1 as source_id, toxic::int as label,
      md5(text) as digest from documents join labels using (doc_id)""",
)
def generated_id(v: Views):
    raw = v.table("documents").join(v.table("labels"), "doc_id")
    table = S.labelled_table(raw, text="text", label="toxic", order=["doc_id"])
    return table.select("source_id", "label", _digest("text1"))


@query(
    "S2_candidates_jsonl",
    """select source_id, prompt_route, ordinal as candidate_index, md5(candidate_text) as digest
      from candidates""",
)
def candidates_jsonl(v: Views):
    folder = _folder(v)
    rows = v.candidates.select(
        "source_id", "prompt_route", F.col("ordinal").alias("candidate_index"), "candidate_text"
    )
    S.write_table(rows, folder, "json")
    back = S.read_candidates(v.spark, folder)
    return back.select("source_id", "prompt_route", "candidate_index", _digest("candidate_text"))


@query(
    "S3_region_inventory",
    """select label::int as position, 'class ' || label as name, r6(min(x)) as x0, r6(max(x)) as x1
      from (select label, unnest(embedding)::double as x from embeddings) group by label""",
)
def region_inventory(v: Views):
    values = v.table("embeddings").select("label", F.explode("embedding").alias("x"))
    boxes = values.groupBy("label").agg(
        F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi")
    )
    item = F.struct(
        F.concat(F.lit("class "), F.col("label")).alias("name"),
        F.array(F.col("lo"), F.lit(0.0), F.col("hi"), F.lit(1.0)).alias("bbox"),
    )
    # An inventory is one small document: ten classes, sorted.
    whole = boxes.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("label", item.alias("i")))), lambda s: s["i"]).alias(
            "information_units"
        )
    )
    folder = _folder(v)
    whole.select(F.to_json(F.struct("information_units")).alias("value")).coalesce(1).write.text(folder)
    regions = S.read_regions(v.spark, folder)
    return rounded(
        regions.select("position", "name", F.col("bbox")[0].alias("x0"), F.col("bbox")[2].alias("x1"))
    )


@query(
    "S4_manifest_csv",
    """select o_custkey::varchar as run, o_orderkey::varchar as output, o_orderpriority as role
      from orders""",
)
def manifest_csv(v: Views):
    folder = _folder(v)
    rows = v.table("orders").select(
        F.col("o_custkey").alias(S.BOM + "run"),
        F.col("o_orderkey").alias("output"),
        F.col("o_orderpriority").alias("role"),
    )
    S.write_table(rows, folder, "csv")
    return S.read_manifest(v.spark, folder, ["run", "output", "role"])


@query(
    "S5_read_pairs",
    """select p.label, md5(s.text1) as anchor, md5(p.chosen_text) as chosen,
      md5(p.rejected_text) as rejected from pairs p join sources s using (source_id)""",
)
def read_pairs(v: Views):
    folder = _folder(v)
    pairs = build_pairs(v.sources, v.scored(text=True), texts=v.candidate_texts)
    S.write_table(pairs, folder, compression="zstd")
    pairs = S.read_pairs(v.spark.read.parquet(folder))
    return pairs.select(
        "label",
        *[F.md5(F.col(f"{n}_text").cast("binary")).alias(n) for n in ("anchor", "chosen", "rejected")],
    )


@query(
    "S6_prediction_lock",
    """select dataset, unit, method, weight_id, aug_seed, train_seed, y_true, y_pred,
      r6(y_prob) as y_prob from predictions where dataset in ('ext_a', 'ext_b')
        and method in ('paired', 'edit')""",
)
def prediction_lock(v: Views):
    methods = ("paired", "edit")
    wanted = F.col("dataset").isin(*EXTERNAL) & F.col("method").isin(*methods)
    # The lock carries the families, which the metrics' view of the predictions leaves out.
    first = keep_first(v.repeated_predictions.where(wanted))
    return rounded(S.prediction_lock(first, EXTERNAL, methods).drop("family", "method_group"))


@query(
    "S7_minimal_csv",
    """select p.label, md5(s.text1) as anchor, md5(p.chosen_text) as chosen
      from pairs p join sources s using (source_id)""",
)
def minimal_csv(v: Views):
    folder = _folder(v)
    pairs = build_pairs(v.sources, v.scored(text=True), texts=v.candidate_texts)
    S.write_table(pairs, folder, "csv", S.MINIMAL, "gzip")
    schema = "anchor_text string, chosen_text string, rejected_text string, label int"
    back = v.spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(
        folder, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return back.select(
        "label", *[F.md5(F.col(f"{n}_text").cast("binary")).alias(n) for n in ("anchor", "chosen")]
    )


@query(
    "S8_scored_jsonl",
    """select source_id, ordinal, bucket_name, r6(residual_cos) as residual_cos,
      r6(yz_violation_score) as yz_violation_score from scored""",
)
def scored_jsonl(v: Views):
    folder = _folder(v)
    S.write_table(v.scored(), folder, "json")
    schema = (
        "source_id bigint, ordinal int, bucket_name string, residual_cos double, "
        "yz_violation_score double"
    )
    return rounded(v.spark.read.schema(schema).json(folder))


@query(
    "S9_run_summary",
    "select count(*) as documents, sum(n_chars)::bigint as characters from documents",
)
def run_summary(v: Views):
    facts = v.table("documents").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters")
    ).first()
    folder = _folder(v)
    S.write_summary(v.spark, folder, facts.asDict())
    return v.spark.read.schema("documents bigint, characters bigint").json(folder)


@query("S10_file_manifest")
def file_manifest(v: Views):
    return X.file_manifest(v.spark, v.sf_dir)


@query("S11_verify_manifest")
def verify_manifest(v: Views):
    actual = durable(X.file_manifest(v.spark, v.sf_dir))  # read three times, hashed once
    spoiled = F.when(F.col("path") == "orders.parquet", F.sha2(F.lit("other"), 256)).otherwise(
        F.col("sha256")
    )
    recorded = actual.select("path", spoiled.alias("sha256"))
    renamed = actual.where(F.col("path") == "part.parquet").select(F.lit("absent.parquet").alias("path"), "sha256")
    return X.verify_manifest(recorded.unionByName(renamed), actual)


@query(
    "C3_array_form",
    """select text_id, r6(breadth) as breadth, r6(depth) as depth from coverage""",
)
def array_form(v: Views):
    from pairforge.operators.coverage import fuse_scores

    scores = fuse_scores(v.region_scores).groupBy("text_id").agg(
        F.collect_list("final_score").alias("scores")
    )
    breadth, depth = breadth_depth_arrays(F.col("scores"))
    return rounded(scores.select("text_id", breadth.alias("breadth"), depth.alias("depth")))


@query("C15_embed_texts")
def embed(v: Views):
    vectors = embed_texts(v.table("documents"), "doc_id", "text")
    return rounded(vectors.select("doc_id", F.posexplode("vec").alias("position", "x")))


def _box(side: str) -> str:
    return f"({side}.x1 - {side}.x0) * ({side}.y1 - {side}.y0)"


COMMON = """(greatest(least(k.x1, b.x1) - greatest(k.x0, b.x0), 0)
  * greatest(least(k.y1, b.y1) - greatest(k.y0, b.y0), 0))"""


@query(
    "C16_suppress_detections",
    f"""with recursive d as (select image_id, box_id, x0, y0, x0 + 60 + w * 20 as x1,
          y0 + 60 + t * 20 as y1, score from (select l_orderkey as image_id,
            l_linenumber || '-' || l_partkey || '-' || l_suppkey as box_id,
            u('x:' || key) * 60 as x0, u('y:' || key) * 60 as y0, u('w:' || key) as w,
            u('h:' || key) as t, u('d:' || key) as score
          from (select *, l_orderkey || ':' || l_linenumber || ':' || l_partkey as key
            from lineitem))),
      b as materialized (select *, row_number() over (partition by image_id
          order by score desc, box_id) as place from d where score > 0.2),
      s as (select image_id, place, [b] as kept from b where place = 1
        union all select b.image_id, b.place, case when len(list_filter(s.kept, lambda k:
            {COMMON} > 0.5 * ({_box('k')} + {_box('b')} - {COMMON}))) > 0 then s.kept
          else list_append(s.kept, b) end
        from s join b on b.image_id = s.image_id and b.place = s.place + 1),
      f as (select unnest(arg_max(kept, place)) as k from s group by image_id)
      select k.image_id, k.box_id, r6(k.x0) as x0, r6(k.y0) as y0, r6(k.x1) as x1,
        r6(k.y1) as y1, r6(k.score) as score from f""",
)
def suppress_detections(v: Views):
    return rounded(suppress(v.detections))
