"""Detection filter and exact greedy non-maximum suppression.

Images are independent and normally hold few boxes, so many of them share one task.
An image above ``group_limit`` boxes never enters a single task: its boxes go through
rounds over a spatial grid. A round takes the best box of every cell; a cell's best that
no better remaining box overlaps is final, and everything it overlaps is dropped. That
yields the same set as the sequential greedy scan.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.scaling import durable, salted_join, top_k

BOX = ("image_id", "box_id", "x0", "y0", "x1", "y1", "score")
CORNERS = ("x0", "y0", "x1", "y1")
ROWS_PER_TASK = 50_000


def suppress(
    detections: DataFrame,
    min_score: float = 0.2,
    max_iou: float = 0.5,
    group_limit: int = 5_000,
) -> DataFrame:
    """Boxes scoring above ``min_score`` that survive suppression per image.

    Scores sort descending, equal scores by ``box_id``; a box goes when its overlap with
    a kept better box exceeds ``max_iou``, which must lie in (0, 1]. Boxes without area
    (flat, inverted or with an unknown corner) overlap nothing and stay.
    """
    if not 0.0 < max_iou <= 1.0:
        raise ValueError("max_iou must lie in (0, 1]")
    scored = detections.where(F.col("score") > min_score).select(*BOX)
    if max_iou == 1.0:  # no overlap exceeds it
        return scored
    solid = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False))
    flat, boxes = scored.where(~solid), scored.where(solid)
    # Copies of one box: only the best can survive, the rest overlap it fully.
    boxes = top_k(
        boxes, ["image_id", *CORNERS], [F.col("score").desc(), F.col("box_id")], 1, "_copy"
    ).drop("_copy")
    boxes = durable(boxes)
    sizes = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > group_limit).select("image_id")
    total = boxes.count()
    if large.isEmpty():
        return _suppress_small(boxes, max_iou, total).unionByName(flat)
    small = boxes.join(large, "image_id", "left_anti")
    hot = boxes.join(large, "image_id", "left_semi")
    kept = _suppress_small(small, max_iou, total).unionByName(_suppress_large(hot, max_iou))
    return kept.unionByName(flat)


def _suppress_small(boxes: DataFrame, max_iou: float, total: int) -> DataFrame:
    tasks = max(ceil(total / ROWS_PER_TASK), boxes.sparkSession.sparkContext.defaultParallelism)
    names = list(BOX)

    def scan(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by(
            [("image_id", "ascending"), ("score", "descending"), ("box_id", "ascending")]
        )
        image = table.column("image_id").to_numpy()
        x0, y0, x1, y1 = (table.column(c).to_numpy() for c in CORNERS)
        area = (x1 - x0) * (y1 - y0)
        starts = np.flatnonzero(np.r_[True, image[1:] != image[:-1]]) if len(image) else []
        keep = np.zeros(len(image), dtype=bool)
        for start, stop in zip(starts, [*starts[1:], len(image)]):
            alive = np.ones(stop - start, dtype=bool)
            for i in range(start, stop):
                if not alive[i - start]:
                    continue
                keep[i] = True
                rest = slice(i + 1, stop)
                wide = np.minimum(x1[i], x1[rest]) - np.maximum(x0[i], x0[rest])
                high = np.minimum(y1[i], y1[rest]) - np.maximum(y0[i], y0[rest])
                common = np.maximum(wide, 0.0) * np.maximum(high, 0.0)
                alive[i + 1 - start :] &= ~(common > max_iou * (area[i] + area[rest] - common))
        return table.filter(pa.array(keep)).select(names)

    schema = boxes.select(*names).schema
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(tasks)).alias("_task")
    return boxes.groupBy(bucket).applyInArrow(scan, schema)


def _overlaps(a: str, b: str, max_iou: float) -> Column:
    def edge(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def area(side: str) -> Column:
        return (edge(side, "x1") - edge(side, "x0")) * (edge(side, "y1") - edge(side, "y0"))

    wide = F.least(edge(a, "x1"), edge(b, "x1")) - F.greatest(edge(a, "x0"), edge(b, "x0"))
    high = F.least(edge(a, "y1"), edge(b, "y1")) - F.greatest(edge(a, "y0"), edge(b, "y0"))
    common = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    return common > F.lit(max_iou) * (area(a) + area(b) - common)


CELL = ("image_id", "ci", "cj", "gx", "gy")


def _suppress_large(boxes: DataFrame, max_iou: float) -> DataFrame:
    # Overlapping boxes differ in width (and height) by less than a factor 1 / max_iou.
    reach = ceil(log2(1.0 / max_iou))
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kept = boxes.limit(0)
    remaining = durable(
        boxes.withColumn("ci", F.floor(F.log2(width)).cast("int"))
        .withColumn("cj", F.floor(F.log2(height)).cast("int"))
        .withColumn("gx", F.floor((F.col("x0") + F.col("x1")) / 2 / F.pow(F.lit(2.0), "ci")))
        .withColumn("gy", F.floor((F.col("y0") + F.col("y1")) / 2 / F.pow(F.lit(2.0), "cj")))
    )
    steps = F.array(*[F.lit(d) for d in range(-reach, reach + 1)])

    def cells_along(low: str, high: str, size_class: str) -> Column:
        """Cells of one axis whose boxes may overlap enough, for a class of box sizes."""
        side = F.pow(F.lit(2.0), F.col(size_class))
        center = (F.col(low) + F.col(high)) / 2
        bound = F.lit(1.0 - max_iou) * F.greatest(F.col(high) - F.col(low), side * 2)
        return F.explode(F.sequence(F.floor((center - bound) / side), F.floor((center + bound) / side)))

    while not remaining.isEmpty():
        best = remaining.groupBy(*CELL).agg(
            F.min_by(F.struct(*BOX), F.struct(-F.col("score"), F.col("box_id"))).alias("b")
        )
        probe = (
            remaining.select("image_id", F.struct(*BOX).alias("c"), *CORNERS, "ci", "cj")
            .withColumn("ci", F.explode(F.transform(steps, lambda d: F.col("ci") + d)))
            .withColumn("cj", F.explode(F.transform(steps, lambda d: F.col("cj") + d)))
            .withColumn("gx", cells_along("x0", "x1", "ci"))
            .withColumn("gy", cells_along("y0", "y1", "cj"))
            .drop(*CORNERS)
        )
        met = salted_join(probe, best, list(CELL)).where(_overlaps("c", "b", max_iou))
        better = F.struct(-F.col("c.score"), F.col("c.box_id")) < F.struct(
            -F.col("b.score"), F.col("b.box_id")
        )
        met = durable(
            met.select(
                "image_id",
                F.col("c.box_id").alias("box_id"),
                F.col("b.box_id").alias("best_id"),
                better.alias("better"),
            )
        )
        # Every best meets itself, so the final bests come from the same rows.
        final = met.groupBy("image_id", "best_id").agg(F.max("better").alias("blocked")).where(
            ~F.col("blocked")
        )
        gone = met.join(final, ["image_id", "best_id"]).select("image_id", "box_id").distinct()
        winners = final.select("image_id", F.col("best_id").alias("box_id"))
        kept = kept.unionByName(
            remaining.join(winners, ["image_id", "box_id"], "left_semi").select(*BOX)
        )
        remaining = durable(remaining.join(gone, ["image_id", "box_id"], "left_anti"))
    return kept.select(*BOX)
