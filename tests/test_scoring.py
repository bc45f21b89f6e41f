import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import bands as B
from pairforge.operators import coverage as C
from pairforge.operators import residual as R
from pairforge.operators.embed import embed_texts
from pairforge.settings import ScoringSettings


def test_breadth_and_depth(spark):
    df = spark.createDataFrame([("a", s) for s in (0.18, 0.20, 0.25)] + [("b", 0.1)], "text_id string, final_score double")
    rows = {r["text_id"]: r for r in C.breadth_depth(df).collect()}
    assert rows["a"]["breadth"] == pytest.approx(2 / 3)
    assert rows["a"]["depth"] == pytest.approx(0.035)
    assert (rows["b"]["breadth"], rows["b"]["depth"]) == (0.0, 0.0)
    array = spark.createDataFrame([([0.18, 0.20, 0.25],), ([],)], "s array<double>")
    out = array.select(*C.breadth_depth_arrays(F.col("s"))).collect()
    assert out[0][1] == pytest.approx(0.035) and tuple(out[1]) == (0.0, 0.0)


def test_fusion(spark):
    df = spark.createDataFrame([(0.1, 0.3), (0.2, 0.4)], "global_score double, chunk_score double")
    assert [r[0] for r in C.fuse_scores(df).select("final_score").collect()] == pytest.approx([0.26, 0.36])
    with pytest.raises(ValueError):
        ScoringSettings(chunk_weight=1.1)


def test_residual_of_the_direction_vanishes(spark):
    rows = [([2.0, 0.0], 1), ([4.0, 0.0], 1), ([-2.0, 0.0], 0), ([-4.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec array<double>, label int")
    fit = R.fit_projection(df)
    assert fit.center == pytest.approx((0.0, 0.0)) and fit.direction == pytest.approx((1.0, 0.0))
    pairs = spark.createDataFrame([([1.0, 1.0], [-1.0, 2.0]), ([3.0, 0.0], [1.0, 5.0])], "a array<double>, b array<double>")
    out = [r[0] for r in pairs.select(R.residual_cosine(fit, F.col("a"), F.col("b"))).collect()]
    assert out == pytest.approx([1.0, 1.0])


def test_projection_needs_both_labels_and_a_direction(spark):
    same = spark.createDataFrame([([1.0], 1), ([1.0], 0)], "vec array<double>, label int")
    with pytest.raises(ValueError):
        R.fit_projection(same)
    with pytest.raises(ValueError):
        R.fit_projection(same.where("label = 1"))


def test_bands_are_mirrored(spark):
    sources = spark.createDataFrame([(1, 10.0, 20.0), (0, 10.0, 20.0)], "label int, breadth double, depth double")
    stats = spark.createDataFrame([(0, 2.0, 4.0), (1, 2.0, 4.0)], "label int, y_scale double, z_scale double")
    rows = {r["label"]: r for r in B.with_bands(sources, stats).collect()}
    assert (rows[1]["y_upper"], rows[1]["y_lower"]) == pytest.approx((10.8, 8.0))
    assert (rows[0]["y_upper"], rows[0]["y_lower"]) == pytest.approx((12.0, 9.2))
    assert (rows[1]["z_upper"], rows[1]["z_lower"]) == pytest.approx((21.6, 16.0))


def test_violation_and_buckets(spark):
    row = (1, 0.7, 0.1, 0.5, 0.1, 0.1, 0.2, 0.05, 0.05, 0.139)
    ddl = (
        "label int, candidate_y double, candidate_z double, breadth double, depth double, "
        "eps_y_plus double, eps_y_minus double, eps_z_plus double, eps_z_minus double, residual_cos double"
    )
    out = B.evaluate_candidates(spark.createDataFrame([row, (*row[:1], 0.5, *row[2:9], 0.14)], ddl)).collect()
    assert not out[0]["yz_pass"] and out[0]["y_violate_high"] == pytest.approx(1.0)
    assert out[0]["x_pass"] and out[0]["bucket_name"] == "yz_fail_x_pass"
    assert out[1]["yz_pass"] and not out[1]["x_pass"] and out[1]["bucket_id"] == 1


def test_class_statistics_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 2, float(y), float(z)) for i, (y, z) in enumerate(rng.random((301, 2)))]
    df = spark.createDataFrame(rows, "label int, breadth double, depth double")
    for r in B.class_statistics(df).collect():
        y = np.array([b for a, b, _ in rows if a == r["label"]])
        mad = 1.4826 * np.median(np.abs(y - np.median(y)))
        assert r["y_center"] == pytest.approx(np.median(y)) and r["y_scale"] == pytest.approx(mad)
        assert r["y_upper_risk"] == pytest.approx(np.quantile(y, 0.9))


def test_region_inventory_must_not_be_empty(spark):
    empty = spark.createDataFrame([], "region int, vec array<double>")
    with pytest.raises(ValueError):
        C.region_similarity(empty, empty, empty)


def test_embedding_hook(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "a b")], "id int, text string")
    rows = {r["id"]: r["vec"] for r in embed_texts(df, "id", "text", batch_size=2).collect()}
    assert rows[1] == rows[3] and len(rows[1]) == 64
    assert np.linalg.norm(rows[1]) == pytest.approx(1.0) and np.linalg.norm(rows[2]) == 0.0


def test_equal_pairs_have_equal_residual_cosines_wherever_they_stand(spark):
    rng = np.random.default_rng(0)
    fit = R.Projection(tuple(rng.normal(size=64)), tuple(rng.normal(size=64) / 8))
    pairs = [([float(x) for x in rng.normal(size=64)], [float(x) for x in rng.normal(size=64)]) for _ in range(61)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs) for _ in range(11)], "i int, a array<double>, b array<double>")
    out = df.coalesce(1).select("i", R.residual_cosine(fit, F.col("a"), F.col("b")).alias("x")).distinct().collect()
    assert len(out) == 61
