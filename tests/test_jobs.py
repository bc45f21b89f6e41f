import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import augment as G
from pairforge.operators import contracts as K
from pairforge.operators import representation as R
from pairforge.operators import selection as S
from pairforge.operators.detections import suppress
from pairforge.settings import DeletionSettings, TokenEditSettings
from pairforge.sources import files, tables


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(
        [(0, "a sailor mends the net", 1), (1, "rain falls", 0), (2, "!!", 0)],
        "source_id bigint, text1 string, label int",
    )


@pytest.fixture(scope="module")
def synonyms(spark):
    return spark.createDataFrame([("sailor", ["seaman"]), ("net", ["mesh"])], "word string, synonyms array<string>")


def test_training_table_has_two_variants_per_source(texts, synonyms):
    table = G.training_table(texts, synonyms, [1, 2]).collect()
    assert Counter((r["source_id"], r["seed"]) for r in table) == {(0, 1): 2, (0, 2): 2, (1, 1): 2, (1, 2): 2, (2, 1): 1, (2, 2): 1}
    assert {r["aug_index"] for r in table} == {0, 1}
    full = G.training_table(texts.where("source_id = 0"), synonyms, [1], TokenEditSettings(include_original=True)).collect()
    assert [r["text1"] for r in full if r["is_original"]] == ["a sailor mends the net"]


def test_techniques(texts, synonyms):
    rows = {r["technique"]: r["text"] for r in G.edited_texts(texts.where("source_id = 0"), synonyms, [5]).collect()}
    words = Counter("a sailor mends the net".split())
    assert Counter(rows["swap"].split()) == words and rows["swap"] != "a sailor mends the net"
    replaced = Counter(rows["replace"].split())
    assert sum((replaced - words).values()) == 1 and set(replaced - words) <= {"seaman", "mesh"}
    inserted = rows["insert"].split()
    assert len(inserted) in (5, 6) and inserted[-1] == "net"
    assert set(rows["delete"].split()) <= set(words) and rows["delete"]


@pytest.mark.parametrize("partitions", [1, 5])
def test_augmentation_does_not_depend_on_partitions(texts, synonyms, partitions):
    base = sorted(map(tuple, G.training_table(texts, synonyms, [3]).collect()))
    assert sorted(map(tuple, G.training_table(texts.repartition(partitions), synonyms, [3]).collect())) == base


def test_deletion_negatives(spark, texts):
    records = G.deletion_negatives(texts.where("source_id = 0"), 1).collect()
    assert len(records) == 3 and all(len(r["negative_texts"]) == 3 for r in records)
    always = DeletionSettings(n_aug=2, probability=1.0, allow_empty=False)
    kept = G.deletion_negatives(texts.where("source_id = 0"), 1, always).collect()
    assert all(len(t.split()) == 1 for r in kept for t in r["negative_texts"])
    empty = G.deletion_negatives(texts.where("source_id = 0"), 1, DeletionSettings(probability=1.0)).first()
    assert empty["negative_texts"] == ["", "", ""]


def test_deletion_rate(spark):
    long = spark.createDataFrame([(0, "w " * 20000, 1)], "source_id bigint, text1 string, label int")
    text = G.deletion_negatives(long, 9, DeletionSettings(n_aug=1, n_neg=1)).first()["negative_texts"][0]
    assert abs(len(text.split()) / 20000 - 0.7) < 0.02


def greedy(boxes, limit=0.5, min_score=0.2):
    kept = []
    for b in sorted((b for b in boxes if b[6] > min_score), key=lambda b: (-b[6], b[1])):
        def overlap(k):
            wide = max(0, min(k[4], b[4]) - max(k[2], b[2]))
            high = max(0, min(k[5], b[5]) - max(k[3], b[3]))
            union = (k[4] - k[2]) * (k[5] - k[3]) + (b[4] - b[2]) * (b[5] - b[3]) - wide * high
            return wide * high > limit * union
        if not any(k[0] == b[0] and overlap(k) for k in kept):
            kept.append(b)
    return {(b[0], b[1]) for b in kept}


@pytest.mark.parametrize("group_limit", [5000, 20])
def test_suppression_matches_the_greedy_scan(spark, group_limit):
    """With a small limit, the crowded image takes the grid rounds."""
    rng = np.random.default_rng(4)
    boxes = []
    for image, n in ((1, 120), (2, 5)):
        for i in range(n):
            x, y, w, h = rng.random(4) * [40, 40, 30, 30] + [0, 0, 8, 8]
            boxes.append((image, f"{i:03d}", float(x), float(y), float(x + w), float(y + h), round(float(rng.random()), 2)))
    boxes += [(1, f"copy{i}", *boxes[0][2:6], 0.9) for i in range(30)]
    ddl = "image_id bigint, box_id string, x0 double, y0 double, x1 double, y1 double, score double"
    out = suppress(spark.createDataFrame(boxes, ddl), group_limit=group_limit)
    assert {(r["image_id"], r["box_id"]) for r in out.collect()} == greedy(boxes)


@pytest.mark.parametrize("group_limit", [5000, 1])
def test_suppression_keeps_boxes_without_area(spark, group_limit):
    """Flat, inverted and unknown boxes stay on both sides of the limit; equal boxes stay at 1."""
    solid = [(1, "a", 0.0, 0.0, 4.0, 4.0, 0.9), (1, "b", 0.0, 0.0, 4.0, 4.0, 0.8)]
    empty = [
        (1, "c", 1.0, 1.0, 1.0, 1.0, 0.7),
        (1, "d", 1.0, 1.0, 1.0, 1.0, 0.7),
        (1, "e", 4.0, 4.0, 0.0, 0.0, 0.7),
        (1, "f", None, 0.0, 4.0, 4.0, 0.7),
    ]
    ddl = "image_id bigint, box_id string, x0 double, y0 double, x1 double, y1 double, score double"
    boxes = spark.createDataFrame(solid + empty, ddl)
    ids = lambda df: sorted(r["box_id"] for r in df.collect())
    assert ids(suppress(boxes, group_limit=group_limit)) == ["a", "c", "d", "e", "f"]
    assert ids(suppress(boxes, max_iou=1.0, group_limit=group_limit)) == list("abcdef")
    with pytest.raises(ValueError):
        suppress(boxes, max_iou=0.0, group_limit=group_limit)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_nearest_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(8)
    q, r = rng.normal(size=(40, 6)), rng.normal(size=(70, 6))
    r[10] = r[3]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vec array<double>")
    refs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "ref_id bigint, vec array<double>")
    got = {}
    for row in R.nearest(queries, refs, 5, block_rows=block_rows).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row["ref_id"]
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    distance = np.round(1 - unit(q) @ unit(r).T, 9)
    for i in range(40):
        assert [got[i][k] for k in range(1, 6)] == sorted(range(70), key=lambda j: (distance[i, j], j))[:5]


def test_held_out_regression_uses_other_folds_only(spark):
    points = spark.createDataFrame(
        [(0, 1, 0, 0.0, 0.0, 5.0), (1, 1, 1, 0.0, 1.0, 1.0), (2, 1, 1, 0.0, 2.0, 4.0), (3, 0, 1, 0.0, 0.0, 99.0), (4, 1, 0, 0.0, 0.1, 77.0)],
        "point_id bigint, label int, fold int, dim1 double, dim2 double, value double",
    )
    out = {r["point_id"]: r["predicted"] for r in R.held_out_regression(points).collect()}
    assert out[0] == pytest.approx((1.0 / 1 + 4.0 / 2) / (1 / 1 + 1 / 2))


def metric_rows(spark, rows):
    return spark.createDataFrame(rows, "checkpoint string, epoch int, dataset_role string, metric_name string, metric_value double")


def test_selection_ties_and_firewall(spark):
    base = [("e1.pt", 1, "CV-validation", "accuracy", 0.8), ("e1.pt", 1, "cv_validation", "f1", 0.78), ("e2.pt", 2, "cv_validation", "accuracy", 0.8), ("e2.pt", 2, "cv_validation", "f1", 0.82)]
    assert S.select_checkpoint(metric_rows(spark, base), "cv_validation", "accuracy", "f1").first()["checkpoint"] == "e2.pt"
    assert S.select_checkpoint(metric_rows(spark, base), "cv_validation", "accuracy").first()["checkpoint"] == "e1.pt"
    for role in ("external", "adress_validation"):
        with pytest.raises(ValueError):
            S.select_checkpoint(metric_rows(spark, base + [("x", 1, role, "accuracy", 0.1)]), "cv_validation", "accuracy")
    with pytest.raises(ValueError):
        S.select_checkpoint(metric_rows(spark, base), "external", "accuracy")


def test_early_stop(spark):
    history = spark.createDataFrame(
        [("a", i, acc, f1) for i, (acc, f1) in enumerate([(0.5, 0.5), (0.6, 0.4), (0.6, 0.5), (0.6, 0.5), (0.5, 0.9), (0.9, 0.9)], 1)],
        "checkpoint string, epoch int, accuracy double, f1 double",
    )
    assert tuple(S.early_stop(history, 2).first())[1:3] == (3, 5)
    assert tuple(S.early_stop(history, 2, use_f1=False).first())[1:3] == (2, 4)


def test_run_manifest(spark):
    grid = [(g, c, f"o{g}{c}", "cv_validation", None, None) for g in range(5) for c in range(5)]
    ddl = "generation_seed int, classifier_seed int, checkpoint_output string, validation_role string, training_mode string, shuffle_seed_source string"
    assert K.validate_run_manifest(spark.createDataFrame(grid, ddl)).count() == 0
    broken = grid[1:] + [(1, 1, "o11", "pitt", "mixed", "x")]
    found = {r["check"] for r in K.validate_run_manifest(spark.createDataFrame(broken, ddl)).collect()}
    assert found == {"missing_run", "shared_output", "role", "training_mode", "shuffle_source"}


def test_checked_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    twice = spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    with pytest.raises(ValueError):
        K.checked_join(left, twice, ["k"], "many_to_one")
    assert K.checked_join(left, twice, ["k"], "one_to_many").count() == 2
    with pytest.raises(ValueError):
        K.complete_left_join(left, twice, ["k"], "y")


def test_region_files(spark, tmp_path):
    item = {"bbox": [0, 1, 2, 3]}
    for name, content in (("list", [{"name": "cup", **item}, item]), ("wrapped", {"ius": [item]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
    rows = tables.read_regions(spark, str(tmp_path / "list.json")).collect()
    assert [r["name"] for r in rows] == ["cup", "IU_1"]
    assert tables.read_regions(spark, str(tmp_path / "wrapped.json")).first()["name"] == "IU_0"
    for content in ("[]", '[{"bbox": [1, 2]}]'):
        (tmp_path / "bad.json").write_text(content)
        with pytest.raises(ValueError):
            tables.read_regions(spark, str(tmp_path / "bad.json"))


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"source_id": 1, "candidate_text": "x"}\n\n   \n{"source_id": 2}\n')
    assert tables.read_candidates(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "m.csv").write_text("﻿run,role\n1,a\n", encoding="utf-8")
    assert tables.read_manifest(spark, str(tmp_path / "m.csv"), ["run", "role"]).first()["run"] == "1"
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "m.csv"), ["absent"])
    bad = spark.createDataFrame([(1, "t", 2)], "source_id int, text1 string, label int")
    with pytest.raises(ValueError):
        tables.labelled_table(bad)
    numbered = tables.labelled_table(
        spark.createDataFrame([("b", 1), ("a", 0)], "text1 string, label int"), order=["text1"]
    )
    assert {(r["text1"], r["source_id"]) for r in numbered.collect()} == {("a", 0), ("b", 1)}


def test_file_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "outputs").mkdir()
    for name in ("a.txt", "sub/b.txt", "outputs/c.txt"):
        (tmp_path / name).write_text(name)
    found = files.file_manifest(spark, str(tmp_path))
    assert {r["path"] for r in found.collect()} == {"a.txt", "sub/b.txt"}
    recorded = found.select("path", F.when(F.col("path") == "a.txt", "0").otherwise(F.col("sha256")).alias("sha256"))
    assert [tuple(r)[:2] for r in files.verify_manifest(recorded, found).collect()] == [("a.txt", "0")]


def test_files_larger_than_a_column_are_hashed(spark, tmp_path, monkeypatch):
    size, block = (2 << 30) + 5, bytes(1 << 20)
    with (tmp_path / "two words.bin").open("wb") as sparse:
        sparse.truncate(size)
    digest = hashlib.sha256()
    for at in range(0, size, len(block)):
        digest.update(block[: size - at])
    found = files.file_manifest(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("two words.bin", size, digest.hexdigest())]
    (tmp_path / "two words.bin").unlink()
    for name in "ab":
        (tmp_path / name).write_text(name)
    whole = files.content_digest(spark, str(tmp_path))
    monkeypatch.setattr(files, "HELD_BYTES", 0)
    assert files.content_digest(spark, str(tmp_path)) == whole


def test_missing_role_fails_the_selection(spark):
    rows = [("a", 1, "cv_validation", "accuracy", 0.5), ("b", 2, None, "accuracy", 0.9)]
    with pytest.raises(Exception, match="other roles"):
        S.select_checkpoint(metric_rows(spark, rows), "cv_validation", "accuracy")
    assert S.select_checkpoint(metric_rows(spark, rows[:1]), " CV_Validation", "Accuracy").first()["checkpoint"] == "a"


def test_references_are_not_written_once_per_small_block(spark):
    rows = spark.range(3000).select(F.col("id").alias("query_id"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    n_query, n_ref = R.search_parts(rows, rows)
    assert n_ref == 1 and n_query <= spark.sparkContext.defaultParallelism


def test_the_larger_side_of_a_search_is_not_repeated_for_every_core():
    wide, many = (20_000, 64, True), (42_384, 64, True)
    n_query, n_ref = R._grid(wide, many, 10, 8)
    assert n_query * n_ref >= 8 and 20_000 * n_ref + 42_384 * n_query < 20_000 + 42_384 * 8
    assert R._grid(many, (5, 64, True), 10, 8) == (8, 1)


@pytest.mark.parametrize("single", [True, False])
def test_single_precision_is_written_only_where_it_is_exact(spark, single):
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(900, 16)).astype(np.float32 if single else np.float64).astype(np.float64)
    flat = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(spots)], "id bigint, vec array<double>")
    assert R._sizes(flat) == (900, 16, single) and R._sizes(flat.limit(0))[0] == 0
    found = R.nearest(flat.withColumnRenamed("id", "query_id"), flat.withColumnRenamed("id", "ref_id"), 3).collect()
    unit = spots / np.linalg.norm(spots, axis=1)[:, None]
    distance = np.round(1 - unit @ unit.T, 9)
    got = {(r["query_id"], r["rank"]): r["ref_id"] for r in found}
    for i in range(900):
        assert [got[i, k] for k in (1, 2, 3)] == np.lexsort((np.arange(900), distance[i]))[:3].tolist()


@pytest.mark.parametrize("task_bytes", [1 << 25, 2048])
def test_short_vectors_with_ties_and_filters_match_brute_force(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(R, "TASK_BYTES", task_bytes)
    rng = np.random.default_rng(4)
    spots = np.round(rng.normal(size=(700, 2)), 1)
    labels, folds = rng.integers(0, 2, 700), rng.integers(0, 3, 700)
    data = [(i, [float(a) for a in p], int(x), int(f)) for i, (p, x, f) in enumerate(zip(spots, labels, folds))]
    flat = spark.createDataFrame(data, "id bigint, vec array<double>, label int, fold int")
    found = R.nearest(
        flat.withColumnRenamed("id", "query_id"), flat.withColumnRenamed("id", "ref_id"), 7,
        metric="euclidean", within="label", across="fold", block_rows=64,
    ).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["ref_id"])
    for i in range(700):
        distance = np.round(np.sqrt(((spots[i] - spots) ** 2).sum(axis=1)), 9)
        allowed = np.flatnonzero((labels == labels[i]) & (folds != folds[i]))
        assert got[i] == [int(j) for j in allowed[np.lexsort((allowed, distance[allowed]))][:7]]


def test_rates_of_shared_vectors_equal_those_of_every_query(spark):
    rng = np.random.default_rng(6)
    refs = spark.createDataFrame([(i, [float(a) for a in v], int(i % 2)) for i, v in enumerate(rng.normal(size=(60, 4)))], "ref_id bigint, vec array<double>, label int")
    own = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(9, 4)))], "query_id bigint, vec array<double>")
    rates = {(r["query_id"], r["label"]): r["opposite_rate"] for r in R.opposite_rates(own, refs, (0, 1), 5).collect()}
    for label in (0, 1):
        each = R.knn_contamination(own.withColumn("label", F.lit(label)), refs, 5).collect()
        assert {r["query_id"]: r["opposite_rate"] for r in each} == {q: x for (q, y), x in rates.items() if y == label}


def test_shared_vectors_are_searched_once(spark, monkeypatch):
    import numpy as np

    draw, searched, real = np.random.default_rng(3), [], R.nearest

    def counted(queries, references, k, **options):
        searched.append(references.count())
        return real(queries, references, k, **options)

    monkeypatch.setattr(R, "nearest", counted)
    matrix = draw.normal(size=(40, 6)).round(3)
    matrix[7] = matrix[3]  # a tie between vectors, which ids decide
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id bigint, vec array<double>")
    pairs = [(int(r), int(draw.integers(0, 30)) if r % 3 else 3) for r in draw.permutation(200)]  # vector 3 is crowded
    refs = spark.createDataFrame(pairs, "ref_id bigint, vec_id bigint")
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    found = R.nearest_shared(queries, refs, vectors, 10).collect()
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    away = np.round(1 - unit @ unit.T, 9)
    for q in range(40):
        want = [r for _, r in sorted((away[q, v], r) for r, v in pairs)[:10]]
        assert [r["ref_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert searched == [len({v for _, v in pairs})]


def test_held_out_models_read_their_points_once(spark):
    draw, read = np.random.default_rng(8), spark.sparkContext.accumulator(0)
    rows = [(i, int(i % 2), int(i % 5), *(float(x) for x in draw.normal(size=2)), float(draw.uniform())) for i in range(200)]

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ddl = "point_id bigint, label int, fold int, dim1 double, dim2 double, value double"
    points = spark.createDataFrame(rows, ddl).mapInArrow(counted, ddl)
    assert R.held_out_classifier(points).count() == 2
    assert read.value == 200
    assert R.held_out_regression(points, 5).count() == 200
    assert read.value == 400


def test_coarse_products_lose_no_neighbour(monkeypatch):
    draw, ids = np.random.default_rng(9), np.arange(4000)
    base = draw.normal(size=(40, 16))
    refs = np.repeat(base, 100, axis=0) + draw.normal(size=(4000, 16)) * 1e-5  # closer than single precision tells
    refs[:7] = np.nan
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    queries = refs[draw.permutation(4000)[:50]]
    queries = queries[~np.isnan(queries[:, 0])]
    away = 1.0 - queries @ refs.T
    monkeypatch.setattr(R, "PAIR_BYTES", 1000)
    best = R._Nearest(len(queries), 10)
    for at in (0, 5, 300, 1500):
        part = slice(at, {0: 5, 5: 300, 300: 1500, 1500: 4000}[at])
        best.add_cosines(queries, refs[part], queries.astype(np.float32), refs[part].astype(np.float32), ids[part])
    for i in range(len(queries)):
        shown = np.round(np.where(np.isnan(away[i]), np.inf, away[i]), R.TIE_DIGITS)
        assert (best.ref[best.row == i] == np.lexsort((ids, shown))[:10]).mean() > 0.99, i
        assert np.allclose(np.sort(best.distance[best.row == i]), np.sort(away[i][~np.isnan(away[i])])[:10], atol=2e-9)
