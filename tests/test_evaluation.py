import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions.numeric import student_tail
from pairforge.functions.resampling import Multiplicities, bases
from pairforge.operators import audit as A
from pairforge.operators import bootstrap as B
from pairforge.operators import contracts as K
from pairforge.operators import effects as E
from pairforge.operators import metrics as M
from pairforge.settings import BootstrapSettings

DDL = (
    "method string, dataset string, weight_id string, unit bigint, y_true int, y_prob double, "
    "y_pred int, aug_seed int, train_seed int"
)


def rows(dataset, y, p, method="m", weight="w", aug=0, train=0):
    return [
        (method, dataset, weight, i, int(a), float(b), int(b >= 0.5), aug, train)
        for i, (a, b) in enumerate(zip(y, p))
    ]


@pytest.fixture(scope="module")
def cohorts(spark):
    rng = np.random.default_rng(5)
    data = []
    for dataset, n in (("val", 40), ("ext_a", 61), ("ext_b", 33)):
        y = rng.integers(0, 2, n)
        for method, lift in (("m", 0.1), ("target", 0.4)):
            for weight in (0, 1):
                p = np.round(np.clip(rng.random(n) * 0.6 + lift * y, 0, 1), 2)
                data += rows(dataset, y, p, method, f"w{weight}", weight, 0)
    return data, spark.createDataFrame(data, DDL)


def test_worked_example(spark):
    df = spark.createDataFrame(rows("d", [0, 0, 1, 1], [0.1, 0.6, 0.7, 0.9]), DDL)
    r = M.all_metrics(df).first()
    assert (r["accuracy"], r["sensitivity"], r["specificity"]) == (0.75, 1.0, 0.5)
    assert r["precision"] == pytest.approx(2 / 3) and r["f1"] == pytest.approx(0.8)
    assert r["auroc"] == 1.0 and r["auprc"] == 1.0


def test_zero_denominators(spark):
    df = spark.createDataFrame(rows("d", [0, 0], [0.1, 0.2]), DDL)
    metrics = M.weight_metrics(df)
    assert metrics.first()["precision"] is None and metrics.first()["sensitivity"] is None
    assert M.zero_filled(metrics).first()["precision"] == 0.0


def test_calibrated_prediction_has_no_error(spark):
    df = spark.createDataFrame(rows("d", [0, 1, 0, 1], [0.5] * 4), DDL)
    assert M.calibration_error(M.order_statistics(df), bins=1).first()["ece"] == 0.0


@pytest.mark.parametrize("n", [7, 10, 23])
def test_calibration_bins_match_array_split(spark, n):
    rng = np.random.default_rng(n)
    y, p = rng.integers(0, 2, n), np.sort(rng.random(n))
    df = spark.createDataFrame(rows("d", y, p), DDL)
    expected = sum(
        len(i) / n * abs(y[i].mean() - p[i].mean()) for i in np.array_split(np.arange(n), min(10, n))
    )
    got = M.calibration_error(M.order_statistics(df.repartition(3))).first()["ece"]
    assert got == pytest.approx(expected)


def test_seed_groups_are_decided_per_method_and_dataset(spark):
    data = rows("d", [1], [0.9], "a", "w0", None, 4) + rows("d", [1], [0.9], "b", "w1", 2, 4)
    groups = {r["method"]: r["seed_group"] for r in M.seed_groups(spark.createDataFrame(data, DDL)).collect()}
    assert groups == {"a": "train_seed_4", "b": "aug_seed_2"}


def test_plan_keeps_stratum_sizes(cohorts):
    data, df = cohorts
    plan = B.resample_plan(df, BootstrapSettings(replicates=8))
    size = {}
    for _, dataset, _, unit, y, *_ in data:
        size.setdefault((dataset, y), set()).add(unit)
    counts = plan.groupBy("replicate", "dataset", "y_true").agg(F.sum("mult").alias("n")).collect()
    assert len(counts) == 8 * len(size)
    assert all(r["n"] == len(size[(r["dataset"], r["y_true"])]) for r in counts)


@pytest.mark.parametrize("block", [3, 200])
def test_replicate_metrics_match_resampled_arrays(cohorts, block):
    data, df = cohorts
    settings = BootstrapSettings(replicates=7, block=block)
    plan = {}
    for r in B.resample_plan(df, settings).collect():
        plan[(r["replicate"], r["dataset"], r["unit"])] = r["mult"]
    got = {
        (r["method"], r["dataset"], r["replicate"], r["metric"]): r["value"]
        for r in B.replicate_metrics(df.repartition(5), settings).collect()
    }
    assert len(got) == 2 * 3 * 7 * 8
    for method, dataset, replicate in (("m", "ext_a", 0), ("target", "ext_b", 6)):
        f1, auroc, auprc = [], [], []
        for weight in ("w0", "w1"):
            drawn = sorted(
                (p, u, y, hit)
                for m, d, w, u, y, p, hit, *_ in data
                if (m, d, w) == (method, dataset, weight)
                for _ in range(plan.get((replicate, d, u), 0))
            )
            y = np.array([row[2] for row in drawn])
            hit = np.array([row[3] for row in drawn])
            tp = ((y == 1) & (hit == 1)).sum()
            f1.append(2 * tp / (y.sum() + hit.sum()))
            ranks = np.arange(1, len(y) + 1)
            pos = y.sum()
            auroc.append((ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))
            down = y[::-1]
            auprc.append((np.cumsum(down) / ranks * down).sum() / pos)
        for metric, value in (("f1", f1), ("auroc", auroc), ("auprc", auprc)):
            assert got[(method, dataset, replicate, metric)] == pytest.approx(np.mean(value))


def test_external_average_ignores_validation(cohorts):
    _, df = cohorts
    boot = B.add_external(B.replicate_metrics(df, BootstrapSettings(replicates=3)), ["ext_a", "ext_b"])
    cells = {(r["method"], r["dataset"], r["replicate"]): r["value"] for r in boot.where("metric = 'f1'").collect()}
    for (method, dataset, replicate), value in cells.items():
        if dataset == M.AVERAGE:
            pair = [cells[(method, d, replicate)] for d in ("ext_a", "ext_b")]
            assert value == pytest.approx(sum(pair) / 2)


def test_smallest_p_value(spark):
    n = 10_000
    boot = spark.range(n).select(
        F.explode(F.array(F.lit("a"), F.lit("t"))).alias("method"),
        F.lit("d").alias("dataset"),
        F.col("id").alias("replicate"),
        F.lit("f1").alias("metric"),
    ).withColumn("value", F.when(F.col("method") == "t", 0.8).otherwise(0.7))
    summary = spark.createDataFrame([("a", "d", "f1", 0.7), ("t", "d", "f1", 0.8)], "method string, dataset string, metric string, mean double")
    row = B.contrasts(boot, summary, "t", BootstrapSettings(replicates=n)).first()
    assert row["p_two_sided"] == pytest.approx(2 / 10001)
    assert row["observed_delta"] == pytest.approx(0.1)


# Published p-values of eight rank tests and their published q-values.
P_VALUES = [0.0022152331567848, 0.0161478991090732, 0.1697069487895826, 0.0096600470712206, 0.0211692664604446, 0.0503169149255528, 0.069875375434309, 0.0004356379889562]
Q_VALUES = [0.0088609326271394, 0.0322957982181465, 0.1697069487895826, 0.0257601255232551, 0.0338708263367114, 0.0670892199007371, 0.0798575719249246, 0.0034851039116497]


def test_false_discovery_reproduces_the_published_values(spark):
    df = spark.createDataFrame(list(enumerate(P_VALUES)), "id int, p_value double")
    got = {r["id"]: r["q_value"] for r in E.false_discovery(df, ["id"]).collect()}
    assert [got[i] for i in range(8)] == pytest.approx(Q_VALUES)


def test_rank_test_against_pair_counting(spark):
    rng = np.random.default_rng(2)
    y, x = rng.integers(0, 2, 60), np.round(rng.random(60), 1)
    df = spark.createDataFrame([("d", "v", int(a), float(b)) for a, b in zip(y, x)], "dataset string, metric string, y_true int, value double")
    r = E.rank_test(df).first()
    wins = sum((a > b) + 0.5 * (a == b) for a in x[y == 0] for b in x[y == 1])
    assert r["u"] == pytest.approx(wins)
    assert r["rank_biserial"] == pytest.approx(2 * wins / ((y == 0).sum() * (y == 1).sum()) - 1)
    assert 0 < r["p_value"] <= 1


def test_rank_biserial_identity():
    assert 2 * 1956 / (54 * 54) - 1 == pytest.approx(0.3415637860082305)


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 9, 80), rng.integers(0, 5, 80)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    row = A.spearman(df, ["g"]).first()
    assert row["rho"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert 0 < row["p_value"] < 1


def test_student_tail_known_points():
    assert student_tail(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert student_tail(1.0, 1) == pytest.approx(0.5)
    assert student_tail(0.0, 5) == 1.0
    assert student_tail(0.01, 1e12) == pytest.approx(0.9920212, abs=1e-7)
    for t in (0.3, 2.0, 6.0):  # both sides of the switch agree
        assert student_tail(t, 10_000.001) == pytest.approx(student_tail(t, 9_999.999), rel=1e-6)


def test_joint_index(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 1.0, 1.0), ("a", 2.0, 2.0)], "dataset string, y double, z double")
    out = {(r["y"], r["z"]): r["joint_index"] for r in E.joint_index(df, "dataset", "y", "z").collect()}
    assert out[(1.0, 3.0)] == pytest.approx(((1.5 / 4) * (3 / 4)) ** 0.5)


def test_prediction_contracts(cohorts, spark):
    data, df = cohorts
    assert K.prediction_gaps(df, ["y_prob"]).count() == 0
    holed = spark.createDataFrame(data[1:] + [(*data[1][:4], 1 - data[1][4], *data[1][5:])], DDL)
    gap = K.prediction_gaps(holed, ["y_prob"]).collect()
    assert [(r["dataset"], r["unit"], r["method"], r["weight_id"]) for r in gap] == [("val", 0, "m", "w0")]
    assert K.outcome_conflicts(holed).count() == 1


def test_repeated_predictions_keep_the_first(spark):
    first = rows("d", [0, 0, 1, 1], [0.1, 0.6, 0.7, 0.9])
    again = [(*r[:5], 1 - r[5], 1 - r[6], *r[7:]) for r in first[1:3]]
    data = [(k, *r) for k, r in enumerate(first)] + [(10 + k, *r) for k, r in enumerate(again)]
    df = spark.createDataFrame(data[::-1], f"row_idx int, {DDL}")
    kept = M.keep_first(df)
    assert sorted(tuple(r) for r in kept.select(df.columns[1:]).collect()) == sorted(first)
    assert M.all_metrics(kept).first() == M.all_metrics(spark.createDataFrame(first, DDL)).first()
    named = M.keep_first(df.withColumn("family", F.lit("f")))
    assert sorted(tuple(r) for r in named.drop("family").collect()) == sorted(first)
    assert M.keep_first(df.limit(0)).count() == 0


def test_weights_must_agree(spark):
    good = rows("d", [0, 1, 1], [0.1, 0.6, 0.7]) + rows("d", [0, 1, 1], [0.3, 0.2, 0.7], weight="v")
    other = good + rows("e", [1, 1], [0.5, 0.5], weight="u")
    assert {(r.dataset, r.weight_id, r.n) for r in M.agreeing_weights(spark.createDataFrame(other, DDL)).collect()} == {("d", "w", 3), ("d", "v", 3), ("e", "u", 2)}
    lost = good[:-1]
    swapped = good[:-1] + [(*good[-1][:3], 7, *good[-1][4:])]
    null = good[:-1] + [(*good[-1][:5], None, *good[-1][6:])]
    for data in (lost, swapped, null):
        with pytest.raises(Exception, match="incomplete prediction grid"):
            M.agreeing_weights(spark.createDataFrame(data, DDL)).collect()
    contrary = good[:-1] + [(*good[-1][:4], 0, *good[-1][5:])]
    with pytest.raises(Exception, match="outcomes differ"):
        M.agreeing_weights(spark.createDataFrame(contrary, DDL)).select("weight_id").collect()


def test_one_sided_seed_groups_fail_whatever_is_read(spark):
    data = rows("a", [0, 1], [0.2, 0.8]) + rows("b", [0, 1], [0.2, 0.8], aug=1)
    df = spark.createDataFrame(data, DDL)
    detail = M.seed_level(M.all_metrics(df), M.seed_groups(df))
    with pytest.raises(Exception, match="one cohort only"):
        M.external_average(detail, "a", "b").select("seed_group", "f1").collect()


@pytest.mark.parametrize("size", [1, 2, 5, 13, 64, 1000, 2500])
def test_multiplicities_follow_the_law_of_draws(size):
    base = bases(3, 0, 400, "d", 1)
    tree = Multiplicities(base, size)
    mult = tree.of(np.arange(size))
    assert (mult.sum(axis=0) == size).all() and (mult >= 0).all()
    some = np.random.default_rng(1).integers(0, size, 30)
    assert (tree.of(some) == mult[some]).all() and (Multiplicities(base[7:9], size).of(some) == mult[some][:, 7:9]).all()
    # Every place is drawn once on average, with the variance of a binomial count.
    assert abs(mult.mean(axis=1) - 1).max() < 6 * np.sqrt(1 / 400)
    assert mult.var() == pytest.approx(1 - 1 / size, abs=0.12)
    if size > 1:
        pairs = np.corrcoef(mult[0], mult[-1])[0, 1]
        assert abs(pairs + 1 / (size - 1)) < 0.25


def test_ten_thousand_replicates(cohorts, spark):
    data, df = cohorts
    settings = BootstrapSettings(replicates=10_000)
    boot = B.replicate_metrics(df.where("method = 'm' and dataset = 'ext_b'"), settings)
    found = {r["replicate"]: r["value"] for r in boot.where("metric = 'f1'").collect()}
    assert sorted(found) == list(range(10_000))
    units = sorted({(r[3], r[4]) for r in data if r[1] == "ext_b"})
    first = {}
    for y in (0, 1):
        mine = [u for u, label in units if label == y]
        first |= dict(zip(mine, Multiplicities(bases(settings.seed, 0, 10_000, "ext_b", y), len(mine)).of(np.arange(len(mine)))))
    for replicate in (0, 199, 200, 9_999):
        f1 = []
        for weight in ("w0", "w1"):
            own = [(r[4], r[6], first[r[3]][replicate]) for r in data if r[:3] == ("m", "ext_b", weight)]
            tp = sum(m for y, hit, m in own if y and hit)
            f1.append(2 * tp / sum(m * (y + hit) for y, hit, m in own))
        assert found[replicate] == pytest.approx(np.mean(f1))


def test_moments_resample_known_values(spark):
    data = [("d", "x", u, int(u % 2), None if u % 5 == 0 else u * 0.5) for u in range(41)] + [(None, "x", 1, 0, 2.0), (None, "x", 2, 1, 3.0)]
    values = spark.createDataFrame(data, "dataset string, metric string, unit bigint, y_true int, value double")
    settings = BootstrapSettings(replicates=450)
    rows = B.group_moments(values, settings).collect()
    known = [r for r in data if r[4] is not None]
    for r in rows:
        mine = sorted((u, x) for d, _, u, y, x in known if (d, y) == (r["dataset"], r["y_true"]))
        assert r["n"] == len(mine)
        mult = [1] * len(mine)
        if r["replicate"] is not None:
            name = "x" if r["dataset"] is None else "d:x"
            mult = Multiplicities(bases(settings.seed, r["replicate"], 1, name, r["y_true"]), len(mine)).of(np.arange(len(mine)))[:, 0]
        assert r["s"] == pytest.approx(sum(m * x for m, (_, x) in zip(mult, mine)))
    assert len(rows) == 4 * 451
    table = B.effect_table(values, settings).collect()
    assert len(table) == 2 and all(t["mean_difference_ci_low"] is not None for t in table)


def test_null_groups_keep_their_quartiles(spark):
    data = [(None, "x", 0, float(v)) for v in range(5)] + [("d", "x", 0, 7.0)]
    out = E.describe(spark.createDataFrame(data, "dataset string, metric string, y_true int, value double"))
    assert {(r.dataset, r.q1, r["median"], r.q3) for r in out.collect()} == {(None, 1.0, 2.0, 3.0), ("d", 7.0, 7.0, 7.0)}


def test_keep_first_deals_many_predictions_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "KEPT_ROWS", 20)
    data = [(0, *r) for r in rows("d", [0, 1] * 100, [0.4] * 200)] + [(1, *r) for r in rows("d", [1, 0] * 100, [0.9] * 200)]
    kept = M.keep_first(spark.createDataFrame(data, f"row_idx int, {DDL}"))
    assert len(kept.inputFiles()) > 4
    assert sorted((r["unit"], r["y_true"], r["y_prob"]) for r in kept.collect()) == [(i, i % 2, 0.4) for i in range(200)]


def test_resample_plan_is_never_broadcast(spark):
    plan = B.resample_plan(spark.createDataFrame(rows("d", [0, 1] * 50, [0.4] * 100), DDL), BootstrapSettings(replicates=8))
    assert sum(r["mult"] for r in plan.collect()) == 800
    joins = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0] and "place" in joins[0]


def test_keep_first_deals_by_rows_where_bytes_would_merge_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "KEPT_ROWS", 150)
    data = [(k, *r) for k in (0, 1) for r in rows("d", [k, 1 - k] * 100, [0.4 + 0.5 * k] * 200)]
    kept = M.keep_first(spark.createDataFrame(data, f"row_idx int, {DDL}"))
    assert len(kept.inputFiles()) >= 3
    assert sorted((r["unit"], r["y_true"], r["y_prob"]) for r in kept.collect()) == [(i, i % 2, 0.4) for i in range(200)]


def test_tosses_of_a_large_stratum_are_taken_many_at_once(monkeypatch):
    from pairforge.functions import resampling as P

    base, calls = bases(1, 0, 3, "d", 1), []
    mixed = P._mixed
    monkeypatch.setattr(P, "_mixed", lambda x: calls.append(1) or mixed(x))
    many = P.heads(base, np.array([1, 2]), 5, np.full((2, 3), 100_000))
    assert len(calls) < 100
    monkeypatch.setattr(P, "HASHES", 1)
    assert (many == P.heads(base, np.array([1, 2]), 5, np.full((2, 3), 100_000))).all()


def test_slices_that_do_not_fit_take_fewer_replicates_at_once(cohorts, monkeypatch):
    _, df = cohorts
    settings = BootstrapSettings(replicates=30)
    whole = {tuple(r[:4]): r["value"] for r in B.replicate_metrics(df, settings).collect()}
    assert len(B._slice_blocks(settings, 1000)) == 1
    monkeypatch.setattr(B, "SLICE_BYTES", 100)
    assert len(B._slice_blocks(settings, 50)) == 30
    assert whole == {tuple(r[:4]): r["value"] for r in B.replicate_metrics(df, settings).collect()}


def test_counts_of_coins_stay_small_below_the_known_nodes(monkeypatch):
    """Wide counts would move eight bytes a node and replicate through every level."""
    from pairforge.functions import resampling as P

    monkeypatch.setattr(P, "KNOWN", 16)
    size, base = 5000, P.bases(3, 0, 7, "val", 1)
    tree, seen, plain = P.Multiplicities(base, size), [], P.heads

    def watched(base, node, kind, tosses):
        seen.append((tosses.dtype.itemsize, int(tosses.max(initial=0))))
        return plain(base, node, kind, tosses)

    monkeypatch.setattr(P, "heads", watched)
    mult = tree.of(np.arange(size), np.uint16)
    assert (mult.sum(axis=0) == size).all() and mult.dtype == np.uint16
    assert seen and all(width == (1 if most < 256 else 2) for width, most in seen)
