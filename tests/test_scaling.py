import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import scaling as S


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value many of them."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(x), i) for i, x in enumerate(np.round(rng.normal(size=3000), 2))]
    rows += [("hot", 0.5, 3000 + i) for i in range(1500)]
    rows += [("cold", float(x), 9000 + i) for i, x in enumerate(rng.normal(size=37))]
    rows += [("one", 4.0, 9999)]
    return rows, spark.createDataFrame(rows, "g string, x double, id int")


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_exact_quantiles(skewed, partitions):
    rows, df = skewed
    out = S.exact_quantiles(
        df.repartition(partitions), ["g"], "x", {"a": 0.1, "m": 0.5, "z": 0.975}
    )
    for r in out.collect():
        values = [x for g, x, _ in rows if g == r["g"]]
        assert np.allclose([r["a"], r["m"], r["z"]], np.quantile(values, [0.1, 0.5, 0.975]))


def test_running_totals_and_following_minimum(skewed):
    rows, df = skewed
    totals = S.running_totals(df, ["g"], ["x", "id"], {"n": F.lit(1)})
    low = S.following_minimum(
        df.withColumn("v", F.col("id") % 101), ["g"], ["x", "id"], "v", "low"
    )
    places = {r["id"]: (r["n_before"], r["n_all"]) for r in totals.collect()}
    lows = {r["id"]: r["low"] for r in low.collect()}
    for group in ("hot", "cold", "one"):
        ordered = sorted((x, i) for g, x, i in rows if g == group)
        best = None
        for place in range(len(ordered) - 1, -1, -1):
            key = ordered[place][1]
            best = key % 101 if best is None else min(best, key % 101)
            assert places[key] == (place, len(ordered))
            assert lows[key] == best


def test_running_totals_deal_rows_once_behind_the_slices(spark):
    """The offsets of the slices are no join, which would deal and sort all rows once more."""
    groups = [("a", None), (None, 1), (None, None), ("a", 1)]
    rows = [(g, h, i % 7, i) for i in range(400) for g, h in groups]
    df = spark.createDataFrame(rows, "g string, h int, x int, id int")
    placed = S.running_totals(df, ["g", "h"], ["x", "id"], {"n": F.lit(1), "s": F.col("x")}, 9)
    assert "Join" not in placed._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["g"], r["h"], r["id"]): (r["n_before"], r["s_before"], r["n_all"], r["s_all"]) for r in placed.collect()}
    assert len(got) == len(rows)
    for g, h in groups:
        before, total = 0, sum(i % 7 for i in range(400))
        for place, (x, i) in enumerate(sorted((i % 7, i) for i in range(400))):
            assert got[g, h, i] == (place, before, 400, total)
            before += x


def test_mid_ranks(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 5.0), (1, None)], "g int, x double")
    ranks = {r["x"]: r["mid_rank"] for r in S.mid_ranks(df, ["g"], "x").collect()}
    assert ranks == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_salted_join_equals_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
        assert sorted(map(tuple, S.salted_join(big, small, ["k"], how).collect()), key=str) == plain


def test_top_k_is_pruned_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = S.top_k(df, ["g"], [F.col("id")], 3, "r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_large_k_is_exact_without_one_task_per_group(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 5003).alias("x"))
    out = S.top_k(df, ["g"], [F.col("x").desc()], 1500, "r").collect()
    for group in (0, 1):
        values = sorted(((i * 7919) % 5003 for i in range(5000) if i % 2 == group), reverse=True)[:1500]
        assert sorted((r["r"], r["x"]) for r in out if r["g"] == group) == list(enumerate(values, 1))


def test_null_groups_stay_on_both_sides_of_the_group_limit(spark):
    rows = [(None if i % 3 == 0 else "g", float(i * 7 % 31), i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    order = [F.desc("v"), F.asc("i")]
    few = {tuple(r) for r in S.top_k(df, ["g"], order, S.GROUP_LIMIT, "rank").collect()}
    many = {tuple(r) for r in S.top_k(df, ["g"], order, S.GROUP_LIMIT + 1, "rank").select("g", "v", "i", "rank").collect()}
    assert few == many and len(few) == 60
    medians = {r.g: r.q for r in S.exact_quantiles(df, ["g"], "v", {"q": 0.5}).collect()}
    assert set(medians) == {None, "g"}


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SCAN_ROWS", 50)
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    dealt = S.spread(spark.read.parquet(str(tmp_path / "t")))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 60


def test_numbered_slices_are_cut_as_parquet(spark):
    rows = spark.range(1000).select(F.lit("a long name of a weight").alias("g"), (F.col("id") * 37 % 1000).alias("x"))
    cut = S.slices(rows, ["g"], ["x"], 4)
    assert cut.inputFiles() and all(f.endswith(".parquet") for f in cut.inputFiles())
    ends = cut.groupBy("_slice").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy("_slice").collect()
    assert sum(r["n"] for r in ends) == 1000 and len(ends) > 1
    assert all(a["high"] < b["low"] for a, b in zip(ends, ends[1:]))
