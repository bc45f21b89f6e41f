import pytest
from pyspark.sql import functions as F

from pairforge.operators import pairs as P
from pairforge.operators.contracts import pair_summary, validate_pairs
from pairforge.operators.preference import preference_records
from pairforge.plans.pairing import MINIMAL, build_pairs
from pairforge.settings import PairSettings, PoolSettings
from pairforge.sources.tables import write_table

DDL = (
    "source_id bigint, ordinal int, candidate_text string, yz_pass boolean, residual_cos double, "
    "yz_utilization double, yz_violation_score double, origin_cos double, bucket_name string, "
    "bucket_id int, prompt_type string"
)


def candidate(ordinal, passes, residual, utilization=0.5, violation=0.0, text=None, source=1):
    bucket = 0 if passes else 3
    return (source, ordinal, text or f"text {ordinal}", passes, residual, utilization, violation, 0.8, f"b{bucket}", bucket, "chosen_prompt")


@pytest.fixture(scope="module")
def pool(spark):
    rows = [candidate(i, True, i / 100) for i in range(1, 7)]
    rows += [candidate(6 + i, False, 0.4, 0.1, float(i + 1)) for i in range(1, 7)]
    rows += [candidate(20, True, 0.01, text="  TEXT   1 "), candidate(21, True, 0.0, text="  ")]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(1, "anchor", 1), (2, "lonely", 0)], "source_id bigint, text1 string, label int")


def test_margin(spark):
    columns = ("yz_pass", "residual_cos", "yz_utilization", "yz_violation")
    df = spark.createDataFrame(
        [(True, 0.05, 0.8, 0.0, False, 0.40, 0.1, 2.0)],
        ", ".join(f"{s}{c} {'boolean' if c == 'yz_pass' else 'double'}" for s in "cr" for c in columns),
    )
    assert df.select(P.pair_margin("c", "r")).first()[0] == pytest.approx(15.4)
    assert df.select(P.strictly_worse("c", "r")).first()[0]
    assert not df.select(P.strictly_worse("r", "c")).first()[0]


def test_six_by_six(spark, pool, sources):
    pairs = build_pairs(sources, pool)
    rows = sorted(pairs.collect(), key=lambda r: r["pair_rank"])
    assert [r["pair_rank"] for r in rows] == list(range(6))
    assert [r["chosen_text"] for r in rows] == [f"text {i}" for i in range(1, 7)]
    assert [r["rejected_text"] for r in rows] == [f"text {i}" for i in range(12, 6, -1)]
    assert all(r["pair_margin"] >= 1 and r["train_id"] == 1 for r in rows)
    summary = pair_summary(pairs).first()
    assert (summary["sources"], summary["pairs"]) == (1, 6)
    assert validate_pairs(pairs, sources=1, count=6, minimum=5, maximum=6).count() == 0
    assert {r["check"] for r in validate_pairs(pairs, count=7, maximum=5).collect()} == {"pair_count", "too_many_pairs"}


def test_pairing_reads_the_texts_of_the_winners_only(spark, pool, sources):
    digested = pool.withColumn("text_digest", P.text_digest(F.col("candidate_text"))).drop("candidate_text")
    asked = []

    def fetch(wanted):
        asked.append(wanted.count())
        return wanted.join(pool.select("source_id", "ordinal", "candidate_text"), ["source_id", "ordinal"])

    columns = sorted(build_pairs(sources, pool).columns)
    expected = build_pairs(sources, pool).select(columns).collect()
    assert sorted(build_pairs(sources, digested, texts=fetch).select(columns).collect()) == sorted(expected)
    assert asked == [12]  # two texts of six pairs, of 14 candidates


def test_minimal_table_is_compressed(spark, pool, sources, tmp_path):
    table = build_pairs(sources, pool).withColumn("anchor_text", F.concat(F.repeat(F.lit("word, \"next\"\n"), 1000), F.lit("end")))
    write_table(table, str(tmp_path / "t"), "csv", MINIMAL, "gzip")
    assert sum(f.stat().st_size for f in (tmp_path / "t").glob("*.csv.gz")) in range(1, 10_000)
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "t"))
    assert {r["anchor_text"] for r in back.collect()} == {'word, "next"\n' * 1000 + "end"}


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_roles_do_not_depend_on_partitions(pool, partitions):
    roles = P.assign_roles(P.deduplicate(pool.repartition(partitions)), PairSettings(chosen_count=2, rejected_count=3))
    rows = sorted((r["role"], r["role_rank"], r["ordinal"]) for r in roles.collect())
    assert rows == [("chosen", 1, 1), ("chosen", 2, 2), ("rejected", 1, 12), ("rejected", 2, 11), ("rejected", 3, 10)]


def test_deduplicate_keeps_the_first_and_is_idempotent(pool):
    once = P.deduplicate(pool)
    assert {r["ordinal"] for r in once.collect()} == set(range(1, 13))
    assert P.deduplicate(once).count() == once.count()


def test_unknown_residual_sorts_first_for_roles_and_last_for_pairs(spark):
    rows = [candidate(1, True, None), candidate(2, True, 0.1), candidate(3, False, 0.2, violation=9.0), candidate(4, False, 0.2, violation=8.0)]
    roles = P.assign_roles(spark.createDataFrame(rows, DDL), PairSettings(chosen_count=2))
    assert {r["ordinal"]: r["role_rank"] for r in roles.where("role = 'chosen'").collect()} == {1: 1, 2: 2}
    ordered = P.order_for_pairing(roles).where("role = 'chosen'")
    assert {r["ordinal"]: r["pair_rank"] for r in ordered.collect()} == {1: 1, 2: 0}


def test_hot_source_gives_the_same_pairs(spark, sources):
    rows = [candidate(i, i % 3 == 0, (i % 97) / 100, 0.3, 0.0 if i % 3 == 0 else (i % 89) / 10) for i in range(1, 2001)]
    hot = spark.createDataFrame(rows, DDL)
    got = {(r["chosen_text"], r["rejected_text"]) for r in build_pairs(sources, hot).collect()}
    good = sorted((r for r in rows if r[3]), key=lambda r: (r[4], -r[5], -r[7], r[1]))[:6]
    bad = sorted((r for r in rows if not r[3]), key=lambda r: (-r[6], r[4], r[7], r[1]))[:6]
    assert got == {(c[2], r[2]) for c, r in zip(good, bad)}


def test_route_pool(spark):
    texts = ["a", "A ", "", "b", "c", "d"]
    trials = spark.createDataFrame(
        [(1, "chosen", i, t) for i, t in enumerate(texts, 1)],
        "source_id bigint, prompt_route string, generation_trial int, candidate_text string",
    )
    pool = P.route_pool(trials, PoolSettings(target=2, trials_multiplier=2))
    assert sorted((r["candidate_index"], r["generation_trial"]) for r in pool.collect()) == [(1, 1), (2, 4)]


def test_preference_export(spark, pool, sources):
    templates = spark.createDataFrame([(1, "Task {text}"), (0, "x")], "label int, template string")
    records = preference_records(build_pairs(sources, pool), templates, seed=3).collect()
    assert len(records) == 6 and {r["status"] for r in records} == {"ok"}
    first = records[0]
    assert first["prompt"][0]["content"][1]["text"] == "Task anchor"
    assert first["chosen"][0]["role"] == "assistant"
    broken = build_pairs(sources, pool).withColumn("chosen_text", F.lit("x USER: y"))
    with pytest.raises(ValueError):
        preference_records(broken, templates, seed=3)
