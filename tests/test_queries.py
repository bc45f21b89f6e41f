import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_check_has_a_query():
    queries, checks = entry_module.queries(), entry_module.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 140


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "pair_margin" in df.columns


@pytest.mark.parametrize("name", ["C9_class_statistics", "R5_roles", "M4_calibration_error", "A2_coupling", "V6_prediction_grid", "G4_random_deletion"])
def test_sample_of_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = entry_module.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
    cursor = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = sorted(map(str, (tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())))
    assert got == expected


def test_prediction_lock_query_reads_the_families(spark):
    locked = entry_module.queries()["S6_prediction_lock"](spark, SF).collect()
    assert {r["dataset"] for r in locked} == {"ext_a", "ext_b"} and {r["method"] for r in locked} == {"paired", "edit"}
    assert len({(r["method"], r["weight_id"], r["unit"]) for r in locked}) == len(locked)


def test_generated_audit_searches_once_and_sorts_no_predictions(spark, monkeypatch):
    from pairforge.operators import metrics
    from workload import views

    searches, real = [], views.nearest_shared
    monkeypatch.setattr(views, "nearest_shared", lambda *a, **k: searches.append(1) or real(*a, **k))
    monkeypatch.setattr(metrics, "order_statistics", lambda *a, **k: pytest.fail("rank metrics are not read"))
    assert entry_module.queries()["M21_generated_audit"](spark, SF).count() == 4
    assert searches == [1]


def test_external_replicates_leave_out_other_cohorts(spark, monkeypatch):
    from workload import queries_evaluation as Q

    seen, real = set(), Q.B.replicate_metrics

    def watched(predictions, settings):
        seen.update(r["dataset"] for r in predictions.select("dataset").distinct().collect())
        return real(predictions, settings)

    monkeypatch.setattr(Q.B, "replicate_metrics", watched)
    rows = entry_module.queries()["B3_external_replicates"](spark, SF).collect()
    assert rows and {r["dataset"] for r in rows} == {"external_average"}
    assert seen == {"ext_a", "ext_b"}
