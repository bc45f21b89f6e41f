"""What a bounded sample must not change in the toxicity model."""

import random

import numpy as np

from pairforge.llm import toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def table(spark, n, seed):
    """One row in ten is toxic and says so; one clean row in thirty says it too."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        toxic = int(i % 10 == 0)
        said = " grumbolt" if toxic and draw.random() < 0.9 or not toxic and draw.random() < 1 / 30 else ""
        rows.append((i, " ".join(draw.choice(WORDS) for _ in range(25)) + said, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_scores_do_not_move_with_the_bound(spark):
    docs = table(spark, 6000, 1)
    labels = docs.select("doc_id", "toxic")
    probe = spark.createDataFrame([(0, "alpha beta"), (1, "alpha grumbolt beta"), (2, "")], "doc_id bigint, text string")
    found = []
    for rows, bound in ((docs, 100_000), (docs, 600), (table(spark, 1200, 2), 600)):
        model = toxicity.fit(rows, labels.join(rows.select("doc_id"), "doc_id"), bound=bound)
        assert "grumbolt" in model["terms"]
        found.append([r.score for r in sorted(toxicity.score(probe, model).collect())])
    logits = np.log(np.array(found)) - np.log(1 - np.array(found))
    assert np.abs(logits - logits[0]).max() < 1.2
    assert (np.array(found)[:, 0] < 0.2).all() and (np.array(found)[:, 1] > np.array(found)[:, 0]).all()


def test_likely_keeps_all_wanted_rows(spark):
    rows = spark.range(200_000).selectExpr("id as doc_id", "'x' as text", "1 as _word")
    wanted = spark.range(0, 200_000, 500).selectExpr("id as doc_id")
    kept = {r.doc_id for r in toxicity.likely(rows.select("doc_id", "text"), wanted).collect()}
    assert kept >= set(range(0, 200_000, 500)) and len(kept) < 2 * 400 + 10
    assert toxicity.likely(rows, wanted.limit(0)).count() == 0
