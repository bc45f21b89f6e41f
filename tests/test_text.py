import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairforge.functions import numeric as N
from pairforge.functions import text as X
from pairforge.functions.chunking import chunk_tokens, chunks
from pairforge.operators.prompts import render_prompts, rule_scan


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_cleaning_example(spark):
    assert one(spark, "Boy's cookie-theft; UH!", X.letters_only(F.col("t")))[0] == (
        "boys cookie theft uh"
    )


@pytest.mark.parametrize("value", ["  A\t b\n\nC  d　", "", " \x1c x", "a  b"])
def test_text_key_matches_python(spark, value):
    expected = re.sub(r"\s+", " ", value.strip().lower())
    assert one(spark, value, X.text_key(F.col("t")))[0] == expected


def test_markers(spark):
    row = one(
        spark,
        " USER: q ASSISTANT: a ASSISTANT: b ",
        X.after_first_marker(F.col("t")),
        X.after_last_marker(F.col("t")),
    )
    assert tuple(row) == ("a ASSISTANT: b", "b")


@pytest.mark.parametrize(
    ("value", "status"),
    [("ASSISTANT: ok text", "ok"), ("  assistant :  ", "empty"), ("x USER: y", "marker")],
)
def test_clean_completion(spark, value, status):
    assert one(spark, value, *X.clean_completion(F.col("t")))[1] == status


def test_route_and_role_names(spark):
    rows = spark.createDataFrame([("chosen", None), (None, "rejected"), (None, "odd")], "a string, b string")
    routes = [r[0] for r in rows.select(X.route_name(F.col("a"), F.col("b"))).collect()]
    assert routes == ["chosen_prompt", "rejected_prompt", None]
    assert one(spark, " CV-Validation Set ", X.role_name(F.col("t")))[0] == "cv_validation_set"


def test_chunking_cuts_after_eight_words():
    tokens = "one two three four five six seven eight nine ten .".split()
    assert list(chunk_tokens(tokens)) == ["one two three four five six seven eight", "nine ten."]


def test_chunking_prefers_the_last_sentence_end():
    tokens = "a b . c d ! e f g h i".split()
    assert list(chunk_tokens(tokens, 8)) == ["a b. c d!", "e f g h i"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["w", "x9", ".", ",", "?", "("]), max_size=60), st.integers(1, 9))
def test_chunking_keeps_every_token_and_the_limit(tokens, limit):
    pieces = list(chunk_tokens(tokens, limit))
    assert "".join(pieces).replace(" ", "") == "".join(tokens)
    assert all(len(re.findall(r"\w+", p)) <= limit for p in pieces)


def test_chunks_on_whole_long_text(spark):
    text = "word " * 20_000
    pieces = one(spark, text, chunks(F.col("t")))[0]
    assert len(pieces) == 2500


def test_prompts(spark):
    templates = spark.createDataFrame([(1, "r", "Say {text}!"), (1, "d", "Say.")], "label int, route string, template string")
    rows = spark.createDataFrame(
        [(1, "r", " hi "), (1, "r", " "), (1, "d", ""), (0, "r", "x")], "label int, route string, text1 string"
    )
    out = sorted((r["prompt_status"], r["prompt"]) for r in render_prompts(rows, templates).collect() if r["prompt"])
    assert out == [("ok", "Say hi!"), ("ok", "Say.")]


def test_rule_scan(spark):
    rows = spark.createDataFrame(
        [(1, "see /home/me/x"), (2, "API_KEY = 'abc'"), (3, "fine")], "id int, text string"
    )
    found = {(r["id"], r["rule"]) for r in rule_scan(rows, "id", "text").collect()}
    assert found == {(1, "absolute_path"), (2, "credential_literal")}


def test_cells_round_numbers_as_they_are_stored(spark):
    df = spark.createDataFrame([(0.25, 0.15), (0.35, 0.45), (-0.04, None), (None, 1.0)], "a double, b double")
    cells = df.select(N.mean_sd_cell(F.col("a"), F.col("b"), 1.0), N.range_cell(F.col("a"), F.col("b"), 1.0), N.interval_cell(F.col("a"), F.col("a"), F.col("b"), 1.0))
    assert [tuple(r) for r in cells.collect()] == [
        ("0.2 ± 0.1", "0.2–0.1", "0.2 [0.2, 0.1]"),
        ("0.3 ± 0.5", "0.3–0.5", "0.3 [0.3, 0.5]"),
        ("-0.0 ± NaN", "--", "-0.0 [-0.0, null]"),
        ("--", "--", "--"),
    ]
