"""Prompt rendering, rule scans and quality regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import strip
from pairforge.operators.scaling import exact_quantiles

# Fixed patterns: absolute user paths and credential literals, both case-blind.
RULES: Mapping[str, tuple[str, str]] = {
    "absolute_path": ("ERROR", r"(?i)(?:/home/[^/\s\"']+/|[a-z]:[\\/]users[\\/])"),
    "credential_literal": (
        "ERROR",
        r"(?i)(?:api[_-]?key|access[_-]?token|secret|password)\s*=\s*[\"'][^\"']+[\"']",
    ),
}
MAX_TEMPLATES = 10_000


def render_prompts(
    rows: DataFrame,
    templates: DataFrame,
    keys: Sequence[str] = ("label", "route"),
    text: str = "text1",
) -> DataFrame:
    """Fill the template of each row's keys; adds ``prompt`` and ``prompt_status``.

    ``templates(*keys, template)`` marks the text by ``{text}``; a template without the
    mark leaves the text out. The status is ``ok``, ``empty`` or ``no_template``.
    """
    if templates.limit(MAX_TEMPLATES + 1).count() > MAX_TEMPLATES:
        raise ValueError("the template table is too large to ship to every task")
    body = F.coalesce(strip(F.col(text)), F.lit(""))
    joined = rows.join(F.broadcast(templates), list(keys), "left")
    status = (
        F.when(F.col("template").isNull(), "no_template")
        .when((body == "") & F.col("template").contains("{text}"), "empty")
        .otherwise("ok")
    )
    filled = strip(F.replace("template", F.lit("{text}"), body))
    return (
        joined.withColumn("prompt_status", status)
        .withColumn("prompt", F.when(F.col("prompt_status") == "ok", filled))
        .drop("template")
    )


def rule_scan(
    corpus: DataFrame,
    key: str,
    text: str,
    rules: Mapping[str, tuple[str, str]] = RULES,
) -> DataFrame:
    """One finding per text and broken rule, in a single pass over the whole texts."""
    checks = [
        F.when(
            F.col(text).rlike(pattern),
            F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")),
        )
        for name, (severity, pattern) in rules.items()
    ]
    return corpus.select(key, F.inline(F.array_compact(F.array(*checks))))


def severity_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


def quality_regions(df: DataFrame, x: str, y: str) -> DataFrame:
    """Quadrant of every row by the medians of two columns."""
    rows = df.withColumn("_all", F.lit(1))
    x_cut = exact_quantiles(rows, ["_all"], x, {"x_boundary": 0.5})
    y_cut = exact_quantiles(rows, ["_all"], y, {"y_boundary": 0.5})
    horizontal = F.when(F.col(x) < F.col("x_boundary"), "low").otherwise("high")
    vertical = F.when(F.col(y) < F.col("y_boundary"), "low").otherwise("high")
    return (
        rows.join(F.broadcast(x_cut), "_all")
        .join(F.broadcast(y_cut), "_all")
        .withColumn("region", F.concat_ws("_", horizontal, vertical))
        .drop("_all")
    )
