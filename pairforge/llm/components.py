"""Connected components by contraction.

Every round lets each node follow the first of itself and its neighbours in an order drawn
anew by hash, and replaces the ends of all links by the nodes they lead to. About half of the
nodes of a chain are left after a round, and fewer of anything denser, so the number of rounds
grows with the logarithm of the nodes, whatever the shape. The steps of the rounds are then
put together from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import stored

HOT = 1000  # a value is hot from this part of all rows on, so there are at most so many


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """``node`` and ``label``, the least node it can reach, for every node with a link.

    Links from a node to itself and null ends link nothing. Without links there are no rows.
    Every round is written out; only counts reach the driver.
    """
    edges = _distinct(links.select(F.col(first).alias("a"), F.col(second).alias("b")))
    steps: list[DataFrame] = []
    while total := edges.count():
        steps.append(_step(edges, len(steps)))
        busy = steps[-1].where(F.col("links") * HOT > total).select(F.col("node").alias("_key"), F.col("label").alias("_hot"))
        edges = _distinct(_looked_up(_looked_up(edges, "a", steps[-1], busy), "b", steps[-1], busy))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps.pop()
    while steps:
        labels = stored(followed(steps.pop().select("node", "label"), "label", labels))
    labels = labels.select("node", "label")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return stored(followed(labels, "label", least.select(F.col("label").alias("node"), F.col("least").alias("label"))))


def _distinct(edges: DataFrame) -> DataFrame:
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(ordered.distinct())


def _step(edges: DataFrame, turn: int) -> DataFrame:
    """Where each node of the links goes: to the first of itself and its neighbours."""

    def place(column: str) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), column).alias("draw"), F.col(column).alias("label"))

    ends = edges.select(F.col("a").alias("node"), F.least(place("a"), place("b")).alias("best"))
    ends = ends.union(edges.select(F.col("b"), F.least(place("a"), place("b"))))
    first = ends.groupBy("node").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("links"))
    return stored(first.select("node", "best.label", "links"))


def followed(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by the label that ``table`` (node, label) gives it.

    Values without a label stay.
    """
    total = rows.count()
    known = table.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    hot = rows.groupBy(F.col(column).alias("_key")).count().where(F.col("count") * HOT > total).select("_key")
    busy = hot.join(known, F.col("_key") == F.col("_node"), "left").select("_key", F.coalesce("_label", "_key").alias("_hot"))
    return _looked_up(rows, column, table, busy)


def _looked_up(rows: DataFrame, column: str, table: DataFrame, busy: DataFrame) -> DataFrame:
    """As ``followed``; the hot values' labels in ``busy`` are broadcast.

    At most ``HOT`` values are hot (twice that, of both ends of links), so that no task gets
    all rows of one value.
    """
    names = rows.columns
    known = table.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    marked = rows.join(F.broadcast(busy), F.col(column) == F.col("_key"), "left").select(*names, "_hot")
    cold = F.when(F.col("_hot").isNull(), F.col(column)).otherwise(F.xxhash64(*names))  # found rows are dealt out
    spread = marked.withColumn("_cold", cold).join(known, F.col("_cold") == F.col("_node"), "left")
    return spread.withColumn(column, F.coalesce("_hot", "_label", column)).select(*names)
