"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) are drawn from the table. Every vector is described by the
ordered list of its nearest pivots and posted in the inverted lists of these pivots. Vectors
that share enough pivots are candidates, and their cosines are computed in double precision.

In a crowd of near copies the nearest pivots are ordered by noise. So pivots keep apart from
each other, and a row that lies close to a pivot is compared with every row that the
triangle inequality leaves: none of its pairs is missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns, signed, stored
from pairforge.llm.components import components

COSINE = 0.9
NEAREST = 8  # pivots that describe a vector
SHARED = 2  # pivots that a candidate pair has in common at least
PER_PIVOT = 64  # vectors for each pivot, about
PIVOTS = (32, 4096)  # least and most pivots, if the table has so many that keep apart
DRAWN = 4  # sampled vectors for each wanted pivot
CLOSE = 0.8  # pivots have a lower cosine with each other; rows with a higher one to a pivot are compared exactly
BLOCK = 1024  # rows of an inverted list that are compared at once


def _unit(vector) -> np.ndarray | None:
    if vector is None or any(x is None for x in vector):
        return None
    v = np.array(vector, dtype=np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    v = v / max(np.abs(v).max(), 1e-300)
    size = np.linalg.norm(v)
    return v / size if size > 0 else None


def link_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row its id, ``n_links``, ``component_id`` and ``kept``.

    Rows link if their vectors have the same length and a cosine of ``cosine`` or more. If
    neither has a pivot within ``CLOSE``, they must also share ``SHARED`` of their
    ``NEAREST`` pivots, which a few true pairs do not: recall is measured in the tests. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing. Equal vectors are one class and all linked. Rows with a
    null id count as links but name no component; repeated rows link with each other.
    """

    def build():
        def step(ids, found):
            units = [_unit(v) for v in found]
            keys = [None if u is None else signed(xxhash.xxh3_64_intdigest(np.array(v, dtype=np.float64).tobytes())) for u, v in zip(units, found)]
            return ids, keys, [None if u is None else u.tolist() for u in units]

        return step

    kind = dict(vectors.dtypes)[id_column]
    rows = stored(map_columns(vectors, [id_column, vector_column], build, f"id {kind}, node bigint, unit array<double>"))
    classes = stored(
        rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    )
    counts, edges = _compared(classes, cosine)
    labels = components(edges)
    named = classes.select("node", "id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    known = (
        named.join(least, "label")
        .join(counts, "node", "left")
        .select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    )
    joined = rows.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _spread(units: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The first ``most`` vectors that keep apart from all those taken before them."""
    size = max((len(u) for u in units), default=0)
    taken = np.zeros((most, size))
    found: list[np.ndarray] = []
    for unit in units:
        padded = np.pad(unit, (0, size - len(unit)))
        if len(found) < most and (not found or (taken[: len(found)] @ padded).max() < CLOSE):
            taken[len(found)] = padded
            found.append(unit)
    return found


def _fitted(pivots: list[np.ndarray], size: int) -> np.ndarray:
    """The pivots cut or filled up to ``size`` components, of length one or zero."""
    rows = np.array([np.pad(p, (0, max(0, size - len(p))))[:size] for p in pivots]).reshape(-1, size)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _by_size(units) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, unit in enumerate(units):
        found.setdefault(len(unit), []).append(i)
    return found


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Cells (row, column) of a matrix of links that connect what the links connect."""
    found: list[tuple[int, int]] = []
    rows, columns = linked.any(axis=1), linked.any(axis=0)  # not reached yet
    while rows.any():
        front = np.flatnonzero(rows)[:1]
        rows[front] = False
        while len(front):
            part = linked[front] & columns
            new = np.flatnonzero(part.any(axis=0))
            found += zip(front[part[:, new].argmax(axis=0)].tolist(), new.tolist())
            columns[new] = False
            part = linked[:, new] & rows[:, None]
            front = np.flatnonzero(part.any(axis=1))
            found += zip(front.tolist(), new[part[front].argmax(axis=1)].tolist() if len(new) else [])
            rows[front] = False
    return found


def _compared(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Per class the rows it links with, and links that connect each component.

    A row within ``CLOSE`` of a pivot is at home in the list of its nearest one, and a
    guest wherever a row at home may lie within ``cosine`` of it: angles to the pivot
    and, by the plane between two pivots, distances to their cells bound that. A pair of
    rows that both have homes counts in the list of the first. Other pairs count in the
    inverted list of the first pivot that both share. A list is cut into blocks of about
    ``BLOCK`` rows and every pair of blocks is one group, so a hot list spreads over many
    tasks. Groups give sums and a spanning forest, not all pairs.
    """
    spark = classes.sparkSession
    n = classes.count()
    wanted = min(max(n // PER_PIVOT, PIVOTS[0]), PIVOTS[1])
    drawn = classes.orderBy(F.xxhash64(F.lit("pivot"), "node"), "node").limit(DRAWN * wanted).select("unit").collect()
    pivots = _spread([np.array(r.unit) for r in drawn], wanted)
    shared = spark.sparkContext.broadcast(pivots)
    needed = min(SHARED, len(pivots))

    def describe():
        known: dict[int, np.ndarray] = {}

        def step(nodes, units, copies):
            near, home, closest = ([None] * len(nodes) for _ in range(3))
            for size, at in _by_size(units).items():
                if size not in known:
                    known[size] = _fitted(shared.value, size)
                cosines = np.array([units[i] for i in at]) @ known[size].T
                for i, own in zip(at, cosines):
                    order = np.argsort(-own, kind="stable")[:NEAREST].tolist()
                    if own[order[0]] >= CLOSE:
                        home[i], closest[i] = order[0], float(own[order[0]])
                    else:
                        near[i] = order
            return nodes, units, copies, near, home, closest

        return step

    described = stored(
        map_columns(
            classes,
            ["node", "unit", "copies"],
            describe,
            "node bigint, unit array<double>, copies bigint, near array<int>, home int, closest double",
        )
    )
    bound = np.full(len(pivots), 2.0)  # least cosine of a guest; no row has 2
    for pivot, farthest in described.where("home is not null").groupBy("home").agg(F.min("closest")).collect():  # a row per pivot
        bound[pivot] = np.cos(min(np.pi, np.arccos(min(1.0, farthest)) + np.arccos(cosine))) - 1e-9
    bounds = spark.sparkContext.broadcast(bound)
    reach = float(np.sqrt(2 - 2 * cosine))  # distance of two unit vectors with this cosine

    def visit():
        known: dict[int, np.ndarray] = {}

        def step(nodes, units, copies, home):
            visited = [[]] * len(nodes)
            for size, at in _by_size(units).items():
                if size not in known:
                    known[size] = _fitted(shared.value, size)
                fitted = known[size]
                cosines = np.array([units[i] for i in at]) @ fitted.T
                for i, own in zip(at, cosines):
                    best = int(own.argmax()) if home[i] is None else home[i]
                    lists = np.flatnonzero(own >= bounds.value)
                    lists = lists[lists < home[i]] if home[i] is not None else lists
                    apart = np.linalg.norm(fitted[lists] - fitted[best], axis=1)
                    visited[i] = lists[own[best] - own[lists] <= reach * apart + 1e-9].tolist()
            return nodes, units, copies, visited

        return step

    guests = stored(
        map_columns(described, ["node", "unit", "copies", "home"], visit, "node bigint, unit array<double>, copies bigint, visited array<int>")
        .where(F.size("visited") > 0)
    )

    def posted(rows: DataFrame, pivot, near) -> tuple[DataFrame, DataFrame]:
        entries = rows.select("node", "unit", "copies", near.alias("near"), pivot.alias("pivot"))
        sizes = rows.select(pivot.alias("pivot")).groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        return entries, sizes  # a row of sizes per pivot

    none = F.lit(None).cast("array<int>")
    hosts, host_blocks = posted(described.where("home is not null"), F.col("home"), none)
    visitors, visitor_blocks = posted(guests, F.explode("visited"), none)
    listed, listed_blocks = posted(described.where("home is null"), F.explode("near"), F.col("near"))

    def own(entries: DataFrame, sizes: DataFrame) -> DataFrame:
        return entries.join(F.broadcast(sizes), "pivot").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def meet(entries: DataFrame, others: DataFrame | None = None) -> DataFrame:
        if others is not None:
            entries = entries.drop("blocks").join(F.broadcast(others), "pivot")
        return entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def within(entries: DataFrame) -> DataFrame:
        return meet(entries).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    # The blocks of guests have numbers below zero.
    hosts, visitors = own(hosts, host_blocks), own(visitors, visitor_blocks)
    left = meet(hosts, visitor_blocks).withColumn("low", F.col("own")).withColumn("high", -1 - F.col("other"))
    right = meet(visitors, host_blocks).withColumn("low", F.col("other")).withColumn("own", -1 - F.col("own")).withColumn("high", F.col("own"))
    exact = within(hosts).unionByName(left).unionByName(right).withColumn("exact", F.lit(True))
    grouped = exact.unionByName(within(own(listed, listed_blocks)).withColumn("exact", F.lit(False)))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        exact, pivot, low, high = (group[c].iloc[0] for c in ("exact", "pivot", "low", "high"))
        group = group.sort_values("node")
        nodes, sums, others = ([np.zeros(0, dtype=np.int64)] for _ in range(3))
        lengths = group["unit"].map(len).to_numpy()
        for size in np.unique(lengths):
            same = group[lengths == size]
            a, b = same[same["own"] == low], same[same["own"] == high]
            if not len(a) or not len(b):
                continue
            linked = np.stack(a["unit"].to_numpy()) @ np.stack(b["unit"].to_numpy()).T >= cosine
            if low == high:
                linked |= linked.T
                np.fill_diagonal(linked, False)
            if not exact:
                i, j = np.nonzero(linked)
                left, right = (np.stack(side["near"].to_numpy()) if len(i) else None for side in (a, b))
                for at in range(0, len(i), 1 << 16):
                    x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    both = (left[x][:, :, None] == right[y][:, None, :]).any(axis=2)
                    first = np.where(both, left[x], len(pivots)).min(axis=1)
                    linked[x, y] = (both.sum(axis=1) >= needed) & (first == pivot)
            an, bn = a["node"].to_numpy(), b["node"].to_numpy()
            for one, count in ((an, linked @ b["copies"].to_numpy()), (bn, a["copies"].to_numpy() @ linked))[: 1 if low == high else 2]:
                nodes.append(one[count > 0])
                sums.append(count[count > 0])
            others.append(np.full(len(np.concatenate(nodes)) - len(np.concatenate(others)), -1))
            if ends := _forest(linked):
                x, y = np.array(ends).T
                nodes.append(an[x])
                sums.append(np.zeros(len(x), dtype=np.int64))
                others.append(bn[y])
        made = pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(sums)})
        made["other"] = pd.array(np.concatenate(others), dtype="Int64")
        made.loc[made["links"] > 0, "other"] = pd.NA
        return made

    result = stored(grouped.groupBy("exact", "pivot", "low", "high").applyInPandas(compare, "node bigint, links bigint, other bigint"))
    counts = result.groupBy("node").agg(F.sum("links").alias("links"))
    edges = result.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))
    return counts, edges
