"""Neighbourhoods and projections of embedded texts."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.vectors import as_matrix
from pairforge.operators.metrics import auroc_mid_ranks
from pairforge.operators.scaling import durable, top_k

BLOCK_ROWS = 4096
# Vectors of one side that a task holds. Either side is written once per part of the other.
TASK_BYTES = 64 << 20
# Distances equal to this many digits count as ties; the lower reference id wins.
TIE_DIGITS = 9
SLACK = 2.0 * 10.0**-TIE_DIGITS  # what rounding to ties may hide
PAIR_BYTES = 8 << 20  # vectors of pairs that are compared exactly at once
LOW_WIDTH = 8  # vectors this short are searched in the order of their first component


class _Nearest:
    """The ``k`` nearest references of a chunk of queries, block after block."""

    def __init__(self, rows: int, k: int):
        import numpy as np

        self.k, self.kth = k, np.full(rows, np.inf)
        self.row, self.ref = np.empty(0, np.int64), np.empty(0, np.int64)
        self.shown, self.distance = np.empty(0), np.empty(0)

    def add(self, distance, ref_ids) -> None:
        import numpy as np

        limit = self.kth + SLACK
        if distance.shape[1] > self.k and np.isinf(limit).any():
            limit = np.minimum(limit, np.partition(distance, self.k - 1, axis=1)[:, self.k - 1] + SLACK)
        row, place = np.nonzero((distance <= limit[:, None]) & (distance < np.inf))
        self._keep(row, ref_ids[place], distance[row, place])

    def add_cosines(self, queries, block, narrow_queries, narrow_block, ref_ids) -> None:
        """As ``add`` for unit vectors. Products in single precision leave out what is too far by more than their
        error; distances of the rest are taken in double precision."""
        import numpy as np

        similar = narrow_queries @ narrow_block.T
        error = (queries.shape[1] + 4) * 2.0**-23  # twice what products and their sums lose
        least = 1.0 - self.kth - SLACK - error
        if len(block) > self.k and np.isinf(self.kth).any():
            known = np.where(np.isnan(similar), np.float32(-np.inf), similar)
            least = np.maximum(least, np.partition(known, len(block) - self.k, axis=1)[:, len(block) - self.k] - SLACK - 2 * error)
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        row, place = np.divmod(np.flatnonzero(similar >= least[:, None]), len(block))
        step = max(1, PAIR_BYTES // (8 * max(1, queries.shape[1])))
        parts = [slice(at, at + step) for at in range(0, len(row), step)]
        found = [1.0 - np.einsum("ij,ij->i", queries[row[p]], block[place[p]]) for p in parts]
        self._keep(row, ref_ids[place], np.concatenate(found) if found else np.empty(0))

    def _keep(self, row, ref, found) -> None:
        import numpy as np

        if not len(row):
            return
        row, ref = np.concatenate([self.row, row]), np.concatenate([self.ref, ref])
        shown = np.concatenate([self.shown, np.round(found, TIE_DIGITS)])
        found = np.concatenate([self.distance, found])
        order = np.lexsort((ref, shown, row))
        order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < self.k]
        self.row, self.ref, self.shown, self.distance = row[order], ref[order], shown[order], found[order]
        ends = np.cumsum(np.bincount(self.row, minlength=len(self.kth))) - 1
        full = np.bincount(self.row, minlength=len(self.kth)) == self.k
        self.kth[full] = self.shown[ends[full]]


def _sizes(df: DataFrame) -> tuple[int, int, bool]:
    """Rows, the largest width, and whether single precision holds every component exactly."""
    exact = F.forall("vec", lambda x: x.cast("double") == x.cast("float").cast("double"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"), F.bool_and(exact).alias("narrow")).first()
    return row["n"], row["width"] or 1, bool(row["narrow"])


def _grid(queries: tuple, references: tuple, k: int, cores: int) -> tuple[int, int]:
    """Parts of queries and references whose tasks fit and that write the fewest bytes.

    Every row is written once per part of the other side, and ``k`` results per query and
    part of the references. Small inputs still get a task per core to run on.
    """
    (rows, *_), (n_refs, *_) = queries, references
    n_query, n_ref = (max(1, ceil(n * 8 * width / TASK_BYTES)) for n, width, _ in (queries, references))
    of_query, of_ref = ((4 if narrow else 8) * width for _, width, narrow in (queries, references))

    def grid(more: int) -> tuple[int, int]:
        own = min(ceil(cores / more), ceil(rows / 256), 8 * n_query)
        return max(n_query, own), more

    def cost(parts: tuple[int, int]) -> int:
        return rows * (of_query + 24 * k) * parts[1] + n_refs * of_ref * parts[0]

    most = max(n_ref, min(ceil(cores / n_query), ceil(n_refs / 256)))
    return min((grid(more) for more in range(n_ref, most + 1)), key=cost)


def search_parts(queries: DataFrame, references: DataFrame, k: int = 10) -> tuple[int, int]:
    """Into how many parts a search deals its queries and references."""
    return _grid(_sizes(queries), _sizes(references), k, queries.sparkSession.sparkContext.defaultParallelism)


def nearest(
    queries: DataFrame,
    references: DataFrame,
    k: int,
    *,
    metric: str = "cosine",
    within: str | None = None,
    across: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k nearest references: ``(query_id, ref_id, distance, rank)``.

    Both sides are dealt by a hash of their id to parts of at most about ``TASK_BYTES``. One task
    compares a part of the queries with a part of the references, in blocks of ``block_rows``
    references as matrix products, and emits the k best per query, so neither all pairs nor a
    whole side ever materialise; a second step merges the parts. Vectors that single precision
    holds exactly are written as such and compared in double precision. Short vectors are compared in
    the order of their first component and only as far as the k best found so far reach.
    ``within`` keeps pairs whose value is equal in that column, ``across`` keeps pairs whose
    value differs (held-out folds).
    """
    extra = [c for c in (within, across) if c]
    sizes = _sizes(queries), _sizes(references)
    n_query, n_ref = _grid(*sizes, k, queries.sparkSession.sparkContext.defaultParallelism)

    def parts(df: DataFrame, key: str, own: int, other: int, names: tuple[str, str], narrow: bool) -> DataFrame:
        mine, theirs = names
        # Fresh column identities: both sides may stem from one table.
        return df.select(
            F.col(key).alias(key),
            F.col("vec").cast("array<float>" if narrow else "array<double>").alias("vec"),
            *[F.col(c).alias(c) for c in extra],
            F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs),
        )

    left = parts(queries, "query_id", n_query, n_ref, ("_qb", "_rb"), sizes[0][2])
    right = parts(references, "ref_id", n_ref, n_query, ("_rb", "_qb"), sizes[1][2])

    def compare(q, r):
        import numpy as np
        import pyarrow as pa

        empty = {"query_id": pa.array([], pa.int64()), "ref_id": pa.array([], pa.int64())}
        if not len(q) or not len(r):
            return pa.table({**empty, "distance": pa.array([], pa.float64())})
        refs, qs = as_matrix(r.column("vec")), as_matrix(q.column("vec"))
        ref_ids, query_ids = r.column("ref_id").to_numpy(), q.column("query_id").to_numpy()
        filters = [(q.column(n).to_numpy(), r.column(n).to_numpy(), equal) for n, equal in ((within, True), (across, False)) if n]
        short = metric != "cosine" and refs.shape[1] <= LOW_WIDTH
        if metric == "cosine":
            refs = refs / np.maximum(np.linalg.norm(refs, axis=1), 1e-300)[:, None]
            qs = qs / np.maximum(np.linalg.norm(qs, axis=1), 1e-300)[:, None]
        elif short:
            r_order, q_order = np.argsort(refs[:, 0], kind="stable"), np.argsort(qs[:, 0], kind="stable")
            refs, ref_ids, qs, query_ids = refs[r_order], ref_ids[r_order], qs[q_order], query_ids[q_order]
            filters = [(a[q_order], b[r_order], equal) for a, b, equal in filters]
        coarse = metric == "cosine" and not filters
        narrow_qs, narrow_refs = (m.astype(np.float32) for m in (qs, refs)) if coarse else (qs, refs)
        squares = np.einsum("ij,ij->i", refs, refs)
        out_q, out_r, out_d = [], [], []
        for start in range(0, len(qs), 256):
            part = qs[start : start + 256]
            own = np.einsum("ij,ij->i", part, part)
            best = _Nearest(len(part), k)

            def look(low, high):
                for at in range(low, high, block_rows):
                    end = min(at + block_rows, high)
                    block = refs[at:end]
                    if coarse:
                        best.add_cosines(part, block, narrow_qs[start : start + 256], narrow_refs[at:end], ref_ids[at:end])
                        continue
                    if metric == "cosine":
                        distance = 1.0 - part @ block.T
                    elif short:
                        gaps = ((part[:, i : i + 1] - block[None, :, i]) ** 2 for i in range(refs.shape[1]))
                        distance = np.sqrt(sum(gaps))
                    else:
                        distance = np.sqrt(np.maximum(own[:, None] + squares[at:end] - 2 * part @ block.T, 0.0))
                    for mine, theirs, equal in filters:
                        same = mine[start : start + 256, None] == theirs[None, at:end]
                        distance = np.where(same if equal else ~same, distance, np.inf)
                    best.add(distance, ref_ids[at:end])

            if short:
                first = refs[:, 0]
                low = max(0, int(np.searchsorted(first, part[0, 0])) - 4 * k)
                high = min(len(refs), int(np.searchsorted(first, part[-1, 0], "right")) + 4 * k)
                look(low, high)
                # Whatever is nearer than the k best so far lies as near in its first component.
                down = int(np.searchsorted(first, (part[:, 0] - best.kth).min() - SLACK))
                look(min(down, low), low)
                up = int(np.searchsorted(first, (part[:, 0] + best.kth).max() + SLACK, "right"))
                look(high, max(up, high))
            else:
                look(0, len(refs))
            out_q.append(query_ids[start + best.row])
            out_r.append(best.ref)
            out_d.append(best.distance)
        return pa.table(
            {
                "query_id": np.concatenate(out_q),
                "ref_id": np.concatenate(out_r),
                "distance": np.concatenate(out_d),
            }
        )

    found = (
        left.groupBy("_qb", "_rb")
        .cogroup(right.groupBy("_qb", "_rb"))
        .applyInArrow(compare, "query_id bigint, ref_id bigint, distance double")
    )
    order = [F.round("distance", TIE_DIGITS), F.col("ref_id")]
    return top_k(found, ["query_id"], order, k, "rank")


def nearest_shared(
    queries: DataFrame, references: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", **options
) -> DataFrame:
    """As ``nearest``, for ``references(ref_id, key)`` that share the ``vectors(key, vec)``.

    Each vector that has a reference is searched once, under its least reference id; a query's
    ``k`` first vectors by distance and that id hold its ``k`` nearest references.
    """
    owned = references.select(key, "ref_id")
    heads = owned.groupBy(key).agg(F.min("ref_id").alias("_head"))
    searched = heads.join(vectors.select(key, "vec"), key).select(F.col("_head").alias("ref_id"), "vec")
    found = nearest(queries, searched, k, **options).select("query_id", F.col("ref_id").alias("_head"), "distance")
    owners = top_k(owned.join(heads, key).select("_head", "ref_id"), ["_head"], [F.col("ref_id")], k, "_n").drop("_n")
    order = [F.round("distance", TIE_DIGITS), F.col("ref_id")]
    rows = found.join(owners, "_head").select("query_id", "ref_id", "distance")
    return top_k(rows, ["query_id"], order, k, "rank")


def opposite_rate(neighbours: DataFrame, queries: DataFrame, references: DataFrame) -> DataFrame:
    """Share of a query's neighbours that carry the other label."""
    labels = references.select("ref_id", F.col("label").alias("_ref_label"))
    own = queries.select("query_id", F.col("label").alias("_own_label"))
    # Reference ids repeat a lot among the neighbours: count per (query, label) pair after
    # the join, which AQE splits should one reference be everybody's neighbour.
    return (
        neighbours.join(labels, "ref_id")
        .join(own, "query_id")
        .groupBy("query_id")
        .agg(F.avg((F.col("_ref_label") != F.col("_own_label")).cast("int")).alias("opposite_rate"))
    )


def knn_contamination(
    queries: DataFrame, references: DataFrame, k: int = 10, neighbours: DataFrame | None = None
) -> DataFrame:
    """``(query_id, opposite_rate)`` over the k nearest references by cosine distance.

    ``neighbours`` are those of a search that was made before.
    """
    return opposite_rate(nearest(queries, references, k) if neighbours is None else neighbours, queries, references)


def opposite_rates(
    queries: DataFrame, references: DataFrame, labels: Sequence[int], k: int = 10, neighbours: DataFrame | None = None
) -> DataFrame:
    """``(query_id, label, opposite_rate)``: the rate that a query of every label would have.

    For many queries that share few vectors: search each vector once and join on its id.
    ``neighbours`` are those of a search that was made before.
    """
    known = references.select("ref_id", F.col("label").alias("_ref_label"))
    rate = [F.avg((F.col("_ref_label") != x).cast("int")).alias(f"_{x}") for x in labels]
    found = nearest(queries, references, k) if neighbours is None else neighbours
    rates = found.join(known, "ref_id").groupBy("query_id").agg(*rate)
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"_{x}").alias("opposite_rate")) for x in labels]))
    return rates.select("query_id", pairs.alias("_r")).select("query_id", "_r.label", "_r.opposite_rate")


def cap_sample(rows: DataFrame, group: Sequence[str], key: str, cap: int = 800, seed: int = 2024) -> DataFrame:
    """At most ``cap`` rows per stratum, chosen by a seeded hash of their key."""
    token = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return top_k(rows, group, [token, F.col(key)], cap, "sample_rank")


def attach_coordinates(rows: DataFrame, coordinates: DataFrame, key: str) -> DataFrame:
    """Join coordinates by key; rows without one stay, with NULL coordinates."""
    return rows.join(coordinates, key, "left")


def pca(
    vectors: DataFrame, key: str, components: int = 2, *, scale: str = "standard"
) -> tuple[DataFrame, DataFrame]:
    """Coordinates per key and explained-variance ratios.

    ``scale`` is ``standard`` (centre, unit variance) or ``l2`` (unit length). Spark
    aggregates the covariance on the executors; only a width x width matrix is solved.
    """
    from pyspark.ml.feature import PCA, Normalizer, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select(key, array_to_vector(F.col("vec").cast("array<double>")).alias("_raw"))
    if scale == "standard":
        scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)
        data = scaler.fit(data).transform(data)
    elif scale == "l2":
        data = Normalizer(inputCol="_raw", outputCol="_scaled", p=2.0).transform(data)
    else:
        raise ValueError("scale is 'standard' or 'l2'")
    model = PCA(k=components, inputCol="_scaled", outputCol="_pc").fit(data)
    ratios = [(i, float(x)) for i, x in enumerate(model.explainedVariance)]
    spark = vectors.sparkSession
    return (
        model.transform(data).select(key, vector_to_array("_pc").alias("coordinates")),
        spark.createDataFrame(ratios, "component int, explained_ratio double"),
    )


def held_out_regression(points: DataFrame, k: int = 40) -> DataFrame:
    """Inverse-distance kNN prediction of ``value`` from other folds of the same label.

    ``points(point_id, label, fold, dim1, dim2, value)``; a point at distance zero from
    some neighbours takes the mean of those. The points are cut once, since both sides of the
    search, their sizes and the values read them.
    """
    points = durable(points)
    flat = points.select(
        "point_id", F.array("dim1", "dim2").alias("vec"), "label", "fold", "value"
    )
    pairs = nearest(
        flat.withColumnRenamed("point_id", "query_id"),
        flat.withColumnRenamed("point_id", "ref_id"),
        k,
        metric="euclidean",
        within="label",
        across="fold",
    )
    values = points.select(F.col("point_id").alias("ref_id"), F.col("value").alias("_value"))
    touching = F.col("distance") == 0.0
    weight = F.when(~touching, 1.0 / F.nullif(F.col("distance"), F.lit(0.0)))
    predicted = pairs.join(values, "ref_id").groupBy("query_id").agg(
        F.coalesce(
            F.avg(F.when(touching, F.col("_value"))),
            F.sum(weight * F.col("_value")) / F.sum(weight),
        ).alias("predicted")
    )
    return points.join(predicted.withColumnRenamed("query_id", "point_id"), "point_id")


def regression_quality(predicted: DataFrame, group: Sequence[str] = ("label",)) -> DataFrame:
    """R squared and mean absolute error per group."""
    y, p = F.col("value"), F.col("predicted")
    return predicted.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        (1.0 - F.sum(F.pow(y - p, 2)) / (F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
    )


def held_out_classifier(points: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AUC per label of a logistic model for ``value >= threshold``, folds held out.

    Two small models per fold and label are fitted by Spark; folds are a few seeds. The points
    are cut once, since every fit and every prediction reads them.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = durable(points).withColumn("_high", (F.col("value") >= threshold).cast("double"))
    rows = VectorAssembler(inputCols=["dim1", "dim2"], outputCol="_x").transform(rows)
    cells = rows.groupBy("label", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_high").alias("high")
    ).collect()
    scored = None
    for label in sorted({c["label"] for c in cells}):
        mine = [c for c in cells if c["label"] == label]
        for fold in sorted(c["fold"] for c in mine):
            n = sum(c["n"] for c in mine if c["fold"] != fold)
            high = sum(c["high"] for c in mine if c["fold"] != fold)
            if not 0 < high < n:
                continue
            train = rows.where((F.col("label") == label) & (F.col("fold") != fold))
            test = rows.where((F.col("label") == label) & (F.col("fold") == fold))
            model = LogisticRegression(
                featuresCol="_x",
                labelCol="_high",
                regParam=1.0 / n,
                standardization=False,
                maxIter=2000,
            ).fit(train)
            part = model.transform(test).select(
                "label", "_high", vector_to_array("probability")[1].alias("y_prob")
            )
            scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise ValueError("no fold has both classes")
    named = scored.select("label", F.col("_high").cast("int").alias("y_true"), "y_prob")
    return auroc_mid_ranks(named, ["label"])
