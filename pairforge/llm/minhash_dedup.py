"""Near-duplicate texts by a join on the coordinates of MinHash signatures.

A text is the set of its 5-word shingles. Texts with equal sets form a class, and only
classes are compared. A signature holds one minimum per coordinate; two sets of the wanted
likeness agree in at least ``least_matches`` of them. Of every signature only the rarest
values are posted in inverted lists (a prefix: agreeing pairs must meet in one of them), so
values that many texts share are skipped. Pairs that meet are kept if their signatures agree
often enough, and linked only if the full sets confirm it. Pairs of a long list are confirmed
inside its blocks, so that only links which connect something leave them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns, signed, stored
from pairforge.llm.components import components

WORDS = 5
COORDINATES = 48
MATCHES = 28  # a pair of likeness 0.85 has fewer with probability under one in 100,000
LIKENESS = 85  # in hundredths
KEPT = 50_000  # token hashes that a task keeps
SMALL = 32  # longest list whose pairs are formed by a plain join
BLOCK = 512  # rows of a longer list that are compared at once
BLOCK_SHINGLES = 1 << 20  # shingles of them, about
COLUMNS = 4096  # shingles that are counted at once
BROADCAST = 1_000_000  # most ids that are sent to all executors


@lru_cache(maxsize=1)
def _known() -> dict[bytes, int]:
    return {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; letters A-Z count as lower case."""
    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    known = _known()
    if len(known) > KEPT:
        known.clear()
    try:
        hashes = list(map(known.__getitem__, tokens))
    except KeyError:
        for token in set(tokens):
            if token not in known:
                known[token] = xxhash.xxh3_64_intdigest(token)
        hashes = list(map(known.__getitem__, tokens))
    values = np.array(hashes, dtype=np.uint64)
    width = min(words, len(values))
    rolled = np.full(len(values) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + values[k : len(values) - width + 1 + k])
    rolled.sort()
    return rolled[np.concatenate(([True], rolled[1:] != rolled[:-1]))]


def signature(found: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Minimum of each coordinate's hash, tied to the coordinate by its number."""
    seeds = _mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = np.full(coordinates, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        part = (found[at : at + 4096] ^ seeds[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=1))
    return _mix(least + seeds).view(np.int64)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    likeness: int = LIKENESS,
    coordinates: int = COORDINATES,
    least_matches: int = MATCHES,
) -> DataFrame:
    """Per document its id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts link if 100 * intersection >= ``likeness`` * union of their shingle sets;
    ``component_id`` is the least id reachable by links. Null and empty texts and texts
    without words have no shingles and stand alone. A row with a null id keeps its row, with
    a null component unless its text equals another's. Repeated rows share a component.
    Classes are told apart by 64-bit digests of their sets.
    """

    def build():
        def step(ids, texts):
            sizes, nodes, signatures = [], [], []
            for text in texts:
                found = shingles(text)
                sizes.append(len(found))
                nodes.append(signed(xxhash.xxh3_64_intdigest(found.tobytes())) if len(found) else None)
                signatures.append(signature(found, coordinates) if len(found) else None)
            return ids, sizes, nodes, signatures

        return step

    kind = dict(docs.dtypes)[id_column]
    schema = f"id {kind}, n_shingles bigint, node bigint, signature array<bigint>"
    read = stored(map_columns(docs, [id_column, text_column], build, schema))
    full = read.where(F.col("node").isNotNull())
    classes = stored(
        full.groupBy("node").agg(
            F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")
        )
    )
    postings = _postings(classes, coordinates, least_matches)
    links = _links(docs, id_column, text_column, classes, postings, likeness, least_matches)
    labels = components(links)
    named = (
        classes.select("node", "id")
        .join(labels, "node", "left")
        .select("node", F.coalesce("label", "node").alias("label"), "id")
    )
    least = named.where(F.col("label") != F.col("node")).unionByName(
        named.join(labels.select("label").distinct(), "label", "left_semi").where(F.col("label") == F.col("node"))
    ).groupBy("label").agg(F.min("id").alias("least"))
    component = named.join(least, "label", "left").select("node", F.coalesce("least", "id").alias("component_id"))
    alone = read.where(F.col("node").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    grouped = full.select("id", "n_shingles", "node").join(component, "node").select("id", "n_shingles", "component_id")
    return grouped.unionByName(alone).select(
        F.col("id").alias(id_column),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _postings(classes: DataFrame, coordinates: int, least_matches: int) -> DataFrame:
    """(token, node): the prefix of each class, without values that no other class has.

    The prefix is the ``coordinates - least_matches + 1`` rarest values. Values of one
    class alone count as its rarest and need no posting, so most classes have none.
    """
    tokens = classes.select("node", F.explode("signature").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = tokens.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))
    prefix = F.lit(coordinates - least_matches + 1) - (F.lit(coordinates) - F.size("own"))
    chosen = own.where(prefix > 0).select("node", F.explode(F.slice("own", F.lit(1), prefix)).alias("posted"))
    return stored(chosen.select(F.col("posted.token").alias("token"), "node"))


def _links(docs, id_column, text_column, classes, postings, likeness, least_matches) -> DataFrame:
    """Confirmed links between classes, enough of them to connect every component.

    First the class of each list that has the most copies, most likely what the others stem
    from, meets the others of its list. Where that leaves several components in a list, its
    crowded lists give a forest of the pairs that agree, and then all pairs of a list across
    the components that are left meet: as pairs those of short lists, and inside blocks those
    of crowded ones. Links are confirmed every time.
    """
    ranked = postings.join(classes.select("node", "copies"), "node")
    leaders = ranked.groupBy("token").agg(F.min(F.struct(-F.col("copies"), "node")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = leaders.select("token", "a.node").withColumnRenamed("node", "a").join(postings, "token").where("node <> a")
    star = star.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stored(_confirmed(docs, id_column, text_column, classes, stored(pairs.distinct()), likeness))

    links = confirmed(_agreeing(star.distinct(), classes, least_matches))
    for forest in (True, False):
        open_ = _open_lists(postings, components(links))
        crowded = open_.where(F.col("rows") > SMALL)
        if forest and crowded.isEmpty():
            continue
        found = _within_lists(crowded, postings, classes, likeness, least_matches, forest)
        if forest:
            links = links.unionByName(confirmed(found))
            continue
        links = links.unionByName(stored(_confirmed_within(docs, id_column, text_column, classes, stored(found), likeness)))
        few = open_.where(F.col("rows") <= SMALL)
        other = few.select("token", F.col("node").alias("b"), F.col("label").alias("label_b"))
        mine = few.select("token", F.col("node").alias("a"), "label")
        across = mine.join(other, "token").where("label <> label_b and a < b").select("a", "b").distinct()
        links = links.unionByName(confirmed(_agreeing(across, classes, least_matches)))
    return links


def _open_lists(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """``token, node, label, rows`` of the lists that hold several components."""
    marked = postings.join(labels, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).cast("int").alias("rows")
    ).where("low < high")
    return stored(marked.join(mixed.select("token", "rows"), "token"))


def _within_lists(
    rows: DataFrame, postings: DataFrame, classes: DataFrame, likeness: int, least_matches: int, forest: bool
) -> DataFrame:
    """What agrees across the components of long lists, each pair in the first list of both.

    A list is cut into blocks and every pair of blocks compared in a task of its own. With
    ``forest`` pairs ``a, b`` leave the tasks, only so many as connect the components that all
    of them would, the likeliest first. Else the rows that agree with any other leave them,
    each once per pair of blocks: ``token, low, high, block, node, label``.
    """
    words = rows.join(classes.select("node", "n"), "node").groupBy("token").agg(F.sum("n").alias("words"))
    own = postings.join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_list("token").alias("own"))
    full = rows.join(words, "token").join(own, "node").join(classes.select("node", "signature", "n"), "node")
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("words") / BLOCK_SHINGLES)).cast("int")
    spread = full.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    grouped = spread.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        token, low, high = (int(group[c].iloc[0]) for c in ("token", "low", "high"))
        left, right = group[group["block"] == low], group[group["block"] == high]
        if not len(left) or not len(right):
            return pd.DataFrame({name: np.zeros(0, np.int64) for name in names})
        signatures = [np.stack(side["signature"].to_numpy()) for side in (left, right)]
        matches = np.zeros((len(left), len(right)), dtype=np.uint8)
        for k in range(signatures[0].shape[1]):
            matches += signatures[0][:, k, None] == signatures[1][None, :, k]
        labels, sizes, nodes = ([side[c].to_numpy() for side in (left, right)] for c in ("label", "n", "node"))
        fits = 100 * np.minimum(sizes[0][:, None], sizes[1]) >= likeness * np.maximum(sizes[0][:, None], sizes[1])
        chosen = (matches >= least_matches) & (labels[0][:, None] != labels[1]) & fits
        if low == high:
            chosen &= nodes[0][:, None] < nodes[1]
        if chosen.any():
            chosen &= ~_meet_before(left["own"], right["own"], token)
        if not forest:
            sides = ((left, low, chosen.any(axis=1)), (right, high, chosen.any(axis=0)))
            if low == high:
                sides = ((left, low, chosen.any(axis=1) | chosen.any(axis=0)),)
            parts = [side.loc[agrees, ["token", "low", "high", "node", "label"]].assign(block=block) for side, block, agrees in sides]
            return pd.concat(parts)[names]
        i, j = np.nonzero(chosen)
        kept = _spanning(labels[0][i], labels[1][j], matches[i, j])
        i, j = i[kept], j[kept]
        return pd.DataFrame({"a": np.minimum(nodes[0][i], nodes[1][j]), "b": np.maximum(nodes[0][i], nodes[1][j])})

    names = ["a", "b"] if forest else ["token", "low", "high", "block", "node", "label"]
    kinds = {name: "int" if name in ("low", "high", "block") else "bigint" for name in names}
    return grouped.groupBy("token", "low", "high").applyInPandas(compare, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def _confirmed_within(docs, id_column, text_column, classes, rows, likeness) -> DataFrame:
    """Links ``a, b`` between ``rows`` of the same pair of blocks whose full sets are alike enough.

    All pairs across components are compared inside the task; of the links only so many leave
    it as connect the components that all of them would.
    """
    sets = _sets(docs, id_column, text_column, classes, rows.select("node").distinct())

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        left, right = group[group["block"] == low], group[group["block"] == high]
        both = _overlaps(left["members"], right["members"])
        labels, nodes = ([side[c].to_numpy() for side in (left, right)] for c in ("label", "node"))
        sizes = [side["members"].map(len).to_numpy(dtype=np.int64) for side in (left, right)]
        either = sizes[0][:, None] + sizes[1] - both
        i, j = np.nonzero((100 * both >= likeness * either) & (labels[0][:, None] != labels[1]))
        kept = _spanning(labels[0][i], labels[1][j], 100 * both[i, j] // either[i, j])
        i, j = i[kept], j[kept]
        return pd.DataFrame({"a": np.minimum(nodes[0][i], nodes[1][j]), "b": np.maximum(nodes[0][i], nodes[1][j])})

    return rows.join(sets, "node").groupBy("token", "low", "high").applyInPandas(compare, "a bigint, b bigint")


def _overlaps(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, a row per set of ``left``."""
    sides = [[np.asarray(x, dtype=np.int64) for x in side] for side in (left, right)]
    flats = [np.concatenate([np.zeros(0, np.int64), *side]) for side in sides]
    shared = np.intersect1d(*flats)
    placed = []
    for side, flat in zip(sides, flats):
        rows = np.repeat(np.arange(len(side)), np.array([len(x) for x in side], dtype=np.int64))
        at = np.searchsorted(shared, flat)
        known = at < len(shared)
        known[known] = shared[at[known]] == flat[known]
        rows, at = rows[known], at[known]
        order = np.argsort(at, kind="stable")
        placed.append((rows[order], at[order]))
    total = np.zeros((len(sides[0]), len(sides[1])), dtype=np.int64)
    for first in range(0, len(shared), COLUMNS):
        grids = []
        for side, (rows, at) in zip(sides, placed):
            low, high = np.searchsorted(at, (first, first + COLUMNS))
            grid = np.zeros((len(side), min(COLUMNS, len(shared) - first)), dtype=np.float32)
            grid[rows[low:high], at[low:high] - first] = 1
            grids.append(grid)
        total += (grids[0] @ grids[1].T).astype(np.int64)
    return total


def _spanning(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links that connect what all links connect, the heaviest first."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    for k in np.argsort(-weight.astype(np.int16), kind="stable").tolist():
        low, high = find(int(first[k])), find(int(second[k]))
        if low != high:
            root[high] = low
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def _meet_before(left: pd.Series, right: pd.Series, token: int) -> np.ndarray:
    """Which pairs of rows share a list with a lower token than ``token``."""
    sides = [[np.asarray(x, dtype=np.int64) for x in side] for side in (left, right)]
    sides = [[x[x < token] for x in side] for side in sides]
    shared = np.intersect1d(*(np.concatenate(side) for side in sides))
    grids = []
    for side in sides:
        rows, flat = np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side)
        known = np.isin(flat, shared)
        grid = np.zeros((len(side), len(shared)), dtype=np.float32)
        grid[rows[known], np.searchsorted(shared, flat[known])] = 1
        grids.append(grid)
    return grids[0] @ grids[1].T > 0


def _agreeing(pairs: DataFrame, classes: DataFrame, least_matches: int) -> DataFrame:
    """Pairs whose signatures agree in enough coordinates."""
    a = classes.select(F.col("node").alias("a"), F.col("signature").alias("of_a"))
    b = classes.select(F.col("node").alias("b"), F.col("signature").alias("of_b"))
    agreeing = pairs.join(a, "a").join(b, "b").where(F.size(F.array_intersect("of_a", "of_b")) >= least_matches)
    return agreeing.select("a", "b")


def _sets(docs, id_column, text_column, classes, ends) -> DataFrame:
    """``node, members`` of the classes in ``ends``; one text of each class is read again."""
    wanted = stored(classes.select("node", "id").join(ends, "node"))
    ids = wanted.select(F.col("id").alias(id_column))
    if wanted.count() <= BROADCAST:
        ids = F.broadcast(ids)

    def build():
        def step(texts):
            found = [shingles(t) for t in texts]
            places = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            nodes = [signed(xxhash.xxh3_64_intdigest(f.tobytes())) for f in found]
            return nodes, pa.ListArray.from_arrays(pa.array(places), pa.array(flat))

        return step

    texts = docs.select(id_column, text_column).join(ids, id_column, "left_semi")
    sets = map_columns(texts, [text_column], build, "node bigint, members array<bigint>")
    one = Window.partitionBy("node").orderBy("members")
    return stored(sets.join(wanted.select("node"), "node", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"))


def _confirmed(docs, id_column, text_column, classes, pairs, likeness) -> DataFrame:
    """Pairs whose full sets are alike enough."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(docs, id_column, text_column, classes, ends)
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")), "b"
    )
    both = F.size(F.array_intersect("of_a", "of_b"))
    return joined.where(100 * both >= likeness * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")
