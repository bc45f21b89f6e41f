"""Source divergence audit on run-length columns.

Terms are counted per task and language, source and term, then per term over all tasks. The
kept terms of a language are dealt over blocks of bounded size. Within a block the terms are
ordered by their total and by a digest of their counts in all sources, so that terms with
equal counts lie beside each other, and the counts of every source become one run-length
column. A pair of sources costs the union of their run boundaries: the difference of their
shares, which is constant between two boundaries, times the length.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns, stored

# A term in lower-cased UTF-8, the least documents of a kept term, the scale of
# a share, the count added to every term, and the ranks reported of a group's terms.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCS = 30
SCALE = 1_000_000_000
ADDED = 5
TOP = 50

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_OTHER = re.compile(rb"[^a-z\x80-\xff]")
_PIECE = 4 << 20  # bytes of a text that are split into terms at once
_HELD = 200_000  # counts that a task holds before it hands them on
_BLOCK_ROWS = 1_000_000  # counts in a block of terms


def _pieces(text: bytes):
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, summed per task only."""

    def build():
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            rows = [(*key, t, n, held[t]) for key, (found, held) in seen.items() for t, n in found.items()]
            seen.clear()
            return [list(c) for c in zip(*rows)] if rows else [[]] * 5

        def step(langs=(), sources=(), texts=None):
            if texts is None:
                return flush()
            for lang, source, text in zip(langs, sources, texts):
                found, held = seen.setdefault((lang, source), (Counter(), Counter()))
                text = text.translate(_LOWER)
                if len(text) <= _PIECE:
                    terms = TERM.findall(text)
                    found.update(terms)
                    held.update(set(terms))
                    continue
                own: set[bytes] = set()
                for piece in _pieces(text):
                    terms = TERM.findall(piece)
                    found.update(terms)
                    own.update(terms)
                held.update(own)
            return flush() if sum(len(f) for f, _ in seen.values()) > _HELD else [[]] * 5

        return step

    columns = [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("lang", "source", "text")]
    given = docs.select(*columns).withColumn("text", F.col("text").cast("binary"))
    counted = map_columns(given, ["lang", "source", "text"], build, "lang string, source string, term binary, n long, docs long", 64, True)
    return counted.withColumn("term", F.col("term").cast("string"))


def _share(count: Column, total: Column, size: Column) -> Column:
    """``1 + floor(SCALE * (count + ADDED) / (total + ADDED * size))`` in exact decimals."""
    above = (count + ADDED).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, (total + size * ADDED).cast("decimal(19,0)")) + 1


def shares(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """As ``_share``, of an array of counts."""
    if len(counts) and int(counts.max()) >= (1 << 63) // SCALE - ADDED:
        counts = counts.astype(object)
    return (1 + (counts + ADDED) * SCALE // (total + ADDED * size)).astype(np.int64)


def run_lengths(places: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts of the runs of a column of ``size`` terms that is zero elsewhere.

    ``places`` are the sorted positions of the counts above zero.
    """
    if not len(places):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    fresh = np.ones(len(places), bool)
    fresh[1:] = (np.diff(places) != 1) | (np.diff(counts) != 0)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(places)) - 1
    starts = np.stack([places[first], places[last] + 1], axis=1).ravel()
    values = np.stack([counts[first], np.zeros(len(first), np.int64)], axis=1).ravel()
    starts, values = np.append(0, starts), np.append(0, values)
    kept = np.append(starts[:-1] != starts[1:], True) & (starts < size)  # runs without a term go
    return starts[kept], values[kept]


def distance(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum of the absolute differences of two run-length columns (starts, shares)."""
    edges = np.union1d(one[0], other[0])
    f = np.abs(
        one[1][np.searchsorted(one[0], edges, "right") - 1] - other[1][np.searchsorted(other[0], edges, "right") - 1]
    )
    return int((f * np.diff(edges, append=size)).sum())


def _block_distances(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Distances of all pairs of a language's sources over the terms of one block."""
    known = rows.filter(pc.is_null(rows["n"])).sort_by("source")
    sources = known["source"].to_pylist()
    totals, sizes = known["group_n"].to_pylist(), known["terms"].to_pylist()
    held = rows.filter(pc.is_valid(rows["n"])).sort_by([("total", "descending"), ("digest", "ascending"), ("term", "ascending")])
    terms = pc.run_end_encode(held["term"].combine_chunks(), run_end_type=pa.int64())
    ends = np.asarray(terms.run_ends)
    place = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    owner = pc.index_in(held["source"].combine_chunks(), value_set=pa.array(sources, pa.string())).to_numpy()
    order = np.argsort(owner, kind="stable")
    owner, place, counts = owner[order], place[order], held["n"].to_numpy()[order]
    bounds = np.searchsorted(owner, np.arange(len(sources) + 1))
    columns = []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        starts, values = run_lengths(place[low:high], counts[low:high], len(ends))
        columns.append((starts, shares(values, totals[k], sizes[k]) if sizes[k] else values))
    one, other = np.triu_indices(len(sources), 1)
    f = [distance(columns[a], columns[b], len(ends)) for a, b in zip(one.tolist(), other.tolist())]
    names = pa.array(sources, pa.string())
    langs = pa.array([key[0].as_py()] * len(one), pa.string())
    return pa.table({"lang": langs, "a": names.take(pa.array(one)), "b": names.take(pa.array(other)), "f": pa.array(f, pa.int64())})


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every language and source.

    Part ``pair`` lists the other sources of the language by their distance over all kept
    terms, part ``term`` the terms that a source uses more than its language does. Null
    ``lang``, ``source`` and ``text`` are empty strings; every row is a document, repeated
    ones too. A language without kept terms has distances of 0, one with a single source no
    pairs; an empty table gives no rows. Only these three columns are read. Texts are split
    in pieces, so beside a text a task holds its distinct terms. The result has a row for every
    ordered pair of a language's sources, so the work grows with the square of their number.
    """
    docs = docs.select("lang", "source", "text")
    word = Window.partitionBy("lang", "term")
    counted = (
        term_counts(docs)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("docs", F.sum("docs").over(word))
        .where(F.col("docs") >= LEAST_DOCS)
        .withColumn("total", F.sum("n").over(word))
        .withColumn("digest", F.bit_xor(F.xxhash64("source", "n")).over(word))
        .withColumn("first", F.row_number().over(word.orderBy("source")) == 1)
    )
    kept = stored(counted.select("lang", "term", "source", "n", "total", "digest", "first"))
    names = [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("lang", "source")]
    every = docs.select(*names).distinct()
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("terms"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    wide = F.greatest(F.lit(256), F.floor(F.lit(_BLOCK_ROWS) / F.col("sources")))
    langs = stored(
        every.groupBy("lang")
        .agg(F.count("*").alias("sources"))
        .join(of_lang, "lang", "left")
        .na.fill(0, ["lang_n", "terms"])
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / wide)).cast("long"))
    )
    groups = stored(every.join(of_group, ["lang", "source"], "left").na.fill(0, ["group_n"]).join(langs, "lang"))

    entries = kept.join(langs.where("sources > 1").select("lang", "blocks"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n", "total", "digest",
        F.lit(None).cast("long").alias("group_n"), F.lit(None).cast("long").alias("terms"),
    )
    heads = groups.where("sources > 1").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source",
        *[F.lit(None).cast(t).alias(n) for n, t in (("term", "string"), ("n", "long"), ("total", "long"), ("digest", "long"))],
        "group_n", "terms",
    )
    block = entries.unionByName(heads).groupBy("lang", "block")
    halves = (
        block.applyInArrow(_block_distances, "lang string, a string, b string, f long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("f").alias("value"))
    )
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = halves.select("lang", "value", F.explode(both).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    used = (
        kept.select("lang", "source", "term", "n", "total")
        .join(groups.select("lang", "source", "group_n", "lang_n", "terms"), ["lang", "source"])
        .withColumn("value", _share(F.col("n"), F.col("group_n"), F.col("terms")) - _share(F.col("total"), F.col("lang_n"), F.col("terms")))
        .where("value > 0")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(used.withColumn("rank", rank).where(F.col("rank") <= TOP))
