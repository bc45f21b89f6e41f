"""SimHash fingerprints, and a search in permuted block tables.

The terms of a text are its runs of up to three words. Every term's hash votes for or
against each bit with the weight 1 + ln(count), and the sign of the sum is the bit. For the
search a fingerprint is cut into one block more than the radius; within the radius at
least one block of a pair is equal, so a table per block brings all such pairs together.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns, stored

BITS = 256
TERM = 3  # words in a term
KEPT = 400_000
SEGMENT = 2 << 20  # bytes of text in one segment, about
SEGMENTS = 50_000  # most segments; beyond it they grow
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1


@lru_cache(maxsize=1)
def _known() -> dict[str, int]:
    return {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, bits: int = BITS) -> bytes:
    """Fingerprint of a text; a text without words has the one of no votes, all zeros.

    Equal texts have equal fingerprints, as have texts that differ in white space or case.
    """
    words = (text or "").lower().split()
    if not words:
        return bytes(bits // 8)
    known = _known()
    if len(known) > KEPT:
        known.clear()
    for word in set(words):
        if word not in known:
            known[word] = xxhash.xxh3_64_intdigest(word)
    values = np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
    width = min(TERM, len(values))
    terms = np.zeros(len(values) - width + 1, dtype=np.uint64)
    for k in range(width):
        terms = _mix(terms * np.uint64(3) + values[k : len(values) - width + 1 + k])
    terms, counts = np.unique(terms, return_counts=True)
    lanes = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashed = _mix(terms[:, None] + lanes).view(np.uint8).reshape(len(terms), -1).astype(np.int64)
    hashed += np.arange(bits // 8) * 256
    weights = np.repeat(1 + np.log(counts), bits // 8) if counts.max() > 1 else None
    votes = np.bincount(hashed.ravel(), weights, minlength=32 * bits).reshape(-1, 256) @ _SIGNS
    return np.packbits(votes.ravel() > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """Id and ``fingerprint`` of every row; a null text counts as empty."""
    kind = dict(docs.dtypes)[id_column]
    return map_columns(
        docs,
        [id_column, text_column],
        lambda: lambda ids, texts: (ids, [fingerprint(t, bits) for t in texts]),
        f"`{id_column}` {kind}, fingerprint binary",
    )


def within_radius(prints: DataFrame, radius: int, id_column: str = "doc_id", bits: int = BITS) -> DataFrame:
    """All pairs of distinct fingerprints at most ``radius`` bits apart: ``a``, ``b``, ``distance``.

    ``prints`` has the ids and fingerprints; equal fingerprints are one, and those of no
    votes take no part. A pair is given once, by the first block that both share.
    """
    blocks = radius + 1
    if blocks > bits // 8:
        raise ValueError("the radius leaves less than eight bits to a block")
    cuts = [bits * i // blocks for i in range(blocks + 1)]

    def build():
        def step(found):
            rows = []
            for f in found:
                whole = int.from_bytes(f)
                for i in range(blocks):
                    part = whole >> (bits - cuts[i + 1]) & (1 << cuts[i + 1] - cuts[i]) - 1
                    rows.append((i, part.to_bytes(bits // 8), f))
            return [list(c) for c in zip(*rows)] if rows else [[]] * 3

        return step

    distinct = prints.select("fingerprint").where(F.col("fingerprint") != F.lit(bytes(bits // 8))).distinct()
    posted = stored(map_columns(distinct, ["fingerprint"], build, "block int, part binary, fingerprint binary"))

    def compare():
        def step(blocks_, a, b):
            out = []
            for i, x, y in zip(blocks_, a, b):
                apart = int.from_bytes(x) ^ int.from_bytes(y)
                first = next(k for k in range(blocks) if not apart >> (bits - cuts[k + 1]) & (1 << cuts[k + 1] - cuts[k]) - 1)
                if first == i and apart.bit_count() <= radius:
                    out.append((x, y, apart.bit_count()))
            return [list(c) for c in zip(*out)] if out else [[]] * 3

        return step

    many = posted.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    left = posted.join(many, ["block", "part"])
    pairs = left.select("block", "part", F.col("fingerprint").alias("a")).join(
        left.select("block", "part", F.col("fingerprint").alias("b")), ["block", "part"]
    )
    return map_columns(pairs.where("a < b"), ["block", "a", "b"], compare, "a binary, b binary, distance int")


def edited(text: str | None, following: str | None) -> str:
    """The text with its last half replaced by the start of the following one."""
    text, half = text or "", len(text or "") // 2
    return text[: len(text) - half] + (following or "")[:half]


def compared_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The next document is the one with the next lower id; after the lowest comes the highest
    again. Rows with equal ids follow each other by text, null ids come last; a single row is
    its own next. Ids are whole numbers. They are cut into segments; a row goes to the segment
    of its id and, if it leads a segment, also to the segment before. Each segment is read in
    order, row by row, so its size does not matter.
    """
    base = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    size, high = base.agg(F.sum(F.octet_length("text")), F.max("id")).first()
    parts = max(1, min(SEGMENTS, (size or 0) // SEGMENT))
    cuts = [] if high is None else base.agg(F.percentile_approx("id", [i / parts for i in range(1, parts + 1)], 10 * parts)).first()[0]
    leads = np.unique(np.array([*cuts, high] if cuts else [], dtype=np.int64))[::-1]  # the highest id of each segment
    shared = docs.sparkSession.sparkContext.broadcast(leads)

    @F.pandas_udf("array<bigint>")
    def targets(ids: pd.Series) -> pd.Series:
        """Segment of each id, and for a leading id the one before it as -1 - segment."""
        known = shared.value
        out = []
        for i in ids:
            if pd.isna(i):
                at, first = max(len(known) - 1, 0), not len(known)
            else:
                at = int(np.searchsorted(-known, -int(i), side="right")) - 1
                first = int(i) == int(known[at])
            out.append([at, -1 - (at - 1) % max(len(known), 1)] if first else [at])
        return pd.Series(out)

    sent = base.select("id", "text", F.explode(targets("id")).alias("to"))
    rows = sent.select(
        "id", "text", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("at"), (F.col("to") < 0).alias("guest")
    )
    ordered = rows.repartition("at").sortWithinPartitions("at", "guest", F.desc_nulls_last("id"), "text")

    def build():
        held = []  # the row whose next one has not come yet

        def step(ids, texts, segments, guests):
            out = []
            for i, text, at, guest in zip(ids, texts, segments, guests):
                own = fingerprint(text, bits)
                if held and held[0][2] == at:
                    before, was = held[0][1], held[0][3]
                    changed = edited(before, text)
                    new = fingerprint(changed, bits)
                    out.append((held[0][0], len(before), sha256(changed.encode()).hexdigest(), was.hex(), new.hex(), likeness(was, new), likeness(was, own)))
                held[:] = [] if guest else [(i, text, at, own)]
            return [list(c) for c in zip(*out)] if out else [[]] * 7

        return step

    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_columns(ordered, ["id", "text", "at", "guest"], build, schema)
