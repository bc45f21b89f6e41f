"""Packing token sequences by non-negative least squares over length combinations.

Every document is cut into full windows and one rest. Shallow combinations of rest lengths
that fill a window exactly (several of one length and one of another) are enumerated, the
number of times to use each is fitted to the histogram of lengths, and rounded down to what
is there. Rests that no combination takes are packed greedily, the longest first, into the
window with the least room that fits.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns, stored

WINDOW = 4096
GROUP = 2048  # rests that one task packs greedily together, about
KEPT = 800_000  # chunks and words kept per task
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"  # letters that are normalised already and have one lower-case letter each
_WORD = re.compile(rf"([{_LATIN}]+)([!-&(-/:-@\[-`{{-~]*)")  # and stops behind it, which the vocabulary splits off


class Encoder:
    """Token ids of whole texts, by the tokenizers library, white-space chunk by chunk.

    The vocabulary drops white space and never joins across it, so a text's ids are those
    of its chunks one after another; chunks already met keep their ids in a bounded table.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        letters = [chr(c) for c in range(256) if re.match(f"[{_LATIN}]", chr(c))]
        self.shown = {ord(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in letters}
        self.known: dict[str, bytes] = {}

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids."""
        known = self.known
        if len(known) > KEPT:
            known.clear()
        split = [_chunks(t or "") for t in texts]
        found = [list(map(known.get, chunks)) for chunks in split]
        self.learn({c for chunks, ids in zip(split, found) if None in ids for c, i in zip(chunks, ids) if i is None})
        return [
            b"".join([known[c] if i is None else i for c, i in zip(chunks, ids)] if None in ids else ids)
            for chunks, ids in zip(split, found)
        ]

    def learn(self, chunks: set[str]) -> None:
        """Keep the ids of new chunks; words of Latin letters need no more than the merges."""
        known, merged, others = self.known, self.coder.model.tokenize, []
        for chunk in chunks:
            m = _WORD.fullmatch(chunk)
            if m is None:
                others.append(chunk)
                continue
            word, stops = m[1].lower(), m[2]
            ids = known.get(word)
            if ids is None:
                tokens = merged(word if word.isascii() else word.translate(self.shown))
                ids = known[word] = array("I", [t.id for t in tokens]).tobytes()
            if stops:
                if stops not in known:
                    known[stops] = array("I", self.coder.encode(stops, add_special_tokens=False).ids).tobytes()
                ids += known[stops]
            known[chunk] = ids
        for chunk, coded in zip(others, self.coder.encode_batch_fast(others, add_special_tokens=False)):
            known[chunk] = array("I", coded.ids).tobytes()


def _chunks(text: str) -> list[str]:
    """Pieces between white space; the four separators U+001C to U+001F are none here."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        plain = text.translate({0x1C: "", 0x1D: "", 0x1E: "", 0x1F: ""})
        if not any(c in text for c in ""):
            back = {0xE000: "\x1c", 0xE001: "\x1d", 0xE002: "\x1e", 0xE003: "\x1f"}
            return [c.translate(back) for c in plain.split()]
        return [text]
    return text.split()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Full windows and rests of every document's ids, each ``length`` numbered per task."""

    def build():
        coder, close = encoder(path), np.array([end], dtype="<u4").tobytes()
        context = TaskContext.get()
        task, numbers = context.partitionId() if context else 0, Counter()

        def step(ids, texts):
            rows = []
            for i, coded in zip(ids, coder.encode_many(texts)):
                whole = memoryview(coded + close)
                size = len(whole) // 4
                for start in range(0, size, window):
                    part = whole[4 * start : 4 * (start + window)]
                    length = len(part) // 4
                    rows.append((i, start, length, zlib.crc32(part), size, task, numbers[length]))
                    numbers[length] += 1
            return [list(c) for c in zip(*rows)] if rows else [[]] * 7

        return step

    kind = dict(docs.dtypes)[id_column]
    return map_columns(
        docs,
        [id_column, text_column],
        build,
        f"`{id_column}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, number bigint",
    )


def combinations(window: int = WINDOW) -> np.ndarray:
    """Rows (a, times, b): ``times`` lengths a and one b, or none if b is 0, fill the window."""
    rows = []
    for a in range(1, window):
        times = np.arange(1, window // a + 1)
        b = window - a * times
        rows.append(np.stack([np.full(len(times), a), times, b], axis=1)[(b != a) & ((times > 1) | (b < a))])
    return np.concatenate(rows)


def fitted(histogram: np.ndarray, window: int = WINDOW, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts that use no more rests than there are.

    Multiplicative steps solve min |A x - histogram| over x >= 0; the solution is rounded to
    the nearest, largest counts first, within the rests that are left, twice over.
    """
    rows = combinations(window)
    a, times, b = rows.T
    present = (histogram[a] >= times) & ((b == 0) | (histogram[b] > 0))
    rows, a, times, b = rows[present], a[present], times[present].astype(float), b[present]
    one = (b > 0).astype(float)
    wanted = histogram.astype(float)
    wanted[0] = 0
    pull = times * wanted[a] + one * wanted[b]
    x = np.minimum(wanted[a] / times, np.where(b > 0, wanted[b], np.inf)) / 8 + 1e-3
    for _ in range(rounds):
        made = np.bincount(a, times * x, minlength=window + 1) + np.bincount(b, one * x, minlength=window + 1)
        x *= pull / np.maximum(times * made[a] + one * made[b], 1e-12)
    left, counts = histogram.copy(), np.zeros(len(rows), dtype=np.int64)
    for rounded in (np.floor(x + 0.5), np.full(len(x), np.iinfo(np.int32).max, dtype=float)):
        for i in np.argsort(-x, kind="stable"):
            p, n, q = rows[i]
            most = left[p] // n if q == 0 else min(left[p] // n, left[q])
            use = int(min(rounded[i], most))
            if use > 0:
                counts[i] += use
                left[p] -= use * n
                left[q] -= use if q else 0
    used = counts > 0
    return rows[used], counts[used]


class Plan:
    """Where the rest of a given length and rank goes."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        rows, counts = fitted(histogram, window)
        self.full = int(histogram[window])
        taken = np.zeros(window + 1, dtype=np.int64)
        slots: dict[int, list] = {}
        sequence = self.full
        for (a, times, b), n in zip(rows.tolist(), counts.tolist()):
            slots.setdefault(a, []).append((taken[a], times, sequence, 0))
            taken[a] += n * times
            if b:
                slots.setdefault(b, []).append((taken[b], 1, sequence, a * times))
                taken[b] += n
            sequence += n
        self.taken, self.next = taken, sequence
        self.rest = int((histogram - taken)[1:window].sum())
        self.slots = {k: np.array(v, dtype=np.int64).T for k, v in slots.items()}

    def place(self, length: int, rank: int, window: int = WINDOW) -> tuple[int | None, int | None]:
        """Sequence and offset, or nothing for a rest that is packed greedily."""
        if length == window:
            return rank, 0
        if rank >= self.taken[length]:
            return None, None
        first, times, sequence, offset = self.slots[length]
        i = int(np.searchsorted(first, rank, side="right")) - 1
        k = rank - int(first[i])
        return int(sequence[i]) + k // int(times[i]), int(offset[i]) + k % int(times[i]) * length


def greedy(lengths: np.ndarray, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, longest first, into the tightest bin with room."""
    bins, offsets, room, sizes = [0] * len(lengths), [0] * len(lengths), [], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(room, (need, -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            free, number = window, len(sizes)
            sizes.append(0)
        bins[i], offsets[i] = number, sizes[number]
        sizes[number] += need
        if free > need:
            bisect.insort(room, (free - need, number))
    return bins, offsets


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece: its document, place in it, checksum, sequence and offset.

    A null or empty text is the closing id alone. Rows with equal ids or texts are packed
    each for itself. An empty table gives no rows.
    """
    rows = stored(pieces(docs, path, window, end, id_column, text_column))
    per_task = rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        histogram[r["length"]] = r["n"]
    plan = Plan(histogram, window)
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by the window

    def build():
        def step(*columns):
            placed = [shared.value.place(n, k, window) for n, k in zip(columns[2], columns[-1])]
            return *columns[:-1], [p[0] for p in placed], [p[1] for p in placed]

        return step

    kind = dict(docs.dtypes)[id_column]
    fields = f"`{id_column}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens"]
    ranked = rows.join(offsets, ["task", "length"]).withColumn("rank", F.col("number") + F.col("before"))
    placed = stored(map_columns(ranked, [*names, "rank"], build, f"{fields}, sequence_id bigint, offset bigint", rows=4096))
    groups = max(1, -(-plan.rest // GROUP))
    salt = F.pmod(F.xxhash64(F.col(id_column).cast("string"), "start", "ids_crc32", "_copy"), F.lit(groups))

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([id_column, "start", "ids_crc32"], kind="stable")
        bins, offsets = greedy(group["length"].to_numpy(), window)
        sequence = plan_next + group["_group"].to_numpy() + groups * np.array(bins, dtype=np.int64)
        return group.assign(sequence_id=sequence, offset=offsets)[[*names, "sequence_id", "offset"]]

    plan_next = plan.next
    left = placed.where(F.col("sequence_id").isNull()).withColumn("_copy", F.rand(7)).withColumn("_group", salt).drop("_copy")
    rest = left.groupBy("_group").applyInPandas(together, f"{fields}, sequence_id bigint, offset bigint")
    return placed.where(F.col("sequence_id").isNotNull()).unionByName(rest)
