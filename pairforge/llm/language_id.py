"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams, n from 1 to 3, of lower-cased words
padded with a blank on either side. A text goes to the language whose profile lies at the
least out-of-place distance from the text's own: the sum over the text's n-grams of how
far their ranks differ, an n-gram missing from the profile costing the profile's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns, summed

SIZE = 300  # n-grams in a profile
LANGUAGES = 5000  # most languages a table of profiles may hold
UNKNOWN = "und"
_BITS = 21  # of a code point; three of them fit one integer
_FLUSH = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, n code points packed into one integer."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < 3:
        return codes[:0]
    pairs = (codes[:-1] << _BITS) | codes[1:]
    triples = ((codes[:-2] << 2 * _BITS) | (codes[1:-1] << _BITS) | codes[2:])[codes[1:-1] != 32]
    return np.concatenate((codes[codes != 32], pairs, triples))


def profile(text: str | None, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams, ties by their packed value; empty without letters."""
    found, counts = np.unique(grams(text or ""), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of every profile's n-grams, as one matrix."""

    def __init__(self, rows: Sequence[tuple[str, int, int]], size: int = SIZE):
        """``rows``: language, n-gram, rank from 0."""
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), place[lang]] = rank

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to every language."""
        at = np.searchsorted(self.grams, own)
        missing = self.grams[np.minimum(at, len(self.grams) - 1)] != own
        ranks = self.ranks[np.where(missing, len(self.grams), at)]
        apart = np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])
        return np.where(ranks < 0, self.size, apart).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and the margin of its distance over the next one's, 0 to 1."""
        own = profile(text, self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        apart = self.distances(own)
        best = int(np.argmin(apart))
        others = np.delete(apart, best)
        second = float(others.min()) if len(others) else float(self.size * len(own))
        return self.langs[best], 1.0 - float(apart[best]) / second if second > 0 else 0.0


def learn_profiles(docs: DataFrame, size: int = SIZE, text_column: str = "text", lang_column: str = "lang") -> list:
    """Profile rows (language, n-gram, rank) from all rows of ``docs`` with a language.

    Counts are added up inside each task before the shuffle, so a language with most of
    the rows is no hot key. The result has at most ``LANGUAGES * size`` rows.
    """

    def build():
        held: dict[str, list] = {}

        def emptied():
            rows = [(lang, *summed(parts)) for lang, parts in held.items()]
            held.clear()
            langs = [lang for lang, found, _ in rows for _ in range(len(found))]
            return langs, *[np.concatenate([r[i] for r in rows]).tolist() if rows else [] for i in (1, 2)]

        def step(texts=None, langs=None):
            if texts is None:
                return emptied()
            for lang in set(langs):
                own = grams(" ".join(t for t, x in zip(texts, langs) if x == lang and t))
                held.setdefault(lang, []).append(np.unique(own, return_counts=True))
                if len(held[lang]) > 16:
                    held[lang] = [summed(held[lang])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > _FLUSH:
                return emptied()
            return [], [], []

        return step

    labelled = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    counted = (
        map_columns(labelled, [text_column, lang_column], build, "lang string, gram bigint, n bigint", finish=True)
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    rows = [(r.lang, r.gram, r.rank) for r in top.select("lang", "gram", "rank").limit(LANGUAGES * size + 1).collect()]
    if len(rows) > LANGUAGES * size:
        raise ValueError(f"more than {LANGUAGES} languages")
    return rows


def identify(
    docs: DataFrame, rows: list, keep: Sequence[str | Column] = ("doc_id",), text_column: str = "text", size: int = SIZE
) -> DataFrame:
    """``keep`` columns of each row with ``lang_pred`` and ``score``.

    A null text, a text without a letter or an empty set of profiles gives ``und`` with
    score 0. Of languages at the same distance the first by name wins.
    """
    kept = docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def build():
        known = Profiles(shared.value, size)

        def step(*columns):
            found = [known.predict(t) for t in columns[-1]]
            return *columns[:-1], [f[0] for f in found], [f[1] for f in found]

        return step

    fields = "".join(f"`{name}` {kind}, " for name, kind in kept.dtypes)
    return map_columns(docs, [*keep, text_column], build, f"{fields}lang_pred string, score double")
