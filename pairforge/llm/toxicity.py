"""Toxicity by weak supervision.

Many weak voters look at a text: lexicon voters (one per word or word beginning), and
pattern voters (shouting and exclamation, no hit at all). A generative model of the votes
estimates each voter's accuracy by expectation maximisation and discounts voters that vote
together. A linear classifier is then trained on the posterior labels and scores texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns, stored, summed

SAMPLE = 12_000  # most labelled rows that the classifier is fitted on, about
SUPPORT = 3  # least number of different label-1 texts that show a term
CHANCE = 0.05  # expected number of terms that pass without telling the labels apart
BEGINNINGS = (3, 4, 5)
ODDS = 3.0  # least log ratio of a term's frequency under label 1 to that under label 0
WORDS_OF_BITS = 1 << 18  # size of the filter of labelled ids, 64 bits each
DEPENDENT = 0.7  # least correlation that is taken for a dependence between voters
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")
_MARKS = re.compile(r"[!?]{2,}")
PATTERNS = ("shouting", "no_hit")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def terms_of(words: set[str]) -> set[str]:
    """Whole words, and longer words' beginnings with a mark behind them."""
    found = set(words)
    for size in BEGINNINGS:
        found |= {w[:size] + "~" for w in words if len(w) > size}
    return found


def sampled(labelled: DataFrame, label: str, bound: int = SAMPLE, id_column: str = "doc_id") -> DataFrame:
    """Ids and labels of about ``bound`` rows, half of them of either label if there are so many.

    Rows are chosen by a hash of the id, so the choice does not depend on partitions.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect() if r[0] in (0, 1)}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, bound / 2 / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(F.col(label).isin(0, 1) & (draw < share)).select(id_column, label)


def different(docs: DataFrame, labels: DataFrame, label: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The least id and the label of every text that has this label, so that copies count once."""
    texts = docs.select(id_column, F.sha2(F.col(text_column).cast("binary"), 256).alias("digest"))
    named = texts.join(labels.where(F.col(label).isin(0, 1)).select(id_column, label), id_column)
    return named.groupBy("digest", label).agg(F.min(id_column).alias(id_column)).select(id_column, label)


def likely(rows: DataFrame, wanted: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows of ``rows`` whose id may be in ``wanted``: all that are, and a share of the others.

    A filter of ``WORDS_OF_BITS`` words of 64 bits, one bit per id, is broadcast whatever the
    number of ids, so that a later join shuffles few rows that it drops.
    """
    digest = F.xxhash64(F.col(id_column).cast("string"), F.lit("likely"))
    word, bit = F.pmod(digest, F.lit(WORDS_OF_BITS)), F.pmod(F.shiftright(digest, 40), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = wanted.select(word.alias("_word"), one.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return marked.where(F.getbit("_bits", bit) == 1).select(*rows.columns)


def mine_terms(learning: DataFrame, label: str, text_column: str = "text") -> list[str]:
    """Terms that tell label 1 from label 0, the strongest first.

    A term counts texts, and is one if its likelihood ratio under one or two rates stands
    out among as many terms as there are; neither a share of the texts nor a rank bounds it.
    """

    def build():
        held: dict[str, list[int]] = {}

        def step(texts=None, labels=None):
            for text, value in zip(texts or [], labels or []):
                for term in terms_of(words_of(text)):
                    held.setdefault(term, [0, 0])[value] += 1
            if texts is not None and len(held) < 1 << 18:
                return [], [], []
            out = list(held), [n[0] for n in held.values()], [n[1] for n in held.values()]
            held.clear()
            return out

        return step

    counted = map_columns(learning, [text_column, label], build, "term string, neg bigint, pos bigint", finish=True)
    size = {r[0]: r[1] for r in learning.groupBy(label).count().collect()}
    pos, neg = float(size.get(1, 0)), float(size.get(0, 0))
    share = (pos + 0.5) / (pos + neg + 1.0)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    both = F.col("pos") + F.col("neg")
    ratio = 2 * (
        F.col("pos") * F.log(F.col("pos") / (both * share))
        + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (both * (1 - share)))).otherwise(0.0)
    )
    totals = stored(counted.groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(F.col("pos") >= SUPPORT))
    tried = max(1, totals.count())
    best = totals.where((odds > ODDS) & (ratio > 2 * float(np.log(tried / CHANCE)))).orderBy(F.desc(odds * F.sqrt("pos")), "term")
    return [r.term for r in best.select("term").collect()]


class Features:
    """Which known terms and patterns a text shows, as feature numbers."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        self.number = {t: i for i, t in enumerate(terms)}
        self.whole = {t for t in terms if not t.endswith("~")}
        self.starts = {n: {t for t in terms if t.endswith("~") and len(t) == n + 1} for n in BEGINNINGS}
        self.size = len(self.terms) + len(PATTERNS)

    def of(self, text: str | None) -> list[int]:
        words = words_of(text)
        whole = words & self.whole
        starts = {t for n, known in self.starts.items() if known for t in {w[:n] + "~" for w in words if len(w) > n} & known}
        found = [self.number[t] for t in whole | starts]
        shown = (len(_SHOUT.findall(text or "")) >= 3 or bool(_MARKS.search(text or "")), not found)
        return sorted(found) + [len(self.terms) + i for i, x in enumerate(shown) if x]


def _flat(rows: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the marks of a sparse table."""
    lengths = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), lengths), np.fromiter((c for r in rows for c in r), dtype=np.int64, count=sum(lengths))


def _dependence(rows: Sequence[Sequence[int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of columns with marks in one row, and in how many."""
    keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    part: list[np.ndarray] = []
    held = 0
    for i, row in enumerate(rows):
        own = np.asarray(row, dtype=np.int64)
        part.append((own[:, None] * size + own).ravel())
        held += len(own) ** 2
        if held > 1 << 22 or i == len(rows) - 1:
            keys, counts = summed([(keys, counts), np.unique(np.concatenate(part), return_counts=True)])
            part, held = [], 0
    return keys // size, keys % size, counts


def label_model(votes: Sequence[Sequence[int]], against: Sequence[int], size: int, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior of label 1 for each row of ``votes``, the numbers of the voters that speak.

    Those in ``against`` vote for label 0. Each voter has its own rates of voting under
    either label; not voting tells nothing, since most voters know one language only.
    Rates come from expectation maximisation, started at the votes' balance; the weight
    of a voter in a posterior is one over the sum of its correlations of ``DEPENDENT`` or
    more with all voters, in who votes where and within what is believed of the label, so
    that near-copies of a voter count once together.
    """
    n = len(votes)
    row, voter = _flat(votes)
    sign = np.ones(size)
    sign[list(against)] = -1
    spoken = np.bincount(row, sign[voter], minlength=n)
    belief = np.where(spoken > 0, 0.9, np.where(spoken < 0, 0.02, prior))
    first, second, together = _dependence(votes, size)
    weight = np.ones(size)
    for turn in range(rounds):
        mass = (belief.sum() + 1.0, (1 - belief).sum() + 1.0)
        told = [np.bincount(voter, b[row], minlength=size) for b in (belief, 1 - belief)]
        rate = [(t + 0.1) / (m + 0.2) for t, m in zip(told, mass)]
        if turn % 10 == 0:
            b, c = belief, 1 - belief
            (s, t), (x, y) = rate, told

            def spread(i, j, both):
                cross = x[i] * s[j] + s[i] * x[j] + y[i] * t[j] + t[i] * y[j]
                return both - cross + (b @ b) * s[i] * s[j] + (c @ c) * t[i] * t[j] + (b @ c) * (s[i] * t[j] + t[i] * s[j])

            every = np.arange(size)
            scale = np.sqrt(np.maximum(spread(every, every, told[0] + told[1]), 1e-6))
            linked = spread(first, second, together) / (scale[first] * scale[second])
            weight = 1.0 / np.maximum(1.0, np.bincount(first, np.where(linked >= DEPENDENT, linked, 0), minlength=size))
        evidence = np.bincount(row, (weight * (np.log(rate[0]) - np.log(rate[1])))[voter], minlength=n)
        share = min(max(prior, 1e-4), 1 - 1e-4)
        new = 1 / (1 + np.exp(-np.clip(evidence + np.log(share / (1 - share)), -30, 30)))
        if np.abs(new - belief).max() < 1e-6:
            break
        belief = new
    return belief


def linear_classifier(rows: Sequence[Sequence[int]], size: int, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of a logistic regression on soft labels; the last one is the bias."""
    row, column = _flat([[*r, size] for r in rows])
    w, v, m = (np.zeros(size + 1, dtype=np.float64) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], minlength=len(rows)), -30, 30)))
        slope = np.bincount(column, (p - target)[row], minlength=size + 1) / len(rows) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, id_column: str = "doc_id",
        text_column: str = "text") -> dict:
    """Terms and weights learned from ``labels`` (unique ids and 0/1 labels) and the texts.

    The labels choose the terms, from all different texts, and give the share of label 1;
    the classifier itself sees posterior labels only, of at most about ``bound`` texts.
    """
    counts = {r[0]: r[1] for r in labels.groupBy(label).count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    share = (pos + 0.5) / (pos + neg + 1.0)
    empty = {"terms": [], "weights": [0.0] * len(PATTERNS) + [float(np.log(share / (1 - share)))]}
    if not pos or not neg:
        return empty
    chosen = stored(different(docs, labels, label, id_column, text_column))
    texts = docs.select(id_column, text_column)
    # The same plan at every size: only texts that may be chosen are shuffled.
    learning = likely(texts, chosen, id_column).join(chosen.hint("merge"), id_column)
    terms = mine_terms(learning, label, text_column)
    if not terms:
        return empty
    known = Features(terms)
    sample = texts.join(F.broadcast(sampled(chosen, label, bound, id_column)), id_column)  # bounded by ``bound``
    found = map_columns(
        sample, [text_column, label], lambda: lambda texts, values: ([known.of(t) for t in texts], values), "found array<int>, label int"
    )
    rows, values = zip(*((r.found, r.label) for r in found.collect()))
    drawn = sum(values) / len(values)
    posterior = label_model(rows, [len(terms) + PATTERNS.index("no_hit")], known.size, drawn)
    weights = linear_classifier(rows, known.size, posterior)
    # The sample holds both labels half and half where there are many; the bias takes that back.
    held = {r[0]: r[1] for r in chosen.groupBy(label).count().collect()}
    seen = (sum(values) + 0.5, len(values) - sum(values) + 0.5)
    weights[-1] += np.log((held.get(1, 0) + 0.5) / (held.get(0, 0) + 0.5)) - np.log(seen[0] / seen[1])
    return {"terms": terms, "weights": weights.tolist()}


def score(docs: DataFrame, model: dict, keep: Sequence[str | Column] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """``keep`` columns of every row with ``score`` (0 to 1) and ``predicted`` (0 or 1).

    A null text counts as empty; an empty text gets the score of a text without any term.
    """
    kept = docs.select(*keep)

    def build():
        known = Features(model["terms"])
        weights, bias = np.array(model["weights"][:-1]), model["weights"][-1]

        def step(*columns):
            sums = [float(weights[known.of(t)].sum()) + bias for t in columns[-1]]
            return *columns[:-1], [1 / (1 + float(np.exp(-max(-30.0, min(30.0, s))))) for s in sums]

        return step

    fields = "".join(f"`{name}` {kind}, " for name, kind in kept.dtypes)
    scored = map_columns(docs, [*keep, text_column], build, f"{fields}score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
