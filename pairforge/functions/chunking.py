"""Sentence-first chunking of texts into pieces of at most ``limit`` words."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.text import tokens

# Sentence ends, and marks that hug the token before them.
SENTENCE_ENDS = frozenset(".。!！?？;；")
HUGGING = frozenset(",.!?;:。！？；：")


def _is_word(token: str) -> bool:
    return token[0].isalnum() or token[0] == "_"


def _join(piece: list[str]) -> str:
    out: list[str] = []
    for token in piece:
        if out and token in HUGGING:
            out[-1] += token
        else:
            out.append(token)
    return " ".join(out)


def chunk_tokens(sequence: list[str], limit: int = 8) -> Iterator[str]:
    """Cut at the last sentence end once ``limit`` words wait, else after word ``limit``.

    At most one cut happens per token, so a sentence end right after the last word of a
    full chunk opens the next one.
    """
    waiting: list[str] = []
    n_words = 0
    for token in sequence:
        waiting.append(token)
        n_words += _is_word(token)
        if n_words < limit:
            continue
        seen, at_end, at_limit = 0, -1, -1
        for place, waited in enumerate(waiting):
            if _is_word(waited):
                seen += 1
                if seen == limit and at_limit < 0:
                    at_limit = place
            elif waited in SENTENCE_ENDS and seen <= limit:
                at_end = place
        cut = (at_end if at_end >= 0 else at_limit) + 1
        yield _join(waiting[:cut])
        n_words -= sum(map(_is_word, waiting[:cut]))
        waiting = waiting[cut:]
    if waiting:
        yield _join(waiting)


def chunks(text: Column, limit: int = 8) -> Column:
    """Chunks of a text, in order. Tokens come from a built-in expression."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(batch):
        import pyarrow as pa

        return pa.array(
            [None if row is None else list(chunk_tokens(row, limit)) for row in batch.to_pylist()],
            pa.list_(pa.string()),
        )

    return split(tokens(text))
