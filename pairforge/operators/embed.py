"""Batch model hook: a user function from texts to vectors, applied per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.vectors import as_lists

Encoder = Callable[[Sequence[str]], "object"]


def hashing_encoder(width: int = 64) -> Callable[[], Encoder]:
    """Built-in stand-in for a model: signed hashed bag of words, unit length."""

    def load() -> Encoder:
        from zlib import crc32

        import numpy as np

        def encode(texts: Sequence[str]):
            rows = np.zeros((len(texts), width))
            for i, text in enumerate(texts):
                for word in (text or "").lower().split():
                    code = crc32(word.encode())
                    rows[i, code % width] += 1.0 if code >> 31 else -1.0
            norms = np.linalg.norm(rows, axis=1)
            return rows / np.where(norms > 0, norms, 1.0)[:, None]

        return encode

    return load


def embed_texts(
    df: DataFrame,
    key: str,
    text: str,
    load: Callable[[], Encoder] | None = None,
    batch_size: int = 256,
) -> DataFrame:
    """``(key, vec)`` for every text. ``load`` runs once per task, e.g. to open a model."""
    opener = load or hashing_encoder()
    kind = dict(df.dtypes)[key]

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        model = opener()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [
                np.asarray(model(texts[i : i + batch_size]), dtype=np.float64)
                for i in range(0, len(texts), batch_size)
            ]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), as_lists(np.vstack(parts))], names=[key, "vec"]
                )

    return df.select(key, F.col(text).cast("string")).mapInArrow(
        encode, f"{key} {kind}, vec array<double>"
    )
