"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pairforge.operators.scaling import checkpoint_folder


def map_columns(
    df: DataFrame,
    columns: Sequence[str | Column],
    build: Callable[[], Callable],
    schema: str,
    rows: int = 256,
    finish: bool = False,
) -> DataFrame:
    """Run a Python step over slices of ``rows`` rows, as Arrow batches inside the tasks.

    ``build()`` runs once per task and returns ``step(*lists) -> lists``, one list (or
    Arrow array) per output column; the output may have another number of rows. Only
    ``columns`` are read, so other columns of ``df`` never matter. With ``finish`` the
    step is called once more without arguments at the end of the task.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()

        def packed(out) -> pa.RecordBatch:
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, fields)]
            return pa.RecordBatch.from_arrays(arrays, schema=fields)

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield packed(step(*[part.column(i).to_pylist() for i in range(part.num_columns)]))
        if finish:
            yield packed(step())

    return df.select(*columns).mapInArrow(run, schema)


def id_remainder(column: str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that several readers do not repeat the work, survives lost
    executors, and prunes columns on reading. The folder is the one that
    ``spark.checkpoint.dir`` names.
    """
    spark: SparkSession = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and total counts of several (keys, counts)."""
    found, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(found))
    return found, counts.astype(np.int64)


def signed(digest: int) -> int:
    """An unsigned 64-bit digest as the signed integer that Spark holds."""
    return digest - (1 << 64) if digest >> 63 else digest
