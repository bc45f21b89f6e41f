"""File manifests: path, size and SHA-256, and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: folders that never enter a manifest.
IGNORED = (
    ".git",
    "__pycache__",
    ".pytest_cache",
    "_audit",
    "_staging",
    "checkpoints",
    "outputs",
)

HELD_BYTES = 16 << 20  # a file up to this size is read whole by the JVM, a larger one in pieces
PIECE_BYTES = 4 << 20


def _located(path: str):
    """PyArrow's file system of a path, and the path in it; an error if it has none."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:"):
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(quote(path, safe=":/@"))


def _can_stream(path: str) -> bool:
    try:
        return bool(_located(path))
    except (OSError, ValueError, NotImplementedError):
        return False


def _pieces_digest(path: str) -> str:
    """SHA-256 of a file of any size, read in pieces where the task runs."""
    system, place = _located(path)
    digest = hashlib.sha256()
    with system.open_input_stream(place, compression=None) as stream:
        while piece := stream.read(PIECE_BYTES):
            digest.update(piece)
    return digest.hexdigest()


def _digests(files: DataFrame) -> DataFrame:
    """``(path, length, sha256)`` of the files of a ``binaryFile`` reader.

    The reader skips the content of the larger files, since the condition on their length reaches it.
    Their digests run over pieces, one file after another in a task, so neither the size that a binary
    column can hold nor a task's memory bounds a file. Where PyArrow has no file system for the scheme,
    the JVM reads all files whole, and one above 2 GB fails loudly.
    """
    some = files.select("path").first()
    if some is not None and not _can_stream(some["path"]):
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    whole = files.where(F.col("length") <= HELD_BYTES).select("path", "length", F.sha2("content", 256).alias("sha256"))

    def stream(batches):
        import pyarrow as pa

        for batch in batches:
            digests = [_pieces_digest(path) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "sha256"])

    large = files.where(F.col("length") > HELD_BYTES).select("path", "length")
    return whole.unionByName(large.mapInArrow(stream, "path string, length bigint, sha256 string"))


def file_manifest(
    spark: SparkSession, root: str, ignored: Sequence[str] = IGNORED, glob: str | None = None
) -> DataFrame:
    """``(path, bytes, sha256)`` of every file under a root, relative to it.

    The reader spreads the files over tasks, which hash where they read; see ``_digests``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    marker = root.rstrip("/") + "/"
    relative = F.substring_index("path", marker, -1)
    parts = F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")))
    kept = ~F.arrays_overlap(parts, F.array(*[F.lit(i) for i in ignored]))
    return _digests(reader.load(root).where(kept)).select(
        relative.alias("path"), F.col("length").alias("bytes"), "sha256"
    )


def content_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file, or of the sorted part digests of a folder."""
    files = _digests(spark.read.format("binaryFile").load(path)).select(F.col("sha256").alias("d"))
    joined = F.array_join(F.sort_array(F.collect_list("d")), ":")
    digest = F.when(F.count(F.lit(1)) == 1, F.max("d")).otherwise(F.sha2(joined, 256))
    return files.agg(digest.alias("d")).first()["d"]


def verify_manifest(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded ``(path, sha256)`` that are missing or differ; no row means verified."""
    found = actual.select("path", F.col("sha256").alias("actual_sha256"))
    joined = recorded.select("path", F.lower("sha256").alias("sha256")).join(found, "path", "left")
    problem = F.when(F.col("actual_sha256").isNull(), "missing").when(
        F.col("actual_sha256") != F.col("sha256"), "mismatch"
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull())
