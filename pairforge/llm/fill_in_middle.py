"""Fill-in-middle transformation by displacement of bytes.

Spark draws the cuts; a task gets whole texts as one buffer of UTF-8 bytes. Scanning that
buffer for code points turns cuts into byte places. A difference array holds, at every place
where a new part of a text begins, by how much the shift of the bytes changes; its running sum
gives every byte its output place, and one scatter moves the batch. The way back scans the
output for its marks, builds the same kind of array over the bytes of the text and gathers.

Both directions walk the buffer in windows, so that beside the texts and their outputs only
arrays of a window's size are held. A text and its output must fit into a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The marks and the shares of the forms in a hundred.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

_MARKS = np.frombuffer(f"{PREFIX}{SUFFIX}{MIDDLE}".encode(), np.uint8).reshape(3, 3)
_WINDOW = 1 << 20
_SLICE = 8 << 20
_BLOCK = 4096


def _draw(doc_id: str, group: int) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def with_cuts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null: empty), ``n``, ``form`` and the lengths of prefix and middle.

    A null id draws like the empty id. Texts without code points, texts that hold a mark and a
    tenth of the others stay plain; their lengths are null.
    """
    whole = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        *[_draw(doc_id, k).alias(f"h{k + 1}") for k in range(4)],
    ).withColumn("n", F.length("text").cast("long"))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("n") == 0) | held | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    return whole.select(
        "doc_id",
        "text",
        "n",
        form.alias("form"),
        F.when(~plain, F.least(first, second)).alias("prefix_chars"),
        F.when(~plain, F.greatest(first, second) - F.least(first, second)).alias("middle_chars"),
    )


def _starts(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def byte_places(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Byte place of code point ``chars`` of text ``rows``; its length leads to the text's end."""
    padded = -len(data) % _BLOCK
    full = np.concatenate([data, np.full(padded, 0x80, np.uint8)]) if padded else data
    total = np.zeros(len(full) // _BLOCK + 1, np.int64)
    for at in range(0, len(full), _WINDOW):  # whole blocks, as a window is a multiple of one
        part = _starts(full[at : at + _WINDOW]).reshape(-1, _BLOCK).sum(axis=1)
        total[at // _BLOCK + 1 : at // _BLOCK + 1 + len(part)] = part
    np.cumsum(total, out=total)

    def rank(place: int) -> int:  # code points that begin before the place
        block = place // _BLOCK
        return int(total[block]) + int(np.count_nonzero(_starts(data[block * _BLOCK : place])))

    out = offsets[rows] + chars
    for k in range(len(rows)):
        begin, end, wanted = int(offsets[rows[k]]), int(offsets[rows[k] + 1]), int(chars[k])
        goal = rank(begin) + wanted
        if goal >= rank(end):
            out[k] = end
            continue
        block = int(np.searchsorted(total, goal, "right")) - 1
        inside = _starts(full[block * _BLOCK : (block + 1) * _BLOCK])
        out[k] = block * _BLOCK + int(np.flatnonzero(inside)[goal - total[block]])
    return out


def _shifts(places: np.ndarray, changes: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Windows of the running sum of a difference array with ``changes`` at sorted ``places``."""
    before = 0
    for at in range(0, size, _WINDOW):
        end = min(at + _WINDOW, size)
        low, high = np.searchsorted(places, (at, end))
        steps = np.zeros(end - at, np.int64)
        np.add.at(steps, places[low:high] - at, changes[low:high])
        steps[0] += before
        shift = np.cumsum(steps, out=steps)
        before = int(shift[-1])
        yield at, end, shift


def scatter(data: np.ndarray, offsets: np.ndarray, forms: np.ndarray, first: np.ndarray, second: np.ndarray):
    """Outputs of the texts in ``data`` as (bytes, offsets).

    ``forms`` holds 0 for plain, 1 for psm, 2 for spm; ``first`` and ``second`` are the byte
    places of both cuts (ignored for plain texts).
    """
    begin, end = offsets[:-1], offsets[1:]
    marked = forms > 0
    to = np.zeros(len(offsets), np.int64)
    np.cumsum(end - begin + 9 * marked, out=to[1:])
    first, second = np.where(marked, first, begin), np.where(marked, second, end)
    prefix, middle, suffix = first - begin, second - first, end - second
    psm, spm = forms == 1, forms == 2
    # Where the parts of a text land, and where its three marks do.
    at_prefix = to[:-1] + 3 * psm + (6 + suffix) * spm
    at_suffix = to[:-1] + (6 + prefix) * psm + 3 * spm
    at_middle = to[:-1] + np.where(marked, 9 + prefix + suffix, prefix)
    shifts = np.stack([at_prefix - begin, at_middle - first, at_suffix - second], axis=1).ravel()
    places = np.stack([begin, first, second], axis=1).ravel()
    inside = places < np.repeat(end, 3)  # parts without bytes at a text's end move nothing
    places, shifts = places[inside], shifts[inside]
    out = np.empty(int(to[-1]), np.uint8)
    for at, stop, shift in _shifts(places, np.diff(shifts, prepend=0), len(data)):
        shift += np.arange(at, stop)
        out[shift] = data[at:stop]
    for kind, part in enumerate((at_prefix, at_suffix, at_middle)):
        for letter in range(3):
            out[part[marked] - 3 + letter] = _MARKS[kind, letter]
    return out, to


def gather(data: np.ndarray, offsets: np.ndarray, forms: np.ndarray):
    """The texts of outputs as (bytes, offsets), from the outputs and their forms alone."""
    begin, end = offsets[:-1], offsets[1:]
    marked = forms > 0
    found = []
    for at in range(0, len(data), _WINDOW):
        part = data[at : at + _WINDOW + 2]
        here = np.flatnonzero((part[:-2] == _MARKS[0, 0]) & (part[2:] == _MARKS[0, 2])) if len(part) > 2 else np.zeros(0, np.int64)
        found.append(at + here[np.isin(part[here + 1], _MARKS[:, 1])])
    marks = np.concatenate(found) if found else np.zeros(0, np.int64)
    row = np.searchsorted(end, marks, "right")
    mine = marked[row] & (marks + 3 <= end[row])
    if (np.bincount(row[mine], minlength=len(end)) != 3 * marked).any():
        raise ValueError("an output that is not plain holds other than three marks")
    marks = marks[mine].reshape(-1, 3)
    second, third = begin.copy(), begin.copy()  # places of the later two marks
    second[marked], third[marked] = marks[:, 1], marks[:, 2]
    psm, spm = forms == 1, forms == 2
    one, two, three = begin + 3, second + 3, third + 3
    prefix = np.where(psm, second - one, third - two) * marked
    suffix = np.where(psm, third - two, second - one) * marked
    middle = np.where(marked, end - three, end - begin)
    to = np.zeros(len(offsets), np.int64)
    np.cumsum(prefix + middle + suffix, out=to[1:])
    # The parts in the order of the text: where each begins there and in the output.
    source = np.stack([np.where(spm, two, one), np.where(marked, three, begin), np.where(spm, one, two)], axis=1).ravel()
    places = np.stack([to[:-1], to[:-1] + prefix, to[:-1] + prefix + middle], axis=1).ravel()
    inside = np.stack([prefix, middle, suffix], axis=1).ravel() > 0
    places, shifts = places[inside], (source - places)[inside]
    out = np.empty(int(to[-1]), np.uint8)
    for at, stop, shift in _shifts(places, np.diff(shifts, prepend=0), len(out)):
        shift += np.arange(at, stop)
        out[at:stop] = data[shift]
    return out, to


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in slices of about ``_SLICE`` bytes of one column; a longer row is alone."""
    size = np.asarray(pc.binary_length(batch.column(column))).cumsum()
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + _SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def _moved(df: DataFrame, keep: str, text: str, name: str, step: Callable) -> DataFrame:
    """Columns ``keep`` (DDL) of ``df`` and the binary column ``name`` that ``step`` makes.

    ``step(batch) -> (bytes, offsets)`` gets slices of rows bounded by the bytes of ``text``.
    """
    schema = StructType.fromDDL(f"{keep}, {name} binary")
    fields = to_arrow_schema(schema)
    at = [df.columns.index(n) for n in schema.names[:-1]]
    size = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, size):
                data, offsets = step(part)
                wide = offsets[-1] > np.iinfo(np.int32).max
                buffers = [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(data)]
                made = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(offsets) - 1, buffers)
                arrays = [*[part.column(i) for i in at], made]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, fields)], schema=fields)

    return df.mapInArrow(run, f"{keep}, {name} binary")


def _code() -> Column:
    return F.when(F.col("form") == "psm", 1).when(F.col("form") == "spm", 2).otherwise(0).cast("int")


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text in its form: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    Nothing but the id and the text is read, so other columns of ``docs`` never matter. Null
    and empty texts give an empty plain output, repeated rows the same output each, an empty
    table no rows. Texts are moved whole, whatever their length.
    """
    cut = with_cuts(docs, doc_id, text)
    cut = cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _code().alias("code"), F.col("text").cast("binary").alias("text"))

    def step(part: pa.RecordBatch):
        data, offsets = _buffer(part.column("text"))
        forms = part.column("code").to_numpy()
        prefix, middle = (part.column(n).fill_null(0).to_numpy() for n in ("prefix_chars", "middle_chars"))
        rows = np.flatnonzero(forms)
        first, second = offsets[:-1].copy(), offsets[1:].copy()
        first[rows] = byte_places(data, offsets, rows, prefix[rows])
        second[rows] = byte_places(data, offsets, rows, (prefix + middle)[rows])
        return scatter(data, offsets, forms, first, second)

    kind = cut.schema["doc_id"].dataType.simpleString()
    keep = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long"
    return _moved(cut, keep, "text", "output", step).withColumn("output", F.col("output").cast("string"))


def restore(transformed: DataFrame) -> DataFrame:
    """The columns of ``transform`` and ``restored``, the text rebuilt from output and form.

    An empty table gives no rows; an output that lacks the marks of its form is an error.
    """
    given = transformed.withColumn("code", _code()).withColumn("output", F.col("output").cast("binary"))

    def step(part: pa.RecordBatch):
        return gather(*_buffer(part.column("output")), part.column("code").to_numpy())

    kind = transformed.schema["doc_id"].dataType.simpleString()
    keep = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    rebuilt = _moved(given, keep, "output", "restored", step)
    return rebuilt.select(*[F.col(n).cast("string").alias(n) if n in ("output", "restored") else n for n in rebuilt.columns])
