"""Secret scans: a worklist of decoded layers, rescanned until nothing new appears.

A text is layer zero. Every layer is searched for the three kinds of secrets and for
encoded parts: percent escapes, Unicode escapes, base64 runs, and compressed data inside
base64. Each decoded part becomes a layer of its own; layers that hold themselves are
skipped, so decoding ends even where a part decodes to itself. Equal layers are decoded once,
and every place they come from gets their findings. Findings carry the span of the original
text, in code points, that they came from.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import lzma
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# Base64 letters, joined over line ends; and where a part of them may begin or end.
_BREAK = r"[ \t]*(?:\r\n?|\n)[ \t]*"
_CHAIN = re.compile(
    rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}+|[A-Za-z0-9+/_-]{{4,}}+(?={_BREAK}[A-Za-z0-9+/_-]))(?:{_BREAK}[A-Za-z0-9+/_-]++)*+={{0,2}}"
)
_LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_SEPARATOR = re.compile(r"[+/_-]")
_STANDARD = str.maketrans("-_", "+/")
LEAST_RUN = 16  # letters of base64 that are decoded at least
_PERCENT_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE_UNIT = re.compile(r"(?:\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2}|U[0-9A-Fa-f]{8}))+")
_UNICODE_ONE = re.compile(r"\\(?:[uUx]([0-9A-Fa-f]{4}(?:[0-9A-Fa-f]{4})?|[0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]{1,6})\})")

Span = tuple[int, int, int]  # start, end, index of the kind


def base_spans(text: str) -> list[Span]:
    """Spans of the three kinds in one layer, leftmost and non-overlapping per kind."""
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A hex run of the least length lies inside a run of base64 letters.
    for run in _RUN.finditer(text):
        if run.end() - run.start() >= LEAST["hex"]:
            found += [
                (run.start() + m.start(), run.start() + m.end(), 2)
                for m in HEX.finditer(run[0])
                if m.end() - m.start() >= LEAST["hex"]
            ]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _percent(unit: str) -> str:
    return bytes.fromhex(unit.replace("%", "")).decode("utf-8", "replace")


def _unicode(unit: str) -> str:
    codes = "".join(
        chr(code) if (code := int(m[1] or m[2], 16)) < 0x110000 else "\ufffd" for m in _UNICODE_ONE.finditer(unit)
    )
    return codes.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _unescaped(text: str, unit: re.Pattern, decode: Callable[[str], str]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Decoded text and its pieces: (start, end) in the output, (start, end) in the text.

    A piece is either copied text or one escape sequence, which is mapped as a whole.
    """
    out, pieces, at, size = [], [], 0, 0
    for m in unit.finditer(text):
        for part, start, end in ((text[at : m.start()], at, m.start()), (decode(m[0]), m.start(), m.end())):
            if part:
                out.append(part)
                pieces.append((size, size + len(part), start, end))
                size += len(part)
        at = m.end()
    if at < len(text):
        out.append(text[at:])
        pieces.append((size, size + len(text) - at, at, len(text)))
    return "".join(out), pieces


def _bytes(letters: str) -> bytes:
    """Bytes of standard base64 letters; a last one without a partner is left out."""
    letters = letters[: len(letters) - (len(letters) % 4 == 1)]
    return base64.b64decode(letters + "=" * (-len(letters) % 4))


def _text_bytes(data: bytes) -> int:
    """Number of leading bytes that are UTF-8."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as error:
        return error.start
    return len(data)


def _unpacked(data: bytes) -> tuple[bytes, int] | None:
    """What a compressed stream at the start of ``data`` holds, and the bytes it takes."""
    if data[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
    elif len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0:
        stream = zlib.decompressobj()
    elif data[:3] == b"BZh":
        stream = bz2.BZ2Decompressor()
    elif data[:6] == b"\xfd7zXZ\x00":
        stream = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    else:
        return None
    try:
        out = stream.decompress(data[:4096])  # most of what only looks like a stream fails here
        if not (early := stream.eof):
            out += stream.decompress(data[4096:])
    except (zlib.error, OSError, EOFError, lzma.LZMAError):  # text may begin like a stream
        return None
    used = len(data) - len(stream.unused_data) - (max(0, len(data) - 4096) if early else 0)
    return (out, used) if stream.eof else None


def _part(letters: str, start: int, bounds: list[int]) -> tuple[str, int, int, int] | None:
    """Text of the base64 that starts at ``start``, unpacked, and the bound where it ends.

    Words behind base64 may decode to a few bytes too, mostly to control characters. So
    a length of the text without them follows, and the bound where that ends.
    """
    head = _bytes(letters[start : start + LEAST_RUN])
    packed = head.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00")) or head[0] == 0x78 and (0x7800 + head[1]) % 31 == 0
    if packed and (found := _unpacked(_bytes(letters[start:]))):
        data, used = found
        end = bounds[bisect.bisect_left(bounds, start - (-used * 4 // 3))]
        seen = {data}
        while (inner := _unpacked(data)) and inner[0] not in seen:
            data = inner[0]
            seen.add(data)
        return (data.decode("utf-8"), end, 0, end) if data and _text_bytes(data) == len(data) else None
    if _text_bytes(head) < len(head) - 3:
        return None
    size = 64
    while (valid := _text_bytes(data := _bytes(letters[start : start + size]))) >= len(data) - 3 and start + size < len(letters):
        size *= 4
    ends = []
    for i in range(bisect.bisect_right(bounds, start + (valid * 4 + 5) // 3) - 1, 0, -1):
        n = (bounds[i] - start) * 3 // 4
        if bounds[i] - start < LEAST_RUN:
            break
        if (bounds[i] - start) % 4 != 1 and n <= valid and (n == valid or data[n] & 0xC0 != 0x80):
            ends.append((n, bounds[i]))
            if not _CONTROL.search(data, max(0, bounds[i - 1] - start) * 3 // 4, n):
                break
    if not ends:
        return None
    (n, end), (tight, near) = ends[0], ends[-1]
    if _CONTROL.search(data, max(0, bounds[bisect.bisect_left(bounds, near) - 1] - start) * 3 // 4, tight):
        tight, near = n, end
    return data[:n].decode("utf-8"), end, len(data[:tight].decode("utf-8")), near


def _binary_parts(text: str):
    """Parts of base64 that hold text: (text, mapping to their spans).

    A part begins and ends where its letters do, at a line or at a separator, which may
    be a letter of base64 or not. The longest is taken; parts of it that decode to the
    end of its text are not.
    """
    for m in _CHAIN.finditer(text):
        body = m[0].rstrip("=")
        lines = [(g.start(), g[0]) for g in _LETTERS.finditer(body)]
        letters = "".join(line for _, line in lines)
        if len(letters) < LEAST_RUN:
            continue
        begun = [0]
        for _, line in lines:
            begun.append(begun[-1] + len(line))
        cuts = {g.start() + k for g in _SEPARATOR.finditer(letters) for k in (0, 1)}
        bounds = sorted(cuts.union(begun))
        letters = letters.translate(_STANDARD)

        def place(at: int) -> int:
            line = bisect.bisect_right(begun, at) - 1
            return m.start() + lines[line][0] + at - begun[line]

        reached = [0] * 4
        for start in bounds:
            if start + LEAST_RUN > len(letters):
                break
            if start >= reached[start % 4] and (found := _part(letters, start, bounds)):
                decoded, end, tight, near = found
                reached[start % 4] = end
                far, close = (m.end() if e == len(letters) else place(e - 1) + 1 for e in (end, near))
                yield decoded, lambda a, b, first=place(start), far=far, tight=tight, close=close: (first, close if b <= tight else far, True)


def _layers(text: str):
    """Encoded parts of one layer: (decoded text, mapping to spans of this layer).

    Escapes are decoded in the whole layer at once, as a secret may lie across blanks.
    """
    for mark, unit, decode in (("%", _PERCENT_UNIT, _percent), ("\\", _UNICODE_UNIT, _unicode)):
        if mark in text and unit.search(text):
            decoded, pieces = _unescaped(text, unit, decode)
            yield decoded, _piecewise(pieces)
    yield from _binary_parts(text)


def _piecewise(pieces: list[tuple[int, int, int, int]]):
    """Mapping through copied pieces character by character, through escapes as wholes."""
    starts = [p[0] for p in pieces]

    def place(a: int, b: int) -> tuple[int, int, bool]:
        first, last = bisect.bisect_right(starts, a) - 1, bisect.bisect_right(starts, b - 1) - 1
        low, high = pieces[first], pieces[last]
        copied = [p[1] - p[0] == p[3] - p[2] for p in (low, high)]
        start = low[2] + (a - low[0] if copied[0] else 0)
        end = high[2] + b - high[0] if copied[1] else high[3]
        changed = any(p[1] - p[0] != p[3] - p[2] for p in pieces[first : last + 1])
        return start, end, changed

    return place


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Spans found in the text itself, and all spans with those of decoded layers."""
    if not text:
        return [], []
    base = base_spans(text)
    every = set(base) | {(a, b, kind) for a, b, kind, changed in _findings(text) if changed}
    return base, sorted(every, key=lambda s: (s[0], s[2], s[1]))


def _findings(text: str) -> set[tuple[int, int, int, bool]]:
    """Spans of a text and of all layers below it, and whether any decoding touched them.

    Layers are done before those that hold them, without nesting calls. What a layer has
    is kept for its other places, unless a part of it was skipped as one of the layers
    above it.
    """

    class Frame:
        def __init__(self, layer: str, step):
            self.layer, self.step, self.parts, self.skipped = layer, step, _layers(layer), len(depth)
            self.found = {(*span, False) for span in base_spans(layer)}
            depth[layer] = len(depth)

        def take(self, found, step) -> None:
            for a, b, kind, touched in found:
                start, end, changed = step(a, b)
                if touched or changed:
                    self.found.add((start, end, kind, True))

    depth: dict[str, int] = {}
    done: dict[str, set] = {}
    stack = [Frame(text, None)]
    while True:
        top = stack[-1]
        for decoded, step in top.parts:
            if decoded in depth:
                top.skipped = min(top.skipped, depth[decoded])
            elif decoded in done:
                top.take(done[decoded], step)
            elif decoded:
                stack.append(Frame(decoded, step))
                break
        else:
            stack.pop()
            at = depth.pop(top.layer)
            if top.skipped >= at:
                done[top.layer] = top.found
            if not stack:
                return top.found
            if top.skipped < at:
                stack[-1].skipped = min(stack[-1].skipped, top.skipped)
            stack[-1].take(top.found, top.step)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``base`` and ``spans``.

    Both are arrays of (start, end, kind) in code points, end exclusive, by start and
    kind. A null or empty text gives empty arrays; repeated rows give repeated results.
    """

    def build():
        def step(ids, texts):
            results = [scan(t) for t in texts]
            named = [[[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in r[i]] for r in results] for i in (0, 1)]
            return ids, *named

        return step

    kind = dict(docs.dtypes)[id_column]
    span = "array<struct<start:bigint,end:bigint,kind:string>>"
    return map_columns(
        docs, [id_column, text_column], build, f"`{id_column}` {kind}, base {span}, spans {span}"
    )


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows with every secret span replaced by ``mark``; all columns are kept.

    Overlapping spans are replaced as one. Null and empty texts stay as they are.
    """

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: _masked(t, mark))

    return docs.withColumn(text_column, masked(F.col(text_column)))


def _masked(text: str | None, mark: str) -> str | None:
    if not text:
        return text
    out, at, until = [], 0, -1
    for start, end, _ in scan(text)[1]:
        if start >= until:
            if until >= 0:
                at = until
            out += [text[at:start], mark]
            until = end
        else:
            until = max(until, end)
    return text if until < 0 else "".join(out) + text[until:]
