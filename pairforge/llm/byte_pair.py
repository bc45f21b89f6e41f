"""Byte-pair encoding and decoding with a contiguous rank array per word.

A word is a list of part ids with the rank of every adjacent pair beside it. The lowest
rank is found by scanning, its boundary deleted, and the two ranks next to it refreshed.
Words already met keep their ids in a bounded table per task.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from pairforge.llm.common import map_columns

# White space by Unicode's property, and the pattern that splits words.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

NONE = 1 << 60
MIX = 0x9E3779B97F4A7C15  # an odd multiplier that spreads keys
WIDTHS = (8, 16, 32, 64)  # words up to these sizes in bytes are merged together
SHORT = 256  # longer words use a heap, since scanning them again and again is quadratic
KEPT = 500_000  # words kept


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class PairTable:
    """Ranks of pairs of ids, looked up for whole arrays in an open hash table."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], bits: int = 19):
        self.shift, self.mask = 64 - bits, (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int64)
        self.merged = np.zeros(len(pairs), dtype=np.int64)
        self.blank = (1 << 31) - 1  # stands where there is no part, and is in no pair
        for (left, right), (rank, both) in pairs.items():
            slot = ((left << 32 | right) * MIX & (1 << 64) - 1) >> self.shift
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot], self.merged[rank] = left << 32 | right, rank, both

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = (key.astype(np.uint64) * np.uint64(MIX) >> np.uint64(self.shift)).astype(np.int64)
        held = self.keys[slot]
        found = np.where(held == key, self.values[slot], NONE)
        open_ = (held != key) & (held >= 0)
        while open_.any():
            slot = (slot + open_) & self.mask
            held = self.keys[slot]
            found = np.where(open_ & (held == key), self.values[slot], found)
            open_ &= (held != key) & (held >= 0)
        return found


class Vocabulary:
    """Ids, pair ranks and bytes of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], byte_letters()
        back = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        self.of_byte = [ids[letters[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[left], ids[right]] = (rank, ids[left + right])
        bytes_of = {i: bytes(back[c] for c in token) for token, i in ids.items() if all(c in back for c in token)}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        longest = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.table = PairTable(self.pairs)
        self.first = np.array(self.of_byte)
        self.fixed = {t: array("I", [i]).tobytes() for t, i in self.special.items()}
        self.words = dict(self.fixed)

    def word(self, data: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.of_byte[b] for b in data]
        return self._scanned(parts) if len(parts) <= SHORT else self._queued(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        none = (NONE, 0)
        ranks = [self.pairs.get(pair, none)[0] for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] = self.pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = self.pairs.get((parts[i], parts[i + 1]), none)[0]
            if i:
                ranks[i - 1] = self.pairs.get((parts[i - 1], parts[i]), none)[0]
        return parts

    def _queued(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, with a heap in place of the scan."""
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue = [(self.pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.pairs]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= size or parts[j] != right:
                continue
            parts[i], parts[j] = self.pairs[left, right][1], -1
            after[i] = after[j]
            if after[j] < size:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < size and (pair := (parts[a], parts[b])) in self.pairs:
                    heapq.heappush(queue, (self.pairs[pair][0], a, *pair))
        return [p for p in parts if p >= 0]

    def learn(self, words: set[str]) -> None:
        """Enter words into the table of known words, many at a time."""
        new = list(words)
        data = [w.encode() for w in new]
        for low, high in zip((0, *WIDTHS), WIDTHS):
            chosen = [i for i, d in enumerate(data) if low < len(d) <= high]
            for at in range(0, len(chosen), 2048):
                part = chosen[at : at + 2048]
                for i, ids in zip(part, self._together([data[i] for i in part], high)):
                    self.words[new[i]] = ids
        for i, d in enumerate(data):
            if len(d) > WIDTHS[-1]:
                self.words[new[i]] = array("I", self.word(d)).tobytes()

    def _together(self, data: list[bytes], width: int) -> list[bytes]:
        """Ids of many short words: the rank arrays are the rows of one matrix.

        Every turn finds the least rank of each row, deletes its boundary by moving the
        later parts one place left, and refreshes the ranks on both sides.
        """
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        places = np.arange(width)
        parts = np.full((len(data), width), self.table.blank, dtype=np.int64)
        parts[places < sizes[:, None]] = self.first[np.frombuffer(b"".join(data), dtype=np.uint8)]
        ranks = self.table.ranks(parts[:, :-1], parts[:, 1:])
        done: list[bytes] = [b""] * len(data)
        rows = np.arange(len(data))
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            going = least < NONE
            if not going.all():
                for i in np.flatnonzero(~going):
                    done[rows[i]] = parts[i, : sizes[i]].astype("<u4").tobytes()
                rows, parts, ranks, sizes, at, least = (x[going] for x in (rows, parts, ranks, sizes, at, least))
            if not len(rows):
                return done
            every = np.arange(len(rows))
            moved = np.minimum(places + (places > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, moved, axis=1)
            ranks = np.take_along_axis(ranks, moved[:, :-1].clip(max=width - 2), axis=1)
            sizes = sizes - 1
            parts[every, at] = self.table.merged[least]
            parts[every, sizes] = self.table.blank
            ranks[every, np.minimum(sizes - 1, width - 2)] = NONE
            after = np.minimum(at + 1, width - 1)
            ranks[every, np.minimum(at, width - 2)] = self.table.ranks(parts[every, at], parts[every, after])
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.table.ranks(parts[inner, at[inner] - 1], parts[inner, at[inner]])

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers.

        A string of a special token in a text becomes that token, as in the library.
        """
        split = []
        for text in texts:
            pieces = [text or ""] if self.split is None else self.split.split(text or "")
            split.append(list(chain.from_iterable([p] if p in self.special else _WORD.findall(p) for p in pieces)))
        if len(self.words) > KEPT:
            self.words = dict(self.fixed)
        known = self.words
        self.learn({w for words in split for w in words if w not in known})
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids and the text decoded from them, one row per document.

    ``ids`` holds little-endian unsigned 32-bit integers. A null text counts as empty and
    gives no ids; strings of special tokens in a text become those tokens.
    """

    def build():
        coder = vocabulary(path)

        def step(ids, texts):
            encoded = coder.encode_many(texts)
            return ids, encoded, [coder.decode(e) for e in encoded]

        return step

    kind = dict(docs.dtypes)[id_column]
    return map_columns(
        docs, [id_column, text_column], build, f"`{id_column}` {kind}, ids binary, decoded string", rows=128
    )
