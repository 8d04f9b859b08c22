"""Substring search for thousands of needles in one pass over the texts (T4).

The bytes of a batch of texts lie in one buffer.  At every place the next bytes
(eight, or as many as the needles of a shorter class have) make one number,
found by shifts over the whole buffer, and numbers that start no needle fall
away by a table of bits and a sorted search.  At the few places left, the hash
of each distinct needle length comes from prefix sums of a rolling hash, so the
cost hardly grows with the number of needles.  Every hit is verified byte by
byte.  UTF-8 makes byte matches the same as character matches.

Defined cases: NULL texts hold nothing; empty needles and NULLs are not looked
for; repeated needles count once; matches overlap freely and never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20        # of all needles, as every task holds them
PART = 1 << 22              # bytes of text searched at a time
TABLE_BITS = 16
BASE = np.uint64(0x9E3779B97F4A7C15)        # odd, so that its powers have inverses


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _grams(buf: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` bytes at every place as one number."""
    n = len(buf) - m + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(m):
        out = (out << np.uint64(8)) | buf[j:j + len(out)]
    return out


def _bit(grams: np.ndarray) -> np.ndarray:
    return (grams * BASE) >> np.uint64(64 - TABLE_BITS)


class _Class:
    """Needles of one gram width: all shorter ones of that length, or all of eight bytes and more."""

    def __init__(self, width: int, needles: list[tuple[bytes, int]]):
        self.width = width
        grams = [int.from_bytes(b[:width], "big") for b, _ in needles]
        self.grams = np.unique(np.array(grams, np.uint64))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[_bit(self.grams)] = True
        self.by_length: dict[int, dict[int, list[tuple[bytes, int]]]] = {}
        for b, k in needles:
            self.by_length.setdefault(len(b), {}).setdefault(rolling(b), []).append((b, k))
        self.hashes = {n: np.sort(np.array(list(h), np.uint64)) for n, h in self.by_length.items()}

    def starts(self, buf: np.ndarray) -> np.ndarray:
        grams = _grams(buf, self.width)
        at = np.flatnonzero(self.table[_bit(grams)])
        return at[_among(grams[at], self.grams)]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def rolling(b: bytes) -> int:
    x = np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1)
    return int((x * _powers(len(x), int(BASE))).sum(dtype=np.uint64))


class Searcher:
    """Finds which of the needles each text of a buffer holds."""

    def __init__(self, needles: list[bytes]):
        classes: dict[int, list[tuple[bytes, int]]] = {}
        for k, b in enumerate(needles):
            classes.setdefault(min(len(b), 8), []).append((b, k))
        self.classes = [_Class(w, each) for w, each in sorted(classes.items())]
        self.inverse = pow(int(BASE), -1, 1 << 64)

    def hits(self, buf: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(text, needle), each once; ``ends`` are the texts' ends in the buffer."""
        out: set[tuple[int, int]] = set()
        sums = inverse = None
        whole = buf.tobytes()
        for c in self.classes:
            at = c.starts(buf)
            text = np.searchsorted(ends, at, side="right")
            if len(at) and sums is None:
                sums = np.zeros(len(buf) + 1, np.uint64)
                np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(len(buf), int(BASE)), out=sums[1:])
                inverse = _powers(len(buf), self.inverse)
            for n, known in c.hashes.items():
                fits = at + n <= ends[np.minimum(text, len(ends) - 1)] if len(at) else np.zeros(0, bool)
                a, t = at[fits], text[fits]
                if not len(a):
                    continue
                h = (sums[a + n] - sums[a]) * inverse[a]
                ok = _among(h, known)
                a, t, h = a[ok], t[ok], h[ok]
                order = np.lexsort((a, h, t))
                a, t, h = a[order], t[order], h[order]
                first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])][:len(a)])
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a)]):
                    for b, k in c.by_length[n][int(h[i])]:      # places after the first only where hashes collide
                        if any(whole[p:p + n] == b for p in map(int, a[i:j])):
                            out.add((int(t[i]), k))
        return sorted(out)


def _parts(texts: pa.Array) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of runs of texts of about ``PART`` bytes; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + PART, side="right")) - 1)
        yield lo, every[offs[lo]:offs[hi]], offs[lo + 1:hi + 1] - offs[lo]
        lo = hi


def stated(words: DataFrame, column: str, most: int = 2_000_000) -> list[str]:
    """The distinct words of a needle table on the driver; raises beyond ``most`` of them."""
    rows = words.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} needles")
    return sorted(r[0] for r in rows)


def needle_hits(df: DataFrame, key: str, text: str, needles: Iterable[str]) -> DataFrame:
    """(key, needles): rows whose text holds a needle, with those it holds as a sorted array.

    Raises if the needles are larger than ``MAX_BYTES``."""
    words = sorted({w for w in needles if w})
    coded = [w.encode("utf-8") for w in words]
    if sum(map(len, coded)) > MAX_BYTES:
        raise ValueError(f"more than {MAX_BYTES} bytes of needles")
    sent = df.sparkSession.sparkContext.broadcast(coded)
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        search = Searcher(sent.value)
        for batch in batches:
            for first, buf, ends in _parts(batch.column(1)):
                found: dict[int, list[str]] = {}
                for row, k in search.hits(buf, ends):
                    found.setdefault(first + row, []).append(sent.value[k].decode("utf-8"))
                if found:
                    yield pa.record_batch([batch.column(0).take(pa.array(list(found))),
                                           pa.array(list(found.values()), pa.list_(pa.string()))], ["key", "needles"])

    return src.mapInArrow(run, f"key {kind}, needles array<string>").withColumnRenamed("key", key)
