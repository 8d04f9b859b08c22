"""Token ids in wavelet-matrix shards (operator 4).

Format of a shard, all numbers little-endian: ``WVM1``, uint8 bit count, uint64
tokens, uint64 documents, then sections, each with its uint32 length and
compressed by zstd: document ids (int64), a null mark per document (uint8),
tokens per document (uint64), and one bit-plane per bit, the highest first.
Plane *l* holds bit *l* of every token in the order in which the tokens stand
after a stable partition by each plane above it (zeros first).  Rank
directories are counted when a shard is opened; ``access``, ``count`` and
``locate`` then need no other file.

Defined cases: a null or empty text holds the end id alone; a null document id
sorts first; rows with equal ids stand next to each other ordered by a hash of their text; an
empty table writes no shard and reads back as no rows; other columns are not
looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import file_bytes, library_ids, scratch, slices

MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 18   # a shard closes with the document that reaches this
SHARD_SCHEMA = "part int, shard int, part_start long, n_docs long, n_tokens long, payload binary"


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int) -> bytes:
    """The bytes of one shard."""
    pack = zstandard.ZstdCompressor(level=1).compress
    sections = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(lengths, "<u8").tobytes()]
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for b in range(bits - 1, -1, -1):
        bit = (cur & cur.dtype.type(1 << b)) != 0
        sections.append(np.packbits(bit).tobytes())
        cur = cur.take(np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)]))
    out = [MAGIC, struct.pack("<BQQ", bits, len(ids), len(doc_ids))]
    for s in sections:
        s = pack(s)
        out += [struct.pack("<I", len(s)), s]
    return b"".join(out)


class Shard:
    """One opened shard."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.bits, self.n, docs = struct.unpack_from("<BQQ", data, 4)
        at, parts, unpack = 21, [], zstandard.ZstdDecompressor().decompress
        for _ in range(3 + self.bits):
            (size,) = struct.unpack_from("<I", data, at)
            parts.append(unpack(data[at + 4:at + 4 + size]) if size else b"")
            at += 4 + size
        null = np.frombuffer(parts[1], "u1")
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(parts[0], "<i8"), null)]
        self.lengths = np.frombuffer(parts[2], "<u8").astype(np.int64)
        self.planes = [np.frombuffer(p, "u1") for p in parts[3:]]
        self.ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)]) for p in self.planes]
        self.zeros = [self.n - int(o[-1]) for o in self.ones]

    def _rank1(self, level: int, i: int) -> int:
        byte, rest = divmod(i, 8)
        n = int(self.ones[level][byte])
        return n + (int(self.planes[level][byte]) >> (8 - rest)).bit_count() if rest else n

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for lv in range(self.bits):
            r = self._rank1(lv, i)
            bit = self._rank1(lv, i + 1) - r
            i = self.zeros[lv] + r if bit else i - r
            value = value << 1 | bit
        return value

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        lo, hi = 0, stop
        for lv in range(self.bits):
            a, b = self._rank1(lv, lo), self._rank1(lv, hi)
            lo, hi = (self.zeros[lv] + a, self.zeros[lv] + b) if token >> (self.bits - 1 - lv) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, stop: int | None = None) -> int:
        """How often ``token`` stands before place ``stop`` (the end if None)."""
        if token >> self.bits or token < 0:
            return 0
        lo, hi = self._range(token, self.n if stop is None else stop)
        return hi - lo

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for lv in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - lv) & 1
            i = self._select(lv, bit, i - self.zeros[lv] * bit)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the partitions from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for lv in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[lv], count=self.n).view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[:self.zeros[lv]]
            up[np.flatnonzero(bit)] = out[self.zeros[lv]:] | out.dtype.type(1 << (self.bits - 1 - lv))
            out = up
        return out.astype("<u4")


def write(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 0, vocab: int = 50257) -> None:
    """Write every text's ids as shards under ``path`` in ascending id order.

    One range shuffle of the texts puts them in order; each task then streams
    its sorted rows and closes a shard every ``SHARD_TOKENS`` tokens.  Spark
    writes the shard files (one payload a row, so any store that Spark knows
    will do), which makes a repeated task harmless.
    """
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))
    bits = max(1, (vocab - 1).bit_length())
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    width = max(1, src.rdd.getNumPartitions())

    def run(batches):
        encode = library_ids(tokenizer_path, data.value)
        part, shard, start, n, held, names, sizes = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def close():
            row = [part, shard, start, len(names), n, build(np.concatenate(held), names, sizes, bits)]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, KINDS)], NAMES)

        for batch in batches:
            for rows in slices(batch, 1):
                ids, lens = encode.batch(rows.column(1))
                stops = np.cumsum(lens)
                ids = np.insert(ids, stops, end_id)                     # one after each document
                stops = stops + np.arange(1, len(lens) + 1)
                a = 0
                for d, b in zip(rows.column(0).to_pylist(), stops.tolist()):
                    held.append(ids[a:b])
                    names.append(d)
                    sizes.append(b - a)
                    n, a = n + b - a, b
                    if n >= SHARD_TOKENS:
                        yield close()
                        shard, start, n, held, names, sizes = shard + 1, start + n, 0, [], [], []
        if names:
            yield close()
        encode.trim()

    # a hot id is dealt out by the hash of its texts
    (src.withColumn("deal", F.xxhash64("text")).repartitionByRange(width, "doc_id", "deal")
     .sortWithinPartitions("doc_id", "deal", "text").select("doc_id", "text").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "none").parquet(path))


KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
NAMES = ["part", "shard", "part_start", "n_docs", "n_tokens", "payload"]


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards.

    A shard knows its place in its part; the parts' starts are a running sum
    over one row a part, small enough to send along.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    total = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard, at = Shard(row["payload"]), row["base"] + row["part_start"]
                raw, stops = shard.tokens().tobytes(), np.cumsum(shard.lengths)
                starts = stops - shard.lengths
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.record_batch([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + at, pa.int64()),
                                       pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())],
                                      ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (shards.join(F.broadcast(base), "part").select("part_start", "base", "payload")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the shards under the shared folder and read them back."""
    path = scratch(docs.sparkSession, "shards")
    write(docs, tokenizer_path, path)
    return read(docs.sparkSession, path)
