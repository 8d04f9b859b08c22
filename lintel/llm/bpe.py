"""Byte-level BPE encoding and decoding by a monoid tree reduction (operator 1).

A piece (one match of the split pattern) is encoded by halving it down to
short leaves, encoding the leaves by rank merges, and joining neighbours on
the way up.  A join re-encodes a window around the boundary and grows it
until the window's outermost tokens come out as they were: a token sequence
is the encoding of its bytes exactly when each adjacent pair is the encoding
of its own bytes, so tokens outside such a window are proven stable.  The join
is associative, which is what lets halves be encoded apart.  Decoding
concatenates byte strings pairwise up the same kind of tree.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows
are independent, so repeated rows give repeated results and extra columns of
any name are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import PieceIds, file_bytes, piece_of, slices

LEAF = 24        # bytes that are merged directly
LONG = 96        # bytes from which merges go by a heap
ROWS = 256       # rows handled at a time inside a task
MEMO = 24 << 20  # bytes of a worker's memo of pieces
SLICE = 2 << 20  # bytes of text coded at a time


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 token, blank, rank)."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class TreeBPE:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}

    def _merge(self, piece: bytes) -> list[bytes]:
        """Rank merges of a short byte string: lowest rank first, leftmost on ties."""
        if len(piece) > LONG:
            return self._merge_long(piece)
        ranks = self.ranks
        parts = [piece[i:i + 1] for i in range(len(piece))]
        get, none = ranks.get, len(ranks) + 256
        near = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while near:
            low = min(near)
            if low == none:
                break
            i = near.index(low)
            parts[i] += parts.pop(i + 1)
            near.pop(i)
            if i < len(near):
                near[i] = get(parts[i] + parts[i + 1], none)
            if i:
                near[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same merges by a heap of (rank, start) over linked neighbours, n log n in the length.

        An entry whose pair has changed since is passed over: the pair that
        starts there now has another rank or is gone.
        """
        get, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))         # of the part that starts here; 0: no part starts here
        back = list(range(-1, n - 1))       # where the part before starts
        rank = [get(piece[i:i + 2], -1) for i in range(n - 1)] + [-1]
        heap = [(r << 40) | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        place = (1 << 40) - 1
        while heap:
            top = heappop(heap)
            i = top & place
            if rank[i] != top >> 40 or not end[i]:
                continue
            j = end[i]
            last = end[i] = end[j]
            end[j], rank[j] = 0, -1
            if last < n:
                back[last] = i
                r = rank[i] = get(piece[i:end[last]], -1)
                if r >= 0:
                    heappush(heap, (r << 40) | i)
            else:
                rank[i] = -1
            k = back[i]
            if k >= 0:
                r = rank[k] = get(piece[k:last], -1)
                if r >= 0:
                    heappush(heap, (r << 40) | k)
        out, i = [], 0
        while i < n:
            out.append(piece[i:end[i]])
            i = end[i]
        return out

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Encoding of the concatenation of two encoded byte strings.

        Only the side whose outermost token has changed grows, fourfold.
        """
        if not left or not right:
            return left or right
        m = n = 1
        while True:
            a, b = left[-m:], right[:n]
            window = self._merge(b"".join(a) + b"".join(b))
            steady = len(a) == len(left) or window[0] == a[0], len(b) == len(right) or window[-1] == b[-1]
            if all(steady):
                return left[:len(left) - len(a)] + window + right[len(b):]
            m, n = m if steady[0] else 4 * m, n if steady[1] else 4 * n

    def _tree(self, piece: bytes, seen: dict[int, tuple[bytes, list[bytes]]]) -> list[bytes]:
        """Tokens by halves whose left length is a power of two.

        Runs of one byte, and of any period that divides such a length, then
        part between tokens.  ``seen`` keeps the last block of each length, so
        repeated blocks are encoded once.
        """
        if len(piece) <= LEAF:
            return self._merge(piece)
        last = seen.get(len(piece))
        if last is None or last[0] != piece:
            half = 1 << ((len(piece) - 1).bit_length() - 1)
            last = piece, self.join(self._tree(piece[:half], seen), self._tree(piece[half:], seen))
            seen[len(piece)] = last
        return last[1]

    def tokens(self, piece: bytes) -> list[bytes]:
        if piece in self.ranks:
            return [piece]
        return self._tree(piece, {}) if piece else []

    def encode(self, piece: bytes) -> list[int]:
        return [self.ranks[t] for t in self.tokens(piece)]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.token.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_MADE: dict[tuple[int, str], tuple[TreeBPE, PieceIds]] = {}


def _coder(data: bytes, pattern: str) -> tuple[TreeBPE, PieceIds]:
    """The worker's coder for one rank file and pattern, kept from task to task."""
    key = (hash(data), pattern)
    if key not in _MADE:
        bpe, find = TreeBPE(read_ranks(data)), regex.compile(pattern).findall
        pack, run = bpe.ranks, bpe.tokens

        def encode(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
            each = [[pack[t] for m in find(p) for t in run(m.encode("utf-8"))] for p in map(piece_of, keys)]
            size = np.fromiter(map(len, each), np.int64, len(each))
            return np.fromiter(chain.from_iterable(each), "<u4", int(size.sum())), size
        _MADE[key] = bpe, PieceIds(encode, MEMO, MEMO // 2)
    return _MADE[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    ``pattern`` must not match across a blank or line feed that stands
    between two characters that are no white space (as the usual byte-level
    patterns); texts are cut there and the cuts' ids kept in a bounded memo.
    """
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(ranks_path))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        ids = _coder(data.value, pattern)[1]
        for batch in batches:
            for part in slices(batch, 1, size=SLICE):
                flat, n = ids.batch(part.column(1))
                offs = np.concatenate([[0], 4 * np.cumsum(n)])
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [
                    None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), out.cast(pa.binary())],
                                      ["id", "n_tokens", "ids"])
        ids.trim()

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str = "") -> DataFrame:
    """Adds ``bytes``, the decoded bytes of each row's ``ids``, to (id, n_tokens, ids)."""
    data = encoded.sparkSession.sparkContext.broadcast(file_bytes(ranks_path))

    def run(batches):
        bpe = _coder(data.value, pattern)[0]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                out = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "bytes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, bytes binary")


def sha256(col: str) -> Column:
    return F.sha2(F.col(col), 256)
