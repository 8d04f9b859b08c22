"""Suffix-array dedup of repeated byte strings (operator 5).

A byte goes when a string of ``length`` bytes that covers it also starts
earlier: in a document with a smaller id, or earlier in the same document.

Every such string holds ``length - GRAM + 1`` grams; the one with the smallest
hash is its anchor, so equal strings have equal anchors.  An anchor that stands
once in the corpus rules its strings out.  The rest of the text, as segments
(the strings that share an anchor's place: at most ``2 * length - GRAM`` bytes),
is dealt out by the anchor's hash.  A task sorts its segments' suffixes in two
stages: only suffixes smaller than their successors are sorted directly, the
others are induced by scanning the buckets of first bytes in order; then
adjacent common prefixes give the groups of equal strings, in which all but
the first go.

First only hashes travel: a task tells of an anchor, its segment's hash and its
first place, once however often it holds them.  All but the first of equal
segments go at once, as they start later, so a string that a third of all
documents share is one row a task; only the segments of anchors that several
different segments share are sent and sorted, in groups of whole anchors of
about ``SORT`` bytes.

Defined cases: null or empty texts, and those shorter than ``length``, lose
nothing; a null id is the smallest; rows that repeat an id are ordered by where
they stand in the input; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import freeing, release, shuffle_width, stored
from lintel.llm.shingles import range_sums, sum_hashes

LENGTH, GRAM = 100, 32
SORT = 1 << 19       # bytes of segments sorted together
TEXT = 1 << 20        # starts of a long text that are looked at together
BLOCK = 1 << 17       # bytes of short texts that are looked at together
ROWS = 256


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Runs of string starts that share an anchor's place: (text's number, hash, segment hash, first start, starts).

    A segment is the bytes of a run's strings.  Short texts are taken together,
    long ones in blocks; a run cut by a block's end is two.
    """
    out, held, size = [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, TEXT):
            held.append((i, a, text[a:a + TEXT + length - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                out.append(_anchors(held, length, gram))
                held, size = [], 0
    if held:
        out.append(_anchors(held, length, gram))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in ("i8", "u8", "u8", "i8", "i8")]


def _anchors(held: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
    size = np.array([len(x) for _, _, x in held])
    begin, row, base = np.cumsum(size) - size, np.array([x[0] for x in held]), np.array([x[1] for x in held])
    total, w = range_sums(b), length - gram + 1
    h = sum_hashes(total, np.arange(len(b) - gram + 1), np.arange(gram, len(b) + 1))
    # the least hash of each window, the leftmost of those equal but for the bits that hold a place
    place = np.uint64((1 << (2 * TEXT + BLOCK + length).bit_length()) - 1)
    low, width = (h & ~place) | np.arange(len(h), dtype=np.uint64), 1
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    # of strings that lie in one text
    count = size - length + 1
    starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    pos = (np.minimum(low[starts], low[starts + (w - width)]) & place).astype(np.int64)
    first = np.flatnonzero(np.diff(pos, prepend=-1))
    at, n = starts[first], np.diff(first, append=len(starts))
    of = np.searchsorted(begin, at, side="right") - 1
    return row[of], h[pos[first]], sum_hashes(total, at, at + n + length - 1), at - begin[of] + base[of], n


def words(t: np.ndarray, beyond: int) -> np.ndarray:
    """The seven symbols from each place on as one number, for ``beyond`` places more than ``t`` has."""
    one = np.zeros(len(t) + beyond + 7, np.uint64)
    one[:len(t)] = t
    two = one[:-1] << np.uint64(9) | one[1:]
    four = two[:-2] << np.uint64(18) | two[2:]
    return four[:-4] << np.uint64(27) | two[4:-2] << np.uint64(9) | one[6:-1]


def suffix_array(t: np.ndarray, depth: int, wanted: np.ndarray | None = None, key: np.ndarray | None = None
                 ) -> np.ndarray:
    """Order of the ``wanted`` suffixes (all, if none are named) by their first ``depth`` symbols, in two stages.

    ``t`` holds small integers; 0 ends a segment and never counts as equal.
    ``key`` holds its :func:`words`, where they are known.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    t = t.astype(np.int16)
    # type B: smaller than its successor (a run takes the type of what follows it)
    cmp = np.sign(np.append(t[1:], np.int16(0)) - t)
    idx = np.where(cmp != 0, np.arange(n), n)
    idx = np.minimum.accumulate(idx[::-1])[::-1]
    small = np.append(cmp, np.int16(-1))[idx] > 0
    small[t == 0] = True                       # ends are sorted directly, in any order
    if wanted is None:
        needed = np.ones(n, bool)
    else:                                      # a suffix that is induced needs those up to the next type B
        to = np.where(small, np.arange(n), n - 1)
        to = np.minimum.accumulate(to[::-1])[::-1][wanted]
        needed = np.cumsum(np.bincount(np.flatnonzero(wanted), minlength=n + 1)
                           - np.bincount(to + 1, minlength=n + 1))[:n] > 0
    # stage one: sort type B suffixes directly, word by word, ties only
    levels = -(-depth // 7)
    if key is None:
        key = words(t, 7 * levels)
    order = np.flatnonzero(small & needed)
    order = order[np.argsort(key[order], kind="stable")]
    word = key[order]
    at = np.arange(len(order))
    new, level = np.append(True, word[1:] != word[:-1])[:len(order)], 1
    while True:
        group = np.cumsum(new) - 1
        keep = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        at, new, group = at[keep], new[keep], group[keep]
        if not len(at) or level >= levels:
            break
        word, level = key[order[at] + 7 * level], level + 1
        apart = np.append(False, word[1:] != word[:-1]) & ~new
        if apart.any():                        # groups that still agree need no sort
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[apart]] = True
            m = np.flatnonzero(mixed[group])
            p = m[np.lexsort((word[m], group[m]))]
            order[at[m]], word[m] = order[at[p]], word[p]
            new = new | np.append(True, word[1:] != word[:-1])
    # stage two: buckets by first symbol in rising order; a suffix larger than its
    # successor is put, in the successors' order, before its bucket's direct ones
    direct = np.split(order, np.cumsum(np.bincount(t[order], minlength=257))[:-1])
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    needed &= ~small
    out = []
    for c in range(257):
        parts = []
        part = np.concatenate(induced[c]) if induced[c] else order[:0]
        while len(part):                       # a bucket may add to itself (runs)
            parts.append(part)
            part = part[part > 0] - 1
            part = part[needed[part] & (t[part] == c)]
        parts.append(direct[c])
        done = np.concatenate(parts)
        out.append(done)
        prev = done[done > 0] - 1
        prev = prev[needed[prev] & (t[prev] > c)]
        if len(prev):
            prev = prev[np.argsort(t[prev], kind="stable")]
            by = t[prev]
            cut = np.flatnonzero(by[1:] != by[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(prev)]):
                induced[by[a]].append(prev[a:b])
    sa = np.concatenate(out)
    return sa if wanted is None else sa[wanted[sa]]


def equal_next(key: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares ``depth`` symbols with the one before it; ``key`` holds the :func:`words`."""
    live, cut = np.arange(1, len(sa)), np.uint64(9 * max(0, 7 - depth))
    for k in [*range(0, depth - 7, 7), max(0, depth - 7)]:
        live = live[key[sa[live] + k] >> cut == key[sa[live - 1] + k] >> cut]
    out = np.zeros(len(sa), bool)
    out[live] = True
    return out


def repeats(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to): runs of starts in each segment whose string starts in an earlier place.

    A segment is ``size`` bytes of ``data`` from ``begin``; those that share
    strings are given in the order of their places.
    """
    base = np.cumsum(size + 1) - size - 1
    ends = base + size
    src = np.repeat(begin - base, size + 1) + np.arange(ends[-1] + 1)
    t = data[np.minimum(src, len(data) - 1)].astype(np.int16) + np.int16(1)
    t[ends] = 0
    # places where a whole string starts
    count = size - length + 1
    starts = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(count.sum())
    wanted = np.zeros(len(t), bool)
    wanted[starts] = True
    key = words(t, 7 * -(-length // 7))
    sa = suffix_array(t, length, wanted, key)
    same = equal_next(key, sa, length)
    group = np.cumsum(~same)
    if not same.any():
        return base[:0], base[:0], base[:0]
    # starts of segments never overlap, so places in ``t`` are in the order of starts
    head = np.flatnonzero(~same)
    at = np.sort(sa[sa != np.minimum.reduceat(sa, head)[group - 1]])
    new = np.append(True, at[1:] != at[:-1] + 1)
    a, b = at[new], at[np.append(new[1:], True)] + 1
    seg = np.searchsorted(base, a, side="right") - 1
    return seg, a - base[seg], b - base[seg]


# --------------------------------------------------------------- operators

# anchor (48 bits), segment hash, document id, row after the chunk's first, start (lowest bit: anchor met twice), starts
PLACE = np.dtype([("h", "<u4"), ("l", "<u2"), ("s", "<u8"), ("d", "<i8"), ("u", "<u4"), ("a", "<u4"), ("n", "<u4")])
LEAST = -(1 << 63)   # the place of a null id
CHUNK = 4096         # rows whose anchors or segments a task looks at together
# of a segment: anchor, document id (or least), row, start, bytes
HEAD = np.dtype([("h", "<i8"), ("d", "<i8"), ("u", "<i8"), ("a", "<i4"), ("n", "<i4")])


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
             ) -> DataFrame:
    """(uid, doc_id, data, row): a row number, to be stored, the text's compressed bytes, the ``carry`` columns."""
    row = F.struct(F.col(text_col).isNull().alias("_null"), *[F.col(f"`{c}`") for c in carry])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row.alias("row"))
    kind = src.schema["row"].dataType.simpleString()

    @freeing
    def run(batches):
        uid, press = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                data = [press((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                yield pa.record_batch([pa.array(range(uid, uid + len(data)), pa.int64()), part.column(0),
                                       pa.array(data, pa.binary()), part.column(2)], ["uid", "doc_id", "data", "row"])
                uid += len(data)

    return src.mapInArrow(run, f"uid long, doc_id long, data binary, row {kind}")


def _packed(keys: np.ndarray, rows: np.ndarray, name: str) -> pa.RecordBatch:
    """One row (``name``, data) per key: its rows' bytes, packed."""
    p = np.argsort(keys, kind="stable")
    keys, rows = keys[p], rows[p]
    cut = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else [], len(keys)).astype(int)
    return pa.record_batch([pa.array(keys[cut[:-1]].astype(np.int64)),
                            pa.array([rows[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                           [name, "data"])


def _chunks(batches, near: bool = False):
    """Lists of about CHUNK rows; ``near``: whose uids differ by less than 32 bits.

    A task may read several stored files, whose uids lie further apart.
    """
    held: list[dict] = []
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            for r in batch.slice(k, ROWS).to_pylist():
                if near and held and r["uid"] >> 32 != held[0]["uid"] >> 32:
                    yield held
                    held = []
                held.append(r)
            if len(held) >= CHUNK:
                yield held
                held = []
    if held:
        yield held


def _by_order(rows: np.ndarray, uids: np.ndarray) -> np.ndarray:
    """Order by anchor, segment and place."""
    key = rows["h"].astype(np.uint64) << np.uint64(16) | rows["l"]
    p = np.argsort(key, kind="stable")
    key = key[p]
    same = key[1:] == key[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)[:len(p)]) if len(p) else p
    q = p[tied]
    p[tied] = q[np.lexsort((rows["a"][q], uids[q], rows["d"][q], rows["s"][q], key[tied]))]
    return p


def _equal(rows: np.ndarray, *names: str) -> np.ndarray:
    """Whether each row equals the one before it."""
    out = np.ones(len(rows), bool)
    for n in names:
        out[1:] &= rows[n][1:] == rows[n][:-1]
    out[:1] = False
    return out


def anchor_places(texts: DataFrame, width: int, length: int, gram: int) -> DataFrame:
    """(uid, gone, starts): packed runs [from, to) of a text's segments that go at once, as equal ones come
    earlier, and packed ``START`` of those whose anchor different segments share."""
    @freeing
    def tell(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for rows in _chunks(batches, near=True):     # a row is told as 32 bits from the chunk's first
            of, h, s, a, n = anchors([open_(r["data"]) for r in rows], length, gram)
            uids = np.array([r["uid"] for r in rows])
            first = uids.min()
            out = np.zeros(len(h), PLACE)
            out["h"], out["l"] = h >> np.uint64(32), h >> np.uint64(16) & np.uint64(0xFFFF)
            out["s"], out["a"], out["n"] = s, a << 1, n
            out["d"] = np.array([LEAST if r["doc_id"] is None else r["doc_id"] for r in rows])[of]
            out["u"] = (uids - first)[of]
            out = out[_by_order(out, out["u"])]
            same = _equal(out, "h", "l", "s")
            if same.any():                       # later ones of equal segments: a negative key names the row
                yield _packed(-1 - (out["u"][same].astype(np.int64) + first), _runs(out[same], length), "to")
            out = out[~same]
            met = _equal(out, "h", "l")
            out["a"] |= met | np.append(met[1:], False)[:len(out)]
            for to, data in zip(*_packed(out["h"].astype(np.int64) % width, out, "to").columns):
                yield pa.record_batch([pa.array([to.as_py()]), pa.array([struct.pack("<q", first) + data.as_py()])],
                                      ["to", "data"])

    @freeing
    def answer(batches):
        parts, firsts = [], []
        for batch in batches:
            for to, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if to < 0:
                    runs = np.frombuffer(data, "<i4").reshape(-1, 2)
                    yield _told(np.full(len(runs), -1 - to), runs, None)
                else:
                    parts.append(np.frombuffer(data, PLACE, offset=8))
                    firsts.append(np.full(len(parts[-1]), struct.unpack_from("<q", data)[0]))
        if not parts:
            return
        rows, uids = np.concatenate(parts), np.concatenate(firsts)
        parts.clear()
        firsts.clear()
        uids += rows["u"]
        p = _by_order(rows, uids)
        rows, uids = rows[p], uids[p]
        del p
        same = _equal(rows, "h", "l", "s")
        if same.any():
            yield _told(uids[same], _runs(rows[same], length), None)
        rows, uids = rows[~same], uids[~same]    # the first of each segment whose anchor has several
        met = _equal(rows, "h", "l")
        hit = met | np.append(met[1:], False)[:len(rows)] | (rows["a"] & 1 > 0)
        if hit.any():
            rows, uids = rows[hit], uids[hit]
            yield _told(uids, _runs(rows, length), rows["h"].astype(np.int64) << 16 | rows["l"])

    @freeing
    def by_row(batches):
        for batch in batches:
            cols: list[list] = [[], [], []]
            for parts in batch.column(1).to_pylist():
                rows = np.frombuffer(b"".join(parts), TOLD)
                rows = rows[np.argsort(rows["u"], kind="stable")]
                for own in np.split(rows, np.flatnonzero(np.diff(rows["u"])) + 1):
                    gone = own["h"] < 0
                    for c, v in zip(cols, (int(own["u"][0]), own[["a", "b"]][gone].astype(RUN).tobytes(),
                                           own[["h", "a", "b"]][~gone].astype(START).tobytes())):
                        c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()))],
                                  ["uid", "gone", "starts"])

    # answers travel in groups of rows, so that their number follows the texts and not the buckets
    return (texts.select("uid", "doc_id", "data").mapInArrow(tell, "to long, data binary").repartition(width, "to")
            .mapInArrow(answer, "rows long, data binary")
            .groupBy("rows").agg(F.collect_list("data").alias("data"))      # of GROUP texts, so bounded by them
            .mapInArrow(by_row, "uid long, gone binary, starts binary"))


GROUP = 32           # rows whose answers travel together
RUN = np.dtype([("a", "<i4"), ("b", "<i4")])         # bytes from, to
START = np.dtype([("h", "<i8"), ("a", "<i4"), ("b", "<i4")])     # anchor, bytes from, to
TOLD = np.dtype([("u", "<i8"), ("h", "<i8"), ("a", "<i4"), ("b", "<i4")])    # row, anchor (-1: goes at once), from, to


def _runs(rows: np.ndarray, length: int) -> np.ndarray:
    """[from, to) of the bytes of each segment."""
    a = (rows["a"] >> 1).astype("<i4")
    return np.stack([a, a + (rows["n"].astype("<i4") + (length - 1))], 1).astype("<i4")


def _told(uids: np.ndarray, runs: np.ndarray, anchor: np.ndarray | None) -> pa.RecordBatch:
    out = np.zeros(len(uids), TOLD)
    out["u"], out["h"], out["a"], out["b"] = uids, -1 if anchor is None else anchor, runs[:, 0], runs[:, 1]
    return _packed(uids // GROUP, out, "rows")


def removed_runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(uid, data): packed int32 pairs [from, to) of the bytes to remove, a row or more per uid.

    ``texts`` is the stored result of :func:`numbered`.
    """
    width = max(shuffle_width(texts.sparkSession), texts.rdd.getNumPartitions())
    told = stored(anchor_places(texts, width, length, gram), "told")
    release(texts.sparkSession)          # the places' shuffle is the largest

    @freeing
    def cut(batches):
        """Segments by anchor: how many, their heads, their bytes."""
        open_ = zstandard.ZstdDecompressor().decompress
        for rows in _chunks(batches):
            found = [np.frombuffer(r["starts"], START) for r in rows]
            each, got = [len(f) for f in found], np.concatenate(found)
            data = [open_(r["data"]) for r in rows]
            begin = np.cumsum([0] + [len(x) for x in data[:-1]])
            data = b"".join(data)
            head = np.zeros(len(got), HEAD)
            head["h"], head["a"], head["n"] = got["h"], got["a"], got["b"] - got["a"]
            head["d"] = np.repeat([LEAST if r["doc_id"] is None else r["doc_id"] for r in rows], each)
            head["u"] = np.repeat([r["uid"] for r in rows], each)
            at, to = np.repeat(begin, each) + got["a"], (got["h"] >> 16) % width
            p = np.argsort(to, kind="stable")
            head, at, to = head[p], at[p], to[p]
            edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            seg = [data[x:x + n] for x, n in zip(at.tolist(), head["n"].tolist())]
            out = [b"".join([struct.pack("<q", b - a), head[a:b].tobytes(), *seg[a:b]])
                   for a, b in zip(edges, edges[1:])]
            yield pa.record_batch([pa.array(to[edges[:-1]]), pa.array(out, pa.binary())], ["to", "data"])

    @freeing
    def induce(batches):
        heads, parts = [], []
        for batch in batches:
            for data in batch.column(1).to_pylist():
                n, = struct.unpack_from("<q", data)
                heads.append(np.frombuffer(data, HEAD, n, 8))
                parts.append(data[8 + heads[-1].nbytes:])
        if not heads:
            return
        head, data = np.concatenate(heads), np.frombuffer(b"".join(parts), np.uint8)
        heads.clear()
        parts.clear()
        begin = np.cumsum(head["n"], dtype=np.int64) - head["n"]
        p = np.lexsort((head["a"], head["u"], head["d"], head["h"]))       # by anchor, then place
        head, begin = head[p], begin[p]
        size = head["n"].astype(np.int64)
        sums = np.cumsum(size)
        ends = np.append(np.flatnonzero(np.diff(head["h"])) + 1, len(head))
        a = 0
        while a < len(head):                     # whole anchors, about SORT bytes at a time
            b = int(np.searchsorted(sums, (sums[a - 1] if a else 0) + SORT)) + 1
            b = int(ends[min(np.searchsorted(ends, b), len(ends) - 1)])
            seg, x, y = repeats(data, begin[a:b], size[a:b], length)
            if len(seg):
                own = head[a:b][seg]
                yield _packed(own["u"], np.stack([own["a"] + x, own["a"] + y - 1 + length], 1).astype("<i4"), "uid")
            a = b

    segments = (texts.join(told.where(F.length("starts") > 0), "uid").select("uid", "doc_id", "data", "starts")
                .mapInArrow(cut, "to long, data binary").repartition(width, "to"))
    return segments.mapInArrow(induce, "uid long, data binary").unionByName(
        told.where(F.length("gone") > 0).select("uid", F.col("gone").alias("data")))


def _union(batches):
    """The merged runs of each row's lists (uid, runs)."""
    for batch in batches:
        out = []
        for runs in batch.column(1).to_pylist():
            g = np.frombuffer(b"".join(runs), "<i4").reshape(-1, 2)
            g = g[np.argsort(g[:, 0], kind="stable")]
            reach = np.maximum.accumulate(g[:, 1])
            new = np.append(True, g[1:, 0] > reach[:-1])
            ends = np.append(np.flatnonzero(new)[1:] - 1, len(g) - 1)
            out.append(np.stack([g[new, 0], reach[ends]], 1).astype("<i4").tobytes())
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["uid", "runs"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, row) of every row of ``docs``.

    ``kept`` holds the remaining bytes, ``row`` the columns named in ``carry``.
    """
    release(docs.sparkSession)           # of what came before
    texts = stored(numbered(docs, id_col, text_col, carry), "texts")
    kind = texts.schema["row"].dataType.simpleString()
    runs = stored(removed_runs(texts, length, gram).groupBy("uid").agg(F.collect_list("data").alias("runs"))
                  .mapInArrow(_union, "uid long, runs binary"), "runs")      # of one text, so bounded by it

    @freeing
    def apply(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                cols: list[list] = [[], [], [], []]
                for data, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = open_(data)
                    spans = np.frombuffer(runs or b"", "<i4").reshape(-1, 2).tolist()
                    n = sum(b - a for a, b in spans)
                    at, left = 0, []
                    for a, b in spans:
                        left.append(data[at:a])
                        at = b
                    left.append(data[at:])
                    for c, v in zip(cols, (len(data), n, len(spans), b"".join(left))):
                        c.append(v)
                yield pa.record_batch([part.column(0), *[pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int64(), pa.int64(), pa.binary()))], part.column(3)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "row"])

    return (texts.join(runs, "uid", "left").select("doc_id", "data", "runs", "row").mapInArrow(
        apply, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, row {kind}"))


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes gone from its texts; a character that lost a byte goes whole."""
    names = docs.columns
    done = dedup_substrings(docs, id_col, text_col, length, gram, tuple(c for c in names if c != text_col))

    @freeing
    def decode(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                text = [b.decode("utf-8", "ignore") for b in part.column(0).to_pylist()]
                yield pa.record_batch([pa.array(text, pa.string()), part.column(1)], ["text", "row"])

    out = done.select("kept", "row").mapInArrow(decode, f"text string, row {done.schema['row'].dataType.simpleString()}")
    return out.select(*[F.col(f"row.`{c}`").alias(c) if c != text_col else
                        F.when(~F.col("row._null"), F.col("text")).alias(c) for c in names])
