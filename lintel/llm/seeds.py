"""Repeated passages by seed and extend (operator 11).

A word goes when a window of ``window`` consecutive words that covers it also
starts earlier: in a document with a smaller id, or earlier in the same one.

Seeds: every window holds ``window - GRAM + 1`` grams of words, and the one of
the smallest hash (the leftmost, if several) is its anchor, so equal windows
have equal anchors at the same place.  Documents are joined on their anchors:
an anchor that stands once in the corpus rules its windows out.

Extending: consecutive windows of one anchor form a stretch, the anchor with
the words to its left and right that any of its windows reaches.  Where whole
stretches are equal, the match goes both ways as far as the anchor's windows
do, and all but the first go at once.  Only the first of each class of equal
stretches whose anchor other classes share are extended step by step: each of
their windows, from the one that reaches furthest to the left to the one that
reaches furthest to the right, is matched by its own hash, and goes unless it
is the first.  Windows that go in a row are one maximal repeat; its words go.

Words are told apart by 64-bit hashes, stretches by the anchor's hash and one
of their own, windows by two (128 bits).  A task tells of equal stretches or
windows in a slice of its texts once, with the earliest place; so those of two
rows are in different texts, and a place is a single number made of the id and
the row's: the first of equal ones is a grouped minimum, combined before the
shuffle.  No pairs are formed: a passage in a third of all texts is one row a
slice.  Texts travel compressed, and a table that is done with is deleted.

Defined cases: null, empty and blank texts have no words; a text of fewer than
``window`` words loses nothing; a null id is the smallest; rows that repeat an
id are ordered by where they stand in the input; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import discard, read_back, slices, stored, write_out
from lintel.llm.shingles import mix, range_hashes
from lintel.llm.suffix import numbered

WINDOW, GRAM = 20, 8
BLOCK = 1 << 20       # bytes whose words are hashed together
SLICE = 2 << 20       # compressed bytes of text a task looks at together
ROW_BITS = 60         # of a place, for the row number
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a slice of texts: byte ranges, and how many are each text's."""

    def __init__(self, texts: list[bytes]):
        self.offs = np.cumsum([0, *map(len, texts)])
        b = self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        solid = np.append(~_BLANK[b], False)
        new = np.zeros(len(b) + 1, bool)
        new[self.offs] = True                            # words do not reach across texts
        before = np.append(False, solid[:-1])
        self.start = np.flatnonzero(solid & (new | ~before))
        self.stop = np.flatnonzero(before & (new | ~solid))
        self.first = np.searchsorted(self.start, self.offs)      # each text's first word, and the end

    def hashes(self) -> np.ndarray:
        """A hash of each word, by blocks of whole words."""
        out, a = [], 0
        while a < len(self.start):
            at = self.start[a]
            z = max(a + 1, int(np.searchsorted(self.stop, at + BLOCK, "right")))
            out.append(range_hashes(self.bytes[at:self.stop[z - 1]], self.start[a:z] - at, self.stop[a:z] - at))
            a = z
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def runs_of(h: np.ndarray, size: int, step: int = 0) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    out, have, done = None, h, 0
    # by doubling: the binary digits of the size, from the lowest
    power = _STEP[step]
    width = 1
    while size:
        if size & 1:
            if out is None:
                out, done = have, width
            else:
                n = len(h) - done - width + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = mix(out[:n] * power + have[done:done + n])
                done += width
        size >>= 1
        if size:
            n = len(h) - 2 * width + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            have = mix(have[:n] * power + have[width:width + n])
            width *= 2
    return out


def stretches(words: Words, window: int, gram: int):
    """(text, first word, number of windows, anchor's hash, stretch's hash) of every anchor.

    Consecutive windows of one text whose anchor is the same gram.
    """
    h, n = words.hashes(), len(words.start)
    count = n - window + 1
    if count <= 0:
        return [np.zeros(0, t) for t in ("i8", "i8", "i8", "u8", "u8")]
    g = runs_of(h, gram)
    low, pos, width, reach = g, np.arange(len(g)), 1, window - gram + 1

    def left_of(a, b, at, to):
        return np.where(a <= b, a, b), np.where(a <= b, at, to)

    while width * 2 <= reach:
        low, pos = left_of(low[:-width], low[width:], pos[:-width], pos[width:])
        width *= 2
    more = reach - width
    low, pos = left_of(low[:count], low[more:more + count], pos[:count], pos[more:more + count])
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[:count]
    inside = np.arange(count) + window <= words.first[1:][text]
    at = np.flatnonzero(inside)
    new = np.append(True, (np.diff(at) > 1) | (np.diff(pos[at]) > 0) | (np.diff(text[at]) > 0))[:len(at)]
    first = at[new]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    # a stretch is told by prefix sums of its words' hashes times powers of an odd number
    return text[first], first, size, low[first], _spans(h, first, first + size + window - 1)


def _spans(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each range of words."""
    base = 0xA0761D6478BD642F
    up = np.cumprod(np.append(np.uint64(1), np.full(len(h), base, np.uint64)), dtype=np.uint64)
    down = np.cumprod(np.append(np.uint64(1), np.full(len(h), pow(base, -1, 1 << 64), np.uint64)), dtype=np.uint64)
    total = np.append(np.uint64(0), np.cumsum(mix(h) * up[:-1], dtype=np.uint64))
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def _later(*keys: np.ndarray) -> np.ndarray:
    """Whether each row's keys stand in an earlier row too."""
    order = np.lexsort(keys[::-1])           # stable: equal rows stay in order
    same = np.ones(len(order), bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    out = np.zeros(len(order), bool)
    out[order] = same
    return out


# --------------------------------------------------------------- operators

def _texts(batch: pa.RecordBatch) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(d) for d in batch.column("data").to_pylist()]


def _parts(batches):
    for whole in batches:
        yield from slices(whole, whole.schema.get_field_index("data"), size=SLICE)


def _ranks(batch: pa.RecordBatch) -> np.ndarray:
    """Each row's rank by id (null first), then row number."""
    doc = batch.column("doc_id")
    ids = doc.fill_null(0).to_numpy()
    order = np.lexsort((batch.column("uid").to_numpy(), ids, doc.is_valid().to_numpy(zero_copy_only=False)))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _places(batch: pa.RecordBatch) -> np.ndarray:
    """Each row's place, as two words of a 128-bit number: the id (null: one less than any), then the row number."""
    doc = batch.column("doc_id")
    ids, null = doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)
    high = np.where(null, ((-1 << 63) - 1) >> 4, ids >> 4)
    low = np.where(null, 15, ids & 15).astype(np.uint64) << np.uint64(ROW_BITS)
    return np.stack([low | batch.column("uid").to_numpy().astype(np.uint64), high.view(np.uint64)], 1)


def _decimals(places: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(places),
                                 [None, pa.py_buffer(np.ascontiguousarray(places).tobytes())])


PLACE = "decimal(38,0)"
SEED = f"h long, s long, place {PLACE}, uid long, at int, size int"


def seeds(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Stretches (anchor, hash, place, uid, first word, windows), once a slice; h is null for those that go at once."""
    def run(batches):
        for batch in _parts(batches):
            words = Words(_texts(batch))
            text, first, size, h, s = stretches(words, window, gram)
            order = np.lexsort((first, _ranks(batch)[text]))
            text, first, size, h, s = text[order], first[order], size[order], h[order], s[order]
            gone = _later(h, s)
            yield pa.record_batch([pa.array(h.view(np.int64), mask=gone), pa.array(s.view(np.int64)),
                                   _decimals(_places(batch)[text]), batch.column("uid").take(pa.array(text)),
                                   pa.array(first - words.first[text], pa.int32()), pa.array(size, pa.int32())],
                                  ["h", "s", "place", "uid", "at", "size"])

    return texts.select("uid", "doc_id", "data").mapInArrow(run, SEED)


ANSWER = ["uid", "at", "size"]


def classes(found: DataFrame) -> DataFrame:
    """(uid, at, size, gone) of stretches that go, and of those to be extended (gone is false)."""
    spark = found.sparkSession
    live = found.where("h is not null")
    shared = stored(live.groupBy(F.col("h").alias("anchor")).count().where("count > 1").select("anchor"), "anchors")
    path = write_out(live.join(shared, F.col("h") == F.col("anchor")).drop("anchor"), "met", "zstd")
    met = read_back(spark, path)
    # a class is all equal stretches; several: the anchor has other classes too
    first = stored(met.groupBy(F.col("h").alias("h1"), F.col("s").alias("s1")).agg(F.min("place").alias("first")),
                   "classes")
    several = first.groupBy(F.col("h1").alias("h2")).agg((F.count("*") > 1).alias("several"))
    first = first.join(several, F.col("h1") == F.col("h2")).drop("h2")
    told = met.join(first, (F.col("h") == F.col("h1")) & (F.col("s") == F.col("s1")))
    later = F.col("place") > F.col("first")
    out = stored(told.where(later | F.col("several")).select(*ANSWER, later.alias("gone"))
                 .unionByName(found.where("h is null").select(*ANSWER, F.lit(True).alias("gone"))), "stretches")
    discard(spark, path)
    return out


WINDOWS = f"w long, v long, place {PLACE}, uid long, at int"


def windows(texts: DataFrame, told: DataFrame, window: int) -> DataFrame:
    """Windows (two hashes, place, uid, first word) of the stretches to be extended, once a slice; w is null
    for those that go at once."""
    asked = (told.where("not gone").groupBy("uid")
             .agg(F.collect_list(F.struct("at", "size")).alias("asked")))       # of one text, so bounded by it
    each = texts.join(asked, "uid").select("uid", "doc_id", "data", "asked")

    def run(batches):
        for batch in _parts(batches):
            words = Words(_texts(batch))
            h = words.hashes()
            w, v = runs_of(h, window, 0), runs_of(h, window, 1)
            text, flat = _rows(batch.column("asked"))
            size = flat.field("size").to_numpy().astype(np.int64)
            at = flat.field("at").to_numpy() + words.first[text]
            at = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            text = np.repeat(text, size)
            order = np.lexsort((at, _ranks(batch)[text]))
            at, text = at[order], text[order]
            gone = _later(w[at], v[at])
            yield pa.record_batch([pa.array(w[at].view(np.int64), mask=gone), pa.array(v[at].view(np.int64)),
                                   _decimals(_places(batch)[text]), batch.column("uid").take(pa.array(text)),
                                   pa.array(at - words.first[text], pa.int32())], ["w", "v", "place", "uid", "at"])

    return each.mapInArrow(run, WINDOWS)


def _rows(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each item of a list column (null lists hold none), and the items."""
    offs = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(offs)), lists.flatten()


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(uid, at, size): runs of windows that also start earlier, by the first one's first word; stored.

    ``texts`` is the stored result of :func:`numbered`.
    """
    spark = texts.sparkSession
    path = write_out(seeds(texts, window, gram), "seeds", "zstd")
    told = classes(read_back(spark, path))
    discard(spark, path)
    path = write_out(windows(texts, told, window), "windows", "zstd")
    seen = read_back(spark, path)
    live = seen.where("w is not null")
    first = (live.groupBy(F.col("w").alias("w1"), F.col("v").alias("v1"))
             .agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"))
    late = live.join(first, (F.col("w") == F.col("w1")) & (F.col("v") == F.col("v1"))).where("place > first")
    one = F.lit(1).alias("size")
    out = stored(told.where("gone").select(*ANSWER).unionByName(late.select("uid", "at", one))
                 .unionByName(seen.where("w is null").select("uid", "at", one)), "repeats")
    discard(spark, path)
    return out


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, row) of every row of ``docs``.

    ``kept`` holds the remaining words joined by one space, ``row`` the columns
    named in ``carry``.
    """
    texts = stored(numbered(docs, id_col, text_col, carry), "texts")
    kind = texts.schema["row"].dataType.simpleString()
    runs = (repeats(texts, window, gram).groupBy("uid")
            .agg(F.collect_list(F.struct("at", "size")).alias("runs")))          # of one text, so bounded by it
    each = texts.join(runs, "uid", "left").select("doc_id", "data", "row", "runs")

    def run(batches):
        for batch in _parts(batches):
            words = Words(_texts(batch))
            text, flat = _rows(batch.column("runs"))
            first = flat.field("at").to_numpy() + words.first[text]
            edge = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + flat.field("size").to_numpy() - 1 + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.diff(np.append(0, np.cumsum(gone))[words.first])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)),
                                   pa.array(removed.astype(np.int64)), _kept(words, ~gone), batch.column("row")],
                                  ["doc_id", "n_words", "n_removed", "kept", "row"])

    return each.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept string, row {kind}")


def _kept(words: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space."""
    start, stop = words.start[keep], words.stop[keep]
    text = (np.repeat(np.arange(len(words.first) - 1), np.diff(words.first)))[keep]
    size = stop - start + 1                              # with a blank after each word but a text's last
    size[np.append(text[1:] != text[:-1], True)[:len(text)]] -= 1
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = words.bytes[np.minimum(at, max(0, len(words.bytes) - 1))] if len(at) else np.zeros(0, np.uint8)
    out[(ends - 1)[size > stop - start]] = 32
    total = np.zeros(len(words.first), np.int64)
    np.add.at(total[1:], text, size)
    return pa.Array.from_buffers(pa.large_string(), len(total) - 1, [None, pa.py_buffer(np.cumsum(total)),
                                                                     pa.py_buffer(out)]).cast(pa.string())


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated passages gone from its texts, whose words are joined by one space."""
    names = docs.columns
    done = dedup_passages(docs, id_col, text_col, window, gram, tuple(c for c in names if c != text_col))
    return done.select(*[F.col(f"row.`{c}`").alias(c) if c != text_col else
                         F.when(~F.col("row._null"), F.col("kept")).alias(c) for c in names])
