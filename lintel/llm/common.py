"""Helpers that the training-data operators share.

``table`` reads one input through Spark's reader, ``stored`` cuts lineage by a
table written under ``spark.checkpoint.dir`` (so a lost executor never costs
more than one stage), ``components`` labels connected components by
contraction, and ``PieceIds`` is a bounded memo of token ids.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that the session names for checkpoints."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, name: str, codec: str | None = None) -> str:
    """Write ``df`` under the shared folder; the path."""
    path = scratch(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return path


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Where ``rows`` bounds its rows, the files (and the last step's tasks) follow
    them, ``PART_ROWS`` each, and not the shuffle's partitions.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // PART_ROWS)))
    return df.sparkSession.read.schema(df.schema).parquet(write_out(df, name))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`write_out` that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark deletes a shuffle's files once nothing refers to the shuffle."""
    spark._jvm.System.gc()


def small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """A stored frame, to be broadcast if it is small, and else to be joined by a shuffle."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def prepare(spark: SparkSession) -> None:
    """Ship this package to the Python workers and settle the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "8m")


# Spark's bound on the bytes of a batch that goes to a Python worker: 10,000 rows
# of whole texts take tens of MB, in the JVM and in the worker, for each task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def freeing(run, encodes: bool = False):
    """``run`` over a task's batches, after which the worker gives unused memory back to the system.

    Workers live on from task to task, and their allocators keep what a task
    has freed, so stages that follow each other would add up.  For the same reason
    a task that ``encodes`` nothing drops the tokenizers that earlier ones left.
    """
    def freed(batches):
        if not encodes:
            drop_encoders()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):      # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)
    return freed


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_BYTES = 32 << 20
PART_ROWS = 1 << 15     # short rows that one task writes


# ---------------------------------------------------------------- vectors

def integer_vectors(vectors: DataFrame, factor: int, id_col: str, vec_col: str, label_col: str | None = None
                    ) -> DataFrame:
    """(id, x[, label]): ``floor(factor * c)`` of the vectors without null or non-finite components."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                         *([F.col(label_col).alias("label")] if label_col else []))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("v", lambda c: F.floor(F.lit(float(factor)) * c))
    return src.where(F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True))).withColumn("x", x).drop("v")


def ranges(vectors: DataFrame) -> list[tuple[int, str, int]]:
    """(length, narrowest type, largest absolute component) of each length of ``x``."""
    rows = (vectors.groupBy(F.size("x").alias("dim")).agg(F.min(F.array_min("x")).alias("low"),
                                                          F.max(F.array_max("x")).alias("high")).collect())
    out = []
    for r in sorted(rows, key=lambda r: r["dim"]):      # one row a length
        most = max(abs(r["low"] or 0), abs(r["high"] or 0))
        out.append((r["dim"], "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint", most))
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


# ------------------------------------------------------------- components

def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component_id) of every node in ``edges`` (a, b; at most ``rows``, if
    given): the smallest node reachable.

    Contraction: each node moves to the first of itself and its neighbours, in
    an order that is drawn anew every second round, and the edges move along;
    edges within one node go, repeated ones count once.  Nodes that still have
    edges at least halve or so in a round (a hub and its leaves are one after two),
    so the rounds grow with the logarithm of the nodes.  A round is a grouped
    minimum (combined before the shuffle, so a hub of any degree is no hot group)
    and two joins with the moves, which go along if they are few and else meet the
    edges in joins that adaptive execution splits.  Each round is stored; it ends
    when no edge is left.  Nulls and self loops are ignored.
    """
    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
               "edges", rows)
    at: DataFrame | None = None
    for turn in range(max_rounds):
        n = e.count()
        if not n and at is not None:
            break

        def place(c: str) -> Column:
            return F.struct(F.xxhash64(c, F.lit(turn // 2)).alias("h"), F.col(c).alias("id"))  # noqa: B023

        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("m"))
                       .select("node", F.least(place("node"), F.col("m"))["id"].alias("to")), "moves", 2 * n)
        to = F.broadcast(moves) if 2 * n <= MOVES else moves
        for c in "ab":
            e = e.join(to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")), c)
        e = stored(e.where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
                   .distinct(), "edges", n)
        if at is None:
            at, count = moves, 2 * n
        else:                                       # nodes that stand where nothing moves stay
            at = stored(at.join(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
                        .select("node", F.coalesce("next", "to").alias("to")), "places", count)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = at.groupBy("to").agg(F.min("node").alias("component_id"))
    return at.join(F.broadcast(stored(least, "least", count)) if count <= MOVES else least, "to").select(
        "node", "component_id")


MOVES = 1 << 19      # nodes with their moves (16 bytes each) that may go to every task


# --------------------------------------------------------------- token ids

# A text may be cut before a blank or line feed that stands between two
# characters that are no white space: no token pattern used here matches
# across that place, so the pieces' ids in a row are the text's ids.
PIECES = re.compile(r"(?<=\S)(?=[ \n]\S)").split


def slices(batch: pa.RecordBatch, column: int, rows: int = 2048, size: int = 8 << 20):
    """Slices of a batch of about ``size`` bytes of one column, at most ``rows`` rows."""
    lens = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        before = lens[a - 1] if a else 0
        b = min(a + rows, max(a + 1, int(np.searchsorted(lens, before + size))))
        yield batch.slice(a, b - a)
        a = b


# A key that is no word, or whose word begins or ends with white space.
_WS = r"\x09\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = rf"^[\x00\n]?$|^[\x00\n][{_WS}\n]|^[{_WS}]|[{_WS}\n]$"

# A key that ends with a Latin letter and then ASCII punctuation; the pre-tokenizers
# of ``library_encoder`` that split words cut there, whatever stands before or after.
TAIL = r"(?s)^(?P<stem>.*[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])(?P<tail>[!-/:-@\[-`{-~]+)$"


class PieceIds:
    """Ids of texts through a bounded memo of their pieces.

    ``encode`` maps a list of distinct keys to all their ids in a row and how
    many are each key's.  Texts without odd white space are cut by string
    splitting alone: a key is then a word (the blank before it is understood),
    a line feed with the word after it, or NUL and the text's first word; other
    texts are cut by ``PIECES`` and their keys start with SOH.  Where ``encode`` has
    ``splits``, the punctuation that ends a word is a key of its own; where it has
    ``drops``, white space has no ids, and where it has ``folds``, ASCII letters are
    lower-cased, so that words met in several forms are one key.  When the memo holds
    about ``limit`` bytes, only keys met in several batches stay, so memory does
    not grow with the input; :meth:`trim` leaves ``rest`` bytes at most.
    """

    def __init__(self, encode, limit: int = 80 << 20, rest: int = 32 << 20):
        self.encode, self.limit, self.rest = encode, limit, rest
        self.slot: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)
        self.used = 0
        self.splits, self.drops, self.folds = (getattr(encode, c, False) for c in ("splits", "drops", "folds"))

    def trim(self) -> None:
        """Keep the keys met most often, within ``rest`` bytes."""
        keys = list(self.slot)                       # in the order of their places
        cost = np.fromiter(map(len, keys), np.int64, len(keys)) + KEY_BYTES + 4 * self.size
        order = np.argsort(-self.hits, kind="stable")
        order = order[self.hits[order] > 1]
        keep = np.sort(order[np.cumsum(cost[order]) <= self.rest])
        size, stop = self.size[keep], np.cumsum(self.size[keep])
        self.ids = self.ids[np.repeat(self.begin[keep] - (stop - size), size) + np.arange(size.sum())]
        self.begin, self.size, self.hits = stop - size, size, self.hits[keep] // 2 + 1
        self.slot = dict(zip([keys[i] for i in keep.tolist()], range(len(keep))))
        self.used = int(cost[keep].sum())

    def _slots(self, keys: list[str]) -> np.ndarray:
        """Where the memo holds each of some distinct keys."""
        out = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(out < 0)
        if len(new):
            todo = [keys[i] for i in new.tolist()]
            ids, size = self.encode(todo)
            n = len(self.size)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
            self.hits = np.concatenate([self.hits, np.zeros(len(todo), np.int64)])
            self.slot.update(zip(todo, range(n, n + len(todo))))
            out[new] = np.arange(n, n + len(todo))
            self.used += sum(map(len, todo)) + KEY_BYTES * len(todo) + ids.nbytes
        self.hits[out] += 1
        return out

    def _distinct(self, keys: pa.Array) -> np.ndarray:
        """Where the memo holds each of some keys that may repeat."""
        coded = keys.dictionary_encode()
        return self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]

    def _places(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the memo holds the parts of some distinct keys, in a row, and how many parts each has."""
        if not (self.splits or self.drops or self.folds):
            return self._slots(keys.to_numpy(zero_copy_only=False).tolist()), np.ones(len(keys), np.int64)
        if self.drops:
            keys = pc.replace_substring_regex(keys, r"^[\x00\n]", "")
        if self.folds:
            keys = pc.if_else(pc.string_is_ascii(keys), pc.ascii_lower(keys), keys)
        many = np.ones(len(keys), np.int64)
        if not self.splits:
            return self._distinct(keys), many
        cut = pc.extract_regex(keys, TAIL)
        has = cut.is_valid()
        many += has.to_numpy(zero_copy_only=False)
        first = np.cumsum(many) - many
        place = np.empty(many.sum(), np.int64)
        place[first] = self._distinct(pc.if_else(has, pc.struct_field(cut, "stem"), keys))
        tails = pc.struct_field(cut, "tail").filter(has)
        if not self.drops:      # no blank before it
            tails = pc.binary_join_element_wise(pa.scalar("\0"), tails, "")
        place[first[many > 1] + 1] = self._distinct(tails)
        return place, many

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many are each text's (null: none)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        plain = pc.binary_join_element_wise(pa.scalar("\0"),
                                            pc.replace_substring(texts, "\n", " \n"), "")
        words = pc.split_pattern(plain, " ")
        offs = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        codes, keys = coded.indices.to_numpy(), coded.dictionary
        odd = pc.match_substring_regex(keys, ODD).to_numpy(zero_copy_only=False)
        counts = np.add.reduceat(np.append(odd[codes], False), offs[:-1], dtype=np.int64) if len(texts) else offs[:0]
        bad = (counts > 0) | pc.or_(pc.match_substring(texts, "\0"), pc.match_substring(texts, "\1")).to_numpy(
            zero_copy_only=False)
        # places of what is left of the keys, then those of each odd text's pieces
        if self.used > self.limit:
            self.trim()
        many = np.zeros(len(keys), np.int64)
        if bad.any():
            sure = np.zeros(len(keys), bool)
            sure[codes[~np.repeat(bad, np.diff(offs))]] = True
            place, many[sure] = self._places(keys.filter(pa.array(sure)))
        else:
            place, many[:] = self._places(keys)
        if bad.any() or len(place) > len(keys):
            n, first = many[codes], np.cumsum(many) - many
            ends = np.concatenate([[0], np.cumsum(n)])
            at = place[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])]
            offs = ends[offs]
        else:
            at = place[codes]
        if bad.any():
            parts, last = [], 0
            n = np.diff(offs)
            for i in np.flatnonzero(bad).tolist():
                mine = ["\1" + p for p in PIECES(texts[i].as_py())] if len(texts[i].as_py()) else []
                known = list(dict.fromkeys(mine))
                spot = dict(zip(known, self._slots(known).tolist()))
                parts += [at[last:offs[i]], np.array([spot[k] for k in mine], np.int64)]
                last, n[i] = offs[i + 1], len(mine)
            at = np.concatenate([*parts, at[last:]])
            offs = np.concatenate([[0], np.cumsum(n)])
        each = self.size[at]
        stop = np.cumsum(each)
        take = np.repeat(self.begin[at] - (stop - each), each)
        take += np.arange(len(take))
        ends = np.concatenate([[0], stop])[offs]
        return self.ids[take], np.diff(ends)


def piece_of(key: str) -> str:
    """The piece that a key of :class:`PieceIds` stands for."""
    return key[1:] if key[0] in "\0\1" else key if key[0] == "\n" else " " + key


KEY_BYTES = 180      # of a key in the memo, besides its characters and ids
GROUP = 1024


def library_encoder(data: bytes):
    """Piece encoder over the JSON file of a byte-level ``tokenizers`` tokenizer."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(data.decode("utf-8"))
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    tok.no_truncation()
    tok.no_padding()
    end = getattr(tok.model, "end_of_word_suffix", None) or ""
    vocab = tok.get_vocab()
    width = np.zeros(max(vocab.values()) + 1, np.int64)     # bytes of each token: one character a byte
    for token, i in vocab.items():
        width[i] = len(token) - (len(end) if end and token.endswith(end) else 0)
    blanks = not end     # with word ends, white space is dropped
    splits, folds = _known_steps(json.loads(data))
    normal = tok.normalizer.normalize_str if tok.normalizer is not None else None
    tok.normalizer = None       # texts are normalised before they go in, so that their sizes are known

    def clean(text: str) -> str:
        return text if normal is None else text.lower() if folds and text.isascii() else normal(text)

    def sizes(parts: list[str], text: str) -> np.ndarray | None:
        """Bytes that the ids of each part (a blank or line feed, then a word) of a clean text stand for, if known."""
        if not blanks:
            words = text.split()
            return pc.binary_length(pa.array(words, pa.string())).to_numpy() if len(words) == len(parts) else None
        n = pc.binary_length(pa.array(parts, pa.string())).to_numpy().astype(np.int64)
        if normal is not None and not text.isascii():
            for i, p in enumerate(parts):
                if not p.isascii():
                    n[i] = len(normal(p).encode("utf-8"))
        return n + np.fromiter((p[0] != "\n" for p in parts), np.int64, len(parts))      # the blank is understood

    def alone(pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tok.encode_batch_fast([clean(p) for p in pieces],
                                                                      add_special_tokens=False)]

    def encode(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a call takes many keys in a row (each starts where no match can
        # reach across); the ids' byte counts tell where a key ends
        size = np.zeros(len(keys), np.int64)
        flat: list[np.ndarray] = []
        first, plain, wide = [], [], []
        for i, k in enumerate(keys):
            (first if k[0] in "\0\1" else plain if k.isascii() else wide).append(i)
        plain += wide
        for i, ids in zip(first, alone([piece_of(keys[i]) for i in first])):
            flat.append(ids)
            size[i] = len(ids)
        for a in range(0, len(plain), GROUP):
            part = plain[a:a + GROUP]
            own = [keys[i] for i in part]
            text = clean((" " + " ".join(own)).replace(" \n", "\n"))
            ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            done = np.cumsum(width[ids])
            want = sizes(own, text)
            want = None if want is None else np.cumsum(want)
            stop = None if want is None else np.searchsorted(done, want)
            if want is None or not len(done) or done[-1] != want[-1] or (done[stop] != want).any():
                each = alone([piece_of(k) for k in own])     # lengths that say nothing: one by one
                flat += each
                size[part] = [len(e) for e in each]
            else:
                flat.append(ids)
                size[part] = np.diff(stop + 1, prepend=0)
        # ids are in the order of `first`, then `plain`
        order = np.array(first + plain, np.int64)
        got = size[order]
        begin = np.empty(len(keys), np.int64)
        begin[order] = np.cumsum(got) - got
        ids = np.concatenate(flat) if flat else np.zeros(0, "<u4")
        if first or wide:
            stop = np.cumsum(size)
            at = np.repeat(begin - (stop - size), size)
            ids = ids[at + np.arange(len(at))]
        return ids, size

    encode.splits, encode.drops, encode.folds = splits, not blanks, folds and not blanks
    return encode


# No match reaches from a letter to the punctuation after it, and none looks back.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _known_steps(spec: dict) -> tuple[bool, bool]:
    """Whether a tokenizer surely cuts between a letter and punctuation, and surely lower-cases ASCII and no more."""
    def steps(x, name):
        return x[name] if x and x["type"] == "Sequence" else [x] if x else []

    cuts = [(c["type"], c.get("use_regex"), (c.get("pattern") or {}).get("Regex")) for c in
            steps(spec.get("pre_tokenizer"), "pretokenizers")]
    splits = cuts in ([("ByteLevel", True, None)], [("Split", None, _WORDS), ("ByteLevel", False, None)])
    changes = [c["type"] if c["type"] != "Replace" else (c["pattern"].get("Regex"), c["content"]) for c in
               steps(spec.get("normalizer"), "normalizers")]
    same = all(c in ("NFC", "NFD", "Lowercase", (r"\s+", " ")) for c in changes)
    return splits and same, same and "Lowercase" in changes


_ENCODERS: dict[str, PieceIds] = {}


def library_ids(key: str, data: bytes) -> PieceIds:
    """The worker's memo for one tokenizer, to be trimmed when a task ends."""
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceIds(library_encoder(data))
    return _ENCODERS[key]


def drop_encoders() -> None:
    """Forget the worker's tokenizers and their memos."""
    _ENCODERS.clear()


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver (a fixed size of some MB)."""
    with open(path, "rb") as f:
        return f.read()
