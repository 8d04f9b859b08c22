"""Best-fit packing by a grouping genetic algorithm (operator 10).

Every text is tokenised once and cut into pieces of at most ``capacity``
tokens; full pieces are sequences by themselves.  The other pieces are dealt
to islands by a hash.  An island evolves packings of its pieces: a crossover
injects whole well-filled bins of one parent into another, drops the bins that
hold the same pieces, and puts the displaced pieces back by best fit.  Several
islands evolve each deal with seeds of their own; their elites migrate to one
population that evolves on.  Bins that came out well filled are settled, and
the pieces of the others are dealt anew, to as many islands as they need, until
one deal holds them all.  Where most bins do not fill up, only the least filled
bin of each island is dealt once more.  Deals go by a piece's stored number, so
rows that repeat an id or have none are dealt like others.  An island's size is a parameter, so no task grows
with the input, and no piece is dropped.

Defined cases: a null or empty text is one piece that holds the end id alone;
repeated rows, also of one id, are pieces of their own; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import file_bytes, freeing, library_ids, slices, stored

ISLAND = 4096      # pieces in one deal
ISLANDS = 2        # populations that evolve each deal before they meet
SETTLED = 0.995    # a bin filled to this share is not dealt again
POPULATION, GENERATIONS = 6, 24
SLICE = 3 << 20    # bytes of text encoded at a time: a worker's arrays take some twenty times as much
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, uid) of every text's pieces; ``uid`` is a number, to be stored."""
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        encode, uid = library_ids(tokenizer_path, data.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows in slices(batch, 1, size=SLICE):
                ids, lens = encode.batch(rows.column(1))
                stops = np.cumsum(lens)
                raw = np.insert(ids, stops, end_id).astype("<u4").tobytes()     # the end id after each text
                stops, a, out = 4 * (stops + np.arange(1, len(lens) + 1)), 0, []
                for d, b in zip(rows.column(0).to_pylist(), stops.tolist()):
                    for i, at in enumerate(range(a, b, 4 * capacity)):
                        to = min(b, at + 4 * capacity)
                        out.append((d, i, (at - a) // 4, (to - at) // 4, zlib.crc32(raw[at:to])))
                    a = b
                yield pa.record_batch([*[pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    pa.array(np.arange(uid, uid + len(out)))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
                uid += len(out)
        encode.trim()

    return src.mapInArrow(freeing(run, encodes=True), PIECE)


# ----------------------------------------------------------- one population

def best_fit(bins: list[list[int]], items: list[int], size: list[int], capacity: int) -> list[list[int]]:
    """Put ``items``, largest first, each where the least room stays."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-size[i], i)):
        at = bisect_left(room, (size[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
            insort(room, (left - size[i], k))
        else:
            bins.append([i])
            insort(room, (capacity - size[i], len(bins) - 1))
    return bins


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> float:
    """Falkenauer's measure: the mean square of the bins' fill."""
    return sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rnd: random.Random
              ) -> list[list[int]]:
    """Inject well-filled bins of ``b`` into ``a``; best-fit what that displaces."""
    full = sorted(b, key=lambda x: -sum(size[i] for i in x))
    pick = full[:max(1, len(full) // 2)]
    pick = [x for x in pick if rnd.random() < 0.5] or pick[:1]
    moved = {i for x in pick for i in x}
    keep = [x for x in a if moved.isdisjoint(x)]
    left = [i for x in a if not moved.isdisjoint(x) for i in x if i not in moved]
    # the emptiest bins are opened too, or best fit would have nothing to mend
    keep.sort(key=lambda x: -sum(size[i] for i in x))
    opened = keep[len(keep) - max(1, len(keep) // 20):] if keep else []
    left += [i for x in opened for i in x]
    return best_fit(keep[:len(keep) - len(opened)] + pick, left, size, capacity)


def evolve(size: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = ()) -> list[list[int]]:
    """The best packing found; stops at the bound ceil(sum / capacity)."""
    rnd, least = random.Random(seed), -(-sum(size) // capacity)
    people = list(elites) or [best_fit([], list(range(len(size))), size, capacity)]
    score = lambda p: (len(p), -fitness(p, size, capacity))
    while len(people) < POPULATION and min(map(len, people)) > least:
        first = rnd.sample(range(len(size)), min(len(size), max(1, len(size) // 8)))
        rest = set(range(len(size))) - set(first)
        people.append(best_fit(best_fit([], first, size, capacity), sorted(rest), size, capacity))
    people.sort(key=score)
    for _ in range(GENERATIONS):
        if len(people[0]) <= least or len(people) < 2:
            break
        a, b = rnd.sample(people[:max(2, POPULATION // 2)], 2)
        people = sorted([*people, crossover(a, b, size, capacity, rnd)], key=score)[:POPULATION]
    return people[0]


# ------------------------------------------------------------- the islands

def pack(cut: DataFrame, capacity: int, island: int = ISLAND, islands: int = ISLANDS) -> DataFrame:
    """The rows of :func:`pieces` with sequence_id and offset instead of uid.

    ``cut`` is read once per deal, so pass a stored table.
    """
    names = [c.name for c in cut.schema]
    item = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    whole = cut.where(F.col("length") >= capacity).withColumns(
        {"_deal": F.lit(0), "_group": F.xxhash64("doc_id", "piece"), "bin": F.monotonically_increasing_id(),
         "offset": F.lit(0).cast("long")})
    settled = [whole.select(*names, "_deal", "_group", "bin", "offset")]
    todo, deal = cut.where(F.col("length") < capacity), 0
    n, last = todo.count(), False
    while n:
        deal += 1
        groups = -(-n // island)
        dealt = todo.withColumn("_group", F.pmod(F.xxhash64("uid", F.lit(deal)), F.lit(groups)))
        first = (dealt.withColumn("_island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
                 .groupBy("_group", "_island").applyInPandas(
                     lambda p: _first(p, capacity), f"{item}, _group long, _island int, bin long"))
        met = stored(first.groupBy("_group").applyInPandas(
            lambda p: _meet(p, capacity, names),
            f"{item}, _group long, bin long, offset long, fill double, least boolean"), "packed")
        last = last or groups == 1
        done, todo = (met, None) if last else (met.where(F.col("fill") >= SETTLED), met.where(F.col("fill") < SETTLED))
        left = 0 if last else todo.count()
        if left > 0.7 * n:   # pieces that do not fill up: settle what this deal found, but an open bin an island
            last, done, todo = True, met.where("not least"), met.where("least")
            left = todo.count()
        settled.append(done.withColumn("_deal", F.lit(deal)).select(*names, "_deal", "_group", "bin", "offset"))
        if left:
            todo = todo.select(*names)
        n = left
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    # deal, group and bin number one sequence; full pieces are numbered by their own rows
    number = F.when(F.col("_deal") == 0, -1 - F.col("bin")).otherwise(
        F.col("_deal") * F.lit(1 << 56) + F.col("_group") * F.lit(1 << 16) + F.col("bin"))
    return out.select(*[c for c in names if c != "uid"], number.alias("sequence_id"), "offset")


def _first(p: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One island's elite: its pieces with their bin."""
    p = p.sort_values(["length", "doc_id", "piece", "ids_crc32", "uid"], kind="stable").reset_index(drop=True)
    best = evolve(p["length"].tolist(), capacity, int(p["_island"].iloc[0]) + 1)
    p["bin"] = _bins(best, len(p))
    return p


def _meet(p: pd.DataFrame, capacity: int, names: list[str]) -> pd.DataFrame:
    """The elites of a deal's islands evolve on together."""
    order = ["length", "doc_id", "piece", "ids_crc32", "uid"]
    each = [q.sort_values(order, kind="stable").reset_index(drop=True) for _, q in p.groupby("_island", sort=True)]
    size = each[0]["length"].tolist()
    elites = [[g.tolist() for g in q.groupby("bin").indices.values()] for q in each]
    best = evolve(size, capacity, 0, elites)
    out = each[0][[*names, "_group"]].copy()
    out["bin"] = _bins(best, len(out))
    out["offset"] = out.groupby("bin")["length"].cumsum() - out["length"]
    out["fill"] = out.groupby("bin")["length"].transform("sum") / capacity
    out["least"] = (out["bin"] == out.loc[out["fill"].idxmin(), "bin"]) & (out["fill"] < SETTLED)
    return out[[*names, "_group", "bin", "offset", "fill", "least"]]


def _bins(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Pieces of every text with the sequence and the place that hold them."""
    cut = stored(pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(cut, capacity)
