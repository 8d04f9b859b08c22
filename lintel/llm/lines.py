"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only (operator 8).

A line that holds a word is dropped when an earlier line (by document id, then
place) is the same, and one of at least ``min_chars`` characters also when an
earlier line of such a length is within one edit of it, judged on the input.
Equal lines of any length meet by a grouped minimum over the lines' hashes.
For the others the deletion neighbourhood is emitted in two steps, so that long
lines cost a constant number of keys:

1.  Block variants: the line with one of its blocks deleted, hashed with the
    shorter length of the two lines that it may match.  Lines within one edit
    share a variant, since the edit falls into one block.  Halves are tried
    first; lines with a partner there emit sixteenths.
2.  Character variants: lines that still have a partner emit, inside that
    block, every variant with one character deleted.  Variants equal at one
    place are mutually within one edit (a replaced character); a line equal to
    another's variant is one deletion away.  Both are grouped minima, so no
    pairs within a group are made, whatever its size.

Each line to drop is then held against its keeper by ``levenshtein`` before it
goes.  Groups of any size are combined before the shuffle.

Defined cases: blank lines stay; a null text stays null and an empty text
empty; null ids sort first; rows that repeat an id and a text share one decision (they are one
document, so neither is earlier); a text all of whose lines go becomes empty;
an empty table gives an empty result; other columns, whatever their names, are
handed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import small, stored

MIN_CHARS = 24      # of lines that one edit may change; in shorter ones it makes another word
WORD = r"[^\x20\x09-\x0D]"
BLOCKS = 16


def _variants(blocks: int) -> Column:
    """Block variants of ``line``: (m, j, a, b, key); [a, b) is the deleted block."""
    n = F.char_length("line")

    def one(back: int):
        def at(j: Column) -> Column:
            m = n - back
            a = F.floor(j * m / blocks).cast("int")
            b = F.floor((j + 1) * m / blocks).cast("int") + back
            key = F.xxhash64(m, j, F.substr("line", F.lit(1), a), F.substr("line", b + 1))
            return F.struct(m.alias("m"), j.alias("j"), a.alias("a"), b.alias("b"), key.alias("key"))
        return at

    places = F.sequence(F.lit(0), F.lit(blocks - 1))
    return F.concat(F.transform(places, one(0)), F.transform(places, one(1)))


def _halves() -> list[Column]:
    """Keys of the line with one half deleted, for both lengths that a partner may make the shorter."""
    out = []
    for back in (0, 1):
        m = F.char_length("line") - back
        h = F.shiftright(m, 1)
        out += [F.xxhash64(m, F.lit(0), F.substr("line", F.lit(1), h)),
                F.xxhash64(m, F.lit(1), F.substr("line", h + back + 1))]
    return out


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(at (doc, th, pos), h1, h2, halves) of every line with a word; the text stays behind.

    ``halves`` is NULL for lines that only exact copies may drop.
    """
    text = F.col(text_col)
    halves = F.when(F.char_length("line") >= min_chars, F.array(*_halves()))
    return (docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"),
                        F.posexplode(F.split(text, "\n")).alias("pos", "line"))
            .where(F.col("line").rlike(WORD))
            .select(F.struct("doc", "th", "pos").alias("at"), F.xxhash64("line").alias("h1"),
                    F.hash("line").alias("h2"), halves.alias("halves")))


def _shared(emitted: DataFrame) -> DataFrame:
    """The rows whose ``key`` another line has too."""
    met = emitted.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    return emitted.join(met, "key", "left_semi")


def _texts(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``places`` (h1, h2, at) with their line; only the documents named there are split."""
    by_doc = stored(places.groupBy(F.col("at.doc").alias("w_doc"), F.col("at.th").alias("w_th")).agg(
        F.collect_list(F.struct("h1", "h2", "at")).alias("wanted")), "wanted")   # of one text, so bounded by it
    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    met = d.join(small(by_doc, 32 + 64 * F.size("wanted")), d["doc"].eqNullSafe(by_doc["w_doc"]) & (d["th"] == by_doc["w_th"]))
    return (met.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
            .select("w.*", F.element_at("lines", F.col("w.at.pos") + 1).alias("line"))
            .dropDuplicates(["h1", "h2"]))      # rows may repeat


def near_lines(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2) of the lines that have an earlier line within one edit.

    ``lines`` is the stored result of :func:`_lines`.
    """
    one = lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("halves").alias("halves"))
    half = _shared(one.select("h1", "h2", "at", F.explode("halves").alias("key")))
    places = half.groupBy("h1", "h2").agg(F.min("at").alias("at"))
    some = stored(_texts(docs, places, id_col, text_col), "lines")
    tight = some.select("*", F.explode(_variants(BLOCKS)).alias("v")).withColumn("key", F.col("v.key"))
    tight = stored(_shared(tight).select("h1", "h2", "at", "line", "v"), "variants")
    n, block = F.char_length("line"), F.substr("line", F.col("v.a") + 1, F.col("v.b") - F.col("v.a"))
    size = F.col("v.b") - F.col("v.a")
    cut = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.struct(
        i.alias("i"), F.xxhash64(F.concat(F.substr(F.col("block"), F.lit(1), i - 1),
                                          F.substr(F.col("block"), i + 1))).alias("x")))
    rows = tight.select("h1", "h2", "at", F.col("v.key").alias("k"), (F.col("v.m") == n).alias("own"),
                        block.alias("block"), size.alias("size"))
    one = rows.where("size > 0").select("h1", "h2", "at", "k", "own", F.explode(cut).alias("c"))
    # a replaced character: variants without the same place, of lines of one length
    same = one.where("own").select("h1", "h2", "at", "k", F.col("c.i").alias("i"), F.col("c.x").alias("x"),
                                   F.lit(True).alias("longer"))
    # a missing character: a line, and the longer lines' variants equal to it
    self = rows.where("own").select("h1", "h2", "at", "k", F.lit(0).alias("i"),
                                    F.xxhash64("block").alias("x"), F.lit(False).alias("longer"))
    longer = one.where("not own").select("h1", "h2", "at", "k", F.lit(0).alias("i"), F.col("c.x").alias("x"),
                                         F.lit(True).alias("longer"))
    every = same.unionByName(self).unionByName(longer)
    who = F.struct("at", "h1", "h2")
    low = every.groupBy("k", "i", "x").agg(
        F.min(F.when(F.col("longer"), who)).alias("of_longer"), F.min(F.when(~F.col("longer"), who)).alias("of_self"))
    met = every.join(low.where("of_self is not null or i > 0"), ["k", "i", "x"])
    # i > 0: the earliest of the group; i = 0: of the other kind
    keeper = F.when((F.col("i") > 0) | ~F.col("longer"), F.col("of_longer")).otherwise(F.col("of_self"))
    pair = (met.withColumn("keeper", keeper).where("keeper.at < at")
            .groupBy("h1", "h2").agg(F.min("keeper").alias("keeper"))
            .select("h1", "h2", F.col("keeper.h1").alias("k1"), F.col("keeper.h2").alias("k2")))
    kept = some.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("line").alias("earlier"))
    return (pair.join(some.select("h1", "h2", "line"), ["h1", "h2"]).join(kept, ["k1", "k2"])
            .where(F.levenshtein("line", "earlier", 1) >= 0).select("h1", "h2"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
                  ) -> DataFrame:
    """(doc, th, dropped): the places of the lines to drop, a row per document that has any."""
    lines = stored(_lines(docs, id_col, text_col, min_chars), "lines")
    near = near_lines(docs, lines, id_col, text_col).withColumn("near", F.lit(True))
    seen = (lines.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
            .join(near, ["h1", "h2"], "left").where("near or first <> last"))
    gone = stored(lines.select("at", "h1", "h2").join(seen, ["h1", "h2"])
                  .where("coalesce(near, false) or at <> first").select("at.*"), "gone")
    return gone.groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                counts: bool = False) -> DataFrame:
    """``docs`` with the repeated lines gone from its texts.

    With ``counts``, columns ``n_lines`` and ``n_dropped`` follow.
    """
    gone = stored(dropped_lines(docs, id_col, text_col, min_chars), "dropped")
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("doc"),
                    F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("th"))
    g = small(gone.select(F.col("doc").alias("g_doc"), F.col("th").alias("g_th"), "dropped"),
               40 + 4 * F.size("dropped"))
    j = d.join(g, d["doc"].eqNullSafe(g["g_doc"]) & (d["th"] == g["g_th"]), "left")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x, i: ~F.array_contains("dropped", i))
    new = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = [new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    if counts:
        out += [F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped")]
    return j.select(*out)
