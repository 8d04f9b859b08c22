"""Text mining as Spark plans (T-series).

Keyword matching works on whole words, case-insensitively, with Unicode
word characters (letters, marks, numbers, underscore).  A keyword of one to
three words matches where the lowered text holds exactly that word sequence
separated by single spaces and bounded by non-word characters or the ends —
the semantics of ``(^|\\W)kw($|\\W)`` with Unicode ``\\W``.

Instead of one regex alternation per keyword (cost grows with the list), each
text is cut into tokens once and its 1..n-grams are looked up in the keyword
set; ``x IN (...)`` on a literal list is planned as a hash set, so the cost
is linear in the text and flat in the list size.  All of it is row-local: no
shuffle is needed to find the hits of a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.functions.columns import KW_WORD, col_, normalize_text, strip_stopwords
from lintel.operators.joins import attach_scalars
from lintel.session import written

SEP = "\u0001"  # encloses a run of non-word, non-space characters
SUBSTRINGS = 32  # keywords up to which a text is searched for each of them before it is cut


def clean_keywords(words: Sequence[str]) -> list[str]:
    """Lower-cased distinct keywords (duplicates across languages collapse)."""
    return sorted({w.strip().lower() for w in words if w and w.strip()})


def token_keywords(words: Sequence[str]) -> list[str]:
    """Keywords in the form in which :func:`tokens` leaves them in a text, so
    ``low-cost`` is found where the text has that very run of punctuation."""
    runs = regex.compile(f"[^{KW_WORD} ]+")
    return sorted({runs.sub(f" {SEP}\\g<0>{SEP} ", w).strip(" ") for w in clean_keywords(words)})


def _as_written(grams: Column, kws: list[str]) -> Column:
    """Found grams as the keywords they stand for."""
    if not any(SEP in w for w in kws):
        return grams
    return F.transform(grams, lambda g: F.regexp_replace(g, f" ?{SEP}([^{SEP}]*){SEP} ?", "$1"))


def max_words(words: Sequence[str]) -> int:
    return max(len(w.split(" ")) for w in words)


def tokens(c: str | Column) -> Column:
    """Lowered text as tokens; a run of non-word, non-space characters
    becomes a token of its own, so an n-gram of words never spans it, and
    repeated spaces leave empty tokens, so only single-spaced words are adjacent."""
    s = F.regexp_replace(F.lower(col_(c)), f"([^{KW_WORD} ]+)", f" {SEP}$1{SEP} ")
    return F.split(s, " ")


def _gram_structs(t: Column, n: int) -> Column:
    """``array<struct<g1..gn>>``: token i with its next n-1 tokens (NULL
    past the end).  Built from shifted copies of the token array so that the
    lambdas below see one element at a time and never re-evaluate the text."""
    shifted = [t.alias("g1")] + [F.slice(t, k, F.greatest(F.size(t) - (k - 1), F.lit(1))).alias(f"g{k}")
                                  for k in range(2, n + 1)]
    return F.arrays_zip(*shifted)


def _grams_of(z: Column, n: int, kws: list[str]) -> list[Column]:
    """The 1..n-grams starting at one zipped element.  A k-gram is only built
    when the token starts some k-word keyword (a hash-set test), so most
    positions cost one lookup and no string building; NULL otherwise."""
    out = [z["g1"]]
    for k in range(2, n + 1):
        firsts = sorted({w.split(" ")[0] for w in kws if len(w.split(" ")) == k})
        if not firsts:
            continue
        parts = []
        for j in range(1, k + 1):
            parts += [z[f"g{j}"], F.lit(" ")]
        out.append(F.when(z["g1"].isin(firsts), F.concat(*parts[:-1])))
    return out


def _match_tokens(t: Column, kws: list[str], n: int) -> Column:
    z = _gram_structs(t, n)
    return F.coalesce(F.exists(z, lambda x: _any_in(_grams_of(x, n, kws), kws)), F.lit(False))


def _hits_tokens(t: Column, kws: list[str], n: int) -> Column:
    z = _gram_structs(t, n)
    grams = F.flatten(F.transform(z, lambda x: F.array(*_grams_of(x, n, kws))))
    return F.array_sort(F.array_distinct(F.filter(grams, lambda g: F.coalesce(g.isin(kws), F.lit(False)))))


def keyword_match(cols: Sequence[str | Column], words: Sequence[str]) -> Column:
    """T1 predicate as a single column expression (for ad-hoc use; the
    DataFrame form :func:`screen` tokenises each text only once)."""
    kws = token_keywords(words)
    n = max_words(kws)
    cond: Column | None = None
    for c in cols:
        e = _match_tokens(tokens(c), kws, n)
        cond = e if cond is None else cond | e
    return cond


def _any_in(grams: list[Column], kws: list[str]) -> Column:
    out = F.coalesce(grams[0].isin(kws), F.lit(False))
    for g in grams[1:]:
        out = out | F.coalesce(g.isin(kws), F.lit(False))
    return out


def keyword_hits(c: str | Column, words: Sequence[str]) -> Column:
    """T2 column: distinct keywords found in ``c`` (overlapping keywords all
    count; a keyword found twice counts once)."""
    kws = token_keywords(words)
    return _as_written(_hits_tokens(tokens(c), kws, max_words(kws)), kws)


def _with_tokens(df: DataFrame, texts: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Tokenise each text once.  The tokens are produced by a generator (one
    output row per input row), so the optimiser cannot inline the regex back
    into every use, nor push the keyword test below a repartition that
    spreads the text work over the cluster."""
    toks = F.struct(*[tokens(t).alias(nm) for t, nm in zip(texts, names)])
    return df.select("*", F.inline(F.array(toks)))


def screen(df: DataFrame, cols: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Rows whose text columns contain any keyword.

    A text that matches holds the keyword letter by letter, so with a short
    list only texts that hold one as a substring are cut into tokens."""
    kws = token_keywords(words)
    n = max_words(kws)
    names = [f"_tok{i}" for i in range(len(cols))]
    texts = [F.col(c) for c in cols]
    if len(kws) <= SUBSTRINGS:
        has = [contains_any(F.lower(c), clean_keywords(words)) for c in texts]
        df = df.filter(reduce(or_, has))
        texts = [F.when(h, c) for h, c in zip(has, texts)]
    staged = _with_tokens(df, texts, names)
    cond = None
    for nm in names:
        e = _match_tokens(F.col(nm), kws, n)
        cond = e if cond is None else cond | e
    return staged.filter(cond).drop(*names)


def hit_table(df: DataFrame, id_col: str, text_cols: Sequence[str], words: Sequence[str],
              keep: Sequence[str] = ()) -> DataFrame:
    """Long ``(id, word, *keep)`` table, one row per row and keyword found
    in the space-joined text columns."""
    kws = token_keywords(words)
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols])
    staged = _with_tokens(df.select(id_col, *keep, *text_cols), [text], ["_tok"])
    return staged.select(id_col, *keep, F.explode(_as_written(_hits_tokens(F.col("_tok"), kws, max_words(kws)), kws)).alias("word"))


def evaluate(df: DataFrame, id_col: str, text_cols: Sequence[str], words: Sequence[str],
             flag: str) -> DataFrame:
    """Per keyword, rows matched (``n``) and the mean of ``flag`` over
    them (``false_positive_rate``); keywords with no hit are absent.

    One row-local explode, then one aggregate by word with a map-side
    partial step, so a very common keyword is combined before the shuffle."""
    hits = hit_table(df, id_col, text_cols, words, keep=[flag])
    return hits.groupBy("word").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg(F.col(flag).cast("double")).alias("false_positive_rate"))


def contains_any(c: str | Column, needles: Sequence[str]) -> Column:
    """T4: plain substring test against a few needles."""
    c = col_(c)
    out = F.lit(False)
    for s in needles:
        out = out | F.coalesce(F.contains(c, F.lit(s)), F.lit(False))
    return out


def clean_text(*cols: str | Column, stopwords: Sequence[str] | None = None) -> Column:
    """P16 + P17 (+ P18): join columns, normalise, optionally drop stop words."""
    t = normalize_text(F.concat_ws(" ", *[col_(c) for c in cols]))
    if stopwords is not None:
        t = strip_stopwords(t, stopwords)
    return t


def text_key(c: str | Column) -> Column:
    """Stable key of a text (hex SHA-256), used to dedupe and join back."""
    return F.sha2(col_(c), 256)


# ---------------------------------------------------------------- TF-IDF (T5)

def next_in_order(rows: DataFrame, order: Sequence[str], value: str, into: str) -> DataFrame:
    """``rows`` with ``value`` of the next row in the global order of ``order`` (NULL in the last).

    No task sees all rows: ranges of the order are stored with their number,
    each range finds its own neighbours, and its last row takes the first value
    of the next range that has rows; that table has one row a range.  The order
    must be total for a defined result."""
    ranges = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_range", F.spark_partition_id()))
    ranges = written(ranges, "ranges")
    firsts = ranges.groupBy("_range").agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_f"))
    borders = firsts.select("_range", F.lead("_f").over(Window.orderBy("_range")).alias("_border"))
    inside = F.lead(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("_range").orderBy(*order))
    return (ranges.withColumn("_next", inside).join(F.broadcast(borders), "_range", "left")
            .withColumn(into, F.coalesce("_next", "_border")["v"]).drop("_range", "_next", "_border"))


def tfidf_terms(docs: DataFrame, text: str, positive: str, n: int = 1, k: int = 250,
                joined_by: str | None = None) -> DataFrame:
    """T5: rank the terms of the positive class by TF-IDF.

    ``docs`` holds one row per distinct cleaned text with a boolean
    ``positive``.  df counts distinct texts holding a term; tf counts term
    occurrences over all positive texts (one vector); ``idf = ln((1+N) /
    (1+df)) + 1`` (smoothed, as the common vectoriser default); scores are
    L2-normalised; ties broken by term.  Terms are words of at least two
    characters; with ``n = 2`` adjacent pairs inside one text.  With
    ``joined_by`` (a unique column) the positive texts are one text in that
    order: pairs across a border count towards tf if some text holds the pair,
    and texts without words are no border.
    """
    if joined_by is not None:
        if n != 2:
            raise ValueError("only pairs cross borders")
        docs = written(docs.select(joined_by, text, positive), "texts")      # read twice below
    # Words, pairs and sorted terms are a projection each: the next one reads
    # them several times, and a single expression would compute them each time.
    toks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda x: F.length(x) >= 2)
    each = docs.select(F.col(positive).alias("_pos"), toks.alias("_t"))
    grams = F.col("_t")
    if n != 1:
        # Pairs from the token array and its copy shifted by one (zip_with
        # pads the shorter side with NULL, which the filter drops).
        if n != 2:
            raise ValueError("n must be 1 or 2")
        nxt = F.slice(grams, 2, F.greatest(F.size(grams) - 1, F.lit(1)))
        grams = F.filter(F.zip_with(grams, nxt, lambda a, b: F.concat(a, F.lit(" "), b)),
                         lambda x: x.isNotNull())
    # One pass: sort each text's terms, flag the first of each run (that text
    # counts once towards df) and count every occurrence of a positive text
    # towards tf; then a single aggregate by term (partial per task first).
    each = each.select("_pos", F.sort_array(grams).alias("_s"))
    srt = F.col("_s")
    prev = F.concat(F.array(F.lit(None).cast("string")),
                    F.slice(srt, 1, F.greatest(F.size(srt) - 1, F.lit(0))))
    runs = F.zip_with(srt, prev, lambda x, p: F.struct(x.alias("term"), (p.isNull() | (x != p)).alias("first")))
    runs = F.filter(runs, lambda r: r["term"].isNotNull())  # zip_with pads an empty text
    # Each text also emits one row with a NULL term: its df is the number of
    # texts N, so N comes out of the same pass.
    runs = F.concat(runs, F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(True).alias("first"))))
    g = each.select("_pos", F.explode(runs).alias("_r"))
    seen = g.select(F.col("_r.term").alias("term"), F.col("_r.first").cast("long").alias("_d"),
                    F.col("_pos").cast("long").alias("_p"))
    if joined_by is not None:
        ends = (docs.where(F.col(positive)).select(F.col(joined_by).alias("_o"), toks.alias("_t")).where(F.size("_t") > 0)
                .select("_o", F.element_at("_t", 1).alias("_head"), F.element_at("_t", -1).alias("_tail")))
        across = next_in_order(ends, ["_o"], "_head", "_follow").where("_follow is not null")
        seen = seen.unionByName(across.select(F.concat("_tail", F.lit(" "), "_follow").alias("term"),
                                              F.lit(0).cast("long").alias("_d"), F.lit(1).cast("long").alias("_p")))
    counts = (seen.groupBy("term").agg(F.sum("_d").alias("_df"), F.sum("_p").alias("_tf")))
    # The positive texts' vocabulary; written once so the norm and the ranking
    # below do not both recompute the corpus pass.
    counts = written(counts.filter(F.col("term").isNull() | ((F.col("_tf") > 0) & (F.col("_df") > 0))), "terms")
    n_docs = counts.filter(F.col("term").isNull()).select(F.col("_df").alias("_n"))
    sc = attach_scalars(counts.filter(F.col("term").isNotNull()), n_docs)
    sc = sc.select("term", (F.col("_tf") * (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1)).alias("_s"))
    norm = sc.agg(F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_z"))
    top = attach_scalars(sc, norm).select("term", (F.col("_s") / F.col("_z")).alias("score"))
    top = top.orderBy(F.col("score").desc(), F.col("term")).limit(k)
    # Rank inside the k rows only (a bounded, single-partition window).
    return top.select(F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("term"))).alias("rank"),
                      "term", "score")


# ---------------------------------------------------- distinct-text scoring

Scorer = Callable[[pd.Series], pd.DataFrame]


def length_scorer(texts: pd.Series) -> pd.DataFrame:
    """Deterministic stand-in scorer: label by length, score in (0, 1)."""
    n = texts.str.len().astype("float64")
    return pd.DataFrame({"zs_label": ["long" if x > 2000 else "short" for x in n],
                         "zs_score": n / (n + 1000.0)})


BRIEF = 22            # characters under which the second stand-in scorer takes a text as off topic


def brief_scorer(texts: pd.Series) -> pd.DataFrame:
    """Deterministic stand-in scorer for titles: ``short`` under ``BRIEF`` characters."""
    n = texts.str.len().astype("float64")
    return pd.DataFrame({"zs_label": ["long" if x >= BRIEF else "short" for x in n], "zs_score": n / (n + BRIEF)})


SCORE_SCHEMA = "text_key string, zs_label string, zs_score double"


def score_distinct(df: DataFrame, text: str, scorer: Scorer = length_scorer,
                   persist: bool = True) -> DataFrame:
    """Score each distinct text once.

    Texts are keyed by hash and deduplicated with it (a hash aggregate, one
    shuffle of the distinct texts); the scorer runs on Arrow batches in ``mapInPandas``.
    The scores are checkpointed to the shared checkpoint folder, so a retry
    or a re-plan never runs the scorer twice."""
    distinct = (df.select(text_key(text).alias("text_key"), F.col(text).alias("_t"))
                .filter(F.col("_t").isNotNull())
                .distinct())

    def run(batches):
        for b in batches:
            out = scorer(b["_t"])
            out.insert(0, "text_key", b["text_key"].values)
            yield out

    scores = distinct.mapInPandas(run, SCORE_SCHEMA)
    return scores.checkpoint(eager=True) if persist else scores


def join_back(df: DataFrame, text: str, scores: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Scores back onto every row.  The text itself is not shuffled: the
    rows carry only its key into the join; a text copied onto very many rows
    (more than ``hot_rows``) is joined by broadcast instead of by shuffle."""
    from lintel.operators.joins import join_split_hot
    keyed = df.withColumn("text_key", text_key(text))
    return join_split_hot(keyed, scores, "text_key", "left", hot_rows=hot_rows).drop("text_key")


def best_in_array(scores: str | Column) -> Column:
    """T9, row-local: ``struct(best_label, best_score)`` of an array of
    candidate scores (label = position; ties go to the lowest position).
    When a row carries all its candidates, no shuffle is needed."""
    s = F.array_max(F.transform(col_(scores),
                                lambda x, i: F.struct(x.cast("double").alias("s"), (-i).alias("neg"))))
    return F.struct((-s["neg"]).cast("bigint").alias("best_label"), s["s"].alias("best_score"))


def best_label(long_scores: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """T9 on a long ``(key, label, score)`` table: per key, the highest-scoring
    label and its score (ties: smallest numeric label).  One aggregate by key
    with a map-side partial step."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(label)).alias("l"))
                 if isinstance(long_scores.schema[label].dataType, T.NumericType)
                 else F.struct(F.col(score).alias("s"), F.col(label).alias("l")))
    out = long_scores.groupBy(key).agg(best.alias("_b"))
    lab = -F.col("_b.l") if isinstance(long_scores.schema[label].dataType, T.NumericType) else F.col("_b.l")
    return out.select(key, lab.alias("best_label"), F.col("_b.s").alias("best_score"))
