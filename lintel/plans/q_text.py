"""Steps 6-8: keyword screening and evaluation, cleaning, TF-IDF, scoring,
label selection and vectors over the driver's document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import columns as C
from lintel.functions.columns import KW_WORD, PY_SPACE, PY_WORD
from lintel.operators import checks, nearest, needles, rollups, text, vectors
from lintel.plans.common import SQL_FACT_A_CLEAN, fact_a_clean, r4, tables
from lintel.plans.oracle_views import with_views
from lintel.plans.registry import register
from lintel.session import scratch_path
from lintel.sources import views
from lintel.sources.keywords import BASIC_KEYWORDS, FACT_KEYWORDS, document_keywords, stopwords

DOC_KW = document_keywords()
FACT_TEXT = ["project_title", "short_description", "long_description"]


# ------------------------------------------------------------- SQL helpers

def _esc(w: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\" else ch for ch in w).replace("'", "''")


def sql_kw_regex(words) -> str:
    alt = "|".join(_esc(w) for w in text.clean_keywords(words))
    return f"'(^|[^{KW_WORD}])({alt})($|[^{KW_WORD}])'"


def sql_kw_values(words) -> str:
    vals = ", ".join(f"('{w.replace(chr(39), chr(39) * 2)}', '{_esc(w)}')" for w in text.clean_keywords(words))
    return f"kw AS (SELECT * FROM (VALUES {vals}) v(word, pat))"


SQL_KW_MATCH = f"regexp_matches(lower(@col), '(^|[^{KW_WORD}])' || kw.pat || '($|[^{KW_WORD}])')"


def sql_normalize(expr: str) -> str:
    s = f"regexp_replace({expr}, '[^{PY_WORD}{PY_SPACE}]', ' ', 'g')"
    s = f"lower(trim(regexp_replace({s}, '[{PY_SPACE}]+', ' ', 'g')))"
    return f"nullif({s}, '')"


def sql_stop_cte() -> str:
    vals = ", ".join("('" + w.replace("'", "''") + "')" for w in stopwords())
    return f"stop AS (SELECT * FROM (VALUES {vals}) v(w))"


def sql_clean_ctes(src: str, text_expr: str, extra_cols: str = "") -> list[str]:
    """CTEs ``cl`` (doc_id, clean) and ``stripped`` (doc_id, t[, extra])."""
    return [
        sql_stop_cte(),
        f"cl AS (SELECT doc_id{extra_cols}, {sql_normalize(text_expr)} AS clean FROM {src})",
        """tok AS (SELECT doc_id, unnest(string_split(coalesce(clean, ''), ' ')) AS w,
                      unnest(range(1, len(string_split(coalesce(clean, ''), ' ')) + 1)) AS pos FROM cl)""",
        f"""stripped AS (
  SELECT cl.doc_id{extra_cols.replace(', ', ', cl.')}, coalesce(s.t, '') AS t FROM cl LEFT JOIN (
    SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t FROM tok
    WHERE w <> '' AND w NOT IN (SELECT w FROM stop) GROUP BY doc_id) s ON cl.doc_id = s.doc_id)""",
    ]


# --------------------------------------------------------------- screening

@register("keyword_screen", ("T1",), f"""
SELECT doc_id FROM documents
WHERE regexp_matches(lower(text), {sql_kw_regex(DOC_KW)})
   OR regexp_matches(lower(source), {sql_kw_regex(DOC_KW)})""")
def keyword_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text or source contains any keyword as whole words."""
    d = tables(spark, sf_dir).documents
    return text.screen(d, ["text", "source"], DOC_KW).select("doc_id")


@register("keyword_screen_fact", ("T1", "P16", "A1"), with_views("fact_a", extra=[SQL_FACT_A_CLEAN]) + f"""
SELECT year, count(*) AS n, round(coalesce(sum(usd_disbursement_deflated), 0), 4) AS usd_disbursement_deflated
FROM fact_a_clean
WHERE coalesce(regexp_matches(lower(project_title), {sql_kw_regex(FACT_KEYWORDS)}), false)
   OR coalesce(regexp_matches(lower(short_description), {sql_kw_regex(FACT_KEYWORDS)}), false)
   OR coalesce(regexp_matches(lower(long_description), {sql_kw_regex(FACT_KEYWORDS)}), false)
GROUP BY year""")
def keyword_screen_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword definition on fact A: rows whose title, short or long
    description holds a keyword (NULL descriptions simply do not match)."""
    fa = text.screen(fact_a_clean(tables(spark, sf_dir)), FACT_TEXT, FACT_KEYWORDS)
    return fa.groupBy("year").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                  r4(rollups.zero_sum("usd_disbursement_deflated")).alias("usd_disbursement_deflated"))


@register("keyword_hits", ("T2",), "WITH " + sql_kw_values(DOC_KW) + f"""
SELECT DISTINCT d.doc_id, kw.word FROM documents d, kw WHERE {SQL_KW_MATCH.replace('@col', 'd.text')}""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables(spark, sf_dir).documents
    return text.hit_table(d, "doc_id", ["text"], DOC_KW)


@register("keyword_eval", ("P9", "T3", "A8"), with_views("texts", extra=[sql_kw_values(DOC_KW)]) + f"""
SELECT kw.word, count(*) AS n, round(avg(CAST(t.false_positive AS DOUBLE)), 6) AS false_positive_rate
FROM texts t, kw WHERE {SQL_KW_MATCH.replace('@col', 't.text')}
GROUP BY kw.word""")
def keyword_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per keyword: documents matched and their false-positive rate."""
    ev = text.evaluate(views.texts(tables(spark, sf_dir)), "doc_id", ["text"], DOC_KW, "false_positive")
    return ev.select("word", "n", F.round("false_positive_rate", 6).alias("false_positive_rate"))


@register("false_positive_overall", ("P9", "A8"), with_views("texts") + """
SELECT count(*) AS n, round(avg(CAST(false_positive AS DOUBLE)), 6) AS false_positive_rate FROM texts""")
def false_positive_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.texts(tables(spark, sf_dir))
    return t.agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.round(F.avg(F.col("false_positive").cast("double")), 6).alias("false_positive_rate"))


@register("any_substring", ("T4",), f"""
SELECT doc_id FROM documents
WHERE {" OR ".join(f"coalesce(contains(text, '{w}'), false)" for w in BASIC_KEYWORDS)}""")
def any_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables(spark, sf_dir).documents
    return d.filter(text.contains_any("text", BASIC_KEYWORDS)).select("doc_id")


# The words that a benchmark passage may be recognised by have at least so many letters.
NEEDLE_LETTERS = 5


@register("needle_hits", ("T4",), f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\pL{{{NEEDLE_LETTERS},}}')) AS w FROM benchmark)
SELECT d.doc_id, count(*) AS n_needles, string_agg(w.w, ' ' ORDER BY w.w) AS needles
FROM documents d JOIN w ON contains(d.text, w.w) GROUP BY d.doc_id""")
def needle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every longer word of the benchmark passages as a needle: which of them each document holds, also inside words."""
    t = tables(spark, sf_dir)
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(rf"\pL{{{NEEDLE_LETTERS},}}"), 0)).alias("w"))
    found = needles.needle_hits(t.documents, "doc_id", "text", needles.stated(words, "w"))
    return found.select("doc_id", F.size("needles").cast("long").alias("n_needles"),
                        F.array_join("needles", " ").alias("needles"))


# ---------------------------------------------------------------- cleaning

@register("text_concat_clean", ("P16", "P17"), f"""
SELECT doc_id, {sql_normalize("concat_ws(' ', text, source)")} AS text_clean FROM documents""")
def text_concat_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables(spark, sf_dir).documents
    return d.select("doc_id", text.clean_text("text", "source").alias("text_clean"))


@register("stopword_strip", ("P17", "P18"),
          "WITH " + ",\n".join(sql_clean_ctes("documents", "text")) + """
SELECT doc_id, t AS text_stripped FROM stripped""")
def stopword_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables(spark, sf_dir).documents
    return d.select("doc_id", text.clean_text("text", stopwords=stopwords()).alias("text_stripped"))


def _cleaned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    lab = t.labels.select("doc_id", (F.col("quality") == 1).alias("_q"))
    d = t.documents.join(lab, "doc_id", "left")
    return d.select("doc_id", text.clean_text("text", stopwords=stopwords()).alias("t"),
                    F.coalesce("_q", F.lit(False)).alias("positive"))


@register("distinct_texts", ("A6", "T6", "Q5"),
          "WITH " + ",\n".join(sql_clean_ctes("documents", "text")) + """
SELECT (SELECT count(*) FROM stripped) AS rows_before,
       (SELECT count(*) FROM (SELECT DISTINCT t FROM stripped)) AS rows_after""")
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cleaned_docs(spark, sf_dir)
    return checks.counts_before_after(c, c.select("t").distinct())


def _tfidf_sql(n: int, joined: bool = False) -> str:
    ctes = sql_clean_ctes("(SELECT d.*, coalesce(l.quality = 1, false) AS pos FROM documents d "
                          "LEFT JOIN labels l ON d.doc_id = l.doc_id)", "text", ", pos")
    if n == 1:
        grams = "list_filter(string_split(t, ' '), lambda x: length(x) >= 2)"
    else:
        grams = ("list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])")
    across = " UNION ALL SELECT term FROM across WHERE term IS NOT NULL" if joined else ""
    return "WITH " + ",\n".join(ctes) + f""",
dd AS (SELECT t, bool_or(pos) AS pos, min(doc_id) AS o FROM stripped GROUP BY t),
tk0 AS (SELECT t, pos, o, list_filter(string_split(t, ' '), lambda x: length(x) >= 2) AS tk FROM dd),
g AS (SELECT t, pos, {grams if n == 1 else grams} AS gr FROM tk0),
across AS (SELECT tk[len(tk)] || ' ' || lead(tk[1]) OVER (ORDER BY o) AS term FROM tk0 WHERE pos AND len(tk) > 0),
nd AS (SELECT count(*) AS n FROM dd),
dfq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT t, unnest(gr) AS term FROM g) GROUP BY term),
tfq AS (SELECT term, count(*) AS tf FROM (SELECT unnest(gr) AS term FROM g WHERE pos{across}) GROUP BY term),
sc AS (SELECT tfq.term, tf * (ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1) AS s
       FROM tfq JOIN dfq ON tfq.term = dfq.term, nd),
z AS (SELECT sqrt(sum(s * s)) AS z FROM sc),
top AS (SELECT term, s / z AS score FROM sc, z ORDER BY score DESC, term LIMIT 250)
SELECT CAST(row_number() OVER (ORDER BY score DESC, term) AS INTEGER) AS rank, term, round(score, 6) AS score
FROM top"""


def _tfidf(spark: SparkSession, sf_dir: str, n: int, joined: bool = False) -> DataFrame:
    c = _cleaned_docs(spark, sf_dir)
    own = [F.max("positive").alias("positive")] + ([F.min("doc_id").alias("o")] if joined else [])
    out = text.tfidf_terms(c.groupBy("t").agg(*own), "t", "positive", n=n, k=250, joined_by="o" if joined else None)
    return out.select("rank", "term", F.round("score", 6).alias("score"))


@register("tfidf_unigrams", ("T5", "T6", "A13", "O2"), _tfidf_sql(1))
def tfidf_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 250 single words of the positive documents (quality = 1)."""
    return _tfidf(spark, sf_dir, 1)


@register("tfidf_bigrams", ("T5", "T6", "A13", "O2"), _tfidf_sql(2))
def tfidf_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 250 adjacent word pairs (within one document)."""
    return _tfidf(spark, sf_dir, 2)


@register("tfidf_bigrams_joined", ("T5", "T6", "A13", "O2"), _tfidf_sql(2, joined=True))
def tfidf_bigrams_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 250 word pairs of the positive documents joined to one text in
    order of id: pairs across two documents count where a document holds them."""
    return _tfidf(spark, sf_dir, 2, joined=True)


# The scorer's label that marks a text as "about something else" (P9).
FALSE_POSITIVE_LABEL = "short"


@register("scored_keyword_eval", ("T1", "T8", "J10", "P9", "T3", "A8"), "WITH " + sql_kw_values(DOC_KW) + f""",
scored AS (
  SELECT doc_id, text,
         starts_with(CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END, '{FALSE_POSITIVE_LABEL}')
           AS false_positive
  FROM documents WHERE text IS NOT NULL
)
SELECT kw.word, count(*) AS n, round(avg(CAST(s.false_positive AS DOUBLE)), 6) AS false_positive_rate
FROM scored s, kw WHERE {SQL_KW_MATCH.replace('@col', 's.text')}
GROUP BY kw.word""")
def scored_keyword_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword-definition chain: score each distinct text once, flag
    rows whose label marks them as off-topic, then evaluate every keyword
    (rows matched and their false-positive rate)."""
    d = tables(spark, sf_dir).documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    scores = text.score_distinct(d, "text", text.length_scorer)
    scored = text.join_back(d, "text", scores)
    flagged = scored.withColumn("false_positive", C.flag_from_label("zs_label", FALSE_POSITIVE_LABEL))
    ev = text.evaluate(flagged, "doc_id", ["text"], DOC_KW, "false_positive")
    return ev.select("word", "n", F.round("false_positive_rate", 6).alias("false_positive_rate"))


# ------------------------------------------------------- scoring and labels

@register("score_distinct_join_back", ("T8", "J10"), """
SELECT doc_id,
       CASE WHEN text IS NULL THEN NULL WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS zs_label,
       round(length(text) / (length(text) + 1000.0), 6) AS zs_score
FROM documents""")
def score_distinct_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every distinct document text once (pluggable pandas scorer) and
    join the scores back onto all documents."""
    d = tables(spark, sf_dir).documents
    scores = text.score_distinct(d, "text", text.length_scorer)
    out = text.join_back(d.select("doc_id", "text"), "text", scores)
    return out.select("doc_id", "zs_label", F.round("zs_score", 6).alias("zs_score"))


@register("best_label", ("T9",), """
WITH e AS (SELECT vec_id, unnest(embedding) AS s, unnest(range(0, len(embedding))) AS idx FROM embeddings)
SELECT vec_id, first(idx ORDER BY CAST(s AS DOUBLE) DESC, idx) AS best_label,
       max(CAST(s AS DOUBLE)) AS best_score
FROM e GROUP BY vec_id""")
def best_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector, the component (candidate label) with the highest score;
    all candidates of a vector are in its row, so this is row-local."""
    e = tables(spark, sf_dir).embeddings
    b = text.best_in_array("embedding")
    return e.select("vec_id", b["best_label"].alias("best_label"), b["best_score"].alias("best_score"))


# ----------------------------------------------------------------- vectors

def _query_vector(e: DataFrame) -> DataFrame:
    """One row: the vector with id 0 (the least, if several)."""
    return e.filter(F.col("vec_id") == 0).agg(F.min("embedding").alias("query"))


@register("similarity_topk", ("T7", "J11", "O2"), """
WITH q AS (SELECT CAST(min(embedding) AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), q.q), 6) AS score
FROM embeddings, q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), q.q) DESC, vec_id LIMIT 20""")
def similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors closest (dot product) to the vector with id 0."""
    e = tables(spark, sf_dir).embeddings
    out = vectors.rank_by_similarity(e, "embedding", _query_vector(e), "query", k=20, tie_key="vec_id")
    return out.select("vec_id", "label", F.round("score", 6).alias("score"))


def _topk_sql(queries: str) -> str:
    return f"""
WITH q AS ({queries}),
s AS (SELECT query, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), q.v) AS s FROM embeddings, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query, rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 20"""


def _top20(e: DataFrame, queries: DataFrame) -> DataFrame:
    return nearest.top_k_many(e, "embedding", "vec_id", queries, 20).select(
        F.col("query").cast(queries.schema["query"].dataType).alias("query"), "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@register("similarity_topk_many", ("T7", "O2"), _topk_sql(
    "SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0"))
def similarity_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors closest (dot product) to each vector whose id is divisible by 50, among all vectors."""
    e = tables(spark, sf_dir).embeddings
    return _top20(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")))


@register("similarity_topk_labels", ("T7", "A2", "O2"), _topk_sql("""
  SELECT label AS query, list(m ORDER BY pos) AS v FROM (
    SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS m FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings WHERE label IS NOT NULL)
    GROUP BY label, pos) GROUP BY label"""))
def similarity_topk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors closest (dot product) to the mean vector of each label."""
    e = tables(spark, sf_dir).embeddings
    return _top20(e, nearest.group_means(e, "embedding", "label"))


@register("similarity_scores", ("T7", "J11"), """
WITH q AS (SELECT CAST(min(embedding) AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), q.q), 6) AS score FROM embeddings, q""")
def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's similarity (dot product) to the vector with id 0."""
    e = tables(spark, sf_dir).embeddings
    out = vectors.rank_by_similarity(e, "embedding", _query_vector(e), "query")
    return out.select("vec_id", "label", F.round("score", 6).alias("score"))


@register("vector_cache_increment", ("S8", "S5"), """
WITH b AS (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL
      AND sha256(text) NOT IN (SELECT sha256(text) FROM b)),
u AS (SELECT text, true AS from_cache FROM b UNION ALL SELECT text, false FROM d)
SELECT sha256(text) AS text_key, CAST(length(text) AS DOUBLE) AS n_chars,
       CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words,
       CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines, from_cache
FROM u""")
def vector_cache_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build a vector cache from the benchmark passages, then add only the
    document texts it does not hold yet (left anti join on the text hash)."""
    t = tables(spark, sf_dir)
    path = scratch_path(spark, "vector_cache")
    vectors.cache_vectors(t.benchmark, "text", path, vectors.shape_encoder, vectors.SHAPE_SCHEMA)
    vectors.cache_vectors(t.documents, "text", path, vectors.shape_encoder, vectors.SHAPE_SCHEMA)
    c = spark.read.parquet(path)
    return c.select("text_key", "n_chars", "n_words", "n_lines",
                    (F.col("batch") == F.lit(0)).alias("from_cache"))
