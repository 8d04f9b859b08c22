"""The operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import (bpe, codes, html, jaccard, langid, lines, packing, quality, seeds, suffix, vectors,
                        wavelet, whiten)
from lintel.llm.common import prepare, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    """Register a query under its function's name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path, public_tokenizers.PATTERN).select(
        F.col("id").alias("doc_id"), "n_tokens", bpe.sha256("ids").alias("ids_sha256"),
        bpe.sha256("bytes").alias("decoded_sha256"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose 4-word shingle sets have Jaccard similarity 0.85 or more."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), 4, 85, 100).select(
        "doc_id", "n_shingles", "component_id")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents that are not held out; predict all."""
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return langid.predict(docs, net).withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ids to wavelet shards and read them back."""
    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte of a 100-byte string that also starts earlier."""
    return suffix.dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base features and the cascade's verdict of every document."""
    return quality.cascade(table(spark, sf_dir, "documents"), features=quality.BASE)


WORD = r"[^\x20\x09-\x0D]+"
ORACLE["op6_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
ln AS (SELECT rid, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) AS l FROM d),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM ln GROUP BY rid),
tri AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i,
               unnest(list_transform(range(1, len(w) - 1),
                                     lambda k: w[k] || chr(31) || chr(32) || w[k + 1] || chr(32) || w[k + 2])) AS g
        FROM d WHERE len(w) >= 3),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))
             AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lo,
             length(regexp_replace(t, '[^!]', '', 'g')) AS marks
      FROM d LEFT JOIN lc USING (rid) LEFT JOIN cov USING (rid)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words
            OR 100 * n_dup_lines > 50 * greatest(1, n_lines) OR up > lo OR 100 * marks > 50 * n_words) AS kept
FROM g"""


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one, long lines up to one edit."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"), counts=True).select(
        "doc_id", "n_lines", "n_dropped", "text")


def _near(a: str, b: str) -> str:
    """SQL: whether two texts are within one edit."""
    return f"""len(list_filter(range(0, length({a}) + 1), lambda i: substr({a}, 1, i) = substr({b}, 1, i) AND (
      substr({a}, i + 2) = substr({b}, i + 2) OR substr({a}, i + 2) = substr({b}, i + 1)
      OR substr({a}, i + 1) = substr({b}, i + 2)))) > 0"""


ORACLE["op8_line_dedup"] = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
o AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE regexp_matches(line, '{lines.WORD}') GROUP BY line),
h AS (SELECT line, first, m, substr(line, 1, m // 2) AS a, substr(line, length(line) - (m - m // 2) + 1 + m % 2) AS b
      FROM o, (VALUES (0), (1)) v(k), LATERAL (SELECT length(line) - k AS m) x WHERE length(line) >= {lines.MIN_CHARS}),
p AS (SELECT x.line, y.line AS other FROM h x JOIN h y ON x.m = y.m AND x.a = y.a WHERE y.first < x.first
      UNION SELECT x.line, y.line FROM h x JOIN h y ON x.m = y.m AND x.b = y.b WHERE y.first < x.first),
n AS (SELECT DISTINCT line FROM p WHERE abs(length(line) - length(other)) <= 1 AND {_near("line", "other")}),
k AS (SELECT l.doc_id, l.line, l.pos, o.line IS NOT NULL AND ((l.doc_id, l.pos) <> o.first OR n.line IS NOT NULL) AS gone
      FROM l LEFT JOIN o ON l.line = o.line LEFT JOIN n ON l.line = n.line)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.t, '') END AS text
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS t
                  FROM k GROUP BY doc_id) c ON d.doc_id = c.doc_id"""


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with cosine 0.93 or more."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences of at most 2048 tokens."""
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every word of a 20-word window that also starts earlier."""
    return seeds.dedup_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code every vector's four parts by codebooks of 256 entries after four rounds."""
    return codes.codes(table(spark, sf_dir, "embeddings"), 1024)


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector; fails where a deviation does not fit a long."""
    done = whiten.whiten(table(spark, sf_dir, "embeddings"), 256)
    return done.withColumn("deviation", F.col("deviation").cast("long"))
