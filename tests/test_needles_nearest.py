"""Needle search, many similarity queries, pairs across texts and validity against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.operators import nearest, needles, text, validity


def test_searcher_equals_plain_search():
    rnd = random.Random(2)
    for _ in range(200):
        letters = rnd.choice(["ab", "abcdé漢 ", "xyz "])
        word = lambda n: "".join(rnd.choice(letters) for _ in range(n))     # noqa: E731
        wanted = sorted({word(rnd.randrange(1, 14)) for _ in range(rnd.randrange(1, 40))})
        texts = [word(rnd.randrange(0, 80)) for _ in range(20)]
        coded = [t.encode() for t in texts]
        got = needles.Searcher([w.encode() for w in wanted]).hits(
            np.frombuffer(b"".join(coded), np.uint8), np.cumsum([len(b) for b in coded]))
        assert set(got) == {(i, k) for i, t in enumerate(texts) for k, w in enumerate(wanted) if w in t}


def test_needle_hits_odd_cases(spark, monkeypatch):
    monkeypatch.setattr(needles, "PART", 64)
    rows = [(1, None, "c"), (2, "", "c"), (3, "housing and slums", "c"), (3, "housing and slums", "c"),
            (None, "hébergement", "c"), (4, "x" * 5000 + "long needle of many words", "c"), (5, "hous", "c"), (6, "ing", "c")]
    df = spark.createDataFrame(rows, "key long, text string, needles string").repartition(3)
    got = needles.needle_hits(df, "key", "text", ["housing", "slum", "", "é", "long needle of many words", "slum", "absent"])
    want = [(None, ["é"]), (3, ["housing", "slum"]), (3, ["housing", "slum"]), (4, ["long needle of many words"])]
    assert sorted(((r["key"], r["needles"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert needles.needle_hits(df, "key", "text", []).count() == 0
    assert needles.needle_hits(df.limit(0), "key", "text", ["a"]).count() == 0


def test_needles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(needles, "MAX_BYTES", 4)
    df = spark.createDataFrame([("abcde",)], "w string")
    with pytest.raises(ValueError):
        needles.needle_hits(df.withColumn("id", F.lit(1)), "id", "w", ["abcde"])
    with pytest.raises(ValueError):
        needles.stated(spark.range(3).select(F.col("id").cast("string").alias("w")), "w", most=2)


def _plain_best(rows, queries, k):
    out = []
    for q, v in queries:
        if v is None or any(x is None for x in v) or not np.isfinite(v).all():
            continue
        scored = []
        for i, x in rows:
            if i is not None and x is not None and len(x) == len(v) and all(c is not None for c in x) and np.isfinite(x).all():
                s = 0.0
                for a, b in zip(x, v):
                    s += a * b
                scored.append((-s, i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("parts,block", [(1, 1 << 20), (7, 1 << 20), (3, 64)])
def test_top_k_of_many_queries(spark, parts, block, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 16)
    monkeypatch.setattr(nearest, "PAIRS", 50)
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=6).tolist()) for i in range(150)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]                        # a third are copies: ties by id
    rows += [(900, None), (901, [1.0] * 5), (902, [float("nan")] * 6), (903, [None] * 6), (904, [float("inf")] * 6), (None, rows[7][1])]
    queries = [(i, rows[i][1]) for i in range(12)] + [(77, [0.0] * 6), (78, None), (79, [1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(parts)
    q = spark.createDataFrame(queries, "query long, vec array<double>")
    got = sorted(tuple(r) for r in nearest.top_k_many(df, "v", "id", q, 5, block).collect())
    assert got == _plain_best(rows, queries, 5)
    assert nearest.top_k_many(df.limit(0), "v", "id", q, 5).count() == 0
    assert nearest.top_k_many(df, "v", "id", q.limit(0), 5).count() == 0


def test_group_means(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0]), (None, [9.0, 9.0])], "g long, v array<double>")
    assert {r["query"]: r["vec"] for r in nearest.group_means(df, "v", "g").collect()} == {1: [2.0, 3.0], 2: [5.0, 6.0]}


@pytest.mark.parametrize("parts", [1, 4, 11])
def test_next_in_order_under_any_partitioning(spark, parts):
    order = list(range(200))
    random.Random(parts).shuffle(order)
    df = spark.createDataFrame([(i, f"v{i}" if i % 5 else None) for i in order], "o long, v string").repartition(parts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["o"]: r["n"] for r in text.next_in_order(df, ["o"], "v", "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {i: f"v{i + 1}" if i < 199 and (i + 1) % 5 else None for i in range(200)}


def test_bigrams_across_texts(spark):
    rows = [(1, "aa bb", True), (2, "cc aa", True), (3, "bb cc", False), (4, "", True), (5, "bb aa", True), (6, "bb aa bb", False)]
    df = spark.createDataFrame(rows, "o long, t string, positive boolean")
    got = {r["term"]: r["score"] for r in text.tfidf_terms(df, "t", "positive", n=2, joined_by="o").collect()}
    held = [{" ".join(p) for p in zip(t.split(), t.split()[1:])} for _, t, _ in rows]
    words = [w for _, t, pos in rows if pos for w in t.split()]
    pairs = [" ".join(p) for p in zip(words, words[1:])]
    s = {p: pairs.count(p) * (np.log(7 / (1 + sum(p in h for h in held))) + 1) for p in set(pairs) if any(p in h for h in held)}
    z = np.sqrt(sum(v * v for v in s.values()))
    assert set(got) == set(s) and all(abs(got[p] - s[p] / z) < 1e-12 for p in s)
    assert "bb cc" in got          # made by a border alone, held by a text of the other class


def test_history_and_as_of(spark):
    fact = spark.createDataFrame(
        [("a", 2000, "low"), ("a", 2000, "low"), ("a", 2000, "high"), ("a", 2001, "low"), ("a", 2003, "mid"),
         ("b", 2002, "y"), ("b", 2002, "x"), (None, 2000, "x"), ("c", None, "x"), ("c", 2000, None)], "k string, y long, g string")
    h = validity.history(fact, "k", "y", "g")
    assert sorted(map(tuple, h.collect())) == [("a", "low", 2000, 2003), ("a", "mid", 2003, None), ("b", "x", 2002, None)]
    rows = [("a", 1999, 1.0), ("a", 2000, 2.0), ("a", 2002, 3.0), ("a", 2009, 4.0), ("b", 2001, 5.0), ("b", 2002, 6.0),
            ("c", 2000, 7.0), (None, 2000, 8.0)]
    got = validity.as_of(spark.createDataFrame(rows, "k string, y long, v double"), h, "k", "y", "g").collect()
    assert sorted((r["v"], r["g"]) for r in got) == [
        (1.0, "Unknown"), (2.0, "low"), (3.0, "low"), (4.0, "mid"), (5.0, "Unknown"), (6.0, "x"), (7.0, "Unknown"), (8.0, "Unknown")]
    assert validity.history(fact.limit(0), "k", "y", "g").count() == 0
