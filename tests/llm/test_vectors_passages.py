"""Operators 11 to 13 against plain versions, with the defined odd cases."""

import random

import brute
import numpy as np
import pytest

from lintel.llm import codes, seeds, whiten

DOCS = "doc_id long, text string, row string, h string, data string"     # the last three clash with inner names
VECS = "vec_id long, embedding array<float>, label int, x string, id string, v string"


def _docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "r", "h", "d") for i, t in rows], DOCS).repartition(parts, "doc_id")


def _text(rnd, n, words=40):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


def _passages(spark, rows, parts=3, **more):
    got = seeds.dedup_passages(_docs(spark, rows, parts), **more).collect()
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in got)


def _want(rows, window=20):
    return sorted((i is not None, i or 0, *rest) for i, *rest in brute.passages(rows, window))


def test_passages_equal_brute_force(spark):
    rnd = random.Random(1)
    stock, long = _text(rnd, 25), _text(rnd, 400)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, _text(rnd, 19)), (4, long), (5, long), (6, "Ä " * 60),
            (7, long.replace("w1 ", "x ")), (8, "a b c " * 30), (9, long + "\n" + long)]
    # a stock passage in a third of all texts, each time in other surroundings
    rows += [(10 + i, f"{_text(rnd, 30, 5000)} {stock if i % 3 == 0 else ''} {_text(rnd, 30, 5000)}") for i in range(90)]
    rows += [(200 + i, _text(rnd, rnd.randrange(10, 200), 3)) for i in range(20)]      # few words, many repeats
    rnd.shuffle(rows)
    assert _passages(spark, rows) == _want(rows)
    assert _passages(spark, rows, 1, window=7, gram=3) == _want(rows, 7)


def test_passages_of_repeated_and_null_ids(spark):
    rnd = random.Random(2)
    same = _text(rnd, 50)
    # rows of one id are ordered by where they stand, so equal texts can stand in any order
    rows = [(None, same), (5, same), (5, same), (5, same), (9, _text(rnd, 50)), (None, "a b")]
    assert _passages(spark, rows) == _want(rows)
    assert seeds.dedup_passages(_docs(spark, [])).count() == 0


def test_texts_without_passages(spark):
    rnd = random.Random(3)
    a, b = _text(rnd, 40, 900), _text(rnd, 30, 900)
    got = seeds.dedup_texts(_docs(spark, [(1, a), (2, f"new  {a} words {b}"), (3, None)])).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [a, f"new words {b}", None]
    assert got[0].asDict() == {"doc_id": 1, "text": a, "row": "r", "h": "h", "data": "d"}


def _vecs(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "i", "v") for i, v, lab in rows], VECS).repartition(3)


def _random_vectors(n, dim, seed, scale=1.0):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(30, dim))
    return [(i, (scale * (base[rnd.integers(30)] + 0.2 * rnd.normal(size=dim))).astype(np.float32).tolist(),
             int(rnd.integers(5)) if i % 7 else None) for i in range(n)]


BAD = [(1000, None, 1), (1001, [float("nan")] * 8, 1), (1002, [float("inf")] + [0.0] * 7, 1), (1003, [None] * 8, 1)]


@pytest.mark.parametrize("case", ["plain", "ties", "few", "large"])
def test_codes_equal_brute_force(spark, case):
    rows = _random_vectors(900 if case != "few" else 9, 8, 4)
    if case == "ties":           # a small grid: many equal distances, repeated rows and ids, a null id
        rows = [(i // 2 if i else None, [round(c) / 1024 for c in v], lab) for i, v, lab in rows]
    if case == "large":          # beyond what doubles hold exactly
        rows = [(i, [c * 1e5 for c in v], lab) for i, v, lab in rows]
    got = sorted(tuple(r) for r in codes.codes(_vecs(spark, rows + BAD)).where("vec_id is not null").collect())
    want = sorted(r for r in brute.codes([(i, np.array(v, np.float32).astype(float).tolist(), lab)
                                          for i, v, lab in rows]) if r[0] is not None)
    assert got == want


def test_codes_adapt_and_stay_exact():
    """Bounds kept over many moves give what measuring everything gives, at any list length."""
    rnd = np.random.default_rng(5)
    x, entries = rnd.integers(-50, 50, (400, 3)), rnd.integers(-50, 50, (40, 3))
    for listed in (1, 4, 16):
        book = codes.Book(entries, 100, None, listed)
        known, need = codes.assign(x, book, None)
        assert (need == codes.BEYOND).all()
        skipped = 0
        for _ in range(6):
            new = book.entries + rnd.integers(-2, 3, book.entries.shape)
            book = codes.Book(new, 100, codes.up(np.sqrt(((new - book.entries) ** 2).sum(1).astype(float))), listed)
            known, need = codes.assign(x, book, known)
            assert (known.best == ((x[:, None] - new[None]) ** 2).sum(2).argmin(1)).all()
            skipped += (need != codes.BEYOND).sum()
        assert skipped or listed == 1
        again = codes.Bounds.read(*known.columns())
        assert (again.best == known.best).all() and np.allclose(again.outer, known.outer, rtol=1e-5)
        assert (again.listed[:, :known.listed.shape[1]] == known.listed).all()


def test_codes_odd_cases(spark):
    assert codes.codes(_vecs(spark, [])).count() == 0 and codes.codes(_vecs(spark, BAD)).count() == 0
    got = codes.codes(_vecs(spark, [(1, [], 1), (2, [0.5, 1.0, 2.0], 2), (3, [0.5, 1.0, 2.0], 2)])).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got] == [
        (1, "00000000", 0, 0), (2, "00000000", 0, 0), (3, "00000000", 0, 0)]


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e13])
def test_whitening_equals_numpy(spark, scale):
    rows = _random_vectors(300, 8, 6, scale)
    rows += [(500 + i, v, lab) for i, v, lab in rows[:50]] + [(None, rows[0][1], 1)]       # repeated rows, a null id
    got = whiten.whiten(_vecs(spark, rows + BAD)).collect()
    n, dev, w, part = brute.whitened(rows)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == 4 * len(rows)
    for k in range(4):
        mine = np.array([by[r[0], k + 1]["whitened"] for r in rows])
        sign = np.sign(mine @ w[:, k])
        assert np.allclose(mine, sign * w[:, k], rtol=1e-6, atol=1e-8)
        assert np.isclose(by[0, k + 1]["explained"], part[k], rtol=1e-8)
    assert all(by[r[0], 1]["deviation"] == d for r, d in zip(rows, dev)) and got[0]["n"] == n
    assert got[0]["identity_error"] < 1e-8


def test_exact_square_sums():
    rnd = np.random.default_rng(7)
    for most in (10, 1 << 20, 1 << 40, (1 << 60) - 1):
        z = rnd.integers(-most, most, (500, 3))
        assert whiten.square_sums(z, most).tolist() == [sum(int(v) ** 2 for v in z[:, c]) for c in range(3)]


def test_whitening_odd_cases(spark):
    assert whiten.whiten(_vecs(spark, [])).count() == 0 and whiten.whiten(_vecs(spark, BAD)).count() == 0
    one = whiten.whiten(_vecs(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [], 1)])).collect()
    assert len(one) == 4 and {(r["n"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {
        (1, None, None, None)}
    flat = whiten.whiten(_vecs(spark, [(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)])).collect()     # one dimension is constant
    assert {r["component"]: abs(r["whitened"]) if r["whitened"] is not None else None for r in flat} == {1: 1.0, 2: None}
    assert {r["identity_error"] for r in flat} == {0.0}
