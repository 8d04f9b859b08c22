"""Aggregations: empty groups, quantiles, pivot, set difference, top-k."""

from lintel.operators import rollups


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "k string, v double")
    out = {r.k: r.s for r in rollups.sum_by(df, ["k"], {"s": "v"}).collect()}
    assert out == {"a": 0.0, "b": 2.0}


def test_exact_quantiles_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (5.0,)], "v double")
    q = rollups.exact_quantiles(df, "v", (0, 0.1, 0.2, 0.8, 0.9, 1)).first()
    assert [round(x, 6) for x in q] == [1.0, 1.3, 1.6, 3.8, 4.4, 5.0]


def test_pivot_fixed_values(spark):
    df = spark.createDataFrame([(2020, "A", 1.0), (2020, "B", 2.0), (2021, "A", 3.0)], "y int, p string, v double")
    out = {r.y: (r.p_a, r.p_b, r.p_c) for r in rollups.pivot_sum(df, "y", "p", ["A", "B", "C"], "v").collect()}
    assert out == {2020: (1.0, 2.0, None), 2021: (3.0, None, None)}


def test_one_sided(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "n string")
    b = spark.createDataFrame([("y",), ("z",)], "n string")
    out = sorted((r.n, r.side) for r in rollups.one_sided(a, b, "n").collect())
    assert out == [("x", "left_only"), ("z", "right_only")]


def test_top_k_tie_break_is_stable_under_repartition(spark):
    rows = [(f"d{i}", float(i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, v double")
    first = [tuple(r) for r in rollups.top_k(df, "v", ["k"], 7).collect()]
    for n in (1, 5, 13):
        again = [tuple(r) for r in rollups.top_k(df.repartition(n), "v", ["k"], 7).collect()]
        assert again == first
