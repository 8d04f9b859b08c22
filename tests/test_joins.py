"""Joins: value split, null-safe reconcile, deduplicated lookups, layered codes."""

from pyspark.sql import functions as F

from lintel.operators import checks, joins


def test_split_weights_and_conservation(spark):
    fact = spark.createDataFrame([("U", 10.0), ("A", 20.0), ("B", 30.0), (None, 5.0)], "ref string, v double")
    mapping = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3)], "ref string, donor int")
    out = joins.split_values(fact, mapping, "ref", ["v"])
    key = lambda t: tuple("" if x is None else str(x) for x in t)
    got = sorted(((r.ref, r.donor, r.v) for r in out.collect()), key=key)
    want = [("U", None, 10.0), ("A", 1, 20.0), ("B", 2, 15.0), ("B", 3, 15.0), (None, None, 5.0)]
    assert got == sorted(want, key=key)
    chk = checks.totals_conserved(fact, out, "v").first()
    assert chk.conserved and chk.pre_total == chk.post_total == 65.0
    # Unmapped rows are dropped only after the check.
    assert out.filter(F.col("donor").isNotNull()).count() == 3


def test_reconcile_null_keys_match(spark):
    a = spark.createDataFrame([("D", None, 1.0)], "donor string, recip string, a double")
    b = spark.createDataFrame([("D", None, 2.0)], "donor string, recip string, b double")
    out = joins.full_reconcile(a, b, ["donor", "recip"]).collect()
    assert len(out) == 1 and out[0].a == 1.0 and out[0].b == 2.0


def test_dedupe_lookup_no_fanout(spark):
    dim = spark.createDataFrame([("A5_X", "Caribbean, regional"), ("A5_X", "Caribbean, regional"),
                                 ("N01", "One")], "iso string, name string")
    fact = spark.createDataFrame([("A5_X", 3.0), ("N01", 1.0)], "iso string, v double")
    out = joins.lookup_left(fact, joins.dedupe_lookup(dim, "iso"), "iso")
    assert out.count() == 2
    assert out.agg(F.sum("v")).first()[0] == 4.0


def test_layered_code_resolution(spark):
    df = spark.createDataFrame([("889",), ("XK",), ("FR",), ("ZZ",)], "code string")
    region = spark.createDataFrame([("889", "O_X")], "k string, v string")
    override = spark.createDataFrame([("XK", "XKV")], "k string, v string")
    iso = spark.createDataFrame([("FR", "FRA"), ("XK", "WRONG")], "k string, v string")
    out = joins.recode_via_lookups(df, "code", "iso3", [(region, "k", "v"), (override, "k", "v"), (iso, "k", "v")])
    assert sorted((r.code, r.iso3) for r in out.collect()) == [("889", "O_X"), ("FR", "FRA"), ("XK", "XKV")]


def test_small_broadcasts_only_under_bound(spark):
    tiny = spark.range(3).select(F.col("id").cast("int").alias("k"))
    big = spark.range(100).withColumn("k", F.col("id").cast("int"))
    assert joins.estimated_bytes(tiny) < 10**6
    # A frame of unknown size (local rows) is never hinted.
    unknown = spark.createDataFrame([(1,)], "k int")
    assert joins.small(unknown, 10**9) is unknown
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(joins.small(tiny, 10**9), "k")._jdf.queryExecution().sparkPlan().toString()
        refused = big.join(joins.small(tiny, 0), "k")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Broadcast" in hinted
    assert "Broadcast" not in refused


def test_full_with_suffixes(spark):
    a = spark.createDataFrame([("X", 1.0), ("Y", 2.0)], "iso string, v double")
    b = spark.createDataFrame([("Y", 3.0), ("Z", 4.0)], "iso string, v double")
    out = {r.iso: (r.v_p, r.v_k) for r in joins.full_with_suffixes(a, b, "iso", ("_p", "_k")).collect()}
    assert out == {"X": (1.0, 0.0), "Y": (2.0, 3.0), "Z": (0.0, 4.0)}


def test_join_split_hot_matches_plain_join(spark):
    rows = [("hot", i) for i in range(50)] + [("a", 1), ("b", 2), (None, 3)]
    big = spark.createDataFrame(rows, "k string, i int")
    other = spark.createDataFrame([("hot", 1.0), ("a", 2.0)], "k string, s double")
    got = sorted((r.k or "", r.i, r.s) for r in joins.join_split_hot(big, other, "k", "left", hot_rows=10).collect())
    want = sorted((r.k or "", r.i, r.s) for r in big.join(other, "k", "left").collect())
    assert got == want and len(got) == 53
