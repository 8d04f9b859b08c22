"""Scalar rules and predicates on inline fixtures (null and Unicode cases)."""

from pyspark.sql import functions as F

from lintel.functions import columns as C


def test_exclusion_keeps_blank_and_na(spark):
    df = spark.createDataFrame([("E01",), (None,), ("NA",), ("C01",), ("E02",)], "aid_type string")
    df = df.withColumn("sector_code", F.lit("160"))
    kept = sorted(r.aid_type or "<null>" for r in df.filter(C.oda_exclusion()).collect())
    assert kept == ["<null>", "C01", "NA"]


def test_exclusion_drops_sector_null_safe(spark):
    df = spark.createDataFrame([("930", "C01"), (None, "C01"), ("160", "C01")], "sector_code string, aid_type string")
    assert df.filter(C.oda_exclusion()).count() == 2


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (None,)], "x double")
    out = [r.y for r in df.select(C.clamp_nonneg("x").alias("y")).collect()]
    assert out == [0.0, 0.0, 2.0, None]


def test_unicode_trim_and_hspace(spark):
    df = spark.createDataFrame([(" P7  ",), ("NATION 3",), (None,)], "s string")
    out = df.select(C.unicode_trim("s").alias("t"), C.hspace_to_space("s").alias("h")).collect()
    assert out[0].t == "P7"
    assert out[1].h == "NATION 3"
    assert out[2].t is None


def test_repair_from_prefix(spark):
    df = spark.createDataFrame([(None, "GB-1-x"), ("A", "FR-6-y"), ("B", "ZZ-1")], "ref string, ident string")
    out = [r.r for r in df.select(C.repair_from_prefix("ref", "ident", [("GB-1", "GB-1"), ("FR-6", "FR-6")])
                                  .alias("r")).collect()]
    assert out == ["GB-1", "FR-6", "B"]


def test_conditional_keep(spark):
    rows = [("44000", "International Development Association x"), ("44000", "other"), ("44000", None),
            ("X", None), (None, "International Development Association")]
    df = spark.createDataFrame(rows, "ref string, funding string")
    kept = df.filter(C.conditional_keep("ref", "funding", [("44000", "International Development Association")]))
    assert sorted((r.ref, r.funding) for r in kept.collect()) == [
        ("44000", "International Development Association x"), ("X", None)]


def test_literal_contains_with_parentheses(spark):
    df = spark.createDataFrame([("Food and Agriculture Organization (FAO)",), ("Food and Agriculture Organization",)],
                               "s string")
    assert df.filter(C.contains_literal("s", "Organization (FAO)")).count() == 1


def test_value_bins_edges(spark):
    edges = (0, 1, 10, 50, 100, 500, 1000, 1500)
    df = spark.createDataFrame([(0.0,), (1.0,), (999.9,), (1500.0,), (1500.1,), (-1.0,), (None,)], "x double")
    out = [r.b for r in df.select(C.value_bin("x", edges).alias("b")).collect()]
    assert out == [0, 1, 5, 6, None, None, None]
    labels = [r.l for r in df.select(C.bin_label("x", edges).alias("l")).collect()]
    assert labels[:4] == ["0 - 1", "1 - 10", "500 - 1000", "1000 - 1500"]


def test_normalize_text(spark):
    df = spark.createDataFrame([("  Hello, World!! café_1 ",), ("!!!",), (None,)], "s string")
    out = [r.t for r in df.select(C.normalize_text("s").alias("t")).collect()]
    assert out == ["hello world café_1", None, None]


def test_strip_stopwords(spark):
    df = spark.createDataFrame([("the house of la casa",)], "s string")
    assert df.select(C.strip_stopwords("s", ["the", "of", "la"]).alias("t")).first().t == "house casa"


def test_concat_skips_null(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(C.concat_text("x", "y", "z").alias("t")).first().t == "a c"


def test_recode_and_money(spark):
    df = spark.createDataFrame([("Syrian Arab Republic", 1234.56), ("Chad", None)], "n string, v double")
    out = df.select(C.recode("n", {"Syrian Arab Republic": "Syria"}).alias("n"),
                    C.money_text("v").alias("m")).collect()
    assert [(r.n, r.m) for r in out] == [("Syria", "$1,234.6"), ("Chad", None)]
