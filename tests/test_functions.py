"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from factspark.functions import names, trust, values


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normalize_name(spark):
    cases = {
        "SpaceX Inc.": "spacex", "Rocket Lab Ltd": "rocket lab", "L3Harris Technologies, Inc.": "l3harris",
        "Planet Labs Inc.": "planet", "Airbus S.A.S.": "airbus s a s", "Planet Labs PBC": "planet labs pbc",
        "Société Générale": "societe generale", "  SpaceX  Inc.  ": "spacex", "Inc.": "inc", "Space Labs": "space labs",
    }
    assert one(spark, [(k,) for k in cases], "n string", names.normalize_name(F.col("n"))) == list(cases.values())


def test_normalize_country(spark):
    cases = {
        "United States": "US", "USA": "US", "us": "US", "The Netherlands": "NL", "España": "ES", "  france  ": "FR",
        "Atlantis": None, "xx": None, "": None, None: None, "U.K.": None, "Italy.": "IT",
    }
    assert one(spark, [(k,) for k in cases], "n string", names.normalize_country(F.col("n"))) == list(cases.values())


def test_combine_trust(spark):
    cases = [(80, [], 80), (80, [80], 94), (82, [80], 95), (80, [50], 80), (80, [30], 80), (0, [], 1), (100, [], 99), (80, [80] * 5, 99), (80, None, 80)]
    got = one(spark, [(a, b) for a, b, _ in cases], "b int, c array<int>", trust.combine_trust(F.col("b"), F.col("c")))
    assert got == [c for _, _, c in cases]
    assert one(spark, [(70, [60, 90]), (70, [90, 60])], "b int, c array<int>", trust.combine_trust(F.col("b"), F.col("c")))[0] == \
        one(spark, [(70, [90, 60])], "b int, c array<int>", trust.combine_trust(F.col("b"), F.col("c")))[0]


def test_decay(spark):
    now = F.lit("2020-01-01").cast("timestamp")
    rows = [(80, "2020-01-01", 365), (80, "2017-01-01", 365), (80, "2010-01-05", None), (None, None, 30)]
    df = spark.createDataFrame(rows, "c int, at string, w int").withColumn("at", F.col("at").cast("timestamp"))
    got = [r[0] for r in df.select(trust.display_trust(F.coalesce("c", F.lit(50)), F.col("at"), F.col("w"), now)).collect()]
    assert got[0] == 0.8 and got[1] < 0.8 and got[2] >= 0.5 and got[3] == 0.5


def test_display_trust_rounds_as_python(spark):
    cases = [(c, p) for c in range(0, 101) for p in range(0, 1500, 5)]
    days = 100
    now, at = F.lit("2024-01-01").cast("timestamp"), F.expr("TIMESTAMP '2024-01-01' - make_dt_interval(p + 100)")
    df = spark.createDataFrame(cases, "c int, p int")
    got = {(r.c, r.p): r.t for r in df.select("c", "p", trust.display_trust(F.col("c"), at, F.lit(days), now).alias("t")).collect()}
    assert got == {(c, p): round(max(0.1, min(1.0, c / 100 - min(0.7, 0.05 * round(p / days, 2)))), 1) for c, p in cases}


def test_out_of_range(spark):
    cases = [(6.0, 1.0, True), (0.1, 1.0, True), (2.0, 1.0, False), (5.0, 1.0, False), (5.1, 1.0, True), (3.0, 0.0, False), (None, 1.0, False)]
    assert one(spark, [c[:2] for c in cases], "n double, o double", values.out_of_range(F.col("n"), F.col("o"))) == [c[2] for c in cases]


def test_values_equal(spark):
    side = lambda p: {k: F.col(p + k) for k in ("value_text", "value_num", "value_bool", "value_date")}
    cols = ", ".join(f"{p}value_text string, {p}value_num double, {p}value_bool boolean, {p}value_date date" for p in "ab")
    rows = [("x", None, None, None, "x", None, None, None), (None, 1.0, None, None, None, 1.0, None, None), (None, None, True, None, None, None, False, None), (None,) * 8]
    assert one(spark, rows, cols, values.values_equal(side("a"), side("b"))) == [True, True, False, False]


def test_clearly_newer(spark):
    rows = [("2020-02-15", "2020-01-01", "2020-01-01", "2020-01-01", True), ("2020-01-30", "2020-01-01", "2021-01-01", "2020-01-01", False),
            (None, None, "2020-03-01", "2020-01-01", True), (None, "2020-01-01", "2020-01-06", "2020-01-01", False)]
    df = spark.createDataFrame([r[:4] for r in rows], "a string, b string, c string, d string").select(*[F.col(x).cast("timestamp").alias(x) for x in "abcd"])
    assert [r[0] for r in df.select(values.clearly_newer(*[F.col(x) for x in "abcd"])).collect()] == [r[4] for r in rows]


def test_reopen(spark):
    yes = [(0, 5, 4, 5), (2, 2, 2, 7), (5, 5, 9, 5), (0, 0, 3, 0)]
    no = [(5, 5, 5, 5), (5, 5, 7, 5), (6, 6, 5, 6), (0, 0, 2, 0)]
    got = one(spark, yes + no, "a int, b int, c int, d int", trust.should_reopen(*[F.col(x) for x in "abcd"]))
    assert got == [True] * 4 + [False] * 4


def test_independence(spark):
    rows = [("1", "h", "a", "1", "h", "a", False), ("1", "h", "a", "2", "h", "b", False), ("1", "h", "a", "2", "g", "a", False),
            ("1", "h", "a", "2", "g", "b", True), ("1", "h", "", "2", "g", "b", False), (None, None, None, "2", "g", "b", False)]
    got = one(spark, [r[:6] for r in rows], "a string, b string, c string, d string, e string, f string", trust.documents_independent(*[F.col(x) for x in "abcdef"]))
    assert got == [r[6] for r in rows]


def test_domains(spark):
    cases = {"https://www.nasa.gov/x": 92, "http://lab.mit.edu": 75, "https://a.b.gov": 88, "https://who.int/": 85, "x": 55, None: 55, "https://Reuters.com": 82, "https://nasa.gov:8080/": 55}
    assert one(spark, [(k,) for k in cases], "u string", trust.domain_trust(F.col("u"))) == list(cases.values())


@pytest.mark.parametrize("a, b, share", [("word", "two words", 0.3636), ("abc", "abc", 1.0), ("", "abc", 0.0)])
def test_trigram_similarity(spark, a, b, share):
    got = one(spark, [(a, b)], "a string, b string", names.trigram_similarity(F.col("a"), F.col("b")))[0]
    assert abs(got - share) < 1e-4


def test_dates_and_addresses(spark):
    date, precision = values.flexible_date(F.col("d"))
    df = spark.createDataFrame([("2020-05-06T1",), ("2020-05",), ("2020",), ("May",), (None,)], "d string")
    got = [(str(r[0]), r[1]) for r in df.select(date, precision).collect()]
    assert got == [("2020-05-06", "day"), ("2020-05-01", "month"), ("2020-01-01", "year"), ("None", "year"), ("None", "year")]
    parts = values.address_parts(F.col("a"))
    rows = [("C/ Gran, 95, floor 2, 08024 Barcelona, Spain",), ("1 Road, 12345 Town",), ("Nowhere, Land",), ("08001 City, X",)]
    got = [tuple(r[0]) if r[0] else None for r in spark.createDataFrame(rows, "a string").select(parts).collect()]
    assert got == [("C/ Gran 95", "08024", "Barcelona", "Spain"), ("1 Road", "12345", "Town", "12345 Town"), None, (None, "08001", "City", "X")]
