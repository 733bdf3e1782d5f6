from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finloom.functions import numbers, quality, similarity, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_french_numbers(spark):
    given_ = ["1500", "1 500,00", "12 450 000", "1.500,00", "(1.500,00)", "-", "—", "150,00 DT", "DT 1.234,56", "l5O,00", "1,5", "", "abc", None, "-1.500,00", "42", "1.5", "1.234.567", "OOO", "€ 12"]
    want = [1500, 1500, 12450000, 1500, -1500, 0, 0, 150, "1234.56", 150, "1.5", None, None, None, -1500, 42, "1.5", 1234567, None, 12]
    got = column(spark, given_, numbers.parse_french)
    assert got == [None if w is None else Decimal(str(w)).quantize(Decimal("0.000001")) for w in want]


def test_lenient_numbers(spark):
    got = column(spark, ["1 234 567", "(12)", "1,5", "1,234.5", "95,276,113 41,694,461", "12 DT", "", None, "x", "13.3%"], numbers.extract_numeric)
    assert got == [1234567.0, -12.0, 1.5, 1234.5, None, 12.0, None, None, None, 13.3]


def test_grades_and_percent(spark):
    assert column(spark, [0.9, 0.7, 0.5, 0.1], numbers.score_to_grade, "double") == ["EXCELLENT", "GOOD", "FAIR", "POOR"]
    assert column(spark, [0.125, 0.135, 0.5], numbers.percent, "double") == [12, 14, 50]
    assert column(spark, [12.0, -3.25], numbers.french_percent, "double")[0] == "+12,0%"


def test_normal_forms(spark):
    assert column(spark, ["  L'Été  &  Cie ", "RÉSULTAT"], text.normalize) == ["l ete cie", "resultat"]
    assert column(spark, ["5O3 a l0l x", "=12 _3"], text.numeric_format_repair) == ["503 a l0l x", "-12 -3"]
    assert column(spark, ["ACTIFS NON COURANTS", "Stocks", "AB"], text.is_caps_heading) == [True, False, False]


def test_quality_layers(spark):
    rows = spark.createDataFrame([("abababab" * 4,), ("",), ("abc",)], "t string")
    got = rows.select(quality.char_entropy(F.col("t")).alias("b")).collect()
    assert [round(r.b, 6) for r in got] == [1.0, 0.0, round(1.584962500721156, 6)]
    one = spark.range(1).select(quality.composite(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit("POOR")).alias("q"), quality.correction_penalty(F.lit(5), F.lit(1000)).alias("p")).first()
    assert one.q == 0.0 and one.p == pytest.approx(0.005)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


@given(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12))
def test_common_subsequence(a, b):
    assert similarity.common_subsequence(a, b) == brute_lcs(a, b)


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_edits(a, b):
    def full(x, y):
        if not x or not y:
            return len(x) + len(y)
        return min(full(x[1:], y) + 1, full(x, y[1:]) + 1, full(x[1:], y[1:]) + (x[0] != y[0])) if len(x) + len(y) < 9 else None

    want = full(a, b)
    if want is not None:
        assert similarity.edits(a, b, 20) == want


def test_break_words():
    words = frozenset(["total", "des", "actifs", "tot", "al"])
    assert similarity.break_words("totaldesactifs", words, 6) == ["total", "des", "actifs"]
    assert similarity.break_words("totalx", words, 6) is None
