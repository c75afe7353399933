import pytest
from pyspark.sql import functions as F

from mensura.functions.keys import file_key, filled, name_key, strip
from mensura.functions.names import ascii_column, paper_keys, resolve_variable, variable_names
from mensura.functions.numbers import plain_number, quantity


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("12", 12.0), (" 12 ", 12.0), ("+5", 5.0), ("-5.5", -5.5), ("−5,5", -5.5), ("9,9", 9.9), ("1.0E3", 1000.0), ("9.9e-2", 0.099), ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("1,234,567", 1234567.0),
        ("12 000", 12000.0), ("0.5 ± 0.1", 0.5), ("0.5±0.1 µm", 0.5), ("3 +/- 1", 3.0), ("5 µm", 5.0), ("5µm", 5.0), ("1.3 /10", 1.3), ("8/10", 8.0), ("9.9 s⁻¹", 9.9), ("26.1s⁻¹", 26.1), ("0.03 Pa·s", 0.03),
        ("10 mm s-1", 10.0), ("50 %", 50.0), ("ca. 5", 5.0), ("1.5 x 10^3", 1500.0), ("1.5×10⁻²", 0.015), ("5.2 (0.3)", 5.2), ("5 µm", 5.0),
        ("1-2", None), ("1 – 2", None), ("10…20", None), ("10 to 21", None), ("< 5", None), ("≤5", None), ("> 1", None), ("below 9", None), ("three", None), ("l.O", None), ("Fig. 3", None), ("", None), (" ", None), (None, None), ("nan", None), ("n.d.", None),
        ("5 of 9", None), ("1;2", None), ("5 a" + "b" * 5000 + "!", None),
    ],
)
def test_quantity(spark, text, number):
    got = one(spark, quantity, text)
    assert got == pytest.approx(number) if number is not None else got is None


@pytest.mark.parametrize(("text", "number"), [("0,5", 0.5), (" 5.00e-1 ", 0.5), ("1d", None), ("nan", None), ("inf", None), ("—", None), ("", None), (None, None), ("1_0", None)])
def test_plain_number(spark, text, number):
    assert one(spark, plain_number, text) == number


def test_keys(spark):
    assert one(spark, name_key, "D90_μm ") == one(spark, name_key, "d90 µm") == "d90um"
    assert one(spark, name_key, "Shear rate (s⁻¹)") == "shearrates1"
    assert one(spark, file_key, "papers/1‐s2.0-S1-MAIN.PDF\t") == one(spark, file_key, "1-s2.0-s1-main") == "1s20s1main"
    assert one(spark, strip, "​　 a b \n") == "a b"
    assert [one(spark, filled, t) for t in (None, "", " ", "NaN", " n/a ", "—", "0", "none of them")] == [False] * 6 + [True] * 2


def test_names(spark):
    guide = spark.createDataFrame([("d90_µm", "d90 (µm)"), ("Temperature_C", "Temperature (°C)"), (None, "x"), ("No_label", None)], "variable string, label string")
    names = variable_names(guide)
    df = spark.createDataFrame([("D90 (μm)",), ("temperature_c",), ("other",), (None,)], "t string")
    assert [r[0] for r in df.select(resolve_variable(F.col("t"), names)).collect()] == ["d90_µm", "Temperature_C", None, None]
    assert df.select(resolve_variable(F.col("t"), {})).first()[0] is None
    assert ascii_column("d90_µm") == "d90_um" and ascii_column("Shear_rate_s-1") == "shear_rate_s_1"
    papers = spark.createDataFrame([("A-1",), ("a-1",), (None,)], "paper string")
    assert [tuple(r) for r in paper_keys(papers).collect()] == [("a1", "A-1")]
