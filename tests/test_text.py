import math

import pytest
from pyspark.sql import functions as F

from ticksmith.functions import text
from ticksmith.sources.bars import check_columns

# FIXTURES §3: volume text -> double (a Python model of the rule gives the same).
VOLUME_CASES = [
    ("45.5K", 45500.0), ("1.2M", 1200000.0), ("3B", 3e9), ("1,234.5K", 0.0),
    ("1,234", 1234.0), ("-", 0.0), (None, 0.0), (" 7K ", 7000.0), ("5k", 0.0),
    ("", 0.0), ("K", 0.0), ("1KM", 0.0), ("1e3", 1000.0), ("inf", math.inf),
    ("1d", 0.0), ("5f", 0.0), ("1_000", 0.0),
]


def python_volume(v):
    """Independent model of the CSV volume rule (underscores rejected)."""
    if v is None:
        return 0.0
    s = v.strip()
    for letter, f in (("K", 1e3), ("M", 1e6), ("B", 1e9)):
        if letter in s:
            body = s.replace(letter, "")
            break
    else:
        body, f = s.replace(",", ""), 1.0
    if "_" in body:
        return 0.0
    try:
        return float(body) * f
    except ValueError:
        return 0.0


def test_volume_edge_table(spark):
    df = spark.createDataFrame([(v,) for v, _ in VOLUME_CASES], "v string")
    got = [r[0] for r in df.select(text.parse_volume("v")).collect()]
    for (v, want), g in zip(VOLUME_CASES, got):
        assert g == want, (v, g, want)
        assert python_volume(v) == want


def test_price_and_percent(spark):
    df = spark.createDataFrame([("67,211.9", "4.96%"), ("", ""), ("abc", "1d%"), (" 1,000 ", "-0.5%")],
                               "p string, c string")
    got = df.select(text.parse_number("p").alias("p"), text.parse_percent("c").alias("c")).collect()
    assert (got[0].p, got[0].c) == (67211.9, 4.96)
    assert (got[1].p, got[1].c) == (None, None)
    assert (got[2].p, got[2].c) == (None, None)
    assert (got[3].p, got[3].c) == (1000.0, -0.5)


def test_nan_text_becomes_null(spark):
    df = spark.createDataFrame([("nan",), ("NaN%",)], "v string")
    got = df.select(text.parse_number("v"), text.parse_percent("v")).collect()
    assert got[0][0] is None and got[1][1] is None


def test_market_date_formats(spark):
    df = spark.createDataFrame([("12/31/2023",), ("Jan 5, 2024",), ("2024-01-05",), ("garbage",)], "d string")
    got = [r[0] for r in df.select(F.date_format(text.parse_market_date("d"), "yyyy-MM-dd")).collect()]
    assert got == ["2023-12-31", "2024-01-05", "2024-01-05", None]


def test_required_columns():
    check_columns(["Date", "Price", "Open", "High", "Low", "Vol.", "Change %", "extra"])
    with pytest.raises(ValueError, match="the CSV header lacks"):
        check_columns(["Date", "Price", "Open", "High", "Low", "Change %"])
