"""Property test: the native parsers agree with a Python model of float()."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from ticksmith.functions import text

ALPHABET = "0123456789.,KMBkmb+-eE_ \tinfa%"


def model_float(s):
    """Python float() without digit underscores (the documented difference)."""
    if "_" in s:
        return None
    try:
        return float(s)
    except ValueError:
        return None


def model_volume(v):
    if v is None:
        return 0.0
    s = v.strip(" \t\n\r\x0b\x0c")
    for letter, f in (("K", 1e3), ("M", 1e6), ("B", 1e9)):
        if letter in s:
            x = model_float(s.replace(letter, ""))
            return 0.0 if x is None else x * f
    x = model_float(s.replace(",", ""))
    return 0.0 if x is None else x


def model_number(v):
    x = None if v is None else model_float(v.replace(",", ""))
    return None if x is None or math.isnan(x) else x


def same(a, b):
    if a is None or b is None:
        return a is b
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b


@settings(max_examples=15, deadline=None, derandomize=True)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=9)), min_size=60, max_size=60))
def test_parsers_match_python_model(spark, cells):
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    rows = df.select(text.parse_volume("v").alias("vol"), text.parse_number("v").alias("num")).collect()
    for c, r in zip(cells, rows):
        assert same(r.vol, model_volume(c)), (c, r.vol, model_volume(c))
        assert same(r.num, model_number(c)), (c, r.num, model_number(c))
