from pyspark.sql import functions as F

from ticksmith.functions import codec
from ticksmith.schema import BAR_MESSAGE

# SURVEY §2.14 inputs and decoded / re-encoded outputs.
CASES = [
    ("not json", None, "{}"),
    ('{"price":1.5', None, "{}"),
    ("[1,2]", None, "{}"),
    ("{}", None, "{}"),
    ("", None, "{}"),
    (None, None, "{}"),
    ('{"price":"12.5","open":3.0}', None, '{"open":3.0}'),
    ('{"price":1}', 1.0, '{"price":1.0}'),
    ('{"price":2,"price":3}', 3.0, '{"price":3.0}'),
    ('{"price":4,"zzz":1}', 4.0, '{"price":4.0}'),
]


def test_decode_and_reencode(spark):
    df = spark.createDataFrame([(v,) for v, _, _ in CASES], "value string")
    dec = codec.decode_frame(df, BAR_MESSAGE)
    out = dec.select("price", codec.encode_row().alias("json")).collect()
    for (v, price, js), row in zip(CASES, out):
        assert row.price == price, v
        assert row.json == js, (v, row.json)


def test_nan_round_trip(spark):
    df = spark.createDataFrame([('{"price":NaN}',)], "value string")
    row = codec.decode_frame(df, BAR_MESSAGE).select("price", codec.encode_row("price").alias("j")).first()
    assert row.price != row.price  # NaN
    assert row.j == '{"price":"NaN"}'


def test_number_in_string_field(spark):
    df = spark.createDataFrame([('{"date":5}',)], "value string")
    assert codec.decode_frame(df, BAR_MESSAGE).first().date == "5"


def test_double_encoded(spark):
    plain = '{"price":2.0,"date":"d"}'
    twice = '"{\\"price\\":3.0}"'
    df = spark.createDataFrame([(plain,), (twice,), ("bad",), (None,)], "value string")
    got = [r.price for r in codec.decode_frame(df, BAR_MESSAGE, lenient=True).collect()]
    assert got == [2.0, 3.0, None, None]


def test_quarantine(spark):
    df = spark.createDataFrame([('{"price":1}',), ("oops",), ("",)], "value string")
    good, bad = codec.with_quarantine(df, BAR_MESSAGE)
    assert [r.price for r in good.collect()] == [1.0]
    assert sorted(r.value for r in bad.collect()) == ["", "oops"]


def test_bytes_to_text(spark):
    df = spark.createDataFrame([(bytearray(b'{"price":7}'),)], "value binary")
    assert codec.decode_frame(df, BAR_MESSAGE).first().price == 7.0
    assert df.select(codec.as_text("value")).first()[0] == '{"price":7}'
    assert df.select(F.col("value")).count() == 1
