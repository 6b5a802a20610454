"""Property test: plain and double-encoded messages decode to the same values."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from ticksmith.functions import codec
from ticksmith.schema import BAR_MESSAGE

finite = st.floats(allow_nan=False, allow_infinity=False, width=64)
message = st.fixed_dictionaries(
    {"price": finite},
    optional={"open": finite, "date": st.text(max_size=12), "timestamp": st.text(max_size=12)})


@settings(max_examples=10, deadline=None, derandomize=True)
@given(st.lists(st.tuples(message, st.booleans()), min_size=40, max_size=40))
def test_lenient_decode_round_trip(spark, batch):
    texts = [json.dumps(json.dumps(m)) if twice else json.dumps(m) for m, twice in batch]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    rows = codec.decode_frame(df, BAR_MESSAGE, lenient=True).collect()
    for (m, _), r in zip(batch, rows):
        assert r.price == m["price"]
        assert r.open == m.get("open") and r.date == m.get("date") and r.timestamp == m.get("timestamp")
