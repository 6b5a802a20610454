import json

import pytest
from pyspark.sql import functions as F

from ticksmith.plans import normalize
from ticksmith.sinks import writers
from ticksmith.sources import bars as src

CSV = '''Date,Price,Open,High,Low,Vol.,Change %,Note
"01/03/2024","42,836.1","44,183.1","45,503.2","40,813.0","121.53K","-3.05%",a
"01/02/2024","44,183.1","45,000.0","45,899.9","44,162.1","1.2M","-1.82%",b
"01/04/2024","44,151.1","42,836.1","44,751.6","42,629.3","-","3.07%",c
"01/05/2024","","42,836.1","44,751.6","42,629.3","3B","1.00%",d
"01/06/2024","44,000.0","42,836.1","44,751.6","42,629.3","5K","",e
"01/07/2024","44,000.0","42,836.1","44,751.6","42,629.3","5K","0.5%",
'''


def test_csv_normalize(spark, scratch):
    p = f"{scratch}/bars.csv"
    open(p, "w").write(CSV)
    raw = src.read_csv_text(spark, p)
    out = normalize.normalize_csv_bars(raw).collect()
    # rows with an empty price, change or extra cell are dropped; sorted by date
    assert [r.Note for r in out] == ["b", "a", "c"]
    assert [r.volume for r in out] == [1200000.0, 121530.0, 0.0]
    assert out[1].price == 42836.1 and out[1].change_percent == -3.05
    msgs = normalize.to_messages(normalize.normalize_csv_bars(raw), sent_at=F.lit("2024-02-01 10:00:00").cast("timestamp"))
    first = msgs.first()
    assert first.date == "2024-01-02T00:00:00" and first.timestamp == "2024-02-01T10:00:00"


def test_missing_column_raises_before_reading(spark, scratch):
    p = f"{scratch}/bad.csv"
    open(p, "w").write("Date,Price\n01/01/2024,1\n")
    with pytest.raises(ValueError, match="the CSV header lacks"):
        src.read_csv_text(spark, p)


def test_history_payload_multiline(spark, scratch):
    doc = {"Response": "Success", "Data": {"Aggregated": False, "Data": [
        {"time": 1704067200, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volumeto": 100.0, "x": 1},
        {"time": 1704153600, "open": 1.5, "high": 2.5, "low": 1.0, "close": 2.0, "volumeto": 200.0},
    ]}}
    p = f"{scratch}/hist.json"
    open(p, "w").write(json.dumps(doc, indent=2))
    bars = normalize.history_bars(src.read_history(spark, p, multiline=True))
    rows = normalize.to_messages(bars, sent_at=F.lit(None).cast("timestamp")).collect()
    assert [r.date for r in rows] == ["2024-01-01T00:00:00", "2024-01-02T00:00:00"]
    assert rows[1].price == 2.0 and rows[1].volume == 200.0 and rows[1].change_percent is None
    js = writers.as_messages(normalize.to_messages(bars, sent_at=F.lit("2024-01-03").cast("timestamp"))).first().value
    assert "change_percent" not in js and '"price":1.5' in js


def test_publish_to_files(spark, scratch):
    df = spark.createDataFrame([(1.0, None)], "price double, open double")
    writers.publish(df, path=f"{scratch}/out")
    assert spark.read.text(f"{scratch}/out").first().value == '{"price":1.0}'
