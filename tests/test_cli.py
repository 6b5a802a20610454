"""The command line runs the pipeline end to end over files."""

import pytest

from ticksmith.__main__ import parser
from ticksmith.plans import fixtures, normalize
from ticksmith.sinks import writers
from ticksmith.sources import bars
from ticksmith.streaming import stream, tail

from sf_paths import SF_MID, SF_SMALL

CSV = '''Date,Price,Open,High,Low,Vol.,Change %
"01/03/2024","42,836.1","44,183.1","45,503.2","40,813.0","121.53K","-3.05%"
"1/2/2024","44,183.1","45,000.0","45,899.9","44,162.1","1.2M","-1.82%"
'''


def _run(spark, argv):
    args = parser().parse_args(argv)
    args.fn(spark, args)


def test_publish_then_stream(spark, scratch):
    open(f"{scratch}/bars.csv", "w").write(CSV)
    _run(spark, ["publish-csv", "--input", f"{scratch}/bars.csv", "--output", f"{scratch}/topic"])
    msgs = spark.read.text(f"{scratch}/topic").collect()
    assert len(msgs) == 2 and '"date":"2024-01-02T00:00:00"' in min(m.value for m in msgs)
    _run(spark, ["stream", "--input", f"{scratch}/topic", "--output", f"{scratch}/out", "--once"])
    out = stream.Outputs(root=f"{scratch}/out")
    assert stream.read_result(spark, out, "price").count() == 2


def test_from_csv_to_snapshot(spark, scratch, capsys):
    """publish-csv, stream, tables, snapshot and export, each reading what the one before wrote."""
    lines = [f'"{m:02d}/{d:02d}/2024","{100 + d}.5","100","200","50","1K","{d}%"' for m in (1, 2, 3) for d in range(1, 29)]
    open(f"{scratch}/bars.csv", "w").write("\n".join([CSV.split("\n")[0], *lines]) + "\n")
    _run(spark, ["publish-csv", "--input", f"{scratch}/bars.csv", "--output", f"{scratch}/topic",
                 "--start", "2024-06-01T00:00:00", "--step", "30"])
    stamps = [r.value for r in spark.read.text(f"{scratch}/topic").collect()]
    assert len({s.split('"timestamp":"')[1][:19] for s in stamps}) == 84
    _run(spark, ["stream", "--input", f"{scratch}/topic", "--output", f"{scratch}/out", "--once"])
    _run(spark, ["tables", "--input", f"{scratch}/out", "--output", f"{scratch}/tables", "--once"])
    rows = {k: t.count() for k, t in tail.read_tables(spark, f"{scratch}/tables").items()}
    assert rows["price"] == 84 and rows["sma"] == rows["bb"] > 0
    _run(spark, ["snapshot", "--tables", f"{scratch}/tables"])
    assert "$128.50" in capsys.readouterr().out
    _run(spark, ["export", "--tables", f"{scratch}/tables", "--output", f"{scratch}/export", "--rows", "5"])
    import glob
    text = open(glob.glob(f"{scratch}/export/part*")[0]).read().split()
    assert len(text) == 6 and [line.split(",")[2] for line in text[1:]] != sorted(
        (line.split(",")[2] for line in text[1:]), reverse=True)


def test_once_drains_every_query(spark, scratch):
    """The shortest query must not cut off the others."""
    writers.publish(fixtures.messages(spark, SF_MID).drop("seq", "symbol"), path=f"{scratch}/topic")
    _run(spark, ["stream", "--input", f"{scratch}/topic", "--output", f"{scratch}/out", "--once"])
    out = stream.Outputs(root=f"{scratch}/out")
    assert {k: stream.read_messages(spark, out, k).count() for k in ("price", "sma", "bb")} == {
        "price": 10000, "sma": 29795, "bb": 29795}
    _run(spark, ["tables", "--input", f"{scratch}/out", "--output", f"{scratch}/tables", "--once"])
    assert {k: t.count() for k, t in tail.read_tables(spark, f"{scratch}/tables").items()} == {
        "price": 10000, "sma": 29795, "bb": 29795}


def test_failfast_and_rejects(spark, scratch):
    open(f"{scratch}/bars.csv", "w").write(CSV + '"someday","1","1","1","1","1","1%"\n"5 Jan 2024","x","1","1","1","1","1%"\n')
    raw = bars.read_csv_text(spark, f"{scratch}/bars.csv")
    assert normalize.normalize_csv_bars(raw).count() == 2
    assert sorted(r.Date for r in normalize.rejected_csv_bars(raw).collect()) == ["5 Jan 2024", "someday"]
    with pytest.raises(Exception, match="no date layout fits someday"):
        normalize.normalize_csv_bars(raw, mode="failfast").collect()


def test_quoted_cells(spark, scratch):
    open(f"{scratch}/q.csv", "w").write(CSV.split("\n")[0] + ',Note\n"1/2/2024","1","1","1","1","1","1%","say ""hi"", ok\nthere"\n')
    assert bars.read_csv_text(spark, f"{scratch}/q.csv", multiline=True).first().Note == 'say "hi", ok\nthere'


def test_indicators_command(spark, scratch):
    fixtures.ticks(spark, SF_SMALL).write.parquet(f"{scratch}/ticks")
    _run(spark, ["indicators", "--input", f"{scratch}/ticks", "--output", f"{scratch}/frame"])
    frame = spark.read.parquet(f"{scratch}/frame")
    assert frame.count() == 1000 and "MACD_hist" in frame.columns
