"""Command line: the pipeline's jobs, for ``spark-submit`` or ``python -m ticksmith``.

    publish-csv      CSV price history -> normalised bar messages (files or Kafka)
    publish-history  REST history payload files -> bar messages
    stream           bar messages -> pass-through + time-window SMA / bands sinks
    tables           result messages -> recent-rows tables (price / sma / bb)
    indicators       parquet bars or ticks -> full indicator frame (parquet)
    snapshot         recent-rows price table -> one formatted snapshot row
    export           recent-rows price table -> CSV of the latest rows

Folder arguments name shared storage; Kafka arguments need the Kafka
connector on the classpath.
"""

from __future__ import annotations

import argparse

from ticksmith.session import build_session, scratch_scope
from ticksmith.sources.messages import INPUT_TOPIC
from ticksmith.streaming.tail import TIMED_ORDER


def _publish(bars, args) -> None:
    """Send time of a message: now, the bar's date, or ``--start`` plus row number times ``--step`` seconds."""
    from pyspark.sql import functions as F

    from ticksmith.plans import normalize
    from ticksmith.sinks import writers
    stamp = None
    if args.start:
        bars = normalize.stamped(bars, args.start, args.step)
        stamp = F.col("sent_at")
    elif args.stamp == "date":
        stamp = F.col("date")
    msgs = normalize.to_messages(bars, stamp)
    if args.kafka:
        writers.publish(msgs, kafka_servers=args.kafka, topic=args.topic)
    else:
        writers.publish(msgs, path=args.output)


def cmd_publish_csv(spark, args) -> None:
    from ticksmith.plans import normalize
    from ticksmith.sources import bars
    raw = bars.read_csv_text(spark, args.input, args.multiline)
    _publish(normalize.normalize_csv_bars(raw, mode="failfast" if args.failfast else "drop"), args)


def cmd_publish_history(spark, args) -> None:
    from ticksmith.plans import normalize
    from ticksmith.sources import bars
    entries = bars.read_history(spark, args.input, multiline=not args.json_lines)
    _publish(normalize.history_bars(entries).orderBy("date"), args)


def _message_source(spark, args):
    from ticksmith.sources import messages
    if args.kafka:
        return messages.kafka_stream(spark, args.kafka, args.topic,
                                     max_offsets_per_trigger=args.max_per_trigger)
    return messages.file_stream(spark, args.input, args.max_per_trigger)


def cmd_stream(spark, args) -> None:
    from ticksmith.sources.messages import RESULT_TOPICS
    from ticksmith.streaming import stream
    streams = stream.indicator_streams(_message_source(spark, args), event_time=args.event_time, quarantine=args.quarantine)
    out = stream.Outputs(root=args.output, kafka_servers=args.kafka_out, topics=RESULT_TOPICS)
    queries = stream.start(streams, out, trigger=_trigger(args))
    stream.await_all(spark, queries)


def cmd_tables(spark, args) -> None:
    from ticksmith.sources import messages
    from ticksmith.streaming import stream, tail
    if args.kafka:
        sources = {k: messages.result_messages(spark, args.kafka, k) for k in messages.RESULT_TOPICS}
    else:
        sources = {k: messages.file_stream(spark, f"{args.input}/{k}") for k in messages.RESULT_TOPICS}
    stream.await_all(spark, tail.start_tables(sources, args.output, _trigger(args), once_within=args.once_within))


def cmd_indicators(spark, args) -> None:
    from ticksmith.plans.indicators import indicator_frame
    df = spark.read.parquet(args.input)
    indicator_frame(df, price=args.price, keys=args.keys, order=args.order) \
        .write.mode("overwrite").parquet(args.output)


def cmd_snapshot(spark, args) -> None:
    from ticksmith.plans import views
    from ticksmith.streaming import tail
    price = tail.latest_rows(spark, args.tables, "price", args.rows, TIMED_ORDER["price"])
    views.snapshot(price, args.rows, args.start, args.end,
                   order=TIMED_ORDER["price"]).show(truncate=False)


def cmd_export(spark, args) -> None:
    from ticksmith.plans import views
    from ticksmith.streaming import tail
    price = tail.latest_rows(spark, args.tables, "price", args.rows, TIMED_ORDER["price"])
    views.export_csv(price, args.output, args.rows, order=TIMED_ORDER["price"])


def _trigger(args) -> dict:
    return {"availableNow": True} if args.once else {"processingTime": args.trigger}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ticksmith")
    sub = p.add_subparsers(dest="cmd", required=True)

    def add(name, fn, **kw):
        s = sub.add_parser(name, **kw)
        s.set_defaults(fn=fn)
        return s

    for name, fn in [("publish-csv", cmd_publish_csv), ("publish-history", cmd_publish_history)]:
        s = add(name, fn)
        s.add_argument("--input", required=True)
        s.add_argument("--output", help="folder for message files")
        s.add_argument("--kafka", help="bootstrap servers")
        s.add_argument("--topic", default=INPUT_TOPIC)
        s.add_argument("--stamp", choices=["now", "date"], default="now", help="send time of the messages")
        s.add_argument("--start", help="send time of the first message; then --step seconds per row")
        s.add_argument("--step", type=float, default=1.0)
        if name == "publish-history":
            s.add_argument("--json-lines", action="store_true")
        else:
            s.add_argument("--failfast", action="store_true", help="stop on a date that cannot be read")
            s.add_argument("--multiline", action="store_true", help="cells may hold line breaks")

    for name, fn in [("stream", cmd_stream), ("tables", cmd_tables)]:
        s = add(name, fn)
        s.add_argument("--input", help="message folder (file source)")
        s.add_argument("--kafka", help="bootstrap servers of the source topics")
        s.add_argument("--topic", default=INPUT_TOPIC)
        s.add_argument("--output", required=True, help="sink / table root folder")
        s.add_argument("--trigger", default="1 second")
        s.add_argument("--once", action="store_true", help="process what is available, then stop")
        s.add_argument("--max-per-trigger", type=int, default=None)
        if name == "stream":
            s.add_argument("--kafka-out", help="write result topics to these servers")
            s.add_argument("--quarantine", action="store_true")
            s.add_argument("--event-time", choices=["timestamp", "date"], default="timestamp")
        else:
            s.add_argument("--once-within", help="window tables take a window sent again within this time once, e.g. '1 hour'")

    s = add("indicators", cmd_indicators)
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--price", default="price")
    s.add_argument("--keys", nargs="*", default=["symbol"])
    s.add_argument("--order", nargs="+", default=["ts", "seq"])

    for name, fn in [("snapshot", cmd_snapshot), ("export", cmd_export)]:
        s = add(name, fn)
        s.add_argument("--tables", required=True)
        s.add_argument("--rows", type=int, default=100)
        if name == "snapshot":
            s.add_argument("--start")
            s.add_argument("--end")
        else:
            s.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(app=f"ticksmith-{args.cmd}")
    with scratch_scope(spark):
        args.fn(spark, args)


if __name__ == "__main__":
    main()
