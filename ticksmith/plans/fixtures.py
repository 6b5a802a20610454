"""Instrument data derived from the driver's tables.

* ticks: ``events`` as a multi-instrument tick stream (symbol = event type).
* bars: ``orders`` rolled up to daily OHLCV bars per order priority.
* messages: ticks in the message schema, as the producer would publish.
* CSV text and REST payloads: bars re-encoded the way those feeds write
  them, so the parsers run on text Spark produced from the tables.

All of it is ordinary distributed Spark work that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.functions import timefmt
from ticksmith.schema import CSV_COLUMNS
from ticksmith.session import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, ts, seq, price`` from ``events``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts",
        F.col("event_id").alias("seq"), F.col("value").alias("price"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars: ``symbol, date, open, high, low, price, volume, change_percent``.

    Open/close are the first/last order of the day by order key; volume is
    the day's value in cents summed exactly, then scaled to units.
    """
    o = table(spark, sf_dir, "orders")
    agg = o.groupBy(F.col("o_orderpriority").alias("symbol"),
                    F.col("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("price"),
        (F.sum(F.round(F.col("o_totalprice") * 100)) / 100).alias("volume"))
    # "+ 0.0" turns a rounded negative zero into zero.
    change = F.round(F.try_divide(F.lit(100.0) * (F.col("price") - F.col("open")), F.col("open")), 2) + F.lit(0.0)
    return agg.withColumn("change_percent", change)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as bar messages, plus ``seq`` and ``symbol``: one message per event.

    ``timestamp`` is the event time as ISO text, ``date`` its day; open,
    high and low equal the tick price; volume is the user id; the change is
    the event's ``k`` property minus 50.
    """
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("symbol"),
        timefmt.iso_format("ts").alias("timestamp"),
        timefmt.iso_format(F.date_trunc("day", "ts")).alias("date"),
        F.col("value").alias("price"), F.col("value").alias("open"),
        F.col("value").alias("high"), F.col("value").alias("low"),
        F.col("user_id").cast("double").alias("volume"),
        (F.get_json_object("props", "$.k").cast("double") - F.lit(50.0)).alias("change_percent"))


# How each bar symbol writes its volume cell (the CSV feed
# uses every one of these styles).
VOLUME_STYLE = {
    "1-URGENT": "commas",
    "2-HIGH": "K",
    "3-MEDIUM": "M",
    "4-NOT SPECIFIED": "B",
    "5-LOW": "commas+K",
}


def volume_text(v: str = "volume", symbol: str = "symbol"):
    x = F.col(v)
    s = F.col(symbol)
    return (F.when(s == "2-HIGH", F.concat(F.format_string("%.5f", x / 1e3), F.lit("K")))
            .when(s == "3-MEDIUM", F.concat(F.format_string("%.8f", x / 1e6), F.lit("M")))
            .when(s == "4-NOT SPECIFIED", F.concat(F.format_string("%.11f", x / 1e9), F.lit("B")))
            .when(s == "5-LOW", F.concat(F.format_number(x, 2), F.lit("K")))
            .otherwise(F.format_number(x, 2)))


def bars_as_csv_text(b: DataFrame) -> DataFrame:
    """Bars rendered as CSV export cells: ``12/31/2023``, ``64,036.50``, ``4.96%``."""
    return b.select(
        "symbol",
        F.date_format("date", "MM/dd/yyyy").alias("Date"),
        F.format_number("price", 2).alias("Price"),
        F.format_number("open", 2).alias("Open"),
        F.format_number("high", 2).alias("High"),
        F.format_number("low", 2).alias("Low"),
        volume_text().alias("Vol."),
        F.concat(F.format_string("%.2f", F.col("change_percent")), F.lit("%")).alias("Change %"),
    ).select("symbol", *[F.col(f"`{c}`") for c in CSV_COLUMNS])


# How each bar symbol's feed writes its dates.
DATE_STYLE = {"1-URGENT": "MM/dd/yyyy", "2-HIGH": "dd/MM/yyyy", "3-MEDIUM": "yyyy-MM-dd",
              "4-NOT SPECIFIED": "MMM d, yyyy", "5-LOW": "d.M.yyyy"}


def bars_by_feed(b: DataFrame) -> DataFrame:
    """CSV cells with a ``feed`` column (the symbol), each feed with its own date layout."""
    day = F.to_date("Date", "MM/dd/yyyy")
    shown = F.coalesce(*[F.when(F.col("symbol") == s, F.date_format(day, f)) for s, f in DATE_STYLE.items()], F.col("Date"))
    return bars_as_csv_text(b).withColumn("Date", shown).withColumnRenamed("symbol", "feed")


def bars_as_history_payloads(b: DataFrame) -> DataFrame:
    """One payload document per symbol and month, JSON text in ``value``.

    Pages are bounded (at most one entry per day), like the feed's own page
    limit, so no document grows with the history.
    """
    entry = F.struct(
        F.unix_timestamp(F.col("date").cast("timestamp")).alias("time"),
        "open", "high", "low", F.col("price").alias("close"),
        F.col("volume").alias("volumeto"))
    pages = b.groupBy("symbol", F.date_trunc("month", "date").alias("month")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries"))
    return pages.select(F.to_json(F.struct(
        F.col("symbol").alias("Symbol"),
        F.struct(F.col("entries").alias("Data")).alias("Data"))).alias("value"))


def dirty_csv_text(b: DataFrame) -> DataFrame:
    """CSV bars with bad and unusual cells by day of the year, and a ``note`` with quotes and commas.

    Every 20th day: 3 unreadable price (row dropped), 7 unpadded date, 9 date
    with slashes year first, 11 no volume (0.0), 13 empty change (row
    dropped), 17 a date that is none (row dropped).
    """
    day = F.to_date("Date", "MM/dd/yyyy")
    k = F.dayofyear(day) % 20
    date = (F.when(k == 7, F.date_format(day, "M/d/yyyy")).when(k == 9, F.date_format(day, "yyyy/MM/dd"))
            .when(k == 17, F.lit("someday")).otherwise(F.col("Date")))
    cells = {"Date": date, "Price": F.when(k == 3, F.lit("n/a")).otherwise(F.col("Price")),
             "Vol.": F.when(k == 11, F.lit("-")).otherwise(F.col("`Vol.`")),
             "Change %": F.when(k == 13, F.lit("")).otherwise(F.col("`Change %`"))}
    note = F.concat(F.lit('say "'), F.col("symbol"), F.lit('", ok'))
    return b.select("symbol", note.alias("note"), *[cells.get(c, F.col(f"`{c}`")).alias(c) for c in CSV_COLUMNS])
