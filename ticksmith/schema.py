"""Explicit schemas for every message, file and result the engine handles."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, DoubleType, LongType, StringType, StructField, StructType,
    TimestampType,
)

# The bar message as it travels between producer and engine
# (field names, order and types must equal the reference's topic schema).
BAR_FIELDS = ["timestamp", "date", "price", "open", "high", "low", "volume", "change_percent"]

BAR_MESSAGE = StructType([
    StructField("timestamp", StringType(), True),
    StructField("date", StringType(), True),
    StructField("price", DoubleType(), True),
    StructField("open", DoubleType(), True),
    StructField("high", DoubleType(), True),
    StructField("low", DoubleType(), True),
    StructField("volume", DoubleType(), True),
    StructField("change_percent", DoubleType(), True),
])

# Bar messages that name their instrument (several instruments on one topic).
KEYED_BAR_MESSAGE = StructType(BAR_MESSAGE.fields + [StructField("symbol", StringType(), True)])

# CSV header of a price-history export, read all as text.
CSV_COLUMNS = ["Date", "Price", "Open", "High", "Low", "Vol.", "Change %"]

# REST daily-history payload, Data.Data[] of OHLC objects.
HISTORY_ENTRY = StructType([
    StructField("time", LongType(), True),
    StructField("open", DoubleType(), True),
    StructField("high", DoubleType(), True),
    StructField("low", DoubleType(), True),
    StructField("close", DoubleType(), True),
    StructField("volumeto", DoubleType(), True),
])

HISTORY_PAYLOAD = StructType([
    StructField("Data", StructType([
        StructField("Data", ArrayType(HISTORY_ENTRY), True),
    ]), True),
])

# Windowed results (time windows, not row windows).
SMA_RESULT = StructType([
    StructField("window_start", TimestampType(), True),
    StructField("window_end", TimestampType(), True),
    StructField("sma_20", DoubleType(), True),
])

BB_RESULT = StructType([
    StructField("window_start", TimestampType(), True),
    StructField("window_end", TimestampType(), True),
    StructField("bb_middle", DoubleType(), True),
    StructField("bb_std", DoubleType(), True),
    StructField("bb_upper", DoubleType(), True),
    StructField("bb_lower", DoubleType(), True),
])

# Recent-rows tables add the receive time.
PROCESSED_AT = "processed_at"

RESULT_SCHEMAS = {"price": BAR_MESSAGE, "sma": SMA_RESULT, "bb": BB_RESULT}
