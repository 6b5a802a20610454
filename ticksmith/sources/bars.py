"""Batch sources: CSV price history and REST daily-history payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ticksmith.schema import CSV_COLUMNS, HISTORY_PAYLOAD


def check_columns(columns: list[str], required: list[str] = CSV_COLUMNS) -> None:
    """Raise before any job runs when a required column is missing."""
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"the CSV header lacks {missing}; it needs {required}")


def read_csv_text(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV with a header row, every cell as text (typing is done by expressions).

    A quote inside a quoted cell is doubled. ``multiline=True`` allows line
    breaks inside quoted cells; a file is then read by one task. Only the
    header is read to learn the column names; no schema inference pass over
    the data.
    """
    df = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
          .option("multiLine", multiline).option("mode", "PERMISSIVE").csv(path))
    check_columns(df.columns)
    return df


def history_entries(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Payload rows (``Data.Data`` array of OHLC objects) -> one row per entry.

    ``keep`` names top-level payload fields copied onto every entry.
    """
    return (payloads.select(*keep, F.explode(F.col("Data.Data")).alias("e"))
            .select(*keep, "e.time", "e.open", "e.high", "e.low", "e.close", "e.volumeto"))


def payload_schema(keep: tuple[str, ...] = ()) -> StructType:
    return StructType([StructField(k, StringType(), True) for k in keep] + HISTORY_PAYLOAD.fields)


def read_history(spark: SparkSession, path: str, multiline: bool = True,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Landed history payload files -> entries.

    ``multiline=True`` for one pretty-printed document per file, ``False``
    for JSON Lines (one payload per line, split across tasks).
    """
    payloads = spark.read.schema(payload_schema(keep)).option("multiLine", multiline).json(path)
    return history_entries(payloads, keep)
