"""Normalisation of raw bars into the message schema.

CSV history: text cells typed by expressions, rows with any missing value
dropped, sorted by market date. REST history: payload entries projected to
the same fields (no change percent in that feed). Both end as messages with
a send-time stamp, ready to publish.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticksmith.functions import text, timefmt
from ticksmith.operators import series
from ticksmith.schema import BAR_FIELDS, CSV_COLUMNS

# The CSV price cells (thousands separators, no suffix).
PRICE_CELLS = ["Price", "Open", "High", "Low"]


_LAYOUT = "_layout"


def elect_layouts(raw: DataFrame, by: Sequence[str], formats: Sequence[str] | None = None,
                  cell: str = "Date") -> DataFrame:
    """The date layout of each source: ``by``, ``layout``.

    A source (a file, a feed: ``by``) writes its dates one way. Its layout is the
    one that reads all its non-empty cells; ``03/04/2024`` alone does not tell,
    but a thirteenth of a month anywhere in the source does. If several layouts
    read every cell, they must read each alike. NULL: the source has no date cell.
    A source that no layout reads whole, or that several read differently, is an
    error, raised when the result is used. One partial aggregate, so a source may
    hold any share of the rows.
    """
    formats = list(formats or [*text.DATE_FORMATS, *text.DAY_FIRST_FORMATS])
    cells = raw.select(*by, text.strip(cell).alias("_cell")).where("_cell <> ''")
    read = cells.select(*by, *[F.try_to_timestamp("_cell", F.lit(f)).alias(f"_d{i}") for i, f in enumerate(formats)])
    pairs = [(i, j) for j in range(len(formats)) for i in range(j)]
    votes = read.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(f"_d{i}").alias(f"_r{i}") for i in range(len(formats))],
        *[F.count_if(F.col(f"_d{i}") == F.col(f"_d{j}")).alias(f"_e{i}_{j}") for i, j in pairs])
    wins = [F.col(f"_r{i}") == F.col("_n") for i in range(len(formats))]
    clash = F.lit(False)
    for i, j in pairs:
        clash = clash | (wins[i] & wins[j] & (F.col(f"_e{i}_{j}") < F.col("_n")))
    layout = F.coalesce(*[F.when(win, F.lit(f)) for win, f in zip(wins, formats)])
    source = F.concat_ws(", ", *[F.col(c).cast("string") for c in by])
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), source)).cast("string")
    return votes.select(*by, F.when(clash, fail("several date layouts fit the source"))
                        .when(layout.isNull(), fail("no date layout fits all of the source")).otherwise(layout).alias("layout"))


def _with_layout(raw: DataFrame, by: Sequence[str], formats: Sequence[str]) -> DataFrame:
    elected = elect_layouts(raw, by, formats).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("layout").alias(_LAYOUT))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return raw.join(elected, same, "left").drop(*[f"_by_{c}" for c in by])


def _typed(raw: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """All rows: extra columns, typed columns, and the date cell as ``_date``.

    Two projections: the first cleans each cell once (strip, separators,
    suffix), the second parses the cleaned text. Kept apart, every regular
    expression runs once per cell and the generated code stays small.
    """
    extra = [c for c in raw.columns if c not in CSV_COLUMNS and c != _LAYOUT]
    elected = [_LAYOUT] if _LAYOUT in raw.columns else []
    date = text.parse_date_as("_date", _LAYOUT, list(formats)) if elected else text.parse_market_date("_date", stripped=True)
    vol_body, vol_factor = text.volume_parts(F.col("`Vol.`"))
    cleaned = raw.select(
        *[F.col(f"`{c}`") for c in extra], *elected,
        text.strip("Date").alias("_date"),
        *[text.strip(F.replace(F.col(c), F.lit(","), F.lit(""))).alias(f"_{c}") for c in PRICE_CELLS],
        vol_body.alias("_vol"), vol_factor.alias("_vol_f"),
        text.strip(F.replace(F.col("`Change %`"), F.lit("%"), F.lit(""))).alias("_chg"),
    )
    return cleaned.select(
        *[F.col(f"`{c}`") for c in extra], "_date",
        date.alias("date"),
        *[text.nan_to_null(text.py_float(f"_{c}", stripped=True)).alias(c.lower()) for c in PRICE_CELLS],
        text.volume_from_parts("_vol", "_vol_f").alias("volume"),
        text.nan_to_null(text.py_float("_chg", stripped=True)).alias("change_percent"),
    )


def normalize_csv_bars(raw: DataFrame, sort: bool = True,
                       tiebreak: Sequence[str] = (), mode: str = "drop",
                       layout_by: Sequence[str] = (), formats: Sequence[str] | None = None) -> DataFrame:
    """CSV text bars -> ``date, price, open, high, low, volume, change_percent``.

    Extra columns are kept as they are and, like the typed ones, a NULL or
    NaN in any of them drops the row (``rejected_csv_bars`` has those rows).
    Volume never drops a row: bad or missing volume is 0.0.
    ``mode="failfast"`` raises on a date that no layout fits, instead of
    dropping its row. ``sort=False`` spares the range shuffle where the sink
    needs no order. ``layout_by`` names columns that tell the sources apart (a
    feed, or ``_metadata.file_path`` as a column): each source's dates are then
    read by its one layout (``elect_layouts`` over ``formats``), day-first ones too.
    """
    if mode not in ("drop", "failfast"):
        raise ValueError("mode is 'drop' or 'failfast'")
    extra = [c for c in raw.columns if c not in CSV_COLUMNS]
    if layout_by:
        formats = list(formats or [*text.DATE_FORMATS, *text.DAY_FIRST_FORMATS])
        typed = _typed(_with_layout(raw, layout_by, formats), formats)
    else:
        typed = _typed(raw)
    if mode == "failfast":
        bad = F.raise_error(F.concat(F.lit("no date layout fits "), F.coalesce("_date", F.lit("an empty cell"))))
        typed = typed.withColumn("date", F.coalesce("date", bad.cast("timestamp")))
    typed = typed.drop("_date").na.drop(how="any")
    if sort:
        typed = typed.orderBy("date", *(tiebreak or extra))
    return typed


def rejected_csv_bars(raw: DataFrame) -> DataFrame:
    """The rows of ``raw``, as text, that ``normalize_csv_bars`` drops."""
    marked = raw.withColumn("_raw", F.struct(*[F.col(f"`{c}`") for c in raw.columns]))
    names = [f.lower() for f in PRICE_CELLS] + ["date", "change_percent", *[c for c in raw.columns if c not in CSV_COLUMNS]]
    missing = F.lit(False)
    for c in names:
        missing = missing | F.col(f"`{c}`").isNull()
    return _typed(marked).where(missing).select("_raw.*")


def history_bars(entries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """REST entries -> bar fields; ``close`` is the price, ``volumeto`` the volume.

    ``volumeto`` is quote-currency volume where the CSV's ``Vol.`` is base
    units: the two feeds' volumes are not comparable. ``change_percent`` is
    absent from this feed and stays NULL.
    """
    return entries.select(
        *keep,
        timefmt.epoch_seconds("time").alias("date"),
        F.col("close").alias("price"), "open", "high", "low",
        F.col("volumeto").alias("volume"),
        F.lit(None).cast("double").alias("change_percent"))


def to_messages(bars: DataFrame, sent_at: Column | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """Bars -> message fields: ISO ``timestamp`` (send time) and ``date``.

    ``sent_at`` defaults to ``current_timestamp()``, one value per job: no
    event-time window closes over such messages. Pass a column (the bar's
    date, or ``stamped``'s) for a stamp per row.
    """
    stamp = sent_at if sent_at is not None else F.current_timestamp()
    return bars.select(
        *keep,
        timefmt.iso_format(stamp).alias("timestamp"),
        timefmt.iso_format("date").alias("date"),
        *[F.col(c).cast("double").alias(c) for c in BAR_FIELDS[2:]])


def stamped(bars: DataFrame, start: str, step_seconds: float = 1.0, order: Sequence[str] = ("date",),
            name: str = "sent_at") -> DataFrame:
    """``bars`` with a send time per row: ``start`` plus the row's place in ``order`` times ``step_seconds``.

    The paced replay's stamps without its waiting; places are numbered by
    range partitions, not in one task.
    """
    placed = series.with_global_position(bars, (), order)
    micros = F.round(F.col(series.POS) * F.lit(step_seconds * 1e6)).cast("long")
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + micros)
    return placed.withColumn(name, at).drop(series.POS)
