"""Independent SQL (DuckDB dialect) for each registered query.

Written from the definitions, not from the Spark plans: plain window
functions for the row indicators, ``generate_series`` for sliding windows,
and recursive CTEs for the EMA recursion. Column names equal the Spark
queries'.
"""

from __future__ import annotations


def _iso(c: str) -> str:
    """``isoformat()`` text of a timestamp: fraction only when non-zero."""
    return (f"(strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({c}) % 1000000 <> 0 "
            f"THEN strftime({c}, '.%f') ELSE '' END)")


def _alpha(span: int) -> str:
    return f"(CAST(2 AS DOUBLE) / {span + 1})"


def _q(span: int) -> str:
    return f"(1 - {_alpha(span)})"


TICKS = "SELECT event_type AS symbol, ts, event_id AS seq, value AS price FROM events"

MSGS = (f"SELECT event_id AS seq, event_type AS symbol, {_iso('ts')} AS timestamp, "
        "strftime(ts, '%Y-%m-%dT00:00:00') AS date, value AS price, value AS open, "
        "value AS high, value AS low, CAST(user_id AS DOUBLE) AS volume, "
        "CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50.0 AS change_percent FROM events")

BARS = ("SELECT symbol, date, open, high, low, price, volume, "
        "round(100.0 * (price - open) / open, 2) + 0.0 AS change_percent FROM ("
        "SELECT o_orderpriority AS symbol, o_orderdate AS date, "
        "arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, "
        "min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS price, "
        "sum(round(o_totalprice * 100)) / 100 AS volume "
        "FROM orders GROUP BY o_orderpriority, o_orderdate)")

MSG_COLS = "seq, symbol, timestamp, date, price, volume, change_percent"

_SLIDES = ("SELECT {keys} value, unnest(generate_series(time_bucket(INTERVAL '1 minute', ts) - "
           "INTERVAL '4 minutes', time_bucket(INTERVAL '1 minute', ts), INTERVAL '1 minute')) "
           "AS window_start FROM events WHERE ts IS NOT NULL")


def _sliding(stats: str, keys: str = "", where: str = "") -> str:
    k = f"{keys}, " if keys else ""
    sel = {
        "sma": "round(avg(value), 6) AS sma_20",
        "bands": ("round(avg(value), 6) AS bb_middle, round(stddev_samp(value), 6) AS bb_std, "
                  "round(avg(value) + 2 * stddev_samp(value), 6) AS bb_upper, "
                  "round(avg(value) - 2 * stddev_samp(value), 6) AS bb_lower"),
    }[stats]
    src = _SLIDES.format(keys=f"event_type AS {keys}, " if keys else "")
    sql = (f"SELECT * FROM (SELECT {k}window_start, window_start + INTERVAL '5 minutes' AS window_end, "
           f"{sel} FROM ({src}) x GROUP BY {k}window_start) y")
    return sql + (f" WHERE {where}" if where else "")


_STREAM_DONE = ("window_end <= (SELECT date_trunc('millisecond', max(ts)) FROM events) "
                "- INTERVAL '10 minutes'")

_W = "PARTITION BY event_type ORDER BY ts, event_id"


def _frame(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, n: int, expr: str = "value") -> str:
    return f"CASE WHEN count({expr}) OVER {_frame(n)} >= {n} THEN {agg}({expr}) OVER {_frame(n)} END"


def _rolling(out_cols: str) -> str:
    return f"SELECT event_type AS symbol, ts, event_id AS seq, value AS price, {out_cols} FROM events"


_RSI = (
    "WITH d AS (SELECT *, value - lag(value) OVER (" + _W + ") AS delta FROM events), "
    "g AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, "
    "CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss FROM d), "
    "m AS (SELECT *, avg(gain) OVER w AS ag, avg(loss) OVER w AS al, count(*) OVER w AS n FROM g "
    "WINDOW w AS (" + _W + " ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) "
    "SELECT event_type AS symbol, ts, event_id AS seq, value AS price, "
    "CASE WHEN n >= 14 THEN CASE WHEN al > 0 THEN round(100 - 100 / (1 + ag / al), 6) "
    "WHEN ag > 0 THEN 100.0 END END AS {out} FROM m")

_PRICE_RSI = (
    "WITH m AS (SELECT *, avg(CASE WHEN value > 0 THEN value ELSE 0 END) OVER w AS pg, "
    "-avg(CASE WHEN value < 0 THEN value ELSE 0 END) OVER w AS nl, count(value) OVER w AS n "
    "FROM events WINDOW w AS (" + _W + " ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) "
    "SELECT event_type AS symbol, ts, event_id AS seq, value AS price, "
    "CASE WHEN n >= 14 THEN CASE WHEN nl > 0 THEN round(100 - 100 / (1 + pg / nl), 6) "
    "WHEN pg > 0 THEN 100.0 END END AS rsi_price_level FROM m")

_SEQ = ("s AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, "
        "row_number() OVER (" + _W + ") AS rn FROM events WHERE value IS NOT NULL)")

# The chart's visible slice: each symbol's last 100 rows, renumbered.
_SLICE = ("s0 AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, "
          "row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back "
          "FROM events WHERE value IS NOT NULL), "
          "s AS (SELECT symbol, ts, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) "
          "AS rn FROM s0 WHERE back <= 100)")


def _ema_sql(span: int, out: str) -> str:
    a, q = _alpha(span), _q(span)
    return (f"WITH RECURSIVE {_SEQ}, r AS (SELECT symbol, ts, seq, price, rn, price AS e FROM s WHERE rn = 1 "
            f"UNION ALL SELECT s.symbol, s.ts, s.seq, s.price, s.rn, {a} * s.price + {q} * r.e "
            f"FROM r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1) "
            f"SELECT symbol, ts, seq, price, round(e, 6) AS {out} FROM r")


def _macd_rec(src: str = _SEQ) -> str:
    a12, q12, a26, q26, a9, q9 = _alpha(12), _q(12), _alpha(26), _q(26), _alpha(9), _q(9)
    e12 = f"({a12} * s.price + {q12} * r.e12)"
    e26 = f"({a26} * s.price + {q26} * r.e26)"
    return (f"{src}, r AS (SELECT symbol, ts, seq, price, rn, price AS e12, price AS e26, "
            f"CAST(0 AS DOUBLE) AS sig FROM s WHERE rn = 1 "
            f"UNION ALL SELECT s.symbol, s.ts, s.seq, s.price, s.rn, {e12}, {e26}, "
            f"{a9} * ({e12} - {e26}) + {q9} * r.sig FROM r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1)")


_MACD_COLS = ("round(e12, 6) AS EMA_12, round(e26, 6) AS EMA_26, round(e12 - e26, 6) AS MACD, "
              "round(sig, 6) AS MACD_signal, round((e12 - e26) - sig, 6) AS MACD_hist")

_MACD = f"WITH RECURSIVE {_macd_rec()} SELECT symbol, ts, seq, price, {_MACD_COLS} FROM r"

_FRAME = (
    f"WITH RECURSIVE {_macd_rec()}, "
    "d AS (SELECT *, value - lag(value) OVER (" + _W + ") AS delta FROM events), "
    "g AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, "
    "CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss FROM d), "
    "w AS (SELECT event_type AS symbol, event_id AS seq, "
    "avg(gain) OVER " + _frame(14) + " AS ag, avg(loss) OVER " + _frame(14) + " AS al, "
    "count(*) OVER " + _frame(14) + " AS n14, "
    + _full("avg", 20) + " AS sma20, " + _full("avg", 50) + " AS sma50, "
    + _full("stddev_samp", 20) + " AS std20 FROM g) "
    "SELECT r.symbol, r.ts, r.seq, r.price, "
    "CASE WHEN n14 >= 14 THEN CASE WHEN al > 0 THEN round(100 - 100 / (1 + ag / al), 6) "
    "WHEN ag > 0 THEN 100.0 END END AS RSI, "
    "round(sma20, 6) AS SMA_20, round(sma50, 6) AS SMA_50, round(sma20, 6) AS BB_middle, "
    "round(sma20 + 2 * std20, 6) AS BB_upper, round(sma20 - 2 * std20, 6) AS BB_lower, "
    + _MACD_COLS.replace("e12", "r.e12").replace("e26", "r.e26").replace("sig,", "r.sig,")
    .replace("- sig", "- r.sig") +
    " FROM r JOIN w ON r.symbol = w.symbol AND r.seq = w.seq")


def _snapshot(where: str = "") -> str:
    flt = f" WHERE {where}" if where else ""
    return (
        f"WITH m AS ({MSGS}), l AS (SELECT * FROM m ORDER BY seq DESC LIMIT 100), "
        f"f AS (SELECT * FROM l{flt}), "
        "z AS (SELECT arg_max(price, seq) AS price, arg_max(change_percent, seq) AS change_percent, "
        "arg_max(volume, seq) AS volume, count(*) AS n FROM f) "
        "SELECT price, change_percent, volume, "
        "CASE WHEN n = 0 THEN '$0.00' ELSE coalesce('$' || format('{:,.2f}', price), '$nan') END AS current_price, "
        "CASE WHEN n = 0 THEN '0.00%' ELSE coalesce(printf('%+.2f%%', change_percent), 'N/A') END "
        "AS price_change, "
        "CASE WHEN n = 0 THEN '$0.00' ELSE coalesce('$' || format('{:,.2f}', volume), '$nan') END AS current_volume, "
        "CASE WHEN n = 0 THEN 'N/A' WHEN change_percent >= 0 THEN 'Bullish' ELSE 'Bearish' END "
        "AS market_status FROM z")


_VOL_TEXT = (
    "CASE {sym} WHEN '2-HIGH' THEN printf('%.5f', {v} / 1000) || 'K' "
    "WHEN '3-MEDIUM' THEN printf('%.8f', {v} / 1000000) || 'M' "
    "WHEN '4-NOT SPECIFIED' THEN printf('%.11f', {v} / 1000000000) || 'B' "
    "WHEN '5-LOW' THEN format('{{:,.2f}}', {v}) || 'K' "
    "ELSE format('{{:,.2f}}', {v}) END")

_VOL_PARSE = (
    "coalesce(CASE WHEN contains({t}, 'K') THEN TRY_CAST(replace({t}, 'K', '') AS DOUBLE) * 1000 "
    "WHEN contains({t}, 'M') THEN TRY_CAST(replace({t}, 'M', '') AS DOUBLE) * 1000000 "
    "WHEN contains({t}, 'B') THEN TRY_CAST(replace({t}, 'B', '') AS DOUBLE) * 1000000000 "
    "ELSE TRY_CAST(replace({t}, ',', '') AS DOUBLE) END, 0.0)")

_EMA2 = (f"WITH RECURSIVE {_SEQ}, r AS (SELECT symbol, ts, seq, price, rn, price AS e12, price AS e26 "
         f"FROM s WHERE rn = 1 UNION ALL SELECT s.symbol, s.ts, s.seq, s.price, s.rn, "
         f"{_alpha(12)} * s.price + {_q(12)} * r.e12, {_alpha(26)} * s.price + {_q(26)} * r.e26 "
         f"FROM r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1) "
         f"SELECT symbol, ts, seq, price, round(e12, 6) AS ema_12, round(e26, 6) AS ema_26 FROM r")

_JSON_EVENTS = ("SELECT event_id, ts, event_type, value, "
                "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


def _oldest_first(sql: str, order: str, n: int) -> str:
    """The last ``n`` rows, with their place counted from the oldest of them."""
    return (f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS row FROM "
            f"(SELECT * FROM ({sql}) a ORDER BY {order} DESC LIMIT {n}) b")


def _lots(rec: dict[str, str], keyed: bool) -> str:
    """EMA recursion over all ticks, per symbol or as one series."""
    part = "PARTITION BY event_type " if keyed else ""
    return (f"WITH RECURSIVE s AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, "
            f"row_number() OVER ({part}ORDER BY ts, event_id) AS rn FROM events), "
            f"r AS (SELECT symbol, ts, seq, price, rn, " + ", ".join(f"price AS {k}" for k in rec) +
            " FROM s WHERE rn = 1 UNION ALL SELECT s.symbol, s.ts, s.seq, s.price, s.rn, " + ", ".join(rec.values()) +
            f" FROM r JOIN s ON {'s.symbol = r.symbol AND ' if keyed else ''}s.rn = r.rn + 1)")


def _step(span: int, name: str) -> str:
    return f"{_alpha(span)} * s.price + {_q(span)} * r.{name}"


_MACD_LONG = (
    "WITH RECURSIVE " + _SEQ + ", r AS (SELECT symbol, ts, seq, price, rn, price AS f, price AS w, CAST(0 AS DOUBLE) AS g "
    "FROM s WHERE rn = 1 UNION ALL SELECT s.symbol, s.ts, s.seq, s.price, s.rn, " + _step(5, "f") + ", " + _step(200, "w") +
    f", {_alpha(9)} * (({_step(5, 'f')}) - ({_step(200, 'w')})) + {_q(9)} * r.g "
    "FROM r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1) "
    "SELECT symbol, ts, seq, price, round(f, 6) AS ema_fast, round(w, 6) AS ema_slow, round(f - w, 6) AS macd, "
    "round(g, 6) AS signal, round(f - w - g, 6) AS hist FROM r")

# Ticks with a missing price at every 97th event.
_GAPPY = "(SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value) FROM events) events"


def _gaps(sql: str) -> str:
    return sql.replace("FROM events", f"FROM {_GAPPY}")


# Recursion over every row, with the last priced row's number; a gap of g rows leaves q^g of the older weight.
_DECAY = (f"WITH RECURSIVE s AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, "
          f"row_number() OVER ({_W}) AS rn FROM {_GAPPY}), "
          "r AS (SELECT symbol, ts, seq, rn, price AS e, CASE WHEN price IS NOT NULL THEN rn END AS p FROM s WHERE rn = 1 "
          "UNION ALL SELECT s.symbol, s.ts, s.seq, s.rn, CASE WHEN s.price IS NULL THEN r.e WHEN r.e IS NULL THEN s.price "
          f"ELSE (pow({_q(12)}, s.rn - r.p) * r.e + {_alpha(12)} * s.price) / (pow({_q(12)}, s.rn - r.p) + {_alpha(12)}) END, "
          "CASE WHEN s.price IS NULL THEN r.p ELSE s.rn END FROM r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1) "
          "SELECT symbol, ts, seq, round(e, 6) AS ema_12 FROM r")



def _decayed(span: int, e: str) -> str:
    left = f"pow({_q(span)}, s.rn - r.p)"
    return (f"(CASE WHEN s.price IS NULL THEN r.{e} WHEN r.{e} IS NULL THEN s.price "
            f"ELSE ({left} * r.{e} + {_alpha(span)} * s.price) / ({left} + {_alpha(span)}) END)")


# The signal starts with the first price (line and signal zero) and then moves on with every row.
_DECAY_MACD = (f"WITH RECURSIVE s AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, "
               f"row_number() OVER ({_W}) AS rn FROM {_GAPPY}), "
               "r AS (SELECT symbol, ts, seq, rn, price AS e12, price AS e26, CASE WHEN price IS NOT NULL THEN CAST(0 AS DOUBLE) END AS sig, "
               "CASE WHEN price IS NOT NULL THEN rn END AS p FROM s WHERE rn = 1 "
               f"UNION ALL SELECT s.symbol, s.ts, s.seq, s.rn, {_decayed(12, 'e12')}, {_decayed(26, 'e26')}, "
               "CASE WHEN r.sig IS NULL THEN CASE WHEN s.price IS NOT NULL THEN CAST(0 AS DOUBLE) END "
               f"ELSE {_alpha(9)} * ({_decayed(12, 'e12')} - {_decayed(26, 'e26')}) + {_q(9)} * r.sig END, "
               "CASE WHEN s.price IS NULL THEN r.p ELSE s.rn END FROM r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1) "
               f"SELECT symbol, ts, seq, {_MACD_COLS} FROM r")

_DIRTY = (f"WITH b AS ({BARS}), t AS (SELECT *, dayofyear(date) % 20 AS k, "
          + _VOL_TEXT.format(sym="symbol", v="volume") + " AS vol_text FROM b) "
          "SELECT symbol, 'say \"' || symbol || '\", ok' AS note, date, price, "
          "CASE WHEN k = 11 THEN 0.0 ELSE round(" + _VOL_PARSE.format(t="vol_text") + ", 6) END AS volume, "
          "change_percent FROM t WHERE k NOT IN (3, 13, 17)")

_WEEKS = ("SELECT time_bucket(INTERVAL '7 days', date, TIMESTAMP '1970-01-01') AS w, avg(price) AS m FROM bars GROUP BY 1")

_CHAIN = (f"WITH bars AS ({BARS}), weeks AS ({_WEEKS}), "
          "done AS (SELECT * FROM weeks WHERE w + INTERVAL '7 days' <= (SELECT max(date) FROM bars) - INTERVAL '10 minutes') "
          "SELECT 'price' AS table, count(*) AS n, round(sum(price), 2) AS total FROM bars "
          "UNION ALL SELECT 'sma', count(*), round(sum(m), 2) FROM done")

ORACLE: dict[str, str] = {
    "ema_200": _ema_sql(200, "ema_200"),
    "macd_5_200_9": _MACD_LONG,
    "bands_with_gaps": _gaps(_rolling(
        f"round({_full('avg', 20)}, 6) AS BB_middle, "
        f"round({_full('avg', 20)} + 2 * {_full('stddev_samp', 20)}, 6) AS BB_upper, "
        f"round({_full('avg', 20)} - 2 * {_full('stddev_samp', 20)}, 6) AS BB_lower")),
    "rsi_with_gaps": _gaps(_RSI.replace("{out}", "rsi")),
    "ema_with_gaps": _gaps(_ema_sql(12, "ema_12")),
    "ema_decay_gaps": _DECAY,
    "macd_decay_gaps": _DECAY_MACD,
    "layout_per_feed": f"SELECT symbol AS feed, date, price, open, high, low, change_percent FROM ({BARS}) b",
    "stream_snapshot": _snapshot(),
    "stream_indicator_frame": _FRAME,
    "stream_ema_reordered": _EMA2,
    "stream_late_rows": ("SELECT event_type AS symbol, event_id AS seq, value AS price FROM events "
                         "WHERE event_id % 5 = 0 AND ts < TIMESTAMP '2024-01-08'"),
    "stream_duplicates": f"SELECT symbol, seq, timestamp, price FROM ({MSGS}) m",
    "table_window_repeats": _sliding("sma", where=_STREAM_DONE),
    "recent_rows_arrival": (f"SELECT timestamp, date, price, volume, change_percent FROM ({MSGS}) m "
                            "ORDER BY timestamp DESC, seq DESC LIMIT 100"),
    "sma_2000": _rolling(f"round({_full('avg', 2000)}, 6) AS sma_2000"),
    "bollinger_2000": _rolling(
        f"round({_full('avg', 2000)}, 6) AS BB_middle, "
        f"round({_full('avg', 2000)} + 2 * {_full('stddev_samp', 2000)}, 6) AS BB_upper, "
        f"round({_full('avg', 2000)} - 2 * {_full('stddev_samp', 2000)}, 6) AS BB_lower"),
    "percent_ties": ("SELECT event_id, (event_id % 801 - 400) / 8.0 AS change, "
                     "printf('%+.2f%%', CAST((event_id % 801 - 400) / 8.0 AS DOUBLE)) AS shown FROM events"),
    "dirty_bars": _DIRTY,
    "stream_late_file": _sliding("sma", where=_STREAM_DONE),
    "job_chain": _CHAIN,
    "stream_ema_unkeyed": _lots({"e12": _step(12, "e12"), "e26": _step(26, "e26")}, keyed=False) +
                          " SELECT symbol, ts, seq, price, round(e12, 6) AS ema_12, round(e26, 6) AS ema_26 FROM r",
    "recent_rows_bb": ("SELECT * FROM (" + _sliding("bands", where=_STREAM_DONE) + ") z ORDER BY window_start DESC LIMIT 100"),
    "recent_rows_price": (f"SELECT timestamp, date, price, volume, change_percent FROM ({MSGS}) m ORDER BY timestamp DESC, "
                          "price DESC, volume DESC, change_percent DESC LIMIT 100"),
    "chart_bands": ("SELECT x, sma, upper, lower, row_number() OVER (ORDER BY x) - 1 AS row FROM ("
                    "SELECT window_start AS x, bb_middle AS sma, bb_upper AS upper, bb_lower AS lower FROM ("
                    + _sliding("bands") + ") z ORDER BY window_start DESC LIMIT 100) l "
                    "WHERE x >= TIMESTAMP '2024-01-30 22:00:00' AND x <= TIMESTAMP '2024-01-30 23:55:00'"),
    "sliding_sma": _sliding("sma"),
    "sliding_bands": _sliding("bands"),
    "sliding_bands_by_symbol": _sliding("bands", keys="symbol"),
    "diff": _rolling(f"round(value - lag(value) OVER ({_W}), 6) AS diff"),
    "sma_20": _rolling(f"round({_full('avg', 20)}, 6) AS sma_20"),
    "sma_50": _rolling(f"round({_full('avg', 50)}, 6) AS sma_50"),
    "bollinger_20": _rolling(
        f"round({_full('avg', 20)}, 6) AS BB_middle, "
        f"round({_full('avg', 20)} + 2 * {_full('stddev_samp', 20)}, 6) AS BB_upper, "
        f"round({_full('avg', 20)} - 2 * {_full('stddev_samp', 20)}, 6) AS BB_lower"),
    "rsi_14": _RSI.replace("{out}", "rsi"),
    "rsi_price_level": _PRICE_RSI,
    "ema_12": _ema_sql(12, "ema_12"),
    "ema_26": _ema_sql(26, "ema_26"),
    "macd": _MACD,
    "indicator_frame": _FRAME,
    "latest_n": _oldest_first(f"SELECT {MSG_COLS} FROM ({MSGS}) m", "seq", 100),
    "latest_n_per_symbol": (f"SELECT {MSG_COLS}, rank FROM (SELECT *, row_number() OVER "
                            f"(PARTITION BY symbol ORDER BY seq DESC) AS rank FROM ({MSGS}) m) x "
                            "WHERE rank <= 100"),
    "latest_then_range": (
        f"WITH b AS ({BARS}), m AS (SELECT symbol, strftime(date, '%Y-%m-%dT%H:%M:%S') AS date, "
        "price, volume, change_percent FROM b), "
        "l AS (SELECT * FROM m ORDER BY date DESC, symbol DESC LIMIT 100) "
        "SELECT symbol, date, price, volume, change_percent FROM l "
        "WHERE date >= '2001-07-20' AND date <= '2001-07-25'"),
    "date_range": (f"SELECT {MSG_COLS} FROM ({MSGS}) m "
                   "WHERE date >= '2024-01-05' AND date <= '2024-01-12'"),
    "window_range": _sliding("bands", where=(f"{_iso('window_start')} >= '2024-01-10' AND "
                                             f"{_iso('window_start')} <= '2024-01-11T06:00:00'")),
    "snapshot": _snapshot(),
    "snapshot_empty_range": _snapshot("date >= '2024-01-01' AND date <= '2024-01-02'"),
    "market_status": ("SELECT seq, change_percent, CASE WHEN change_percent >= 0 THEN 'Bullish' "
                      "ELSE 'Bearish' END AS market_status, coalesce(change_percent >= 0, false) "
                      f"AS positive FROM ({MSGS}) m"),
    "recent_trades": _oldest_first("SELECT event_id AS seq, strftime(ts, '%Y-%m-%d') AS day, "
                      "'$' || format('{:,.2f}', value) AS price_text, "
                      "'$' || format('{:,.2f}', CAST(user_id AS DOUBLE)) AS volume_text "
                      "FROM events", "seq", 5),
    "ohlc_series": f"SELECT symbol, date AS x, open, high, low, price AS close FROM ({BARS}) b",
    "price_series": "SELECT event_id AS seq, ts AS x, value AS price FROM events",
    "export_csv": _oldest_first(f"SELECT {MSG_COLS} FROM ({MSGS}) m", "seq", 100),
    "normalize_prices": ("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price_text, "
                         "o_totalprice AS price FROM orders"),
    "parse_volume": ("WITH t AS (SELECT o_orderkey, "
                     + _VOL_TEXT.format(sym="o_orderpriority", v="o_totalprice") +
                     " AS vol_text FROM orders) SELECT o_orderkey, vol_text, "
                     + _VOL_PARSE.format(t="vol_text") + " AS volume FROM t"),
    "parse_percent": (f"SELECT symbol, date, printf('%.2f', change_percent) || '%' AS pct_text, "
                      f"CAST(printf('%.2f', change_percent) AS DOUBLE) AS change_percent FROM ({BARS}) b"),
    "normalize_bars": (f"WITH b AS ({BARS}), t AS (SELECT *, "
                       + _VOL_TEXT.format(sym="symbol", v="volume") +
                       " AS vol_text FROM b) SELECT symbol, date, price, open, high, low, "
                       "round(" + _VOL_PARSE.format(t="vol_text") + ", 6) AS volume, change_percent FROM t"),
    "flatten_history": ("SELECT symbol, date, price, open, high, low, volume, "
                        f"CAST(NULL AS DOUBLE) AS change_percent FROM ({BARS}) b"),
    "json_roundtrip": _JSON_EVENTS,
    "double_encoded_json": _JSON_EVENTS,
    "stream_sliding_sma": _sliding("sma", where=_STREAM_DONE),
    "stream_sliding_bands": _sliding("bands", where=_STREAM_DONE),
    "stream_sliding_bands_by_symbol": _sliding("bands", keys="symbol", where=_STREAM_DONE),
    "stream_passthrough": ("SELECT timestamp, date, price, open, high, low, volume, change_percent "
                           f"FROM ({MSGS}) m"),
    "stream_ema": _EMA2,
    "recent_rows_sma": ("SELECT * FROM (" + _sliding("sma", where=_STREAM_DONE) +
                        ") z ORDER BY window_start DESC LIMIT 100"),
    "chart_macd": f"WITH RECURSIVE {_macd_rec(_SLICE)} SELECT symbol, ts, seq, price, {_MACD_COLS} FROM r",
    "chart_rsi": (
        f"WITH {_SLICE}, m AS (SELECT *, avg(CASE WHEN price > 0 THEN price ELSE 0 END) OVER w AS pg, "
        "-avg(CASE WHEN price < 0 THEN price ELSE 0 END) OVER w AS nl, count(price) OVER w AS n "
        "FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) "
        "SELECT symbol, ts, seq, price, CASE WHEN n >= 14 THEN CASE WHEN nl > 0 THEN "
        "round(100 - 100 / (1 + pg / nl), 6) WHEN pg > 0 THEN 100.0 END END AS RSI FROM m"),
}
