"""Short forms for catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.ratios import nearest
from barflow.sources import adapters as A

M15 = 15 * A.MINUTE
HORIZONS = (1, 5, 15)
YEAR_BARS = 525_600.0


def r(column, digits: int = 6) -> F.Column:
    """Rounded as the SQL does."""
    return nearest(F.col(column) if isinstance(column, str) else column, digits)


def pick(df: DataFrame, keys: str, values, digits: int = 6) -> DataFrame:
    return df.select(*keys.split(), *[r(F.col(v), digits).alias(v) for v in (values.split() if isinstance(values, str) else values)])


def rounded(names, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{n}, {digits}) + 0.0 AS {n}" for n in (names.split() if isinstance(names, str) else names))


W = "PARTITION BY symbol ORDER BY open_time"


def back(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


NUMBERED = f"numbered AS (SELECT *, row_number() OVER ({W}) - 1 AS rn FROM bars)"

def features_sql(interval: int = A.MINUTE) -> str:
    """Fourteen features; the recurrences run row by row."""
    return f"""{A.sql_bars(interval)}, {NUMBERED},
steps AS (SELECT symbol, rn, open_time, close AS c, close AS e12, close AS e26, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss, high - low AS atr FROM numbered WHERE rn = 0
  UNION ALL
  SELECT n.symbol, n.rn, n.open_time, n.close, s.e12 + (n.close - s.e12) * (2.0::DOUBLE / 13), s.e26 + (n.close - s.e26) * (2.0::DOUBLE / 27),
    s.sig + 0.2::DOUBLE * ((s.e12 + (n.close - s.e12) * (2.0::DOUBLE / 13)) - (s.e26 + (n.close - s.e26) * (2.0::DOUBLE / 27)) - s.sig),
    CASE WHEN n.rn = 1 THEN greatest(n.close - s.c, 0) ELSE s.gain + (greatest(n.close - s.c, 0) - s.gain) / 14 END,
    CASE WHEN n.rn = 1 THEN greatest(s.c - n.close, 0) ELSE s.loss + (greatest(s.c - n.close, 0) - s.loss) / 14 END,
    s.atr + (greatest(n.high - n.low, abs(n.high - s.c), abs(n.low - s.c)) - s.atr) / 14
  FROM steps s JOIN numbered n ON n.symbol = s.symbol AND n.rn = s.rn + 1),
looks AS (SELECT *, ln(close / lag(close, 1) OVER ({W})) AS ret_1, ln(close / lag(close, 5) OVER ({W})) AS ret_5, ln(close / lag(close, 15) OVER ({W})) AS ret_15,
  avg(close) OVER {back(20)} AS ma20, stddev_samp(close) OVER {back(20)} AS sd20, avg(close) OVER {back(50)} AS ma50, avg(volume) OVER {back(20)} AS v20, avg(trades) OVER {back(20)} AS n20 FROM numbered),
wide AS (SELECT *, stddev_samp(ret_1) OVER {back(20)} AS rvol_20 FROM looks),
features AS (SELECT w.symbol, w.open_time, w.close_time, w.open, w.high, w.low, w.close, w.volume, w.trades, w.taker, w.rn, w.rn >= 63 AS valid, ret_1, ret_5, ret_15, rvol_20,
  CASE WHEN sd20 > 0 THEN (close - ma20) / sd20 ELSE 0 END AS bb_z_20, close / ma50 - 1 AS dist_ma_50, atr / close AS atr_pct_14,
  CASE WHEN gain + loss > 0 THEN (100 * gain / (gain + loss) - 50) / 50 ELSE 0 END AS rsi_14, (e12 - e26 - sig) / close AS macd_hist_pct,
  ln((volume + 1e-9) / (v20 + 1e-9)) AS rel_volume, (high - low) / close AS range_pct, CASE WHEN high > low THEN (close - open) / (high - low) ELSE 0 END AS body_ratio,
  CASE WHEN volume > 0 THEN taker / volume - 0.5 ELSE 0 END AS taker_imbalance, ln((trades + 1.0) / (n20 + 1.0)) AS rel_trades
  FROM wide w JOIN steps s USING (symbol, rn))"""


FEATURES_SQL = features_sql()
