"""The logical market tables, derived from an ``events`` table of timestamped values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, MINUTE, DAY = 3_600_000, 60_000, 86_400_000


def epoch_ms(ts: str) -> F.Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(
        f"datediff(CAST({ts} AS DATE), DATE'1970-01-01') * {DAY}L + hour({ts}) * {HOUR}L + minute({ts}) * {MINUTE}L"
        f" + CAST(floor(extract(SECOND FROM {ts}) * 1000) AS BIGINT)"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trade_id, price, qty, is_buyer_maker, trade_time."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"), F.col("value").alias("price"),
        (1 + F.col("user_id") % 10).cast("double").alias("qty"), (F.col("event_id") % 2 == 1).alias("is_buyer_maker"), epoch_ms("ts").alias("trade_time"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, update_id, book_time, bid, bid_qty, ask, ask_qty."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("update_id"), epoch_ms("ts").alias("book_time"), F.col("value").alias("bid"),
        (1 + k % 17).cast("double").alias("bid_qty"), (F.col("value") * 1.001).alias("ask"), (1 + F.col("user_id") % 13).cast("double").alias("ask_qty"),
    )


def bars_of(trade_rows: DataFrame, interval: int) -> DataFrame:
    """Bars of ``interval`` milliseconds: one row per symbol and bucket that has a trade."""
    bucket = F.col("trade_time") - F.col("trade_time") % interval
    grouped = trade_rows.groupBy("symbol", bucket.alias("open_time")).agg(
        F.min_by("price", F.struct("trade_time", "trade_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("trade_time", "trade_id")).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trades"),
        F.sum(F.when(~F.col("is_buyer_maker"), F.col("qty")).otherwise(0.0)).alias("taker"),
    )
    return grouped.withColumn("close_time", F.col("open_time") + interval - 1)


def bars(spark: SparkSession, sf_dir: str, interval: int = MINUTE) -> DataFrame:
    return bars_of(trades(spark, sf_dir), interval)


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency samples: service, metric, ns, ts."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("service"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("metric"),
        F.floor(F.col("value") * 1000).cast("long").alias("ns"), epoch_ms("ts").alias("ts"), F.col("event_id").alias("seq"),
    )


#: The same tables as DuckDB common table expressions.
SQL_TRADES = """trades AS (SELECT event_type AS symbol, event_id AS trade_id, value AS price, CAST(1 + user_id % 10 AS DOUBLE) AS qty,
  event_id % 2 = 1 AS is_buyer_maker, epoch_us(ts) // 1000 AS trade_time FROM events)"""
SQL_BOOKS = """books AS (SELECT event_type AS symbol, event_id AS update_id, epoch_us(ts) // 1000 AS book_time, value AS bid,
  CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 17 AS DOUBLE) AS bid_qty, value * 1.001::DOUBLE AS ask, CAST(1 + user_id % 13 AS DOUBLE) AS ask_qty FROM events)"""
SQL_SERVICES = "services AS (SELECT event_type AS service, 'm' || (user_id % 3) AS metric, CAST(floor(value * 1000) AS BIGINT) AS ns, epoch_us(ts) // 1000 AS ts, event_id AS seq FROM events)"


def sql_bars(interval: int = MINUTE) -> str:
    return f"""{SQL_TRADES},
bars AS (SELECT symbol, trade_time - trade_time % {interval} AS open_time, arg_min(price, (trade_time, trade_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (trade_time, trade_id)) AS close, sum(qty) AS volume, count(*) AS trades, sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0 END) AS taker,
  trade_time - trade_time % {interval} + {interval - 1} AS close_time FROM trades GROUP BY ALL)"""
