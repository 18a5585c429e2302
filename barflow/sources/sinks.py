"""Sinks for reports, decisions and model artifacts; Spark's committer makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.ratios import nearest
from barflow.sources.adapters import DAY, HOUR, MINUTE


def minute_text(ms: F.Column) -> F.Column:
    """'YYYY-MM-DD HH:MM' in UTC of milliseconds, whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY).cast("int")).cast("string")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(day, F.lit(" "), two(F.pmod(ms, F.lit(DAY)) / HOUR), F.lit(":"), two(F.pmod(ms, F.lit(HOUR)) / MINUTE))


def append_decisions(decisions: DataFrame, path: str) -> None:
    """One JSON object for each decision, appended."""
    decisions.write.mode("append").json(path)


def write_report(trades: DataFrame, equity: DataFrame, summary: DataFrame, path: str) -> None:
    """trades and equity as CSV with readable times, equity rounded to four digits, summary as JSON; the folders are replaced."""
    timed = trades.withColumn("entry_time", minute_text(F.col("entry_time"))).withColumn("exit_time", minute_text(F.col("exit_time")))
    timed.write.mode("overwrite").option("header", True).csv(f"{path}/trades")
    equity.select("run", "symbol", minute_text(F.col("t")).alias("time"), nearest(F.col("equity"), 4).alias("equity")).write.mode("overwrite").option("header", True).csv(f"{path}/equity")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What :func:`write_report` wrote."""
    csv = spark.read.option("header", True)
    curve = csv.schema("run string, symbol string, time string, equity double").csv(f"{path}/equity")
    return csv.option("inferSchema", True).csv(f"{path}/trades"), curve, spark.read.json(f"{path}/summary")
