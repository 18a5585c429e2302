"""Scoring closed bars with versioned models over windows of raw features."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.signals import decide_signal, expected_prices
from barflow.operators.learning import clipped
from barflow.plans.blocks import blocked, numbered
from barflow.sources.frames import last_n
from barflow.streaming.runner import KEPT_VERSIONS, forget

CLIP = 5.0


def write_model(spark: SparkSession, path: str, version: int, model: dict) -> None:
    """Add a version to the model table; older ones stay, so running streams and late readers keep theirs.

    A model has inputs, lookback, horizons, mean and std (one an input), weights (by horizon, lag and input), bias, scale and sigma (one a horizon).
    Numbers that JSON has none for, as NaN, are written as their names.
    """
    body = json.loads(json.dumps(model), parse_constant=str)
    spark.createDataFrame([(version, json.dumps(body))], "version int, body string").coalesce(1).write.mode("append").parquet(path)


def latest_model(spark: SparkSession, path: str, inputs: list[str]) -> dict | None:
    """The newest model whose inputs are ``inputs``; incompatible versions are passed over. One row comes to the driver."""
    rows = spark.read.schema("version int, body string").parquet(path).where(F.get_json_object("body", "$.inputs") == json.dumps(inputs, separators=(",", ":")))
    best = rows.orderBy(F.desc("version")).first()
    return None if best is None else json.loads(best["body"]) | {"version": best["version"]}


def window_scores(raw: np.ndarray, model: dict) -> np.ndarray:
    """Log returns expected after each row that ends a full window of ``raw`` (a row a bar, a column an input): rows - lookback + 1 by horizons.

    Rows come without nulls; NaN counts as the greatest number. Every lag of every input has a weight of its own: a causal convolution, one
    product of all rows with the weights of a lag at a time, so that no window is ever copied.
    """
    mean, std, weights, bias, scale = (np.array(model[k], float) for k in ("mean", "std", "weights", "bias", "scale"))
    z = clipped(raw, mean, std, CLIP)
    last = model["lookback"] - 1
    out = np.tile(bias, (len(z) - last, 1))
    for lag in range(last + 1):
        out += z[last - lag : len(z) - lag] @ weights[:, lag].T
    return out * scale


def score(rows: DataFrame, model: dict) -> DataFrame:
    """(symbol, open_time, close, exp, exp_price, signal, horizon, edge_bps, model_version) of the rows that end a full window, with all horizons in exp and exp_price.

    ``rows``: symbol, open_time, close and the model's inputs, raw: a new model needs no inverse of an old scaling. Windows are views within blocks of a
    symbol that take along the rows before them, so no window is ever a row and no symbol a task. A null counts as 0.
    """
    inputs, back = model["inputs"], model["lookback"] - 1

    def each(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rn")
        own = block.iloc[back:]
        made = list(window_scores(block[inputs].to_numpy(float), model)) if len(own) else []
        return pd.DataFrame({"symbol": own["symbol"], "open_time": own["open_time"], "close": own["close"], "exp": pd.Series(made, own.index, object), "own": own["home_"] == own["block_"]})

    kept = rows.select("symbol", "open_time", "close", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in inputs])
    b = blocked(numbered(kept), back)
    made = b.rows.groupBy("symbol", "block_").applyInPandas(each, "symbol string, open_time long, close double, exp array<double>, own boolean").where("own")
    made = made.withColumn("exp", F.transform("exp", lambda x: F.coalesce(x, F.lit(float("nan")))))  # pandas hands over NaN in arrays as null
    sigma, horizons = F.array(*[F.lit(float(x)) for x in model["sigma"]]), F.array(*map(F.lit, model["horizons"]))
    decided = made.withColumn("d_", decide_signal(F.col("exp"), sigma, horizons, 8.0))
    return decided.select("symbol", "open_time", "close", "exp", expected_prices(F.col("close"), F.col("exp")).alias("exp_price"), "d_.*", F.lit(model.get("version")).cast("int").alias("model_version"))


def stream_scores(rows: DataFrame, model_path: str, inputs: list[str], out: str, state: str, checkpoint: str, lookback: int) -> None:
    """Score a stream of feature rows; every micro-batch reads the newest compatible model, so a new version takes effect without a restart.

    The last ``lookback`` - 1 raw rows of each symbol are kept between micro-batches, as a version of the ``state`` folder for each; a broken
    micro-batch is done again from the version before it. Versions that no micro-batch can ask for any more are deleted.
    """
    spark = rows.sparkSession
    columns = ["symbol", "open_time", "close", *inputs]

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.select(*columns)
        before = spark.read.schema(fresh.schema).parquet(f"{state}/batch={number - 1}") if number else fresh.limit(0)
        both = before.unionByName(fresh)
        model = latest_model(spark, model_path, inputs)
        if model is not None:
            score(both, model).join(before.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti").write.mode("overwrite").parquet(f"{out}/batch={number}")
        last_n(both, "symbol", ["open_time"], lookback - 1).write.mode("overwrite").parquet(f"{state}/batch={number}")
        forget(spark, f"{state}/batch={number - KEPT_VERSIONS}")

    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
