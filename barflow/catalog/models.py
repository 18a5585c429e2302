"""Models fitted and applied on the given tables, agent runs, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.catalog import query
from barflow.catalog.common import HORIZONS, YEAR_BARS, r
from barflow.catalog.ledgers import CONFIGS, WHOLE, _sql, books, curves, fed
from barflow.catalog.signals import advice_texts, normalised
from barflow.functions import signals as S
from barflow.operators import agent as B
from barflow.operators import evaluation as E
from barflow.operators import features as X
from barflow.operators import labels as L
from barflow.operators import learning as M
from barflow.operators.micro import asof
from barflow.plans.blocks import numbered
from barflow.plans.lineage import checkpointed
from barflow.plans.once import with_once
from barflow.plans.running import quantiles
from barflow.sources import adapters as A
from barflow.sources import sinks
from barflow.streaming.runner import shared_folder


def samples(spark, sf_dir, horizons=(5,)):
    rows = L.forward_returns(X.features_14(A.bars(spark, sf_dir)).where("valid").drop("rn"), horizons)
    wanted = [f"y_{h}" for h in horizons] + list(X.FEATURES)
    return checkpointed(M.finite(L.ratio_split(rows).select("symbol", "open_time", "split", *wanted), wanted))


def _scores(rows, by=("split",)):
    long_ = rows.withColumnRenamed("y_5", "y") if "y_5" in rows.columns else rows
    return E.quality(long_, list(by)).join(E.spearman(long_, list(by)).drop("n"), list(by)).select(*by, "n", r("hit_rate").alias("hit_rate"), r("r2_zero").alias("r2_zero"), r("ic").alias("ic"))


@query()
def fit_forecaster(spark, sf_dir):
    rows = samples(spark, sf_dir)
    model, scale, left = M.fit_forecaster(rows, "y_5")
    return _scores(M.predicted(model, rows, scale)).withColumn("y_scale", F.lit(scale)).withColumn("sigma", F.lit(left))


@query()
def fit_gbt_reg(spark, sf_dir):
    rows = samples(spark, sf_dir)
    model, scale = M.fit_gbt_reg(rows, "y_5")
    return _scores(M.predicted(model, rows, scale))


@query()
def fit_gbt_cls(spark, sf_dir):
    rows = samples(spark, sf_dir)
    model, size = M.fit_gbt_cls(rows, "y_5")
    return _scores(M.expected_moves(model, rows, size))


SCORES, COMPONENTS, SEEDS, COMPARED_TREES = 12, 8, (0, 1, 2), 300


def enriched(spark, sf_dir):
    """Samples beside the scores of the last advice at or before their opening and the components of an embedding, one for each sample by its place."""
    rows = samples(spark, sf_dir)
    advice = with_once(advice_texts(spark, sf_dir), "s", S.advice_scores(S.parse_advice(F.col("text")))).where("s IS NOT NULL").select("symbol", "trade_time", *[F.col("s")[i].alias(f"score_{i}") for i in range(SCORES)])
    beside = asof(rows, advice, "open_time", "trade_time", [f"score_{i}" for i in range(SCORES)]).drop("trade_time_asof").dropna(subset=["score_0"])
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id IS NOT NULL")
    made, _ = M.principal_components(vectors, "embedding", F.col("vec_id") % 10 < 7, COMPONENTS)
    parts = numbered(made.withColumn("all_", F.lit(1)), "all_", "vec_id").select("rn", *[F.col("components")[i].alias(f"component_{i}") for i in range(COMPONENTS)])
    many = parts.agg(F.count("*").alias("many_"))
    return checkpointed(beside.crossJoin(F.broadcast(many)).withColumn("rn", F.pmod(F.xxhash64("symbol", "open_time"), "many_")).join(parts, "rn").drop("rn", "many_"))


@query()
def feature_set_compare(spark, sf_dir):
    """Test scores of four sets of inputs, each the mean of three seeds: rank correlation, hits, and trades beyond the training part's 70 % quantile."""
    rows = enriched(spark, sf_dir)
    scores, components = [f"score_{i}" for i in range(SCORES)], [f"component_{i}" for i in range(COMPONENTS)]
    base = list(X.FEATURES)
    sets = {"features": base, "features, scores": base + scores, "features, scores, embedding": base + scores + components, "scores, embedding": scores + components}
    made = checkpointed(M.averaged(rows, "y_5", sets, SEEDS, COMPARED_TREES))
    limits = quantiles(made.where("split = 'train'").withColumn("strength", F.abs("pred")), ["set"], "strength", [0.7]).select("set", F.col("quantiles")[0].alias("limit_"))
    test = made.where("split = 'test'").join(F.broadcast(limits), "set")
    traded = E.threshold_strategy(test, ["set"], F.col("limit_"), 10)
    return traded.join(E.quality(test, ["set"]).select("set", "r2_zero", "n"), "set").join(E.spearman(test, ["set"]).select("set", "ic"), "set")


@query()
def embedding_pca(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out, shares = M.principal_components(rows, "embedding", F.col("vec_id") % 10 < 7, 8)
    return out.select("vec_id", "label", "components").withColumn("explained", F.lit(float(sum(shares))))


def advised(spark, sf_dir):
    """Bars of a run beside the model's signal and the last advice at or before the close."""
    bars = fed(spark, sf_dir).drop("edge_bps").withColumn("run", F.lit("plain"))
    advice = normalised(spark, sf_dir).where("a IS NOT NULL").select("symbol", "trade_time", "a.*")
    return asof(bars, advice, "t", "trade_time", ["action", "confidence", "size", "horizon_bars", "stop_bps", "take_bps"]).drop("trade_time_asof")


@query()
def ask_gate(spark, sf_dir):
    """Calls by reason and what came of them, where the model has a veto and in free mode."""
    rows = checkpointed(advised(spark, sf_dir))
    modes = [B.followed(rows, B.Gate(veto=veto), CONFIGS["plain"]).withColumn("mode", F.lit(mode)) for mode, veto in (("veto", True), ("free", False))]
    return modes[0].unionByName(modes[1]).groupBy("mode", "symbol", "reason", "action").agg(F.count("*").alias("n"))


@query()
def run_compare(spark, sf_dir):
    """The run that follows advice beside the model's own and buy-and-hold, each up to the last bar; a symbol without a call has 0 of them."""
    followed = B.followed(advised(spark, sf_dir), rules=CONFIGS["plain"], ends=True)
    agent = followed.groupBy("symbol").agg((F.max(F.when(F.col("reason") == "end", F.col("equity"))) / 10_000.0 - 1).alias("agent"), F.count_if(F.col("reason") != "end").alias("calls"))
    model = curves(spark, sf_dir).where("run = 'plain'").groupBy("symbol").agg((F.max_by("equity", "t") / 10_000.0 - 1).alias("model"))
    hold = A.bars(spark, sf_dir).groupBy("symbol").agg((F.try_divide(F.max_by("close", "open_time"), F.min_by("open", "open_time")) - 1).alias("buy_hold"))
    return agent.join(model, "symbol").join(hold, "symbol").select("symbol", "calls", r("agent").alias("agent"), r("model").alias("model"), r("buy_hold").alias("buy_hold"))


@query()
def decision_log_sink(spark, sf_dir):
    folder = shared_folder(spark) + "/decisions"
    decisions = B.followed(advised(spark, sf_dir), rules=CONFIGS["plain"])
    sinks.append_decisions(decisions, folder)
    return spark.read.schema(decisions.schema).json(folder)


@query(_sql("SELECT run, symbol, strftime(make_timestamp(t * 1000), '%Y-%m-%d %H:%M') AS time, round(equity, 4) + 0.0 AS equity FROM curve"))
def report_sinks(spark, sf_dir):
    """The equity report as written and read again."""
    folder = shared_folder(spark)
    trades, equity = books(spark, sf_dir, WHOLE)
    sinks.write_report(trades, equity, E.run_summary(trades, equity, ["run", "symbol"], 10_000.0, YEAR_BARS), folder)
    return sinks.read_report(spark, folder)[1].select("run", "symbol", "time", "equity")


#: What the report's strategy trades beyond, and pays for a trade, in basis points.
REPORT_BPS, REPORT_COST = 8.0, 10.0


def report_rows(spark, sf_dir):
    """Forecasts of every horizon beside what came: horizon, split, place (a sample's number in its symbol), y, pred, y_scale, sigma."""
    rows = checkpointed(numbered(samples(spark, sf_dir, HORIZONS)))
    parts = []
    for h in HORIZONS:
        model, scale, left = M.fit_forecaster(rows, f"y_{h}")
        known = M.predicted(model, rows.dropna(subset=[f"y_{h}"]), scale)
        parts.append(known.select(F.lit(h).alias("horizon"), "split", F.col("rn").alias("place"), F.col(f"y_{h}").alias("y"), "pred", F.lit(scale).alias("y_scale"), F.lit(left).alias("sigma")))
    return checkpointed(reduce(DataFrame.unionByName, parts))


@query()
def artifact_report(spark, sf_dir):
    """Counts, scores and the strategy's trades, returns and Sharpe ratios of a fit by horizon and part, with the report's version from its contents."""
    rows, by = report_rows(spark, sf_dir), ["horizon", "split"]
    fits = rows.groupBy(*by).agg(F.first("y_scale").alias("y_scale"), F.first("sigma").alias("sigma"))
    money = E.strategy(rows, by, REPORT_BPS, REPORT_COST, YEAR_BARS)
    report = checkpointed(_scores(rows, by).join(fits, by).join(money, by, "left"))
    line = F.format_string("%d|%s|%d|%.9f|%.9f", "horizon", "split", "n", "y_scale", "hit_rate")
    version = report.agg(F.substring(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256), 1, 12).alias("version"))
    return report.crossJoin(F.broadcast(version))


@query(f"WITH {A.sql_bars()} SELECT symbol, count(*) AS bars, max(open_time) AS last_open FROM bars GROUP BY symbol")
def artifact_write(spark, sf_dir):
    folder = shared_folder(spark) + "/report"
    counts = numbered(A.bars(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("open_time").alias("last_open"))
    sinks.write_artifact(counts, folder)
    sinks.write_artifact(counts, folder)
    return spark.read.schema(counts.schema).json(folder)
