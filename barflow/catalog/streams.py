"""Streaming operators, run over the given tables as replayed streams until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog import query
from barflow.catalog.bars import X
from barflow.catalog.common import FEATURES_SQL, HORIZONS, W, YEAR_BARS, back, pick, r, rounded
from barflow.catalog.evaluation import _BUCKET_SQL, PERCENTILES
from barflow.catalog.ledgers import WHOLE, _sql, fed
from barflow.catalog.market import _BOOK_SQL, _FLOW_SQL, _REGIME
from barflow.catalog.storage import _MESSAGES, messages
from barflow.operators import evaluation as E
from barflow.operators.labels import ratio_split
from barflow.operators.learning import fit_window_model, lag_spans
from barflow.plans.blocks import numbered
from barflow.plans.lineage import checkpointed
from barflow.sources import adapters as A
from barflow.streaming import metrics as K
from barflow.streaming import runner as N
from barflow.streaming import scoring as C
from barflow.streaming import stateful as P
from barflow.streaming import typed as T

PARTS = 6


def replayed(df, order, parts=PARTS):
    return N.source(df.sparkSession, N.staged(df, order, parts), df.schema, N.FILES_PER_TRIGGER)


@query(f"WITH RECURSIVE {FEATURES_SQL} SELECT symbol, open_time, valid, " + ", ".join(f"round(CASE WHEN valid THEN {c} END, 6) + 0.0 AS {c}" for c in X.FEATURES) + " FROM features")
def stream_features(spark, sf_dir):
    """Must equal the batch features."""
    out = N.drained(T.stream_features(replayed(A.bars(spark, sf_dir), "open_time"), A.MINUTE))
    return pick(out, "symbol open_time valid", X.FEATURES)


@query(f"WITH {A.sql_bars()}, g AS (SELECT *, CAST(coalesce(open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) <> {A.MINUTE}, false) AS INTEGER) AS gap FROM bars) SELECT symbol, count(*) AS bars, CAST(sum(gap) AS BIGINT) AS gaps FROM g GROUP BY symbol")
def stream_dedupe_gap(spark, sf_dir):
    """Every bar is sent twice in a micro-batch; repeats are dropped and gaps counted."""
    bars = A.bars(spark, sf_dir)
    out = N.drained(T.stream_features(replayed(bars.unionByName(bars), "open_time"), A.MINUTE))
    return out.groupBy("symbol").agg(F.count("*").alias("bars"), F.max("gaps").alias("gaps"))


@query(f"WITH RECURSIVE {FEATURES_SQL}, m AS (SELECT symbol, max(open_time) - {48 * A.HOUR} AS since FROM features GROUP BY symbol) SELECT symbol, open_time, round(rsi_14, 6) + 0.0 AS rsi_14 FROM features JOIN m USING (symbol) WHERE valid AND open_time > since")
def stream_warm_start(spark, sf_dir):
    """Only the last two days are streamed: the state begins from the batch of bars before them, and the features are those of a stream that never stopped."""
    bars = A.bars(spark, sf_dir)
    since = bars.groupBy("symbol").agg((F.max("open_time") - 48 * A.HOUR).alias("since"))
    timed = checkpointed(bars.join(since, "symbol"))
    history, fresh = timed.where("open_time <= since").drop("since"), timed.where("open_time > since").drop("since")
    out = N.drained(T.stream_features(replayed(fresh, "open_time"), A.MINUTE, checkpointed(history)))
    return pick(out.where("valid"), "symbol open_time", "rsi_14")


@query(f"WITH RECURSIVE {_BOOK_SQL}, k AS (SELECT symbol, update_id, obi, row_number() OVER (PARTITION BY symbol ORDER BY update_id) - 1 AS rn FROM m), s AS (SELECT symbol, update_id, rn, 0.05::DOUBLE * obi AS e, obi FROM k WHERE rn = 0 UNION ALL SELECT k.symbol, k.update_id, k.rn, s.e + 0.05::DOUBLE * (k.obi - s.e), k.obi FROM s JOIN k ON k.symbol = s.symbol AND k.rn = s.rn + 1) SELECT symbol, update_id, round(obi, 6) + 0.0 AS obi, round(e, 6) + 0.0 AS obi_ewma FROM s")
def stream_obi(spark, sf_dir):
    return pick(N.drained(T.stream_obi(replayed(A.books(spark, sf_dir), "update_id"))), "symbol update_id", "obi obi_ewma")


@query(f"WITH {_REGIME} SELECT symbol, open_time, round(rv, 6) + 0.0 AS rv, CASE WHEN share > 0.8 THEN 'HIGH' WHEN share < 0.2 THEN 'LOW' ELSE 'NORMAL' END AS vol_regime, round(efficiency, 6) + 0.0 AS efficiency, CASE WHEN efficiency > 0.3 THEN CASE WHEN net > 0 THEN 'TREND_UP' ELSE 'TREND_DOWN' END ELSE 'RANGE' END AS trend_regime FROM regimes")
def stream_regimes(spark, sf_dir):
    out = N.drained(T.stream_regimes(replayed(A.bars(spark, sf_dir), "open_time"), YEAR_BARS))
    return out.select("symbol", "open_time", r("rv").alias("rv"), "vol_regime", r("efficiency").alias("efficiency"), "trend_regime")


@query(_FLOW_SQL.replace("FROM w", f"FROM w WHERE (sec + 1) * 1000 <= (SELECT max(trade_time) - 300000 FROM trades)"))
def stream_trade_windows(spark, sf_dir):
    """Sums by second, then over an hour and five hours, under a five-minute watermark: the batch's order flow, but for seconds that the watermark has not passed."""
    rows = N.drained(T.stream_flow(replayed(A.trades(spark, sf_dir), "trade_time"), 3600, 18_000))
    return pick(rows.withColumn("vwap", F.col("vwap") + 1e-9), "symbol sec", "flow_short flow_long trade_rate vwap")


def tagged(spark, sf_dir):
    empty = lambda *cs: [F.lit(None).cast("double").alias(c) for c in cs]
    books = A.books(spark, sf_dir).select("symbol", F.col("book_time").alias("sent"), F.lit("book").alias("kind"), "bid", "ask", "bid_qty", "ask_qty", *empty("price", "qty"), F.lit(None).cast("boolean").alias("is_buyer_maker"))
    trades = A.trades(spark, sf_dir).select("symbol", F.col("trade_time").alias("sent"), F.lit("trade").alias("kind"), *empty("bid", "ask", "bid_qty", "ask_qty"), "price", "qty", "is_buyer_maker")
    bars = A.bars(spark, sf_dir).select("symbol", F.col("close_time").alias("sent"), F.lit("bar").alias("kind"), *empty("bid", "ask", "bid_qty", "ask_qty", "price", "qty"), F.lit(None).cast("boolean").alias("is_buyer_maker"))
    return books.unionByName(trades).unionByName(bars)


@query()
def stream_snapshot(spark, sf_dir):
    return N.drained(T.stream_snapshots(replayed(tagged(spark, sf_dir), "sent"), 2 * A.HOUR, 3600, 18_000))


@query(_sql("SELECT symbol, side, entry_time, exit_time, bars, reason, round(pnl, 4) + 0.0 AS pnl FROM ledger WHERE run = 'plain' AND reason <> 'end'"))
def stream_ledger(spark, sf_dir):
    """The batch ledger's trades but for those that only its end closes."""
    rows = fed(spark, sf_dir).select("symbol", "t", "open", "high", "low", "close", "signal", "horizon", "edge_bps")
    return pick(N.drained(P.stream_ledger(replayed(rows, "t"), WHOLE["plain"])), "symbol side entry_time exit_time bars reason", "pnl", 4)


@query(f"WITH {_MESSAGES} SELECT topic, sent // 86400000 AS day, count(*) AS messages, count(DISTINCT payload) AS payloads FROM messages GROUP BY ALL")
def capture_sink(spark, sf_dir):
    """Messages appended to Parquet by topic and day, then read back."""
    stream = replayed(messages(spark, sf_dir), "sent").withColumn("day", F.floor(F.col("sent") / A.DAY))
    return N.drained(stream, partition_by=["topic", "day"]).groupBy("topic", "day").agg(F.count("*").alias("messages"), F.countDistinct("payload").alias("payloads"))


@query(f"WITH {_MESSAGES} SELECT topic, CAST(sent // 3600000 % 24 AS BIGINT) AS hour, seq, payload FROM messages")
def stream_capture(spark, sf_dir):
    """Raw messages captured by topic and hour, so that a reader of one topic prunes the other's folders; here both are read back."""
    stream = replayed(messages(spark, sf_dir), "sent").withColumn("hour", F.floor(F.col("sent") / A.HOUR) % 24)
    return N.drained(stream, partition_by=["topic", "hour"]).select("topic", "hour", "seq", "payload")


@query(f"WITH {_MESSAGES}, c AS (SELECT (max(sent) + min(sent)) // 2 AS cut FROM messages) SELECT mode, topic, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT 'replay' AS mode, * FROM messages UNION ALL SELECT 'now', messages.* FROM messages, c WHERE sent > cut) GROUP BY ALL")
def stream_source(spark, sf_dir):
    """A replay of all that is retained beside a subscription that begins now, when half of the time has passed: it gets only what comes later."""
    rows = messages(spark, sf_dir)
    cut = rows.agg(F.floor((F.max("sent") + F.min("sent")) / 2).alias("cut")).first()["cut"]
    path = N.staged(rows.where(F.col("sent") <= cut), "sent", 2)
    late = N.subscribed(spark, path, rows.schema)
    N.staged(rows.where(F.col("sent") > cut), "sent", 2, path)
    count = lambda df, mode: df.groupBy(F.lit(mode).alias("mode"), "topic").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return count(N.drained(N.source(spark, path, rows.schema, N.FILES_PER_TRIGGER)), "replay").unionByName(count(late(), "now"))


@query(f"WITH {A.SQL_BOOKS} SELECT symbol, max(update_id) AS update_id, arg_max(bid, update_id) AS bid FROM books GROUP BY symbol")
def conflate_latest(spark, sf_dir):
    """The serving table that a slow reader sees: the newest quote of each symbol."""
    folder = N.shared_folder(spark)
    quotes = A.books(spark, sf_dir).select("symbol", "update_id", "bid")
    N.serve_latest(replayed(quotes, "update_id"), "symbol", "update_id", f"{folder}/table", f"{folder}/state")
    return N.latest_version(spark, f"{folder}/table", quotes.schema)


LOOKBACK = 128


def scored_rows(spark, sf_dir):
    """Valid feature rows with their place and part, as models are fitted on them and score them."""
    rows = X.features_14(A.bars(spark, sf_dir)).where("valid").drop("rn")
    return checkpointed(ratio_split(numbered(rows)).select("symbol", "open_time", "close", "rn", "split", *X.FEATURES))


def _score_sql() -> str:
    """The fit and the scores of fit_window_model and score: one ridge system a horizon, solved by elimination over a list of rows."""
    names, each = X.FEATURES, lambda f: ", ".join(f(c) for c in X.FEATURES)
    spans = lag_spans(LOOKBACK)
    x = [f"avg(z_{c}) OVER ({W} ROWS BETWEEN {after - 1} PRECEDING AND {first} PRECEDING)" for first, after in spans for c in names]
    n, exps, sigmas = len(x) + 1, [f"exp_{h}" for h in HORIZONS], [f"sigma_{h}" for h in HORIZONS]
    zs = [f"abs({e}) / greatest({s}, 1e-12)" for e, s in zip(exps, sigmas)]
    solve = lambda h: f"""sums_{h} AS (SELECT i, j, sum(v[i] * v[j]) AS s FROM (SELECT list_append(v, y_{h}) AS v FROM known WHERE split = 'train' AND y_{h} IS NOT NULL), range(1, {n + 1}) a(i), range(1, {n + 2}) b(j) GROUP BY ALL),
 size_{h} AS (SELECT count(*) AS n, coalesce(nullif(stddev_pop(y_{h}), 0), 1.0) AS scale_{h} FROM known WHERE split = 'train' AND y_{h} IS NOT NULL),
 lines_{h} AS (SELECT i, list(s / n / CASE WHEN j = {n + 1} THEN scale_{h} ELSE 1 END + CASE WHEN i <> j THEN 0 WHEN i = 1 THEN 1e-11::DOUBLE ELSE 0.01::DOUBLE END ORDER BY j) AS line FROM sums_{h}, size_{h} GROUP BY i),
 swept_{h} AS (SELECT 1 AS k, list(line ORDER BY i) AS a FROM lines_{h} UNION ALL
  SELECT k + 1, list_transform(a, lambda line, i: CASE WHEN i = k THEN list_transform(line, lambda v: v / line[k]) ELSE list_transform(line, lambda v, j: v - line[k] / a[k][k] * a[k][j]) END) FROM swept_{h} WHERE k <= {n}),
 fit_{h} AS (SELECT list_transform(a, lambda line: line[{n + 1}]) AS w_{h}, scale_{h} FROM swept_{h}, size_{h} WHERE k = {n + 1}),"""  # noqa: E731
    return f"""WITH RECURSIVE {FEATURES_SQL}, v AS (SELECT symbol, open_time, close, {', '.join(names)}, row_number() OVER ({W}) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n FROM features WHERE valid),
 parted AS (SELECT * EXCLUDE ({', '.join(names)}), {each(lambda c: f'coalesce({c}, 0) AS {c}')}, CASE WHEN place < floor(n * 0.65::DOUBLE) THEN 'train' WHEN place < floor(n * (0.65::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM v),
 stats AS (SELECT {each(lambda c: f'avg({c}) AS mean_{c}, stddev_pop({c}) + 1e-12 AS std_{c}')} FROM parted WHERE split = 'train'),
 zs AS (SELECT symbol, open_time, close, place, split, {each(lambda c: f'greatest(-5.0, least(5.0, ({c} - mean_{c}) / std_{c})) AS z_{c}')} FROM parted, stats),
 ms AS (SELECT symbol, open_time, close, place, split, [1.0::DOUBLE, {', '.join(x)}] AS v, {', '.join(f'ln(lead(close, {h}) OVER ({W}) / close) AS y_{h}' for h in HORIZONS)} FROM zs),
 known AS MATERIALIZED (SELECT * FROM ms WHERE place >= {LOOKBACK - 1}), {''.join(map(solve, HORIZONS))}
 made AS (SELECT symbol, open_time, close, split, {', '.join(f'y_{h}' for h in HORIZONS)}, {', '.join(f'coalesce(list_dot_product(v, w_{h}), 0) * scale_{h} AS exp_{h}' for h in HORIZONS)} FROM known, {', '.join(f'fit_{h}' for h in HORIZONS)}),
 spread AS (SELECT {', '.join(f'coalesce(nullif(stddev_pop(y_{h} - exp_{h}), 0), 1.0) AS sigma_{h}' for h in HORIZONS)} FROM made WHERE split = 'val'),
 best AS (SELECT *, {', '.join(f'{z} AS z{i}' for i, z in enumerate(zs))} FROM made, spread),
 scores AS (SELECT symbol, open_time, close, {', '.join(exps)}, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS j, CASE j WHEN 0 THEN {exps[0]} WHEN 1 THEN {exps[1]} ELSE {exps[2]} END * 1e4 AS edge_bps FROM best)"""


_SCORES = f"""{_score_sql()} SELECT symbol, open_time, {rounded([f'exp_{h}' for h in HORIZONS])}, round(close * exp(exp_{HORIZONS[0]}), 6) + 0.0 AS price, CASE WHEN edge_bps > 8 THEN 'LONG' WHEN edge_bps < -8 THEN 'SHORT' ELSE 'FLAT' END AS signal,
 CAST({list(HORIZONS)}[j + 1] AS INTEGER) AS horizon, round(edge_bps, 3) + 0.0 AS edge_bps FROM scores"""


def _scores(df):
    """Forecast rows with their arrays taken apart."""
    parts = [r(F.col("exp")[i]).alias(f"exp_{h}") for i, h in enumerate(HORIZONS)]
    return df.select("symbol", "open_time", *parts, r(F.col("exp_price")[0]).alias("price"), "signal", "horizon", r("edge_bps", 3).alias("edge_bps"))


def _fitted(rows):
    return fit_window_model(rows, list(X.FEATURES), HORIZONS, LOOKBACK)


def _streamed(spark, rows, folder):
    C.stream_scores(replayed(rows.drop("rn", "split"), "open_time"), f"{folder}/models", list(X.FEATURES), f"{folder}/out", f"{folder}/tail", f"{folder}/state", LOOKBACK)
    return spark.read.parquet(f"{folder}/out")


@query(_SCORES)
def stream_score(spark, sf_dir):
    """Forecasts of each bar as it comes, from windows of 128 rows and 14 features that span micro-batches."""
    folder, rows = N.shared_folder(spark), scored_rows(spark, sf_dir)
    C.write_model(spark, f"{folder}/models", 1, _fitted(rows))
    return _scores(_streamed(spark, rows, folder))


@query(_SCORES)
def batch_score(spark, sf_dir):
    """Forecasts of every bar with a full window, by the fitted model."""
    rows = scored_rows(spark, sf_dir)
    return _scores(C.score(rows, _fitted(rows)))


@query(f"{_score_sql()} SELECT 2 AS model_version, count(*) AS n, {', '.join(f'round(sum(exp_{h}), 5) + 0.0 AS total_{h}' for h in HORIZONS)} FROM scores HAVING count(*) > 0")
def model_refresh(spark, sf_dir):
    """A newer compatible model and a newer one with other inputs: the stream takes the former."""
    folder, rows = N.shared_folder(spark), scored_rows(spark, sf_dir)
    model = _fitted(rows)
    C.write_model(spark, f"{folder}/models", 1, model | {"scale": [9.0] * len(HORIZONS)})
    C.write_model(spark, f"{folder}/models", 2, model)
    C.write_model(spark, f"{folder}/models", 3, model | {"inputs": ["ret_5", *X.FEATURES[1:]]})
    out = _streamed(spark, rows, folder)
    return out.groupBy("model_version").agg(F.count("*").alias("n"), *[r(F.sum(F.col("exp")[i]), 5).alias(f"total_{h}") for i, h in enumerate(HORIZONS)])


def recorded(spark, sf_dir):
    """The metrics table of all samples: half of them recorded, then the rest by a stream started anew on the same table and checkpoint."""
    folder, rows = N.shared_folder(spark), A.services(spark, sf_dir)
    cut = rows.agg(F.floor((F.max("ts") + F.min("ts")) / 2).alias("cut")).first()["cut"]
    path = f"{folder}/staged"
    for part in (F.col("ts") <= cut, F.col("ts") > cut):
        N.staged(rows.where(part), "ts", 3, path)
        K.record(N.source(spark, path, rows.schema, N.FILES_PER_TRIGGER), f"{folder}/table", f"{folder}/state", merged=4)
    return K.table(spark, f"{folder}/table")


@query(f"""{_BUCKET_SQL}, h AS (SELECT service, metric, bucket, count(*) AS n, max(ns) AS most FROM b GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY service, metric ORDER BY bucket) AS upto, sum(n) OVER w AS whole, max(most) OVER w AS top FROM h WINDOW w AS (PARTITION BY service, metric)),
 p AS (SELECT service, metric, top, {', '.join(f'min(bucket) FILTER (upto >= {q} / 100 * whole) AS at{i}' for i, q in enumerate(PERCENTILES))} FROM c GROUP BY ALL),
 t AS (SELECT service, metric, count(*) AS counter, CAST(sum(ns) AS BIGINT) AS total, arg_max(ns, (ts, seq)) AS gauge FROM services GROUP BY ALL)
SELECT service, metric, counter, total, top, gauge, {', '.join(f'round(least(pow(2.0, at{i} // 16 + 6) * (1 + (at{i} % 16 + 1) / 16.0), top), 6) + 0.0 AS p{str(q).replace(".", "_")}' for i, q in enumerate(PERCENTILES))} FROM p JOIN t USING (service, metric)""")
def stream_metrics(spark, sf_dir):
    """Counters, gauges and latency percentiles of a stream that was stopped half way, read from its metrics table."""
    rows = recorded(spark, sf_dir)
    wide = E.bucket_percentiles(rows, K.KEYS, PERCENTILES).groupBy(*K.KEYS).agg(*[r(F.max(F.when(F.col("q") == q, F.col("value")))).alias(f"p{str(q).replace('.', '_')}") for q in PERCENTILES])
    return K.totals(rows).join(wide, K.KEYS)


@query(f"WITH {A.SQL_SERVICES}, b AS (SELECT service, metric, ts // {K.BEAT} * {K.BEAT} AS beat, count(*) AS n, sum(ns) AS s, arg_max(ns, (ts, seq)) AS gauge FROM services GROUP BY ALL) SELECT service, metric, beat, CAST(sum(n) OVER w AS BIGINT) AS counter, CAST(sum(s) OVER w AS BIGINT) AS total, gauge FROM b WINDOW w AS (PARTITION BY service, metric ORDER BY beat)")
def stream_heartbeat(spark, sf_dir):
    """What each service reports every five seconds, over a stop of the stream."""
    return K.heartbeat(recorded(spark, sf_dir))


@query(f"WITH {A.SQL_TRADES}, s AS (SELECT count(*) AS rows, CAST(sum(CAST(is_buyer_maker AS INTEGER)) AS BIGINT) AS sales FROM trades) SELECT rows, sales FROM s")
def stream_observed(spark, sf_dir):
    """Counters that a stream observes beside its work, one row of each micro-batch, summed."""
    from pyspark.sql.streaming import StreamingQueryListener

    seen: list[tuple[int, int]] = []

    class Heartbeat(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            row = event.progress.observedMetrics.get("heartbeat")
            if row is not None and row["rows"]:
                seen.append((row["rows"], row["sales"]))

        def onQueryTerminated(self, event):
            pass

    listener = Heartbeat()
    spark.streams.addListener(listener)
    try:
        stream = replayed(A.trades(spark, sf_dir), "trade_time").observe("heartbeat", F.count("*").alias("rows"), F.sum(F.col("is_buyer_maker").cast("long")).alias("sales"))
        N.drained(stream)
        expected = A.trades(spark, sf_dir).count()
        import time

        for _ in range(100):
            if sum(n for n, _ in seen) >= expected:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame(seen, "rows long, sales long").agg(F.sum("rows").alias("rows"), F.sum("sales").alias("sales"))
