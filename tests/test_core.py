"""Shared plans, hand-computed ledgers, causality and leakage, batch and stream parity."""

import json
import math
import random
from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow import catalog
from barflow.functions import signals as S
from barflow.operators import agent, ledger
from barflow.operators import evaluation as E
from barflow.operators import features as X
from barflow.operators import labels as L
from barflow.operators import micro as M
from barflow.plans.blocks import Blocked, Recurrence, blocked, memory, numbered, recurrences
from barflow.sources import frames as R
from barflow.sources import sinks

catalog.load()
BAR = "symbol string, open_time long, open double, high double, low double, close double, volume double, trades long, taker double"


def walk(n, symbol="S", seed=0, step=60_000, skip=()):
    rng = random.Random(seed)
    price, rows = 2000.0, []
    for i in range(n):
        if i in skip:
            continue
        close = price * math.exp(rng.gauss(0, 1e-3))
        volume = 0.0 if i % 97 == 0 else rng.uniform(10, 100)
        rows.append((symbol, i * step, price, max(price, close) * (1 + rng.random() * 1e-3), min(price, close) * (1 - rng.random() * 1e-3), close, volume, rng.randrange(100, 1000), volume * rng.uniform(0.3, 0.7)))
        price = close
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(700) + walk(90, "T", 1), BAR).withColumn("close_time", F.col("open_time") + 59_999)


def test_numbers_and_blocks(spark, bars):
    rows = numbered(bars, span=60_000 * 37)
    for symbol, n in (("S", 700), ("T", 90)):
        got = [r.rn for r in rows.where(F.col("symbol") == symbol).orderBy("open_time").collect()]
        assert got == list(range(n))
    b = blocked(rows, 5, 3, rows=16)
    total = Blocked.home(b.rows.select("*", F.sum("close").over(b.window.rowsBetween(-5, 3)).alias("s"))).where("symbol = 'S'").orderBy("rn").collect()
    close = np.array([r[5] for r in walk(700)])
    assert len(total) == 700
    assert all(abs(r.s - close[max(0, i - 5) : i + 4].sum()) < 1e-6 for i, r in enumerate(total))


@pytest.mark.parametrize("decay", [0.8, 12 / 14, 0.95])
def test_recurrence(spark, bars, decay):
    b = blocked(numbered(bars), memory(decay, 0.9, rows=32), rows=64)
    made = Blocked.home(recurrences(b, [Recurrence("h", F.col("close"), decay), Recurrence("g", -F.col("volume"), 0.9)], rows=32).rows)
    got = made.where("symbol = 'S'").orderBy("rn").collect()
    assert len(got) == 700
    h = g = 0.0
    for r in got:
        h, g = decay * h + r.close, 0.9 * g - r.volume
        assert r.h == pytest.approx(h, rel=1e-12) and r.g == pytest.approx(g, rel=1e-9)


def test_features_look_back_only(spark, bars):
    changed = bars.withColumn("close", F.when(F.col("open_time") > 300 * 60_000, F.col("close") * 7).otherwise(F.col("close")))
    cols = ["symbol", "open_time", *X.FEATURES]
    a = {(r.symbol, r.open_time): r for r in X.features_14(bars).select(cols).collect()}
    for r in X.features_14(changed).select(cols).collect():
        if r.open_time <= 300 * 60_000:
            assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(r[2:], a[r.symbol, r.open_time][2:]) if x is not None)


def test_features_against_pandas(bars):
    got = X.features_14(bars).where("symbol = 'S' AND valid").orderBy("open_time").toPandas()
    p = pd.DataFrame(walk(700), columns=[c.split()[0] for c in BAR.split(", ")])
    c = p["close"]
    r1 = np.log(c / c.shift())
    gain, loss = c.diff().clip(lower=0), (-c.diff()).clip(lower=0)
    wilder = lambda s: s.iloc[1:].ewm(alpha=1 / 14, adjust=False).mean()
    rsi = 100 * wilder(gain) / (wilder(gain) + wilder(loss))
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    expected = {"ret_15": np.log(c / c.shift(15)), "rvol_20": r1.rolling(20).std(), "bb_z_20": (c - c.rolling(20).mean()) / c.rolling(20).std(), "dist_ma_50": c / c.rolling(50).mean() - 1, "rsi_14": (rsi - 50) / 50, "macd_hist_pct": (macd - macd.ewm(span=9, adjust=False).mean()) / c}
    assert len(got) == 637
    for name, values in expected.items():
        assert np.allclose(got[name], values.loc[63:], rtol=1e-7, atol=1e-9), name


def test_eligible_samples_leave_gaps_out(spark):
    rows = spark.createDataFrame(walk(401, skip=(200,)), BAR)
    marked = numbered(rows).withColumn("valid", F.col("rn") >= 50)
    got = sorted(r.rn for r in L.eligible(marked, 60_000, 32, 10).collect())
    assert got[0] == 81 and got[-1] == 389 and 189 in got and 231 in got and not set(range(190, 231)) & set(got)


def test_split_keeps_the_embargo(spark):
    samples = spark.range(100, 10_000).select(F.lit("S").alias("symbol"), (F.col("id") * 60_000).alias("open_time"), F.col("id").alias("rn"))
    parts = {r.split: (r.a, r.b) for r in L.chrono_split(samples, 60).groupBy("split").agg(F.min("rn").alias("a"), F.max("rn").alias("b")).collect()}
    assert parts["train"][1] + 60 < parts["val"][0] and parts["val"][1] + 60 < parts["test"][0] and parts["test"][1] == 9999


def test_normaliser_sees_training_rows_only(spark):
    rows = spark.range(1000).select(F.lit("S").alias("symbol"), (F.col("id") * 60_000).alias("open_time"), F.col("id").alias("rn"), F.when(F.col("id") < 600, 0.0).otherwise(1e6).alias("x"))
    stats = L.normaliser(rows, rows.where("rn BETWEEN 100 AND 599"), ["x"], 32).first()
    assert stats.mean_x == 0 and stats.std_x == pytest.approx(1e-12) and stats.rows == 531


# --- ledgers ------------------------------------------------------------------------------------


def folded(bars, signals, rules):
    rows = pd.DataFrame([(i, *b) for i, b in enumerate(bars)], columns=["t", "open", "high", "low", "close"])
    for c in ("signal", "horizon", "edge_bps", "price", "size", "stop_bps", "take_bps"):
        rows[c] = None
    for t, signal, horizon, *price in signals:
        rows.loc[t, ["signal", "horizon", "edge_bps"]] = [signal, horizon, 1.0]
        if price:
            rows.loc[t, "price"] = price[0]
    return ledger.fold(rows, rules)


FLAT = ledger.Rules(cash=1000.0, fee_bps=0, slippage_bps=0)


def test_next_open_and_costs():
    bars = [(100, 101, 99, 100), (102, 103, 101, 103), (103, 105, 102, 104), (104, 106, 103, 105)]
    trades, curve = folded(bars, [(0, "LONG", 2)], ledger.Rules(cash=1000.0, fee_bps=10, slippage_bps=5))
    entry, exit_ = 102 * 1.0005, 104 * 0.9995
    qty = 1000 / entry
    fees = (qty * entry + qty * exit_) * 1e-3
    assert len(trades) == 1 and trades[0]["entry_price"] == pytest.approx(entry) and trades[0]["bars"] == 2 and trades[0]["reason"] == "horizon"
    assert trades[0]["pnl"] == pytest.approx(qty * (exit_ - entry) - fees) and curve["equity"].iloc[-1] == pytest.approx(1000 + trades[0]["pnl"])
    assert curve["equity"].iloc[0] == 1000 and curve["equity"].iloc[1] == pytest.approx(1000 - qty * entry * 1e-3 + qty * (103 - entry))
    assert curve["in_market"].tolist() == [False, True, True, False]


def test_extend_reverse_and_end():
    bars = [(100, 100, 100, 100)] * 8
    trades, _ = folded(bars, [(0, "LONG", 2), (1, "LONG", 3), (4, "SHORT", 50)], FLAT)
    assert [(t["side"], t["reason"], t["bars"]) for t in trades] == [("LONG", "horizon", 4), ("SHORT", "end", 3)]
    trades, _ = folded(bars, [(0, "LONG", 9), (3, "SHORT", 9)], FLAT)
    assert [(t["side"], t["reason"]) for t in trades] == [("LONG", "reverse"), ("SHORT", "end")]
    trades, _ = folded(bars, [(0, "LONG", 9), (3, "SHORT", 9)], ledger.Rules(cash=1000.0, allow_short=False))
    assert [(t["side"], t["reason"]) for t in trades] == [("LONG", "end")]


@pytest.mark.parametrize("bar, price, reason", [((100, 112, 94, 100), 95, "stop"), ((100, 112, 98, 100), 110, "take"), ((90, 91, 89, 90), 90, "stop"), ((115, 116, 114, 115), 115, "take")])
def test_stop_comes_first_and_gaps_fill_at_the_open(bar, price, reason):
    bars = [(100, 100, 100, 100), (100, 101, 99, 100), bar, (100, 100, 100, 100)]
    trades, _ = folded(bars, [(0, "LONG", 9)], ledger.Rules(cash=1000.0, fee_bps=0, slippage_bps=0, stop_bps=500, take_bps=1000))
    assert (trades[0]["exit_price"], trades[0]["reason"]) == (pytest.approx(price), reason)


def test_live_orders_fill_at_their_price():
    trades, curve = folded([(100, 100, 100, 100), (110, 110, 110, 110), (120, 120, 120, 120)], [(0, "SHORT", 1, 105.0)], FLAT)
    assert trades[0]["entry_price"] == 105 and trades[0]["exit_price"] == 110 and curve["equity"].tolist()[0] == 1000


def test_an_order_of_no_size_opens_nothing_and_blocks_nothing():
    book = ledger.Book(FLAT)
    book.signal(0, 10.0, "LONG", 5, 0.0, 0.0, None, None)
    assert book.own is None
    book.signal(1, 10.0, "LONG", 5, 0.0, 1.0, None, None)
    assert book.own.side == 1
    assert [h.reason for h in book.signal(2, 11.0, "SHORT", 5, 0.0, 0.0, None, None)] == ["reverse"] and book.own is None


def test_no_position_is_worth_more_than_the_rules_allow(spark):
    bars = [(10.0, 10, 10, 10), (10, 20, 10, 20)] * 30
    rows = spark.createDataFrame([("S", i, *map(float, b), "LONG" if i % 2 == 0 else None, 1, 0.0) for i, b in enumerate(bars)], "symbol string, t long, open double, high double, low double, close double, signal string, horizon long, edge_bps double")
    rules = ledger.Rules(cash=1000.0, fee_bps=0, slippage_bps=0, most=5000.0)
    trades, curve = ledger.parted(ledger.both(rows, {"a": rules, "b": FLAT}))
    found = {r.run: r for r in trades.groupBy("run").agg(F.max(F.col("qty") * F.col("entry_price")).alias("most"), F.sum("pnl").alias("pnl"), F.count("*").alias("n")).collect()}
    assert found["a"].most == pytest.approx(5000) and found["a"].pnl == pytest.approx(1000 + 2000 + 4000 + 27 * 5000) and found["b"].pnl == pytest.approx(1000 * (2.0**30 - 1))
    assert {r.run: r["count"] for r in curve.groupBy("run").count().collect()} == {"a": 60, "b": 60}
    assert ledger.both(rows.limit(0), {"a": rules}).collect() == []


def test_ledger_money_is_finite(spark):
    from barflow.catalog import ledgers

    trades, curve = ledgers.books(spark, "/root/testdata/sf0.1")
    for df in (trades, curve):
        wild = [F.isnan(c) | (F.abs(F.col(c)) > 1e13) for c, t in df.dtypes if t == "double"]
        assert df.count() > 0 and df.where(reduce(lambda a, b: a | b, wild)).count() == 0


def test_ranks_keep_a_group_without_name(spark):
    rows = spark.createDataFrame([(g, float(i), float(i * i)) for g in ("a", None) for i in range(5)], "g string, pred double, y double")
    assert {(r.g, round(r.ic, 9), r.n) for r in E.spearman(rows, ["g"]).collect()} == {("a", 1.0, 5), (None, 1.0, 5)}


def test_stream_ledger_equals_batch(spark, sf_dir):
    batch = catalog.QUERIES["position_ledger"](spark, sf_dir).where("run = 'plain' AND reason <> 'end'")
    stream = catalog.QUERIES["stream_ledger"](spark, sf_dir)
    key = lambda rows: sorted((r.symbol, r.side, r.entry_time, r.exit_time, round(r.pnl, 6), r.bars, r.reason) for r in rows.collect())
    assert key(stream) == key(batch) and batch.count() > 50


def test_summary_and_curve_agree(spark, sf_dir):
    summary = catalog.QUERIES["run_summary"](spark, sf_dir).collect()
    trades = catalog.QUERIES["position_ledger"](spark, sf_dir).groupBy("run", "symbol").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n")).collect()
    by = {(t.run, t.symbol): t for t in trades}
    assert len(summary) == len(by)
    for s in summary:
        t = by[s.run, s.symbol]
        assert s.trades == t.n and s.end_equity == pytest.approx(10_000 + t.pnl, abs=0.02) and s.max_drawdown_pct <= 0
        assert s.exits_horizon + s.exits_stop + s.exits_take + s.exits_reverse + s.exits_end == t.n


# --- agent --------------------------------------------------------------------------------------


def advice_rows(n, action, confidence=0.9, signal="LONG", prices=None):
    prices = prices or [100.0] * n
    return pd.DataFrame([("r", "S", i * 60_000, p, p, p, p, signal, 5, action, confidence, 1.0, 3, 0.0, 0.0) for i, p in enumerate(prices)], columns=["run", "symbol", "t", "open", "high", "low", "close", "signal", "horizon", "action", "confidence", "size", "horizon_bars", "stop_bps", "take_bps"])


def test_gate_keeps_its_distance():
    out = agent.follow(advice_rows(60, "OPEN_LONG", 0.2), agent.Gate(), FLAT)
    assert out["t"].div(60_000).astype(int).tolist() == [0, 10, 20, 30, 40, 50] and set(out["action"]) == {"NONE"} and set(out["vetoes"]) == {1}
    out = agent.follow(advice_rows(60, "OPEN_LONG"), agent.Gate(entry_gap=1, calls_per_hour=3), FLAT)
    assert len(out) == 3


def test_losses_cool_down_and_halt():
    falling = [100 - 0.3 * i for i in range(40)]
    out = agent.follow(advice_rows(40, "OPEN_LONG", prices=falling), agent.Gate(entry_gap=1, cooldown=5), FLAT)
    opened = (out.loc[out["action"] == "OPEN_LONG", "t"] // 60_000).tolist()
    assert all(b - a >= 3 + 5 for a, b in zip(opened, opened[1:]))
    out = agent.follow(advice_rows(40, "OPEN_LONG", prices=[100.0, 100, 100, 90] + [90.0] * 36), agent.Gate(entry_gap=1, stops=(5000, 5000, 5000)), FLAT)
    assert (out["t"] // 60_000).max() <= 3


def test_free_mode_scans_and_needs_no_model(spark):
    out = agent.follow(advice_rows(60, "HOLD", signal="FLAT"), agent.Gate(veto=False), FLAT)
    assert set(out["reason"]) == {"scan"} and out["t"].div(60_000).astype(int).tolist() == [0, 15, 30, 45]
    assert agent.follow(advice_rows(60, "HOLD", signal="FLAT"), agent.Gate(), FLAT).empty
    assert agent.follow(advice_rows(60, "HOLD", signal="FLAT"), agent.Gate(veto=False, ask_on_flat=False), FLAT).empty
    out = agent.follow(advice_rows(3, "OPEN_SHORT", signal="FLAT"), agent.Gate(veto=False), FLAT)
    assert out["action"].tolist() == ["OPEN_SHORT"]


def test_a_loss_closed_on_advice_starts_the_cool_down_and_the_end_closes_what_is_open():
    rows = advice_rows(40, "OPEN_LONG", prices=[100.0 - 0.05 * i for i in range(40)])
    rows["horizon_bars"] = 100
    rows.loc[rows.index == 15, "action"] = "CLOSE"
    out = agent.follow(rows, agent.Gate(entry_gap=1, review=15, cooldown=10, stops=(9000, 9000, 9000), max_horizon=10_000), FLAT, ends=True)
    minutes = (out["t"] // 60_000).tolist()
    assert out["action"].tolist()[minutes.index(15)] == "CLOSE" and not [m for m in minutes if 15 < m < 25]
    assert out.iloc[-1]["reason"] == "end" and out.iloc[-1]["t"] == rows["t"].iloc[-1]


def test_gate_on_spark(spark):
    rows = spark.createDataFrame(advice_rows(30, "OPEN_SHORT", signal="SHORT"))
    assert agent.followed(rows).where("action = 'OPEN_SHORT'").count() > 0


# --- columns, joins, frames ---------------------------------------------------------------------


def test_ties_of_decisions_take_the_first(spark):
    row = spark.range(1).select(S.decide_signal(F.array(F.lit(0.002), F.lit(-0.002)), F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1), F.lit(5)), 8.0).alias("d")).first().d
    assert (row.signal, row.horizon) == ("LONG", 1)


@pytest.mark.parametrize("text, action", [('{"action": "buy"}', "OPEN_LONG"), ('x {"action": " Exit ", "size": "inf"} y', "CLOSE"), ("[1]", None), ("nothing", None), ('{"action": 5}', "SKIP"), (None, None), ("{broken}", None)])
def test_advice(spark, text, action):
    row = spark.createDataFrame([(text,)], "t string").select(S.normalise_advice(S.parse_advice(F.col("t"))).alias("a")).first().a
    assert (row and row.action) == action and (row is None or row.size == 0)


def test_buckets(spark):
    values = [0, 63, 64, 65, 67, 68, 127, 128, 10**6, 2**35, 2**36 - 1, 2**36, 2**40]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(S.log_linear_bucket(F.col("v")).alias("b")).collect()]
    expected = [0 if v < 64 else 479 if v >= 2**36 else (v.bit_length() - 7) * 16 + (v >> (v.bit_length() - 5)) % 16 for v in values]
    assert got == expected


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 86_400_005), ("a", 1), ("b", 9), (None, 4)], "symbol string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 6, 3.0), ("b", 10, 4.0), (None, 3, 5.0), ("a", None, 9.0)], "symbol string, at long, x double")
    got = {(r.symbol, r.t): r.x for r in M.asof(left, right, "t", "at", ["x"]).collect()}
    assert got == {("a", 5): 2.0, ("a", 86_400_005): 3.0, ("a", 1): None, ("b", 9): None, (None, 4): 5.0}
    assert M.asof(left.limit(0), right, "t", "at", ["x"]).collect() == []


def test_incremental_table_and_report(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    R.upsert(path, bars.where("open_time < 6000000"))
    R.upsert(path, bars)
    R.upsert(path, bars)
    assert spark.read.parquet(path).count() == bars.count()
    profile = {r.name: (r.decimals, r.type) for r in R.fixed_point_profile(spark.createDataFrame([(1.25, 3.0, 0.1 + 0.2), (None, 4.0, 1 / 3)], "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert profile["a"] == (2, "DECIMAL(3,2)") and profile["b"] == (0, "DECIMAL(1,0)") and profile["c"] == (None, "DOUBLE")
    assert spark.range(1).select(sinks.minute_text(F.lit(1_704_067_500_000)).alias("t")).first().t == "2024-01-01 00:05"


def test_frames_that_do_not_parse(spark):
    frames = spark.createDataFrame([("nonsense",), ('{"stream": "x@aggTrade", "data": {"s": "X", "p": "oops", "q": "2", "T": 7, "m": true}}',), ('{"stream": "x@kline_1m", "data": {"k": {"s": "X", "t": 1, "c": "5", "v": "1", "x": false}}}',), (None,)], "raw string")
    got = R.decode(frames).collect()
    assert [(r.kind, r.symbol, r.place, r.price, r.qty, r.flag) for r in got] == [("trade", "X", 7, None, 2.0, True)]


def test_sweep_tries_the_whole_grid(spark, sf_dir):
    from barflow.catalog import ledgers

    found = {(r.symbol, r.part, r.kind, r.horizon, r.q) for r in ledgers.swept(spark, sf_dir).collect()}
    symbols = {r.symbol for r in ledgers.sweep_inputs(spark, sf_dir)[0].select("symbol").distinct().collect()}
    assert symbols and found == {(s, p, k, h, q) for s in symbols for p in ("val", "test") for k in ("plain", "long") for h in ledgers.HORIZONS for q in range(7)}


def test_a_sweep_is_one_fold_for_each_of_its_runs(spark):
    kinds = {
        "plain": ledger.Rules(most=20_000.0), "stops": ledger.Rules(stop_bps=4, take_bps=9), "takes": ledger.Rules(take_bps=3, allow_short=False, size=0.5), "none": ledger.Rules(size=0.0), "ruin": ledger.Rules(fee_bps=9000.0),
    }
    rng = random.Random(5)
    rows = [(s, p, t, o, h, low, c, rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1)]), rng.gauss(0, 1)) for s in "AB" for p in ("val", "test") for _, t, o, h, low, c, *_ in walk(150, s, seed=ord(s))]
    bars = spark.createDataFrame(rows, "symbol string, part string, t long, open double, high double, low double, close double, pred_3 double, pred_8 double")
    cuts = spark.createDataFrame([("A", 3, [0.2, 1.0]), ("A", 8, [0.1, 0.9]), ("B", 3, [0.0, 5.0]), ("B", 8, None), ("C", 3, [0.1])], "symbol string, horizon int, limits array<double>")
    found = {(r.symbol, r.part, r.kind, r.horizon, r.q): (r.trades, r.ret) for r in ledger.sweep(bars, cuts, (3, 8), kinds, ("val", "test")).collect()}
    assert {k[:1] + k[3:] for k in found} == {("A", 3, 0), ("A", 3, 1), ("A", 8, 0), ("A", 8, 1), ("B", 3, 0), ("B", 3, 1)} and len(found) == 6 * 2 * len(kinds)
    limits = {(r.symbol, r.horizon): r.limits for r in cuts.collect()}
    for (symbol, part, kind, h, q), (trades, ret) in found.items():
        own = pd.DataFrame([r for r in rows if r[:2] == (symbol, part)], columns=bars.columns)
        pred = own[f"pred_{h}"].astype(float)
        own["signal"] = [("LONG" if x > limits[symbol, h][q] else "SHORT" if x < -limits[symbol, h][q] else None) for x in pred]
        for c, x in {"horizon": h, "edge_bps": 0.0, "price": None, "size": None, "stop_bps": None, "take_bps": None}.items():
            own[c] = x
        made, _ = ledger.fold(own, kinds[kind])
        assert trades == len(made) and ret == pytest.approx(sum(x["pnl"] for x in made) / 10_000.0, abs=1e-9)
    assert max(n for n, _ in found.values()) > 20 and ledger.sweep(bars.limit(0), cuts, (3, 8), kinds, ("val",)).count() == 0


# --- ranks, quantiles, resamples ------------------------------------------------------------------


@pytest.mark.parametrize("span", [1_000_000, 7])
def test_ranks_and_quantiles(spark, monkeypatch, span):
    from barflow.operators import evaluation as E
    from barflow.plans import running as Q

    monkeypatch.setattr(Q, "ROWS_PER_SPAN", span)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, round(rng.gauss(0, 1), 1)]), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.quantiles for r in Q.quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    for g in ("a", "b", None):
        values = [x for k, x, _ in rows if k == g and x is not None]
        assert got[g] == pytest.approx(np.quantile(values, [0.0, 0.1, 0.5, 0.99, 1.0]).tolist())
    assert Q.quantiles(df, [], "y", [0.3]).first().quantiles == pytest.approx([np.quantile([r[2] for r in rows], 0.3)])
    scored = E.spearman(df.where("g = 'a'").withColumnsRenamed({"x": "pred"}), ["g"]).first()
    a = pd.DataFrame([r for r in rows if r[0] == "a" and r[1] is not None], columns=["g", "x", "y"])
    assert scored.ic == pytest.approx(np.corrcoef(a["x"].rank(), a["y"].rank())[0, 1]) and scored.n == len(a)
    seen = Q.running(df.where("g = 'a'").withColumn("k", F.monotonically_increasing_id()), ["g"], ["k"], F.floor(F.col("k") / 1000), "top", F.col("y"), "max", before=True).orderBy("k").collect()
    assert [r.top for r in seen] == [max((q.y for q in seen[:i]), default=None) for i in range(len(seen))]


def test_bootstrap_draws_what_resampling_gives(spark):
    from barflow.operators import evaluation as E

    rng = np.random.default_rng(1)
    values = {"base": rng.exponential(100, 41).round(), "other": rng.exponential(50, 60).round()}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("base", None)], "g string, v double")
    made = E.bootstrap_medians(df, "g", "v", draws=1500, seed=4).toPandas()
    for g, vs in values.items():
        plain = np.median(rng.choice(vs, (6000, len(vs))), axis=1)
        drawn = made.loc[made["g"] == g, "median"]
        assert len(drawn) == 1500 and np.allclose(np.quantile(drawn, [0.1, 0.25, 0.5, 0.75, 0.9]), np.quantile(plain, [0.1, 0.25, 0.5, 0.75, 0.9]), rtol=0.08)
    row = E.bootstrap_ratio(df, "g", "v", "base", draws=1500).first()
    ratios = np.median(rng.choice(values["other"], (4000, 60)), axis=1) / np.median(rng.choice(values["base"], (4000, 41)), axis=1)
    assert row.g == "other" and row.ratio == pytest.approx(np.median(values["other"]) / np.median(values["base"]))
    assert (row.low, row.high) == (pytest.approx(np.quantile(ratios, 0.025), rel=0.12), pytest.approx(np.quantile(ratios, 0.975), rel=0.12))


# --- streams, models ------------------------------------------------------------------------------


def test_staged_files_replay_in_order(spark):
    from barflow.streaming import runner as N

    rows = spark.range(500).select((499 - F.col("id")).alias("k")).repartition(5)
    path = N.staged(rows, "k", 7)
    seen = []
    stream = N.source(spark, path, rows.schema, 1)
    stream.writeStream.foreachBatch(lambda df, i: seen.append([r.k for r in df.collect()])).trigger(availableNow=True).option("checkpointLocation", N.shared_folder(spark)).start().awaitTermination()
    assert len(seen) == 7 and all(max(a) < min(b) for a, b in zip(seen, seen[1:])) and sorted(x for b in seen for x in b) == list(range(500))
    late = N.subscribed(spark, path, rows.schema)
    N.staged(spark.range(500, 530).withColumnRenamed("id", "k"), "k", 2, path)
    assert sorted(r.k for r in late().collect()) == list(range(500, 530))
    assert N.drained(N.source(spark, N.staged(rows.limit(0), "k", 3), rows.schema, 1)).count() == 0


def test_replay_follows_the_manifest_whatever_the_files_are_dated(spark):
    from barflow.streaming import runner as N

    rows = spark.range(120).withColumnRenamed("id", "k")
    path = N.staged(rows, "k", 6)
    for round_ in range(1, 12):  # more stagings than the log keeps apart
        N.staged(rows.withColumn("k", F.col("k") + 120 * round_), "k", 2, path)
    system, files = N._files(spark, path)
    for i, x in enumerate(random.Random(4).sample(list(files), len(files))):
        system.setTimes(x.getPath(), 1_000_000_000 + 1000 * i, -1)
    seen = []
    stream = N.source(spark, path, rows.schema, 1)
    stream.writeStream.foreachBatch(lambda df, i: seen.append([r.k for r in df.collect()])).trigger(availableNow=True).option("checkpointLocation", N.shared_folder(spark)).start().awaitTermination()
    assert len(seen) == 6 + 22 and all(max(a) < min(b) for a, b in zip(seen, seen[1:])) and sum(map(len, seen)) == 120 * 12


def test_metrics_go_on_after_a_broken_run_without_doubles(spark):
    from barflow.streaming import metrics as K
    from barflow.streaming import runner as N

    rng = random.Random(8)
    made = [(rng.choice(["a", "b", None]), "m", rng.choice([None, *[int(rng.lognormvariate(9, 3)) for _ in range(20)]]), rng.choice([None, *range(0, 60_000, 7)]), i) for i in range(2000)]
    rows = spark.createDataFrame(made, "service string, metric string, ns long, ts long, seq long")
    path, folder = N.staged(rows, "ts", 5), N.shared_folder(spark)
    run = lambda: K.record(N.source(spark, path, rows.schema, 1), f"{folder}/table", f"{folder}/state", merged=3)
    run()
    first = sorted(map(str, K.table(spark, f"{folder}/table").collect()))
    commits = f"{folder}/state/commits"
    last = N._numbers(spark, commits)[-1]
    N.forget(spark, f"{commits}/{last}")  # as if the run had ended before the micro-batch was known to be done
    run()
    assert sorted(map(str, K.table(spark, f"{folder}/table").collect())) == first
    N.staged(rows.withColumn("seq", F.col("seq") + 2000), "ts", 5, path)
    run()
    known = pd.DataFrame([x for x in made if x[2] is not None and x[3] is not None], columns=rows.columns)
    found = {x.service: x for x in K.totals(K.table(spark, f"{folder}/table")).collect()}
    for service in ("a", "b", None):
        own = known[known.service.isna() if service is None else known.service == service]
        x, newest = found[service], own.sort_values(["ts", "seq"]).iloc[-1]
        assert (x.counter, x.total, x.top, x.gauge) == (2 * len(own), 2 * own.ns.sum(), own.ns.max(), newest.ns)
        beats = [b for b in K.heartbeat(K.table(spark, f"{folder}/table")).collect() if b.service == service]
        assert {b.beat: (b.counter, b.total) for b in beats} == {b: (2 * (own.ts < b + 5000).sum(), 2 * own.ns[own.ts < b + 5000].sum()) for b in {t // 5000 * 5000 for t in own.ts}}
    assert K.table(spark, f"{folder}/none").count() == 0


def test_serving_table_writes_only_the_buckets_of_changed_keys(spark):
    from barflow.streaming import runner as N

    rows = [(k, i, float(i)) for i in range(0, 300) for k in ([i] if i < 200 else [7])] + [(7, 5, -1.0)]
    df = spark.createDataFrame(rows, "k int, at long, x double")
    folder = N.shared_folder(spark)
    N.serve_latest(N.source(spark, N.staged(df, "at", 6), df.schema, 1), "k", "at", f"{folder}/table", f"{folder}/state", buckets=32)
    want = {k: max((at, x) for k2, at, x in rows if k2 == k) for k in range(200)}
    assert {r.k: (r["at"], r.x) for r in N.latest_version(spark, f"{folder}/table", df.schema).collect()} == want
    numbers = N._numbers(spark, f"{folder}/table/manifest")
    last = json.loads(N._text(spark, f"{folder}/table/manifest/{numbers[-1]}.json"))["buckets"]
    assert len(numbers) == N.KEPT_VERSIONS and numbers[-1] == 5 and [n for n in last.values()].count(5) == 1 and len(last) > 20


def test_warm_start_is_a_stream_that_never_stopped(spark):
    from barflow.streaming import runner as N
    from barflow.streaming import typed as T

    rows = spark.createDataFrame([*walk(900, "A", 1, skip=(40, 700)), *walk(300, "B", 2)], BAR)
    run = lambda df, history=None: {(r.symbol, r.open_time): r for r in N.drained(T.stream_features(N.source(spark, N.staged(df, "open_time", 3), df.schema, 1), 60_000, history)).collect()}
    cut = 60_000 * 800
    whole = run(rows)
    warm = run(rows.where(F.col("open_time") >= cut), rows.where(F.col("open_time") < cut))
    assert len(warm) == 100 and all(s == "A" for s, _ in warm)
    for key, r in warm.items():
        assert (r.valid, r.gaps) == (whole[key].valid, whole[key].gaps) and all(getattr(r, c) == pytest.approx(getattr(whole[key], c), abs=1e-9) for c in X.FEATURES)


def test_forecasts_with_a_price_fill_at_once_in_batch_and_stream(spark):
    from barflow.streaming import runner as N
    from barflow.streaming import stateful as P

    rng = random.Random(3)
    rows = [("S", i, *[100.0 + rng.random()] * 4, rng.choice(["LONG", "SHORT", None]), rng.randrange(1, 5), 1.0, 100.5 if i % 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, signal string, horizon long, edge_bps double, price double")
    key = lambda df: sorted((r.side, r.entry_time, r.exit_time, round(r.pnl, 6), r.reason) for r in df.collect())
    batch = ledger.trades(df.withColumn("run", F.lit("a")), {"a": FLAT}).where("reason <> 'end'")
    assert key(batch) == key(N.drained(P.stream_ledger(N.source(spark, N.staged(df, "t", 4), df.schema, 1), FLAT))) and batch.where("entry_price = 100.5").count() > 5


def test_upsert_reads_only_the_spans_that_new_rows_touch(spark, tmp_path):
    path, day = str(tmp_path / "table"), 86_400_000
    made = lambda days: spark.createDataFrame([("S", d * day + i, float(i)) for d in days for i in range(5)], "symbol string, open_time long, x double")
    R.upsert(path, made(range(10)))
    R.upsert(path, made([8, 9, 10]))
    stored = spark.read.parquet(path)
    assert stored.count() == 55 and stored.select("symbol", "open_time").distinct().count() == 55
    plan = stored.where(R.touched(made([9, 10]).withColumn("span_", F.floor(F.col("open_time") / day))))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [span_#" in plan and "IN (9,10)" in plan


def test_snapshots_are_those_of_a_plain_scan(spark):
    from barflow.catalog.streams import tagged
    from barflow.streaming import runner as N
    from barflow.streaming import typed as T

    rows = tagged(spark, "/root/testdata/sf0.001").where("symbol = 'view'")
    got = sorted((r.sent, r.kind, round(r.obi, 9), round(r.flow, 9), round(r.vwap, 6)) for r in N.drained(T.stream_snapshots(N.source(spark, N.staged(rows, "sent", 3), rows.schema, 1), 3_600_000, 3600, 18_000)).collect())
    held, due, expected, book = [], -1, [], None
    for m in sorted(rows.collect(), key=lambda m: (m.sent, m.kind)):
        book = m if m.kind == "book" else book
        held += [m] if m.kind == "trade" else []
        if book is None or m.sent < due and m.kind != "bar":
            continue
        due = m.sent + 3_600_000
        wide = [t for t in held if t.sent // 1000 > m.sent // 1000 - 18_000]
        near = [t for t in wide if t.sent // 1000 > m.sent // 1000 - 3600]
        total, sold = sum(t.qty for t in near), sum(t.qty for t in near if t.is_buyer_maker)
        volume = sum(t.qty for t in wide)
        vwap = sum(t.price * t.qty for t in wide) / volume if volume else (book.bid + book.ask) / 2
        expected.append((m.sent, m.kind, round((book.bid_qty - book.ask_qty) / (book.bid_qty + book.ask_qty), 9), round((total - 2 * sold) / total if total else 0.0, 9), round(vwap, 6)))
    assert len(got) == len(expected) > 50
    for g, e in zip(got, sorted(expected)):
        assert g[:2] == e[:2] and g[2:] == pytest.approx(e[2:])


def test_components_are_those_of_numpy(spark):
    from barflow.operators import learning

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "vec_id long, v array<double>")
    out, shares = learning.principal_components(df, "v", F.col("vec_id") < 40, 2)
    centred = x - x[:40].mean(axis=0)
    values, axes = np.linalg.eigh(np.cov(centred[:40].T))
    expected = centred @ axes[:, ::-1][:, :2]
    got = np.array([r.components for r in out.orderBy("vec_id").collect()])
    assert got.shape == (60, 2) and np.allclose(np.abs(got), np.abs(expected)) and shares == pytest.approx((values[::-1][:2] / values.sum()).tolist())


def test_window_model_scores_as_a_plain_loop(spark, monkeypatch):
    from barflow.operators.learning import fit_window_model
    from barflow.plans import blocks
    from barflow.streaming import scoring as C

    monkeypatch.setattr(blocks.blocked, "__defaults__", (0, "symbol", "open_time", 50))  # several blocks
    rng = np.random.default_rng(5)
    rows = [(s, i * 60_000, float(np.exp(0.01 * rng.normal() + 3)), None if i % 31 == 0 else float(rng.normal()), float(rng.normal() * 3), i, "train" if i < 120 else "val") for s in "ab" for i in range(170)]
    df = spark.createDataFrame(rows, "symbol string, open_time long, close double, f double, g double, rn long, split string")
    model = fit_window_model(df, ["f", "g"], (1, 3), 8)
    mean, std = np.array(model["mean"]), np.array(model["std"])
    assert mean == pytest.approx([np.mean([r[k] or 0 for r in rows if r[6] == "train"]) for k in (3, 4)])
    z = {s: np.clip((np.array([[r[3] or 0, r[4]] for r in rows if r[0] == s]) - mean) / std, -5, 5) for s in "ab"}
    close = {s: [r[2] for r in rows if r[0] == s] for s in "ab"}

    def line(s, i):  # the newest row, then means over lags 1 to 3 and 4 to 7
        return [1, *z[s][i], *z[s][i - 3 : i].mean(axis=0), *z[s][i - 7 : i - 3].mean(axis=0)]

    for at, h in enumerate((1, 3)):
        use = [(s, i) for s in "ab" for i in range(7, 120)]
        x, y = np.array([line(*u) for u in use]), np.array([np.log(close[s][i + h] / close[s][i]) for s, i in use])
        scale = y.std()
        fitted = np.linalg.solve(x.T @ x / len(x) + 0.01 * np.diag([1e-9] + [1] * 6), x.T @ (y / scale) / len(x))
        weights = np.array(model["weights"][at])
        assert weights.shape == (8, 2) and model["bias"][at] == pytest.approx(fitted[0]) and model["scale"][at] == pytest.approx(scale)
        assert weights[0] == pytest.approx(fitted[1:3]) and weights[1:4].sum(axis=0) == pytest.approx(fitted[3:5]) and weights[4:].sum(axis=0) == pytest.approx(fitted[5:])
        held = [(s, i) for s in "ab" for i in range(120, 170 - h)]
        left = [np.log(close[s][i + h] / close[s][i]) - scale * float(np.dot(line(s, i), fitted)) for s, i in held]
        assert model["sigma"][at] == pytest.approx(np.std(left))
    model["weights"] = [[[0.1 * lag + at, -0.2 * lag] for lag in range(8)] for at in range(2)]  # any weights, each lag its own
    got = {(r.symbol, r.open_time): r for r in C.score(df, model | {"version": 4}).collect()}
    assert len(got) == 2 * (170 - 7)
    for s in "ab":
        for i in range(7, 170):
            exp = [(b + sum(w[lag][k] * z[s][i - lag][k] for lag in range(8) for k in range(2))) * c for w, b, c in zip(model["weights"], model["bias"], model["scale"])]
            assert got[s, i * 60_000].exp == pytest.approx(exp) and got[s, i * 60_000].model_version == 4
    raw = np.array([r[3:5] for r in rows[32:40]], float)
    assert not np.allclose(C.window_scores(raw, model), C.window_scores(raw[::-1], model))
    assert C.score(df.limit(0), model).collect() == []


@pytest.mark.parametrize("fit", ["fit_forecaster", "fit_gbt_reg", "fit_gbt_cls"])
def test_fits_find_a_plain_relation(spark, fit):
    from barflow.operators import learning

    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        x = rng.normal(size=2)
        rows.append(("S", i, "train" if i < 400 else "val" if i < 500 else "test", *map(float, x), float(0.002 * x[0] + 0.0002 * rng.normal())))
    df = spark.createDataFrame(rows, "symbol string, open_time long, split string, a double, b double, y double")
    made = getattr(learning, fit)(df, "y", ["a", "b"])
    out = (learning.expected_moves if fit == "fit_gbt_cls" else learning.predicted)(made[0], df, made[1], ["a", "b"]).where("split = 'test'").toPandas()
    assert len(out) == 100 and np.corrcoef(out["pred"], out["y"])[0, 1] > 0.8 and (np.sign(out["pred"]) == np.sign(out["y"])).mean() > 0.8


def test_compared_sets_find_a_relation_only_where_its_input_is(spark, monkeypatch):
    from barflow.catalog import models

    rng = np.random.default_rng(3)
    inputs = [*X.FEATURES, *[f"score_{i}" for i in range(models.SCORES)], *[f"component_{i}" for i in range(models.COMPONENTS)]]
    rows = pd.DataFrame(rng.normal(size=(2000, len(inputs))), columns=inputs)
    rows.insert(0, "y_5", 0.01 * (np.where(rows["score_2"] > 0, 1.0, -1.0) + 0.5 * rows["ret_1"] + rng.normal(size=2000)))
    rows.insert(0, "split", np.repeat(["train", "val", "test"], [1200, 400, 400]))
    rows.insert(0, "open_time", np.arange(2000))
    rows.insert(0, "symbol", "S")
    rows = spark.createDataFrame(rows)
    monkeypatch.setattr(models, "enriched", lambda *a: rows)
    monkeypatch.setattr(models, "SEEDS", (0,))
    found = {r["set"]: r for r in models.feature_set_compare(spark, "").collect()}
    plain, both, all_, other = (found[s] for s in ("features", "features, scores", "features, scores, embedding", "scores, embedding"))
    assert len(found) == 4 and all(r.n == 400 and 0 < r.trades < 400 for r in found.values())
    assert min(both.ic, all_.ic) > other.ic > 0.5 > plain.ic > 0.1
    assert min(both.r2_zero, all_.r2_zero) > other.r2_zero > 0.2 > plain.r2_zero
    assert min(both.net_bps_total, all_.net_bps_total, other.net_bps_total) > 0 and both.hit_rate > 0.75


def test_agent_queries_give_what_a_plain_run_of_each_symbol_gives(spark, sf_dir):
    from barflow.catalog import ledgers, models

    rows = models.advised(spark, sf_dir).toPandas()
    filled = rows.fillna({c: 0.0 for c in ("confidence", "size", "stop_bps", "take_bps", "horizon", "horizon_bars")}).astype(object)
    filled = filled.where(filled.notna(), None)
    runs = {s: agent.follow(part, agent.Gate(), ledgers.CONFIGS["plain"], ends=True) for s, part in filled.groupby("symbol")}
    compared = {r.symbol: r for r in catalog.QUERIES["run_compare"](spark, sf_dir).collect()}
    assert set(compared) == set(runs)
    for s, out in runs.items():
        assert compared[s].calls == len(out) - 1 and compared[s].agent == pytest.approx(out.iloc[-1]["equity"] / 10_000 - 1, abs=1e-6)
    logged = sorted((r.symbol, r.t, r.reason, r.action, r.vetoes) for r in catalog.QUERIES["decision_log_sink"](spark, sf_dir).collect())
    assert logged == sorted((s, *x) for s, out in runs.items() for x in out.loc[out["reason"] != "end", ["t", "reason", "action", "vetoes"]].itertuples(index=False))


def test_report_of_a_fit_has_its_parts_and_counts(spark, sf_dir, monkeypatch):
    from barflow.catalog import models

    known = models.samples(spark, sf_dir, models.HORIZONS)
    rows = models.report_rows(spark, sf_dir)
    parts = {(h, r.split): r["count"] for h in models.HORIZONS for r in known.where(f"y_{h} IS NOT NULL").groupBy("split").count().collect()}
    monkeypatch.setattr(models, "report_rows", lambda *a: rows)
    found = {(r.horizon, r.split): r for r in models.artifact_report(spark, sf_dir).collect()}
    assert {k: r.n for k, r in found.items()} == parts and len({r.version for r in found.values()}) == 1
    for (h, split), own in rows.toPandas().groupby(["horizon", "split"]):
        r = found[h, split]
        assert len(r.version) == 12 and r.sigma > 0 and r.y_scale == pytest.approx(known.where("split = 'train'").toPandas()[f"y_{h}"].std(ddof=0))
        moved = own[own.y != 0]
        assert r.hit_rate == pytest.approx((np.sign(moved.pred) == np.sign(moved.y)).mean(), abs=1e-6)
        assert r.r2_zero == pytest.approx(1 - ((own.y - own.pred) ** 2).mean() / (own.y**2).mean(), abs=1e-6) and r.ic == pytest.approx(own.pred.rank().corr(own.y.rank()), abs=1e-6)
        taken = own[own.place % h == 0]
        side = np.where(taken.pred * 1e4 > models.REPORT_BPS, 1, np.where(taken.pred * 1e4 < -models.REPORT_BPS, -1, 0))
        net = side * taken.y - abs(side) * models.REPORT_COST / 1e4
        assert (r.trades, r.periods) == (abs(side).sum(), len(taken)) and r.net_return == pytest.approx(net.sum()) and r.gross_return == pytest.approx((side * taken.y).sum())
        assert r.net_sharpe == pytest.approx(net.mean() / net.std(ddof=0) * math.sqrt(models.YEAR_BARS / h) if net.std(ddof=0) > 0 else 0.0)


def test_clusters_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from barflow.plans import lineage

    made = []
    context = SimpleNamespace(master="local[4]", getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    assert lineage.shared_root(session) == made[0]
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        context.master = master
        with pytest.raises(RuntimeError):
            lineage.shared_root(session)


def test_cash_below_the_smallest_double_is_no_error():
    prices = [(100.0, 100, 1, 1), (100, 100, 100, 100)] * 400
    rows = pd.DataFrame([(i, *map(float, b), "LONG" if i % 2 else None, 1, 0.0, None, None, None, None) for i, b in enumerate(prices)], columns=["t", "open", "high", "low", "close", "signal", "horizon", "edge_bps", "price", "size", "stop_bps", "take_bps"])
    trades, curve = ledger.fold(rows, ledger.Rules(cash=1000.0, fee_bps=0, slippage_bps=0))
    assert len(trades) > 100 and curve["equity"].iloc[-1] < 1e-300 and len(curve) == 800
    assert ledger.money(ledger.Holding(1, 0, 100.0, 1, 0.0, 0.5, 0.0, 0.0, 1, exit_price=1.0), 5e-324, FLAT)["qty"] == 0


def test_reports_round_large_equity_as_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(3)
    values = [10 ** rng.uniform(9, 12) for _ in range(3000)] + [1e291, 5e-324, -0.0]
    equity = spark.createDataFrame([("plain", "S", i * 60_000, x) for i, x in enumerate(values)], "run string, symbol string, t long, equity double")
    trades = spark.createDataFrame([("plain", "S", 0, 60_000)], "run string, symbol string, entry_time long, exit_time long")
    sinks.write_report(trades, equity, trades.select("run"), str(tmp_path))
    made = [x.equity for x in sinks.read_report(spark, str(tmp_path))[1].orderBy("time").collect()]
    frame = pd.DataFrame({"i": range(len(values)), "x": values})  # noqa: F841
    assert made == [x for (x,) in duckdb.sql("SELECT round(x, 4) + 0.0 FROM frame ORDER BY i").fetchall()]


def test_agents_whose_position_is_of_no_worth_are_no_error():
    account = agent.Account(agent.Gate(), ledger.Book(FLAT), 5e-324)
    traded = account.settle([ledger.Holding(1, 0, 100.0, 1, 0.0, 0.5, 0.0, 0.0, 1, exit_price=1.0)])
    assert [t["pnl"] for t in traded] == [0] and account.cash == 5e-324


def test_prices_of_zero_make_infinities_as_in_sql(spark):
    from barflow.functions.ratios import log_ratio, ratio

    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (None, 0.0)], "a double, b double")
    got = [(x.q, x.l) for x in rows.select(ratio("a", "b").alias("q"), log_ratio("a", "b").alias("l")).collect()]
    assert got[0] == (0.5, math.log(0.5)) and got[1] == (math.inf, math.inf) and got[2] == (0.0, -math.inf) and all(map(math.isnan, got[3])) and got[4] == (None, None)
    bars = [("S", i * 60_000, i * 60_000 + 59_999, p, p, p, p, 1.0, 1, 0.5) for i, p in enumerate([10.0] * 100 + [0.0] + [10.0] * 200)]
    bars = spark.createDataFrame(bars, "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume double, trades long, taker double")
    made = {x.open_time // 60_000: x for x in X.features_14(bars).collect()}
    assert made[100].ret_1 == -math.inf and made[101].ret_1 == math.inf and made[100].atr_pct_14 == math.inf and math.isnan(made[100].range_pct)
    wide = {x.open_time // 60_000: x for x in X.extra_features(bars, 10, 20, 40, 5).collect()}
    assert wide[105].rms_short == math.inf and math.isnan(wide[102].mean_range) and wide[250].rms_short == 0 and wide[250].mean_range == 0


def events_of(spark, folder, prices):
    """An events table of one symbol with a trade a minute at these prices, and DuckDB with the same table."""
    import duckdb

    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 7, "S", float(p), '{"k": 1}') for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


def as_in_sql(spark, con, folder, name):
    """Rows of a query, and how many of them differ from its SQL; a null, NaN and a number are three things here."""
    shown = lambda x: None if x is None else "NaN" if x != x else x if not isinstance(x, float) or math.isinf(x) else round(x, 5) + 0.0
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    expected = sorted((tuple(map(shown, x)) for x in found.fetchall()), key=repr)
    made = sorted((tuple(map(shown, x)) for x in catalog.QUERIES[name](spark, folder).select(*names).collect()), key=repr)
    return made, sum(a != b for a, b in zip(made, expected)) + abs(len(made) - len(expected))


def zero_prices(n):
    """A walk in which the price falls to 0 for one minute, then for two, so that it moves from 0 to 0."""
    prices = [round(x[5] / 20, 2) for x in walk(n)]
    for i in (n // 2, n - 30, n - 29):
        prices[i] = 0.0
    return prices


def test_cleaned_features_keep_what_the_sql_keeps(spark, tmp_path):
    con = events_of(spark, tmp_path, zero_prices(200))
    rows, different = as_in_sql(spark, con, str(tmp_path), "null_inf_clean")
    assert len(rows) == 151 and different == 0 and any(math.inf in x for x in rows) and any("NaN" in x for x in rows)
    cleaned = X.clean_features(spark.createDataFrame([(1.0, 2.0), (-math.inf, 3.0), (math.nan, 4.0), (None, 5.0)], "a double, b double"), ("a",))
    assert sorted(tuple(x) for x in cleaned.collect()) == [(0.0, 3.0), (1.0, 2.0)]


@pytest.mark.parametrize("name", ["rv_annualised", "vol_regime", "stream_regimes"])
def test_regimes_after_a_price_of_zero_are_those_of_the_sql(spark, tmp_path, name):
    con = events_of(spark, tmp_path, zero_prices(400))
    rows, different = as_in_sql(spark, con, str(tmp_path), name)
    assert len(rows) == 400 and different == 0 and any(x in row for row in rows for x in ("NaN", "HIGH"))


def test_streamed_features_after_a_price_of_zero_are_those_of_the_sql(spark, tmp_path):
    con = events_of(spark, tmp_path, zero_prices(200))
    rows, different = as_in_sql(spark, con, str(tmp_path), "stream_features")
    assert len(rows) == 200 and different == 0 and any(math.inf in x for x in rows) and any("NaN" in x for x in rows)


def test_flow_over_many_seconds_equals_a_plain_sum(spark):
    draw = random.Random(3)
    trades = [("S", i, draw.randint(1, 400) / 4, float(draw.randint(1, 9)), draw.random() < 0.5, t * 1000) for i, t in enumerate(sorted(draw.sample(range(80_000, 95_000), 400)))]
    rows = spark.createDataFrame(trades, "symbol string, trade_id long, price double, qty double, is_buyer_maker boolean, trade_time long")
    flow = M.flow(M.second_buckets(rows), 60, 300)
    assert "unboundedpreceding" in flow._jdf.queryExecution().toString().lower() and flow.count() == 400
    for x in flow.collect():
        own = [t for t in trades if x.sec - 300 < t[5] // 1000 <= x.sec]
        near = [t for t in own if t[5] // 1000 > x.sec - 60]
        share = lambda ts: sum(-t[3] if t[4] else t[3] for t in ts) / sum(t[3] for t in ts)
        assert (x.flow_short, x.flow_long, x.trade_rate) == (share(near), share(own), len(near) / 60) and x.vwap == pytest.approx(sum(t[2] * t[3] for t in own) / sum(t[3] for t in own))


def test_ledgers_named_by_their_sql_are_not_bounded():
    from barflow.catalog import ledgers

    assert all(rules.most == math.inf for rules in ledgers.WHOLE.values())
    for name in ("position_ledger", "equity_curve", "run_summary", "recent_trades", "compare_runs", "mark_to_market", "report_sinks", "stream_ledger"):
        assert "least(cash" not in catalog.ORACLES[name] and "least(c " not in catalog.ORACLES[name] and "k.most" not in catalog.ORACLES[name]


def test_a_summary_keeps_what_is_not_a_number(spark):
    trades = spark.createDataFrame([("a", "LONG", 1.0, math.nan, math.inf, "horizon"), ("a", "LONG", -1.0, 2.0, 1.0, "end")], "run string, side string, pnl double, ret_bps double, fees double, reason string")
    equity = spark.createDataFrame([(run, t, 100.0 + t, False) for run in "ab" for t in range(3)], "run string, t long, equity double, in_market boolean")
    made = {x.run: x for x in E.run_summary(trades, equity, ["run"], 100.0, 525_600.0).collect()}
    assert math.isnan(made["a"].avg_trade_bps) and made["a"].fees_paid == math.inf and made["a"].trades == 2 and made["a"].exits_end == 1
    assert (made["b"].trades, made["b"].avg_trade_bps, made["b"].fees_paid, made["b"].win_rate_pct, made["b"].profit_factor) == (0, 0.0, 0.0, 0.0, None)


def test_a_window_model_of_infinite_targets_has_no_finite_score(spark, tmp_path):
    from barflow.operators.learning import clipped, fit_window_model
    from barflow.streaming import scoring as C

    assert clipped(np.array([9.0, -9.0, np.nan, 1.0]), 0.0, 1.0).tolist() == [5.0, -5.0, 5.0, 1.0]
    rng = np.random.default_rng(9)
    rows = [("S", i * 60_000, 0.0 if i == 60 else float(np.exp(0.01 * rng.normal() + 3)), None if i % 31 == 0 else float(rng.normal()), i, "train" if i < 120 else "val") for i in range(170)]
    df = spark.createDataFrame(rows, "symbol string, open_time long, close double, f double, rn long, split string")
    C.write_model(spark, f"{tmp_path}/models", 1, fit_window_model(df, ["f"], (1, 3), 8))
    made = C.score(df, C.latest_model(spark, f"{tmp_path}/models", ["f"])).collect()
    assert len(made) == 163 and all(math.isnan(x) for row in made for x in [*row.exp, row.edge_bps]) and {(x.signal, x.horizon) for x in made} == {("LONG", 1)}
    late = C.score(df, fit_window_model(df.where("open_time > 3600000").withColumn("rn", F.col("rn") - 61), ["f"], (1, 3), 8)).collect()
    assert all(math.isfinite(x) for row in late for x in row.exp)


class _Kept(dict):
    """State as a processor sees it, which counts the calls."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.calls, self[key] = self.calls + 1, value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        self.pop(key, None)

    def exists(self):
        return bool(self)

    def get(self):
        return self["x"]

    def update(self, value):
        self["x"] = value


def _started(processor):
    """A processor and its map, without a stream."""
    kept = _Kept()
    processor.init(type("Handle", (), {"getMapState": lambda *_: kept, "getValueState": lambda *_: _Kept()})())
    return lambda rows: pd.concat([pd.DataFrame(), *processor.handleInputRows(("A",), iter([rows]), None)], ignore_index=True), kept


def test_rolled_seconds_take_few_state_calls_and_are_those_of_one_pass():
    from barflow.streaming import typed as T

    rng = np.random.default_rng(5)
    at = np.sort(rng.choice(60_000, 20_000, replace=False))
    rows = pd.DataFrame({"symbol": "A", "sec": at, "buy": rng.integers(0, 9, 20_000) * 0.1, "sell": 0.5, "n": 1, "notional": rng.random(20_000) * 100})
    run, kept = _started(T.Rolled(600, 3000))
    got = pd.concat([run(rows[i : i + 5000]) for i in range(0, 20_000, 5000)], ignore_index=True)
    assert kept.calls < 100 and sum(len(v[0]) for v in kept.values()) == (at > at[-1] - 3000).sum()
    for i in (0, 7, 4999, 5000, 5001, 12_345, 19_999):
        near, wide = (rows[(rows.sec > at[i] - span) & (rows.sec <= at[i])] for span in (600, 3000))
        assert (got.flow_short[i], got.trade_rate[i]) == pytest.approx(((near.buy.sum() - near.sell.sum()) / (near.buy.sum() + near.sell.sum()), len(near) / 600))
        assert got.vwap[i] == pytest.approx(wide.notional.sum() / (wide.buy.sum() + wide.sell.sum()))


def test_snapshots_take_few_state_calls_and_are_those_of_a_plain_scan_over_micro_batches():
    from barflow.streaming import typed as T

    rng = np.random.default_rng(6)
    n = 40_000
    rows = pd.DataFrame({"symbol": "A", "sent": np.sort(rng.integers(0, 60_000_000, n)), "kind": rng.choice(["bar", "book", "trade"], n, p=[0.02, 0.18, 0.8])})
    for c in ("bid", "ask", "bid_qty", "ask_qty", "price", "qty"):
        rows[c] = np.where((rows.kind == "trade") == (c in ("price", "qty")), rng.integers(1, 99, n), np.nan)
    rows["is_buyer_maker"] = [None if k != "trade" else bool(x) for k, x in zip(rows.kind, rng.integers(0, 2, n))]
    rows = rows.sort_values(["sent", "kind"], kind="stable", ignore_index=True)
    run, kept = _started(T.Snapshots(20_000, 600, 3000))
    got = pd.concat([run(rows[i : i + 8000]) for i in range(0, n, 8000)], ignore_index=True)
    assert kept.calls < 100
    expected, due, book = [], -1, None
    trades = rows[rows.kind == "trade"]
    for m in rows.itertuples():
        book = m if m.kind == "book" else book
        if book is not None and (m.sent >= due or m.kind == "bar"):
            due = m.sent + 20_000
            expected.append((m.Index, m.sent, m.kind, (book.bid + book.ask) / 2))
    assert [tuple(x) for x in got[["sent", "kind", "mid"]].to_numpy()] == [x[1:] for x in expected] and len(expected) > 2000
    for i in range(0, len(expected), 97):
        index, sent = expected[i][:2]
        near, wide = (trades[(trades.index <= index) & (trades.sent // 1000 > sent // 1000 - span)] for span in (600, 3000))
        sold = near.qty[near.is_buyer_maker.astype(bool)].sum()
        assert (got.flow[i], got.trade_rate[i], got.vwap[i]) == pytest.approx(((near.qty.sum() - 2 * sold) / near.qty.sum() if len(near) else 0.0, len(near) / 600, (wide.price * wide.qty).sum() / wide.qty.sum() if len(wide) else expected[i][3]))
