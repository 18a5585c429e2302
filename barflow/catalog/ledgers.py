"""Ledgers of naive signals over a grid of rules, their summaries and comparisons."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.catalog import query
from barflow.catalog.common import HORIZONS, NUMBERED, W, YEAR_BARS, pick, r, rounded
from barflow.catalog.signals import _FORECAST, decided
from barflow.functions.ratios import ratio
from barflow.operators import evaluation as E
from barflow.operators import ledger as G
from barflow.operators.labels import past_returns
from barflow.operators.learning import finite
from barflow.plans.lineage import checkpointed
from barflow.plans.running import quantiles
from barflow.sources import adapters as A

#: Where the SQL of a query has the bound, no position is worth more than ten times the cash at the start. The ledgers themselves, their curves and summaries have none.
MOST = 100_000.0
CONFIGS = {
    "plain": G.Rules(most=MOST), "tight": G.Rules(stop_bps=3000, take_bps=6000, most=MOST), "long": G.Rules(allow_short=False, size=0.5, most=MOST), "free": G.Rules(fee_bps=0, slippage_bps=0, stop_bps=5000, most=MOST),
}
WHOLE = {name: replace(rules, most=float("inf")) for name, rules in CONFIGS.items()}


def fed(spark, sf_dir):
    """Bars beside the decisions taken on them."""
    bars = A.bars(spark, sf_dir).select("symbol", F.col("open_time").alias("t"), "open", "high", "low", "close")
    signals = decided(spark, sf_dir).select("symbol", F.col("open_time").alias("t"), "signal", F.col("horizon").cast("long").alias("horizon"), "edge_bps")
    return bars.join(signals, ["symbol", "t"], "left")


def _money(side: str, cash: str, price: str, out: str, bounded: bool) -> str:
    """Profit and fees of a position for the SQL: all columns but the last two are inputs."""
    qty = f"(least({cash} * k.size, k.most) / {price})" if bounded else f"({cash} * k.size / {price})"
    return f"{side} * {qty} * ({out} - {price}) - {qty} * {price} * k.rate - {qty} * {out} * k.rate"


def _ledger_sql(bounded: bool) -> str:
    """The ledger row by row: what waits is done at the open, then stop or take, then the horizon at the close; a bar ends two positions at most."""
    most = ", most" if bounded else ""
    stake = "stake" if bounded else "cash * size"
    return f"""{_FORECAST},
 rules AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {c.fee_bps / 1e4!r}::DOUBLE, {c.slippage_bps}::DOUBLE, {c.size}::DOUBLE, {c.stop_bps}::DOUBLE, {c.take_bps}::DOUBLE, {str(c.allow_short).lower()}{f', {c.most!r}::DOUBLE' if bounded else ''})" for n, c in CONFIGS.items())}) v(run, rate, slip, size, stop, take, shorts{most})),
 feed AS (SELECT b.symbol, b.open_time AS t, b.open, b.high, b.low, b.close, d.signal, CAST(d.horizon AS BIGINT) AS horizon, d.edge_bps, row_number() OVER (PARTITION BY b.symbol ORDER BY b.open_time) - 1 AS n,
   count(*) OVER (PARTITION BY b.symbol) AS total FROM bars b LEFT JOIN decided d USING (symbol, open_time)),
 acts AS (SELECT *, lag(signal) OVER w AS sig, lag(horizon) OVER w AS hor, lag(edge_bps) OVER w AS edge_in FROM feed WINDOW w AS (PARTITION BY symbol ORDER BY n)),
 steps AS (SELECT run, symbol, CAST(-1 AS BIGINT) AS n, 0 AS side, CAST(0 AS BIGINT) AS entry_t, 1.0::DOUBLE AS price, CAST(0 AS BIGINT) AS planned, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS held, 0.0::DOUBLE AS edge, 10000.0::DOUBLE AS cash,
   false AS a_done, 0 AS a_side, CAST(0 AS BIGINT) AS a_entry, 0.0::DOUBLE AS a_price, 0.0::DOUBLE AS a_exit, 0.0::DOUBLE AS a_cash, CAST(0 AS BIGINT) AS a_bars, CAST(0 AS BIGINT) AS a_planned, 0.0::DOUBLE AS a_edge,
   false AS b_done, 0 AS b_side, CAST(0 AS BIGINT) AS b_entry, 0.0::DOUBLE AS b_price, 0.0::DOUBLE AS b_exit, 0.0::DOUBLE AS b_cash, CAST(0 AS BIGINT) AS b_bars, CAST(0 AS BIGINT) AS b_planned, 0.0::DOUBLE AS b_edge, '' AS b_reason, false AS in_market
  FROM rules, (SELECT DISTINCT symbol FROM feed)
  UNION ALL
  SELECT run, symbol, n, CASE WHEN closes THEN 0 ELSE side1 END, entry1, price1, planned1, until1, held2, edge1, cash1 + CASE WHEN closes AND ok1 THEN b_pnl ELSE 0 END,
   reverses AND a_ok, side0, entry0, price0, a_out, cash0, held0, planned0, edge0, closes AND ok1, side1, entry1, price1, b_out, cash1, held2, planned1, edge1, CASE WHEN stopped THEN 'stop' WHEN taken THEN 'take' ELSE 'horizon' END, stays AND ok1
  FROM (SELECT k.run, a.symbol, a.n, s.side AS side0, s.entry_t AS entry0, s.price AS price0, s.held AS held0, s.planned AS planned0, s.edge AS edge0, s.cash AS cash0,
   CASE WHEN a.sig = 'LONG' THEN 1 WHEN a.sig = 'SHORT' AND k.shorts THEN -1 ELSE 0 END AS want, want <> 0 AND s.side <> want AS opens, opens AND s.side <> 0 AS reverses,
   a.open * (1 - s.side * k.slip / 1e4) AS a_out, s.cash > 0 AND k.size > 0 AND s.price > 0 AS a_ok, {_money('s.side', 's.cash', 's.price', 'a_out', bounded)} AS a_pnl, s.cash + CASE WHEN reverses AND a_ok THEN a_pnl ELSE 0 END AS cash1,
   CASE WHEN opens THEN want ELSE s.side END AS side1, CASE WHEN opens THEN a.open * (1 + want * k.slip / 1e4) ELSE s.price END AS price1, CASE WHEN opens THEN a.t ELSE s.entry_t END AS entry1,
   CASE WHEN opens THEN a.hor ELSE s.planned END AS planned1, CASE WHEN opens THEN a.hor WHEN want <> 0 THEN s.held + a.hor ELSE s.until END AS until1, CASE WHEN opens THEN 0 ELSE s.held END AS held1, CASE WHEN opens THEN a.edge_in ELSE s.edge END AS edge1,
   price1 * (1 - side1 * k.stop / 1e4) AS stop_at, price1 * (1 + side1 * k.take / 1e4) AS take_at,
   side1 <> 0 AND k.stop > 0 AND stop_at * side1 >= CASE WHEN side1 > 0 THEN a.low ELSE a.high END * side1 AS stopped, side1 <> 0 AND NOT stopped AND k.take > 0 AND take_at * side1 <= CASE WHEN side1 > 0 THEN a.high ELSE a.low END * side1 AS taken,
   side1 <> 0 AND NOT stopped AND NOT taken AS stays, held1 + stays::BIGINT AS held2, stopped OR taken OR stays AND held2 >= until1 AS closes,
   CASE WHEN stopped THEN side1 * least(side1 * a.open, side1 * stop_at) WHEN taken THEN side1 * greatest(side1 * a.open, side1 * take_at) ELSE a.close END * (1 - side1 * k.slip / 1e4) AS b_out,
   cash1 > 0 AND k.size > 0 AND price1 > 0 AS ok1, {_money('side1', 'cash1', 'price1', 'b_out', bounded)} AS b_pnl
   FROM steps s JOIN acts a ON a.symbol = s.symbol AND a.n = s.n + 1 JOIN rules k ON k.run = s.run)),
 walked AS (SELECT s.*, f.t, f.close, f.n = f.total - 1 AS last, k.rate, k.slip, k.size{', k.most' if bounded else ''} FROM steps s JOIN feed f ON f.symbol = s.symbol AND f.n = s.n JOIN rules k USING (run)),
 ended AS (SELECT *, {'least(cash * size, most) AS stake, ' if bounded else ''}close * (1 - side * slip / 1e4) AS e_exit, last AND side <> 0 AND cash > 0 AND size > 0 AND price > 0 AS e_done FROM walked),
 closed AS (SELECT run, symbol, a_side AS s, a_entry AS entry_time, a_price AS entry_price, t AS exit_time, a_exit AS exit_price, a_cash AS c, a_bars AS bars, 'reverse' AS reason, a_planned AS horizon, a_edge AS edge_bps, rate, size{most} FROM ended WHERE a_done
  UNION ALL SELECT run, symbol, b_side, b_entry, b_price, t, b_exit, b_cash, b_bars, b_reason, b_planned, b_edge, rate, size{most} FROM ended WHERE b_done
  UNION ALL SELECT run, symbol, side, entry_t, price, t, e_exit, cash, held, 'end', planned, edge, rate, size{most} FROM ended WHERE e_done),
 ledger AS (SELECT run, symbol, CASE WHEN s > 0 THEN 'LONG' ELSE 'SHORT' END AS side, entry_time, entry_price, exit_time, exit_price, {'least(c * size, most)' if bounded else 'c * size'} / entry_price AS qty,
   s * qty * (exit_price - entry_price) - qty * entry_price * rate - qty * exit_price * rate AS pnl, qty * entry_price * rate + qty * exit_price * rate AS fees, pnl / (qty * entry_price) * 1e4 AS ret_bps, bars, reason, horizon, edge_bps FROM closed),
 curve AS (SELECT run, symbol, t, CASE WHEN e_done THEN cash + side * ({stake} / price) * (e_exit - price) - {stake} * rate - ({stake} / price) * e_exit * rate
   WHEN side <> 0 AND cash > 0 AND size > 0 AND price > 0 THEN cash - {stake} / price * price * rate + side * ({stake} / price) * (close - price) ELSE cash END AS equity, in_market FROM ended)"""


LEDGER_COLUMNS = "run symbol side entry_time exit_time bars reason horizon"
LEDGER_PRICES, LEDGER_VALUES = "entry_price exit_price", "qty pnl fees ret_bps edge_bps"
#: Prices have up to six digits after the slippage, so four would meet ties.
LEDGER_SQL_COLUMNS = f"{', '.join(LEDGER_COLUMNS.split())}, {rounded(LEDGER_PRICES, 8)}, {rounded(LEDGER_VALUES, 4)}"


def _ledger_rows(df, keys=""):
    return df.select(*LEDGER_COLUMNS.split(), *keys.split(), *[r(c, 8).alias(c) for c in LEDGER_PRICES.split()], *[r(c, 4).alias(c) for c in LEDGER_VALUES.split()])


def _sql(select: str, more: str = "", bounded: bool = False) -> str:
    return f"WITH RECURSIVE {_ledger_sql(bounded)}{', ' + more if more else ''} {select}"


def books(spark, sf_dir, rules=CONFIGS):
    """Trades and equity curves of all sets of rules, folded once and read as often as needed.

    Books of bounded rules hold finite numbers only: the edge of a forecast from a price of 0, which has no bound, counts as unknown in them.
    """
    rows = fed(spark, sf_dir)
    return G.parted(checkpointed(G.both(finite(rows, ["edge_bps"]) if rules is CONFIGS else rows, rules)))


def ledger(spark, sf_dir, rules=CONFIGS):
    return G.parted(G.both(fed(spark, sf_dir), rules))[0]


def curves(spark, sf_dir, rules=CONFIGS):
    return G.parted(G.both(fed(spark, sf_dir), rules))[1]


@query(_sql(f"SELECT {LEDGER_SQL_COLUMNS} FROM ledger"))
def position_ledger(spark, sf_dir):
    return _ledger_rows(ledger(spark, sf_dir, WHOLE))


@query(_sql("SELECT run, symbol, t, round(equity, 4) + 0.0 AS equity, in_market FROM curve"))
def equity_curve(spark, sf_dir):
    return pick(curves(spark, sf_dir, WHOLE), "run symbol t in_market", "equity", 4)


_SUMMARY = "end_equity max_drawdown_pct sharpe_ann exposure_pct total_return_pct win_rate_pct avg_trade_bps profit_factor fees_paid"
_COUNTS = "bars trades longs shorts exits_horizon exits_stop exits_take exits_reverse exits_end"


@query(_sql(f"SELECT run, symbol, {', '.join(_COUNTS.split())}, {rounded(_SUMMARY, 4)} FROM summary", f"""
 path AS (SELECT *, lag(equity, 1, 10000.0::DOUBLE) OVER w AS before, greatest(max(equity) OVER (PARTITION BY run, symbol ORDER BY t ROWS UNBOUNDED PRECEDING), 10000.0::DOUBLE) AS peak FROM curve WINDOW w AS (PARTITION BY run, symbol ORDER BY t)),
 steps2 AS (SELECT *, (equity - before) / greatest(before, 1e-12) AS ret, (equity - peak) / peak AS down FROM path),
 c2 AS (SELECT run, symbol, arg_max(equity, t) AS end_equity, least(min(down), 0) * 100 AS max_drawdown_pct, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt({YEAR_BARS}::DOUBLE) ELSE 0 END AS sharpe_ann, count(*) AS bars,
   avg(CAST(in_market AS DOUBLE)) * 100 AS exposure_pct FROM steps2 GROUP BY ALL),
 b2 AS (SELECT run, symbol, count(*) AS trades, avg(CAST(pnl > 0 AS DOUBLE)) * 100 AS win_rate_pct, avg(ret_bps) AS avg_trade_bps, CASE WHEN sum(pnl) FILTER (pnl <= 0) < 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -(sum(pnl) FILTER (pnl <= 0)) END AS profit_factor,
   sum(fees) AS fees_paid, count(*) FILTER (side = 'LONG') AS longs, count(*) FILTER (side = 'SHORT') AS shorts, {', '.join(f"count(*) FILTER (reason = '{x}') AS exits_{x}" for x in ('horizon', 'stop', 'take', 'reverse', 'end'))} FROM ledger GROUP BY ALL),
 summary AS (SELECT run, symbol, end_equity, max_drawdown_pct, sharpe_ann, bars, exposure_pct, (end_equity / 10000 - 1) * 100 AS total_return_pct, profit_factor,
   {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'trades win_rate_pct avg_trade_bps fees_paid longs shorts exits_horizon exits_stop exits_take exits_reverse exits_end'.split())} FROM c2 LEFT JOIN b2 USING (run, symbol))"""))
def run_summary(spark, sf_dir):
    return pick(E.run_summary(*books(spark, sf_dir, WHOLE), ["run", "symbol"], 10_000.0, YEAR_BARS), f"run symbol {_COUNTS}", _SUMMARY, 4)


@query(_sql("SELECT run, symbol, reason, count(*) AS n FROM ledger GROUP BY ALL", bounded=True))
def exit_reasons(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("run", "symbol", "reason").agg(F.count("*").alias("n"))


@query(_sql(f"SELECT {LEDGER_SQL_COLUMNS}, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY run, symbol ORDER BY exit_time DESC, entry_time DESC) AS k FROM ledger) WHERE k <= 5"))
def recent_trades(spark, sf_dir):
    w = Window.partitionBy("run", "symbol").orderBy(F.desc("exit_time"), F.desc("entry_time"))
    return _ledger_rows(ledger(spark, sf_dir, WHOLE).withColumn("k", F.row_number().over(w)).where("k <= 5"), "k")


@query(_sql("""SELECT e.run, e.symbol, round(e.ret, 6) + 0.0 AS ret, round(p.ret, 6) + 0.0 AS plain_ret, round(h.buy_hold, 6) + 0.0 AS buy_hold FROM ends e JOIN ends p ON p.symbol = e.symbol AND p.run = 'plain' JOIN hold h ON h.symbol = e.symbol WHERE e.run <> 'plain'""", """
 ends AS (SELECT run, symbol, arg_max(equity, t) / 10000 - 1 AS ret FROM curve GROUP BY ALL), hold AS (SELECT symbol, arg_max(close, open_time) / arg_min(open, open_time) - 1 AS buy_hold FROM bars GROUP BY symbol)"""))
def compare_runs(spark, sf_dir):
    """Each set of rules beside the plain one and buy-and-hold, by symbol."""
    ends = curves(spark, sf_dir, WHOLE).groupBy("run", "symbol").agg((F.max_by("equity", "t") / 10_000.0 - 1).alias("ret"))
    hold = A.bars(spark, sf_dir).groupBy("symbol").agg((ratio(F.max_by("close", "open_time"), F.min_by("open", "open_time")) - 1).alias("buy_hold"))
    plain = ends.where("run = 'plain'").select("symbol", F.col("ret").alias("plain_ret"))
    return pick(ends.where("run <> 'plain'").join(plain, "symbol").join(hold, "symbol"), "run symbol", "ret plain_ret buy_hold")


@query(_sql("""SELECT c.run, c.symbol, c.t, l.entry_time, l.side, round(CASE WHEN l.side = 'LONG' THEN 1 ELSE -1 END * (b.close / l.entry_price - 1) * 1e4, 4) + 0.0 AS unrealised_bps, round((c.equity / 10000 - 1) * 100, 4) + 0.0 AS return_pct
 FROM curve c JOIN bars b ON b.symbol = c.symbol AND b.open_time = c.t JOIN ledger l ON l.run = c.run AND l.symbol = c.symbol AND c.t BETWEEN l.entry_time AND l.exit_time WHERE c.in_market"""))
def mark_to_market(spark, sf_dir):
    """Open positions at each bar: cash, unrealised basis points and equity against the start, from the curve and the trade that is open."""
    trades, curve = books(spark, sf_dir, WHOLE)
    trades, curve = trades.select("run", "symbol", "side", "entry_time", "exit_time", "entry_price"), curve.where("in_market")
    bars = A.bars(spark, sf_dir).select("symbol", F.col("open_time").alias("t"), "close")
    day = F.floor(F.col("t") / A.DAY)
    # a position is beside the days that it touches, so the range join is an equi join on run, symbol and day first
    days = trades.withColumn("day_", F.explode(F.sequence(F.floor(F.col("entry_time") / A.DAY), F.floor(F.col("exit_time") / A.DAY))))
    rows = curve.join(bars, ["symbol", "t"]).withColumn("day_", day).join(days, ["run", "symbol", "day_"]).where("t >= entry_time AND t <= exit_time")
    sign = F.when(F.col("side") == "LONG", 1).otherwise(-1)
    return rows.select("run", "symbol", "t", "entry_time", "side", r(sign * (ratio("close", "entry_price") - 1) * 1e4, 4).alias("unrealised_bps"), r((F.col("equity") / 10_000.0 - 1) * 100, 4).alias("return_pct"))


@query(_sql("SELECT run, symbol, t, cooling, halted FROM blocks", f"""
 lost AS (SELECT DISTINCT run, symbol, exit_time AS t, 1 AS lost FROM ledger WHERE pnl < 0), days AS (SELECT c.*, t // {A.DAY} AS day, coalesce(lost, 0) AS lost FROM curve c LEFT JOIN lost USING (run, symbol, t)),
 began AS (SELECT *, max(lost) OVER (PARTITION BY run, symbol ORDER BY t ROWS 4 PRECEDING) = 1 AS cooling, CAST((equity / first_value(equity) OVER (PARTITION BY run, symbol, day ORDER BY t) - 1) * 100 <= -3.0 AS INTEGER) AS hit FROM days),
 blocks AS (SELECT *, max(hit) OVER (PARTITION BY run, symbol, day ORDER BY t) = 1 AS halted FROM began)""", bounded=True))
def entry_blocks(spark, sf_dir):
    """What would keep a run from opening at each bar: a cool-down of five bars after a losing exit, and the rest of a UTC day once it has lost 3 %.

    The day's halt is latched at every bar close, also where the loss recovers later.
    """
    trades, curve = books(spark, sf_dir)
    losses = trades.where("pnl < 0").select("run", "symbol", F.col("exit_time").alias("t")).distinct().withColumn("lost", F.lit(1))
    rows = curve.join(losses, ["run", "symbol", "t"], "left").withColumn("day", F.floor(F.col("t") / A.DAY))
    by = Window.partitionBy("run", "symbol").orderBy("t")
    day = Window.partitionBy("run", "symbol", "day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    start = F.first("equity").over(day)
    rows = rows.withColumn("cooling", F.coalesce(F.max("lost").over(by.rowsBetween(-4, 0)), F.lit(0)) == 1).withColumn("start_", start)
    hit = (ratio("equity", "start_") - 1) * 100 <= -3.0
    return rows.withColumn("hit_", hit.cast("int")).withColumn("halted", F.max("hit_").over(day) == 1).select("run", "symbol", "t", "cooling", "halted")


SWEPT = (0.5, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
SWEPT_KINDS = ("plain", "long")


def _sweep_sql() -> str:
    """Every run of the sweep row by row: no rules of it stop or take, so a bar ends a position at its open by the other side or at its close, where time is up or the part ends."""
    w, of, k = "(PARTITION BY symbol, part ORDER BY rn)", ", ".join, CONFIGS["plain"]
    slip, rate = f"{k.slippage_bps / 1e4!r}::DOUBLE", f"{k.fee_bps / 1e4!r}::DOUBLE"
    profit = lambda side, cash, price, out: f"(least({cash} * size, {k.most!r}::DOUBLE) / {price}) * ({side} * ({out} - {price}) - {rate} * {price} - {rate} * {out})"
    return f"""WITH RECURSIVE {A.sql_bars()}, {NUMBERED},
 made AS (SELECT symbol, rn, open, close, {of(f'ln(close / lag(close, {h}) OVER ({W})) AS p{h}' for h in HORIZONS)}, CASE WHEN rn < count(*) OVER (PARTITION BY symbol) * 0.6::DOUBLE THEN 'val' ELSE 'test' END AS part FROM numbered),
 acts AS (SELECT symbol, part, open, close, row_number() OVER {w} - 1 AS n, count(*) OVER (PARTITION BY symbol, part) AS total, {of(f'lag(p{h}) OVER {w} AS s{h}' for h in HORIZONS)} FROM made),
 known AS ({' UNION ALL '.join(f'SELECT symbol, {h} AS horizon, abs(p{h}) AS strength FROM made WHERE part = $$val$$ AND p{h} IS NOT NULL' for h in HORIZONS)}),
 lists AS (SELECT symbol, horizon, quantile_cont(strength, {list(SWEPT)}) AS t FROM known GROUP BY ALL),
 cuts AS (SELECT symbol, horizon, unnest(range({len(SWEPT)})) AS q, unnest(t) AS lim FROM lists),
 walk AS (SELECT symbol, part, kind, horizon, q, lim, shorts, size, CAST(-1 AS BIGINT) AS n, false AS done, 0 AS side, 1.0::DOUBLE AS price, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS held, 0.0::DOUBLE AS won, CAST(0 AS BIGINT) AS trades
   FROM cuts, (VALUES {of(f"('{n}', {str(CONFIGS[n].allow_short).lower()}, {CONFIGS[n].size!r}::DOUBLE)" for n in SWEPT_KINDS)}) r(kind, shorts, size), (VALUES ('val'), ('test')) p(part)
  UNION ALL
  SELECT symbol, part, kind, horizon, q, lim, shorts, size, n, final, CASE WHEN ends THEN 0 ELSE side1 END, price1, until1, held2, won1 + CASE WHEN ends AND won1 > -10000 THEN b_pnl ELSE 0 END, trades1 + CAST(ends AND won1 > -10000 AS BIGINT)
  FROM (SELECT v.symbol, v.part, kind, horizon, q, lim, shorts, size, a.n, a.n = a.total - 1 AS final, CASE horizon {' '.join(f'WHEN {h} THEN s{h}' for h in HORIZONS)} END AS pred,
   CASE WHEN pred > lim THEN 1 WHEN pred < -lim AND shorts THEN -1 ELSE 0 END AS want, want <> 0 AND side <> want AS opens, opens AND side <> 0 AND won > -10000 AS turns, a.open * (1 - side * {slip}) AS a_out,
   {profit('side', '(10000 + won)', 'price', 'a_out')} AS a_pnl, won + CASE WHEN turns THEN a_pnl ELSE 0 END AS won1, trades + CAST(turns AS BIGINT) AS trades1,
   CASE WHEN opens THEN want ELSE side END AS side1, CASE WHEN opens THEN a.open * (1 + want * {slip}) ELSE price END AS price1, CASE WHEN opens THEN horizon WHEN want <> 0 THEN held + horizon ELSE until END AS until1,
   CASE WHEN opens THEN 0 ELSE held END + CAST(side1 <> 0 AS BIGINT) AS held2, side1 <> 0 AND (held2 >= until1 OR final) AS ends, a.close * (1 - side1 * {slip}) AS b_out, {profit('side1', '(10000 + won1)', 'price1', 'b_out')} AS b_pnl
   FROM walk v JOIN acts a ON a.symbol = v.symbol AND a.part = v.part AND a.n = v.n + 1)),
 swept AS (SELECT symbol, part, kind, horizon, q, trades, won / 10000 AS ret FROM walk WHERE done),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(ret, 9) DESC, horizon, q, kind = 'plain' DESC) AS place FROM swept WHERE part = 'val' AND trades >= 15) WHERE place = 1)"""


@query(f"{_sweep_sql()} SELECT b.symbol, b.kind, CAST(b.horizon AS BIGINT) AS horizon, CAST(b.q AS INTEGER) AS q, b.trades AS val_trades, round(b.ret, 6) + 0.0 AS val_ret, t.trades AS test_trades, round(t.ret, 6) + 0.0 AS test_ret FROM best b LEFT JOIN (SELECT * FROM swept WHERE part = 'test') t USING (symbol, kind, horizon, q)")
def ledger_sweep(spark, sf_dir):
    """Every horizon, quantile and choice of sides on the first 60 % of the bars; the best with 15 trades or more beside what it does on the rest."""
    scored = swept(spark, sf_dir)
    order = F.struct(F.round("ret", 9), -F.col("horizon"), -F.col("q"), F.col("kind") == "plain")
    best = scored.where("part = 'val' AND trades >= 15").groupBy("symbol").agg(F.max_by(F.struct("kind", "horizon", "q", "trades", "ret"), order).alias("b"))
    picked = best.select("symbol", "b.kind", "b.horizon", "b.q", F.col("b.trades").alias("val_trades"), r("b.ret").alias("val_ret"))
    test = scored.where("part = 'test'").select("symbol", "kind", "horizon", "q", F.col("trades").alias("test_trades"), r("ret").alias("test_ret"))
    return picked.join(test, ["symbol", "kind", "horizon", "q"], "left")


def swept(spark, sf_dir):
    """Trades and return of every run of the grid, on both parts of the bars."""
    return checkpointed(G.sweep(*sweep_inputs(spark, sf_dir), HORIZONS, {n: CONFIGS[n] for n in SWEPT_KINDS}, ("val", "test")))


def sweep_inputs(spark, sf_dir):
    """Bars with their part and momentum, and the thresholds of each symbol and horizon."""
    rows = past_returns(A.bars(spark, sf_dir), HORIZONS)
    sizes = rows.groupBy("symbol").agg((F.count("*") * 0.6).alias("cut_"))
    parts = rows.join(sizes, "symbol").select("symbol", F.col("open_time").alias("t"), "open", "high", "low", "close", F.when(F.col("rn") < F.col("cut_"), "val").otherwise("test").alias("part"), *[F.col(f"momentum_{h}").alias(f"pred_{h}") for h in HORIZONS])
    parts = checkpointed(parts)
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.abs(f"pred_{h}").alias("strength")) for h in HORIZONS])).alias("x")
    strengths = parts.where("part = 'val'").select("symbol", pairs).select("symbol", "x.*").where("strength IS NOT NULL")
    return parts, quantiles(strengths, ["symbol", "horizon"], "strength", list(SWEPT)).withColumnRenamed("quantiles", "limits")
