"""Frames, captures, retention and clean-up of raw rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.catalog import query
from barflow.catalog.common import W, r
from barflow.sources import adapters as A
from barflow.sources import frames as R
from barflow.streaming.runner import shared_folder


def frames(spark, sf_dir):
    return R.frames_of(A.trades(spark, sf_dir), A.books(spark, sf_dir), A.bars(spark, sf_dir))


@query(f"""WITH {A.sql_bars()}, {A.SQL_BOOKS} SELECT 'book' AS kind, symbol, update_id AS place, bid AS price, bid_qty AS qty, CAST(NULL AS BOOLEAN) AS flag FROM books
UNION ALL SELECT 'trade', symbol, trade_time, price, qty, is_buyer_maker FROM trades UNION ALL SELECT 'bar', symbol, open_time, close, volume, true FROM bars WHERE (open_time // 3600000) % 3 <> 0""")
def frame_decode(spark, sf_dir):
    return R.decode(frames(spark, sf_dir))


_MESSAGES = f"""{A.SQL_TRADES}, {A.SQL_BOOKS}, messages AS (SELECT 'trade' AS topic, trade_id AS seq, trade_time AS sent, symbol || '|' || trade_id AS payload FROM trades UNION ALL SELECT 'book', update_id, book_time, symbol || '|' || update_id FROM books)"""


def messages(spark, sf_dir):
    t = A.trades(spark, sf_dir).select(F.lit("trade").alias("topic"), F.col("trade_id").alias("seq"), F.col("trade_time").alias("sent"), F.concat_ws("|", "symbol", F.col("trade_id").cast("string")).alias("payload"))
    b = A.books(spark, sf_dir).select(F.lit("book").alias("topic"), F.col("update_id").alias("seq"), F.col("book_time").alias("sent"), F.concat_ws("|", "symbol", F.col("update_id").cast("string")).alias("payload"))
    return t.unionByName(b)


@query(f"WITH {_MESSAGES} SELECT topic, seq, payload FROM messages")
def replay_read(spark, sf_dir):
    """The whole log in order of hour, topic and sequence."""
    return messages(spark, sf_dir).orderBy(F.floor(F.col("sent") / A.HOUR), "topic", "seq").select("topic", "seq", "payload")


@query(f"WITH {_MESSAGES} SELECT topic, sent // 86400000 AS day, count(*) AS messages, CAST(sum(strlen(payload)) AS BIGINT) AS payload_bytes, CAST(sum(strlen(payload) + 3) AS BIGINT) AS framed_bytes FROM messages GROUP BY ALL")
def capture_stats(spark, sf_dir):
    size = F.octet_length("payload")
    return messages(spark, sf_dir).groupBy("topic", F.floor(F.col("sent") / A.DAY).alias("day")).agg(F.count("*").alias("messages"), F.sum(size).alias("payload_bytes"), F.sum(size + 3).alias("framed_bytes"))


@query(f"WITH {_MESSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq DESC) AS k FROM messages) SELECT topic, seq, payload FROM k WHERE k <= 100")
def history_last_n(spark, sf_dir):
    return R.last_n(messages(spark, sf_dir), "topic", ["seq"], 100).select("topic", "seq", "payload").orderBy("topic", "seq")


@query(f"WITH {_MESSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq DESC) AS k FROM messages) SELECT topic, count(*) AS kept, min(seq) AS oldest FROM k WHERE k <= CASE topic WHEN 'book' THEN 500 ELSE 200 END GROUP BY topic")
def retention_trim(spark, sf_dir):
    return R.trim(messages(spark, sf_dir), "topic", ["seq"], {"book": 500}, 200).groupBy("topic").agg(F.count("*").alias("kept"), F.min("seq").alias("oldest"))


_RAW = f"""WITH {A.sql_bars()}, now AS (SELECT max(close_time) AS now FROM bars)"""


def raw_klines(spark, sf_dir):
    """Bars as an exchange lists them: text fields, every fourth a second time with another close."""
    b = A.bars(spark, sf_dir)
    cols = [F.col(c).cast("string").alias(c) for c in ("open_time", "close_time", "open", "high", "low", "close", "volume", "trades", "taker")]
    first = b.select("symbol", F.lit(1).alias("arrival"), *cols)
    again = b.where(F.col("open_time") / A.HOUR % 4 == 0).withColumn("close", F.col("close") + 1).select("symbol", F.lit(2).alias("arrival"), *cols)
    return first.unionByName(again)


@query(f"{_RAW} SELECT symbol, open_time, close_time, open, high, low, close, volume, trades, taker FROM bars, now WHERE close_time < now")
def kline_load(spark, sf_dir):
    raw = raw_klines(spark, sf_dir)
    bars = R.load_klines(raw)
    now = bars.agg(F.max("close_time").alias("now"))
    return bars.join(F.broadcast(now), F.col("close_time") < F.col("now")).select("symbol", "open_time", "close_time", "open", "high", "low", "close", "volume", "trades", "taker")


@query(f"{_RAW} SELECT symbol, open_time, close FROM bars")
def sort_unique(spark, sf_dir):
    return R.load_klines(raw_klines(spark, sf_dir)).select("symbol", "open_time", "close").orderBy("symbol", "open_time")


@query(f"WITH {A.sql_bars()} SELECT symbol, open_time, close, open_time % {2 * A.HOUR} = 0 AS cached FROM bars")
def bars_incremental(spark, sf_dir):
    """A table with every other hour of the bars, brought up to date by a full load: only what it lacks is written."""
    bars = A.bars(spark, sf_dir).select("symbol", "open_time", "close")
    cached = F.col("open_time") % (2 * A.HOUR) == 0
    table = shared_folder(spark) + "/bars"
    R.upsert(table, bars.where(cached).withColumn("cached", F.lit(True)))
    R.upsert(table, bars.withColumn("cached", F.lit(False)))
    return spark.read.parquet(table).select("symbol", "open_time", "close", "cached")


@query("""SELECT 'l_quantity' AS name, 0 AS decimals UNION ALL SELECT 'l_extendedprice', CASE WHEN (SELECT bool_and(round_even(l_extendedprice, 0) = l_extendedprice) FROM lineitem) THEN 0
 WHEN (SELECT bool_and(round_even(l_extendedprice * 10, 0) / 10 = l_extendedprice) FROM lineitem) THEN 1 WHEN (SELECT bool_and(round_even(l_extendedprice * 100, 0) / 100 = l_extendedprice) FROM lineitem) THEN 2 END
UNION ALL SELECT 'l_discount', CASE WHEN (SELECT bool_and(round_even(l_discount, 0) = l_discount) FROM lineitem) THEN 0 WHEN (SELECT bool_and(round_even(l_discount * 10, 0) / 10 = l_discount) FROM lineitem) THEN 1
 WHEN (SELECT bool_and(round_even(l_discount * 100, 0) / 100 = l_discount) FROM lineitem) THEN 2 END""")
def fixed_point_profile(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return R.fixed_point_profile(rows, ["l_quantity", "l_extendedprice", "l_discount"]).select("name", "decimals")


_LINES = f"{A.SQL_TRADES}, lines AS (SELECT trade_id AS line, trade_time - trade_time % 600000 AS t, symbol, price FROM trades)"


@query(f"WITH {_LINES} SELECT symbol, t, arg_max(price, line) AS price, max(line) AS line FROM lines GROUP BY ALL")
def llm_cache_load(spark, sf_dir):
    """JSON lines of (symbol, t): the last line of each wins."""
    lines = A.trades(spark, sf_dir).select(F.col("trade_id").alias("line"), F.to_json(F.struct("symbol", (F.col("trade_time") - F.col("trade_time") % 600_000).alias("t"), "price")).alias("text"))
    parsed = lines.select("line", F.from_json("text", "symbol STRING, t BIGINT, price DOUBLE").alias("x")).select("line", "x.*")
    return parsed.groupBy("symbol", "t").agg(F.max_by("price", "line").alias("price"), F.max("line").alias("line"))


@query(f"""WITH {A.sql_bars()}, k AS (SELECT symbol, open_time, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM bars WHERE trades % 9 <> 0)
SELECT symbol, open_time, close FROM k WHERE k <= 200""")
def proto_load(spark, sf_dir):
    """Numbers coerced (a word becomes null), rows with nulls and repeated times dropped, the last 200 of each symbol kept."""
    raw = raw_klines(spark, sf_dir).withColumn("close", F.when(F.col("trades").cast("long") % 9 == 0, "n/a").otherwise(F.col("close")))
    rows = raw.where("arrival = 1").select("symbol", F.col("open_time").try_cast("long").alias("open_time"), F.col("close").try_cast("double").alias("close")).dropna().dropDuplicates(["symbol", "open_time"])
    return R.last_n(rows, "symbol", ["open_time"], 200)


@query(f"""WITH {A.sql_bars()}, a AS (SELECT symbol, open_time FROM bars WHERE open_time % {2 * A.HOUR} = 0), e AS (SELECT symbol, open_time, round(close * 2, 4) AS e FROM bars WHERE open_time % {3 * A.HOUR} = 0), f AS (SELECT symbol, open_time, ln(close / lag(close) OVER ({W})) AS ret FROM bars)
SELECT symbol, open_time, round(ret, 6) + 0.0 AS ret, e + 0.0 AS e FROM f JOIN a USING (symbol, open_time) JOIN e USING (symbol, open_time)""")
def join_sample_sets(spark, sf_dir):
    """Features, advice and embeddings of the samples that have all three."""
    from barflow.operators.labels import past_returns

    bars = A.bars(spark, sf_dir)
    advice = bars.where(F.col("open_time") % (2 * A.HOUR) == 0).select("symbol", "open_time")
    other = bars.where(F.col("open_time") % (3 * A.HOUR) == 0).select("symbol", "open_time", r(F.col("close") * 2, 4).alias("e"))
    rows = past_returns(bars, (1,)).select("symbol", "open_time", r("momentum_1").alias("ret"))
    return rows.join(advice, ["symbol", "open_time"]).join(other, ["symbol", "open_time"])
