"""Exchange rows and stream frames as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.plans.lineage import checkpointed
from barflow.plans.once import let, with_once
from barflow.sources.adapters import DAY

BODY = "map<string,string>"


def route(frames: DataFrame, raw: str = "raw") -> DataFrame:
    """stream and the body as a map from field to text: each frame is parsed once."""
    return with_once(frames, "frame_", F.from_json(raw, f"stream string, data {BODY}")).select("*", "frame_.*").drop("frame_")


def decode(frames: DataFrame, raw: str = "raw") -> DataFrame:
    """kind, symbol, place (update id, trade time or open time), price, qty, flag of book, trade and closed bar frames; other frames and bars that are still open are dropped.

    Works on batches and streams alike. A frame's text is parsed once, and a bar's inner object once more. A number that does not parse is null.
    """

    def kind_of(frame: F.Column) -> F.Column:
        stream = frame["stream"]
        return F.when(stream.endswith("@bookTicker"), "book").when(stream.endswith("@aggTrade"), "trade").when(stream.contains("@kline_"), "bar")

    def fields(kind: F.Column, body: F.Column) -> F.Column:
        named = lambda book, trade, bar: F.when(kind == "bar", body[bar]).when(kind == "trade", body[trade]).otherwise(body[book])
        flag = F.when(kind == "bar", body["x"]).when(kind == "trade", body["m"])
        return F.struct(
            kind.alias("kind"), body["s"].alias("symbol"), named("u", "T", "t").try_cast("long").alias("place"), named("b", "p", "c").try_cast("double").alias("price"),
            named("B", "q", "v").try_cast("double").alias("qty"), flag.try_cast("boolean").alias("flag"),
        )

    def read(frame: F.Column) -> F.Column:
        body = F.when(kind_of(frame) == "bar", F.from_json(frame["data"]["k"], BODY)).otherwise(frame["data"])
        return F.when(kind_of(frame).isNotNull(), let(body, lambda b: fields(kind_of(frame), b)))

    rows = with_once(frames, "x_", let(F.from_json(raw, f"stream string, data {BODY}"), read))
    return rows.where("x_ IS NOT NULL AND (x_.kind <> 'bar' OR x_.flag)").select("x_.*")


def frames_of(trades: DataFrame, books: DataFrame, bars: DataFrame) -> DataFrame:
    """The frames that an exchange would send for these tables; the bars of each third hour come as open ones, and a frame of an unknown stream is among them."""
    text = lambda c: F.col(c).cast("string")
    lower = F.lower("symbol")
    wrap = lambda name, body: F.to_json(F.struct(F.concat(lower, F.lit(name)).alias("stream"), body.alias("data")))
    book = books.select(wrap("@bookTicker", F.struct(text("update_id").alias("u"), F.col("symbol").alias("s"), text("bid").alias("b"), text("bid_qty").alias("B"), text("ask").alias("a"), text("ask_qty").alias("A"))).alias("raw"))
    trade = trades.select(wrap("@aggTrade", F.struct(F.col("symbol").alias("s"), text("price").alias("p"), text("qty").alias("q"), F.col("is_buyer_maker").alias("m"), F.col("trade_time").alias("T"), F.col("trade_time").alias("E"))).alias("raw"))
    closed = F.floor(F.col("open_time") / 3_600_000) % 3 != 0
    k = F.struct(F.col("open_time").alias("t"), F.col("close_time").alias("T"), F.col("symbol").alias("s"), text("open").alias("o"), text("high").alias("h"), text("low").alias("l"), text("close").alias("c"), text("volume").alias("v"), F.col("trades").alias("n"), text("taker").alias("V"), closed.alias("x"))
    bar = bars.select(wrap("@kline_1h", F.struct(F.col("close_time").alias("E"), k.alias("k"))).alias("raw"))
    other = trades.where("trade_id % 50 = 0").select(wrap("@depth", F.struct(F.col("symbol").alias("s"))).alias("raw"))
    return book.unionByName(trade).unionByName(bar).unionByName(other)


def load_klines(raw: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Clean bars of raw exchange rows (symbol, arrival and text fields): numbers cast, the first arrival of each open_time kept, only bars closed by ``now_ms``."""
    numbers = raw.select("symbol", "arrival", *[F.col(c).try_cast("long").alias(c) for c in ("open_time", "close_time", "trades")], *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "taker")])
    first = numbers.where("open_time IS NOT NULL").groupBy("symbol", "open_time").agg(F.min_by(F.struct(*[c for c in numbers.columns if c not in ("symbol", "open_time", "arrival")]), "arrival").alias("x")).select("symbol", "open_time", "x.*")
    return first if now_ms is None else first.where(F.col("close_time") < now_ms)


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key; Spark applies the limit before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= n).drop("k_")


def trim(df: DataFrame, key: str, order: list[str], limits: dict[str, int], usual: int) -> DataFrame:
    """Newest rows of each key up to its own limit."""
    limit = F.lit(usual)
    for name, n in limits.items():
        limit = F.when(F.col(key) == name, n).otherwise(limit)
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("k_", F.row_number().over(w)).where((F.col("k_") <= limit) & (F.col("k_") <= max([usual, *limits.values()]))).drop("k_")


def upsert(path: str, new: DataFrame, partition: str = "symbol", key: tuple[str, ...] = ("symbol", "open_time"), time: str = "open_time", span: int = DAY) -> None:
    """Add the rows of ``new`` that the Parquet table at ``path`` lacks: only new rows are written, as files of their partition and span of time.

    Of what is stored only the spans that ``new`` touches are read; their numbers, as many as spans, come to the driver and prune the scan.
    """
    spark = new.sparkSession
    rows = checkpointed(new.dropDuplicates(list(key)).withColumn("span_", F.floor(F.col(time) / span)))
    try:
        known = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows.write.partitionBy(partition, "span_").parquet(path)
        return
    known = known.where(touched(rows)).select(*key)
    rows.join(known, list(key), "left_anti").write.mode("append").partitionBy(partition, "span_").parquet(path)


def touched(rows: DataFrame, most: int = 1000) -> F.Column:
    """Whether a stored row's span is among those of ``rows``; beyond ``most`` spans, whether it lies between the first and the last."""
    found = [r["span_"] for r in rows.select("span_").distinct().orderBy("span_").limit(most + 1).collect()]
    if len(found) <= most:
        return F.col("span_").isin(found)
    return F.col("span_").between(*rows.agg(F.min("span_"), F.max("span_")).first())


def fixed_point_profile(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """For each column the fewest decimals (up to ``most``) that hold every value exactly, and the DECIMAL type that would: one aggregate pass.

    decimals is null where no number of decimals does, or a scaled value leaves 2^53. Null values do not count.
    """
    exact = lambda c, k: F.rint(F.col(c) * 10.0**k) / 10.0**k == F.col(c)
    flags = [F.min(F.coalesce(exact(c, k) & (F.abs(F.col(c)) * 10.0**k < 2.0**53), F.lit(True))).alias(f"{c}_{k}") for c in columns for k in range(most + 1)]
    row = df.agg(*flags, *[F.max(F.abs(F.col(c))).alias(f"{c}_max") for c in columns])
    def least(c):
        out = F.lit(None).cast("int")
        for k in range(most, -1, -1):
            out = F.when(F.col(f"{c}_{k}"), k).otherwise(out)
        return out

    items = [F.struct(F.lit(c).alias("name"), least(c).alias("decimals"), F.length(F.floor(F.col(f"{c}_max")).cast("string")).alias("digits")) for c in columns]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*").withColumn("type", F.when(F.col("decimals").isNotNull(), F.format_string("DECIMAL(%d,%d)", F.col("digits") + F.col("decimals"), F.col("decimals"))).otherwise("DOUBLE"))
