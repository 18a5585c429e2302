"""Mixing sources to target weights: budgets flow down a domain, language, source tree and each leaf gives a token-prefix of seeded epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barflow.llm.cluster import cut_lineage

LEVELS = ("domain", "lang", "source")
#: Ranges of the hash within a leaf; only the range in which a leaf's budget ends is sorted.
SLICES = 4096
#: Hex digits of the hash: 15 fit a BIGINT.
DIGITS = 15
WORD = r"[^\x20\x09-\x0D]+"
#: A table of leaves with at most so many rows is broadcast.
BROADCAST_LEAVES = 50_000


def word_tokens(text: str = "text") -> F.Column:
    """Words of a text as its token estimate: runs of anything but space and 0x09-0x0D; null has 0."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)).cast("long"), F.lit(0))


def order_key(seed: int, epoch, id_column) -> F.Column:
    """Position of a document in an epoch: 15 hex digits of md5 over 'seed-epoch-id'; a null id counts as the word null."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_column.cast("string"), F.lit("null"))).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def budgets(leaves: DataFrame, total: int, weights: dict[tuple, float], max_epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Tokens that each leaf may give, from (levels..., available).

    A node's budget is shared among its children by weight, none beyond what its subtree can give in ``max_epochs`` epochs: what a child
    cannot give goes to its siblings by weight first, and since a parent is never asked for more than its children hold, only the
    rest moves to the parent's own siblings. ``weights`` has a value for a path such as ("web",) or ("web", "en"); others have 1. A
    weight of 0 or less gives nothing. Adds quota (BIGINT, rounded down).
    """
    tree = leaves.withColumn("cap_", F.col("available").cast("double") * max_epochs).withColumn("have_", F.lit(float(total)))
    for depth in range(len(levels)):
        path, parent = list(levels[: depth + 1]), list(levels[:depth])
        nodes = tree.groupBy(*path).agg(F.sum("cap_").alias("node_cap"), F.first("have_").alias("parent_has"))
        nodes = nodes.withColumn("weight", _weight(path, weights)).withColumn("node_cap", F.when(F.col("weight") > 0, F.col("node_cap")).otherwise(0.0))
        siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        by_need = siblings.orderBy(F.when(F.col("weight") > 0, F.col("node_cap") / F.col("weight")).otherwise(F.lit(float("inf"))), *path)
        before = by_need.rowsBetween(Window.unboundedPreceding, -1)
        onward = by_need.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("rest_", F.sum(F.greatest("weight", F.lit(0.0))).over(onward)).withColumn("spent_", F.coalesce(F.sum("node_cap").over(before), F.lit(0.0)))
        nodes = nodes.withColumn("level_", F.when(F.col("rest_") > 0, (F.col("parent_has") - F.col("spent_")) / F.col("rest_")).otherwise(0.0))
        nodes = nodes.withColumn("water_", F.max("level_").over(siblings))
        share = F.least("node_cap", F.greatest(F.col("weight"), F.lit(0.0)) * F.greatest("water_", F.lit(0.0)))
        nodes = nodes.select(*[F.col(c).alias(f"{c}_") for c in path], share.alias("have_"))
        same = [tree[c].eqNullSafe(nodes[f"{c}_"]) for c in path]
        tree = tree.drop("have_").join(nodes, same).drop(*[f"{c}_" for c in path])
    return tree.withColumn("quota", F.floor(F.col("have_") + 1e-6).cast("long")).drop("cap_", "have_")


def _weight(path: list[str], weights: dict[tuple, float]) -> F.Column:
    out = F.lit(1.0)
    for key, value in sorted(weights.items(), key=str):
        if len(key) == len(path):
            fits = F.lit(True)
            for name, part in zip(path, key):
                fits = fits & F.col(name).eqNullSafe(F.lit(part))
            out = F.when(fits, F.lit(float(value))).otherwise(out)
    return out


def _plan(slim: DataFrame, total: int, weights: dict, max_epochs: int, seed: int, levels: tuple[str, ...]) -> DataFrame:
    """For each leaf: full epochs, tokens left for the next one, the slice in which these end and the tokens before it."""
    stock = cut_lineage(budgets(slim.groupBy(*levels).agg(F.sum("tokens_").alias("available")), total, weights, max_epochs, levels))
    stock = stock.withColumn("full_", F.when(F.col("available") > 0, F.least(F.floor(F.col("quota") / F.col("available")), F.lit(max_epochs))).otherwise(0).cast("int"))
    stock = stock.withColumn("left_", F.when(F.col("full_") < max_epochs, F.col("quota") - F.col("full_") * F.col("available")).otherwise(0))
    stock = stock.where("full_ > 0 OR left_ > 0")
    sliced = _beside(slim, stock, levels).where("left_ > 0").withColumn("slice_", _slice(order_key(seed, F.col("full_"), F.col("id_"))))
    sums = sliced.groupBy(*levels, "slice_").agg(F.sum("tokens_").alias("sum_"), F.first("left_").alias("left_"))
    upto = F.sum("sum_").over(Window.partitionBy(*levels).orderBy("slice_"))
    ends = sums.withColumn("upto_", upto).where("upto_ > left_").groupBy(*levels).agg(F.min_by(F.struct(F.col("slice_"), (F.col("upto_") - F.col("sum_")).alias("before_")), "slice_").alias("end_"))
    renamed = ends.select(*[F.col(c).alias(f"{c}_") for c in levels], "end_")
    joined = stock.join(renamed, [stock[c].eqNullSafe(renamed[f"{c}_"]) for c in levels], "left")
    return cut_lineage(joined.select(*levels, "full_", "left_", F.coalesce("end_.slice_", F.lit(SLICES)).alias("end_"), F.coalesce("end_.before_", F.lit(0)).cast("long").alias("before_")))


def _slice(key: F.Column) -> F.Column:
    """The leading 12 bits of the 60-bit position."""
    return F.shiftright(key, 4 * DIGITS - 12).cast("int")


def _beside(rows: DataFrame, leaves: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """``rows`` with the columns of their leaf; leaves are broadcast only when counted to be few."""
    named = leaves.select(*[F.col(c).alias(f"leaf_{c}") for c in levels], *[c for c in leaves.columns if c not in levels])
    if leaves.count() <= BROADCAST_LEAVES:
        named = F.broadcast(named)
    same = [rows[c].eqNullSafe(F.col(f"leaf_{c}")) for c in levels]
    return rows.join(named, same).drop(*[f"leaf_{c}" for c in levels])


def mix(df: DataFrame, domain: F.Column, weights: dict[tuple, float], share: float = 1.0, total: int | None = None, max_epochs: int = 4, seed: int = 7, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", keep_columns: bool = False) -> DataFrame:
    """Documents of a mix of ``total`` tokens (default: ``share`` of all), one row for each epoch that takes them.

    ``domain`` is the top level of the tree, above ``lang`` and ``source``. A leaf with a quota of q tokens and T at hand gives floor(q / T) whole
    epochs (``max_epochs`` at most), then the longest prefix of the next epoch's seeded order that holds no more than the tokens left. Returns
    (id, domain, lang, source, tokens, epoch), or with ``keep_columns`` the columns of ``df`` alone.

    Tokens are words. Null levels are values of their own. Texts that are null or empty have no tokens: they come with every whole epoch and
    with a prefix that reaches them; a leaf without any token gives nothing. Equal ids have one position, and are ordered by their tokens;
    equal rows count each. An empty table gives an empty mix. Only the slice of a leaf's order in which its budget ends is sorted, so a leaf
    that holds a third of all rows is never one task.
    """
    levels = LEVELS
    names = df.columns
    work = df.select(*([F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_")] if keep_columns else []), F.col(f"`{id_col}`").alias("id_"), domain.alias("domain"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text_"))
    slim = cut_lineage(work.select("id_", *levels, word_tokens("text_").alias("tokens_")))
    if total is None:
        total = int((slim.agg(F.sum("tokens_")).first()[0] or 0) * share)
    plan = _plan(slim, total, weights, max_epochs, seed, levels)
    rows = work.drop("text_").withColumn("tokens_", F.lit(None).cast("long")) if keep_columns else slim
    placed = _beside(rows, plan, levels).withColumn("key_", order_key(seed, F.col("full_"), F.col("id_")))
    whole = placed.withColumn("upper_", F.col("full_") + F.when((F.col("left_") > 0) & (_slice(F.col("key_")) < F.col("end_")), 1).otherwise(0))
    sure = whole.where("upper_ > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("upper_") - 1)))
    at_end = (F.col("left_") > 0) & (_slice(F.col("key_")) == F.col("end_"))
    if keep_columns:
        last = _beside(work, plan, levels).withColumn("key_", order_key(seed, F.col("full_"), F.col("id_"))).where(at_end).withColumn("tokens_", word_tokens("text_"))
    else:
        last = placed.where(at_end)
    run = F.sum("tokens_").over(Window.partitionBy(*levels).orderBy("key_", "id_", "tokens_").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("run_", run).where("before_ + run_ <= left_").withColumn("epoch", F.col("full_"))
    out = ["row_"] if keep_columns else ["id_", *levels, "tokens_", "epoch"]
    both = sure.select(*out).unionByName(last.select(*out))
    if keep_columns:
        return both.select(*[F.col(f"row_.`{c}`").alias(c) for c in names])
    return both.select(F.col("id_").alias(id_col), "domain", F.col("lang").alias(lang), F.col("source").alias(source), F.col("tokens_").alias("tokens"), "epoch")
