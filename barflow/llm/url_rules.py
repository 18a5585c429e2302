"""URL filters: a host and path rule list, then association rules that FP-growth mines from labelled URLs. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.cluster import cut_lineage, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "label=block"
#: Mined rules up to this number are broadcast to the URLs; more are joined by token.
BROADCAST_RULES = 20_000


#: Rows that stand for one list of tokens in one task at most.
RUN = 100_000


def host_of(url: str = "url") -> F.Column:
    """What stands after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty where the URL is null or has no '://'."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str = "url") -> F.Column:
    """What stands after the host up to '?', '#' or the end; empty where the URL is null or has no '://'."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: str) -> F.Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")


def fitting_rule(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> F.Column:
    """STRUCT<rule, verdict> of the longest rule that fits, else null.

    Each rule is (verdict, host, path). It fits its host and all subdomains where the path starts with the rule's. Of equally long rules the
    first in alphabetical order counts.
    """
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        own = (F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = own & F.col(path).startswith(rule_path)
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: str = "url", host: str = "host", path: str = "path") -> F.Column:
    """Distinct tokens of a URL: words of the host, its last two labels, segments and ending of the path, parameter names."""
    labels = F.split(F.col(host), r"\.")
    words = F.filter(F.split(F.col(host), r"[.-]"), lambda x: x != "")
    segments = F.filter(F.split(F.translate(F.col(path), UPPER, LOWER), "/"), lambda x: x != "")
    query = F.regexp_extract(F.col(url), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)), lambda x: x != "")
    ending = F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]{1,5})$", 1)
    parts = [
        F.transform(words, lambda x: F.concat(F.lit("host="), x)),
        F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("suffix="), F.array_join(F.slice(labels, -2, 2), ".")))),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), F.least(i, F.lit(2)).cast("string"), F.lit("="), x)),
        F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))),
        F.transform(names, lambda x: F.concat(F.lit("parameter="), x)),
    ]
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])))


def _repeated(lists: DataFrame) -> DataFrame:
    """Each list of ``lists`` (items, times) as that many rows: in runs of RUN rows at most, which are dealt out before they are made, so that a list which most URLs have is many tasks' work."""
    runs = lists.where("times > 0").select("items", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(RUN).cast("long"))).alias("from"))
    dealt = runs.select("items", "from", F.least(F.lit(RUN).cast("long"), F.col("times") - F.col("from")).cast("int").alias("size")).repartition("items", "from")
    return dealt.select("items", F.explode(F.array_repeat(F.lit(0), F.col("size"))).alias("one")).select("items")


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules (rule_id, items, confidence, support) whose tokens together speak for blocking.

    ``labelled`` has tokens ARRAY<STRING> and blocked BOOLEAN (null: not blocked); other columns are not looked at. A rule is kept with ``min_support``
    of all rows blocked and having its tokens, with ``min_confidence``, and only where no shorter rule inside it is as confident. No labelled row gives no rule.

    FP-growth is given no more than can make such a rule, since n tokens that stand together make 2^n sets. Tokens that always occur together are
    one item, and a rule with it asks for all of them. Tokens too rare among blocked rows take part in no rule. Rules of one item come from
    counts; an item that is always blocked, or that every row has, makes no longer rule better and is mined no further.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.array_sort(F.array_distinct(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("tokens"), F.coalesce("blocked", F.lit(False)).cast("int").alias("hit"))
    lists = cut_lineage(rows.groupBy("tokens").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).withColumn("list", F.monotonically_increasing_id()))
    total = lists.agg(F.sum("n")).first()[0]
    empty = spark.createDataFrame([], "rule_id long, items array<string>, confidence double, support double")
    if not total:
        return empty
    # tokens of the same lists have the same sums of two hashes of these; 64 bits each
    marks = [F.expr(f"bit_xor(xxhash64(list, {i}))").alias(f"mark{i}") for i in (1, 2)]
    tokens = lists.select("list", "n", "hits", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), *marks)
    often = tokens.where(F.col("hits") >= F.lit(min_support * total * (1 - 1e-12)))
    items = cut_lineage(often.groupBy("n", "hits", "mark1", "mark2").agg(F.array_sort(F.collect_list("token")).alias("tokens")))
    rated = lambda hits, n: (hits / n).cast("double")
    single = items.select(F.col("tokens").alias("items"), F.array(F.col("tokens")[0]).alias("parts"), rated(F.col("hits"), F.col("n")).alias("confidence"), (F.col("hits") / total).alias("support"))
    open_ = items.where((F.col("hits") < F.col("n")) & (F.col("n") < total)).select(F.col("tokens")[0].alias("item"), F.explode("tokens").alias("token"))
    heads = open_.where("item = token").select("item")
    met = lists.select("list", "n", "hits", F.explode("tokens").alias("item")).join(heads, "item").groupBy("list", "n", "hits").agg(F.collect_list("item").alias("items"))
    longer = met.where(F.size("items") > 1)
    told = _repeated(longer.select("items", (F.col("n") - F.col("hits")).alias("times")))
    hits = _repeated(longer.select(F.concat("items", F.array(F.lit(BLOCKED))).alias("items"), F.col("hits").alias("times")))
    baskets = cut_lineage(told.unionByName(hits))
    number = baskets.count()
    rules = single
    if number:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * total * (1 - 1e-12) / number), minConfidence=min_confidence).fit(baskets)
        found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED) & (F.size("antecedent") > 1))
        sets = cut_lineage(found.select(F.xxhash64(F.array_sort("antecedent")).alias("set"), F.array_sort("antecedent").alias("parts"), "confidence", (F.col("support") * number / total).alias("support")))
        whole = sets.select("set", "parts", "confidence", "support", F.explode("parts").alias("item")).join(open_, "item").groupBy("set", "parts", "confidence", "support").agg(F.array_sort(F.collect_list("token")).alias("items"))
        rules = single.unionByName(whole.select(*single.columns))
    rules = cut_lineage(rules.where(F.col("confidence") >= min_confidence))
    # shorter rules first: what beats a rule is itself kept or beaten by a kept one, so each size meets the kept rules only
    sizes = sorted(r[0] for r in rules.select(F.size("parts")).distinct().collect())
    kept = None
    for size in sizes:
        longer = rules.where(F.size("parts") == size)
        if kept is not None:
            # a shorter rule inside a longer one shares its first item with it, so they meet on an item
            inner = kept.select(F.col("parts").alias("less"), F.col("confidence").alias("sure"), F.col("parts")[0].alias("item"))
            met = longer.withColumn("item", F.explode("parts")).join(inner, "item")
            beaten = met.where("sure >= confidence AND size(array_except(less, parts)) = 0").select("parts").distinct()
            longer = kept.unionByName(longer.join(beaten, "parts", "left_anti").select(*kept.columns))
        kept = cut_lineage(longer)
    return empty if kept is None else kept.select(F.xxhash64("items").alias("rule_id"), "items", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Keys of ``urls`` (key, tokens) for which some rule has all its tokens, with the highest confidence; by an inverted index from token to rule.

    Each rule stands in the index under its rarest token, so a token that most URLs have leads to few rules, and each URL row meets a rule at
    most once. The index is broadcast only when counted to be small.
    """
    number = rules.count()
    spread = rules.select("rule_id", F.explode("items").alias("token"))
    often = spread.groupBy("token").agg(F.count("*").alias("rules"))
    rarest = spread.join(often, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("rules", "token")).alias("token"))
    index = rules.join(rarest, "rule_id").select("token", "items", "confidence")
    if number <= BROADCAST_RULES:
        index = F.broadcast(index)
    met = urls.select(key, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.where("size(array_except(items, tokens)) = 0").groupBy(key).agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", min_support: float = 0.01, min_confidence: float = 0.9) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    A URL that a rule fits has its verdict. FP-growth learns from all distinct URLs, those that no rule fits as not blocked, so that support and confidence
    are shares of all URLs; a URL that no rule fits is blocked if a mined rule matches its tokens, else allowed. Null URLs and URLs without '://' have empty host
    and path, no rule and no token, and are allowed. Repeated URLs keep their rows; columns of ``pages`` called host, path, rule or verdict are replaced, others
    may have any name.
    """
    plain = pages.select(F.col(f"`{url}`").alias("url_")).distinct()
    parts = plain.withColumn("host_", host_of("url_")).withColumn("path_", path_of("url_"))
    known = cut_lineage(parts.withColumn("found_", fitting_rule(rules, "host_", "path_")).withColumn("tokens", tokens_of("url_", "host_", "path_")))
    mined = mine(known.select("tokens", F.coalesce(F.col("found_.verdict") == "block", F.lit(False)).alias("blocked")), min_support, min_confidence)
    fit, key, mark = (unused(pages, x) for x in ("found_", "url_", "verdict_"))
    blocked = match(known.where("found_ IS NULL"), mined, "url_").select(F.col("url_").alias(key), F.lit("block").alias(mark))
    named = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url]).withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn(fit, fitting_rule(rules))
    joined = named.join(blocked, F.col(f"`{url}`") == F.col(key), "left")
    verdict = F.coalesce(f"{fit}.verdict", mark, F.lit("allow"))
    return joined.withColumn("rule", F.col(f"{fit}.rule")).withColumn("verdict", verdict).drop(fit, key, mark)
