"""Time-aware and rule joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import floor_time, second_of_day
from tidemark.operators.chunks import index_rows, running
from tidemark.session import settle

def asof_join(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    by: str = "symbol",
    on: str = "time",
    right_on: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Backward as-of join: the newest right row with right time <= left time.

    Both sides are tagged and merged into one ordered series per key; the match is the last right row seen so far.
    One sort of the union instead of a range join, and a hot key is cut into row chunks.
    """
    right_on = right_on or on
    lcols = left.columns
    pad = lambda df, names: df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in names])
    r = right.select(F.col(by), F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.struct(*cols).alias("__hit"))
    r = pad(r, [(f"__l_{c}", t) for c, t in left.dtypes])
    lsel = left.select(
        F.col(by), F.col(on).alias("__t"), F.lit(1).alias("__side"),
        F.lit(None).cast(r.schema["__hit"].dataType).alias("__hit"),
        *[F.col(c).alias(f"__l_{c}") for c in lcols],
    )
    both = r.unionByName(lsel)
    order = ["__t", "__side", *[f"__l_{c}" for c in lcols]]
    numbered = settle(index_rows(both, [by], [F.to_date("__t"), second_of_day("__t")], order))
    filled = running(numbered, {"__match": ("last", F.col("__hit"))}, by=(by,), rows=rows)
    return filled.where(F.col("__side") == 1).select(
        *[F.col(f"__l_{c}").alias(c) for c in lcols], *[F.col(f"__match.{c}").alias(c) for c in cols]
    )


def prev_period_join(bars: DataFrame, coarse: DataFrame, cols: Sequence[str], width: str) -> DataFrame:
    """Values of the coarse bar before the one containing each fine bar (previous existing bucket).

    `coarse` must carry row numbers; one row per (symbol, bucket), so the equi join cannot fan out.
    """
    prev = coarse.select("symbol", (F.col("rn") + 1).alias("rn"), *cols)
    shifted = coarse.select("symbol", "rn", F.col("time").alias("__bucket")).join(prev, ["symbol", "rn"]).drop("rn")
    return bars.withColumn("__bucket", floor_time("time", width)).join(shifted, ["symbol", "__bucket"], "left").drop("__bucket")


def positional_htf(bars: DataFrame, coarse: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Row-count alignment: fine bar i (0-based) takes coarse bar i div k - 1. Assumes gap-free fine bars."""
    target = F.floor((F.col("rn") - 1) / k).cast("long")
    right = coarse.select("symbol", F.col("rn").alias("__pos"), *cols)
    return bars.withColumn("__pos", target).join(right, ["symbol", "__pos"], "left").drop("__pos")


def intrabar_join(h1: DataFrame, m1: DataFrame) -> DataFrame:
    """Minute bars inside [hour, hour + 1h): the range condition becomes an equality on the truncated time."""
    hours = h1.select("symbol", F.col("time").alias("hour"))
    return m1.withColumn("hour", floor_time("time", "1 hour")).join(hours, ["symbol", "hour"])


def cross_asset_join(bars: DataFrame, ref_symbol: str) -> DataFrame:
    """Close of a reference symbol at the same (date, hour); a missing reference gives ratio 1.0."""
    ref = bars.where(F.col("symbol") == ref_symbol).select("time", F.col("close").alias("ref_close"))
    ratio = F.col("close") / F.greatest("ref_close", F.lit(1e-10))
    return bars.join(ref, "time", "left").withColumn("ratio", F.coalesce(ratio, F.lit(1.0)))


def align_labels(features: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Inner join on (symbol, time) keeping known, directional labels."""
    known = labels.where(F.col(label).isNotNull() & (F.col(label) != 0)).select("symbol", "time", label)
    return features.join(known, ["symbol", "time"])


def symbol_pairs(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Pairs s1 < s2 of values at the same time. Each time holds one row per symbol."""
    a = returns.select("time", F.col("symbol").alias("s1"), F.col(value).alias("x"))
    b = returns.select("time", F.col("symbol").alias("s2"), F.col(value).alias("y"))
    return a.join(b, "time").where(F.col("s1") < F.col("s2"))


def enrich_closes(journal: DataFrame) -> DataFrame:
    """Closing rows with symbol, side, volume and entry fields of the ticket's first OPEN row."""
    fields = ["symbol", "type", "volume", "entry_price", "sl", "tp", "entry_time"]
    opens = journal.where(F.col("event") == "OPEN").groupBy("ticket").agg(
        F.min(F.struct("entry_time", *[c for c in fields if c != "entry_time"])).alias("o")
    )
    closes = journal.where(F.col("event") != "OPEN")
    keep = [c for c in journal.columns if c not in fields]
    return closes.join(opens, "ticket", "left").select(*keep, *[F.coalesce(closes[c], F.col(f"o.{c}")).alias(c) for c in fields])


def orphan_opens(journal: DataFrame, active: DataFrame) -> DataFrame:
    """OPEN rows whose position is gone and for which no closing row exists."""
    resolved = journal.where((F.col("event") != "OPEN") & F.col("event").isNotNull()).select("ticket")
    return journal.where(F.col("event") == "OPEN").join(active.select("ticket"), "ticket", "left_anti").join(resolved, "ticket", "left_anti")


DEAL_ORDER = ("time", "deal_no", "part_id", "venue", "price", "volume")


def resolve_orphans(journal: DataFrame, active: DataFrame, deals: DataFrame, now) -> DataFrame:
    """MANUAL_CLOSE rows for orphaned tickets from each position's last deal (zeros when it has none)."""
    orphans = orphan_opens(journal, active).groupBy("ticket").agg(
        F.min(F.struct("entry_time", "entry_price", "type")).alias("o")
    )
    last = deals.groupBy(F.col("position_id").alias("ticket")).agg(
        F.max(F.struct(*DEAL_ORDER, "profit")).alias("d")
    )
    side = F.when(F.col("o.type") == "buy", 1).otherwise(-1)
    pips = (F.col("d.price") - F.coalesce("o.entry_price", F.lit(0.0))) * side
    return orphans.join(last, "ticket", "left").select(
        "ticket",
        F.coalesce("d.price", F.lit(0.0)).alias("exit_price"),
        F.lit(now).cast("timestamp_ntz").alias("exit_time"),
        F.coalesce(F.col("d.profit"), F.lit(0)).cast("decimal(18,4)").alias("pnl"),
        F.coalesce(pips, F.lit(0.0)).alias("pips"),
        F.lit("MANUAL_CLOSE").alias("event"),
    )


def external_positions(deals: DataFrame, journal: DataFrame, magic: int) -> DataFrame:
    """Positions unknown to the journal in which no deal carries the bot's magic number."""
    foreign = deals.where(F.col("position_id") != 0).groupBy("position_id").agg(
        F.bool_or(F.coalesce(F.col("magic") == magic, F.lit(False))).alias("own"), F.count(F.lit(1)).alias("n_deals")
    )
    known = journal.where(F.col("ticket").isNotNull()).select(F.col("ticket").alias("position_id"))
    return foreign.where(~F.col("own")).drop("own").join(known, "position_id", "left_anti")


def param_grid(spark, axes: Mapping[str, Sequence]) -> DataFrame:
    """Cross product of parameter axes with a dense param_id; its size is the product of the axis lengths."""
    names = list(axes)
    lists = [F.explode(F.array(*[F.lit(v) for v in values])).alias(n) for n, values in axes.items()]
    grid = spark.range(1).drop("id")
    for n in names:
        grid = grid.select("*", lists[names.index(n)])
    return grid.withColumn("param_id", F.row_number().over(Window.orderBy(*names)))


def scenario_join(positions: DataFrame, shocks: DataFrame) -> DataFrame:
    """Positions under every scenario that names their symbol."""
    return positions.join(shocks, "symbol")


WORD = r"[\p{L}\p{N}_]"


def word_match(text: Column, keyword: Column) -> Column:
    """Whole-word, case-insensitive containment (letters and digits of any script count as word characters)."""
    quoted = F.regexp_replace(F.lower(keyword), r"([^\p{L}\p{N}_\s])", r"\\$1")
    edge = WORD.replace("[", "[^")
    return F.regexp_like(F.lower(text), F.concat(F.lit(f"(?:^|{edge})"), quoted, F.lit(f"(?:$|{edge})")))


def match_keywords(docs: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (article, symbol) for whole-word keyword hits.

    Each text is cut into its distinct words once; one-word keywords are an equality on those words, longer ones
    only test the articles that contain their first word.
    """
    kw = keywords.select(F.lower("keyword").alias("keyword"), "symbol").withColumn("head", F.regexp_extract("keyword", WORD + "+", 0))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD + "+"), F.lit(0)))
    heads = docs.select("article_id", F.explode(tokens).alias("head")).join(kw, "head")
    whole = heads.where(F.col("keyword") == F.col("head")).select("article_id", "symbol")
    maybe = heads.where(F.col("keyword") != F.col("head")).select("article_id", "keyword", "symbol")
    phrases = docs.select("article_id", F.col(text).alias("__text")).join(maybe, "article_id")
    phrases = phrases.where(word_match(F.col("__text"), F.col("keyword"))).select("article_id", "symbol")
    return whole.unionByName(phrases).distinct()


def match_entities(articles: DataFrame, mapping: DataFrame) -> DataFrame:
    """(article, symbol, mean score) by entity code equal to or ending in the mapped code; articles without such a hit
    fall back to the code, or the name of the source, inside the headline, scored with the article's overall score. A
    source that is named there stands for every mapped symbol; an empty source stands for none.

    Ends-with becomes an equality on the entity's suffixes, contains an equality on the code's first two characters
    followed by a filter. The mapping goes to every task, so no text travels, and a headline is copied only for pairs of
    characters that some code begins with.
    """
    code = mapping.select("symbol", F.upper("code").alias("code"))
    ents = articles.select("article_id", F.explode("entities").alias("e")).select(
        "article_id", F.upper("e.symbol").alias("raw"), F.coalesce("e.sentiment_score", F.lit(0.0)).alias("s")
    )
    suffixes = F.transform(F.sequence(F.lit(1), F.length("raw")), lambda i: F.substr(F.col("raw"), i))
    direct = (
        ents.where(F.length("raw") > 0).withColumn("code", F.explode(suffixes)).join(F.broadcast(code), "code")
        .groupBy("article_id", "symbol").agg(F.avg("s").alias("score"))
    )
    headline = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    scored = articles.where(F.col("score").isNotNull()).select("article_id", headline.alias("headline"), "score")
    chars = F.col("chars")
    pairs = F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.concat(F.get(chars, i - 1), F.coalesce(F.get(chars, i), F.lit(""))))
    split = scored.where(F.length("headline") > 0).withColumn("chars", F.split("headline", ""))
    grams = F.array_distinct(F.concat(chars, pairs))
    lower = code.select("symbol", F.lower("code").alias("lcode"), F.lower(F.substring("code", 1, 2)).alias("gram"))
    heads = lower.agg(F.collect_set("gram").alias("heads"))  # one row, no longer than the mapping
    near = split.crossJoin(F.broadcast(heads)).withColumn("grams", F.array_intersect(grams, "heads")).drop("chars", "heads")
    named = near.withColumn("gram", F.explode("grams")).drop("grams").join(F.broadcast(lower), "gram")
    named = named.where(F.contains(F.col("headline"), F.col("lcode"))).select("article_id", "symbol", "score").distinct()
    if "source" in articles.columns:
        whole = articles.where(F.col("score").isNotNull() & (F.length("source") > 0)).where(F.contains(headline, F.lower("source"))).select("article_id", "score")
        codes = code.agg(F.collect_set("symbol").alias("symbols"))  # one row, as long as the mapping
        by_source = whole.crossJoin(F.broadcast(codes)).select("article_id", F.explode("symbols").alias("symbol"), "score")
        named = named.unionByName(by_source).distinct()
    fallback = named.join(direct.select("article_id", "symbol"), ["article_id", "symbol"], "left_anti")
    return direct.unionByName(fallback)


def bars_since_entry(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of each position from the last one before its entry to the end of the series.

    Positions are spread over the days they touch, so the range join is an equality on (symbol, day) plus a filter.
    """
    ends = bars.groupBy("symbol").agg(F.max("time").alias("__end"))
    before = bars.select("symbol", F.col("time").alias("__start"))
    # Strictly before: the newest bar up to the instant ahead of the entry.
    p = asof_join(positions.withColumn("__ahead", F.col("time") - F.expr("INTERVAL 1 MICROSECOND")), before, ["__start"], on="__ahead", right_on="__start")
    p = p.drop("__ahead").withColumn("__start", F.coalesce("__start", "time")).join(ends, "symbol").where(F.col("__end") >= F.col("__start"))
    p = p.withColumn("day", F.explode(F.sequence(F.to_date("__start"), F.to_date("__end")))).withColumnRenamed("time", "entry_time")
    b = bars.select("symbol", F.to_date("time").alias("day"), F.col("time").alias("bar_time"), "high", "low", "close")
    return p.join(b, ["symbol", "day"]).where(F.col("bar_time") >= F.col("__start")).drop("day", "__start", "__end")
