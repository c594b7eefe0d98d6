"""News sources: nested article JSON and RSS items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import parse_iso

ARTICLE_SCHEMA = """uuid string, title string, description string, source string, published_at string, overall_sentiment_score double,
  entities array<struct<symbol: string, sentiment_score: double>>"""


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles with their entity array; the id falls back to title and publication time."""
    raw = spark.read.schema(ARTICLE_SCHEMA).json(path)
    fallback = F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("published_at", F.lit("")))
    return raw.select(
        F.coalesce("uuid", fallback).alias("article_id"), "title", "description", "source", parse_iso("published_at").alias("time"),
        F.col("overall_sentiment_score").alias("score"), "entities",
    )


def explode_entities(articles: DataFrame) -> DataFrame:
    """One row per (article, entity); articles without entities keep one row."""
    return articles.select(
        "article_id", "time", F.explode_outer("entities").alias("e")
    ).select("article_id", "time", F.upper("e.symbol").alias("entity"), F.coalesce("e.sentiment_score", F.when(F.col("e").isNotNull(), 0.0)).alias("score"))


def entity_sentiment(entities: Column) -> Column:
    """Mean sentiment of an entity array, unknown scores counting as 0; null for an empty array."""
    total = F.aggregate(entities, F.lit(0.0), lambda acc, e: acc + F.coalesce(e["sentiment_score"], F.lit(0.0)))
    return F.when(F.size(entities) > 0, total / F.size(entities))


# Publication date formats tried in order.
RSS_FORMATS = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")


def rss_time(col: str) -> Column:
    """Publication time in UTC. Weekday names are dropped first: they carry no information."""
    text = F.regexp_replace(F.trim(F.col(col)), r"^[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"\s(GMT|UTC|Z)$", " +0000")
    tries = [F.try_to_timestamp(text, F.lit(f.replace("EEE, ", ""))) for f in RSS_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def xml_text(col: str | Column, cdata: Column | bool = False) -> Column:
    """Text as XML content: escaped, or as a CDATA section where `cdata` holds and the text allows one.

    Characters that XML can't hold become U+FFFD. Carriage returns are always escaped: a reader makes line feeds of plain ones.
    """
    text = F.regexp_replace(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "\uFFFD")
    escaped = text
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(name))
    usable = F.lit(cdata) if isinstance(cdata, bool) else cdata
    usable = usable & ~F.contains(text, F.lit("]]>")) & ~F.contains(text, F.lit("\r")) & ~F.contains(text, F.lit("</item>"))
    return F.when(usable, F.concat(F.lit("<![CDATA["), text, F.lit("]]>"))).otherwise(escaped)


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Every item of the feeds below a path: title, text (title and description), time, and `raw` where it can't be parsed.

    Feeds are cut behind each closing item tag, so that long files are read by many tasks and a broken item ends with
    itself instead of with its file.
    """
    pieces = spark.read.option("lineSep", "</item>").text(path).where(F.col("value").rlike(r"<item[\s>]"))
    item = F.concat(F.regexp_extract("value", r"(?s)<item[\s>].*", 0), F.lit("</item>"))
    schema = "title string, description string, pubDate string, raw string"
    options = {"rowTag": "item", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "raw", "ignoreSurroundingSpaces": "false"}
    rows = pieces.select(F.from_xml(item, schema, options).alias("i")).select("i.*")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return rows.select("title", F.when(F.col("raw").isNull(), text).alias("text"), rss_time("pubDate").alias("time"), "raw")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """The items that can be parsed: title, text, time."""
    return rss_items(spark, path).where(F.col("raw").isNull()).drop("raw")


def rss_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The items that can't be parsed, as they stand in the feed."""
    return rss_items(spark, path).where(F.col("raw").isNotNull()).select("raw")
