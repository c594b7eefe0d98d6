"""Trade journal files and journal filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOURNAL_COLUMNS = (
    "ticket", "symbol", "type", "volume", "entry_price", "sl", "tp", "entry_time", "atr", "exit_price", "exit_time", "pnl", "pips", "event",
)
_NUMERIC = {"volume", "entry_price", "sl", "tp", "atr", "exit_price", "pips"}


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows with exactly the journal's columns, typed, and the quarantined raw lines.

    Reading an unreadable path raises; an empty journal gives two empty frames.
    """
    raw = spark.read.text(path).where(F.col("value") != ",".join(JOURNAL_COLUMNS))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in JOURNAL_COLUMNS] + [T.StructField("_extra", T.StringType())])
    cells = F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE"})
    n_cells = F.size(F.regexp_extract_all("value", F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(0)))
    # The trailing empty match of the pattern counts one extra cell unless the line ends in a comma.
    width = F.when(F.col("value").endswith(","), n_cells).otherwise(n_cells - 1)
    parsed = raw.select("value", width.alias("n_cells"), cells.alias("c"))
    ok = F.col("n_cells") == len(JOURNAL_COLUMNS)
    typed = []
    for c in JOURNAL_COLUMNS:
        v = F.col(f"c.{c}")
        if c == "ticket":
            v = v.cast("long")
        elif c in _NUMERIC:
            v = F.expr(f"try_cast(c.{c} AS DOUBLE)")
        elif c == "pnl":
            v = F.expr("try_cast(c.pnl AS DECIMAL(18,4))")
        elif c.endswith("_time"):
            v = F.try_to_timestamp(v).cast("timestamp_ntz")
        typed.append(v.alias(c))
    return parsed.where(ok).select(*typed), parsed.where(~ok).select("value", "n_cells")


def closed_on(journal: DataFrame, day: str) -> DataFrame:
    """Rows closed on a calendar day: an exit time that day, not an OPEN row, pnl present."""
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    that_day = (F.col("exit_time") >= start) & (F.col("exit_time") < start + F.expr("INTERVAL 1 DAY"))
    return journal.where(that_day & (F.coalesce("event", F.lit("")) != "") & (F.col("event") != "OPEN") & F.col("pnl").isNotNull())


def prune_tickets(journal: DataFrame, tickets: DataFrame) -> DataFrame:
    return journal.join(tickets, "ticket", "left_anti")
