"""Result sinks, and the log source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_candidates(candidates: DataFrame, path: str) -> None:
    candidates.write.mode("overwrite").partitionBy("symbol").option("header", True).csv(path)


def write_report(candidates: DataFrame, path: str, rank_col: str, n: int = 10) -> None:
    """One JSON object per symbol: its best `n` rows, best first, and how many rows it had."""
    from tidemark.operators.ranking import top_k_per

    rest = [c for c in candidates.columns if c != "symbol"]
    best = top_k_per(candidates, ["symbol"], [F.desc(rank_col), *rest], n)
    top = best.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("rank", *rest))).alias("top"))  # n per symbol
    total = candidates.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_all"))
    top.join(total, "symbol").write.mode("overwrite").json(path)


LOG_LINE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} \[(INFO|WARNING|ERROR)\]"


def tail_log(spark: SparkSession, path: str, n: int = 60) -> DataFrame:
    """The newest `n` lines that carry a timestamp and a level."""
    lines = spark.read.text(path).where(F.col("value").rlike(LOG_LINE))
    stamp = F.substring("value", 1, 23)
    return lines.select(stamp.alias("stamp"), F.regexp_extract("value", LOG_LINE, 1).alias("level"), F.col("value").alias("line")).orderBy(
        F.desc("stamp"), F.desc("line")
    ).limit(n)


def parse_result_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Columns out of optimizer log lines such as ``SYM  EMA10/40  SL=1.5 RR=2.0 ADX=28 PF=0.73 Ret=Rs.-1.5 n=102 WF=0``."""
    line = F.col(col)
    num = lambda pattern, kind: F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast(kind)
    real = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    return lines.where(line.contains("WF=") & line.contains("PF=")).select(
        F.regexp_extract(line, r"^\s*(\S+)", 1).alias("symbol"),
        num(r"EMA(\d+)/", "int").alias("ema_fast"),
        num(r"EMA\d+/(\d+)", "int").alias("ema_slow"),
        num(rf"\bSL={real}", "double").alias("sl"),
        num(rf"\bRR={real}", "double").alias("rr"),
        num(r"\bADX=(\d+)", "int").alias("adx"),
        num(rf"\bPF={real}", "double").alias("pf"),
        num(rf"\bRet=Rs\.{real}", "double").alias("ret"),
        num(r"\bn=(\d+)", "int").alias("n_trades"),
        num(rf"\bWF={real}", "double").alias("wf_score"),
    )
