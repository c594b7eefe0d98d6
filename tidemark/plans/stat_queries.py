"""Correlation, drift, rank statistics."""

from pyspark.sql import functions as F

from tidemark.operators import stats as S
from tidemark.operators.indicators import adx
from tidemark.operators.windows import forward_returns, last_rows
from tidemark.operators.chunks import rolling
from tidemark.plans.flow_queries import rounded
from tidemark.plans.registry import query
from tidemark.plans.sqltext import Scan, erfc_sql
from tidemark.plans.views import Tables, sql
from tidemark.plans.window_queries import frame
from tidemark.session import settle

CORR = {
    "rt": "SELECT symbol, time, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM bars",
    "rc": "SELECT * FROM rt WHERE ret IS NOT NULL AND time > (SELECT max(time) FROM bars) - INTERVAL 240 HOURS",
    "fl": "SELECT * FROM rc WHERE time IN (SELECT time FROM rc GROUP BY time HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars))",
    "cm": "SELECT a.symbol AS s1, b.symbol AS s2, corr(a.ret, b.ret) AS corr, count(*) AS n FROM fl a JOIN fl b ON a.time = b.time AND a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 5",
}


@query("correlation_matrix", sql("SELECT s1, s2, round(corr, 6) AS corr, n FROM cm", **CORR))
def _(t: Tables):
    return rounded(S.corr_matrix(t.bars(), 240))


@query(
    "correlation_reduction",
    sql(
        """SELECT symbol, round(c, 6) AS max_corr, round(CASE WHEN c <= 0.5 THEN 1 ELSE greatest(1 - (c - 0.5) / 0.5 * 0.5, 0.5) END, 6) AS reduction FROM (
SELECT symbol, greatest(max(c), 0) AS c FROM (SELECT s1 AS symbol, s2 AS other, least(abs(corr) * 8, 1) AS c FROM cm UNION ALL SELECT s2, s1, least(abs(corr) * 8, 1) FROM cm) WHERE other IN ('click', 'view') GROUP BY 1)""",
        **CORR,
    ),
)
def _(t: Tables):
    # The sample's symbols are independent; scaling their correlations exercises the whole range of the rule.
    c = S.corr_matrix(t.bars(), 240).withColumn("corr", F.least(F.abs("corr") * 8, F.lit(1.0)))
    held = t.event_meta().where(F.col("symbol").isin("click", "view"))
    return rounded(S.corr_reduction(c, held))


@query(
    "adx_percentiles",
    sql(
        "SELECT symbol, round(quantile_cont(sadx, 0.5), 6) AS p50, round(quantile_cont(sadx, 0.7), 6) AS p70 FROM r JOIN bars USING (symbol, rn) WHERE time > (SELECT max(b2.time) FROM bars b2 WHERE b2.symbol = bars.symbol) - INTERVAL 20 DAYS GROUP BY 1",
        **Scan().adx_seeded(14).ctes("r"),
    ),
)
def _(t: Tables):
    return rounded(S.adx_percentiles(settle(adx(t.bars(), 14)), 20))


FEATS = ["close", "tick_volume", "spread", "ret_1"]
FEAT_BASE = {"fb": "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret_1, count(*) OVER (PARTITION BY symbol) AS nn FROM bars"}
FEAT_LONG = " UNION ALL ".join(f"SELECT symbol, rn, nn, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM fb WHERE {f} IS NOT NULL" for f in FEATS)


def featured(t: Tables):
    from tidemark.operators.windows import returns

    return settle(returns(t.bars(), (1,)))


def baseline(live, share: float = 0.45):
    """The oldest share of each symbol's rows: what later rows are compared with."""
    size = live.groupBy("symbol").agg(F.max("rn").alias("__n"))
    return live.join(size, "symbol").where(F.col("rn") <= F.floor(F.col("__n") * share)).drop("__n")


@query("feature_stats", sql("SELECT symbol, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM fl GROUP BY 1, 2 HAVING count(*) > 10", fb=FEAT_BASE["fb"], fl=FEAT_LONG))
def _(t: Tables):
    return rounded(S.feature_stats(featured(t), FEATS))


def _psi_sql(by: str) -> dict[str, str]:
    qs = ", ".join(f"quantile_cont(close, {i / 10})" for i in range(1, 10))
    return {
        "ex": "SELECT symbol, close FROM bars WHERE time < TIMESTAMP '2024-01-16'",
        "ac": "SELECT symbol, close FROM bars WHERE time >= TIMESTAMP '2024-01-16'",
        "ed": f"SELECT symbol, [{qs}] AS e, count(*) AS te FROM ex GROUP BY 1",
        "bn": """SELECT symbol, k, (SELECT count(*) FROM ex WHERE ex.symbol = g.symbol AND len(list_filter(g.e, lambda x: x <= ex.close)) = k) / te AS pe,
  (SELECT count(*) FROM ac WHERE ac.symbol = g.symbol AND len(list_filter(g.e, lambda x: x <= ac.close)) = k) / (SELECT count(*) FROM ac WHERE ac.symbol = g.symbol) AS pa
  FROM (SELECT * FROM ed, range(10) t(k)) g""",
    }


@query("psi", sql("SELECT symbol, round(sum((greatest(pa, 1e-10) - greatest(pe, 1e-10)) * ln(greatest(pa, 1e-10) / greatest(pe, 1e-10))), 6) AS psi FROM bn GROUP BY 1", **_psi_sql("symbol")))
def _(t: Tables):
    b = t.bars()
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return rounded(S.psi(b.where(F.col("time") < cut), b.where(F.col("time") >= cut), ["symbol"], "close"))


# Normal deciles, to the precision of the quantile approximation used.
_Z = [-1.2815515655446, -0.8416212335729, -0.5244005127080, -0.2533471031357, 0.0, 0.2533471031357, 0.5244005127080, 0.8416212335729, 1.2815515655446]
DRIFT = {
    "fb": FEAT_BASE["fb"],
    "fl": FEAT_LONG,
    "st": "SELECT symbol, feature, avg(value) AS mean, stddev_samp(value) AS std FROM fl WHERE rn <= floor(nn * 0.45) GROUP BY 1, 2",
}


@query(
    "psi_drift",
    sql(
        """SELECT symbol, feature, round(psi, 6) AS psi, count(*) FILTER (psi > 0.2) OVER (PARTITION BY symbol) AS n_drifted, round(max(psi) OVER (PARTITION BY symbol), 6) AS max_psi,
count(*) FILTER (psi > 0.2) OVER (PARTITION BY symbol) >= 3 AS drift FROM (SELECT symbol, feature, sum((greatest(pa, 1e-10) - 0.1::DOUBLE) * ln(greatest(pa, 1e-10) / 0.1::DOUBLE)) AS psi FROM (
SELECT g.symbol, g.feature, g.k, coalesce(n, 0) / ta AS pa FROM (SELECT symbol, feature, count(*) AS ta, unnest(range(10)) AS k FROM lv GROUP BY 1, 2) g LEFT JOIN (SELECT symbol, feature, b, count(*) AS n FROM lv GROUP BY 1, 2, 3) c
ON c.symbol = g.symbol AND c.feature = g.feature AND c.b = g.k) GROUP BY 1, 2)""",
        **DRIFT,
        lv=f"""SELECT l.symbol, l.feature, len(list_filter({_Z}, lambda x: x <= (value - mean) / std)) AS b FROM (SELECT *, row_number() OVER (PARTITION BY symbol, feature ORDER BY rn DESC) AS k FROM fl) l
  JOIN st ON st.symbol = l.symbol AND st.feature = l.feature WHERE k <= 200""",
    ),
)
def _(t: Tables):
    live = featured(t)
    return rounded(S.psi_drift(live, S.feature_stats(baseline(live), FEATS), FEATS))


@query(
    "z_drift",
    sql(
        "SELECT symbol, count(*) FILTER (z > 0.5) AS n_drifted, round(max(z), 6) AS max_z, count(*) FILTER (z > 0.5) >= 3 AS drift FROM (SELECT l.symbol, abs(value - mean) / std AS z FROM fl l JOIN st ON st.symbol = l.symbol AND st.feature = l.feature WHERE rn = nn) GROUP BY 1",
        **DRIFT,
    ),
)
def _(t: Tables):
    live = featured(t)
    return rounded(S.z_drift(live, S.feature_stats(baseline(live), FEATS), FEATS, 0.5))


@query(
    "confidence_drift",
    sql("SELECT symbol, round(b, 6) AS baseline, round(r, 6) AS recent, round(1 - r / b, 6) AS drop_ratio, coalesce(1 - r / b > 0.15, false) AS drift FROM (SELECT symbol, avg(c) FILTER (rn <= 50) AS b, avg(c) FILTER (rn > nn - 50) AS r FROM (SELECT symbol, rn, least(close / 100, 1) AS c, count(*) OVER (PARTITION BY symbol) AS nn FROM bars) GROUP BY 1)"),
)
def _(t: Tables):
    return rounded(S.confidence_drift(t.bars().withColumn("conf", F.least(F.col("close") / 100, F.lit(1.0)))))


COMPONENTS = ["volume", "close_pos", "news"]
SCORED = {
    "sc": f"""SELECT symbol, time, rn, coalesce(least(tick_volume / avg(tick_volume) {frame(20)} / 1.2, 1), 0.5) AS volume, round((close - low) / greatest(high - low, 1e-10), 2) AS close_pos, 0.5::DOUBLE AS news,
  (lead(close, 24) OVER (PARTITION BY symbol ORDER BY rn) - close) / close * CASE WHEN close < open THEN -1 ELSE 1 END AS fwd_24 FROM bars""",
    "lg": " UNION ALL ".join(f"SELECT symbol, time, '{c}' AS component, {c} AS value, fwd_24 FROM sc WHERE fwd_24 IS NOT NULL" for c in COMPONENTS),
    "rk": """SELECT *, rank() OVER (PARTITION BY component ORDER BY value) + (count(*) OVER (PARTITION BY component, value) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY component ORDER BY fwd_24) + (count(*) OVER (PARTITION BY component, fwd_24) - 1) / 2.0 AS ry,
  row_number() OVER (PARTITION BY component ORDER BY value, time, symbol) AS fr, count(*) OVER (PARTITION BY component) AS nn FROM lg""",
}


def scored(t: Tables):
    """Component scores and signed forward returns per bar, all from bounded frames."""
    s = t.bars().withColumn("signal", F.when(F.col("close") < F.col("open"), "sell").otherwise("buy"))
    s = forward_returns(s, (24,))

    def build(df, w):
        v = F.least(F.col("tick_volume") / F.avg("tick_volume").over(last_rows(w, 20)) / 1.2, F.lit(1.0))
        pos = F.round((F.col("close") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-10)), 2)
        return df.withColumn("volume", F.coalesce(v, F.lit(0.5))).withColumn("close_pos", pos).withColumn("news", F.lit(0.5))

    return settle(rolling(s, build, back=19).select("symbol", "time", "rn", *COMPONENTS, "fwd_24"))


@query(
    "rank_ic",
    sql("SELECT component, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(CASE WHEN stddev_pop(value) > 0 THEN corr(rx, ry) ELSE 0 END, 6) AS ic FROM rk GROUP BY 1", **SCORED),
)
def _(t: Tables):
    return rounded(S.rank_ic(scored(t), COMPONENTS)).drop("p_value")


@query(
    "rank_ic_p_value",
    sql(
        f"SELECT component, round(ic, 6) AS ic, round(CASE WHEN abs(ic) >= 1 THEN 0 ELSE {erfc_sql('t')} END, 6) AS p_value FROM (SELECT *, abs(ic * sqrt((n - 2) / (1 - ic * ic))) / sqrt(2.0::DOUBLE) AS t FROM rc)",
        **SCORED,
        rc="SELECT component, count(*) AS n, CASE WHEN stddev_pop(value) > 0 THEN corr(rx, ry) ELSE 0 END AS ic FROM rk GROUP BY 1 HAVING count(*) >= 50",
    ),
)
def _(t: Tables):
    return rounded(S.rank_ic(scored(t), COMPONENTS)).select("component", "ic", "p_value")


@query(
    "rank_auc",
    sql("SELECT component, round((sum(rx) FILTER (fwd_24 > 0) - np * (np + 1) / 2.0) / (np * nneg), 6) AS auc, round(np / (np + nneg), 6) AS win_rate FROM (SELECT *, count(*) FILTER (fwd_24 > 0) OVER (PARTITION BY component) AS np, count(*) FILTER (fwd_24 <= 0) OVER (PARTITION BY component) AS nneg FROM rk) GROUP BY component, np, nneg", **SCORED),
)
def _(t: Tables):
    return rounded(S.rank_auc(scored(t), COMPONENTS))


@query(
    "quartile_spread",
    sql(
        """SELECT component, round(avg(fwd_24) FILTER (q = 1), 6) AS q1_ret, round(avg(fwd_24) FILTER (q = 4), 6) AS q4_ret, round(avg(fwd_24) FILTER (q = 4) - avg(fwd_24) FILTER (q = 1), 6) AS spread_q4_q1 FROM (
SELECT *, CASE WHEN e[1] < e[2] AND e[2] < e[3] AND e[3] < e[4] AND e[4] < e[5] THEN CASE WHEN value <= e[2] THEN 1 WHEN value <= e[3] THEN 2 WHEN value <= e[4] THEN 3 ELSE 4 END
ELSE CASE WHEN fr <= 1 + (nn - 1) * 0.25 THEN 1 WHEN fr <= 1 + (nn - 1) * 0.5 THEN 2 WHEN fr <= 1 + (nn - 1) * 0.75 THEN 3 ELSE 4 END END AS q
FROM rk JOIN (SELECT component, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS e FROM lg GROUP BY 1) USING (component)) GROUP BY 1""",
        **SCORED,
    ),
)
def _(t: Tables):
    return rounded(S.quartile_spread(scored(t), COMPONENTS))


@query(
    "quartile_winrate",
    sql(
        """SELECT symbol, round(avg(CASE WHEN fwd_24 > 0 THEN 1.0 ELSE 0.0 END) FILTER (volume >= hi), 6) AS top_win_rate, round(avg(CASE WHEN fwd_24 > 0 THEN 1.0 ELSE 0.0 END) FILTER (volume <= lo), 6) AS bot_win_rate
FROM sc JOIN (SELECT symbol, quantile_cont(volume, 0.25) AS lo, quantile_cont(volume, 0.75) AS hi FROM sc WHERE fwd_24 IS NOT NULL GROUP BY 1) USING (symbol) WHERE fwd_24 IS NOT NULL GROUP BY 1""",
        sc=SCORED["sc"],
    ),
)
def _(t: Tables):
    return rounded(S.quartile_winrate(scored(t), "volume", "fwd_24", ["symbol"]))


@query("percentile_of_score", sql("SELECT symbol, round(avg(CASE WHEN close <= 50 THEN 100.0 ELSE 0.0 END), 6) AS percentile_rank FROM bars GROUP BY 1"))
def _(t: Tables):
    return rounded(S.percentile_of_score(t.bars_h1(), "close", F.lit(50.0), ["symbol"]))


@query(
    "binary_metrics",
    sql("""SELECT tp, fp, fn, tn, round((fp + fn) / (tp + fp + fn + tn), 6) AS mae, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy
FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM labels)"""),
)
def _(t: Tables):
    p = t.read("labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))
    return rounded(S.binary_metrics(p))
