"""Windows, scores, searches, overfitting and Monte-Carlo checks."""

from pyspark.sql import functions as F

from tidemark.functions import numbers as M
from tidemark.operators import montecarlo as MC
from tidemark.operators import overfit as O
from tidemark.operators import search as S
from tidemark.operators import trades as X
from tidemark.operators.chunks import index_rows
from tidemark.operators.joins import param_grid
from tidemark.plans.flow_queries import rounded
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import HELD, held_bars, trailing_sql
from tidemark.plans.sqltext import erfc_sql
from tidemark.plans.stat_queries import COMPONENTS, scored
from tidemark.plans.trade_queries import BASE, _curve
from tidemark.plans.views import Tables, sql
from tidemark.session import settle

def mix_sql(*parts: str, seed: int = 42) -> str:
    p, x = 2147483647, f"{seed}::BIGINT"
    for part in parts:
        x = f"(({x} * 48271 + {part}) % {p})"
        x = f"(({x} * {x} + 12345) % {p})"
        x = f"(({x} * 69621 + {part}) % {p})"
        x = f"(({x} * {x} + {x}) % {p})"
    return x


WF = {
    "ed": "SELECT symbol, min(time) AS st, max(time) AS en FROM trades GROUP BY 1",
    "ww": "SELECT symbol, CAST(k AS INTEGER) AS window_id, en - to_months(CAST(k * 6 AS INTEGER)) AS oos_end FROM ed, range(4) r(k)",
    "wo": "SELECT *, oos_end - to_months(6) AS oos_start FROM ww",
    "wi": "SELECT *, oos_start - to_months(24) AS is_start FROM wo",
}


@query(
    "walk_forward_windows",
    sql(
        """SELECT w.symbol, window_id, is_start, oos_start AS is_end, oos_start, oos_end, count(*) FILTER (time >= is_start AND time < oos_start) AS n_is, count(*) FILTER (time >= oos_start AND time < oos_end) AS n_oos
FROM wi w JOIN trades t USING (symbol) GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) FILTER (time >= is_start AND time < oos_start) >= 200 AND count(*) FILTER (time >= oos_start AND time < oos_end) >= 100""",
        **WF,
    ),
)
def _(t: Tables):
    tr = t.trades().select("symbol", "time")
    return S.window_counts(tr, S.wf_windows(tr))


@query(
    "purged_rolling_windows",
    sql(
        """SELECT symbol, CAST(k AS INTEGER) AS window_id, st + to_months(CAST(k AS INTEGER)) AS is_start, st + to_months(CAST(k + 24 AS INTEGER)) AS is_end, st + to_months(CAST(least(k + 25, m) AS INTEGER)) AS oos_start, st + to_months(CAST(least(k + 31, m) AS INTEGER)) AS oos_end
FROM (SELECT *, greatest(date_diff('day', CAST(st AS DATE), CAST(en AS DATE)) // 30, 1) AS m FROM ed), range(15) r(k) WHERE m >= 31 AND k <= m - 31 AND st + to_months(CAST(least(k + 25, m) AS INTEGER)) < en""",
        ed=WF["ed"],
    ),
)
def _(t: Tables):
    return S.cpcv_windows(t.trades().select("symbol", "time"))


@query(
    "bar_count_folds",
    sql("SELECT symbol, CAST(k AS BIGINT) AS fold, CAST(s + k * 100 AS BIGINT) AS train_start, CAST(s + k * 100 + 300 AS BIGINT) AS train_end, CAST(s + k * 100 + 400 AS BIGINT) AS test_end FROM (SELECT symbol, count(*) AS n, greatest(50, floor(count(*) * 0.2)) AS s FROM bars GROUP BY 1), range(50) r(k) WHERE s + k * 100 + 400 < n"),
)
def _(t: Tables):
    return S.bar_folds(t.bars_h1(), 300, 100, 50)


# Window results per (symbol, regime as parameter, exit_reason x year as window) from the trades.
WR = {
    "wr": """SELECT symbol, regime AS param_id, year(time) AS window_id, exit_reason, CAST(sum(pnl) FILTER (pnl > 0) AS DOUBLE) / nullif(CAST(abs(sum(pnl) FILTER (pnl < 0)) AS DOUBLE), 0) AS pf, CAST(sum(pnl) AS DOUBLE) AS ret,
  CAST(max(pnl) AS DOUBLE) AS dd, count(*) FILTER (pnl > 0) / count(*) AS wr, count(*) AS n FROM trades GROUP BY 1, 2, 3, 4""",
    "ws": "SELECT *, CASE WHEN n < 3 THEN -999 ELSE least(coalesce(pf, 0), 3) * CASE WHEN dd > 0 THEN abs(ret / dd) ELSE 0 END * (1 + 0.05::DOUBLE * sqrt(n)) END AS score FROM wr",
    "wa": """SELECT *, CASE WHEN n < 3 THEN -999 ELSE b * p * CASE WHEN wr BETWEEN 0.50 AND 0.55 THEN 1.15::DOUBLE WHEN wr > 0.60 THEN 1 - least(0.7::DOUBLE, (wr - 0.6::DOUBLE) * 5) ELSE 1 END * CASE WHEN p BETWEEN 1.2 AND 1.6 THEN 1.15::DOUBLE WHEN p > 2 THEN greatest(0.3::DOUBLE, 1 - (p - 2) * 0.3::DOUBLE) ELSE 1 END END AS alt
  FROM (SELECT *, CASE WHEN ret - dd * 0.3::DOUBLE < 0 AND p > 1 THEN (ret - dd * 0.3::DOUBLE) * 0.5::DOUBLE ELSE ret - dd * 0.3::DOUBLE END AS b FROM (SELECT *, least(coalesce(pf, 0), 3) AS p FROM ws))""",
    "wf": """SELECT i.symbol, i.param_id, i.window_id, i.score AS is_score, coalesce(o.pf, 0) AS oos_pf, i.alt AS is_alt, o.alt AS oos_alt, o.score AS oos_score, o.n AS oos_n FROM wa i JOIN wa o USING (symbol, param_id, window_id) WHERE i.exit_reason = 'F' AND o.exit_reason = 'O'""",
}


def window_results(t: Tables):
    tr = t.trades()
    d = lambda c: c.cast("double")
    win, loss = d(F.sum(F.when(F.col("pnl") > 0, F.col("pnl")))), d(F.abs(F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))))
    r = tr.groupBy("symbol", F.col("regime").alias("param_id"), F.year("time").cast("long").alias("window_id"), "exit_reason").agg(
        win.alias("w"), loss.alias("l"), d(F.sum("pnl")).alias("ret"), d(F.max("pnl")).alias("dd"), (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("wr"), F.count(F.lit(1)).alias("n")
    )
    r = r.withColumn("pf", F.try_divide("w", "l"))
    a = [F.col(c) for c in ("pf", "ret", "dd")]
    r = r.withColumn("score", S.score_result(*a, F.col("n"))).withColumn("alt", S.score_result_alt(*a, F.col("wr"), F.col("n")))
    pick = lambda reason, c: F.max(F.when(F.col("exit_reason") == reason, F.col(c)))
    both = r.where(F.col("exit_reason").isin("F", "O")).groupBy("symbol", "param_id", "window_id").agg(
        pick("F", "score").alias("is_score"), F.coalesce(pick("O", "pf"), F.lit(0.0)).alias("oos_pf"), pick("F", "alt").alias("is_alt"), pick("O", "alt").alias("oos_alt"), pick("O", "score").alias("oos_score"), pick("O", "n").alias("oos_n"),
    )
    return r, both.where(F.col("is_score").isNotNull() & F.col("oos_score").isNotNull())


@query("result_scores", sql("SELECT symbol, param_id, window_id, exit_reason, n, round(score, 4) AS score, round(alt, 2) AS alt FROM wa", **WR))
def _(t: Tables):
    return window_results(t)[0].select("symbol", "param_id", "window_id", "exit_reason", "n", F.round("score", 4).alias("score"), F.round("alt", 2).alias("alt"))


@query("walk_forward_score", sql("SELECT symbol, param_id, round(avg(is_score) * CASE WHEN bool_or(oos_pf < 0.8) THEN 0.5 ELSE 1 END * CASE WHEN bool_and(oos_pf >= 1.0) THEN 1.2 ELSE 1 END, 4) AS wf_score FROM wf GROUP BY 1, 2", **WR))
def _(t: Tables):
    return rounded(S.score_wf(window_results(t)[1], ["symbol", "param_id"]), 4)


@query(
    "walk_forward_score_alt",
    sql(
        """SELECT symbol, param_id, round(avg(is_alt) * product(CASE WHEN d > 0.5 THEN greatest(0.1::DOUBLE, 1 - (d - 0.3::DOUBLE) * 2) ELSE 1 END) * CASE WHEN count(*) FILTER (oos_pf >= 1) >= 2 THEN 1.15::DOUBLE WHEN count(*) FILTER (oos_pf >= 1) = 0 THEN 0.5::DOUBLE ELSE 1 END, 2) AS wf_alt
FROM (SELECT *, CASE WHEN is_alt > 0 AND oos_n >= 3 THEN (is_alt - oos_alt) / greatest(abs(is_alt), 0.01) END AS d FROM wf) GROUP BY 1, 2""",
        **WR,
    ),
)
def _(t: Tables):
    return rounded(S.score_wf_alt(window_results(t)[1], ["symbol", "param_id"]), 2)


@query(
    "cpcv_score",
    sql(
        """SELECT symbol, param_id, round(CASE WHEN k < 3 THEN -999 WHEN coalesce(kr >= 3 AND pf25 >= 1.1, false) THEN p50 * CASE WHEN ok THEN 1.2::DOUBLE ELSE 1 END + p25 ELSE (p50 * 0.5::DOUBLE + p25) * 0.25::DOUBLE END, 4) AS cpcv_score FROM (
SELECT symbol, param_id, count(*) FILTER (oos_score > -999) AS k, quantile_cont(oos_score, 0.25) FILTER (oos_score > -999) AS p25, quantile_cont(oos_score, 0.5) FILTER (oos_score > -999) AS p50,
count(*) FILTER (oos_n >= 3) AS kr, quantile_cont(oos_pf, 0.25) FILTER (oos_n >= 3) AS pf25, bool_and(oos_pf >= 1) FILTER (oos_n >= 3) AS ok FROM wf GROUP BY 1, 2)""",
        **WR,
    ),
)
def _(t: Tables):
    return rounded(S.score_cpcv(window_results(t)[1], ["symbol", "param_id"]), 4)


# Candidates: per brand, the grid axes are part attributes, the metrics come from the trades of those parts.
CA = {
    "ca": """SELECT p_brand AS symbol, 4 + p_size % 6 AS ema_fast, 20 + (p_size // 6) % 5 * 5 AS ema_slow, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS sl, CASE WHEN p_partkey % 2 = 0 THEN 2.0::DOUBLE ELSE 2.5::DOUBLE END AS rr,
  25 AS adx, 0.6::DOUBLE AS score, round(CAST(sum(pnl) AS DOUBLE) / 100000, 4) AS wf_score, count(*) AS n_trades FROM trades JOIN part ON p_partkey = part_id GROUP BY ALL""",
}


def candidates(t: Tables):
    p = t.read("part")
    keyed = p.select(
        F.col("p_partkey").alias("part_id"), (4 + F.col("p_size") % 6).alias("ema_fast"), (20 + F.floor(F.col("p_size") / 6) % 5 * 5).cast("int").alias("ema_slow"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL"), 1.0).otherwise(1.5).alias("sl"), F.when(F.col("p_partkey") % 2 == 0, 2.0).otherwise(2.5).alias("rr"),
    )
    g = t.trades().join(keyed, "part_id").groupBy("symbol", "ema_fast", "ema_slow", "sl", "rr", F.lit(25).alias("adx"), F.lit(0.6).alias("score"))
    return g.agg(F.round(F.sum("pnl").cast("double") / 100000, 4).alias("wf_score"), F.count(F.lit(1)).alias("n_trades"))


@query(
    "stability_penalty",
    sql(
        """SELECT c.symbol, c.ema_fast, c.ema_slow, c.sl, c.rr, c.wf_score, round(s.v, 6) AS stability FROM ca c JOIN (SELECT a.symbol, a.ema_fast, a.ema_slow, CASE WHEN count(*) < 2 THEN 1 ELSE 1 / (1 + stddev_pop(b.w) / greatest(abs(avg(b.w)), 0.01)) END AS v
FROM be a JOIN be b ON a.symbol = b.symbol AND abs(b.r - round(a.r, 4)) < 0.005 GROUP BY 1, 2, 3) s USING (symbol, ema_fast, ema_slow)""",
        **CA,
        be="SELECT symbol, ema_fast, ema_slow, max(wf_score) AS w, ema_fast / ema_slow AS r FROM ca GROUP BY 1, 2, 3",
    ),
)
def _(t: Tables):
    return rounded(S.stability(candidates(t)).select("symbol", "ema_fast", "ema_slow", "sl", "rr", "wf_score", "stability"))


@query(
    "plateau_pick",
    sql(
        """SELECT symbol, ema_fast, ema_slow, sl, rr, wf_score, n_trades FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ema_fast, ema_slow, sl, rr) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM (
SELECT *, max(wf_score) OVER (PARTITION BY symbol) AS b FROM ca) WHERE wf_score >= b * 0.5 AND n_trades >= 3) WHERE k = n // 2 + 1""",
        **CA,
    ),
)
def _(t: Tables):
    return S.plateau_pick(candidates(t), pct=0.5).select("symbol", "ema_fast", "ema_slow", "sl", "rr", "wf_score", "n_trades")


@query(
    "param_changes",
    sql(
        "SELECT symbol, key, old, new FROM (SELECT a.symbol, a.key, b.v AS old, a.v AS new FROM nw a LEFT JOIN ol b USING (symbol, key)) WHERE old IS NULL OR abs(old - new) >= 1e-9 * greatest(abs(new), 0.01)",
        nw="SELECT p_brand AS symbol, 'rr' AS key, CAST(max(p_size) AS DOUBLE) AS v FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'sl', CAST(min(p_size) AS DOUBLE) FROM part GROUP BY 1",
        ol="SELECT p_brand AS symbol, 'rr' AS key, 50.0::DOUBLE AS v FROM part GROUP BY 1",
    ),
)
def _(t: Tables):
    g = t.read("part").groupBy(F.col("p_brand").alias("symbol")).agg(F.max("p_size").cast("double").alias("rr"), F.min("p_size").cast("double").alias("sl"))
    return S.param_diff(g.select("symbol", F.lit("rr").alias("key"), F.lit(50.0).alias("value")), g.unpivot("symbol", ["rr", "sl"], "key", "value"))


@query("sweep_rank", sql("SELECT symbol, wf_score, n_trades, CAST(row_number() OVER (ORDER BY wf_score DESC, symbol) AS INTEGER) AS rank FROM (SELECT symbol, sum(wf_score) AS wf_score, CAST(sum(n_trades) AS BIGINT) AS n_trades FROM ca GROUP BY 1) WHERE n_trades >= 30 AND wf_score > 0".replace("sum(wf_score)", "round(sum(wf_score), 4)"), **CA))
def _(t: Tables):
    best = candidates(t).groupBy("symbol").agg(F.round(F.sum("wf_score"), 4).alias("wf_score"), F.sum("n_trades").alias("n_trades"))
    return S.sweep_rank(best)


@query(
    "effective_trials",
    sql("SELECT symbol, count(*) AS n_trials, CAST(least(greatest(count(DISTINCT round(ema_fast / ema_slow, 2)) * count(DISTINCT sl) * count(DISTINCT rr) * count(DISTINCT adx) * count(DISTINCT score), 1), count(*)) AS DOUBLE) AS effective_trials FROM ca GROUP BY 1", **CA),
)
def _(t: Tables):
    return O.effective_trials(candidates(t))


def _with_oos(t: Tables):
    c = candidates(t).withColumn("oos_mean_pf", M.mix("ema_fast", "ema_slow", (F.col("rr") * 10).cast("int"), "n_trades") % 1000 / 500)
    return settle(index_rows(c, ["symbol"], [F.col("ema_fast")], ["ema_fast", "ema_slow", "sl", "rr"], "param_id"))


ET = "SELECT symbol, count(*) AS n_trials, CAST(least(greatest(count(DISTINCT round(ema_fast / ema_slow, 2)) * count(DISTINCT sl) * count(DISTINCT rr) * count(DISTINCT adx) * count(DISTINCT score), 1), count(*)) AS DOUBLE) AS effective_trials FROM {} GROUP BY 1"


def ppf_sql(p: str) -> str:
    """The rational normal quantile as SQL (central part and upper tail, where the trial counts lie)."""

    def horner(cs, x):
        out = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:]:
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    t = f"sqrt(-2 * ln(1 - {p}))"
    mid = f"({horner(M.ACKLAM_A, r)} * {q} / ({horner(M.ACKLAM_B, r)} * {r} + 1))"
    return f"(CASE WHEN {p} > 0.97575 THEN -({horner(M.ACKLAM_C, t)} / ({horner(M.ACKLAM_D, t)} * {t} + 1)) ELSE {mid} END)"


@query(
    "expected_max_sharpe",
    sql(
        f"SELECT symbol, n_trials, effective_trials, round((1 - 0.5772156649015329::DOUBLE) * {ppf_sql('pa')} + 0.5772156649015329::DOUBLE * {ppf_sql('pb')}, 6) AS expected_max_sr FROM (SELECT *, 1 - 1 / greatest(effective_trials, 2.0::DOUBLE) AS pa, 1 - 1 / (greatest(effective_trials, 2.0::DOUBLE) * exp(1)) AS pb FROM et)",
        **CA,
        et=ET.format("ca"),
    ),
)
def _(t: Tables):
    e = O.effective_trials(candidates(t))
    return rounded(e.withColumn("expected_max_sr", O.expected_max_sharpe(F.col("effective_trials"), F.lit(1.0))))


#: Expected best Sharpe (of deviation sd) and the z value of the observed one; z is null without a deviation.
_MAX = f"CASE WHEN sd > 0 THEN sd * ((1 - 0.5772156649015329::DOUBLE) * {ppf_sql('pa')} + 0.5772156649015329::DOUBLE * {ppf_sql('pb')}) ELSE 0 END"
_DSR = f"CASE WHEN q IS NULL THEN 0 ELSE 0.5::DOUBLE * {erfc_sql('q')} END"


def _deflated(source: str) -> dict[str, str]:
    """CTEs from rows of symbol, sr, sd, n_obs, effective_trials to the best expected Sharpe and q = -z / sqrt(2)."""
    return {
        "dk": f"SELECT *, 1 - 1 / greatest(effective_trials, 2.0::DOUBLE) AS pa, 1 - 1 / (greatest(effective_trials, 2.0::DOUBLE) * exp(1)) AS pb FROM ({source})",
        "dm": f"SELECT *, {_MAX} AS best FROM dk",
        "dz": "SELECT *, CASE WHEN n_obs >= 2 THEN -((sr - best) * sqrt(n_obs - 1) / sqrt(1 + 0.5::DOUBLE * sr * sr)) / sqrt(2.0::DOUBLE) END AS q FROM dm",
    }


@query(
    "deflated_sharpe",
    sql(
        f"SELECT symbol, round({_DSR}, 6) AS dsr FROM dz",
        **CA,
        et=ET.format("ca"),
        **_curve(BASE),
        sh="""SELECT symbol, max(n) AS n_obs, CASE WHEN stddev_pop(d) > 0 THEN avg(d) / stddev_pop(d) ELSE 0 END AS sr FROM (SELECT symbol, count(*) OVER (PARTITION BY symbol) AS n, CASE WHEN (rn - 1) % 6 = 0 THEN CAST(equity - lag(equity, 6) OVER (PARTITION BY symbol ORDER BY rn) AS DOUBLE) END AS d FROM curve) GROUP BY symbol""",
        **_deflated("SELECT symbol, sr, 0.02::DOUBLE AS sd, n_obs, effective_trials FROM sh JOIN et USING (symbol)"),
    ),
)
def _(t: Tables):
    m = X.trade_metrics(t.numbered_trades(), 1000000.0).select("symbol", "sharpe", "n_trades")
    e = m.join(O.effective_trials(candidates(t)), "symbol").withColumn("per_trade", F.col("sharpe") / (252**0.5)).withColumn("sd", F.lit(0.02))
    return rounded(O.deflated_sharpe(e, "per_trade", "sd", "effective_trials", "n_trades").select("symbol", "dsr"))


PBO = {
    **CA,
    "co": f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ema_fast, ema_slow, sl, rr) AS param_id, {mix_sql('ema_fast', 'ema_slow', 'CAST(rr * 10 AS INTEGER)', 'n_trades')} % 1000 / 500 AS oos_mean_pf FROM ca",
    "pr": "SELECT symbol, param_id, wf_score AS i, count(*) OVER (PARTITION BY symbol) AS n, rank() OVER (PARTITION BY symbol ORDER BY oos_mean_pf) - 1 AS below FROM co",
    "pd": f"SELECT *, {mix_sql('split', 'param_id', seed=7)} AS h FROM pr, range(1, 65) s(split) WHERE n >= 4",
    "pw": """SELECT symbol, split, n, arg_max(below, {'i': i, 'k': -k}) AS below FROM (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY h, param_id) AS k FROM pd) WHERE k <= greatest(2, n // 2) GROUP BY ALL""",
    "pb": "SELECT symbol, avg(CASE WHEN below / n < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pbo FROM pw GROUP BY 1",
}


@query("overfit_probability", sql("SELECT symbol, round(pbo, 6) AS pbo FROM (SELECT DISTINCT symbol FROM co) LEFT JOIN pb USING (symbol)", **PBO))
def _(t: Tables):
    return rounded(O.pbo(_with_oos(t)))


@query(
    "overfit_summary",
    sql(
        f"SELECT symbol, n_trials, round(effective_trials, 2) AS effective_trials, round(sd, 4) AS sr_std, round(best, 4) AS expected_max_sr, round({_DSR}, 4) AS dsr, round(pbo, 4) AS pbo FROM dz LEFT JOIN pb USING (symbol)",
        **PBO,
        et=ET.format("co"),
        ob="SELECT symbol, coalesce(stddev_samp(wf_score), 0) AS sd, max(wf_score) AS sr, greatest(max_by(n_trades, wf_score), 2) AS n_obs FROM co GROUP BY 1",
        **_deflated("SELECT * FROM ob JOIN et USING (symbol)"),
    ),
)
def _(t: Tables):
    return O.overfit_summary(_with_oos(t))


# --- grid and exit searches -----------------------------------------------------------------------------------------


def day_windows(t: Tables, bars):
    """Two windows over the sample's month: 14 days in sample, 7 days out of sample, one week apart."""
    e = bars.groupBy("symbol").agg(F.max("time").alias("end")).withColumn("window_id", F.explode(F.array(F.lit(0), F.lit(1))))
    at = lambda days: F.col("end") - F.make_dt_interval(days=(F.col("window_id") * 7 + days).cast("int"))
    return e.select("symbol", "window_id", at(21).alias("is_start"), at(7).alias("is_end"), at(7).alias("oos_start"), at(0).alias("oos_end"))


@query("grid_search")
def _(t: Tables):
    bars = t.bars()
    grid = settle(param_grid(t.spark, {"ema_fast": [3, 5], "ema_slow": [12, 20], "sl": [0.5, 1.0], "rr": [1.5, 2.0]}))
    return rounded(S.grid_search(bars, grid, day_windows(t, bars)))


@query("two_phase_search")
def _(t: Tables):
    bars = t.bars()
    pairs = t.spark.createDataFrame([(3, 12), (5, 20), (6, 18)], "ema_fast int, ema_slow int")
    exits = t.spark.createDataFrame([(0.5, 1.5), (1.0, 2.0)], "sl double, rr double")
    return rounded(S.two_phase(bars, pairs, exits, day_windows(t, bars)))


@query("symbol_screen")
def _(t: Tables):
    bars = t.bars()
    profiles = t.spark.createDataFrame([(1, 3, 12, 1.0, 2.0), (2, 5, 20, 0.5, 3.0)], "param_id int, ema_fast int, ema_slow int, sl double, rr double")
    return rounded(S.screen(bars, profiles, day_windows(t, bars)))


@query(
    "exit_sweep",
    sql(
        """SELECT symbol, CAST(param_id AS INTEGER) AS param_id, target, ch_mult, trades, round(ret, 6) AS ret, round(max_dd, 6) AS max_dd, round(win_rate, 6) AS win_rate, scale_out, chandelier, round(calmar, 6) AS calmar, CAST(k AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(calmar, 9) DESC, param_id) AS k FROM (SELECT *, CASE WHEN max_dd > 0 THEN abs(ret / max_dd) ELSE 0 END AS calmar FROM (
    SELECT symbol, param_id, target, ch_mult, count(*) AS trades, sum(pnl) AS ret, max(greatest(peak, 0) - eq) AS max_dd, avg(CASE WHEN pnl > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate, CAST(sum(scaled) AS BIGINT) AS scale_out, CAST(sum(trailed) AS BIGINT) AS chandelier FROM xo GROUP BY 1, 2, 3, 4))) WHERE k <= 10""",
        **HELD,
        gr="SELECT *, row_number() OVER (ORDER BY target, ch_mult) AS param_id FROM (VALUES (0.35::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) a(target), (VALUES (1.5::DOUBLE), (2.5::DOUBLE), (3.5::DOUBLE)) b(ch_mult)",
        hb="SELECT p.*, g.*, b.rn, b.time AS bar_time, b.high, b.low, b.close, b.atr, 1 AS accel, price_open + sd * abs(price_open - sl) * 2 * target AS lvl FROM ps p, gr g, ab b WHERE b.symbol = p.symbol AND b.rn >= p.start_rn",
        **trailing_sql("symbol, day_no, param_id", "ch_mult", "ch_mult"),
        xs="SELECT symbol, day_no, param_id, min(CASE WHEN breached AND bar_time > time THEN rn END) AS xrn, min(CASE WHEN partial THEN rn END) AS lrn, max(rn) AS ern, max(bar_time) AS et, any_value(time) AS t0 FROM hx GROUP BY 1, 2, 3",
        xr="""SELECT h.symbol, h.day_no, h.param_id, h.target, h.ch_mult, h.sd, h.price_open, h.lvl, h.bar_time AS exit_time, CASE WHEN x.xrn IS NULL THEN h.close ELSE h.stop END AS ex, lrn IS NOT NULL AND (xrn IS NULL OR lrn < xrn) AS sc, xrn IS NOT NULL AS tr
  FROM hx h JOIN xs x ON h.symbol = x.symbol AND h.day_no = x.day_no AND h.param_id = x.param_id AND h.rn = coalesce(x.xrn, x.ern) WHERE x.et > x.t0""",
        xp="SELECT *, CASE WHEN sc THEN 0.5 * (lvl - price_open) * sd + 0.5 * (ex - price_open) * sd ELSE (ex - price_open) * sd END AS pnl, sc::INTEGER AS scaled, tr::INTEGER AS trailed FROM xr",
        xe="SELECT *, sum(pnl) OVER (PARTITION BY symbol, param_id ORDER BY exit_time, day_no ROWS UNBOUNDED PRECEDING) AS eq FROM xp",
        xo="SELECT *, max(eq) OVER (PARTITION BY symbol, param_id ORDER BY exit_time, day_no ROWS UNBOUNDED PRECEDING) AS peak FROM xe",
    ),
)
def _(t: Tables):
    bars, p = held_bars(t)
    grid = settle(param_grid(t.spark, {"target": [0.35, 0.5, 0.75], "ch_mult": [1.5, 2.5, 3.5]}))
    return rounded(S.tune_exits(p, bars, grid))


# --- scoring weights ------------------------------------------------------------------------------------------------

BASELINE = {"volume": 0.5, "close_pos": 0.3, "news": 0.2}


@query("weight_search")
def _(t: Tables):
    return rounded(S.weight_search(scored(t), S.weight_sets(t.spark, COMPONENTS, 40, BASELINE), COMPONENTS))


@query(
    "pick_weights",
    sql(
        """SELECT criterion, weight_id, round(value, 6) AS value FROM (
SELECT 'best_by_IC' AS criterion, weight_id, ic AS value, row_number() OVER (ORDER BY ic DESC, weight_id) AS k FROM rs UNION ALL SELECT 'best_by_combined', weight_id, cmb, row_number() OVER (ORDER BY cmb DESC, weight_id) FROM rs
UNION ALL SELECT 'best_by_win_rate', weight_id, tw, row_number() OVER (ORDER BY tw DESC, weight_id) FROM rs UNION ALL SELECT 'best_by_objective', weight_id, obj, row_number() OVER (ORDER BY obj DESC, weight_id) FROM rs) WHERE k = 1""",
        r0="SELECT l_suppkey AS weight_id, round(avg(l_discount) - 0.05, 4) AS ic, round(avg(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS tw, round(avg(l_tax) - 0.04, 6) AS sp FROM lineitem GROUP BY 1",
        rs="SELECT *, 0.5::DOUBLE * (ic - min(ic) OVER ()) / (max(ic) OVER () - min(ic) OVER ()) + 0.5::DOUBLE * (tw - min(tw) OVER ()) / (max(tw) OVER () - min(tw) OVER ()) AS cmb, 0.4::DOUBLE * ic + 0.3::DOUBLE * tw + 0.3::DOUBLE * greatest(sp, 0) AS obj FROM r0",
    ),
)
def _(t: Tables):
    r = t.read("lineitem").groupBy(F.col("l_suppkey").alias("weight_id")).agg(
        F.round(F.avg("l_discount") - 0.05, 4).alias("IC"), F.round(F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)), 4).alias("top_win_rate"), F.round(F.avg("l_tax") - 0.04, 6).alias("spread_q4_q1"), F.lit("").alias("label"),
    )
    return rounded(S.pick_weights(S.combined_score(r)))


@query("weight_cross_validation")
def _(t: Tables):
    return rounded(S.weight_cv(scored(t), settle(S.weight_sets(t.spark, COMPONENTS, 20, BASELINE)), COMPONENTS, splits=3, top=3))


# --- Monte Carlo ----------------------------------------------------------------------------------------------------


RUIN = {
    "sz": "SELECT symbol, count(*) AS size FROM trades GROUP BY 1",
    "dr": f"SELECT symbol, sim, i, {mix_sql('sim', 'i')} % size + 1 AS pick FROM sz, range(1, 51) a(sim), range(1, 101) b(i)",
    "pa": "SELECT symbol, sim, i, 1000000 + CAST(sum(pnl) OVER (PARTITION BY symbol, sim ORDER BY i ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS equity FROM dr JOIN (SELECT symbol, rn AS pick, pnl FROM numbered) USING (symbol, pick)",
    "pk": "SELECT *, max(equity) OVER (PARTITION BY symbol, sim ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM pa",
    "ph": "SELECT symbol, sim, max((peak - equity) / greatest(peak, 1e-10)) AS dd, last(equity ORDER BY i) AS fin FROM pk GROUP BY 1, 2",
}


@query(
    "bootstrap_ruin",
    sql(
        "SELECT symbol, "
        + ", ".join(f"round(avg(CASE WHEN dd >= {x} THEN 100.0 ELSE 0 END), 6) AS dd_{int(x * 100)}_pct" for x in (0.10, 0.15, 0.20, 0.30))
        + """, round(avg(dd) * 100, 6) AS max_dd_mean, round(avg(CASE WHEN fin > 1000000 THEN 100.0 ELSE 0 END), 6) AS pct_profitable, round(quantile_cont(dd * 100, 0.5), 6) AS max_dd_median, round(quantile_cont(dd * 100, 0.95), 6) AS max_dd_95,
round(quantile_cont(fin, 0.05), 2) AS equity_5, round(quantile_cont(fin, 0.5), 2) AS equity_median, round(quantile_cont(fin, 0.95), 2) AS equity_95 FROM ph GROUP BY 1""",
        **RUIN,
    ),
)
def _(t: Tables):
    out = MC.bootstrap_ruin(t.numbered_trades(), 100, 50, 1000000.0)
    return rounded(out).withColumns({c: F.round(c, 2) for c in ("equity_5", "equity_median", "equity_95")})


def _paths(sims: int) -> dict[str, str]:
    """Every random ordering of a symbol's trades: its final result, drawdown, Sharpe and profit factor."""
    order = "PARTITION BY symbol, sim ORDER BY h, rn"
    return {
        "sh_dr": f"SELECT symbol, rn, pnl, CAST(sim AS INTEGER) AS sim, {mix_sql('sim', 'rn')} AS h FROM numbered, range(1, {sims + 1}) a(sim)",
        "sh_eq": f"SELECT *, sum(pnl) OVER ({order} ROWS UNBOUNDED PRECEDING) AS equity FROM sh_dr",
        "sh_rt": f"SELECT *, max(equity) OVER ({order} ROWS UNBOUNDED PRECEDING) AS peak, CAST(lag(equity) OVER ({order}) AS DOUBLE) AS prev FROM sh_eq",
        "sh_gr": """SELECT symbol, sim, CAST(sum(pnl) AS DOUBLE) AS final_pnl, CAST(max(peak - equity) AS DOUBLE) AS max_dd, coalesce(CAST(sum(pnl) FILTER (pnl > 0) AS DOUBLE), 0) AS gain,
  coalesce(CAST(abs(sum(pnl) FILTER (pnl < 0)) AS DOUBLE), 0) AS loss, avg((CAST(equity AS DOUBLE) - prev) / (abs(prev) + 1e-10)) AS m, stddev_pop((CAST(equity AS DOUBLE) - prev) / (abs(prev) + 1e-10)) AS s FROM sh_rt GROUP BY 1, 2""",
        "paths": "SELECT symbol, sim, final_pnl, max_dd, CASE WHEN s > 0 THEN m / (s + 1e-10) * sqrt(252) ELSE 0 END AS sharpe, CASE WHEN loss > 0 THEN gain / loss ELSE 999 END AS pf FROM sh_gr",
    }


@query(
    "reshuffled_paths",
    sql(
        "SELECT symbol, sim, final_pnl, max_dd, round(sharpe, 6) AS sharpe, round(pf, 6) AS pf FROM paths",
        **_paths(5),
    ),
)
def _(t: Tables):
    return rounded(MC.reshuffle(t.numbered_trades(keep=("symbol", "rn", "pnl")), 5))


@query(
    "monte_carlo_report",
    sql(
        """SELECT symbol, round(return_5, 2) AS return_5, round(return_median, 2) AS return_median, round(return_95, 2) AS return_95, round(dd_median, 2) AS dd_median, round(dd_95, 2) AS dd_95, round(sharpe_5, 4) AS sharpe_5,
  round(sharpe_median, 4) AS sharpe_median, round(sharpe_95, 4) AS sharpe_95, round(pf_median, 4) AS pf_median, n_trades, round(sharpe_rank, 4) AS sharpe_rank, round(pct_profitable_paths, 4) AS pct_profitable_paths,
  round(pct_profitable_bootstrap, 4) AS pct_profitable_bootstrap, round(dd_ratio_95, 4) AS dd_ratio_95, sharpe_rank >= 90 AS ok_sharpe_rank, pct_profitable_paths >= 80 AS ok_profitable, dd_ratio_95 <= 2.5 AS ok_drawdown, n_trades >= 20 AS ok_trades,
  sharpe_rank >= 90 AND pct_profitable_paths >= 80 AND dd_ratio_95 <= 2.5 AND n_trades >= 20 AS robust FROM mc_all""",
        **_paths(8),
        **_curve(BASE),
        mc_own="SELECT symbol, count(*) AS n_trades, CAST(max(peak - equity) AS DOUBLE) AS own_dd FROM curve GROUP BY 1",
        mc_sh="""SELECT symbol, CASE WHEN stddev_pop(d) > 0 THEN avg(d) / stddev_pop(d) * sqrt(252) ELSE 0 END AS own_sharpe FROM (SELECT symbol, CASE WHEN (rn - 1) % 6 = 0 THEN CAST(equity - lag(equity, 6) OVER (PARTITION BY symbol ORDER BY rn) AS DOUBLE) END AS d FROM curve) GROUP BY symbol""",
        mc_size="SELECT symbol, count(*) AS size FROM trades GROUP BY 1",
        mc_pick=f"SELECT symbol, sim, {mix_sql('sim', 'rn', seed=43)} % size + 1 AS pick FROM numbered JOIN mc_size USING (symbol), range(1, 5) a(sim)",
        mc_boot="SELECT symbol, avg(CASE WHEN total > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct_profitable_bootstrap FROM (SELECT symbol, sim, sum(pnl) AS total FROM mc_pick JOIN (SELECT symbol, rn AS pick, pnl FROM numbered) USING (symbol, pick) GROUP BY 1, 2) GROUP BY 1",
        mc_q="""SELECT symbol, quantile_cont(final_pnl, 0.05) AS return_5, quantile_cont(final_pnl, 0.5) AS return_median, quantile_cont(final_pnl, 0.95) AS return_95, quantile_cont(max_dd, 0.5) AS dd_median, quantile_cont(max_dd, 0.95) AS dd_95,
  quantile_cont(sharpe, 0.05) AS sharpe_5, quantile_cont(sharpe, 0.5) AS sharpe_median, quantile_cont(sharpe, 0.95) AS sharpe_95, quantile_cont(pf, 0.5) AS pf_median, avg(CASE WHEN sharpe <= own_sharpe THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS sharpe_rank,
  avg(CASE WHEN final_pnl > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct_profitable_paths FROM paths JOIN mc_sh USING (symbol) GROUP BY 1""",
        mc_all="SELECT *, dd_95 / (abs(own_dd) + 1e-10) AS dd_ratio_95 FROM mc_q JOIN mc_own USING (symbol) JOIN mc_boot USING (symbol)",
    ),
)
def _(t: Tables):
    n = t.numbered_trades(keep=("symbol", "rn", "pnl"))
    out = rounded(MC.mc_report(n, X.trade_metrics(n, 1000000.0), 8), 4)
    return out.withColumns({c: F.round(c, 2) for c in ("return_5", "return_median", "return_95", "dd_median", "dd_95")})
