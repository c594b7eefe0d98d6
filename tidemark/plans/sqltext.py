"""SQL text for the recursive indicators, as used by the checking queries."""

from __future__ import annotations

import math

from tidemark.functions import numbers as M
from tidemark.plans.views import rec_cte

FAST, SLOW = "(2.0::DOUBLE / 3.0)", "(2.0::DOUBLE / 31.0)"
W = "PARTITION BY symbol ORDER BY rn"


def over(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


STEPS = f"""SELECT *, close - lag(close) OVER ({W}) AS step,
  greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr,
  high - lag(high) OVER ({W}) AS upm, lag(low) OVER ({W}) - low AS dnm FROM bars"""
MOVES = """SELECT *, CASE WHEN upm > dnm AND upm > 0 THEN upm ELSE 0 END AS dmp, CASE WHEN dnm > upm AND dnm > 0 THEN dnm ELSE 0 END AS dmm,
  CASE WHEN rn = 1 THEN 0 ELSE tr END AS tr0, greatest(step, 0) AS gain, greatest(-step, 0) AS loss FROM steps"""


class Scan:
    """Collects the window columns and the state columns of one walk over the bars."""

    def __init__(self, view: str = "bars"):
        self.view, self.cols, self.init, self.step = view, {}, {}, {}

    def ewm(self, name, x, alpha):
        self.init[name] = f"b.{x}"
        self.step[name] = f"b.{x} * {alpha} + p.{name} * (1 - {alpha})"
        return self

    def ema(self, name, n, x="close"):
        return self.ewm(name, x, f"(2.0::DOUBLE / {n + 1})")

    def wilder(self, name, x, n):
        return self.ewm(name, x, f"(1.0::DOUBLE / {n})")

    def seeded(self, name, x, n, seed_row, seed, early="NULL"):
        """Wilder smoothing of x from `seed_row` on."""
        self.cols[f"seed_{name}"] = seed
        self.init[name] = f"CASE WHEN {seed_row} = 1 THEN b.seed_{name} ELSE {early.replace('@', 'b.')} END"
        self.step[name] = (
            f"CASE WHEN b.rn < {seed_row} THEN {early.replace('@', 'b.')} WHEN b.rn = {seed_row} THEN b.seed_{name} ELSE (p.{name} * {n - 1} + b.{x}) / {n} END"
        )
        return self

    def kama(self, name, n):
        er = f"CASE WHEN sum(abs(step)) {over(n)} > 0 THEN abs(close - lag(close, {n}) OVER ({W})) / sum(abs(step)) {over(n)} ELSE 0 END"
        self.cols[f"sc_{name}"] = f"pow(({er}) * ({FAST} - {SLOW}) + {SLOW}, 2)"
        self.init[name] = "b.close" if n == 1 else "NULL"
        self.step[name] = f"CASE WHEN b.rn < {n} THEN NULL WHEN b.rn = {n} THEN b.close ELSE p.{name} + b.sc_{name} * (b.close - p.{name}) END"
        return self

    def vidya(self, name, n):
        g, l = f"sum(gain) {over(n)}", f"sum(loss) {over(n)}"
        self.cols[f"sc_{name}"] = f"pow((CASE WHEN {g} + {l} = 0 THEN 0 ELSE abs({g} - {l}) / ({g} + {l}) END) * ({FAST} - {SLOW}) + {SLOW}, 2)"
        self.cols[f"m_{name}"] = f"avg(close) {over(n + 1)}"
        self.init[name] = "NULL"
        self.step[name] = f"CASE WHEN b.rn <= {n} THEN NULL WHEN b.rn = {n + 1} THEN b.m_{name} ELSE p.{name} + b.sc_{name} * (b.close - p.{name}) END"
        return self

    def atr_series(self, name, n):
        return self.seeded(name, "tr", n, n, f"avg(tr) {over(n)}")

    def atr_ml(self, name, n):
        return self.seeded(name, "tr", n, n + 1, f"avg(tr) {over(n)}", "0")

    def rsi(self, name, n):
        self.seeded(f"{name}_g", "gain", n, n + 1, f"avg(gain) {over(n)}")
        return self.seeded(f"{name}_l", "loss", n, n + 1, f"avg(loss) {over(n)}")

    def adx_ewm(self, n=14):
        """States trs, ps, ms, adx: the directional values of a row come from that row's smoothed sums."""
        al = f"(1.0::DOUBLE / {n})"
        new = {k: f"(b.{x} * {al} + p.{k} * (1 - {al}))" for k, x in (("trs", "tr"), ("ps", "dmp"), ("ms", "dmm"))}
        dx = lambda t, p, m: f"(100 * abs(100 * {p} / greatest({t}, 1e-10) - 100 * {m} / greatest({t}, 1e-10)) / greatest(100 * {p} / greatest({t}, 1e-10) + 100 * {m} / greatest({t}, 1e-10), 1e-10))"
        self.init |= {"trs": "b.tr", "ps": "b.dmp", "ms": "b.dmm", "adx": dx("b.tr", "b.dmp", "b.dmm")}
        self.step |= new | {"adx": f"{dx(new['trs'], new['ps'], new['ms'])} * {al} + p.adx * (1 - {al})"}
        return self

    def adx_seeded(self, n=14):
        """States of the mean-seeded form; `acc` sums the first n directional values, `early` is the exponential fill."""
        al = f"(1.0::DOUBLE / {n})"
        new = {}
        for k, x in (("str", "tr0"), ("sps", "dmp"), ("sms", "dmm")):
            self.cols[f"seed_{k}"] = f"avg({x}) OVER ({W} ROWS BETWEEN {n - 2} PRECEDING AND 1 FOLLOWING)"
            new[k] = f"(CASE WHEN b.rn < {n} THEN b.{x} WHEN b.rn = {n} THEN b.seed_{k} ELSE (p.{k} * {n - 1} + b.{x}) / {n} END)"
            self.init[k] = f"b.{x}"

        def dx(t, p, m):
            tt = f"(CASE WHEN {t} = 0 THEN 1e-10 ELSE {t} END)"
            return f"(CASE WHEN 100 * {p} / {tt} + 100 * {m} / {tt} > 0 THEN 100 * abs(100 * {p} / {tt} - 100 * {m} / {tt}) / (100 * {p} / {tt} + 100 * {m} / {tt}) ELSE 0 END)"

        d0, d = dx("b.tr0", "b.dmp", "b.dmm"), dx(new["str"], new["sps"], new["sms"])
        self.init |= {"acc": d0, "early": d0, "sadx": d0}
        early = f"({d} * {al} + p.early * (1 - {al}))"
        self.step |= new | {
            "acc": f"p.acc + {d}",
            "early": early,
            "sadx": f"CASE WHEN b.rn < {n} THEN {early} WHEN b.rn = {n} THEN (p.acc + {d}) / {n} ELSE (p.sadx * {n - 1} + {d}) / {n} END",
        }
        return self

    def ctes(self, name="r") -> dict[str, str]:
        """`name` holds the states, `name_ind` the bars with them."""
        cols = "".join(f", {e} AS {n}" for n, e in self.cols.items())
        state = ", ".join(self.init)
        return {
            f"{name}_steps": STEPS.replace("FROM bars", f"FROM {self.view}"),
            f"{name}_moves": MOVES.replace("FROM steps", f"FROM {name}_steps"),
            f"{name}_wide": f"SELECT *{cols} FROM {name}_moves",
            **rec_cte(name, f"{name}_wide", self.init, self.step),
            f"{name}_ind": f"SELECT v.*, {state} FROM {self.view} v JOIN {name} USING (symbol, rn)",
        }


def erfc_sql(x: str) -> str:
    """Complementary error function of the column `x` (not an expression: it is named often)."""

    def horner(cs, v):
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {v} + {c!r}::DOUBLE)"
        return out

    y, z, a = f"({x} * {x})", f"(1 / ({x} * {x}))", f"abs({x})"
    near = f"1 - {x} * ({horner(M.ERF_NEAR_A, y)} / {horner(M.ERF_NEAR_B, y)})"
    far = f"({1 / math.sqrt(math.pi)!r}::DOUBLE - {z} * ({horner(M.ERF_FAR_P, z)} / {horner(M.ERF_FAR_Q, z)})) / {a}"
    tail = f"exp(-{y}) * CASE WHEN {a} <= 4 THEN {horner(M.ERF_MID_C, a)} / {horner(M.ERF_MID_D, a)} ELSE {far} END"
    return f"(CASE WHEN {a} <= 0.46875 THEN {near} WHEN {x} > 30 THEN 0 WHEN {x} < -30 THEN 2 WHEN {x} < 0 THEN 2 - {tail} ELSE {tail} END)"
