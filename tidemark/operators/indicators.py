"""Recursive indicators as affine scans.

Every indicator is split into window columns (``rolling``) that give the coefficients of ``y[t] = a*y[t-1] + b`` and
one ``affine_scan`` that runs all requested recursions of a stage together. Seeds are rows with ``a = 0``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY, safe_div
from tidemark.operators.chunks import affine_scan, rolling
from tidemark.operators.windows import last_rows
from tidemark.session import settle

FAST, SLOW = 2.0 / 3.0, 2.0 / 31.0

# A part adds its coefficient columns __a_<name> and __b_<name>; `back` / `ahead` say how far its frames reach.
Part = tuple[str, int, int, Callable[[DataFrame, WindowSpec], tuple[DataFrame, Column, Column]]]


def scan_parts(df: DataFrame, parts: Sequence[Part], by: Sequence[str] = ("symbol",), rows: int | None = None) -> DataFrame:
    def build(d, w):
        for name, _, _, make in parts:
            d, a, b = make(d, w)
            d = d.withColumn(f"__pa_{name}", a).withColumn(f"__pb_{name}", b)
        return d

    staged = rolling(df, build, back=max(p[1] for p in parts), ahead=max(p[2] for p in parts), by=by, rows=rows, keep_chunk=True)
    names = [p[0] for p in parts]
    keep = [*df.columns, "chunk", *[f"__pa_{n}" for n in names], *[f"__pb_{n}" for n in names]]
    scanned = affine_scan(staged.select(*keep), {n: (F.col(f"__pa_{n}"), F.col(f"__pb_{n}")) for n in names}, by, rows)
    return scanned.select(*[c for c in df.columns if c not in names], *names)


def _step(d: DataFrame, w: WindowSpec, x: str) -> tuple[DataFrame, str]:
    name = f"__step_{x}"
    return (d if name in d.columns else d.withColumn(name, F.col(x) - F.lag(x).over(w))), name


def ewm_part(name: str, x: str, alpha: float) -> Part:
    """Exponential mean seeded with the first value."""

    def make(d, w):
        first = F.col("rn") == 1
        return d, F.when(first, 0.0).otherwise(1 - alpha), F.when(first, F.col(x)).otherwise(F.col(x) * alpha)

    return (name, 0, 0, make)


def ema_part(name: str, n: int, x: str = "close") -> Part:
    return ewm_part(name, x, 2.0 / (n + 1))


def wilder_part(name: str, x: str, n: int) -> Part:
    return ewm_part(name, x, 1.0 / n)


def _smooth(er: Column) -> Column:
    s = er * (FAST - SLOW) + SLOW
    return s * s


def kama_part(name: str, n: int, x: str = "close", first_row: int = 1) -> Part:
    """Adaptive mean seeded with the n-th value; `first_row` is the row of the first known value of x."""

    def make(d, w):
        d, step = _step(d, w, x)
        path = F.sum(F.abs(F.col(step))).over(last_rows(w, n))
        net = F.abs(F.col(x) - F.lag(x, n).over(w))
        sc = _smooth(F.when(path > 0, net / path).otherwise(0.0))
        seed = first_row + n - 1
        a = F.when(F.col("rn") > seed, 1 - sc).otherwise(0.0)
        b = F.when(F.col("rn") > seed, sc * F.col(x)).when(F.col("rn") == seed, F.col(x))
        return d, a, b

    return (name, n + 1, 0, make)


def vidya_part(name: str, n: int, x: str = "close") -> Part:
    """Adaptive mean driven by the absolute momentum oscillator, seeded with the mean of the first n + 1 values."""

    def make(d, w):
        d, step = _step(d, w, x)
        f = last_rows(w, n)
        up = F.sum(F.greatest(F.col(step), F.lit(0.0))).over(f)
        down = F.sum(F.greatest(-F.col(step), F.lit(0.0))).over(f)
        cmo = F.when(up + down == 0, 0.0).otherwise(F.abs(up - down) / (up + down))
        sc = _smooth(cmo)
        seed = n + 1
        a = F.when(F.col("rn") > seed, 1 - sc).otherwise(0.0)
        b = F.when(F.col("rn") > seed, sc * F.col(x)).when(F.col("rn") == seed, F.avg(x).over(last_rows(w, n + 1)))
        return d, a, b

    return (name, n + 1, 0, make)


def ma_part(name: str, n: int, kind: str = "kama") -> Part:
    """Moving average by kind; an unknown kind is an EMA."""
    return {"kama": kama_part, "vidya": vidya_part}.get(kind, ema_part)(name, n)


def _tr(d: DataFrame, w: WindowSpec) -> DataFrame:
    if "__tr" in d.columns:
        return d
    prev = F.lag("close").over(w)
    return d.withColumn("__tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def _wilder_from(seed_row: int, n: int, x: Column, seed: Column, early: Column | None = None) -> tuple[Column, Column]:
    a = F.when(F.col("rn") > seed_row, (n - 1) / n).otherwise(0.0)
    b = F.when(F.col("rn") > seed_row, x / n).when(F.col("rn") == seed_row, seed)
    return a, b if early is None else b.otherwise(early)


def atr_series_part(name: str, n: int) -> Part:
    """Mean of the first n true ranges (the first bar's is high - low), then Wilder smoothing."""

    def make(d, w):
        d = _tr(d, w)
        a, b = _wilder_from(n, n, F.col("__tr"), F.avg("__tr").over(last_rows(w, n)))
        return d, a, b

    return (name, n, 0, make)


def atr_ml_part(name: str, n: int) -> Part:
    """Mean of the n true ranges after the first bar, then Wilder smoothing; 0 before."""

    def make(d, w):
        d = _tr(d, w)
        a, b = _wilder_from(n + 1, n, F.col("__tr"), F.avg("__tr").over(last_rows(w, n)), F.lit(0.0))
        return d, a, b

    return (name, n, 0, make)


def atr_ewm_part(name: str, n: int) -> Part:
    def make(d, w):
        d = _tr(d, w)
        first = F.col("rn") == 1
        return d, F.when(first, 0.0).otherwise(1 - 1.0 / n), F.when(first, F.col("__tr")).otherwise(F.col("__tr") / n)

    return (name, 1, 0, make)


def rsi_parts(name: str, n: int, x: str = "close") -> list[Part]:
    """Wilder means of gains and losses, seeded with their plain means over the first n changes."""

    def side(sign: int):
        def make(d, w):
            d, step = _step(d, w, x)
            v = F.greatest(sign * F.col(step), F.lit(0.0))
            col = f"__{'up' if sign > 0 else 'dn'}_{x}"
            d = d if col in d.columns else d.withColumn(col, v)
            a, b = _wilder_from(n + 1, n, F.col(col), F.avg(col).over(last_rows(w, n)))
            return d, a, b

        return make

    return [(f"__gain_{name}", n + 1, 0, side(1)), (f"__loss_{name}", n + 1, 0, side(-1))]


def finish_rsi(df: DataFrame, name: str, fill: float | None = None) -> DataFrame:
    g, l = F.col(f"__gain_{name}"), F.col(f"__loss_{name}")
    value = F.when(l == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + g / l))
    value = value if fill is None else F.coalesce(value, F.lit(float(fill)))
    return df.withColumn(name, value).drop(f"__gain_{name}", f"__loss_{name}")


def rsi(df: DataFrame, n: int = 14, fill: float | None = None, name: str = "rsi", rows: int | None = None) -> DataFrame:
    return finish_rsi(scan_parts(df, rsi_parts(name, n), rows=rows), name, fill)


def rsi_bounded(df: DataFrame, n: int = 14, name: str = "rsi_bounded", rows: int | None = None) -> DataFrame:
    """RSI from the last n + 31 bars only: plain means of the n changes before the newest, then n Wilder steps.

    50 before enough history and on a zero loss. The recursion over a bounded array needs no scan.
    """

    def build(d, w):
        d, step = _step(d, w, "close")
        d = d.withColumn("__changes", F.collect_list(F.col(step)).over(last_rows(w, n + 1)))

        def side(sign: int) -> Column:
            v = F.transform("__changes", lambda c: F.greatest(sign * c, F.lit(0.0)))
            seed = F.aggregate(F.slice(v, 1, n), F.lit(0.0), lambda acc, c: acc + c) / n
            return F.aggregate(F.slice(v, 2, n), seed, lambda acc, c: (acc * (n - 1) + c) / n)

        value = F.when(side(-1) <= 0, 50.0).otherwise(100.0 - 100.0 / (1.0 + side(1) / side(-1)))
        return d.withColumn(name, F.when(F.col("rn") > n + 30, value).otherwise(50.0)).drop(step, "__changes")

    return rolling(df, build, back=n + 2, rows=rows)


def _dm(d: DataFrame, w: WindowSpec) -> DataFrame:
    if "__dmp" in d.columns:
        return d
    d = _tr(d, w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    d = d.withColumn("__upm", up).withColumn("__dnm", down)
    return (
        d.withColumn("__dmp", F.when((F.col("__upm") > F.col("__dnm")) & (F.col("__upm") > 0), F.col("__upm")).otherwise(0.0))
        .withColumn("__dmm", F.when((F.col("__dnm") > F.col("__upm")) & (F.col("__dnm") > 0), F.col("__dnm")).otherwise(0.0))
        .withColumn("__tr0", F.when(F.col("rn") == 1, 0.0).otherwise(F.col("__tr")))
    )


def adx_ewm(df: DataFrame, n: int = 14, name: str = "adx", di: bool = True, by: Sequence[str] = ("symbol",), rows: int | None = None) -> DataFrame:
    """ADX with +DI / -DI in the purely exponential form."""

    def part(out: str, col: str) -> Part:
        def make(d, w):
            d = _dm(d, w)
            first = F.col("rn") == 1
            return d, F.when(first, 0.0).otherwise(1 - 1.0 / n), F.when(first, F.col(col)).otherwise(F.col(col) / n)

        return (out, 1, 0, make)

    s = scan_parts(df, [part("__trs", "__tr"), part("__ps", "__dmp"), part("__ms", "__dmm")], by, rows)
    s = s.withColumn(f"{name}_plus", 100 * safe_div("__ps", "__trs")).withColumn(f"{name}_minus", 100 * safe_div("__ms", "__trs"))
    p, m = F.col(f"{name}_plus"), F.col(f"{name}_minus")
    s = settle(s.withColumn("__dx", 100 * safe_div(F.abs(p - m), p + m)).drop("__trs", "__ps", "__ms"))
    out = scan_parts(s, [wilder_part(name, "__dx", n)], by, rows).drop("__dx")
    return out if di else out.drop(f"{name}_plus", f"{name}_minus")


def adx(df: DataFrame, n: int = 14, name: str = "adx", rows: int | None = None) -> DataFrame:
    """ADX with mean-seeded Wilder smoothing; the early bars are filled by the exponential form.

    The mean of the first n true ranges and moves starts at the second bar, so the seed at row n looks one bar ahead.
    """

    def part(out: str, col: str) -> Part:
        def make(d, w):
            d = _dm(d, w)
            a, b = _wilder_from(n, n, F.col(col), F.avg(col).over(w.rowsBetween(-(n - 2), 1)), F.col(col))
            return d, a, b

        return (out, n, 1, make)

    s = scan_parts(df, [part("__trs", "__tr0"), part("__ps", "__dmp"), part("__ms", "__dmm")], rows=rows)
    tr = F.when(F.col("__trs") == 0, TINY).otherwise(F.col("__trs"))
    s = s.withColumn("__p", 100 * F.col("__ps") / tr).withColumn("__m", 100 * F.col("__ms") / tr)
    total = F.col("__p") + F.col("__m")
    s = settle(s.withColumn("__dx", F.when(total > 0, 100 * F.abs(F.col("__p") - F.col("__m")) / total).otherwise(0.0)).drop("__trs", "__ps", "__ms", "__p", "__m"))

    def main(d, w):
        a, b = _wilder_from(n, n, F.col("__dx"), F.avg("__dx").over(last_rows(w, n)))
        return d, a, b

    out = scan_parts(s, [("__main", n, 0, main), wilder_part("__early", "__dx", n)], rows=rows)
    return out.withColumn(name, F.coalesce("__main", "__early")).drop("__main", "__early", "__dx")


def macd_kama(df: DataFrame, compat: bool = False, rows: int | None = None) -> DataFrame:
    """KAMA(12) - KAMA(26), its KAMA(9) signal and the histogram, over the close.

    The signal is seeded at the ninth known value of the line; ``compat`` leaves signal and histogram null, as a seed
    inside the line's null prefix would.
    """
    s = scan_parts(df, [kama_part("__k12", 12), kama_part("__k26", 26)], rows=rows)
    s = s.withColumn("__line", F.col("__k12") - F.col("__k26")).drop("__k12", "__k26")
    if compat:
        s = s.withColumn("__sig", F.lit(None).cast("double"))
    else:
        s = scan_parts(settle(s), [kama_part("__sig", 9, "__line", first_row=26)], rows=rows)
    return s.withColumns({
        "macd": safe_div("__line", "close"), "macd_signal": safe_div("__sig", "close"), "macd_hist": safe_div(F.col("__line") - F.col("__sig"), "close"),
    }).drop("__line", "__sig")


def kama_features(df: DataFrame, periods: Sequence[int] = (4, 9, 21, 50, 100, 200), slope: int = 5, rows: int | None = None) -> DataFrame:
    """Close over KAMA for each period, the 9-21 difference and the slope of KAMA(9)."""
    s = scan_parts(df, [kama_part(f"__k{n}", n) for n in periods], rows=rows)
    s = s.withColumns({f"kama{n}_ratio": F.when(F.col(f"__k{n}").isNotNull(), safe_div("close", f"__k{n}")) for n in periods})
    s = s.withColumn("kama9_21_diff", safe_div(F.col("__k9") - F.col("__k21"), "close"))

    def build(d, w):
        old = F.lag("__k9", slope).over(w)
        return d.withColumn("kama_slope_5", F.when(old.isNotNull(), (F.col("__k9") - old) / F.greatest(old, F.lit(TINY))))

    return rolling(s, build, back=slope, rows=rows).drop(*[f"__k{n}" for n in periods])


def atr_features(df: DataFrame, rows: int | None = None) -> DataFrame:
    """ATR ratios (14 over close, 5 over 14, 14 over 50) and the bar range in ATRs; keeps `atr_14`."""
    s = scan_parts(df, [atr_ml_part("atr_14", 14), atr_ml_part("__a5", 5), atr_ml_part("__a50", 50)], rows=rows)
    return s.withColumns({
        "atr_ratio": safe_div("atr_14", "close"), "atr_ratio_5_14": safe_div("__a5", "atr_14"), "atr_ratio_14_50": safe_div("atr_14", "__a50"),
        "hl_range_ratio": safe_div(F.col("high") - F.col("low"), "atr_14"),
    }).drop("__a5", "__a50")
