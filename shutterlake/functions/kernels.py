"""Array kernels on pixel rows and planes: histograms, blurs, curves, look-up tables. Values are doubles in 0..1 unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of red, green and blue in luma.
LUMA = (0.2126, 0.7152, 0.0722)
# Middle grey; the exponent of perceived brightness; how far from white and black the tone windows reach (at amount 0, and what amount 1
# adds, in proportion to its square), and how strong they are; the pivot, stretch and share of the contrast given back to lifted blacks.
PIVOT, PERCEIVED = 0.18, 2.2
HIGHLIGHTS, BLACKS = (0.20, 0.55, 0.15), (0.12, 0.36, 0.072)
BLACKS_CONTRAST = (0.20, 1.3, 0.85)
_DOUBLES = T.ArrayType(T.DoubleType())


def bin86(v: Column) -> Column:
    """Bin of an 8-bit value: 0 alone, then 85 triples."""
    return F.when(v == 0, 0).otherwise(F.floor((v - 1) / F.lit(3)) + 1).cast("int")


def histogram(pixels: DataFrame, r: str, g: str, b: str) -> DataFrame:
    """(channel, bin, height, share) of 8-bit pixels: red, green, blue and luma in 86 bins.

    Bin 0 is the value 0 alone; the others are the means of three values, so all bins are as high a value. ``share`` is the height over
    the highest of red, green and blue. Only bins that occur have a row; null channels are no pixels.
    """
    y = F.floor((2126 * F.col(r) + 7152 * F.col(g) + 722 * F.col(b) + 5000) / F.lit(10000)).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), c.cast("int").alias("v")) for n, c in (("r", F.col(r)), ("g", F.col(g)), ("b", F.col(b)), ("luma", y))]))
    counts = pixels.where(F.col(r).isNotNull() & F.col(g).isNotNull() & F.col(b).isNotNull()).select(each.alias("c")).groupBy("c.channel", "c.v").agg(F.count(F.lit(1)).alias("n"))
    bins = counts.groupBy("channel", bin86(F.col("v")).alias("bin")).agg(F.sum(F.when(F.col("v") == 0, F.col("n").cast("double")).otherwise(F.col("n") / 3)).alias("h"))
    # At most 4 x 86 rows are left here.
    top = bins.agg(F.max(F.when(F.col("channel") != "luma", F.col("h"))).alias("top")).withColumn("__one", F.lit(1))
    return bins.withColumn("__one", F.lit(1)).join(F.broadcast(top), "__one").select("channel", "bin", F.round("h", 6).alias("height"), F.round(F.col("h") / F.col("top"), 6).alias("share"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def exposure(v: Column, stops: float, gain: float = 1.0) -> Column:
    return v * F.lit(2.0**stops * gain)


def contrast(v: Column, amount: float, pivot: float = PIVOT) -> Column:
    """Powers of 2**amount below and above the pivot, which stays, as do 0 and 1 and what lies beyond."""
    k = F.lit(2.0**amount)
    low = pivot * F.pow(v / pivot, k)
    high = 1.0 - (1.0 - pivot) * F.pow((1.0 - v) / (1.0 - pivot), k)
    return F.when((v <= 0) | (v >= 1), v).when(v <= pivot, low).otherwise(high)


def _window(u: Column) -> Column:
    return F.pow(F.sin(F.lit(np.pi) * u), F.lit(2.0))


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def highlights(v: Column, amount: float) -> Column:
    """Bright values moved by a smooth window of perceived brightness that reaches further down the larger the amount; 1 stays."""
    base, more, gain = HIGHLIGHTS
    floor = 1.0 - (base + more * amount**2)
    t = F.pow(v, F.lit(1 / PERCEIVED))
    moved = F.pow(_unit(t + amount * gain * _window((t - floor) / (1.0 - floor))), F.lit(PERCEIVED))
    return F.when((v <= 0) | (v >= 1), v).when(t <= floor, v).otherwise(moved)


def blacks(v: Column, amount: float) -> Column:
    """Dark values moved likewise; 0 stays. What is lifted gets some of its contrast back."""
    base, more, gain = BLACKS
    pivot, stretch, mix = BLACKS_CONTRAST
    ceiling = base + more * amount**2
    t = F.pow(v, F.lit(1 / PERCEIVED))
    lift = amount * gain * _window(t / ceiling)
    moved = _unit(t + lift)
    if amount > 0:
        moved = moved + mix * ((moved - pivot) * (1.0 + stretch * lift) + pivot - moved)
    return F.when((v <= 0) | (v > 1), v).when(t >= ceiling, v).otherwise(F.pow(_unit(moved), F.lit(PERCEIVED)))


def saturate(c: Column, y: Column, amount: float) -> Column:
    """A channel moved away from the luma, or with a negative amount towards it, -1 to grey."""
    return y + (c - y) * F.lit(max(0.0, 1.0 + amount))


def vibrance(c: Column, y: Column, largest: Column, least: Column, amount: float) -> Column:
    """As ``saturate``, the more the less saturated a colour is, by its largest and least channel."""
    now = F.when(largest > 1e-6, _unit((largest - least) / largest)).otherwise(0.0)
    return y + (c - y) * F.greatest(F.lit(0.0), 1.0 + amount * (1.0 - now))


def soft_saturate(v: Column, limit: float) -> Column:
    """Values up to ``limit`` in size stay, what is beyond is pressed smoothly, to at most twice the limit."""
    beyond = F.abs(v) - limit
    return F.when(beyond <= 0, v).otherwise(F.signum(v) * (limit + beyond / (1.0 + beyond / limit)))


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.lit(1.055) * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def kelvin_xy(kelvin: Column) -> tuple[Column, Column]:
    """Chromaticity of daylight of a colour temperature between 4,000 and 25,000 K (clamped)."""
    # The polynomials of the standard daylight locus.
    t = F.greatest(F.lit(4000.0), F.least(F.lit(25000.0), kelvin.cast("double")))
    cold, warm = (0.237040, 0.24748e3, 1.9018e6, -2.0064e9), (0.244063, 0.09911e3, 2.9678e6, -4.6070e9)
    poly = lambda k: F.lit(k[0]) + F.lit(k[1]) / t + F.lit(k[2]) / F.pow(t, F.lit(2)) + F.lit(k[3]) / F.pow(t, F.lit(3))
    x = F.when(t <= 7000, poly(warm)).otherwise(poly(cold))
    return x, -3.0 * x * x + 2.870 * x - 0.275


def inverse_3x3(m: list[list[float]]) -> list[list[float]]:
    """The inverse of a colour matrix; raises if it has none."""
    a = np.array(m, dtype=float)
    if a.shape != (3, 3) or abs(np.linalg.det(a)) < 1e-12:
        raise ValueError("no inverse")
    return np.linalg.inv(a).tolist()


def matrix_product(m: list[list[float]], rgb: list[Column]) -> list[Column]:
    return [sum((F.lit(float(w)) * c for w, c in zip(row[1:], rgb[1:])), F.lit(float(row[0])) * rgb[0]) for row in m]


def box_blur(row: Column, radius: int) -> Column:
    """Mean over [i-r, i+r] cut at the ends, of an array: a window that slides by differences of running sums, so the radius costs nothing."""
    n = F.size(row)
    grow = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x.cast("double")))
    sums = F.aggregate(row, F.array(F.lit(0.0)), grow)

    def mean(i: Column, upto: Column) -> Column:
        lo, hi = F.greatest(i - radius, F.lit(0)), F.least(i + radius, n - 1)
        return (F.get(upto, hi + 1) - F.get(upto, lo)) / (hi - lo + 1)

    # The sums are made once a row: they are the only element of the outer array.
    blurred = F.transform(F.array(sums), lambda upto: F.transform(F.sequence(F.lit(0), n - 1), lambda i: mean(i, upto)))
    return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.get(blurred, F.lit(0)))


def box_down(row: Column, by: int) -> Column:
    """Means of consecutive groups of ``by``; a short last group is averaged over what it has."""
    k = F.ceil(F.size(row) / F.lit(by)).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)
    return F.when(k == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: mean(F.slice(row, i * by + 1, by))))


def monotone_curve(points: list[tuple[float, float]]) -> Callable[[np.ndarray], np.ndarray]:
    """A cubic through the points that doesn't overshoot (mean slopes, limited so that each piece is monotone), flat beyond the ends."""
    x, y = (np.array(v, dtype=float) for v in zip(*sorted(points)))
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.concatenate([d[:1], (d[:-1] + d[1:]) / 2, d[-1:]])
    for i, s in enumerate(d):
        if s == 0:
            m[i] = m[i + 1] = 0
        else:
            a, b = m[i] / s, m[i + 1] / s
            if a < 0 or b < 0:
                m[i], m[i + 1] = (0 if a < 0 else m[i]), (0 if b < 0 else m[i + 1])
            elif (r := a * a + b * b) > 9:
                m[i], m[i + 1] = 3 / r**0.5 * a * s, 3 / r**0.5 * b * s

    def at(v: np.ndarray) -> np.ndarray:
        v = np.clip(np.asarray(v, dtype=float), x[0], x[-1])
        k = np.clip(np.searchsorted(x, v, side="right") - 1, 0, len(h) - 1)
        t = (v - x[k]) / h[k]
        return y[k] * (1 + 2 * t) * (1 - t) ** 2 + h[k] * m[k] * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + h[k] * m[k + 1] * t * t * (t - 1)

    return at


def apply_curve(row: Column, points: list[tuple[float, float]]) -> Column:
    curve = monotone_curve(points)

    @F.pandas_udf(_DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: curve(a).tolist(), na_action="ignore")

    return run(row)


def lut_1d(row: Column, table: list[float]) -> Column:
    """Linear interpolation in a table over 0..1, clamped."""
    grid, values = np.linspace(0, 1, len(table)), np.array(table, dtype=float)

    @F.pandas_udf(_DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: np.interp(np.asarray(a, dtype=float), grid, values).tolist(), na_action="ignore")

    return run(row)


def trilinear(cube: np.ndarray, rgb: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Colours (n, 3) through a cube (k, k, k, 3) indexed by red, green, blue; blended with the input by ``strength``."""
    k = cube.shape[0] - 1
    p = np.clip(rgb, 0, 1) * k
    i = np.minimum(p.astype(int), max(k - 1, 0))
    f = p - i
    out = np.zeros_like(p)
    for c in np.ndindex(2, 2, 2):
        w = np.prod([f[:, a] if c[a] else 1 - f[:, a] for a in range(3)], axis=0)
        j = np.minimum(i + np.array(c), k)
        out += w[:, None] * cube[j[:, 0], j[:, 1], j[:, 2]]
    return rgb + (out - rgb) * strength


def apply_cube(rgb: Column, cube: np.ndarray, shaper: list[float] | None = None, strength: float = 1.0) -> Column:
    """An array [r, g, b, r, g, b, ...] through a 1-D shaper (if any) and a cube, blended with the input by ``strength``. The cube is bounded by its own definition."""
    c = np.asarray(cube, dtype=float)
    grid = None if shaper is None else np.linspace(0, 1, len(shaper))

    @F.pandas_udf(_DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        out = []
        for a in s:
            if a is None:
                out.append(None)
                continue
            v = np.asarray(a, dtype=float)[: len(a) // 3 * 3].reshape(-1, 3)
            shaped = v if grid is None else np.interp(v, grid, np.asarray(shaper, dtype=float))
            out.append((v + (trilinear(c, shaped) - v) * strength).ravel().tolist())
        return pd.Series(out, dtype=object)

    return run(rgb)
