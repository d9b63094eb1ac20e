"""Features of short annual series held in columns, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from upland.sources.panel import NTL, YEARS


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def growth_pct(old: Column, new: Column) -> Column:
    return F.when(old > 0, (new - old) / old * 100.0)


def growth_log(pct: Column) -> Column:
    return F.log1p(F.when(pct > 0, pct).when(pct.isNotNull(), 0.0))


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trend(columns: list[str] = NTL, years: tuple[int, ...] = YEARS, least: int = 3) -> tuple[Column, Column, Column]:
    """Slope, intercept and number of values of the least-squares line through the values present."""
    there = [F.col(c).isNotNull().cast("double") for c in columns]
    y = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    x = [float(k - years[0]) for k in years]
    n = total(there)
    sx, sy = total([t * k for t, k in zip(there, x, strict=True)]), total(y)
    sxx, sxy = total([t * k * k for t, k in zip(there, x, strict=True)]), total([v * k for v, k in zip(y, x, strict=True)])
    spread = n * sxx - sx * sx
    slope = F.when((n >= least) & (spread != 0), (n * sxy - sx * sy) / F.nullif(spread, F.lit(0.0)))
    return slope, (sy - slope * sx) / F.nullif(n, F.lit(0.0)) - slope * years[0], n


def _segment(columns: list[str], years: tuple[int, ...]) -> Column:
    """struct<slope, rss, n> of a segment, rss its squared residuals; the years' mean and spread are the whole segment's.

    Mean and slope are computed once a row: written out, each would hold the one before it several times."""
    mid = sum(years) / len(years)
    off = [k - mid for k in years]
    n = total([F.col(c).isNotNull().cast("double") for c in columns])
    mean = total([F.coalesce(F.col(c), F.lit(0.0)) for c in columns]) / F.nullif(n, F.lit(0.0))

    slope = lambda m: total([F.coalesce(F.col(c) - m, F.lit(0.0)) * k for c, k in zip(columns, off, strict=True)]) / sum(k * k for k in off)
    left = lambda s, m: [F.coalesce(F.col(c) - (s * k + m), F.lit(0.0)) for c, k in zip(columns, off, strict=True)]
    fit = lambda s, m: F.struct(s.alias("slope"), total([e * e for e in left(s, m)]).alias("rss"), n.alias("n"))
    return bound(mean, lambda m: bound(slope(m), lambda s: fit(s, m)))


def changepoint(columns: list[str] = NTL, years: tuple[int, ...] = YEARS) -> Column:
    """struct<year, pre, post> of the break whose two lines leave least, the earliest of equals; both sides need two values."""

    def option(k: int) -> Column:
        def found(a: Column, b: Column) -> Column:
            both = F.struct(F.round(a["rss"] + b["rss"], 9).alias("rss"), F.lit(years[k]).alias("year"), a["slope"].alias("pre"), b["slope"].alias("post"))
            return F.when((a["n"] >= 2) & (b["n"] >= 2), both)

        return bound(_segment(columns[:k], years[:k]), lambda a: bound(_segment(columns[k:], years[k:]), lambda b: found(a, b)))

    options = F.array(*[option(k) for k in range(2, len(years) - 1)])
    return F.array_min(F.filter(options, lambda o: o.isNotNull()))


def filled(columns: list[str] = NTL) -> Column:
    """The series as an array, gaps filled linearly between neighbours, ends with the nearest value; null without any."""
    known = F.filter(F.transform(F.array(*columns), lambda v, i: F.struct(i.cast("double").alias("i"), v.alias("v"))), lambda s: s["v"].isNotNull())

    def between(a: Column, b: Column, i: Column) -> Column:
        inner = a["v"] + (b["v"] - a["v"]) * ((i - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0.0)))
        return F.when(a.isNull(), b["v"]).when(b.isNull() | (a["i"] == b["i"]), a["v"]).otherwise(inner)

    def at(known: Column, i: Column) -> Column:
        before, after = F.filter(known, lambda s: s["i"] <= i), F.filter(known, lambda s: s["i"] >= i)
        ends = F.struct(F.try_element_at(before, F.lit(-1)).alias("a"), F.try_element_at(after, F.lit(1)).alias("b"))
        return bound(ends, lambda e: between(e["a"], e["b"], i))

    places = F.array(*[F.lit(float(k)) for k in range(len(columns))])
    return bound(known, lambda k: F.when(F.size(k) > 0, F.transform(places, lambda i: at(k, i))))


def damped_holt(columns: list[str] = NTL, ahead: int = 3, alpha: float = 0.5, beta: float = 0.2, phi: float = 0.9, least: int = 3) -> Column:
    """array of forecasts level + phi^h * trend, not below 0; null with fewer than `least` values."""

    def step(s: Column, v: Column) -> Column:
        level = alpha * v + (1 - alpha) * (s["level"] + phi * s["trend"])
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * phi * s["trend"]).alias("trend"))

    def state(y: Column) -> Column:
        start = F.struct(F.element_at(y, 1).alias("level"), (F.element_at(y, 2) - F.element_at(y, 1)).alias("trend"))
        return F.aggregate(F.slice(y, 2, len(columns) - 1), start, step)

    def forecasts(s: Column) -> Column:
        out, damp = [], 1.0
        for _ in range(ahead):
            damp *= phi
            out.append(F.greatest(s["level"] + damp * s["trend"], F.lit(0.0)))
        return F.array(*out)

    enough = total([F.col(c).isNotNull().cast("int") for c in columns]) >= least
    return F.when(enough, bound(bound(filled(columns), state), forecasts))
