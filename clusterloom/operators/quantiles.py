"""Exact quantiles (linear between ranks) without one task that holds all values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an interval, at most, whose distinct values and their numbers are collected; a larger one is narrowed.
HELD = 100_000
#: Accuracy of the summaries that narrow an interval, and how far a rank's share is widened on both sides.
ACCURACY, MARGIN = 10_000, 0.002


def _ranked(values: DataFrame, ranks: list[int], n: int, lowest: float, highest: float, held: int) -> dict[int, float]:
    """The value of each rank (from 0) among ``n`` values (x). An interval around each is narrowed by a summary, whose
    ends are then counted, until it is a value or holds ``held`` rows."""
    spans = {r: (lowest, highest, 0, n) for r in ranks}  # from, to, rows below, rows within
    while live := [r for r in ranks if spans[r][0] < spans[r][1] and spans[r][3] > held]:
        x, ends = F.col("x"), []
        for r in live:
            low, high, below, within = spans[r]
            share = (r - below + 0.5) / within
            wanted = F.array(*[F.lit(min(1.0, max(0.0, share + s))) for s in (-MARGIN, MARGIN)])
            ends.append(F.percentile_approx(F.when(x.between(low, high), x), wanted, ACCURACY).alias(f"e{r}"))
        told = values.agg(*ends).first()
        counts = []
        for r in live:
            low, high, _, _ = spans[r]
            a, b = told[f"e{r}"]
            counts += [F.count_if(x.between(low, high) & (x < a)).alias(f"l{r}"), F.count_if(x.between(a, b)).alias(f"m{r}")]
        found = values.agg(*counts).first()
        for r in live:
            low, high, below, within = spans[r]
            (a, b), less, middle = told[f"e{r}"], found[f"l{r}"], found[f"m{r}"]
            if not below + less <= r < below + less + middle or middle == within:  # the summary tells nothing: the values are counted
                return spans_of_counts(values, ranks, spans)
            spans[r] = (a, b, below + less, middle)
    return spans_of_counts(values, ranks, spans)


def spans_of_counts(values: DataFrame, ranks: list[int], spans: dict) -> dict[int, float]:
    """The value of each rank, from the numbers of the distinct values in its interval."""
    out = {r: spans[r][0] for r in ranks if spans[r][0] == spans[r][1]}
    for span in {spans[r] for r in ranks if r not in out}:  # ranks of the same interval are found in one pass
        low, high, below, _ = span
        wanted = [r for r in sorted(ranks) if r not in out and spans[r] == span]
        for row in values.filter(F.col("x").between(low, high)).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").toLocalIterator():
            below += row.n
            while wanted and below > wanted[0]:
                out[wanted.pop(0)] = row.x
            if not wanted:
                break
    return out


def quantiles(rows: DataFrame, column: str, shares: list[float], held: int = HELD) -> list[float | None]:
    """The quantiles of a column's values that aren't null; None without any. What is collected is bounded by ``held`` rows a rank."""
    values = rows.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    r = values.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lowest"), F.max("x").alias("highest")).first()
    if not r.n:
        return [None] * len(shares)
    places = [(r.n - 1) * q for q in shares]
    ranks = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    at = _ranked(values, ranks, r.n, r.lowest, r.highest, held)
    # The same terms as those of the aggregate function.
    return [at[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * at[math.floor(p)] + (p - math.floor(p)) * at[math.ceil(p)] for p in places]
