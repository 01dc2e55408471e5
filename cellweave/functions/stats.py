"""Column expressions and set-wise helpers shared by every statistic.

Ranks, quantiles, multiple-testing correction and permutations all run on one
primitive, :func:`cumulative_counts`: rows are first reduced to (group, value)
counts, then ranked inside monotone value buckets, and only the small table of
bucket totals is scanned in order.  A group holding a third of the data is
therefore spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellweave.session import materialize

BUCKETS_PER_OCTAVE = 64
#: Equal parts of the range that the values inside one such bucket really have.
PARTS = 1024


def r6(column: Column | str, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0, so that equal results also print equal."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


# ---------------------------------------------------------------- distributions
def norm_sf(z: Column) -> Column:
    """Upper normal tail for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1.0 / (1.0 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2.0) / F.lit(math.sqrt(2.0 * math.pi)) * poly


def norm_pvalue(z: Column) -> Column:
    """Two-sided normal p-value."""
    return F.least(F.lit(1.0), 2.0 * norm_sf(F.abs(z)))


def norm_upper(z: Column) -> Column:
    """P(Z > z) for any sign of z."""
    return F.when(z >= 0, norm_sf(F.abs(z))).otherwise(1.0 - norm_sf(F.abs(z)))


def chi2_sf(x: Column, dof: Column | float) -> Column:
    """Upper chi-square tail by the Wilson-Hilferty cube-root transform."""
    dof = F.lit(float(dof)) if not isinstance(dof, Column) else dof
    spread = 2.0 / (9.0 * dof)
    z = (F.pow(F.greatest(x, F.lit(0.0)) / dof, F.lit(1.0 / 3.0)) - (1.0 - spread)) / F.sqrt(spread)
    return norm_upper(z)


# Lanczos coefficients (g = 7, nine terms).
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, inside whole-stage codegen."""
    x = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, coefficient in enumerate(LANCZOS[1:], start=1):
        series = series + coefficient / (x + float(i))
    t = x + 7.5
    return 0.5 * math.log(2.0 * math.pi) + (x + 0.5) * F.log(t) - t + F.log(series)


def ln_choose(n: Column, k: Column) -> Column:
    n, k = n.cast("double"), k.cast("double")
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def hypergeom_upper(df: DataFrame, keys: Sequence[str], k: str, hits: str, draws: str, total: str, out: str) -> DataFrame:
    """Add ``out`` = P(X >= k) for X hypergeometric(total, hits, draws); one row per ``keys``."""
    terms = df.select(*keys, k, hits, draws, total).withColumn(
        "_i", F.explode(F.sequence(F.col(k), F.greatest(F.col(k), F.least(F.col(hits), F.col(draws)))))
    )
    misses_ok = (F.col(draws) - F.col("_i")) <= (F.col(total) - F.col(hits))
    drawable = F.col("_i") <= F.least(F.col(hits), F.col(draws))
    mass = F.exp(
        ln_choose(F.col(hits), F.col("_i"))
        + ln_choose(F.col(total) - F.col(hits), F.col(draws) - F.col("_i"))
        - ln_choose(F.col(total), F.col(draws))
    )
    tail = terms.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(F.when(misses_ok & drawable, mass).otherwise(0.0))).alias(out))
    return df.join(tail, list(keys))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, all rows at once."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    return h


def student_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided Student-t p-values (regularised incomplete beta)."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    a, b = dof / 2.0, np.full_like(dof, 0.5)
    x = dof / (dof + t * t)
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(np.clip(x, 1e-300, 1)) + b * np.log(np.clip(1 - x, 1e-300, 1)))
    direct = x < (a + 1.0) / (a + b + 2.0)
    upper = front * _beta_fraction(a, b, x) / a
    lower = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    p = np.where(direct, upper, lower)
    return np.clip(np.where(x >= 1.0, 1.0, p), 0.0, 1.0)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Arrow-batched two-sided Student-t p-value; null in, null out."""
    known = t.notna() & dof.notna() & (dof > 0)
    out = pd.Series(np.nan, index=t.index)
    if known.any():
        out[known] = student_two_sided(t[known].to_numpy(), dof[known].to_numpy())
    return out.where(known, None)


# ------------------------------------------------------------- ordered primitives
def value_bucket(value: Column) -> Column:
    """A long that never decreases as ``value`` grows; about 64 buckets per power of two."""
    magnitude = F.floor(F.log2(F.abs(value)) * BUCKETS_PER_OCTAVE) + F.lit(100_000)
    return F.when(value == 0, F.lit(0)).when(value > 0, magnitude).otherwise(-magnitude).cast("long")


def range_buckets(distinct: DataFrame, value: str, out: str = "_bucket") -> DataFrame:
    """Add ``out``, which never decreases as ``value`` grows and follows the data.

    Values of one :func:`value_bucket` (all of them, for epoch times or other values far from zero) are
    cut again into equal parts of the range they really have.  The table of ranges has at most one row
    for each value bucket, whatever the size of the data.
    """
    coarse = value_bucket(F.col(value))
    ranges = distinct.groupBy(coarse.alias("_coarse")).agg(F.min(value).alias("_from"), F.max(value).alias("_to"))
    joined = distinct.withColumn("_at", coarse).join(ranges, F.col("_at").eqNullSafe(F.col("_coarse")))
    part = F.least(F.lit(PARTS - 1), F.floor((F.col(value) - F.col("_from")) / (F.col("_to") - F.col("_from")) * PARTS))
    fine = F.when(F.col("_to") > F.col("_from"), part).otherwise(F.lit(0)).cast("long")
    return joined.withColumn(out, F.col("_at") * PARTS + fine).drop("_at", "_coarse", "_from", "_to")


def cumulative_counts(df: DataFrame, by: Sequence[str], value: str, bucket: Column | None = None) -> DataFrame:
    """Distinct (by, value) with ``n_ties`` rows at the value and ``n_before`` rows below it."""
    by = list(by)
    distinct = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_ties"))
    distinct = materialize(distinct) if bucket is None else distinct  # read four times below
    distinct = range_buckets(distinct, value) if bucket is None else distinct.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = distinct.groupBy(*by, "_bucket").agg(F.sum("n_ties").alias("_n")).select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset")
    )
    return (
        distinct.withColumn("_inside", F.coalesce(F.sum("n_ties").over(inside), F.lit(0)))
        .join(totals, [*by, "_bucket"])
        .select(*by, value, "n_ties", (F.col("_offset") + F.col("_inside")).alias("n_before"))
    )


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct (by, value) with the average rank of its ties (1-based)."""
    counts = cumulative_counts(df, by, value)
    return counts.withColumn("avg_rank", F.col("n_before") + (F.col("n_ties") + 1) / 2.0)


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, out: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile per group without holding a group in one task."""
    by = list(by)
    counts = cumulative_counts(df.filter(F.col(value).isNotNull()), by, value)
    size = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    joined = counts.join(size, by) if by else counts.crossJoin(size)  # one-row side
    position = (F.col("_size") - 1) * F.lit(float(q))
    low, high = F.floor(position), F.ceil(position)
    covers = lambda p: (F.col("n_before") <= p) & (p < F.col("n_before") + F.col("n_ties"))
    picked = joined.filter(covers(low) | covers(high)).groupBy(*by).agg(
        F.max(F.when(covers(low), F.col(value))).alias("_lo"),
        F.max(F.when(covers(high), F.col(value))).alias("_hi"),
        F.max(position - low).alias("_frac"),
    )
    return picked.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias(out))


def bh_fdr(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "qval") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values per ``by`` group; tied p-values share the larger rank.

    The reverse running minimum is taken inside value buckets and then over the
    bucket summary, so no group is sorted whole in one task.
    """

    by = list(by)
    df = materialize(df)  # a test table is small next to what it was computed from, and is read several times
    tested = df.filter(F.col(p).isNotNull()).select(*by, p)
    total = tested.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    ranked = cumulative_counts(tested, by, p)
    ranked = ranked.join(total, by) if by else ranked.crossJoin(total)  # one-row side
    ranked = ranked.select(
        *by, p, (F.col(p) * F.col("_m") / (F.col("n_before") + F.col("n_ties"))).alias("_raw"), value_bucket(F.col(p)).alias("_bucket")
    )
    later = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = ranked.groupBy(*by, "_bucket").agg(F.min("_raw").alias("_low")).select(
        *by, "_bucket", F.coalesce(F.min("_low").over(later), F.lit(1.0)).alias("_above")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = (
        ranked.withColumn("_within", F.min("_raw").over(inside))
        .join(above, [*by, "_bucket"])
        .select(*by, p, F.least(F.lit(1.0), "_within", "_above").alias(out))
    )
    return df.join(adjusted, [*by, p], "left")


# -------------------------------------------------------------------- permutations
def hash_order(df: DataFrame, key: Column, by: Sequence[str] = (), out: str = "slot") -> DataFrame:
    """1-based position of each row in the order of an md5 ``key`` (4096 even buckets)."""
    by = list(by)
    keyed = df.withColumn("_key", F.md5(key.cast("string").cast("binary"))).withColumn("_bucket", F.substring("_key", 1, 3))
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key")
    return (
        keyed.withColumn("_row", F.row_number().over(inside))
        .join(totals, [*by, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_key", "_bucket", "_row", "_offset")
    )


def permute_labels(labels: DataFrame, key: str, label: str, n_perms: int, seed: int = 42) -> DataFrame:
    """(perm, key, label): every permutation reassigns the same multiset of labels."""
    base = hash_order(labels.select(key, label), F.concat_ws("-", F.lit(f"{seed}-base"), F.col(key)))
    perms = labels.select(key).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perms))))
    shuffled = hash_order(perms, F.concat_ws("-", F.lit(seed), F.col("perm"), F.col(key)), by=["perm"])
    return shuffled.join(base.select("slot", label), "slot").select("perm", key, label)


def perm_pvalue(exceed: Column, n: Column | int) -> Column:
    return (exceed + 1.0) / (n + 1.0)


def masked(column: Column, guard: Column, default: float = 0.0) -> Column:
    return F.when(guard, column).otherwise(F.lit(default))
