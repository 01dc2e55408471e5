"""Quality control: per-cell and per-gene metrics, filters, presets, summaries."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds per tissue.
TISSUE_PRESETS = {
    "pbmc": (5, 200, 2500),
    "brain": (10, 200, 6000),
    "heart": (50, 200, 5000),
    "tumor": (20, 200, 5000),
    "liver": (15, 200, 4000),
    "kidney": (15, 200, 4000),
    "lung": (15, 200, 5000),
    "gut": (20, 200, 5000),
    "skin": (10, 200, 4000),
    "muscle": (30, 200, 5000),
}


@dataclass(frozen=True)
class Thresholds:
    """Filter settings; an instance with no arguments holds the defaults."""

    max_mt_pct: float = 20.0
    min_genes: int = 0
    max_genes: int = 0


def tissue_preset(name: str, chosen: Thresholds = Thresholds()) -> Thresholds:
    """Fill settings that are still at their default from the tissue's preset."""
    if name.lower() not in TISSUE_PRESETS:
        warnings.warn(f"no preset for tissue {name!r}; thresholds unchanged", stacklevel=2)
        return chosen
    preset = Thresholds(*TISSUE_PRESETS[name.lower()])
    default = Thresholds()
    fill = {f: getattr(preset, f) for f in ("max_mt_pct", "min_genes", "max_genes") if getattr(chosen, f) == getattr(default, f)}
    return replace(chosen, **fill)


def flag_mito(var: DataFrame, species: str = "human", symbol: str = "symbol") -> DataFrame:
    """``is_mt`` from the symbol prefix."""
    return var.withColumn("is_mt", F.col(symbol).startswith("MT-" if species == "human" else "mt-"))


def cell_metrics(expr: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """One row per cell of ``obs``; cells without expression count as zero."""
    mito = var.select("gene_id", "is_mt")
    seen = (
        expr.join(mito, "gene_id", "left")
        .groupBy("cell_id")
        .agg(
            F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("n_genes_by_counts"),
            F.sum("value").alias("total_counts"),
            F.sum(F.when(F.col("is_mt"), F.col("value")).otherwise(0.0)).alias("total_counts_mt"),
        )
    )
    filled = obs.select("cell_id").join(seen, "cell_id", "left").na.fill(0)
    return filled.withColumn(
        "pct_counts_mt",
        F.when(F.col("total_counts") > 0, F.col("total_counts_mt") / F.col("total_counts") * 100.0).otherwise(0.0),
    )


def gene_metrics(expr: DataFrame, n_cells: DataFrame | int) -> DataFrame:
    """Per gene: cells seen in, total and mean over all ``n_cells`` (zeros included)."""
    stats = expr.groupBy("gene_id").agg(
        F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("n_cells"), F.sum("value").alias("total_counts")
    )
    if isinstance(n_cells, int):
        return stats.withColumn("mean_counts", F.col("total_counts") / F.lit(n_cells))
    return stats.crossJoin(n_cells.agg(F.count(F.lit(1)).alias("_n"))).select(  # one-row side
        "gene_id", "n_cells", "total_counts", (F.col("total_counts") / F.col("_n")).alias("mean_counts")
    )


def filter_genes(expr: DataFrame, min_cells: int = 0, min_counts: float = 0) -> DataFrame:
    """Keep expression of genes seen in enough cells or with enough counts."""
    seen = expr.groupBy("gene_id").agg(
        F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("_cells"), F.sum("value").alias("_total")
    )
    keep = seen.filter((F.col("_cells") >= min_cells) & (F.col("_total") >= min_counts)).select("gene_id")
    return expr.join(keep, "gene_id", "left_semi")


def passing_cells(metrics: DataFrame, t: Thresholds, min_genes: bool = True, rest: bool = True) -> DataFrame:
    """Cell ids passing the lower gene bound and/or the strict upper bounds."""
    keep = F.lit(True)
    if min_genes:
        keep = keep & (F.col("n_genes_by_counts") >= t.min_genes)
    if rest and t.max_mt_pct < 100:
        keep = keep & (F.col("pct_counts_mt") < t.max_mt_pct)
    if rest and t.max_genes > 0:
        keep = keep & (F.col("n_genes_by_counts") < t.max_genes)
    return metrics.filter(keep).select("cell_id")


def filter_cells(expr: DataFrame, obs: DataFrame, var: DataFrame, thresholds: Thresholds = Thresholds(), min_cells: int = 0):
    """The full filter sequence: min_genes, then gene filter, then mito and max_genes bounds.

    The upper bounds use the metrics computed before any filter.  Returns (expr, obs).
    """
    metrics = cell_metrics(expr, obs, var)
    first = passing_cells(metrics, thresholds, rest=False)
    kept = filter_genes(expr.join(first, "cell_id", "left_semi"), min_cells=min_cells)
    final = passing_cells(metrics, thresholds)
    return kept.join(final, "cell_id", "left_semi"), obs.join(final, "cell_id", "left_semi")


def cluster_summary(obs: DataFrame, groupby: str) -> DataFrame:
    return obs.groupBy(groupby).agg(F.count(F.lit(1)).alias("n_cells"))


def qc_summary(expr_before: DataFrame, obs_before: DataFrame, expr_after: DataFrame, obs_after: DataFrame) -> DataFrame:
    """One row: cells and genes before and after filtering."""
    parts = [
        obs_before.agg(F.count(F.lit(1)).alias("n_cells_raw")),
        expr_before.agg(F.countDistinct("gene_id").alias("n_genes_raw")),
        obs_after.agg(F.count(F.lit(1)).alias("n_cells_filtered")),
        expr_after.agg(F.countDistinct("gene_id").alias("n_genes_filtered")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one-row sides
    return row
