"""Normalisations of the long sparse matrix expr(cell_id, gene_id, value)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Gene-identifier pattern and candidate symbol columns.
ENSEMBL_PATTERN = r"^(ENSG|ENSMUSG|ENSDARG)\d+(?:\.\d+)?$"
SYMBOL_COLUMNS = ("SYMBOL", "symbol", "gene_symbol", "gene_symbols", "feature_name", "gene_name")


def _with_total(expr: DataFrame, key: str, total: str, what=None) -> DataFrame:
    """Join each row's group total: the total is pre-aggregated, so a hot key only costs one row per task."""
    sums = expr.groupBy(key).agg((F.sum("value") if what is None else what).alias(total))
    return expr.join(sums, key)


def normalize_total(expr: DataFrame, target: float = 1e4) -> DataFrame:
    scaled = _with_total(expr, "cell_id", "_total")
    return scaled.withColumn("value", F.col("value") * F.lit(float(target)) / F.col("_total")).drop("_total")


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log(1.0 + F.col("value")))


def log_cpm(expr: DataFrame, scale: float = 1e6) -> DataFrame:
    """log1p of counts per million; an empty library counts as 1."""
    joined = _with_total(expr, "cell_id", "_lib")
    lib = F.when(F.col("_lib") == 0, 1.0).otherwise(F.col("_lib"))
    return joined.withColumn("value", F.log(1.0 + F.col("value") / lib * F.lit(float(scale)))).drop("_lib")


def clr_per_cell(expr: DataFrame, n_features: int) -> DataFrame:
    """Centred log ratio: log1p(x / exp(sum of log1p over positives / number of features))."""
    joined = _with_total(expr, "cell_id", "_s", F.sum(F.when(F.col("value") > 0, F.log(1.0 + F.col("value"))).otherwise(0.0)))
    return joined.withColumn("value", F.log(1.0 + F.col("value") / F.exp(F.col("_s") / F.lit(float(n_features))))).drop("_s")


def binarize(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.when(F.col("value") > 0, 1.0).otherwise(0.0))


def tfidf(expr: DataFrame, n_cells: int, log_idf: bool = True) -> DataFrame:
    """Term frequency per cell times inverse frequency per gene.

    ``log_idf``: ln(n / (column sum of tf + 1e-10)); otherwise n / column sum of raw values.
    """
    tf = _with_total(expr, "cell_id", "_row").withColumn("_tf", F.col("value") / F.col("_row"))
    column = tf.groupBy("gene_id").agg(F.sum("_tf" if log_idf else "value").alias("_col"))
    idf = F.log(F.lit(float(n_cells)) / (F.col("_col") + 1e-10)) if log_idf else F.lit(float(n_cells)) / F.col("_col")
    return tf.join(column, "gene_id").withColumn("value", F.col("_tf") * idf).drop("_tf", "_row", "_col")


def l1_log1e4(expr: DataFrame) -> DataFrame:
    joined = _with_total(expr, "cell_id", "_l1", F.sum(F.abs("value")))
    share = F.when(F.col("_l1") > 0, F.col("value") / F.col("_l1")).otherwise(0.0)
    return joined.withColumn("value", F.log(1.0 + 1e4 * share)).drop("_l1")


def size_factors(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """(cell_id, size_factor): library over mean library, at least 1e-6."""
    lib = obs.select("cell_id").join(expr.groupBy("cell_id").agg(F.sum("value").alias("_lib")), "cell_id", "left").na.fill(0.0)
    mean = lib.agg(F.avg("_lib").alias("_mean"))
    return lib.crossJoin(mean).select("cell_id", F.greatest(F.col("_lib") / F.col("_mean"), F.lit(1e-6)).alias("size_factor"))  # one-row side


def sanitize_counts(expr: DataFrame, reject_negative: bool = False) -> DataFrame:
    """Clip below zero and round half to even, or fail on negatives when asked."""
    value = F.col("value")
    if reject_negative:
        value = F.when(value < 0, F.raise_error(F.lit("negative counts"))).otherwise(value)
    return expr.withColumn("value", F.rint(F.greatest(value, F.lit(0.0))))


def looks_like_raw_counts(expr: DataFrame) -> DataFrame:
    """One row: all integers, the largest value, and the two verdicts drawn from them."""
    facts = expr.agg(F.bool_and(F.col("value") == F.rint("value")).alias("all_integer"), F.max("value").alias("max_value"))
    return facts.select(
        "all_integer", "max_value",
        (F.col("all_integer") & (F.col("max_value") > 50)).alias("looks_raw"),
        (F.col("max_value") < 50).alias("looks_log"),
    )


def resolve_layer(expr: DataFrame, order=("counts", "raw", "X")) -> DataFrame:
    """Rows of the first layer of ``order`` that holds any data."""
    rank = F.coalesce(*[F.when(F.col("layer") == name, F.lit(i)) for i, name in enumerate(order)])
    ranked = expr.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    best = ranked.agg(F.min("_rank").alias("_best"))
    return ranked.join(best, F.col("_rank") == F.col("_best"), "left_semi").drop("_rank")


def detect_modality(expr: DataFrame, n_cells: int, n_genes: int, has_hvg: bool = False, declared: str | None = None) -> DataFrame:
    """One row with the guessed modality; rules are tried in order."""
    nnz = expr.agg(F.sum(F.when(F.col("value") != 0, 1).otherwise(0)).alias("nnz"))
    density = F.col("nnz") / F.lit(float(max(n_cells * n_genes, 1)))
    verdict = (
        F.when(F.lit(declared is not None), F.lit(declared))
        .when(F.lit(has_hvg), "rna")
        .when(F.lit(n_genes > 10_000), "rna")
        .when(F.lit(n_genes < 100), "protein")
        .when(density < 0.01, "atac")
        .otherwise("rna")
    )
    return nnz.select(density.alias("density"), verdict.alias("modality"))


def looks_like_ensembl(var: DataFrame, id_col: str = "gene_id", sample: int = 50, share: float = 0.8) -> bool:
    """True if at least 80 % of the first 50 identifiers match the pattern."""
    ids = [str(r[0]) for r in var.select(id_col).filter(F.col(id_col).isNotNull()).orderBy(id_col).limit(sample).collect()]
    return bool(ids) and sum(bool(re.match(ENSEMBL_PATTERN, i)) for i in ids) / len(ids) >= share


def remap_gene_ids(var: DataFrame, resource: DataFrame, candidates: list[str] | None = None, min_share: float = 0.02) -> DataFrame:
    """Replace ``gene_id`` by the identifier column that overlaps most with ``resource(symbol)``."""
    candidates = candidates or [c for c in ("gene_id", *SYMBOL_COLUMNS) if c in var.columns]
    known = resource.select(F.upper(F.col("symbol").cast("string")).alias("_known")).distinct()
    total = known.count()
    overlaps = {}
    for column in candidates:
        ids = var.select(F.upper(F.col(column).cast("string")).alias("_known")).distinct()
        overlaps[column] = ids.join(known, "_known", "left_semi").count()
    best = max(candidates, key=lambda c: overlaps[c])
    if total == 0 or overlaps[best] / total < min_share:
        raise ValueError(f"no identifier column overlaps the resource: {overlaps}")
    return var.withColumn("gene_id", F.col(best).cast("string"))


def scale(expr: DataFrame, obs: DataFrame, genes: DataFrame, max_value: float = 10.0) -> DataFrame:
    """Dense z-scores (sample sd) of the given genes over all cells, clipped to +-max_value.

    Only the chosen genes are densified: cells x genes comes from an explode of
    the gene list kept per cell, not from pairing two large tables.
    """
    from cellweave.operators.features import gene_stats

    chosen = expr.join(genes.select("gene_id"), "gene_id", "left_semi")
    stats = gene_stats(chosen, obs, genes=genes).withColumn("_sd", F.when(F.col("var_sample") > 0, F.sqrt("var_sample")).otherwise(1.0))
    gene_list = genes.agg(F.array_sort(F.collect_set("gene_id")).alias("_genes"))  # bounded: the selected genes
    dense = obs.select("cell_id").crossJoin(gene_list).select("cell_id", F.explode("_genes").alias("gene_id"))  # one-row side
    z = (F.coalesce(F.col("value"), F.lit(0.0)) - F.col("mean")) / F.col("_sd")
    return (
        dense.join(chosen, ["cell_id", "gene_id"], "left")
        .join(stats.select("gene_id", "mean", "_sd"), "gene_id")
        .select("cell_id", "gene_id", F.least(F.greatest(z, F.lit(-max_value)), F.lit(max_value)).alias("value"))
    )
