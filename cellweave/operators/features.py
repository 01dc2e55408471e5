"""Feature selection and decompositions on the sparse matrix."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.session import materialize


def gene_stats(expr: DataFrame, obs: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Per gene: n, nnz, sum, mean, population and sample variance, with implicit zeros."""
    n = obs.agg(F.count(F.lit(1)).alias("n"))
    sums = expr.groupBy("gene_id").agg(
        F.sum(F.when(F.col("value") != 0, 1).otherwise(0)).alias("nnz"),
        F.sum("value").alias("total"),
        F.sum(F.col("value") * F.col("value")).alias("sumsq"),
    )
    if genes is not None:
        sums = genes.select("gene_id").join(sums, "gene_id", "left").na.fill(0)
    mean = F.col("total") / F.col("n")
    return sums.crossJoin(n).select(  # one-row side
        "gene_id", "n", "nnz", "total", "sumsq",
        mean.alias("mean"),
        (F.col("sumsq") / F.col("n") - mean * mean).alias("var_pop"),
        F.when(F.col("n") > 1, (F.col("sumsq") - F.col("n") * mean * mean) / (F.col("n") - 1)).alias("var_sample"),
    )


def top_variance_genes(expr: DataFrame, obs: DataFrame, n_top: int = 20) -> DataFrame:
    """The ``n_top`` genes of largest population variance (ties by gene id)."""
    return gene_stats(expr, obs).select("gene_id", F.col("var_pop").alias("variance")).orderBy(F.desc("variance"), "gene_id").limit(n_top)


def select_genes(expr: DataFrame, obs: DataFrame, var: DataFrame | None = None, genes: list | None = None, n_top: int = 20) -> DataFrame:
    """Explicit genes (missing ones warned about), else flagged variable genes, else top variance."""
    if genes is not None:
        wanted = var.sparkSession.createDataFrame([(g,) for g in genes], ["gene_id"]) if var is not None else None
        present = {r[0] for r in var.join(wanted, "gene_id", "left_semi").select("gene_id").collect()}  # at most len(genes)
        missing = [g for g in genes if g not in present]
        if not present:
            raise ValueError("none of the requested genes is present")
        if missing:
            warnings.warn(f"genes not found: {missing}", stacklevel=2)
        return wanted.join(var, "gene_id", "left_semi")
    if var is not None and "highly_variable" in var.columns:
        flagged = var.filter("highly_variable").select("gene_id").orderBy("gene_id").limit(n_top)
        if not flagged.isEmpty():
            return flagged
    return top_variance_genes(expr, obs, n_top).select("gene_id")


def hvg_dispersion(expr: DataFrame, obs: DataFrame, n_top: int = 2000, n_bins: int = 20) -> DataFrame:
    """Dispersion normalised inside equal-width mean bins; expects log-normalised values.

    Means and variances are taken on expm1 of the values; a bin holding one gene
    uses its own mean as the deviation and 0 as the centre.
    """
    linear = expr.withColumn("value", F.exp("value") - 1.0)
    base = gene_stats(linear, obs).select(
        "gene_id",
        F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean")).alias("_mean"),
        "var_sample",
    ).select(
        "gene_id",
        F.log(1.0 + F.col("_mean")).alias("mean"),
        F.when(F.col("var_sample") > 0, F.log(F.col("var_sample") / F.col("_mean"))).alias("dispersion"),
    )
    span = base.agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    binned = base.crossJoin(span).withColumn(  # one-row side
        "bin", F.when(width > 0, F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.ceil((F.col("mean") - F.col("_lo")) / width).cast("int") - 1))).otherwise(0)
    )
    per_bin = binned.groupBy("bin").agg(F.avg("dispersion").alias("_avg"), F.stddev_samp("dispersion").alias("_std"))
    centre = F.when(F.col("_std").isNull(), 0.0).otherwise(F.col("_avg"))
    spread = F.coalesce(F.col("_std"), F.col("_avg"))
    scored = binned.join(per_bin, "bin").select("gene_id", "mean", "dispersion", "bin", ((F.col("dispersion") - centre) / spread).alias("dispersion_norm"))
    return scored.filter(F.col("dispersion_norm").isNotNull()).orderBy(F.desc("dispersion_norm"), "gene_id").limit(n_top)


def hvg_vst(expr: DataFrame, obs: DataFrame, n_top: int = 2000) -> DataFrame:
    """Rank genes by the variance of standardised, clipped counts.

    The expected sd comes from a quadratic fit of log10 variance on log10 mean
    (normal equations from eleven sums); clipping at sqrt(n) is applied to the
    non-zeros, and the zeros enter in closed form.
    """
    stats = gene_stats(expr, obs).filter("var_sample > 0 AND mean > 0").withColumn("_u", F.log10("mean")).withColumn("_v", F.log10("var_sample"))
    u, v = F.col("_u"), F.col("_v")
    powers = {f"s{p}": F.sum(F.pow(u, F.lit(float(p)))) for p in range(5)} | {f"t{p}": F.sum(F.pow(u, F.lit(float(p))) * v) for p in range(3)}
    sums = stats.agg(*[e.alias(k) for k, e in powers.items()]).first()
    if not sums["s0"]:
        raise ValueError("no gene with positive variance")
    gram = np.array([[sums[f"s{i + j}"] for j in range(3)] for i in range(3)], float)
    beta = np.linalg.lstsq(gram, np.array([sums[f"t{i}"] for i in range(3)], float), rcond=None)[0]
    expected = F.sqrt(F.pow(F.lit(10.0), beta[0].item() + beta[1].item() * u + beta[2].item() * u * u))
    reg = stats.select("gene_id", "n", "nnz", "mean", expected.alias("_sd"))
    clip = F.sqrt("n")
    z = F.least((F.col("value") - F.col("mean")) / F.col("_sd"), clip)
    z0 = -F.col("mean") / F.col("_sd")
    zsum = expr.filter("value <> 0").join(reg, "gene_id").groupBy("gene_id").agg(F.sum(z).alias("_z"), F.sum(z * z).alias("_zz"))
    total, square = F.col("_z") + (F.col("n") - F.col("nnz")) * z0, F.col("_zz") + (F.col("n") - F.col("nnz")) * z0 * z0
    scored = reg.join(zsum, "gene_id").select("gene_id", "mean", ((square - total * total / F.col("n")) / (F.col("n") - 1)).alias("variance_norm"))
    return scored.orderBy(F.desc("variance_norm"), "gene_id").limit(n_top)


def common_genes(a: DataFrame, b: DataFrame, min_genes: int = 1, min_variable: int = 0) -> DataFrame:
    """Shared gene ids; the variable ones alone when at least ``min_variable`` are shared."""
    shared = a.select("gene_id").join(b.select("gene_id"), "gene_id", "left_semi").distinct()
    n = shared.count()
    if n < min_genes:
        raise ValueError(f"only {n} shared genes, need {min_genes}")
    if min_variable and "highly_variable" in a.columns:
        variable = shared.join(a.filter("highly_variable"), "gene_id", "left_semi")
        if variable.count() >= min_variable:
            return variable
    return shared


def cell_vectors(values: DataFrame, genes: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, vec): dense vectors over the chosen genes, in gene order."""
    packed = values.join(genes.select("gene_id"), "gene_id", "left_semi").groupBy(key).agg(F.collect_list(F.struct("gene_id", "value")).alias("_pairs"))
    return packed.select(key, F.transform(F.array_sort("_pairs"), lambda p: p["value"]).alias("vec"))


def pca(scaled: DataFrame, genes: DataFrame, n_comps: int = 50, key: str = "cell_id") -> DataFrame:
    """(cell_id, vec): principal components of dense scaled values; the largest loading of each is positive."""
    # counted, summed, multiplied and transformed: the vectors are built once
    vectors = materialize(cell_vectors(scaled, genes, key)).withColumn("features", array_to_vector("vec"))
    limits = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    k = max(1, min(n_comps, limits[0] - 1, limits[1] - 1))
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(vectors)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, j])), j]) or 1.0) for j in range(k)]
    flip = F.array(*[F.lit(s) for s in signs])
    out = model.transform(vectors)
    result = out.select(key, F.zip_with(vector_to_array("pcs"), flip, lambda a, s: a * s).alias("vec"))
    result.explained_variance = [float(v) for v in model.explainedVariance]
    return result


def suggest_n_pcs(ratios: list[float] | None, threshold: float = 0.85) -> int:
    """First component reaching the cumulative ratio, between 15 and 30; 30 when unknown."""
    if not ratios:
        return 30
    reached = np.flatnonzero(np.cumsum(ratios) >= threshold)
    return int(min(30, max(15, reached[0] + 1 if len(reached) else 30)))


def lsi(expr: DataFrame, obs: DataFrame, n_comps: int = 20, per: str = "column") -> DataFrame:
    """TF-IDF, L1, log, truncated SVD; standardised per column or per row, first component dropped."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix

    from cellweave.operators import normalize

    index = expr.select("gene_id").distinct()
    index = S.hash_order(index, F.col("gene_id"), out="_col")
    size = index.count()
    n = obs.count()
    weights = normalize.l1_log1e4(normalize.tfidf(normalize.binarize(expr), n_cells=n))
    rows = (
        weights.join(index, "gene_id").groupBy("cell_id")
        .agg(F.collect_list(F.struct((F.col("_col") - 1).cast("int").alias("c"), F.col("value").alias("v"))).alias("_nz"))
        .select("cell_id", F.array_sort("_nz").alias("_nz"))
    )
    # The iterative solver reads the rows many times: vectors are built once and then stay on the JVM side.
    vectors = rows.rdd.map(lambda r: (r["cell_id"], Vectors.sparse(size, [p["c"] for p in r["_nz"]], [p["v"] for p in r["_nz"]]))).toDF(["index", "vector"])
    matrix = IndexedRowMatrix(materialize(vectors).persist(StorageLevel.MEMORY_AND_DISK))
    k = max(2, min(n_comps + 1, size - 1, n - 1))
    svd = matrix.computeSVD(k, computeU=True)
    scale = [float(s) for s in svd.s]
    scores = svd.U.rows.map(lambda r: (r.index, [float(x) * s for x, s in zip(r.vector, scale)])).toDF("cell_id long, vec array<double>")
    return standardize_embedding(scores, per=per).select("cell_id", F.slice("vec", 2, k - 1).alias("vec"))


def standardize_embedding(embedding: DataFrame, per: str = "column", key: str = "cell_id") -> DataFrame:
    """Zero mean and unit population sd per column, or per row."""
    if per == "row":
        size = F.size("vec")
        mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / size
        rows = embedding.withColumn("_m", mean)
        rows = rows.withColumn("_s", F.sqrt(F.aggregate(F.transform("vec", lambda x: (x - F.col("_m")) * (x - F.col("_m"))), F.lit(0.0), lambda a, x: a + x) / size))
        safe = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
        return rows.withColumn("vec", F.transform("vec", lambda x: (x - F.col("_m")) / safe)).drop("_m", "_s")
    stats = embedding.select(F.posexplode("vec").alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("_i", "m", "s"))).alias("_stats"))  # one row, one entry per dimension
    return embedding.crossJoin(packed).withColumn(
        "vec", F.zip_with("vec", "_stats", lambda x, st: (x - st["m"]) / F.when(st["s"] > 0, st["s"]).otherwise(1.0))
    ).drop("_stats")


def fuse_embeddings(a: DataFrame, b: DataFrame, method: str = "concatenation", key: str = "cell_id") -> DataFrame:
    """Concatenate two embeddings, or average their standardised forms (equal dimension needed)."""
    if method == "concatenation":
        return a.join(b.withColumnRenamed("vec", "_b"), key).select(key, F.concat("vec", "_b").alias("vec"))
    if method != "weighted":
        raise ValueError(f"unknown fusion method {method!r}")
    za, zb = standardize_embedding(a, key=key), standardize_embedding(b, key=key).withColumnRenamed("vec", "_b")
    checked = F.when(F.size("vec") == F.size("_b"), F.zip_with("vec", "_b", lambda x, y: 0.5 * x + 0.5 * y)).otherwise(F.raise_error(F.lit("embeddings differ in dimension")))
    return za.join(zb, key).select(key, checked.alias("vec"))


class SiteFeatures(NamedTuple):
    """Features as a function of the places in ``sites(cell_id, x, y)``: ``expand(x, y)`` gives their rows."""

    sites: DataFrame
    expand: Callable[[np.ndarray, np.ndarray], np.ndarray]


def random_fourier_features(obs: DataFrame, m: int = 500, seed: int = 42, as_sites: bool = False) -> DataFrame | SiteFeatures:
    """(cell_id, vec): centred cosine features of the coordinates; bandwidth is the median coordinate sd.

    ``as_sites`` gives the places and the function instead, for steps that would send ``m`` numbers with every row.
    """
    sd = obs.agg(F.stddev_pop("x"), F.stddev_pop("y")).first()
    bandwidth = float(np.median([sd[0], sd[1]])) or 1.0
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(size=(2, m)) / bandwidth, rng.uniform(0, 2 * np.pi, m)
    terms = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(p)).alias("p")) for a, b, p in zip(omega[0], omega[1], phase)])
    raw = obs.select("cell_id", F.transform(terms, lambda t: F.cos(F.col("x") * t["a"] + F.col("y") * t["b"] + t["p"]) * float(np.sqrt(2.0 / m))).alias("vec"))
    means = raw.select(F.posexplode("vec").alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("m"))
    if as_sites:
        centre = np.array([r["m"] for r in means.orderBy("_i").collect()], float)  # m numbers
        scale = float(np.sqrt(2.0 / m))
        return SiteFeatures(obs.select("cell_id", "x", "y"), lambda x, y: np.cos(np.outer(x, omega[0]) + np.outer(y, omega[1]) + phase) * scale - centre)
    packed = means.agg(F.array_sort(F.collect_list(F.struct("_i", "m"))).alias("_means"))  # one row of m entries
    return raw.crossJoin(packed).select("cell_id", F.zip_with("vec", "_means", lambda x, c: x - c["m"]).alias("vec"))


def expand_obs_pivot(expr: DataFrame, obs: DataFrame, genes: list) -> DataFrame:
    """Dense columns for a short, given gene list, zeros included."""
    wide = expr.filter(F.col("gene_id").isin(genes)).groupBy("cell_id").pivot("gene_id", genes).agg(F.sum("value"))
    return obs.select("cell_id").join(wide, "cell_id", "left").na.fill(0.0)
