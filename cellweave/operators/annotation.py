"""Cell-type annotation, label transfer, imputation and deconvolution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators import neighbors
from cellweave.operators.communication import _group_means
from cellweave.operators.de import top_per_group


def annotate_by_markers(markers: DataFrame, signatures: DataFrame, group: str = "group", top: int = 30, floor: float = 0.05) -> DataFrame:
    """Best signature per group by overlap with its top markers over the signature size.

    ``signatures(cell_type, gene_id, position)``; on a tie the earlier signature wins.
    """
    best = top_per_group(markers, [group], [F.desc("scores"), "gene_id"], top).select(group, "gene_id")
    sizes = signatures.groupBy("cell_type").agg(F.countDistinct("gene_id").alias("_size"), F.min("position").alias("_pos"))
    hits = best.join(signatures.select("cell_type", "gene_id").distinct(), "gene_id").groupBy(group, "cell_type").agg(F.count(F.lit(1)).alias("_o"))
    scored = hits.join(sizes, "cell_type").withColumn("_s", F.col("_o") / F.col("_size"))
    top1 = scored.groupBy(group).agg(F.max_by(F.struct("cell_type", "_s"), F.struct(F.col("_s"), -F.col("_pos"))).alias("_b"))
    score = F.coalesce(F.col("_b._s"), F.lit(0.0))
    return best.select(group).distinct().join(top1, group, "left").select(
        group, F.when(score < floor, "Unknown").otherwise(F.col("_b.cell_type")).alias("cell_type"), F.round(score, 3).alias("score")
    )


def label_transfer_knn(queries: DataFrame, reference: DataFrame | None, labels: DataFrame, k: int = 30, metric: str = "euclidean") -> DataFrame:
    """Majority label among the k nearest reference cells and its share; ties go to the smaller label.

    ``reference`` None transfers inside one set, each cell left out of its own vote.
    """
    near = neighbors.knn_embedding(queries, reference, k, metric)
    votes = near.join(labels.select(F.col("cell_id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("src").orderBy(F.desc("_n"), "label")
    total = F.sum("_n").over(Window.partitionBy("src"))
    return votes.withColumn("_t", total).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        F.col("src").alias("cell_id"), F.col("label").alias("predicted"), (F.col("_n") / F.col("_t")).alias("confidence")
    )


def assign_from_probabilities(probabilities: DataFrame) -> DataFrame:
    """(cell_id, label, confidence) from long (cell_id, label, p): rows normalised, a zero row stays zero."""
    total = probabilities.groupBy("cell_id").agg(F.sum("p").alias("_t"))
    share = probabilities.join(total, "cell_id").withColumn("_p", F.when(F.col("_t") > 0, F.col("p") / F.col("_t")).otherwise(0.0))
    w = Window.partitionBy("cell_id").orderBy(F.desc("_p"), "label")
    return share.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("cell_id", "label", F.col("_p").alias("confidence"))


def marker_matrix(signatures: DataFrame, var: DataFrame) -> DataFrame:
    """(gene_id, cell_type, 1) of the signature genes that exist; an error when none does."""
    found = signatures.select("cell_type", "gene_id").distinct().join(var.select("gene_id"), "gene_id", "left_semi")
    if found.isEmpty():
        raise ValueError("no signature gene is present")
    return found.withColumn("value", F.lit(1))


def impute_knn(edges: DataFrame, reference_expr: DataFrame, genes: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Unmeasured genes as the inverse-distance weighted mean over the nearest reference cells.

    With ``places(cell_id, x, y)`` of the cells, those that lie together share what their neighbours send.
    """
    weighted = edges.select("src", "dst", (1.0 / (F.col("dist") + 1e-10)).alias("weight"))
    wanted = reference_expr.join(genes.select("gene_id"), "gene_id", "left_semi")
    return neighbors.neighborhood_sums(weighted, wanted, ["value"], places, mean=True).select(F.col("src").alias("cell_id"), "gene_id", "value")


def localize_cells(reference: DataFrame, spots: DataFrame, k: int = 1, metric: str = "cosine") -> DataFrame:
    """The k most similar spots of every reference cell."""
    return neighbors.knn_embedding(reference, spots, k, metric).select(F.col("src").alias("cell_id"), F.col("dst").alias("spot_id"), "dist", "rank")


# ---------------------------------------------------------------- deconvolution
def signature_matrix(expr: DataFrame, obs: DataFrame, cell_type: str, genes: DataFrame | None = None) -> DataFrame:
    """(cell_type, gene_id, mean) of log-normalised reference expression, zeros included."""
    if genes is not None:
        expr = expr.join(genes.select("gene_id"), "gene_id", "left_semi")
    labels = obs.select("cell_id", F.col(cell_type).cast("string").alias("label"))
    return _group_means(expr, labels).select(F.col("label").alias("cell_type"), "gene_id", "mean")


def _solve_nnls(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Active-set non-negative least squares on the normal equations (few unknowns)."""
    k = len(rhs)
    x, active = np.zeros(k), np.zeros(k, bool)
    for _ in range(10 * k):
        gradient = rhs - gram @ x
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-10 * max(1.0, np.abs(rhs).max()):
            break
        active[best] = True
        while True:
            idx = np.flatnonzero(active)
            trial = np.zeros(k)
            trial[idx] = np.linalg.lstsq(gram[np.ix_(idx, idx)], rhs[idx], rcond=None)[0]
            if trial[idx].min() > 0:
                x = trial
                break
            bad = idx[trial[idx] <= 0]
            steps = x[bad] / np.maximum(x[bad] - trial[bad], 1e-300)
            x = x + steps.min() * (trial - x)
            active &= x > 1e-14
            x[~active] = 0.0
            if not active.any():
                break
    else:
        raise RuntimeError("the active set did not settle")
    return x


def nnls_deconvolve(expr: DataFrame, spots: DataFrame, signature: DataFrame) -> DataFrame:
    """Long (cell_id, cell_type, proportion): non-negative fit of each spot by the signatures, normalised to 1.

    Spark forms each spot's right-hand side (one number per type); a task only
    solves the small system.
    """
    types = [r[0] for r in signature.select("cell_type").distinct().orderBy("cell_type").collect()]  # the cell types
    a = signature.select("gene_id", F.col("cell_type").alias("_a"), F.col("mean").alias("_x"))
    b = signature.select("gene_id", F.col("cell_type").alias("_b"), F.col("mean").alias("_y"))
    gram = np.zeros((len(types), len(types)))
    for r in a.join(b, "gene_id").groupBy("_a", "_b").agg(F.sum(F.col("_x") * F.col("_y")).alias("g")).collect():  # types x types
        gram[types.index(r["_a"]), types.index(r["_b"])] = r["g"]
    dots = expr.join(signature, "gene_id").groupBy("cell_id").pivot("cell_type", types).agg(F.sum(F.col("value") * F.col("mean")))
    rows = spots.select("cell_id").join(dots, "cell_id", "left").na.fill(0.0)
    id_type = dict(spots.dtypes)["cell_id"]

    def solve(batches):
        for pdf in batches:
            fitted = np.array([_solve_nnls(gram, r) for r in pdf[types].to_numpy(float)]).reshape(len(pdf), len(types))
            total = fitted.sum(1, keepdims=True)
            share = np.divide(fitted, total, out=np.zeros_like(fitted), where=total > 0)
            out = pdf[["cell_id"]].copy()
            out["shares"] = list(share)
            yield out

    solved = rows.mapInPandas(solve, f"cell_id {id_type}, shares array<double>")
    names = F.array(*[F.lit(t) for t in types])
    return solved.select("cell_id", F.posexplode("shares").alias("_i", "proportion")).select("cell_id", F.element_at(names, F.col("_i") + 1).alias("cell_type"), "proportion")


def dominant_type(proportions: DataFrame) -> DataFrame:
    w = Window.partitionBy("cell_id").orderBy(F.desc("proportion"), "cell_type")
    return proportions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("cell_id", F.col("cell_type").alias("dominant"), "proportion")


def deconv_stats(proportions: DataFrame) -> DataFrame:
    """Mean proportion and number of spots dominated, per cell type."""
    mean = proportions.groupBy("cell_type").agg(F.avg("proportion").alias("mean_proportion"))
    top = dominant_type(proportions).groupBy(F.col("dominant").alias("cell_type")).agg(F.count(F.lit(1)).alias("n_dominant"))
    return mean.join(top, "cell_type", "left").na.fill(0)


def diversity_entropy(proportions: DataFrame) -> DataFrame:
    """Base-2 Shannon entropy per cell over log2 of the number of types."""
    p = F.col("proportion") + 1e-10
    per_cell = proportions.groupBy("cell_id").agg((-F.sum(p * F.log2(p))).alias("_h"), F.count(F.lit(1)).alias("_k"))
    return per_cell.select("cell_id", (F.col("_h") / F.log2("_k")).alias("diversity"))
