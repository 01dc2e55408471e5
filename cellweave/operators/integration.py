"""Batch mixing, slice registration, regridding and image-derived tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.operators import neighbors
from cellweave.operators.domains import _vectors
from cellweave.operators.tissue import connected_components
from cellweave.session import materialize

# Names a slice or batch column may have, in the order they are tried.
SLICE_KEYS = ("slice", "sample", "section", "batch", "sample_id")


def batch_mixing(edges: DataFrame, obs: DataFrame, batch: str) -> DataFrame:
    """One row: mean neighbour-batch entropy over ln(number of batches); cells without neighbours are skipped, one batch gives 0."""
    named = edges.select("src", "dst").join(obs.select(F.col("cell_id").alias("dst"), F.col(batch).alias("_b")), "dst")
    counts = named.groupBy("src", "_b").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy("src").agg(F.sum("_n").alias("_t"))
    p = F.col("_n") / F.col("_t")
    entropy = counts.join(total, "src").groupBy("src").agg((-F.sum(p * F.log(p))).alias("_h"))
    kinds = obs.agg(F.countDistinct(batch).alias("_k"))
    return entropy.agg(F.avg("_h").alias("_m")).crossJoin(kinds).select(F.when(F.col("_k") > 1, F.coalesce("_m", F.lit(0.0)) / F.log("_k")).otherwise(0.0).alias("mixing"))  # one-row sides


def integration_report(before: DataFrame, after: DataFrame, obs: DataFrame, batch: str) -> DataFrame:
    """Batch sizes with the mixing before and after; fewer than two batches is an error."""
    sizes = obs.groupBy(F.col(batch).alias("batch")).agg(F.count(F.lit(1)).alias("n_cells"))
    if sizes.count() < 2:
        candidates = [c for c in obs.columns if obs.select(c).distinct().limit(2).count() == 2]
        raise ValueError(f"{batch} holds one batch only; columns with more than one value: {candidates}")
    mix = lambda e, name: batch_mixing(e, obs, batch).select(F.round("mixing", 4).alias(name))
    return sizes.crossJoin(mix(before, "mixing_before")).crossJoin(mix(after, "mixing_after"))  # one-row sides


def harmonize_embedding(embedding: DataFrame, batch: str = "batch", k: int = 10, iterations: int = 5, sigma: float = 0.1, ridge: float = 1.0, seed: int = 42) -> DataFrame:
    """Soft-cluster batch correction of (cell_id, vec, batch).

    Each round fits centres, weighs cells softly by cosine similarity and moves
    them by the ridge-shrunk offset of their batch in every cluster.
    """
    from pyspark.ml.clustering import KMeans

    current = materialize(embedding.select("cell_id", F.col("vec").cast("array<double>").alias("vec"), batch))
    for i in range(iterations):
        rows = _vectors(current)
        centres = np.array(KMeans(k=k, seed=seed + i).fit(rows).clusterCenters())  # k small vectors
        unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

        def weigh(batches, unit=unit):
            for pdf in batches:
                mat = np.stack(pdf["vec"].to_numpy())
                cos = (mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)) @ unit.T
                w = np.exp((cos - cos.max(1, keepdims=True)) * 2.0 / sigma)
                pdf["w"] = list(w / w.sum(1, keepdims=True))
                yield pdf

        types = dict(current.dtypes)
        soft = materialize(current.mapInPandas(weigh, f"cell_id {types['cell_id']}, vec array<double>, {batch} {types[batch]}, w array<double>"))
        long = soft.select(batch, F.posexplode("w").alias("c", "_w"), "vec").select(batch, "c", "_w", F.posexplode("vec").alias("i", "_x"))
        by_batch = long.groupBy(batch, "c", "i").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_x")).alias("s"))
        overall = by_batch.groupBy("c", "i").agg((F.sum("s") / F.sum("n")).alias("m"))
        offset = by_batch.join(overall, ["c", "i"]).select(batch, "c", "i", ((F.col("s") - F.col("n") * F.col("m")) / (F.col("n") + ridge)).alias("o"))
        table = {}
        for r in offset.collect():  # batches x clusters x dimensions
            table.setdefault(r[batch], {})[(r["c"], r["i"])] = r["o"]
        dims = centres.shape[1]
        shifts = {b: np.array([[v.get((c, d), 0.0) for d in range(dims)] for c in range(len(centres))]) for b, v in table.items()}

        def correct(batches, shifts=shifts):
            for pdf in batches:
                moved = [np.array(v) - np.array(w) @ shifts[b] for v, w, b in zip(pdf["vec"], pdf["w"], pdf[batch])]
                out = pdf[["cell_id", batch]].copy()
                out["vec"] = moved
                yield out[["cell_id", "vec", batch]]

        current = materialize(soft.mapInPandas(correct, f"cell_id {types['cell_id']}, vec array<double>, {batch} {types[batch]}"))
    return current


# -------------------------------------------------------------------- registration
def detect_slice_key(obs: DataFrame) -> str | None:
    present = [c for c in SLICE_KEYS if c in obs.columns]
    if not present:
        return None
    counts = obs.agg(*[F.approx_count_distinct(c).alias(c) for c in present]).first()
    return next((c for c in present if counts[c] >= 2), None)


def rigid_align(obs: DataFrame, slice_key: str, reference) -> DataFrame:
    """Every slice centred and scaled to the reference: (cell_id, slice, x_aligned, y_aligned)."""
    sd = (F.stddev_pop("x") + F.stddev_pop("y")) / 2.0
    stats = obs.groupBy(slice_key).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.when(sd == 0, 1.0).otherwise(sd).alias("_sd"))
    ref = stats.filter(F.col(slice_key) == reference).select(F.col("_mx").alias("_rx"), F.col("_my").alias("_ry"), F.col("_sd").alias("_rs"))
    joined = obs.select("cell_id", slice_key, "x", "y").join(stats, slice_key).crossJoin(ref)  # one-row side
    same = F.col(slice_key) == reference
    move = lambda v, m, r: F.when(same, F.col(v)).otherwise((F.col(v) - F.col(m)) / F.col("_sd") * F.col("_rs") + F.col(r))
    return joined.select("cell_id", slice_key, "x", "y", move("x", "_mx", "_rx").alias("x_aligned"), move("y", "_my", "_ry").alias("y_aligned"))


def alignment_displacement(aligned: DataFrame, slice_key: str) -> DataFrame:
    d2 = F.pow(F.col("x_aligned") - F.col("x"), F.lit(2.0)) + F.pow(F.col("y_aligned") - F.col("y"), F.lit(2.0))
    return aligned.groupBy(slice_key).agg(F.sqrt(F.avg(d2)).alias("rms_displacement"))


def project_by_coupling(coupling: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """coupling(ref_id, cell_id, pi): barycentric coordinates per cell (column sum 0 counts as 1), and the disparity sum of pi^2."""
    rows = coupling.join(reference.select(F.col("cell_id").alias("ref_id"), "x", "y"), "ref_id")
    total = F.sum("pi")
    placed = rows.groupBy("cell_id").agg(*[(F.sum(F.col("pi") * F.col(c)) / F.when(total == 0, 1.0).otherwise(total)).alias(c) for c in "xy"])
    return placed, coupling.agg(F.sum(F.col("pi") * F.col("pi")).alias("disparity"))


def interpolate_slices(values: DataFrame, n: int) -> DataFrame:
    """values(slice, position, feature, value): n slices between each two consecutive ones."""
    order = values.select("slice").distinct()
    w = Window.orderBy("slice")  # the slices
    pairs = order.select(F.col("slice").alias("_a"), F.lead("slice").over(w).alias("_b")).filter("_b IS NOT NULL")
    a = values.select(F.col("slice").alias("_a"), "position", "feature", F.col("value").alias("_va"))
    b = values.select(F.col("slice").alias("_b"), "position", "feature", F.col("value").alias("_vb"))
    joined = a.join(pairs, "_a").join(b, ["_b", "position", "feature"]).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    alpha = F.col("step") / float(n + 1)
    return joined.select("_a", "_b", "step", "position", "feature", ((1.0 - alpha) * F.col("_va") + alpha * F.col("_vb")).alias("value"))


def idw_regrid(obs: DataFrame, value: str, steps: int = 20, k: int = 4, power: float = 2.0) -> DataFrame:
    """Inverse-distance mean of the k nearest cells on a regular grid over the extent."""
    spark = obs.sparkSession
    box = obs.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    grid = spark.range(steps * steps).crossJoin(box).select(  # one-row side
        F.col("id").alias("cell_id"), (F.col("x0") + (F.col("id") % steps) * (F.col("x1") - F.col("x0")) / (steps - 1)).alias("x"),
        (F.col("y0") + F.floor(F.col("id") / steps) * (F.col("y1") - F.col("y0")) / (steps - 1)).alias("y"))
    near = neighbors.knn_join(grid, obs.select("cell_id", "x", "y"), k, exclude_self=False).join(obs.select(F.col("cell_id").alias("dst"), F.col(value).alias("_v")), "dst")
    w = 1.0 / (F.pow("dist", F.lit(power)) + 1e-12)
    filled = near.groupBy(F.col("src").alias("cell_id")).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(value))
    return grid.join(filled, "cell_id").select(F.col("cell_id").alias("grid_id"), "x", "y", value)


# ---------------------------------------------------------------- image-derived
def tile_grid(images: DataFrame, patch: int = 256, stride: int | None = None, mask: DataFrame | None = None) -> DataFrame:
    """images(image_id, width, height) -> tiles; with mask(image_id, tx, ty) only tissue tiles stay."""
    stride = stride or patch
    count = lambda c: F.floor((F.col(c) - patch) / stride).cast("int") + 1
    fit = images.filter((F.col("width") >= patch) & (F.col("height") >= patch))
    tiles = fit.withColumn("tx", F.explode(F.sequence(F.lit(0), count("width") - 1))).withColumn("ty", F.explode(F.sequence(F.lit(0), count("height") - 1)))
    tiles = tiles.select("image_id", "tx", "ty", (F.col("tx") * stride).alias("x"), (F.col("ty") * stride).alias("y"))
    return tiles if mask is None else tiles.join(mask, ["image_id", "tx", "ty"], "left_semi")


def patch_intensity(pixels: DataFrame) -> DataFrame:
    """pixels(patch_id, r, g, b): grey mean, sd, median and range, and per-channel mean and sd."""
    rows = pixels.withColumn("_g", (F.col("r") + F.col("g") + F.col("b")) / 3.0)
    stats = rows.groupBy("patch_id").agg(F.avg("_g").alias("mean"), F.stddev_pop("_g").alias("std"), (F.max("_g") - F.min("_g")).alias("range"),
                                         *[f(c).alias(f"{c}_{n}") for c in "rgb" for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    return stats.join(S.exact_quantile(rows, ["patch_id"], "_g", 0.5, "median"), "patch_id")


def ihc_quantify(pixels: DataFrame, threshold: float = 0.1) -> DataFrame:
    """pixels(image_id, marker): positive share, mean and median, h-score and areas; positive means above threshold * max."""
    top = pixels.groupBy("image_id").agg(F.max("marker").alias("_max"))
    flagged = pixels.join(top, "image_id").withColumn("_p", F.col("marker") > threshold * F.col("_max"))
    positive = flagged.filter("_p")
    stats = flagged.groupBy("image_id").agg(F.count(F.lit(1)).alias("total_area"), F.sum(F.col("_p").cast("long")).alias("positive_area"), F.avg(F.when(F.col("_p"), F.col("marker"))).alias("_m"))
    mean, share = F.coalesce("_m", F.lit(0.0)), F.col("positive_area") / F.col("total_area")
    out = stats.join(S.exact_quantile(positive, ["image_id"], "marker", 0.5, "median_intensity"), "image_id", "left").na.fill(0.0, ["median_intensity"])
    return out.select("image_id", "total_area", "positive_area", share.alias("positive_fraction"), mean.alias("mean_intensity"), "median_intensity", (mean * (1.0 + 2.0 * share)).alias("h_score"))


def tissue_regions(mask: DataFrame, min_area: int) -> DataFrame:
    """mask(px, py) of dark pixels -> (px, py, region), 4-connected regions with at least ``min_area`` pixels."""
    at = mask.select("px", "py", F.concat_ws(",", "px", "py").alias("node"))
    right = at.select((F.col("px") - 1).alias("px"), "py", F.col("node").alias("b"))
    below = at.select("px", (F.col("py") - 1).alias("py"), F.col("node").alias("b"))
    links = at.join(right.unionByName(below), ["px", "py"]).select(F.col("node").alias("a"), "b")
    comp = connected_components(links, at.select("node"))
    big = comp.groupBy("component").agg(F.count(F.lit(1)).alias("area")).filter(F.col("area") >= min_area)
    return at.join(comp, "node").join(big, "component").select("px", "py", F.col("component").alias("region"), "area")


def attention_balance(weights: DataFrame) -> DataFrame:
    """weights(w1, w2): means, their entropy and entropy / ln 2."""
    means = weights.agg(F.avg("w1").alias("mean_w1"), F.avg("w2").alias("mean_w2"))
    h = -(F.col("mean_w1") * F.log(F.col("mean_w1") + 1e-10) + F.col("mean_w2") * F.log(F.col("mean_w2") + 1e-10))
    return means.withColumn("entropy", h).withColumn("balance", F.col("entropy") / F.log(F.lit(2.0)))


def reconstruction_mse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean squared error per modality of (modality, cell_id, feature, value) tables."""
    joined = a.join(b.withColumnRenamed("value", "_v"), ["modality", "cell_id", "feature"])
    return joined.groupBy("modality").agg(F.avg((F.col("value") - F.col("_v")) * (F.col("value") - F.col("_v"))).alias("mse"))


