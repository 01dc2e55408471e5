"""Tumour zones, lymphoid structures, cohort outcome, targets and regulation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cellweave.functions import reference_tables as ref
from cellweave.functions import stats as S
from cellweave.operators import neighbors
from cellweave.operators.communication import _group_means
from cellweave.operators.de import rank_genes_wilcoxon, top_per_group
from cellweave.session import materialize


def infer_types(obs: DataFrame, label: str, keywords=ref.TUMOR_WORDS) -> list[str]:
    """Type names holding a keyword, else the most common type."""
    counts = obs.groupBy(label).count().orderBy(F.desc("count"), label).collect()  # the cell types
    hits = [r[0] for r in counts if any(k in str(r[0]).lower() for k in keywords)]
    return hits or [counts[0][0]]


def tumor_zones(obs: DataFrame, label: str, tumor_types: list[str] | None = None, interface_width: float = 50.0) -> DataFrame:
    """(cell_id, zone, dist): core and edge by the median distance to the nearest other tumour cell, interface, stroma."""
    tumor_types = tumor_types or infer_types(obs, label)
    is_tumor = F.col(label).isin(tumor_types)
    tumor = obs.filter(is_tumor)
    n = tumor.count()
    if n < 10:
        return obs.select("cell_id", F.lit("insufficient_tumor").alias("zone"), F.lit(None).cast("double").alias("dist"))
    far = materialize(obs.select("cell_id", is_tumor.alias("_t")).join(neighbors.min_distance_to_set(obs, tumor), "cell_id"))
    core = S.exact_quantile(far.filter("_t"), [], "dist", 0.5, "_core")
    zone = F.when(F.col("_t") & (F.col("dist") <= F.col("_core")), "tumor_core").when(F.col("_t"), "tumor_edge").when(F.col("dist") <= interface_width, "interface").otherwise("stroma")
    return far.crossJoin(core).select("cell_id", zone.alias("zone"), "dist")  # one-row side


def interface_immune_fraction(zones: DataFrame, obs: DataFrame, label: str, immune=ref.IMMUNE_TYPES) -> DataFrame:
    rows = zones.join(obs.select("cell_id", label), "cell_id").filter("zone = 'interface'")
    return rows.agg(F.coalesce(F.avg(F.when(F.col(label).isin(list(immune)), 1.0).otherwise(0.0)), F.lit(0.0)).alias("interface_immune_fraction"))


def response_patterns(obs: DataFrame, column: str, response: str) -> DataFrame:
    """Share of each zone or type within responders and non-responders."""
    n = obs.groupBy(response, column).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(response).agg(F.sum("n").alias("_t"))
    return n.join(total, response).select(response, column, (F.col("n") / F.col("_t")).alias("share"))


# ----------------------------------------------------------------- lymphoid regions
def connected_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest node id reachable, by alternating star contractions.

    The number of rounds grows with the logarithm of the graph size.
    """
    und = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = materialize(und)
    while True:
        low = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = edges.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct())
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = small.groupBy("a").agg(F.min("b").alias("m"))
        star = small.join(root, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        new = materialize(star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        settled = new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = new
        if settled:
            break
    root = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m"))
    return nodes.join(root, "node", "left").select("node", F.least("node", F.coalesce("_m", "node")).alias("component"))


def dbscan(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """(cell_id, cluster): density clusters, -1 for noise; a point counts itself.

    Points sit in cells of diagonal ``eps``.  A cell holding ``min_pts`` points is
    core as a whole and one cluster, so pairs inside dense cells are never
    formed; other points have at most min_pts - 1 companions per cell.  Links
    between cells need one close core pair, found by a nearest-point join per
    target cell.
    """
    size = eps / np.sqrt(2.0)
    cells = points.select("cell_id", "x", "y", F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy"))
    n = cells.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("_n"))
    cells = materialize(cells.join(n, ["gx", "gy"]).withColumn("cell", F.concat_ws("/", "gx", "gy")))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4])
    reach = lambda df: df.withColumn("_o", F.explode(offsets)).withColumn("gx", F.col("gx") + F.col("_o.i")).withColumn("gy", F.col("gy") + F.col("_o.j")).drop("_o")
    sparse = cells.filter(F.col("_n") < min_pts)
    other = cells.select("gx", "gy", F.col("cell_id").alias("_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    counted = reach(sparse.select("cell_id", "x", "y", "gx", "gy")).join(other, ["gx", "gy"]).filter(d2 <= eps * eps).groupBy("cell_id").agg(F.count(F.lit(1)).alias("_c"))
    core_ids = counted.filter(F.col("_c") >= min_pts).select("cell_id").union(cells.filter(F.col("_n") >= min_pts).select("cell_id"))
    core = materialize(cells.join(core_ids, "cell_id", "left_semi").select("cell_id", "x", "y", "gx", "gy", "cell"))
    occupied = core.select("gx", "gy", F.col("cell").alias("target")).distinct()
    asks = reach(core.select("cell_id", "x", "y", "gx", "gy", "cell")).join(occupied, ["gx", "gy"]).filter("cell <> target")
    near = neighbors.knn_join(asks.select("cell_id", "x", "y", "target", "cell"), core.select("cell_id", "x", "y", F.col("cell").alias("target")), 1, by=["target"], exclude_self=False)
    links = near.filter(F.col("dist") <= eps).join(core.select(F.col("cell_id").alias("src"), "cell"), "src").select(F.col("cell").alias("a"), F.col("target").alias("b")).distinct()
    comp = connected_components(links, core.select(F.col("cell").alias("node")).distinct())
    named = materialize(core.join(comp.withColumnRenamed("node", "cell"), "cell").select("cell_id", "x", "y", "component"))
    border = cells.join(core.select("cell_id"), "cell_id", "left_anti").select("cell_id", "x", "y")
    touch = neighbors.knn_join(border, named.select("cell_id", "x", "y"), 1, exclude_self=False).filter(F.col("dist") <= eps).select(F.col("src").alias("cell_id"), F.col("dst").alias("_core"))
    joined = named.select("cell_id", "component").unionByName(touch.join(named.select(F.col("cell_id").alias("_core"), "component"), "_core").select("cell_id", "component"))
    first = named.groupBy("component").agg(F.min("cell_id").alias("cluster"))
    if not isinstance(points.schema["cell_id"].dataType, IntegralType):  # other ids: clusters are numbered in the order of their smallest member
        first = first.withColumn("cluster", F.row_number().over(Window.orderBy("cluster")) - 1)  # one row per cluster
    return points.select("cell_id").join(joined.join(first, "component").select("cell_id", F.col("cluster").cast("long").alias("cluster")), "cell_id", "left").na.fill(-1, ["cluster"])


def centroids(points: DataFrame, clusters: DataFrame) -> DataFrame:
    return points.join(clusters.filter("cluster >= 0"), "cell_id").groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))


def colocated_regions(b: DataFrame, t: DataFrame, radius: float) -> DataFrame:
    """Pairs of B and T centroids closer than 2r, by a grid join; the midpoint is the centre."""
    size = 2.0 * radius
    left = neighbors._ring(b.select(F.col("cluster").alias("b_cluster"), F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("n").alias("n_b")).withColumn("gx", F.floor(F.col("bx") / size)).withColumn("gy", F.floor(F.col("by") / size)))
    right = t.select(F.col("cluster").alias("t_cluster"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("n").alias("n_t")).withColumn("gx", F.floor(F.col("tx") / size)).withColumn("gy", F.floor(F.col("ty") / size))
    d = F.sqrt((F.col("bx") - F.col("tx")) * (F.col("bx") - F.col("tx")) + (F.col("by") - F.col("ty")) * (F.col("by") - F.col("ty")))
    pairs = left.join(right, ["gx", "gy"]).withColumn("distance", d).filter(F.col("distance") < size)
    pairs = pairs.select("b_cluster", "t_cluster", ((F.col("bx") + F.col("tx")) / 2.0).alias("x"), ((F.col("by") + F.col("ty")) / 2.0).alias("y"), "n_b", "n_t", "distance")
    return pairs.withColumn("region_id", F.row_number().over(Window.orderBy("b_cluster", "t_cluster")) - 1)  # cluster pairs only


def assign_region(obs: DataFrame, regions: DataFrame, radius: float) -> DataFrame:
    """(cell_id, region): the last region within 1.5 r of the cell, else -1."""
    size = 1.5 * radius
    left = neighbors._ring(obs.select("cell_id", "x", "y").withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size)))
    right = regions.select("region_id", F.col("x").alias("rx"), F.col("y").alias("ry")).withColumn("gx", F.floor(F.col("rx") / size)).withColumn("gy", F.floor(F.col("ry") / size))
    d2 = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    hit = left.join(right, ["gx", "gy"]).filter(d2 <= size * size).groupBy("cell_id").agg(F.max("region_id").alias("region"))
    return obs.select("cell_id").join(hit, "cell_id", "left").na.fill(-1, ["region"])


def region_maturity(expr: DataFrame, regions: DataFrame, markers: DataFrame) -> DataFrame:
    """Score .4 GC + .3 FH + .3 DC by the share of markers(kind, gene_id) expressed inside the region."""
    inside = regions.filter("region >= 0")
    sizes = markers.groupBy("kind").agg(F.countDistinct("gene_id").alias("_k"))
    seen = expr.filter("value > 0").join(inside, "cell_id").join(markers, "gene_id").groupBy("region", "kind").agg(F.countDistinct("gene_id").alias("_n"))
    share = seen.join(sizes, "kind").withColumn("_s", F.least(F.col("_n") / F.col("_k"), F.lit(1.0)))
    weight = F.when(F.col("kind") == "germinal_center", 0.4).when(F.col("kind").isin("follicular_helper", "dendritic"), 0.3).otherwise(0.0)
    scored = inside.select("region").distinct().join(share.groupBy("region").agg(F.sum(weight * F.col("_s")).alias("score")), "region", "left").na.fill(0.0, ["score"])
    return scored.withColumn("maturity", F.when(F.col("score") > 0.6, "mature").when(F.col("score") > 0.3, "intermediate").otherwise("early"))


def maturity_markers(spark: SparkSession, species: str = "human") -> DataFrame:
    table = ref.MATURITY_MARKERS.get(species, ref.MATURITY_MARKERS["human"])
    return spark.createDataFrame([(k, g) for k, names in table.items() for g in names], "kind string, gene_id string")


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) <= 2:
        return pts

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def region_ecosystem(obs: DataFrame, regions: DataFrame, parts: int = 64) -> DataFrame:
    """Per region: cells, hull area (0 for up to two points) and density n / max(area, 1).

    A region is reduced to hull corners in hash parts first, so a large one never
    meets a task whole.
    """
    import pandas as pd

    rows = obs.select("cell_id", "x", "y").join(regions.filter("region >= 0"), "cell_id")
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n_cells"))

    def corners(pdf):
        hull = _hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"region": pdf["region"].iloc[0], "x": hull[:, 0], "y": hull[:, 1]})

    def area(pdf):
        h = _hull(pdf[["x", "y"]].to_numpy(float))
        value = 0.0 if len(h) <= 2 else 0.5 * abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1)))
        return pd.DataFrame({"region": [pdf["region"].iloc[0]], "area": [float(value)]})

    kind = dict(rows.dtypes)["region"]
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("cell_id"), F.lit(parts)))
    reduced = salted.groupBy("region", "_s").applyInPandas(corners, f"region {kind}, x double, y double")
    areas = reduced.groupBy("region").applyInPandas(area, f"region {kind}, area double")
    return sizes.join(areas, "region").withColumn("density", F.col("n_cells") / F.greatest("area", F.lit(1.0)))


# ------------------------------------------------------------------------ survival
def _risk_table(cohort: DataFrame, group: list[str], time: str, event: str) -> DataFrame:
    """Per (group, time): events, and the number still at risk (from bucketed counts)."""
    ev = cohort.groupBy(*group, time).agg(F.sum(F.col(event).cast("long")).alias("d"))
    before = S.cumulative_counts(cohort.select(*group, time), group, time)
    total = cohort.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    joined = before.join(total, group) if group else before.crossJoin(total)  # one-row side
    return joined.join(ev, [*group, time]).select(*group, time, "d", (F.col("_n") - F.col("n_before")).alias("at_risk"))


def kaplan_meier(cohort: DataFrame, group: str, time: str = "time", event: str = "event") -> DataFrame:
    """Survival after each event time, exp of the running sum of log(1 - d / n).

    The sums run inside buckets of time, and over the buckets' totals.
    """
    risk = S.range_buckets(materialize(_risk_table(cohort, [group], time, event).filter("d > 0")), time, "_b")
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1.0 - F.col("d") / F.col("at_risk"))).otherwise(0.0)
    dead = (F.col("d") == F.col("at_risk")).cast("int")
    across = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # buckets of a group
    totals = risk.groupBy(group, "_b").agg(F.sum(step).alias("_s"), F.max(dead).alias("_d")).select(
        group, "_b", F.coalesce(F.sum("_s").over(across), F.lit(0.0)).alias("_s"), F.coalesce(F.max("_d").over(across), F.lit(0)).alias("_d"))
    w = Window.partitionBy(group, "_b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    run = risk.withColumn("_own", F.sum(step).over(w)).withColumn("_dead", F.max(dead).over(w)).join(totals, [group, "_b"])
    alive = F.greatest("_dead", "_d") == 0
    return run.select(group, time, "d", "at_risk", F.when(alive, F.exp(F.col("_own") + F.col("_s"))).otherwise(0.0).alias("survival"))


def median_survival(curve: DataFrame, group: str, time: str = "time") -> DataFrame:
    low = curve.filter("survival <= 0.5").groupBy(group).agg(F.min(time).alias("median"))
    return curve.select(group).distinct().join(low, group, "left")


def logrank(cohort: DataFrame, group: str, a, time: str = "time", event: str = "event") -> DataFrame:
    """One row: chi-square and p of group ``a`` against everyone else."""
    flagged = cohort.select(time, event, (F.col(group) == a).cast("long").alias("_a"))
    whole = _risk_table(flagged, [], time, event)
    own = flagged.filter("_a = 1").groupBy(time).agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col(event).cast("long")).alias("_d1"))
    n1 = flagged.agg(F.sum("_a").alias("_n1"))
    rows = whole.join(own, time, "left").na.fill(0).crossJoin(n1)  # one-row side
    rows = S.range_buckets(materialize(rows), time, "_b")
    inside = Window.partitionBy("_b").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_b").agg(F.sum("_c").alias("_t")).select("_b", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_o"))  # value buckets
    rows = rows.join(totals, "_b").withColumn("r1", F.col("_n1") - F.col("_o") - F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    n, d, r1 = F.col("at_risk"), F.col("d"), F.col("r1")
    e = d * r1 / n
    v = F.when(n > 1, d * (r1 / n) * (1 - r1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    out = rows.agg(F.sum("_d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    chi = (F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")) / F.col("variance")
    return out.withColumn("chi2", chi).withColumn("pvalue", S.norm_pvalue(F.sqrt(chi)))


def concordance(cohort: DataFrame, time: str = "time", event: str = "event", risk: str = "partial_hazard") -> DataFrame:
    """One row (n_pairs, n_correct, n_tied, concordance): how often the earlier event has the higher risk.

    A pair counts if the earlier of the two is an event; at one time an event comes before the censored,
    and two events don't count.  Pairs are counted, never made: places in the order of time are split
    by their bits, so that each pair differs first in exactly one bit and meets in the group of the bits
    above; there one pass over the risks counts those that stand right.  A row takes part in about log2 n
    groups, whose risks are split over buckets.  Rows with a null are left out.
    """
    known = cohort.select((F.col(event).cast("int") == 1).alias("e"), F.col(time).alias("t"), F.col(risk).cast("double").alias("r")).dropna()
    kinds = materialize(known.groupBy("t", "e", "r").agg(F.count(F.lit(1)).alias("n")))
    times = S.cumulative_counts(kinds.select("t"), [], "t").select("t", (F.col("n_before") * 2).alias("_p"))
    spots = S.range_buckets(materialize(kinds.select("r").distinct()), "r", "_bucket")
    # of one time, the censored stand behind the events
    placed = materialize(kinds.join(times, "t").join(spots, "r").select((F.col("_p") + F.when(F.col("e"), 0).otherwise(1)).alias("p"), "e", "r", "_bucket", "n"))
    last = placed.agg(F.max("p")).first()[0] or 0
    levels = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.shiftright("p", b + 1).alias("g"), F.shiftright("p", b).bitwiseAND(F.lit(1)).alias("late")) for b in range(max(1, int(last).bit_length()))]))
    split = placed.select("e", "r", "_bucket", "n", levels.alias("l")).filter("l.late = 1 OR e")
    early, late = F.sum(F.when(F.col("l.late") == 0, F.col("n")).otherwise(0)), F.sum(F.when(F.col("l.late") == 1, F.col("n")).otherwise(0))
    cells = materialize(split.groupBy("l.b", "l.g", "_bucket", "r").agg(early.alias("early"), late.alias("late")))
    group = ["b", "g"]
    higher = Window.partitionBy(*group).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)  # buckets of a group
    above = cells.groupBy(*group, "_bucket").agg(F.sum("early").alias("_n")).select(*group, "_bucket", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("_in", F.coalesce(F.sum("early").over(inside), F.lit(0))).join(above, [*group, "_bucket"])
    pairs = cells.groupBy(*group).agg(F.sum("early").alias("a"), F.sum("late").alias("b_")).agg(F.sum(F.col("a") * F.col("b_")).alias("n_pairs"))
    right = counted.agg(F.sum(F.col("late") * (F.col("_above") + F.col("_in"))).alias("n_correct"), F.sum(F.col("late") * F.col("early")).alias("n_tied"))
    value = F.when(F.col("n_pairs") > 0, (F.col("n_correct") + F.col("n_tied") / 2.0) / F.col("n_pairs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pairs.crossJoin(right).select(zero("n_pairs"), zero("n_correct"), zero("n_tied")).withColumn("concordance", value)  # one-row sides


def cox_ph(cohort: DataFrame, features: list[str], time: str = "time", event: str = "event", rounds: int = 25, ridge: float = 1e-9) -> tuple[DataFrame, np.ndarray]:
    """Breslow proportional hazards: risk-set suffix sums in Spark, a small Newton step on the driver.

    Returns the rows with ``partial_hazard`` and the coefficients.
    """
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    means = cohort.agg(*[F.avg(f) for f in features]).first()
    x = [F.col(f) - F.lit(float(m)) for f, m in zip(features, means)]
    beta = np.zeros(k)
    rows = materialize(S.range_buckets(materialize(cohort.select(time, event, *[e.alias(f"x{i}") for i, e in enumerate(x)])), time, "_b"))
    names = ["w"] + [f"w{i}" for i in range(k)] + [f"w{i}_{j}" for i, j in pairs]
    for _ in range(rounds):
        risk = F.exp(sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)))
        terms = [risk] + [risk * F.col(f"x{i}") for i in range(k)] + [risk * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs]
        at = rows.groupBy("_b", time).agg(F.sum(F.col(event).cast("double")).alias("d"), *[F.sum(F.when(F.col(event).cast("int") == 1, F.col(f"x{i}")).otherwise(0.0)).alias(f"e{i}") for i in range(k)],
                                          *[F.sum(tm).alias(nm) for tm, nm in zip(terms, names)])
        inside, across = Window.partitionBy("_b").orderBy(F.desc(time)), Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
        later = at.groupBy("_b").agg(*[F.sum(n).alias(n) for n in names]).select("_b", *[F.coalesce(F.sum(n).over(across), F.lit(0.0)).alias(f"_{n}") for n in names])  # value buckets
        sets = at.join(later, "_b").select("d", *[f"e{i}" for i in range(k)], *[(F.sum(n).over(inside) + F.col(f"_{n}")).alias(n) for n in names]).filter("d > 0")
        grad = [F.sum(F.col(f"e{i}") - F.col("d") * F.col(f"w{i}") / F.col("w")) for i in range(k)]
        hess = [F.sum(F.col("d") * (F.col(f"w{i}_{j}") / F.col("w") - F.col(f"w{i}") * F.col(f"w{j}") / F.col("w") / F.col("w"))) for i, j in pairs]
        values = [float(v) for v in sets.agg(*grad, *hess).first()]
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, values[k:]):
            h[i, j] = h[j, i] = v
        step = np.linalg.solve(h + ridge * np.eye(k), np.array(values[:k]))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    else:
        raise RuntimeError(f"the coefficients still move by {np.abs(step).max()} after {rounds} Newton steps")
    hazard = F.exp(sum((e * float(b) for e, b in zip(x, beta)), F.lit(0.0)))
    return cohort.withColumn("partial_hazard", hazard), beta


# ------------------------------------------------------------------------- targets
def domain_biomarkers(expr: DataFrame, obs: DataFrame, domain: str, n: int = 50) -> DataFrame:
    """(domain, gene, scores, pvals, logfoldchanges, rank): the ``n`` genes of highest rank-sum score of each domain."""
    markers = rank_genes_wilcoxon(expr, obs, domain).withColumn("_s", F.round("scores", 9))
    return top_per_group(markers, ["group"], [F.desc("_s"), "gene_id"], n).select(
        F.col("group").alias("domain"), F.col("gene_id").alias("gene"), "scores", "pvals", "logfoldchanges", "rank")


def prioritize_targets(biomarkers: DataFrame, druggable: DataFrame, literature: DataFrame) -> DataFrame:
    """biomarkers(domain, gene): score = .4 freq / max + .4 druggable + .2 literature."""
    freq = biomarkers.select("domain", "gene").groupBy("gene").agg(F.count(F.lit(1)).alias("spatial_frequency"))
    top = freq.agg(F.max("spatial_frequency").alias("_max"))
    rows = freq.crossJoin(top)  # one-row side
    for name, table in (("druggability", druggable), ("literature_relevance", literature)):
        rows = rows.join(table.select("gene").distinct().withColumn(name, F.lit(1.0)), "gene", "left").na.fill(0.0, [name])
    score = 0.4 * F.col("spatial_frequency") / F.col("_max") + 0.4 * F.col("druggability") + 0.2 * F.col("literature_relevance")
    return rows.withColumn("priority_score", score).drop("_max")


def gene_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(g,) for g in names], "gene string")


def annotate_drugs(targets: DataFrame, n: int = 20) -> DataFrame:
    """The top targets with their approved, investigational and repurposing drugs."""
    spark = targets.sparkSession
    drugs = [(g, list(names), kind) for kind, table in (("approved", ref.APPROVED_DRUGS), ("investigational", ref.INVESTIGATIONAL_DRUGS), ("repurposing", ref.REPURPOSING)) for g, names in table.items()]
    table = spark.createDataFrame(drugs, "gene string, drugs array<string>, kind string")
    out = targets.orderBy(F.desc("priority_score"), "gene").limit(n)
    for kind in ("approved", "investigational", "repurposing"):
        out = out.join(table.filter(F.col("kind") == kind).select("gene", F.col("drugs").alias(kind)), "gene", "left").withColumn(kind, F.coalesce(kind, F.array().cast("array<string>")))
    return out


def evidence_summary(biomarkers: DataFrame, drugs: DataFrame) -> DataFrame:
    found = biomarkers.agg(F.countDistinct("domain").alias("n_domains"), F.countDistinct("gene").alias("n_genes"))
    return found.crossJoin(drugs.agg(F.count(F.lit(1)).alias("n_targets"), F.count(F.when(F.size("approved") > 0, 1)).alias("n_with_approved")))  # one-row sides


# ---------------------------------------------------------------------- regulation
def tf_activity(expr: DataFrame, obs: DataFrame, tfs: DataFrame) -> DataFrame:
    """Mean expression of each transcription factor over all cells."""
    n = obs.agg(F.count(F.lit(1)).alias("_n"))
    sums = tfs.select("gene_id").join(expr.join(tfs.select("gene_id"), "gene_id", "left_semi").groupBy("gene_id").agg(F.sum("value").alias("_s")), "gene_id", "left").na.fill(0.0)
    return sums.crossJoin(n).select("gene_id", (F.col("_s") / F.col("_n")).alias("activity"))  # one-row side


def sparse_correlations(expr: DataFrame, obs: DataFrame, tfs: DataFrame) -> DataFrame:
    """(tf, gene_id, r): Pearson of each factor with each gene it shares a cell with, or with all in closed form."""
    from cellweave.operators.features import gene_stats

    stats = gene_stats(expr, obs).select("gene_id", "n", "total", "sumsq")
    a = expr.join(tfs.select("gene_id"), "gene_id", "left_semi").select("cell_id", F.col("gene_id").alias("tf"), F.col("value").alias("_a"))
    cross = a.join(expr, "cell_id").filter("tf <> gene_id").groupBy("tf", "gene_id").agg(F.sum(F.col("_a") * F.col("value")).alias("_ab"))
    sa = stats.select(F.col("gene_id").alias("tf"), "n", F.col("total").alias("ta"), F.col("sumsq").alias("qa"))
    sb = stats.select("gene_id", F.col("total").alias("tb"), F.col("sumsq").alias("qb"))
    n = F.col("n")
    den = F.sqrt((n * F.col("qa") - F.col("ta") * F.col("ta")) * (n * F.col("qb") - F.col("tb") * F.col("tb")))
    return cross.join(sa, "tf").join(sb, "gene_id").filter(den > 0).select("tf", "gene_id", ((n * F.col("_ab") - F.col("ta") * F.col("tb")) / den).alias("r"))


def coexpression_regulons(expr: DataFrame, obs: DataFrame, tfs: DataFrame, top: int = 50, min_r: float = 0.1) -> DataFrame:
    """Per factor the ``top`` genes of largest |r|, of which r > min_r are kept."""
    return top_per_group(sparse_correlations(expr, obs, tfs), ["tf"], [F.round(F.abs("r"), 9).desc(), "gene_id"], top).filter(F.col("r") > min_r)


def regulon_activity(expr: DataFrame, obs: DataFrame, regulons: DataFrame) -> DataFrame:
    """Per cell and factor: mean of the target genes."""
    sizes = regulons.groupBy("tf").agg(F.countDistinct("gene_id").alias("_k"))
    sums = expr.join(regulons.select("tf", "gene_id"), "gene_id").groupBy("cell_id", "tf").agg(F.sum("value").alias("_s"))
    return sums.join(sizes, "tf").select("cell_id", "tf", (F.col("_s") / F.col("_k")).alias("activity"))


def peak_gene_links(peaks: DataFrame, genes: DataFrame, window: int = 100_000) -> DataFrame:
    """Peaks(chromosome, pos, peak_id) within ``window`` of a gene start, by a bucketed range join."""
    left = peaks.withColumn("_b", F.explode(F.array(*[F.floor(F.col("pos") / window) + i for i in (-1, 0, 1)])))
    right = genes.select("chromosome", "gene_id", "start").withColumn("_b", F.floor(F.col("start") / window))
    return left.join(right, ["chromosome", "_b"]).withColumn("distance", F.abs(F.col("pos") - F.col("start"))).filter(F.col("distance") <= window).drop("_b")


def cluster_profile(expr: DataFrame, obs: DataFrame, groupby: str) -> DataFrame:
    return _group_means(expr, obs.select("cell_id", F.col(groupby).cast("string").alias("label")))


def spatial_regulons(expr: DataFrame, obs: DataFrame, tfs: DataFrame, k: int = 15, top: int = 30, min_score: float = 0.1) -> DataFrame:
    """Per factor the ``top`` genes by .5 |r| + .5 |mean local r|, those above ``min_score``.

    A local r is taken over the k nearest cells (self included) of every cell in
    whose window both genes vary; windows hold k cells, so every step is an
    aggregate over a bounded neighbourhood.
    """
    from cellweave.operators.features import gene_stats

    near = materialize(neighbors.knn_spatial(obs, k, include_self=True).select("src", "dst"))
    spread = lambda s, q, n: n * F.col(q) - F.col(s) * F.col(s)
    varies = spread("s", "q", F.lit(float(k))) > 1e-9
    own = expr.join(tfs.select("gene_id"), "gene_id", "left_semi").withColumnRenamed("cell_id", "dst")
    factor = near.join(own, "dst").groupBy("src", "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).filter(varies)
    factor = materialize(factor.select("src", F.col("gene_id").alias("tf"), F.col("s").alias("st"), F.col("q").alias("qt")))
    # only windows in which a factor varies have a local r
    near = materialize(near.join(factor.select("src"), "src", "left_semi"))
    squares = expr.select("cell_id", "gene_id", F.col("value").alias("s"), (F.col("value") * F.col("value")).alias("q"))
    window = neighbors.neighborhood_sums(near, squares, ["s", "q"], obs).filter(varies)
    a = expr.join(tfs.select("gene_id"), "gene_id", "left_semi").select("cell_id", F.col("gene_id").alias("tf"), F.col("value").alias("_a"))
    product = materialize(a.join(expr, "cell_id").filter("tf <> gene_id").select("cell_id", "tf", "gene_id", (F.col("_a") * F.col("value")).alias("_ab")))
    local = near.join(product.withColumnRenamed("cell_id", "dst"), "dst").groupBy("src", "tf", "gene_id").agg(F.sum("_ab").alias("_ab"))
    pairs = factor.join(window, "src").filter("tf <> gene_id").join(local, ["src", "tf", "gene_id"], "left")
    r_local = (k * F.coalesce("_ab", F.lit(0.0)) - F.col("st") * F.col("s")) / F.sqrt(spread("st", "qt", F.lit(float(k))) * spread("s", "q", F.lit(float(k))))
    mean_local = pairs.groupBy("tf", "gene_id").agg(F.avg(r_local).alias("local_r"))
    stats = gene_stats(expr, obs).select("gene_id", "n", "total", "sumsq")
    whole = mean_local.join(product.groupBy("tf", "gene_id").agg(F.sum("_ab").alias("_ab")), ["tf", "gene_id"], "left")
    whole = whole.join(stats.select(F.col("gene_id").alias("tf"), "n", F.col("total").alias("ta"), F.col("sumsq").alias("qa")), "tf").join(
        stats.select("gene_id", F.col("total").alias("tb"), F.col("sumsq").alias("qb")), "gene_id")
    den = F.sqrt(F.greatest(spread("ta", "qa", F.col("n")) * spread("tb", "qb", F.col("n")), F.lit(0.0)))
    r = F.when(den > 0, (F.col("n") * F.coalesce("_ab", F.lit(0.0)) - F.col("ta") * F.col("tb")) / den).otherwise(0.0)
    scored = whole.select("tf", "gene_id", r.alias("r"), "local_r").withColumn("score", 0.5 * F.abs("r") + 0.5 * F.abs("local_r"))
    return top_per_group(scored, ["tf"], [F.round("score", 9).desc(), "gene_id"], top).filter(F.col("score") > min_score)
