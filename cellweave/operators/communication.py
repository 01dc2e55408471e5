"""Ligand-receptor scoring between cell types and its summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.functions.reference_tables import LR_PAIRS
from cellweave.session import materialize


def curated_pairs(spark: SparkSession, species: str = "human") -> DataFrame:
    return spark.createDataFrame(list(LR_PAIRS.get(species, LR_PAIRS["human"])), "ligand string, receptor string")


def resolve_lr_pairs(pairs: DataFrame, var: DataFrame) -> DataFrame:
    """Pairs whose two genes exist, matched without regard to case; ids come from ``var(gene_id, symbol)``."""
    known = var.groupBy(F.upper("symbol").alias("_k")).agg(F.min("gene_id").alias("_id"))
    left = pairs.join(known.withColumnRenamed("_id", "ligand_id"), F.upper("ligand") == F.col("_k")).drop("_k")
    return left.join(known.withColumnRenamed("_id", "receptor_id"), F.upper("receptor") == F.col("_k")).drop("_k")


def _group_means(expr: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, gene_id, mean, share): zeros count; ``labels`` holds (by, cell_id, label)."""
    sizes = labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_n"))
    sums = expr.join(labels, "cell_id").groupBy(*by, "label", "gene_id").agg(
        F.sum("value").alias("_s"), F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("_nz")
    )
    return sums.join(sizes, [*by, "label"]).select(
        *by, "label", "gene_id", (F.col("_s") / F.col("_n")).alias("mean"), (F.col("_nz") / F.col("_n")).alias("share")
    )


def _pair_up(means: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ligand = means.select(*by, F.col("label").alias("source"), F.col("gene_id").alias("ligand"), F.col("mean").alias("l_mean"), F.col("share").alias("l_share"))
    receptor = means.select(*by, F.col("label").alias("target"), F.col("gene_id").alias("receptor"), F.col("mean").alias("r_mean"), F.col("share").alias("r_share"))
    return pairs.join(ligand, "ligand").join(receptor, [*by, "receptor"])


def _gene_sums(chosen: DataFrame, labels: DataFrame, names: list[str], n_perms: int, seed: int) -> DataFrame:
    """(gene_id, sums, shares): per gene a value for each permutation and label, NaN where no value is.

    Permutation 0 is the real labelling.  A cell carries its codes, permutation times labels plus label, so
    the matrix is shuffled once, whatever the number of permutations, and every labelling adds in the same order.
    """
    listed = labels.sparkSession.createDataFrame([(name, i) for i, name in enumerate(names)], "label string, _i int")
    every = labels.select(F.lit(0).alias("perm"), "cell_id", "label")
    if n_perms:
        every = every.unionByName(S.permute_labels(labels, "cell_id", "label", n_perms, seed))
    width = (n_perms + 1) * len(names)
    code = (F.col("perm") * len(names) + F.col("_i")).cast("smallint" if width < 2**15 else "int")
    codes = materialize(every.join(listed, "label").groupBy("cell_id").agg(F.collect_list(code).alias("_codes")))  # one entry per permutation
    rows = chosen.select("cell_id", "gene_id", F.col("value").cast("double").alias("value")).join(codes, "cell_id")
    rows = rows.repartition("gene_id").sortWithinPartitions("gene_id", "cell_id").select("gene_id", "value", "_codes")
    n_names = len(names)

    def add(batches):
        last, held = None, None
        for pdf in batches:
            genes, value = pdf["gene_id"].to_numpy(), pdf["value"].to_numpy(dtype=float)
            if not len(genes):
                continue
            starts = np.flatnonzero(np.r_[True, genes[1:] != genes[:-1]])
            done, lengths = [], pdf["_codes"].map(len).to_numpy()
            many = max(1, 1_000_000 // width)
            for at in range(0, len(starts), many):  # some genes at a time, so that their tables stay small
                some = starts[at : at + many]
                end = starts[at + many] if at + many < len(starts) else len(genes)
                part = slice(some[0], end)
                run = np.searchsorted(some, np.arange(some[0], end), "right") - 1
                place = np.repeat(run * width, lengths[part]) + np.concatenate(pdf["_codes"].iloc[part].to_list()).astype(np.int64)
                number = np.repeat(value[part], lengths[part])
                known = ~np.isnan(number)
                tables = [np.bincount(place[ok], weight[ok] if weight is not None else None, len(some) * width).reshape(len(some), width).astype(float)
                          for ok, weight in ((known, number), (known, None), (known & (number > 0), None))]
                for k, start in enumerate(some):
                    mine = [table[k] for table in tables]
                    if last is not None and last == genes[start]:
                        held = [a + b for a, b in zip(held, mine)]
                        continue
                    if last is not None:
                        done.append((last, *held))
                    last, held = genes[start], mine
            if done:
                yield finished(done)
        if last is not None:
            yield finished([(last, *held)])

    def finished(done):
        return pd.DataFrame({
            "gene_id": [d[0] for d in done], "sums": [np.where(d[2] > 0, d[1], np.nan) for d in done], "positive": [d[3][:n_names].astype(np.int64) for d in done],
        })

    return rows.mapInPandas(add, f"gene_id {dict(chosen.dtypes)['gene_id']}, sums array<double>, positive array<bigint>")


def lr_score(expr: DataFrame, obs: DataFrame, pairs: DataFrame, groupby: str, n_perms: int = 100, seed: int = 42,
             mode: str = "product", min_share: float = 0.0, digits: int = 6) -> DataFrame:
    """Score and permutation p of every (ligand, receptor, source, target).

    ``pairs(ligand, receptor)`` holds gene ids.  ``mode`` is the product of the
    two group means, or their average; ``min_share`` is the expressing share both
    genes need.  Non-positive scores are dropped.
    """
    labels = obs.select("cell_id", F.col(groupby).cast("string").alias("label"))
    genes = pairs.select(F.col("ligand").alias("gene_id")).unionByName(pairs.select(F.col("receptor").alias("gene_id"))).distinct()
    chosen = expr.join(genes, "gene_id", "left_semi")
    sizes = {r[0]: r[1] for r in labels.filter(F.col("label").isNotNull()).groupBy("label").count().collect()}  # the labels
    names = sorted(sizes)
    n, n_names = np.array([sizes[name] for name in names], float), len(names)
    sums = materialize(_gene_sums(chosen, labels, names, n_perms, seed))
    side = lambda name, short: sums.select(F.col("gene_id").alias(name), F.col("sums").alias(f"_{short}"), F.col("positive").alias(f"_{short}p"))
    listed = pairs.groupBy("ligand", "receptor").agg(F.count(F.lit(1)).alias("_k"))
    joined = listed.join(side("ligand", "l"), "ligand").join(side("receptor", "r"), "receptor")
    many = max(1, 1_000_000 // max((n_perms + 1) * n_names * n_names, 1))

    def score(batches):
        for whole in batches:
            for at in range(0, len(whole), many):  # some pairs at a time: they meet in all labels and permutations
                pdf = whole.iloc[at : at + many]
                left, right = (np.stack(pdf[c].to_list()).reshape(len(pdf), n_perms + 1, n_names) / n for c in ("_l", "_r"))
                ls, rs = (np.stack(pdf[c].to_list()) / n for c in ("_lp", "_rp"))
                meet = left[:, :, :, None] * right[:, :, None, :] if mode == "product" else (left[:, :, :, None] + right[:, :, None, :]) / 2.0
                with np.errstate(invalid="ignore"):
                    beyond = (meet[:, 1:] >= meet[:, :1]).sum(axis=1)  # a gene absent from the group never exceeds
                    both = (left[:, 0, :, None] > 0) & (right[:, 0, None, :] > 0) & (ls[:, :, None] >= min_share) & (rs[:, None, :] >= min_share)
                row, source, target = np.nonzero(both)
                yield pd.DataFrame({
                    "ligand": pdf["ligand"].to_numpy()[row], "receptor": pdf["receptor"].to_numpy()[row], "source": np.array(names, object)[source],
                    "target": np.array(names, object)[target], "score": meet[:, 0][row, source, target], "_x": beyond[row, source, target], "_k": pdf["_k"].to_numpy()[row],
                })

    types = dict(pairs.dtypes)
    seen = joined.mapInPandas(score, f"ligand {types['ligand']}, receptor {types['receptor']}, source string, target string, score double, _x long, _k long")
    # A pair listed k times has k rows, each compared with every copy of its permuted rows.
    seen = seen.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    pvalue = S.perm_pvalue(F.col("_x") * F.col("_k") * F.col("_k"), n_perms) if n_perms else F.lit(1.0)
    return seen.select("ligand", "receptor", "source", "target", F.round("score", digits).alias("score"), F.round(pvalue, digits).alias("pvalue"))


def lr_score_thresholded(expr, obs, pairs, groupby, threshold: float = 0.1, n_perms: int = 1000, seed: int = 42) -> DataFrame:
    """Mean-of-means statistic for genes expressed in enough of both groups; scores under 1e-6 go."""
    scored = lr_score(expr, obs, pairs, groupby, n_perms, seed, "mean", threshold, 4)
    return scored.filter(F.col("score") >= 1e-6)


def consensus_rank(expr: DataFrame, obs: DataFrame, pairs: DataFrame, groupby: str) -> DataFrame:
    """Robust rank aggregation of magnitude and of specificity scorers.

    score = 1 - magnitude rank, pvalue = specificity rank.
    """
    labels = obs.select("cell_id", F.col(groupby).cast("string").alias("label"))
    means = _group_means(expr, labels)
    per_gene = means.groupBy("gene_id").agg(F.sum("mean").alias("_sum"), F.avg("mean").alias("_avg"))
    rows = _pair_up(means, pairs)
    for side in ("ligand", "receptor"):
        rows = rows.join(per_gene.select(F.col("gene_id").alias(side), F.col("_sum").alias(f"_{side}_sum"), F.col("_avg").alias(f"_{side}_avg")), side)
    overall = means.agg(F.avg("mean").alias("_mu"))
    product = F.col("l_mean") * F.col("r_mean")
    scorers = {
        "m_product": product, "m_mean": (F.col("l_mean") + F.col("r_mean")) / 2.0, "m_root": F.sqrt(product) / (F.sqrt(product) + F.col("_mu")),
        "s_weight": F.col("l_mean") / F.col("_ligand_sum") * F.col("r_mean") / F.col("_receptor_sum"),
        "s_diff": (F.col("l_mean") - F.col("_ligand_avg") + F.col("r_mean") - F.col("_receptor_avg")) / 2.0,
    }
    key = ["ligand", "receptor", "source", "target"]
    scored = materialize(rows.crossJoin(overall).select(*key, *[S.r6(e, 12).alias(n) for n, e in scorers.items()]))  # one-row side
    size = scored.agg(F.count(F.lit(1)).alias("_n"))
    table = scored
    for name in scorers:
        ranks = S.average_ranks(scored.select(F.col(name)), [], name).crossJoin(size).select(  # one-row side
            name, ((F.col("_n") + 1 - F.col("avg_rank")) / F.col("_n")).alias(f"_r_{name}")
        )
        table = table.join(ranks, name)

    def aggregate(prefix: str):
        ranked = F.array_sort(F.array(*[F.col(f"_r_{n}") for n in scorers if n.startswith(prefix)]))
        n = sum(name.startswith(prefix) for name in scorers)
        tails = [
            sum((math.comb(n, j) * F.pow(ranked[k - 1], F.lit(float(j))) * F.pow(1.0 - ranked[k - 1], F.lit(float(n - j))) for j in range(k, n + 1)), F.lit(0.0))
            for k in range(1, n + 1)
        ]
        return F.least(F.lit(1.0), n * F.least(*tails))

    return table.select(*key, (1.0 - aggregate("m_")).alias("score"), aggregate("s_").alias("pvalue"))


def aggregate_pairs(lr: DataFrame) -> DataFrame:
    """Per (source, target): number, mean score and best ligand-receptor (ties by name)."""
    best = F.min_by(F.struct("ligand", "receptor"), F.struct(-F.col("score"), "ligand", "receptor"))
    return lr.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_interactions"), F.avg("score").alias("mean_score"), best.alias("_b")).select(
        "source", "target", "n_interactions", "mean_score", F.col("_b.ligand").alias("top_ligand"), F.col("_b.receptor").alias("top_receptor")
    )


def signaling_roles(lr: DataFrame, digits: int = 4) -> DataFrame:
    """Outgoing and incoming strength per cell type and the dominant role."""
    ends = lr.select(F.explode(F.array(
        F.struct(F.col("source").alias("cell_type"), F.lit(True).alias("out"), "score"), F.struct(F.col("target").alias("cell_type"), F.lit(False).alias("out"), "score")
    )).alias("e")).select("e.*")
    sums = ends.groupBy("cell_type").agg(
        F.sum(F.when(F.col("out"), F.col("score")).otherwise(0.0)).alias("_o"), F.sum(F.when(~F.col("out"), F.col("score")).otherwise(0.0)).alias("_i"),
        F.count(F.when(F.col("out"), 1)).alias("n_outgoing"), F.count(F.when(~F.col("out"), 1)).alias("n_incoming"),
    )
    role = F.when(F.col("_o") > F.col("_i") * 1.5, "sender").when(F.col("_i") > F.col("_o") * 1.5, "receiver").otherwise("balanced")
    return sums.select(
        "cell_type", F.round("_o", digits).alias("sender_score"), F.round("_i", digits).alias("receiver_score"), F.round(F.col("_o") + F.col("_i"), digits).alias("hub_score"),
        role.alias("dominant_role"), "n_outgoing", "n_incoming",
    )


def significant_or_all(lr: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant rows if there are any, else all rows (decided in the plan, not on the driver)."""
    any_sig = lr.agg(F.coalesce(F.max(F.col("pvalue") < alpha), F.lit(False)).alias("_any"))
    return lr.crossJoin(any_sig).filter(~F.col("_any") | (F.col("pvalue") < alpha)).drop("_any")  # one-row side


def lr_matrix(lr: DataFrame, top_n: int = 20) -> DataFrame:
    """Mean score of the strongest pairs by source, as columns; absent combinations are 0."""
    named = lr.withColumn("lr", F.concat_ws("^", "ligand", "receptor"))
    top = named.groupBy("lr").agg(F.avg("score").alias("_m")).orderBy(F.desc("_m"), "lr").limit(top_n)
    return named.join(top, "lr", "left_semi").groupBy("lr").pivot("source").agg(F.avg("score")).na.fill(0.0)


def lr_chord(lr: DataFrame, top_n: int = 20) -> DataFrame:
    return lr.groupBy("source", "target").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "source", "target").limit(top_n)


def lr_ranked(lr: DataFrame, top_n: int = 20) -> DataFrame:
    label = F.concat(F.col("ligand"), F.lit(" -> "), F.col("receptor"), F.lit(" ("), F.col("source"), F.lit(" -> "), F.col("target"), F.lit(")"))
    return lr.select(label.alias("interaction"), "score").orderBy(F.desc("score"), "interaction").limit(top_n)


def parse_lr_features(features: DataFrame, column: str = "feature") -> DataFrame:
    """``A^B``, or ``A_B`` with both parts capitalised, is a pair; anything else a gene."""
    f = F.col(column)
    upper = r"^(\p{Lu}[^_]*)_(\p{Lu}[^_]*)$"
    caret = F.instr(f, "^") > 0
    return features.select(
        column, (caret | f.rlike(upper)).alias("is_pair"),
        F.when(caret, F.substring_index(f, "^", 1)).when(f.rlike(upper), F.regexp_extract(f, upper, 1)).alias("ligand"),
        F.when(caret, F.expr(f"substring({column}, instr({column}, '^') + 1)")).when(f.rlike(upper), F.regexp_extract(f, upper, 2)).alias("receptor"),
    )


def spatial_lr_score(expr: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per cell and pair: sum over neighbours of its ligand times their receptor."""
    ligand = expr.select(F.col("cell_id").alias("src"), F.col("gene_id").alias("ligand"), F.col("value").alias("_l"))
    receptor = expr.select(F.col("cell_id").alias("dst"), F.col("gene_id").alias("receptor"), F.col("value").alias("_r"))
    sent = ligand.join(pairs, "ligand").join(edges.select("src", "dst"), "src")
    return sent.join(receptor, ["dst", "receptor"]).groupBy(F.col("src").alias("cell_id"), "ligand", "receptor").agg(F.sum(F.col("_l") * F.col("_r")).alias("score"))


def relabel_and_aggregate(lr: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach ``labels(cluster, label)`` to both ends, then count, mean, max and smallest p per label pair."""
    named = lr.join(labels.select(F.col("cluster").alias("source"), F.col("label").alias("source_label")), "source").join(
        labels.select(F.col("cluster").alias("target"), F.col("label").alias("target_label")), "target"
    )
    return named.groupBy("source_label", "target_label").agg(
        F.count(F.lit(1)).alias("n_lr_pairs"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.min("pvalue").alias("min_pvalue")
    )


def count_pivot(agg: DataFrame) -> DataFrame:
    return agg.groupBy("source_label").pivot("target_label").agg(F.sum("n_lr_pairs")).na.fill(0)


