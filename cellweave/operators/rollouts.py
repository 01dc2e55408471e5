"""Reward, advantage and answer-quality analytics over recorded rollouts.

Token sequences are array columns of one row per sample; group statistics are
aggregated and joined back, so that one large prompt group is combined map-side.
"""

from __future__ import annotations

import itertools
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cellweave.functions import stats as S
from cellweave.operators.de import top_per_group
from cellweave.session import materialize


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


# ------------------------------------------------------------------ group advantages
def _group_scores(df: DataFrame, uid: str, score: str) -> DataFrame:
    groups = df.groupBy(uid).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_mean"), F.stddev_samp(score).alias("_sd"))
    return df.join(groups, uid)


def grpo_advantage(df: DataFrame, uid: str = "uid", score: str = "score", eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(score - mean) / (sample sd + eps) within a prompt; a lone sample keeps mean 0 and sd 1."""
    lone = F.col("_n") == 1
    centred = F.col(score) - F.when(lone, 0.0).otherwise(F.col("_mean"))
    scaled = centred / (F.when(lone, 1.0).otherwise(F.col("_sd")) + eps) if by_std else centred
    return _group_scores(df, uid, score).withColumn("advantage", scaled).drop("_n", "_mean", "_sd")


def rloo_advantage(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """Leave-one-out baseline: n / (n - 1) * (score - mean); a lone sample is unchanged."""
    value = F.when(F.col("_n") > 1, F.col("_n") / (F.col("_n") - 1) * (F.col(score) - F.col("_mean"))).otherwise(F.col(score))
    return _group_scores(df, uid, score).withColumn("advantage", value).drop("_n", "_mean", "_sd")


def masked_moments(df: DataFrame, values: str, mask: str = "mask") -> DataFrame:
    """One row: mask count, masked mean and Bessel-corrected variance of an array column."""
    x = F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))
    sums = df.select(F.aggregate(
        F.transform(x, lambda p: F.struct((p["v"] * p["m"]).alias("s"), (p["v"] * p["v"] * p["m"]).alias("q"), p["m"].cast("double").alias("n"))),
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("n")),
        lambda a, p: F.struct((a["s"] + p["s"]).alias("s"), (a["q"] + p["q"]).alias("q"), (a["n"] + p["n"]).alias("n")),
    ).alias("_t")).agg(F.sum("_t.s").alias("_s"), F.sum("_t.q").alias("_q"), F.sum("_t.n").alias("n_masked"))
    mean = F.col("_s") / (F.col("n_masked") + 1e-8)
    raw = (F.col("_q") - 2.0 * mean * F.col("_s") + mean * mean * F.col("n_masked")) / (F.col("n_masked") + 1e-8)
    checked = F.when(F.col("n_masked") > 1, raw * F.col("n_masked") / (F.col("n_masked") - 1)).otherwise(F.raise_error(F.lit("masked variance needs at least two values")))
    return sums.select("n_masked", mean.alias("masked_mean"), checked.alias("masked_var"))


def masked_whiten(df: DataFrame, values: str, mask: str = "mask", shift_mean: bool = True, out: str | None = None) -> DataFrame:
    """Whiten an array column with the masked mean and variance over all samples."""
    joined = df.crossJoin(masked_moments(df, values, mask))  # one-row side
    scale = 1.0 / F.sqrt(F.col("masked_var") + 1e-8)
    back = F.lit(0.0) if shift_mean else F.col("masked_mean")
    white = F.transform(values, lambda v: (v - F.col("masked_mean")) * scale + back)
    return joined.withColumn(out or values, white).drop("n_masked", "masked_mean", "masked_var")


def rfpp_baseline_advantage(df: DataFrame, uid: str = "uid", score: str = "score", mask: str = "mask") -> DataFrame:
    """Score minus the prompt mean on every unmasked token, then whitened over the batch."""
    base = _group_scores(df, uid, score).withColumn("_a", F.col(score) - F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_mean")))
    tokens = base.withColumn("advantages", F.transform(mask, lambda m: F.col("_a") * m)).drop("_n", "_mean", "_sd", "_a")
    white = masked_whiten(tokens, "advantages", mask)
    return white.withColumn("advantages", F.zip_with("advantages", mask, lambda a, m: a * m))


def _scan_back(array: Column, step) -> Column:
    """Right-to-left scan of an array of structs: each output depends on the next one."""
    folded = F.aggregate(F.reverse(array), F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)), x))))
    return F.reverse(folded)


def discounted_returns(df: DataFrame, gamma: float = 1.0, rewards: str = "token_rewards", mask: str = "mask") -> DataFrame:
    """Reverse discounted return, restarted after masked tokens; adds whitened ``advantages``."""
    zipped = F.arrays_zip(F.col(rewards).alias("r"), F.col(mask).alias("m"))
    # The running value behind a masked token is cleared before the next step to the left.
    raw = F.aggregate(
        F.reverse(zipped), F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("run")),
        lambda a, x: F.struct(F.concat(a["out"], F.array(x["r"] + gamma * a["run"])).alias("out"), ((x["r"] + gamma * a["run"]) * x["m"]).alias("run")),
        lambda a: F.reverse(a["out"]),
    )
    with_returns = df.withColumn("returns", raw)
    white = masked_whiten(with_returns, "returns", mask, out="advantages")
    return white.withColumn("advantages", F.zip_with("advantages", mask, lambda a, m: a * m))


def gae(df: DataFrame, gamma: float = 1.0, lam: float = 0.95, rewards: str = "token_rewards", values: str = "values", mask: str = "mask") -> DataFrame:
    """Generalised advantage estimation; the recurrence runs through masked tokens, whitening does not."""
    following = F.concat(F.slice(values, 2, F.size(values)), F.array(F.lit(0.0)))
    parts = F.arrays_zip(F.col(rewards).alias("r"), F.col(values).alias("v"), following.alias("w"))
    raw = df.withColumn("advantages", _scan_back(parts, lambda nxt, p: p["r"] + gamma * p["w"] - p["v"] + gamma * lam * nxt))
    raw = raw.withColumn("returns", F.zip_with("advantages", values, lambda a, v: a + v))
    return masked_whiten(raw, "advantages", mask)


def remax_advantage(df: DataFrame, baseline: str = "baseline", rewards: str = "token_rewards", mask: str = "mask") -> DataFrame:
    """Reverse cumulative reward minus the sample's baseline, on unmasked tokens."""
    weighted = F.zip_with(rewards, mask, lambda r, m: r * m)
    returns = _scan_back(weighted, lambda nxt, r: r + nxt)
    return df.withColumn("returns", returns).withColumn("advantages", F.zip_with("returns", mask, lambda r, m: r - F.col(baseline) * m))


# ---------------------------------------------------------------------- KL and loss
def kl_penalty(logp: Column, ref: Column, mode: str = "kl") -> Column:
    diff = logp - ref
    if mode == "kl":
        return diff
    if mode == "abs":
        return F.abs(diff)
    if mode == "mse":
        return 0.5 * diff * diff
    if mode == "low_var_kl":
        back = ref - logp
        return F.least(F.greatest(F.exp(back) - back - 1.0, F.lit(-10.0)), F.lit(10.0))
    raise ValueError(f"unknown KL mode {mode!r}")


def apply_kl(df: DataFrame, beta: float = 0.1, mode: str = "kl") -> DataFrame:
    """Token rewards = scores - beta * KL * mask; adds the sample's masked mean KL as ``kl``."""
    zipped = F.arrays_zip(F.col("old_logp").alias("a"), F.col("ref_logp").alias("b"), F.col("mask").alias("m"))
    kld = F.transform(zipped, lambda p: kl_penalty(p["a"], p["b"], mode) * p["m"])
    rows = df.withColumn("_k", kld).withColumn("token_rewards", F.zip_with("token_rewards", "_k", lambda r, k: r - beta * k))
    n = _sum(F.transform("mask", lambda m: m.cast("double")))
    return rows.withColumn("kl", _sum(F.col("_k")) / (n + 1e-8)).drop("_k")


def mean_kl(with_kl: DataFrame) -> DataFrame:
    return with_kl.agg(F.avg("kl").alias("mean_kl"))


def aggregate_loss(df: DataFrame, loss: str = "loss", mask: str = "mask", mode: str = "token-mean") -> DataFrame:
    """One row with the batch loss under one of the four reductions."""
    s = _sum(F.zip_with(loss, mask, lambda v, m: v * m))
    n = _sum(F.transform(mask, lambda m: m.cast("double")))
    rows = df.select(s.alias("_s"), n.alias("_n"), F.size(mask).alias("_len"))
    reduce = {
        "token-mean": F.sum("_s") / (F.sum("_n") + 1e-8),
        "seq-mean-token-sum": F.avg("_s"),
        "seq-mean-token-mean": F.avg(F.try_divide("_s", "_n")),
        "seq-mean-token-sum-norm": F.try_divide(F.sum("_s"), F.max("_len")),
    }
    if mode not in reduce:
        raise ValueError(f"unknown reduction {mode!r}")
    return rows.agg(reduce[mode].alias("loss"))


def entropy_from_logits(logits: Column) -> Column:
    """logsumexp - sum(p * logit) of an array of logits."""
    top = F.array_max(logits)
    z = _sum(F.transform(logits, lambda x: F.exp(x - top)))
    lse = top + F.log(z)
    return lse - _sum(F.transform(logits, lambda x: F.exp(x - lse) * x))


def value_loss(df: DataFrame, clip: float = 0.5) -> DataFrame:
    """Clipped value loss and the share of tokens where the clipped branch is larger."""
    z = F.arrays_zip(F.col("vpreds").alias("p"), F.col("values").alias("v"), F.col("returns").alias("r"), F.col("mask").alias("m"))
    per = F.transform(z, lambda t: F.struct(
        ((t["p"] - t["r"]) * (t["p"] - t["r"])).alias("a"),
        F.pow(F.least(F.greatest(t["p"], t["v"] - clip), t["v"] + clip) - t["r"], F.lit(2.0)).alias("b"), t["m"].cast("double").alias("m")))
    tok = df.select(F.explode(per).alias("t")).select("t.*")
    return tok.agg(
        (0.5 * F.sum(F.greatest("a", "b") * F.col("m")) / (F.sum("m") + 1e-8)).alias("vf_loss"),
        (F.sum(F.when(F.col("b") > F.col("a"), F.col("m")).otherwise(0.0)) / (F.sum("m") + 1e-8)).alias("vf_clipfrac"),
    )


def batch_metrics(df: DataFrame, max_response: int) -> DataFrame:
    """Mean, max and min of scores, advantages, returns and lengths, clip ratio and explained variance."""
    tok = F.arrays_zip(F.col("advantages").alias("a"), F.col("returns").alias("r"), F.col("values").alias("v"), F.col("mask").alias("m"))
    valid = F.filter(tok, lambda t: t["m"] > 0)
    length = _sum(F.transform("mask", lambda m: m.cast("double")))
    pick = lambda k: F.transform(valid, lambda t: t[k])
    per = df.select(
        _sum(F.col("token_rewards")).alias("score"), length.alias("len"), F.size(valid).alias("n"),
        *[_sum(pick(k)).alias(f"{k}_sum") for k in "ar"],
        *[F.array_max(pick(k)).alias(f"{k}_max") for k in "ar"],
        *[F.array_min(pick(k)).alias(f"{k}_min") for k in "ar"],
        _sum(F.transform(valid, lambda t: t["r"] * t["r"])).alias("rr"),
        _sum(F.transform(valid, lambda t: t["r"] - t["v"])).alias("d"),
        _sum(F.transform(valid, lambda t: (t["r"] - t["v"]) * (t["r"] - t["v"]))).alias("dd"),
    )
    n = F.sum("n")
    var = lambda s, q: (F.sum(q) - F.sum(s) * F.sum(s) / n) / (n - 1)
    stats = [F.avg("score").alias("score_mean"), F.max("score").alias("score_max"), F.min("score").alias("score_min")]
    for k, name in (("a", "advantage"), ("r", "return")):
        stats += [(F.sum(f"{k}_sum") / n).alias(f"{name}_mean"), F.max(f"{k}_max").alias(f"{name}_max"), F.min(f"{k}_min").alias(f"{name}_min")]
    stats += [F.avg("len").alias("length_mean"), F.max("len").alias("length_max"), F.min("len").alias("length_min"),
              F.avg(F.when(F.col("len") == max_response, 1.0).otherwise(0.0)).alias("clip_ratio"),
              (1.0 - var("d", "dd") / (var("r_sum", "rr") + 1e-5)).alias("explained_var")]
    return per.agg(*stats)


def throughput_metrics(log: DataFrame, n_gpus: int) -> DataFrame:
    """Per step: tokens, seconds, tokens per second and device, milliseconds per token."""
    return log.select(
        "step", F.col("n_tokens").alias("total_tokens"), F.col("seconds").alias("time_per_step"),
        (F.col("n_tokens") / (F.col("seconds") * n_gpus)).alias("tokens_per_second"), (F.col("seconds") * 1000.0 / F.col("n_tokens")).alias("ms_per_token"),
    )


# ------------------------------------------------------------------ validation votes
def best_of_n(df: DataFrame, n: int, uid: str = "uid", score: str = "score") -> DataFrame:
    """Expected best and worst of n draws with replacement per prompt, in closed form from ranks."""
    ranks = S.cumulative_counts(df.select(uid, score), [uid], score)
    sized = ranks.join(df.groupBy(uid).agg(F.count(F.lit(1)).alias("_m")), uid)
    below, upto = F.col("n_before") / F.col("_m"), (F.col("n_before") + F.col("n_ties")) / F.col("_m")
    p_best = F.pow(upto, F.lit(float(n))) - F.pow(below, F.lit(float(n)))
    p_worst = F.pow(1.0 - below, F.lit(float(n))) - F.pow(1.0 - upto, F.lit(float(n)))
    moments = sized.groupBy(uid).agg(*[
        F.sum(p * F.pow(F.col(score), F.lit(float(e)))).alias(f"_{name}{e}") for name, p in (("best", p_best), ("worst", p_worst)) for e in (1, 2)
    ])
    sd = lambda name: F.sqrt(F.greatest(F.col(f"_{name}2") - F.col(f"_{name}1") * F.col(f"_{name}1"), F.lit(0.0)))
    return moments.select(uid, F.col("_best1").alias("best_mean"), sd("best").alias("best_std"), F.col("_worst1").alias("worst_mean"), sd("worst").alias("worst_std"))


def bootstrap_votes(df: DataFrame, n: int, draws: int = 1000, seed: int = 42, uid: str = "uid", score: str = "score", order: str = "sample_id", pred: str | None = None) -> DataFrame:
    """Mean and sd over ``draws`` resamples of n rows of each prompt: best, worst and, with ``pred``, the majority's value.

    Pick j of draw i is row number md5(seed-i-j) mod the prompt's size, in the order of md5(seed-order): the
    same for all prompts of a size.  Rows that no pick names leave first, so a prompt sends at most
    draws * n rows; its draws are then made inside one array, never as rows.  In a draw the prediction
    picked most often wins, the first picked of equal ones, with the value of its first pick.
    """
    rows = df.select(F.col(uid).alias("uid"), F.col(score).alias("value"), F.col(order).alias("_o"), *([F.col(pred).alias("pred")] if pred else []))
    slots = S.hash_order(rows, F.concat_ws("-", F.lit(seed), F.col("_o")), by=["uid"])
    sizes = materialize(rows.groupBy("uid").agg(F.count(F.lit(1)).alias("m")))
    number = lambda i, j: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), i.cast("string"), j.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    all_picks = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: number(i, j)))
    # one row for each size that occurs
    picks = materialize(sizes.select("m").distinct().withColumn("_all", all_picks).withColumn("picks", F.transform("_all", lambda d: F.transform(d, lambda x: x % F.col("m") + 1))).select("m", "picks"))
    named = picks.select("m", F.explode(F.array_distinct(F.flatten("picks"))).alias("slot"))
    sent = slots.join(sizes, "uid").join(named, ["m", "slot"])
    cell = F.struct("value", "pred") if pred else F.struct("value")
    packed = sent.groupBy("uid", "m").agg(F.map_from_entries(F.collect_list(F.struct("slot", cell.alias("c")))).alias("cells"))  # at most draws * n rows
    drawn = packed.join(picks, "m").select("uid", F.transform("picks", lambda d: F.transform(d, lambda k: F.element_at("cells", k))).alias("draws"))

    def majority(cells):
        kinds = F.array_distinct(F.transform(cells, lambda c: F.struct(c["pred"].alias("p"))))
        votes = F.transform(kinds, lambda k: F.size(F.filter(cells, lambda c: c["pred"].eqNullSafe(k["p"]))))
        winner = F.element_at(kinds, F.array_position(votes, F.array_max(votes)).cast("int"))
        return F.element_at(F.filter(cells, lambda c: c["pred"].eqNullSafe(winner["p"])), 1)["value"]

    values = lambda cells: F.transform(cells, lambda c: c["value"])
    reduced = {"best": lambda c: F.array_max(values(c)), "worst": lambda c: F.array_min(values(c))} | ({"majority": majority} if pred else {})
    each = drawn.select("uid", *[F.transform("draws", fn).alias(name) for name, fn in reduced.items()])
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    out = each.select("uid", *[x for name in reduced for x in (mean(name).alias(f"{name}_mean"), name)])
    spread = lambda name: F.sqrt(F.aggregate(name, F.lit(0.0), lambda a, x: a + (x - F.col(f"{name}_mean")) * (x - F.col(f"{name}_mean"))) / F.size(name))
    return out.select(F.col("uid").alias(uid), *[x for name in reduced for x in (F.col(f"{name}_mean"), spread(name).alias(f"{name}_std"))])


def bootstrap_best_of_n(df: DataFrame, n: int, draws: int = 1000, seed: int = 42, uid: str = "uid", score: str = "score", order: str = "sample_id") -> DataFrame:
    """The quantities of :func:`best_of_n` from hash-seeded resamples of each prompt's scores."""
    return bootstrap_votes(df, n, draws, seed, uid, score, order)


def majority_vote(df: DataFrame, uid: str = "uid", pred: str = "pred", value: str = "score", order: str = "sample_id") -> DataFrame:
    """Value of the most frequent prediction; the first seen wins ties."""
    votes = df.groupBy(uid, pred).agg(F.count(F.lit(1)).alias("n_votes"), F.min(order).alias("_first"), F.min_by(value, order).alias("value"))
    return top_per_group(votes, [uid], [F.desc("n_votes"), "_first"], 1).select(uid, pred, "n_votes", "value")


def validation_rollup(df: DataFrame, source: str = "data_source", uid: str = "uid", score: str = "score") -> DataFrame:
    """Mean and population sd per prompt, then the mean over prompts per source."""
    prompts = df.groupBy(source, uid).agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    return prompts.groupBy(source).agg(F.avg("_m").alias("mean"), F.avg("_s").alias("std"), F.count(F.lit(1)).alias("n_prompts"))


def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float) -> Column:
    exceed = length - (max_length - buffer)
    return F.least(-exceed / float(buffer) * factor, F.lit(0.0))


# ----------------------------------------------------------------------- answers
# ASCII punctuation removed from answers, and the closed answers.
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
CLOSED_ANSWERS = ("yes", "no", "noanswer")


def normalize_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def qa_score(df: DataFrame, key: str = "id", pred: str = "response", golds: str = "golds") -> DataFrame:
    """EM, sub-EM, F1, precision and recall against the gold answer of best F1; null predictions score 0.

    The token overlap is a multiset intersection taken by counting words, so long
    answers stay linear.
    """
    rows = df.select(key, F.posexplode(golds).alias("_g", "_gold"), F.col(pred).alias("_pred")).select(
        key, "_g", F.col("_pred").isNull().alias("_missing"), normalize_answer(F.coalesce("_pred", F.lit(""))).alias("_p"), normalize_answer(F.col("_gold")).alias("_q")
    )
    words = rows.select(key, "_g", F.explode(F.concat(
        F.transform(_tokens(F.col("_p")), lambda w: F.struct(w.alias("w"), F.lit(1).alias("p"), F.lit(0).alias("q"))),
        F.transform(_tokens(F.col("_q")), lambda w: F.struct(w.alias("w"), F.lit(0).alias("p"), F.lit(1).alias("q"))),
    )).alias("_w"))
    counts = words.groupBy(key, "_g", "_w.w").agg(F.sum("_w.p").alias("_np"), F.sum("_w.q").alias("_nq"))
    same = counts.groupBy(key, "_g").agg(F.sum(F.least("_np", "_nq")).alias("_same"), F.sum("_np").alias("_lp"), F.sum("_nq").alias("_lq"))
    joined = rows.join(same, [key, "_g"], "left").na.fill(0, ["_same", "_lp", "_lq"])
    differ = F.col("_p") != F.col("_q")
    closed = differ & (F.col("_p").isin(*CLOSED_ANSWERS) | F.col("_q").isin(*CLOSED_ANSWERS))
    zero = F.col("_missing") | closed | (F.col("_same") == 0)
    precision, recall = F.col("_same") / F.col("_lp"), F.col("_same") / F.col("_lq")
    scored = joined.select(
        key, "_g",
        F.when(~F.col("_missing") & ~differ, 1.0).otherwise(0.0).alias("em"),
        F.when(~F.col("_missing") & (F.contains("_p", "_q") | F.contains("_q", "_p")), 1.0).otherwise(0.0).alias("sub_em"),
        F.when(zero, 0.0).otherwise(2.0 * precision * recall / (precision + recall)).alias("f1"),
        F.when(zero, 0.0).otherwise(precision).alias("precision"), F.when(zero, 0.0).otherwise(recall).alias("recall"),
    )
    best = F.max_by(F.struct("em", "sub_em", "f1", "precision", "recall"), F.struct(F.col("f1"), -F.col("_g")))
    return scored.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def eval_summary(scores: DataFrame, sampling: int = 1, output: str | None = None) -> DataFrame:
    """Per-row metrics rounded to two places, averaged, times 100.

    Rows whose ``output`` is empty are left out.  With ``sampling`` each row counts so many times, as it does
    where the set is asked again; the replicates are weights of the mean, not rows, and their
    number is returned in ``n_rows``.
    """
    if output is not None:
        scores = scores.filter(F.coalesce(F.trim(output), F.lit("")) != "")
    if sampling > 1 or output is not None:
        weighted = lambda c: F.sum(F.floor(F.col(c) * 100.0 + 0.5) / 100.0 * sampling) / F.sum(F.lit(sampling)) * 100.0
        return scores.agg(*[F.round(weighted(c), 6).alias(c) for c in ("em", "sub_em", "f1")], F.coalesce(F.sum(F.lit(sampling)), F.lit(0)).cast("long").alias("n_rows"))
    return scores.agg(*[F.round(F.avg(F.floor(F.col(c) * 100.0 + 0.5) / 100.0) * 100.0, 6).alias(c) for c in ("em", "sub_em", "f1")])


def answer_extract(text: Column) -> Column:
    """The answer behind the last "the answer is", after any closed thinking part."""
    tail = F.when(F.contains(text, F.lit("</think>")), F.trim(F.substring_index(text, "</think>", -1))).otherwise(text)
    bare = F.replace(tail, F.lit("*"), F.lit(""))
    answer = F.trim(F.substring_index(bare, "the answer is", -1))
    for mark in ("<｜Assistant｜>", "<｜end▁of▁sentence｜>"):
        answer = F.replace(answer, F.lit(mark), F.lit(""))
    return F.when(F.contains(bare, F.lit("the answer is")), F.trim(F.regexp_replace(F.trim(answer), r"^\.+|\.+$", "")))


def _last_boxed(text: str) -> str | None:
    start = text.rfind("\\boxed{")
    if start < 0:
        return None
    depth = 0
    for i in range(start + 6, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return text[start + 7:i]
    return None


def last_boxed(series: pd.Series) -> pd.Series:
    """Content of the last boxed expression, braces balanced."""
    return series.map(lambda s: None if s is None else _last_boxed(s))


def boxed_score(df: DataFrame, key: str = "id", solution: str = "solution", golds: str = "golds", metric: str = "em") -> DataFrame:
    """Last boxed answer of the final 300 characters against every gold; best value."""
    pick = F.pandas_udf(last_boxed, StringType())
    tail = F.lower(F.substring(F.col(solution), F.greatest(F.lit(1), F.length(solution) - 299), F.lit(300)))
    rows = df.select(key, golds, pick(tail).alias("_answer"))
    scored = qa_score(rows, key, "_answer", golds) if metric == "f1" else None
    if scored is not None:
        return scored.select(key, F.col("f1").alias("score"))
    hit = F.exists(golds, lambda g: normalize_answer(g) == normalize_answer(F.col("_answer")))
    return rows.select(key, F.when(F.col("_answer").isNotNull() & hit, 1.0).otherwise(0.0).alias("score"))


# Patterns of the three kinds of action.
ACTION_PATTERNS = {1: r"<recall>(.*?)</recall>", 2: r"<update>(.*?)</update>", 0: r"\\boxed\{(.+)\}"}


def format_reward(response: Column, action: Column) -> Column:
    """1 when the response holds exactly one non-blank action of its type."""
    one = lambda p: F.when(F.size(F.filter(F.regexp_extract_all(response, F.lit(p), F.lit(1)), lambda m: F.trim(m) != "")) == 1, 1.0).otherwise(0.0)
    return F.when(action == 1, one(ACTION_PATTERNS[1])).when(action == 2, one(ACTION_PATTERNS[2])).when(action == 0, one(ACTION_PATTERNS[0])).otherwise(
        F.raise_error(F.concat(F.lit("invalid action type "), action.cast("string"))))


def word_recall(text: Column, golds: Column) -> Column:
    """Mean over golds of the share of their words that occur in ``text`` (empty golds count 0)."""
    share = F.transform(golds, lambda g: F.when(
        F.size(_words(g)) > 0, _sum(F.transform(_words(g), lambda w: F.when(F.contains(text, w), 1.0).otherwise(0.0))) / F.size(_words(g))
    ).otherwise(0.0))
    return _sum(share) / F.size(golds)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def recall_reward(prompt: Column, response: Column, recalled: Column, golds: Column) -> Column:
    """Recall gained by the new memory plus, if positive, recall gained by revisiting."""
    old = F.regexp_extract(prompt, r"<memory>(.*?)</memory>", 1)
    new = F.regexp_extract(response, r"<update>(.*?)</update>", 1)
    revisit = word_recall(F.concat(recalled, F.lit(" "), prompt), golds) - word_recall(prompt, golds)
    return word_recall(new, golds) - word_recall(old, golds) + F.greatest(F.lit(0.0), revisit)


def reweight(prompt: Column, golds: Column, action: Column) -> Column:
    return F.when(action == 2, 0.5 + word_recall(prompt, golds)).otherwise(1.0)


def action_metrics(df: DataFrame, response: str = "response") -> DataFrame:
    """Counts of recall and update actions per row, averaged."""
    count = lambda p: F.size(F.regexp_extract_all(F.col(response), F.lit(p), F.lit(1)))
    return df.agg(F.avg(count(ACTION_PATTERNS[1])).alias("recalls"), F.avg(count(ACTION_PATTERNS[2])).alias("updates"), F.count(F.lit(1)).alias("n"))


def eval_by_source(df: DataFrame, reward, source: str = "data_source", key: str = "id", responses: str = "responses") -> DataFrame:
    """Mean reward over a row's responses, then over rows, per source; ``reward`` maps a response Column to a Column."""
    rows = df.select(source, key, F.explode(responses).alias("_r")).select(source, key, reward(F.col("_r")).alias("_v"))
    return rows.groupBy(source, key).agg(F.avg("_v").alias("_m")).groupBy(source).agg(F.avg("_m").alias("score"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- sequence preparation
def pad_truncate(ids: Column, n: int, mode: str = "error", pad=0, pad_side: str = "right") -> Column:
    """Exactly n tokens: pad on one side, cut left, right or out of the centre, or fail."""
    size = F.size(ids)
    if mode == "left":
        cut = F.slice(ids, F.greatest(size - (n - 1), F.lit(1)), F.lit(n))
    elif mode == "right":
        cut = F.slice(ids, 1, n)
    elif mode == "center":
        half = n // 2
        cut = F.concat(F.slice(ids, 1, half), F.slice(ids, F.greatest(size - (n - half - 1), F.lit(1)), F.lit(n - half)))
    elif mode == "error":
        cut = F.when(size > n, F.raise_error(F.lit("sequence is too long"))).otherwise(ids)
    else:
        raise ValueError(f"unknown truncation {mode!r}")
    body = F.when(size > n, cut).otherwise(ids)
    padding = F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - size, F.lit(0)))
    return F.concat(padding, body) if pad_side == "left" else F.concat(body, padding)


def filter_overlong(df: DataFrame, tokens: str, max_len: int) -> DataFrame:
    return df.filter(F.size(tokens) <= max_len)


def multiturn_loss_mask(turns: DataFrame, n: int, mode: str = "right", conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversation tokens in turn order with a mask of 1 on assistant tokens, padded to n; zero positions on padding."""
    packed = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "role", "tokens"))).alias("_t"))  # one conversation
    ids = F.flatten(F.transform("_t", lambda t: t["tokens"]))
    mask = F.flatten(F.transform("_t", lambda t: F.transform(t["tokens"], lambda _: F.when(t["role"] == "assistant", 1).otherwise(0))))
    length = F.least(F.size(ids), F.lit(n))
    return packed.select(
        conv, pad_truncate(ids, n, mode, pad="").alias("input_tokens"), pad_truncate(mask, n, mode).alias("loss_mask"),
        F.concat(F.array_repeat(F.lit(1), length), F.array_repeat(F.lit(0), F.lit(n) - length)).alias("attention_mask"),
        F.concat(F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>")), F.array_repeat(F.lit(0), F.lit(n) - length)).alias("positions"),
    )


def chunk_context(df: DataFrame, tokens: str, size: int, key: str) -> DataFrame:
    """(key, step, chunk): fixed-size pieces, one row while the text is longer than step * size."""
    steps = F.ceil(F.size(tokens) / F.lit(float(size))).cast("int")
    return df.filter(F.size(tokens) > 0).select(key, tokens, F.explode(F.sequence(F.lit(0), steps - 1)).alias("step")).select(
        key, "step", F.slice(tokens, F.col("step") * size + 1, F.lit(size)).alias("chunk")
    )


def balance_partitions(df: DataFrame, k: int, length: str = "n_tokens", key: str = "sample_id", batch: str | None = None) -> DataFrame:
    """Near-equal token totals over k parts of equal size: a serpentine deal of the samples by length.

    Ranks come from bucketed counts, so a batch of any size is dealt without
    gathering it.
    """
    by = [batch] if batch else []
    keyed = S.range_buckets(df, length, "_b")
    inside = Window.partitionBy(*by, "_b", "_s").orderBy(F.desc(length), key)
    salted = keyed.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_b"), "_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = salted.groupBy(*by, "_b", "_s").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_b", "_s", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_o"))
    placed = salted.withColumn("_r", F.row_number().over(inside)).join(totals, [*by, "_b", "_s"])
    pos = F.col("_o") + F.col("_r") - 1
    lap, seat = F.floor(pos / k), pos % k
    return placed.withColumn("part", F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat).cast("long")).drop("_b", "_s", "_r", "_o")


def imbalance_stats(parts: DataFrame, length: str = "n_tokens", part: str = "part") -> DataFrame:
    sums = parts.groupBy(part).agg(F.sum(length).alias("_t"))
    return sums.agg(F.min("_t").alias("minmax_min"), F.max("_t").alias("minmax_max"), (F.max("_t") - F.min("_t")).alias("diff"), F.avg("_t").alias("mean"), F.count(F.lit(1)).alias("n_parts"))


def micro_batches(df: DataFrame, max_tokens: int, length: str = "n_tokens", key: str = "sample_id") -> DataFrame:
    """ceil(total / max) balanced groups."""
    total = df.agg(F.sum(length)).first()[0] or 0
    return balance_partitions(df, max(1, -(-int(total) // max_tokens)), length, key)


# ------------------------------------------------------------------ documents and cost
def build_doc_pool(qa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pool(doc, idx), questions): distinct title+text documents indexed in hash order, questions with evidence indices.

    A question ends with "?"; one whose supporting title is missing is skipped.
    """
    docs = qa.select(F.explode("docs").alias("d")).select(F.concat_ws("\n", "d.title", "d.text").alias("doc"), F.col("d.title").alias("title")).distinct()
    pool = S.hash_order(docs, F.col("doc"), out="idx").withColumn("idx", F.col("idx") - 1)
    needs = qa.select("id", F.explode("supporting").alias("title"), F.size("supporting").alias("_need"), "docs")
    own = needs.withColumn("_d", F.explode(F.filter("docs", lambda d: d["title"] == F.col("title")))).select(
        "id", "_need", "title", F.concat_ws("\n", "_d.title", "_d.text").alias("doc"))
    found = own.join(pool, ["doc", "title"]).groupBy("id", "_need").agg(F.array_sort(F.collect_set("idx")).alias("evidence"), F.countDistinct("title").alias("_have"))
    question = F.when(F.trim("question").endswith("?"), F.trim("question")).otherwise(F.concat(F.trim("question"), F.lit("?")))
    return pool, qa.join(found.filter("_have = _need"), "id").select("id", question.alias("question"), "golds", "evidence")


def sample_distractors(questions: DataFrame, pool: DataFrame, num_docs: int, seed: int = 42) -> DataFrame:
    """Each question's documents filled up to num_docs with hash-drawn ones, shuffled, evidence remapped.

    Each question walks the pool in an order of its own, i -> (a i + b) mod p for a prime p from the
    pool's size on, which meets every index once; so it always gets enough and never the whole pool.
    A pool with fewer than ``num_docs`` documents is an error.
    """
    size = pool.count()
    if size < num_docs:
        raise ValueError(f"the pool has {size} documents, {num_docs} are asked for")
    prime = next(p for p in itertools.count(max(size, 2)) if all(p % q for q in range(2, int(p**0.5) + 1)))
    step = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(prime - 1)) + 1
    first = F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 2)), F.lit(prime))
    walk = F.transform(F.sequence(F.lit(0), F.least(F.lit(prime - 1), num_docs + F.size("evidence") + prime - size)).cast("array<bigint>"), lambda i: F.pmod(step * i + first, F.lit(prime)))
    draws = F.filter(walk, lambda d: d < size)
    picked = questions.withColumn(
        "_docs", F.slice(F.concat("evidence", F.array_except(F.array_distinct(draws), "evidence")), 1, num_docs)
    )
    order = F.transform(F.array_sort(F.transform("_docs", lambda d: F.struct(F.xxhash64(F.col("id"), d, F.lit(seed + 1)).alias("h"), d.alias("d")))), lambda s: s["d"])
    shuffled = picked.withColumn("docs", order)
    at = F.transform("evidence", lambda e: F.array_position("docs", e) - 1)
    gaps = F.zip_with(F.slice(F.array_sort(at), 2, F.size(at)), F.slice(F.array_sort(at), 1, F.size(at) - 1), lambda a, b: a - b)
    return shuffled.select("id", "question", "golds", "docs", at.alias("evidence_idx"), (at == F.array_sort(at)).alias("ordered"),
                           (at == F.reverse(F.array_sort(at))).alias("reverse_ordered"), F.array_min(gaps).alias("min_gap"))


def repeat_rows(df: DataFrame, times: int, interleave: bool = True, order: str = "sample_id") -> DataFrame:
    """Every row ``times`` times; ``position`` orders copies next to each other or batch after batch."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn("position", F.struct(F.col(order), "copy") if interleave else F.struct("copy", F.col(order)))


def pad_to_divisor(df: DataFrame, divisor: int, key: str = "sample_id") -> DataFrame:
    """Rows plus copies of the first ones, so that the count divides; copies carry ``is_pad``."""
    short = -df.count() % divisor
    base = df.withColumn("is_pad", F.lit(False))
    return base if not short else base.unionByName(df.orderBy(key).limit(short).withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per usage row: the first price whose name fragment occurs in the model name; per million tokens, 6 places.

    Models are few, so the fragment match runs on the distinct names only.
    """
    models = usage.select("model").distinct()
    hits = models.join(prices, F.contains(F.lower("model"), F.lower("fragment"))).groupBy("model").agg(
        F.min_by(F.struct("input_price", "output_price"), F.struct(-F.length("fragment"), F.col("fragment"))).alias("_p"))
    cost = (F.col("prompt_tokens") * F.col("_p.input_price") + F.col("completion_tokens") * F.col("_p.output_price")) / 1e6
    return usage.join(hits, "model", "left").withColumn("cost", F.round(F.coalesce(cost, F.lit(0.0)), 6)).drop("_p")
