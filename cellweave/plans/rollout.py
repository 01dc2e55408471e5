"""Rollout analytics: an order is a sample, its customer the prompt, its lines the tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.stats import r6
from cellweave.operators import rollouts as ro
from cellweave.plans import tables as t
from cellweave.plans.registry import register

TOK = """tok AS (SELECT l_orderkey AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS pos, COUNT(*) OVER (PARTITION BY l_orderkey) AS len,
  l_discount AS r, l_tax AS v, -l_quantity / 50 AS lp, -l_quantity / 50 - l_tax AS rp, CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END AS m FROM lineitem)"""


def samples(spark, sf):
    lines = t.load(spark, sf, "lineitem")
    entry = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.col("l_discount").alias("r"), F.col("l_tax").alias("v"),
                     (-F.col("l_quantity") / 50).alias("lp"), (-F.col("l_quantity") / 50 - F.col("l_tax")).alias("rp"), F.when(F.col("l_returnflag") != "A", 1).otherwise(0).alias("m"))
    packed = lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.array_sort(F.collect_list(entry)).alias("t"))  # the lines of one order
    pick = lambda k: F.transform("t", lambda x: x[k])
    return packed.select("sample_id", pick("r").alias("token_rewards"), pick("v").alias("values"), pick("lp").alias("old_logp"), pick("rp").alias("ref_logp"), pick("m").alias("mask"))


def scores(spark, sf):
    return t.load(spark, sf, "events").select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("uid"), F.col("event_type").alias("data_source"), F.col("value").alias("score"))


G = "g AS (SELECT event_id AS sample_id, user_id, value, COUNT(*) OVER w AS n, AVG(value) OVER w AS mu, stddev_samp(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id))"


@register("rl_grpo", f"WITH {G} SELECT sample_id, {t.r6_sql('CASE WHEN n = 1 THEN value / (1 + 1e-6::DOUBLE) ELSE (value - mu) / (sd + 1e-6::DOUBLE) END')} AS advantage FROM g")
def rl_grpo(spark, sf):
    return ro.grpo_advantage(scores(spark, sf)).select("sample_id", r6("advantage").alias("advantage"))


@register("rl_rloo", f"WITH {G} SELECT sample_id, {t.r6_sql('CASE WHEN n = 1 THEN value ELSE n / (n - 1)::DOUBLE * (value - mu) END')} AS advantage FROM g")
def rl_rloo(spark, sf):
    return ro.rloo_advantage(scores(spark, sf)).select("sample_id", r6("advantage").alias("advantage"))


def _explode(df, *cols, digits=6):
    return df.select("sample_id", F.posexplode(F.arrays_zip(*cols)).alias("p", "z")).select(
        "sample_id", (F.col("p") + 1).cast("long").alias("pos"), *[r6(F.col(f"z.{c}"), digits).alias(c) for c in cols])


WHITE = "SELECT SUM(x * m) / (SUM(m) + 1e-8::DOUBLE) AS mean, SUM(m) AS n FROM raw"
VAR = "SELECT SUM((x - mean) * (x - mean) * m) / (any_value(n) + 1e-8::DOUBLE) * any_value(n) / (any_value(n) - 1) AS var FROM raw, mo"


def whitened(raw: str, mult: str = "1") -> str:
    return f"""WITH {TOK}, raw AS ({raw}), mo AS ({WHITE}), va AS ({VAR})"""


@register("rl_gae", f"""{whitened("SELECT a.sample_id, a.pos, any_value(a.m) AS m, any_value(a.v) AS v, SUM(pow(0.99::DOUBLE * 0.95::DOUBLE, b.pos - a.pos) * (b.r + 0.99::DOUBLE * coalesce(c.v, 0) - b.v)) AS x FROM tok a JOIN tok b ON a.sample_id = b.sample_id AND b.pos >= a.pos LEFT JOIN tok c ON c.sample_id = b.sample_id AND c.pos = b.pos + 1 GROUP BY 1, 2")}
 SELECT sample_id, pos, {t.r6_sql('(x - mean) / sqrt(var + 1e-8::DOUBLE)')} AS advantages, {t.r6_sql('x + v')} AS returns FROM raw, mo, va""")
def rl_gae(spark, sf):
    return _explode(ro.gae(samples(spark, sf), 0.99, 0.95), "advantages", "returns")


@register("rl_discounted_returns", f"""{whitened("SELECT a.sample_id, a.pos, any_value(a.m) AS m, SUM(pow(0.9::DOUBLE, b.pos - a.pos) * b.r) AS x FROM tok a JOIN tok b ON a.sample_id = b.sample_id AND b.pos >= a.pos AND (b.pos = a.pos OR NOT EXISTS (SELECT 1 FROM tok z WHERE z.sample_id = a.sample_id AND z.pos > a.pos AND z.pos <= b.pos AND z.m = 0)) GROUP BY 1, 2")}
 SELECT sample_id, pos, {t.r6_sql('(x - mean) / sqrt(var + 1e-8::DOUBLE) * m', 4)} AS advantages, {t.r6_sql('x', 9)} AS returns FROM raw, mo, va""")
def rl_discounted_returns(spark, sf):
    out = _explode(ro.discounted_returns(samples(spark, sf), 0.9), "advantages", "returns", digits=9)
    return out.withColumn("advantages", r6("advantages", 4))


@register("rl_remax", f"""WITH {TOK} SELECT sample_id, pos, {t.r6_sql('SUM(r * m) OVER w')} AS returns, {t.r6_sql('SUM(r * m) OVER w - 0.05 * m')} AS advantages FROM tok WINDOW w AS (PARTITION BY sample_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)""")
def rl_remax(spark, sf):
    return _explode(ro.remax_advantage(samples(spark, sf).withColumn("baseline", F.lit(0.05))), "returns", "advantages")


@register("rl_rfpp_baseline", f"""WITH {TOK}, s AS (SELECT sample_id, o_custkey AS uid, SUM(r) AS score FROM tok JOIN orders ON o_orderkey = sample_id GROUP BY 1, 2), u AS (SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY uid) = 1 THEN score ELSE score - AVG(score) OVER (PARTITION BY uid) END AS a FROM s),
 raw AS (SELECT sample_id, pos, m, a * m AS x FROM tok JOIN u USING (sample_id)), mo AS ({WHITE}), va AS ({VAR}) SELECT sample_id, pos, {t.r6_sql('(x - mean) / sqrt(var + 1e-8::DOUBLE) * m')} AS advantages FROM raw, mo, va""")
def rl_rfpp_baseline(spark, sf):
    owner = t.load(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("uid"))
    rows = samples(spark, sf).join(owner, "sample_id").withColumn("score", ro._sum(F.col("token_rewards")))
    return _explode(ro.rfpp_baseline_advantage(rows), "advantages")


@register("rl_masked_whiten", f"""WITH {TOK}, raw AS (SELECT r AS x, m FROM tok), mo AS ({WHITE}), va AS ({VAR}) SELECT n::DOUBLE AS n_masked, {t.r6_sql('mean')} AS masked_mean, {t.r6_sql('var', 9)} AS masked_var FROM mo, va""")
def rl_masked_whiten(spark, sf):
    m = ro.masked_moments(samples(spark, sf), "token_rewards")
    return m.select("n_masked", r6("masked_mean").alias("masked_mean"), r6("masked_var", 9).alias("masked_var"))


@register("rl_apply_kl", f"""WITH {TOK} SELECT sample_id, {t.r6_sql('SUM((exp(rp - lp) - (rp - lp) - 1) * m) / (SUM(m) + 1e-8::DOUBLE)', 9)} AS kl, {t.r6_sql('SUM(r - 0.1 * (exp(rp - lp) - (rp - lp) - 1) * m)')} AS reward FROM tok GROUP BY 1""")
def rl_apply_kl(spark, sf):
    k = ro.apply_kl(samples(spark, sf), 0.1, "low_var_kl")
    return k.select("sample_id", r6("kl", 9).alias("kl"), r6(ro._sum(F.col("token_rewards"))).alias("reward"))


@register("rl_aggregate_loss", f"""WITH {TOK}, s AS (SELECT SUM(r * m) AS s, SUM(m) AS n, COUNT(*) AS len FROM tok GROUP BY sample_id)
 SELECT 'token-mean' AS mode, {t.r6_sql('SUM(s) / (SUM(n) + 1e-8::DOUBLE)')} AS loss FROM s UNION ALL SELECT 'seq-mean-token-sum', {t.r6_sql('AVG(s)')} FROM s
 UNION ALL SELECT 'seq-mean-token-mean', {t.r6_sql('AVG(s / n) FILTER (n > 0)')} FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', {t.r6_sql('SUM(s) / MAX(len)')} FROM s""")
def rl_aggregate_loss(spark, sf):
    rows, out = samples(spark, sf), None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        one = ro.aggregate_loss(rows, "token_rewards", "mask", mode).select(F.lit(mode).alias("mode"), r6("loss").alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@register("rl_batch_metrics")
def rl_batch_metrics(spark, sf):
    return ro.batch_metrics(ro.gae(samples(spark, sf)), 7)


@register("rl_best_of_n", f"""WITH r AS (SELECT DISTINCT user_id AS uid, value, (COUNT(*) OVER (PARTITION BY user_id ORDER BY value))::DOUBLE / COUNT(*) OVER (PARTITION BY user_id) AS hi, (COUNT(*) OVER (PARTITION BY user_id ORDER BY value) - COUNT(*) OVER (PARTITION BY user_id, value))::DOUBLE / COUNT(*) OVER (PARTITION BY user_id) AS lo FROM events)
 SELECT uid, {t.r6_sql('SUM((pow(hi, 4) - pow(lo, 4)) * value)', 5)} AS best_mean, {t.r6_sql('SUM((pow(1 - lo, 4) - pow(1 - hi, 4)) * value)', 5)} AS worst_mean FROM r GROUP BY 1""")
def rl_best_of_n(spark, sf):
    b = ro.best_of_n(scores(spark, sf), 4)
    return b.select("uid", r6("best_mean", 5).alias("best_mean"), r6("worst_mean", 5).alias("worst_mean"))


DRAWS = """sl AS (SELECT user_id AS uid, value, event_type AS pred, COUNT(*) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY md5('42-' || event_id)) AS slot FROM events),
 pk AS (SELECT i, j, CAST('0x' || substr(md5('42-' || i || '-' || j), 1, 8) AS BIGINT) AS h FROM (SELECT unnest(range(1, 101)) AS i), (SELECT unnest(range(1, 5)) AS j)),
 dr AS (SELECT uid, i, j, value, pred FROM (SELECT DISTINCT uid, m FROM sl) u CROSS JOIN pk JOIN sl USING (uid) WHERE slot = h % u.m + 1)"""


@register("rl_bootstrap_best_of_n", f"""WITH {DRAWS}, d AS (SELECT uid, i, MAX(value) AS b, MIN(value) AS w FROM dr GROUP BY 1, 2)
 SELECT uid, {t.r6_sql('AVG(b)', 5)} AS best_mean, {t.r6_sql('stddev_pop(b)', 5)} AS best_std, {t.r6_sql('AVG(w)', 5)} AS worst_mean, {t.r6_sql('stddev_pop(w)', 5)} AS worst_std FROM d GROUP BY 1""")
def rl_bootstrap_best_of_n(spark, sf):
    b = ro.bootstrap_best_of_n(scores(spark, sf), 4, 100)
    return b.select("uid", *[r6(c, 5).alias(c) for c in ("best_mean", "best_std", "worst_mean", "worst_std")])


@register("rl_bootstrap_majority", f"""WITH {DRAWS}, v AS (SELECT uid, i, pred, COUNT(*) AS n, MIN(j) AS f, arg_min(value, j) AS value FROM dr GROUP BY 1, 2, 3), w AS (SELECT uid, i, arg_max(value, (n, -f)) AS value FROM v GROUP BY 1, 2)
 SELECT uid, {t.r6_sql('AVG(value)', 5)} AS majority_mean, {t.r6_sql('stddev_pop(value)', 5)} AS majority_std FROM w GROUP BY 1""")
def rl_bootstrap_majority(spark, sf):
    b = ro.bootstrap_votes(scores(spark, sf), 4, 100, pred="data_source")
    return b.select("uid", *[r6(c, 5).alias(c) for c in ("majority_mean", "majority_std")])


@register("rl_majority_vote", """WITH v AS (SELECT user_id AS uid, event_type AS pred, COUNT(*) AS n_votes, MIN(event_id) AS f, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n_votes DESC, f) AS rn FROM v) SELECT uid, pred, n_votes, value FROM r WHERE rn = 1""")
def rl_majority_vote(spark, sf):
    return ro.majority_vote(scores(spark, sf).withColumnRenamed("data_source", "pred"))


@register("rl_validation_rollup", f"""WITH p AS (SELECT event_type AS data_source, user_id, AVG(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1, 2) SELECT data_source, {t.r6_sql('AVG(m)')} AS mean, {t.r6_sql('AVG(s)')} AS std, COUNT(*) AS n_prompts FROM p GROUP BY 1""")
def rl_validation_rollup(spark, sf):
    return ro.validation_rollup(scores(spark, sf)).select("data_source", r6("mean").alias("mean"), r6("std").alias("std"), "n_prompts")


@register("rl_overlong_penalty", f"SELECT doc_id, {t.r6_sql('least(-(n_chars - 3000) / 1000.0::DOUBLE * 0.5, 0)')} AS penalty FROM documents")
def rl_overlong_penalty(spark, sf):
    return t.load(spark, sf, "documents").select("doc_id", r6(ro.overlong_penalty(F.col("n_chars"), 4000, 1000, 0.5)).alias("penalty"))


NORM = r"""array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"""
QA = f"""WITH src AS (SELECT a.conv_id, a.turn, a.text AS response, b.text AS gold FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
 nn AS (SELECT conv_id, turn, {NORM.format('response')} AS p, {NORM.format('gold')} AS q FROM src),
 w AS (SELECT conv_id, turn, unnest(string_split(p, ' ')) AS w, 1 AS a, 0 AS b FROM nn UNION ALL SELECT conv_id, turn, unnest(string_split(q, ' ')), 0, 1 FROM nn),
 c AS (SELECT conv_id, turn, w, SUM(a) AS a, SUM(b) AS b FROM w WHERE w <> '' GROUP BY 1, 2, 3),
 s AS (SELECT conv_id, turn, SUM(least(a, b)) AS same, SUM(a) AS la, SUM(b) AS lb FROM c GROUP BY 1, 2),
 sc AS (SELECT conv_id, turn, CASE WHEN p = q THEN 1.0::DOUBLE ELSE 0 END AS em, CASE WHEN contains(p, q) OR contains(q, p) THEN 1.0::DOUBLE ELSE 0 END AS sub_em,
   CASE WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * (same / la::DOUBLE) * (same / lb::DOUBLE) / (same / la::DOUBLE + same / lb::DOUBLE) END AS f1,
   CASE WHEN coalesce(same, 0) = 0 THEN 0 ELSE same / la::DOUBLE END AS prec, CASE WHEN coalesce(same, 0) = 0 THEN 0 ELSE same / lb::DOUBLE END AS rec FROM nn LEFT JOIN s USING (conv_id, turn))"""


def qa(spark, sf):
    turns = t.load(spark, sf, "conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return turns.join(nxt, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("response"), F.array("gold").alias("golds"))


@register("rl_qa_score", f"{QA} SELECT conv_id, turn, em, sub_em, {t.r6_sql('f1')} AS f1, {t.r6_sql('prec')} AS precision, {t.r6_sql('rec')} AS recall FROM sc")
def rl_qa_score(spark, sf):
    return ro.qa_score(qa(spark, sf)).select("id.conv_id", "id.turn", "em", "sub_em", *[r6(c).alias(c) for c in ("f1", "precision", "recall")])


@register("rl_eval_summary", f"{QA} SELECT round(AVG(floor(em * 100 + 0.5) / 100) * 100, 6) AS em, round(AVG(floor(sub_em * 100 + 0.5) / 100) * 100, 6) AS sub_em, round(AVG(floor(f1 * 100 + 0.5) / 100) * 100, 4) AS f1 FROM sc")
def rl_eval_summary(spark, sf):
    return ro.eval_summary(ro.qa_score(qa(spark, sf))).withColumn("f1", F.round("f1", 4))


@register("rl_eval_replicates", f"{QA} SELECT round(SUM(floor(em * 100 + 0.5) / 100 * 4) / (COUNT(*) * 4) * 100, 6) AS em, round(AVG(floor(sub_em * 100 + 0.5) / 100) * 100, 6) AS sub_em, round(AVG(floor(f1 * 100 + 0.5) / 100) * 100, 4) AS f1, (COUNT(*) * 4)::BIGINT AS n_rows FROM sc")
def rl_eval_replicates(spark, sf):
    """The question set asked four times."""
    return ro.eval_summary(ro.qa_score(qa(spark, sf)), sampling=4).withColumn("f1", F.round("f1", 4))


ACT = "SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS action, CASE role WHEN 'user' THEN '<recall>' || text || '</recall>' WHEN 'assistant' THEN '<update>' || text || '</update><update> </update>' ELSE '\\boxed{' || text || '}' END AS response FROM conversations"


def actions(spark, sf):
    c = t.load(spark, sf, "conversations")
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    return c.select("conv_id", "turn", "text", F.when(user, 1).when(bot, 2).otherwise(0).alias("action"), F.when(user, F.concat(F.lit("<recall>"), "text", F.lit("</recall>"))).when(
        bot, F.concat(F.lit("<update>"), "text", F.lit("</update><update> </update>"))).otherwise(F.concat(F.lit("\\boxed{"), "text", F.lit("}"))).alias("response"))


@register("rl_format_reward", f"WITH a AS ({ACT}) SELECT conv_id, turn, CASE WHEN contains(text, chr(10)) OR trim(text) = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reward FROM a")
def rl_format_reward(spark, sf):
    return actions(spark, sf).select("conv_id", "turn", ro.format_reward(F.col("response"), F.col("action")).alias("reward"))


@register("rl_action_metrics", f"WITH a AS ({ACT}) SELECT {t.r6_sql('AVG(len(regexp_extract_all(response, $$<recall>(.*?)</recall>$$)))')} AS recalls, {t.r6_sql('AVG(len(regexp_extract_all(response, $$<update>(.*?)</update>$$)))')} AS updates, COUNT(*) AS n FROM a")
def rl_action_metrics(spark, sf):
    m = ro.action_metrics(actions(spark, sf))
    return m.select(r6("recalls").alias("recalls"), r6("updates").alias("updates"), "n")


RECALL = f"""WITH src AS (SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS gold FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
 w AS (SELECT conv_id, turn, prompt, unnest(regexp_split_to_array(gold, '\\s+')) AS w FROM src) SELECT conv_id, turn, {t.r6_sql("0.5 + AVG(CASE WHEN contains(prompt, w) THEN 1.0::DOUBLE ELSE 0 END)")} AS weight FROM w WHERE w <> '' GROUP BY 1, 2"""


@register("rl_reweight", RECALL)
def rl_reweight(spark, sf):
    return qa(spark, sf).select("id.conv_id", "id.turn", r6(ro.reweight(F.col("response"), F.col("golds"), F.lit(2))).alias("weight"))


@register("rl_answer_extract", """SELECT item_id, CASE WHEN item_id >= 0 THEN regexp_replace(trim(replace(text, '*', '')), '^\\.+|\\.+$', '', 'g') END AS answer FROM benchmark""")
def rl_answer_extract(spark, sf):
    text = F.concat(F.lit("So <b>**</b> the answer is "), F.col("text"))
    return t.load(spark, sf, "benchmark").select("item_id", ro.answer_extract(text).alias("answer"))


@register("rl_boxed_score", "SELECT item_id, CASE WHEN length(text) <= 292 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM benchmark")
def rl_boxed_score(spark, sf):
    b = t.load(spark, sf, "benchmark").select("item_id", F.concat(F.lit("so \\boxed{"), "text", F.lit("}")).alias("solution"), F.array("text").alias("golds"))
    return ro.boxed_score(b, "item_id")


@register("rl_eval_by_source", f"WITH x AS (SELECT source, doc_id, AVG(length(l)) AS m FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1, 2) SELECT source, {t.r6_sql('AVG(m)', 4)} AS score, COUNT(*) AS n FROM x GROUP BY 1")
def rl_eval_by_source(spark, sf):
    d = t.load(spark, sf, "documents").withColumn("responses", F.split("text", "\n"))
    return ro.eval_by_source(d, lambda r: F.length(r), "source", "doc_id").withColumn("score", r6("score", 4))


def tokens(spark, sf):
    return t.load(spark, sf, "conversations").withColumn("tokens", F.filter(F.split("text", r"\s+"), lambda w: w != ""))


@register("rl_loss_mask", """WITH w AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations),
 c AS (SELECT *, SUM(n) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM w)
 SELECT conv_id, CAST(least(SUM(n), 128) AS BIGINT) AS n_tokens, CAST(SUM(CASE WHEN role = 'assistant' THEN greatest(least(e, 128) - (e - n), 0) ELSE 0 END) AS BIGINT) AS n_loss FROM c GROUP BY 1""")
def rl_loss_mask(spark, sf):
    m = ro.multiturn_loss_mask(tokens(spark, sf), 128)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("conv_id", total("attention_mask").alias("n_tokens"), total("loss_mask").alias("n_loss"))


WORDS = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"


def doc_tokens(spark, sf):
    return t.load(spark, sf, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("tokens"))


@register("rl_filter_overlong", f"{WORDS} SELECT doc_id, len(w)::BIGINT AS n FROM w WHERE len(w) <= 200")
def rl_filter_overlong(spark, sf):
    return ro.filter_overlong(doc_tokens(spark, sf), "tokens", 200).select("doc_id", F.size("tokens").cast("long").alias("n"))


@register("rl_pad_truncate", f"{WORDS} SELECT doc_id, array_to_string(CASE WHEN len(w) <= 32 THEN list_concat(w, list_transform(range(32 - len(w)), lambda x: '_')) ELSE list_concat(w[1:16], w[len(w) - 15:]) END, ' ') AS text FROM w")
def rl_pad_truncate(spark, sf):
    return doc_tokens(spark, sf).select("doc_id", F.concat_ws(" ", ro.pad_truncate(F.col("tokens"), 32, "center", pad="_")).alias("text"))


@register("rl_chunk_context", f"{WORDS}, s AS (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 100.0) AS BIGINT))) AS step FROM w) SELECT doc_id, step, array_to_string(w[step * 100 + 1 : step * 100 + 100], ' ') AS chunk FROM s")
def rl_chunk_context(spark, sf):
    c = ro.chunk_context(doc_tokens(spark, sf), "tokens", 100, "doc_id")
    return c.select("doc_id", F.col("step").cast("long").alias("step"), F.concat_ws(" ", "chunk").alias("chunk"))


@register("rl_balance_partitions")
def rl_balance_partitions(spark, sf):
    d = t.load(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.col("n_chars").alias("n_tokens"))
    return ro.balance_partitions(d, 16)


@register("rl_micro_batches", "WITH k AS (SELECT CAST(ceil(SUM(n_chars) / 20000.0) AS BIGINT) AS k, COUNT(*) AS n, SUM(n_chars)::BIGINT AS t FROM documents) SELECT k AS n_parts, n // k AS fewest, (n + k - 1) // k AS most, t AS n_tokens FROM k")
def rl_micro_batches(spark, sf):
    """The laws of the deal: as many groups as the tokens ask for, sizes that differ by one at most, every token once."""
    d = t.load(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.col("n_chars").alias("n_tokens"))
    parts = ro.micro_batches(d, 20_000).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("s"))
    return parts.agg(F.count(F.lit(1)).alias("n_parts"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.sum("s").alias("n_tokens"))


RECALL = "list_avg(list_transform(golds, lambda g: CASE WHEN len({w}) > 0 THEN len(list_filter({w}, lambda w: contains({x}, w)))::DOUBLE / len({w}) ELSE 0 END))"
GOLD_WORDS = "list_filter(regexp_split_to_array(g, '\\s+'), lambda v: v <> '')"


def _recall(text: str) -> str:
    return RECALL.format(w=GOLD_WORDS, x=text)


@register("rl_recall_reward", f"""WITH s AS (SELECT a.conv_id, a.turn, '<memory>' || a.text || '</memory> ' || a.role AS prompt, 'x <update>' || left(b.text, 60) || '</update>' AS response, right(b.text, 80) AS recalled, [left(b.text, 30), right(b.text, 40), ''] AS golds
   FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
 r AS (SELECT *, regexp_extract(prompt, '<memory>(.*?)</memory>', 1) AS o, regexp_extract(response, '<update>(.*?)</update>', 1) AS n FROM s)
 SELECT conv_id, turn, {t.r6_sql(f"{_recall('n')} - {_recall('o')} + greatest(0, {_recall('(recalled || chr(32) || prompt)')} - {_recall('prompt')})")} AS reward FROM r""")
def rl_recall_reward(spark, sf):
    c = t.load(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    rows = c.join(nxt, ["conv_id", "turn"])
    prompt = F.concat(F.lit("<memory>"), "text", F.lit("</memory> "), "role")
    response = F.concat(F.lit("x <update>"), F.substring("b", 1, 60), F.lit("</update>"))
    end = lambda n: F.expr(f"right(b, {n})")
    golds = F.array(F.substring("b", 1, 30), end(40), F.lit(""))
    return rows.select("conv_id", "turn", r6(ro.recall_reward(prompt, response, end(80), golds)).alias("reward"))


@register("rl_imbalance_stats", f"""WITH p AS (SELECT source, SUM(n_chars) AS t FROM documents GROUP BY 1) SELECT CAST(MIN(t) AS BIGINT) AS minmax_min, CAST(MAX(t) AS BIGINT) AS minmax_max, CAST(MAX(t) - MIN(t) AS BIGINT) AS diff, {t.r6_sql('AVG(t)')} AS mean, COUNT(*) AS n_parts FROM p""")
def rl_imbalance_stats(spark, sf):
    return ro.imbalance_stats(t.load(spark, sf, "documents"), "n_chars", "source").withColumn("mean", r6("mean"))


@register("rl_token_cost", """SELECT event_type, round(SUM(round((CASE event_type WHEN 'click' THEN value * 2 + user_id * 8 WHEN 'view' THEN value * 0.5 + user_id * 1.5 WHEN 'purchase' THEN value * 3 + user_id * 15 ELSE 0 END) / 1000000.0::DOUBLE, 6)), 4) AS cost FROM events GROUP BY 1""")
def rl_token_cost(spark, sf):
    usage = t.load(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("value").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    prices = spark.createDataFrame([("click", 2.0, 8.0), ("vie", 0.5, 1.5), ("purchase", 3.0, 15.0)], "fragment string, input_price double, output_price double")
    return ro.token_cost(usage, prices).groupBy(F.col("model").alias("event_type")).agg(F.round(F.sum("cost"), 4).alias("cost"))
