"""Message streams replayed from the events table, and dataset-level checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellweave.functions.stats import r6
from cellweave.operators.rollouts import repeat_rows
from cellweave.session import ensure_checkpoint_dir
from cellweave.sources import datasets as ds
from cellweave.streaming import messages as ms
from cellweave.plans import tables as t
from cellweave.plans.registry import register


def replay(spark, sf):
    """The events file as a stream of messages; an event type of a user is a message id."""
    schema = t.load(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        F.lit("chat").alias("channel"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("message_id"), F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("chat_id"),
        F.col("user_id").cast("string").alias("sender_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 2 == 0).alias("is_group"), (F.col("event_type") == "error").alias("was_mentioned"),
        F.concat(F.lit("@bot "), F.col("event_id").cast("string")).alias("content"))


def drain(spark, stream):
    """Run a stream to the end of the data into parquet next to the checkpoints, and read it back."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


EV = "ev AS (SELECT event_id, user_id, user_id || '-' || event_type AS message_id, ts, event_type, '@bot ' || event_id AS content FROM events)"


@register("st_dedup", f"WITH {EV}, l AS (SELECT *, lag(ts) OVER (PARTITION BY message_id ORDER BY ts) AS p FROM ev) SELECT message_id, content FROM l WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 3600000000 * 24")
def st_dedup(spark, sf):
    return drain(spark, ms.stream_dedup(replay(spark, sf), 86400)).select("message_id", "content")


@register("st_rate_limit")
def st_rate_limit(spark, sf):
    return drain(spark, ms.stream_rate_limit(replay(spark, sf), 2, 86400, ("1",))).select("sender_id", "content")


@register("st_group_context")
def st_group_context(spark, sf):
    return drain(spark, ms.stream_group_context(replay(spark, sf))).select("chat_id", "content")


@register("st_mention_gate", f"WITH {EV} SELECT message_id, CASE WHEN user_id % 2 = 0 THEN event_id::VARCHAR ELSE content END AS content FROM ev WHERE event_type = 'error' OR user_id % 2 <> 0")
def st_mention_gate(spark, sf):
    return drain(spark, ms.stream_mention_gate(replay(spark, sf))).select("message_id", "content")


@register("st_allow_list", f"WITH {EV} SELECT message_id, content FROM ev WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def st_allow_list(spark, sf):
    allowed = t.load(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("sender_id"))
    return drain(spark, ms.stream_allow_list(replay(spark, sf), senders=allowed)).select("message_id", "content")


@register("st_truncate", f"WITH {EV} SELECT message_id, CASE WHEN length(content) > 8 THEN left(content, 8) || '... [truncated]' ELSE content END AS content FROM ev")
def st_truncate(spark, sf):
    return drain(spark, ms.stream_truncate(replay(spark, sf), 8)).select("message_id", "content")


def usage(spark, sf):
    return t.load(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.col("value").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))


@register("st_usage", f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS model, COUNT(*) AS n_calls, {t.r6_sql('SUM(value)', 4)} AS prompt_tokens, SUM(user_id)::BIGINT AS completion_tokens FROM events GROUP BY 1, 2")
def st_usage(spark, sf):
    u = ms.stream_usage(usage(spark, sf), "1 hour").withColumn("day", F.date_format("window.start", "yyyy-MM-dd"))
    return u.groupBy("day", "model").agg(F.sum("n_calls").alias("n_calls"), r6(F.sum("prompt_tokens"), 4).alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


@register("st_sessions", """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600000000 * 6 THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT *, SUM(f) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM l),
 n AS (SELECT user_id, sid, COUNT(*) AS n_messages FROM s GROUP BY 1, 2) SELECT user_id::VARCHAR AS chat_id, n_messages, COUNT(*) AS n FROM n GROUP BY 1, 2""")
def st_sessions(spark, sf):
    m = t.load(spark, sf, "events").select(F.lit("chat").alias("channel"), F.col("user_id").cast("string").alias("chat_id"), F.col("ts").cast("timestamp").alias("ts"))
    return ms.stream_sessions(m, "6 hours").groupBy("chat_id", "n_messages").agg(F.count(F.lit(1)).alias("n"))


@register("st_health", "SELECT user_id::VARCHAR AS channel, COUNT(*) FILTER (event_type <> 'error') AS n_success, COUNT(*) FILTER (event_type = 'error') AS n_failure, arg_max(props, ts) FILTER (event_type = 'error') AS last_error FROM events GROUP BY 1")
def st_health(spark, sf):
    r = t.load(spark, sf, "events").select(F.col("user_id").cast("string").alias("channel"), "ts", (F.col("event_type") != "error").alias("ok"), F.col("props").alias("error"))
    return ms.stream_health(r)


@register("st_evict_lru", "SELECT user_id AS key FROM events GROUP BY 1 ORDER BY MAX(ts) DESC, 1 LIMIT 50")
def st_evict_lru(spark, sf):
    return ms.evict_lru(t.load(spark, sf, "events").select(F.col("user_id").alias("key"), "ts"), most=50).select("key")


def _raw_stream(spark, sf):
    return spark.readStream.schema(t.load(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@register("st_usage_stream", f"""WITH p AS (SELECT * FROM (VALUES ('view', 2.0::DOUBLE, 8.0::DOUBLE), ('click', 1.0, 4.0), ('purchase', 5.0, 0.5)) v(model, a, b)),
 w AS (SELECT event_type AS model, value, user_id, epoch_us(ts) // 21600000000 - k AS slot, k FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)),
 g AS (SELECT slot, model, COUNT(*) AS n_calls, SUM(user_id)::BIGINT AS completion_tokens, SUM(value * coalesce(a, 0) + user_id * coalesce(b, 0)) / 1e6 AS cost FROM w LEFT JOIN p USING (model) GROUP BY 1, 2)
 SELECT slot, model, n_calls, completion_tokens, {t.r6_sql('cost')} AS cost FROM g""")
def st_usage_stream(spark, sf):
    """A day sliding by six hours, as a stream, with cost; the watermark outlasts the data so that every window counts."""
    raw = _raw_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.col("value").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    prices = spark.createDataFrame([("view", 2.0, 8.0), ("click", 1.0, 4.0), ("purchase", 5.0, 0.5)], "model string, prompt_price double, completion_price double")
    sums = ms.stream_usage(raw, "24 hours", "6 hours", "3650 days", prices)
    name = f"usage_{uuid.uuid4().hex}"
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    query = sums.writeStream.outputMode("complete").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/sums")).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(sums.schema).parquet(f"{folder}/sums")
    slot = F.floor(F.unix_micros("window.start") / F.lit(21_600_000_000)).cast("long")
    return out.select(slot.alias("slot"), "model", "n_calls", "completion_tokens", r6("cost").alias("cost"))


@register("st_evict_stream", "SELECT user_id AS key, MAX(ts) AS last_access FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def st_evict_stream(spark, sf):
    """The fifty users seen last, kept by a stream."""
    accesses = _raw_stream(spark, sf).select(F.col("user_id").alias("key"), "ts")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/lru-{uuid.uuid4().hex}"
    query = ms.stream_evict_lru(accesses, folder, most=50)
    query.awaitTermination()
    return ms.kept_keys(query, accesses, folder).select("key", "last_access")


# ------------------------------------------------------------------- dataset checks
@register("io_unique_ids", "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN p_name || '-' || (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1) ELSE p_name END AS p_name FROM part")
def io_unique_ids(spark, sf):
    return ds.make_unique_ids(t.load(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@register("io_coordinate_report", "SELECT COUNT(*) AS n_rows, 0::BIGINT AS n_missing, 0::BIGINT AS n_non_finite FROM customer")
def io_coordinate_report(spark, sf):
    return ds.coordinate_report(ds.validate_coords(t.cells(spark, sf)))


@register("io_merge_samples", """WITH x AS (SELECT l_returnflag AS batch, l_returnflag || '_' || l_orderkey AS cell_id, l_partkey AS gene_id, l_quantity AS value FROM lineitem WHERE l_returnflag IN ('A', 'R')), k AS (SELECT gene_id FROM x GROUP BY 1 HAVING COUNT(DISTINCT batch) = 2) SELECT batch, gene_id, COUNT(DISTINCT cell_id) AS n_cells, SUM(value) AS total FROM x JOIN k USING (gene_id) GROUP BY 1, 2""")
def io_merge_samples(spark, sf):
    lines = t.load(spark, sf, "lineitem")
    part = lambda f: (lines.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("value")), lines.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("cell_id")).distinct())
    expr, _ = ds.merge_samples([part("A"), part("R")], ["A", "R"])
    return expr.groupBy("batch", "gene_id").agg(F.countDistinct("cell_id").alias("n_cells"), F.sum("value").alias("total"))


@register("io_pair_modalities", f"WITH {t.SQL_CELLS} SELECT cell_id, {t.r6_sql('x', 8)} AS x, {t.r6_sql('y', 8)} AS y FROM cells")
def io_pair_modalities(spark, sf):
    obs = t.cells(spark, sf)
    p = ds.pair_modalities(obs.select("cell_id", "cell_type"), obs)
    return p.select("cell_id", r6("x", 8).alias("x"), r6("y", 8).alias("y"))


@register("rl_repeat_rows", "SELECT event_id, copy::INT AS copy FROM events, (SELECT unnest(range(3)) AS copy)")
def rl_repeat_rows(spark, sf):
    return repeat_rows(t.load(spark, sf, "events"), 3, order="event_id").select("event_id", "copy")
