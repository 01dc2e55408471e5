"""Message-stream operators; every one takes and returns a (streaming) DataFrame.

messages(channel, message_id, chat_id, sender_id, ts, is_group, was_mentioned, content).
They compose with ``DataFrame.transform``; a dropped message reaches no later step.
Time is event time; late rows are bounded by ``withWatermark``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType


def _by_time(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = list(frames)
    return pd.concat(rows).sort_values("ts", kind="stable") if rows else pd.DataFrame()


#: Messages of a key that are Python objects at a time; the others wait as Arrow strings.
CHUNK = 10_000


def _chunks(frames: Iterator[pd.DataFrame], texts: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of a key by time, at most ``CHUNK`` at once: the columns ``texts`` wait as Arrow strings, not as an object each."""
    parts = [f.astype(dict.fromkeys(texts, "string[pyarrow]")) for f in frames]
    rows = pd.concat(parts) if parts else pd.DataFrame()
    parts.clear()  # never more than two copies of the rows
    rows = rows.sort_values("ts", kind="stable") if len(rows) else rows
    for at in range(0, len(rows), CHUNK):
        part = rows.iloc[at : at + CHUNK]
        yield part.assign(**{c: part[c].astype(object).where(part[c].notna(), None) for c in texts})


def _expire(state: GroupState, second: float) -> None:
    """End the state at ``second`` of event time; at once if the watermark is already there."""
    if state.getCurrentWatermarkMs() < int(second * 1000):
        state.setTimeoutTimestamp(int(second * 1000))
    else:
        state.remove()


def stream_dedup_fixed(messages: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Cheap form: the first copy per id within the watermark; null ids pass."""
    with_id = messages.filter("message_id IS NOT NULL").withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["message_id"])
    return with_id.unionByName(messages.filter("message_id IS NULL").withWatermark("ts", ttl))


def stream_dedup(messages: DataFrame, ttl: int = 3600, watermark: str = "10 minutes") -> DataFrame:
    """Drop a repeated message_id within ``ttl`` seconds of its last sight; a repeat refreshes the time. Null ids pass.

    State is one timestamp per id and ends by event-time timeout.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _by_time(frames)
        last = state.get[0] if state.exists else None
        keep = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            keep.append(last is None or now - last > ttl)
            last = max(now, last or now)
        state.update((last,))
        _expire(state, last + ttl)
        yield rows[keep]

    named = messages.filter("message_id IS NOT NULL").withWatermark("ts", watermark)
    passed = named.groupBy("message_id").applyInPandasWithState(step, messages.schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)
    return passed.unionByName(messages.filter("message_id IS NULL").withWatermark("ts", watermark))


def stream_rate_limit(messages: DataFrame, n: int = 60, window: int = 3600, admins: tuple[str, ...] = (), watermark: str = "10 minutes") -> DataFrame:
    """At most ``n`` accepted messages per sender in any ``window`` seconds; admins and n <= 0 bypass.

    State holds the accepted times only, at most n of them.
    """
    if n <= 0:
        return messages

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _by_time(frames)
        times = list(state.get[0]) if state.exists else []
        keep = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            times = [x for x in times if now - x < window]
            ok = len(times) < n
            keep.append(ok)
            if ok:
                times.append(now)
        state.update((times,))
        _expire(state, (times[-1] if times else 0) + window)
        yield rows[keep]

    limited = messages.filter(~F.coalesce(F.col("sender_id").isin(list(admins)), F.lit(False))).withWatermark("ts", watermark)
    passed = limited.groupBy("sender_id").applyInPandasWithState(step, messages.schema, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    if not admins:
        return passed
    return passed.unionByName(messages.filter(F.col("sender_id").isin(list(admins))).withWatermark("ts", watermark))


def stream_allow_list(messages: DataFrame, chats: DataFrame | None = None, senders: DataFrame | None = None) -> DataFrame:
    """Keep allowed chats and senders; None leaves that side unrestricted."""
    if chats is not None:
        messages = messages.join(chats.select("chat_id"), "chat_id", "left_semi")
    if senders is not None:
        messages = messages.join(senders.select("sender_id"), "sender_id", "left_semi")
    return messages


def stream_mention_gate(messages: DataFrame, mode: str = "group", handle: str = "bot") -> DataFrame:
    """off passes all; always needs a mention; group needs one in groups only. A group's mention is cut from the text."""
    if mode == "off":
        return messages
    kept = messages.filter(F.col("was_mentioned") | (~F.col("is_group") if mode == "group" else F.lit(False)))
    bare = F.trim(F.regexp_replace("content", f"(?i)@{handle}\\s*", ""))
    return kept.withColumn("content", F.when(F.col("is_group"), bare).otherwise(F.col("content")))


def stream_group_context(messages: DataFrame, most: int = 50, age: int = 3600, shown: int = 20, watermark: str = "10 minutes") -> DataFrame:
    """Hold unmentioned group messages per chat; a mention gets the last ``shown`` recent ones in front and clears them."""

    texts = [f.name for f in messages.schema if isinstance(f.dataType, StringType)]

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(x) for x in zip(*state.get)] if state.exists else []
        newest = 0
        for rows in _chunks(frames, texts):
            out = []
            for row in rows.itertuples(index=False):
                now = row.ts.timestamp()
                held = [h for h in held if now - h[0] <= age]
                if row.is_group and not row.was_mentioned:
                    held = (held + [(now, f"{row.sender_id}: {row.content}")])[-most:]
                    continue
                record = row._asdict()
                if row.is_group and held:
                    record["content"] = "\n".join([*[h[1] for h in held[-shown:]], row.content])
                    held = []
                out.append(record)
            newest = rows["ts"].max().timestamp()
            yield pd.DataFrame(out, columns=rows.columns)
        state.update(([h[0] for h in held], [h[1] for h in held]))
        _expire(state, newest + age)

    timed = messages.withWatermark("ts", watermark)
    return timed.groupBy("chat_id").applyInPandasWithState(step, messages.schema, "times array<double>, lines array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_truncate(messages: DataFrame, most: int = 50_000, suffix: str = "... [truncated]") -> DataFrame:
    cut = F.concat(F.substring("content", 1, most), F.lit(suffix))
    return messages.withColumn("content", F.when(F.length("content") > most, cut).otherwise(F.col("content")))


def stream_usage(usage: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes", prices: DataFrame | None = None) -> DataFrame:
    """Calls and tokens per model and window, tumbling or sliding by ``slide``; rows later than the watermark are left out.

    ``prices`` (model, prompt_price, completion_price), per million tokens, adds ``cost``; a model without
    a price costs nothing.
    """
    timed, sums = usage.withWatermark("ts", watermark), [F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")]
    if prices is not None:
        timed = timed.join(F.broadcast(prices), "model", "left")  # one row for each model
        paid = F.col("prompt_tokens") * F.coalesce("prompt_price", F.lit(0.0)) + F.col("completion_tokens") * F.coalesce("completion_price", F.lit(0.0))
        sums.append((F.sum(paid) / 1e6).alias("cost"))
    return timed.groupBy(F.window("ts", window, slide), "model").agg(*sums)


def stream_sessions(messages: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes", keys=("channel", "chat_id")) -> DataFrame:
    return messages.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n_messages"), F.max("ts").alias("last_activity"))


def stream_health(results: DataFrame) -> DataFrame:
    """results(channel, ts, ok, error): successes, failures and the last error per channel."""
    return results.groupBy("channel").agg(
        F.count(F.when(F.col("ok"), 1)).alias("n_success"), F.count(F.when(~F.col("ok"), 1)).alias("n_failure"),
        F.max_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.col("ts"))).alias("last_error"))


def evict_lru(accesses: DataFrame, key: str = "key", most: int = 1000) -> DataFrame:
    """The most recently used keys of accesses(key, ts)."""
    return accesses.groupBy(key).agg(F.max("ts").alias("last_access")).orderBy(F.desc("last_access"), key).limit(most)


def stream_evict_lru(accesses: DataFrame, folder: str, key: str = "key", most: int = 1000):
    """Keep the ``most`` recently used keys of a stream of accesses(key, ts) in a table below ``folder``.

    Each micro-batch is reduced to one row a key, merged with the table the batch before it left, and
    cut to the newest keys (ties: the smaller key).  A table is written under its batch's number, so a batch
    that is run again after a failure writes the same one.  Returns the query; :func:`kept_keys` reads the
    last table.
    """
    spark = accesses.sparkSession
    schema = accesses.select(key, F.col("ts").alias("last_access")).schema

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.max("ts").alias("last_access"))
        old = spark.read.schema(schema).parquet(f"{folder}/keys/{number - 1:012d}") if number else spark.createDataFrame([], schema)
        merged = old.unionByName(new).groupBy(key).agg(F.max("last_access").alias("last_access"))
        merged.orderBy(F.desc("last_access"), key).limit(most).write.mode("overwrite").parquet(f"{folder}/keys/{number:012d}")

    return accesses.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def kept_keys(query, accesses: DataFrame, folder: str, key: str = "key") -> DataFrame:
    """The keys that :func:`stream_evict_lru` keeps after its last micro-batch."""
    last = query.lastProgress["batchId"] if query.lastProgress else None
    schema = accesses.select(key, F.col("ts").alias("last_access")).schema
    spark = accesses.sparkSession
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{folder}/keys/{last:012d}")


def audit_append(events: DataFrame, path: str, checkpoint: str):
    """Append events as JSON lines until the available data is consumed."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
