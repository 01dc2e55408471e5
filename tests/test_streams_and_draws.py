"""Streams run as streams, draws next to plain loops, and the sweep of a session's log."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import memory, rollouts
from cellweave.streaming import messages


def write_batches(spark, folder, batches, ddl):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/in/{i}")


def stream(spark, folder, ddl):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_eviction_keeps_the_newest_keys_over_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    batches = [[(int(k), int(s)) for k, s in zip(rng.integers(0, 30, 20), rng.integers(0, 1000, 20))] for _ in range(4)]
    ddl = "key long, ts long"
    write_batches(spark, tmp_path, batches, ddl)
    rows = stream(spark, tmp_path, ddl).select("key", F.col("ts").cast("timestamp").alias("ts"))
    query = messages.stream_evict_lru(rows, f"{tmp_path}/lru", most=30)
    query.awaitTermination()
    got = {r["key"]: int(r["last_access"].timestamp()) for r in messages.kept_keys(query, rows, f"{tmp_path}/lru").collect()}
    want = {}
    for k, s in (x for b in batches for x in b):
        want[k] = max(want.get(k, 0), s)
    assert got == want
    small = messages.stream_evict_lru(rows, f"{tmp_path}/small", most=3)
    small.awaitTermination()
    assert messages.kept_keys(small, rows, f"{tmp_path}/small").count() == 3


def test_usage_slides_costs_and_leaves_late_rows_out(spark, tmp_path):
    ddl = "ts long, model string, prompt_tokens long, completion_tokens long"
    write_batches(spark, tmp_path, [[(3600, "a", 100, 10), (5400, "b", 1, 1)], [(36_000, "a", 7, 7)], [(36_100, "a", 1, 1)], [(3700, "a", 1000, 1000)], [(90_000, "c", 1, 1)]], ddl)
    rows = stream(spark, tmp_path, ddl).withColumn("ts", F.col("ts").cast("timestamp"))
    prices = spark.createDataFrame([("a", 2.0, 4.0)], "model string, prompt_price double, completion_price double")
    sums = messages.stream_usage(rows, "2 hours", "1 hour", "10 minutes", prices)
    query = sums.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(int(r["window"]["start"].timestamp()), r["model"]): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {k: (r["n_calls"], r["prompt_tokens"]) for k, r in got.items()} == {
        (0, "a"): (1, 100), (3600, "a"): (1, 100), (0, "b"): (1, 1), (3600, "b"): (1, 1), (32_400, "a"): (2, 8), (36_000, "a"): (2, 8)}
    assert got[(0, "a")]["cost"] == pytest.approx((100 * 2 + 10 * 4) / 1e6) and got[(0, "b")]["cost"] == 0.0


def pick(seed, i, j, m):
    return int(hashlib.md5(f"{seed}-{i}-{j}".encode()).hexdigest()[:8], 16) % m


def test_bootstrap_draws_match_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{p}", i + 100 * p, float(rng.integers(0, 5)), str(rng.choice(["x", "y", "z"]))) for p, n in enumerate((1, 3, 8, 90)) for i in range(n)]
    table = spark.createDataFrame(rows, "uid string, sample_id long, score double, pred string")
    got = {r["uid"]: r for r in rollouts.bootstrap_votes(table, 4, 40, seed=9, pred="pred").collect()}
    for uid in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == uid), key=lambda r: hashlib.md5(f"9-{r[1]}".encode()).hexdigest())
        draws = [[own[pick(9, i, j, len(own))] for j in range(1, 5)] for i in range(1, 41)]
        def vote(d):
            kinds = list(dict.fromkeys(x[3] for x in d))
            winner = max(kinds, key=lambda k: sum(x[3] == k for x in d))
            return next(x[2] for x in d if x[3] == winner)

        for name, fn in (("best", lambda d: max(x[2] for x in d)), ("worst", lambda d: min(x[2] for x in d)), ("majority", vote)):
            values = [fn(d) for d in draws]
            assert got[uid][f"{name}_mean"] == pytest.approx(np.mean(values)) and got[uid][f"{name}_std"] == pytest.approx(np.std(values), abs=1e-9)


def test_replicates_are_weights(spark):
    scores = spark.createDataFrame([(0.123, 1.0, 0.5, "a"), (0.456, 0.0, 0.25, ""), (0.9, 0.0, 0.0, None)], "em double, sub_em double, f1 double, out string")
    row = rollouts.eval_summary(scores, sampling=3, output="out").first()
    assert (row["em"], row["sub_em"], row["f1"], row["n_rows"]) == (12.0, 100.0, 50.0, 3)


def test_the_sweep_follows_created_rows(spark):
    j = json.dumps
    log = [
        ("nodes", "A", None, j({"uuid": "A"})), ("nodes", "B", None, j({"uuid": "B"})), ("nodes", "C", "{}", j({"uuid": "C"})), ("nodes", "S", None, j({"uuid": "S"})),
        ("edges", "1", None, j({"id": 1, "child_uuid": "A"})), ("edges", "2", None, j({"id": 2, "child_uuid": "B"})), ("edges", "3", None, j({"id": 3, "child_uuid": "S"})), ("edges", "4", None, j({"id": 4, "child_uuid": "S"})),
        ("paths", "p1", None, j({"edge_id": 1})), ("paths", "p2", None, j({"edge_id": 2})), ("paths", "p3", None, j({"edge_id": 3})), ("paths", "p4", None, j({"edge_id": 4})),
        ("memories", "m1", None, j({"node_uuid": "A"})), ("memories", "m2", None, j({"node_uuid": "B"})), ("memories", "m3", None, j({"node_uuid": "C"})), ("memories", "m4", "{}", j({"node_uuid": "B"})),
        ("glossary_keywords", "g1", None, j({"node_uuid": "B"})), ("glossary_keywords", "g2", None, j({"node_uuid": "S"})),
        ("paths", "p2", j({"edge_id": 2}), None), ("paths", "p4", j({"edge_id": 4}), None),
    ]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(log)], "seq int, tbl string, key string, before string, after string")
    left = {(r["tbl"], r["key"]) for r in memory.changeset_gc(table).collect()}
    gone = {(t, k) for t, k, _, _ in log} - left
    # B hung on p2 alone; S is shared and keeps its other way; what existed before stays
    assert gone == {("paths", "p2"), ("paths", "p4"), ("nodes", "B"), ("edges", "2"), ("edges", "4"), ("memories", "m2"), ("glossary_keywords", "g1")}
    quiet = table.filter("seq < 18 and key not in ('p2', 'p4')")
    assert memory.changeset_gc(quiet).count() == quiet.count()
