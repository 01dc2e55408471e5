import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellweave.operators import memory, rollouts
from cellweave.operators import text as tx
from cellweave.streaming import messages as ms


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("v")).first()["v"]


def test_nested_boxed_answer(spark):
    df = spark.createDataFrame([("a", r"so \boxed{x} then \boxed{\frac{1}{2}}", [r"\frac{1}{2}"]), ("b", "nothing", ["x"])], "id string, solution string, golds array<string>")
    assert {r["id"]: r["score"] for r in rollouts.boxed_score(df).collect()} == {"a": 1.0, "b": 0.0}


def test_qa_guards_and_best_gold(spark):
    df = spark.createDataFrame([("a", "yes", ["no", "yes"]), ("b", "The red cat", ["a cat", "blue dog"]), ("c", None, ["x"]), ("d", "yes it is", ["yes"])], "id string, response string, golds array<string>")
    got = {r["id"]: r for r in rollouts.qa_score(df).collect()}
    assert got["a"]["em"] == 1.0 and got["a"]["f1"] == 1.0
    assert got["b"]["f1"] == pytest.approx(2 / 3) and got["b"]["sub_em"] == 1.0
    assert got["c"]["f1"] == 0.0 and got["c"]["em"] == 0.0 and got["d"]["f1"] == 0.0


def test_padding_and_truncation(spark):
    ids = F.array(*[F.lit(i) for i in range(1, 8)])
    cut = lambda mode, n=4, **k: one(spark, rollouts.pad_truncate(ids, n, mode, **k))
    assert cut("left") == [4, 5, 6, 7] and cut("right") == [1, 2, 3, 4] and cut("center") == [1, 2, 6, 7]
    assert cut("right", 9) == [1, 2, 3, 4, 5, 6, 7, 0, 0] and cut("right", 9, pad_side="left") == [0, 0, 1, 2, 3, 4, 5, 6, 7]
    with pytest.raises(Exception, match="too long"):
        cut("error")


def test_balanced_parts(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101 + 1) for i in range(96)], "sample_id long, n_tokens long")
    parts = rollouts.balance_partitions(df, 8)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert sizes == [12] * 8
    assert rollouts.imbalance_stats(parts).first()["diff"] < 60


def test_gae_against_a_loop(spark):
    r, v, m = [1.0, 0.0, 2.0], [0.5, 0.2, 0.1], [1, 1, 0]
    df = spark.createDataFrame([(1, r, v, m), (2, [0.5], [0.0], [1])], "sample_id int, token_rewards array<double>, values array<double>, mask array<int>")
    adv, nxt = [], 0.0
    for t in (2, 1, 0):
        nxt = r[t] + 0.9 * (v[t + 1] if t < 2 else 0.0) - v[t] + 0.9 * 0.8 * nxt
        adv.insert(0, nxt)
    got = rollouts.gae(df, 0.9, 0.8).filter("sample_id = 1").first()["returns"]
    assert got == pytest.approx([a + b for a, b in zip(adv, v)])


def test_documents_and_distractors(spark):
    rows = [(f"q{i}", f"who is {i}", [f"a{i}"], [(f"t{i}", "x"), (f"u{i}", "y")], [f"t{i}"] if i else ["missing"]) for i in range(6)]
    qa = spark.createDataFrame(rows, "id string, question string, golds array<string>, docs array<struct<title:string,text:string>>, supporting array<string>")
    pool, questions = rollouts.build_doc_pool(qa)
    assert pool.count() == 12 and {r["id"] for r in questions.collect()} == {f"q{i}" for i in range(1, 6)}
    for r in rollouts.sample_distractors(questions, pool, 5).collect():
        assert len(r["docs"]) == len(set(r["docs"])) == 5 and r["question"].endswith("?") and all(0 <= i < 5 for i in r["evidence_idx"])


def test_tokens_and_snippets(spark):
    assert one(spark, tx.tokenize(F.lit("a/b.c a 空间x-d"))) == ["a", "b", "c", "空", "间", "x", "d"]
    assert one(spark, tx.snippet(F.lit("z" * 50 + "Hit here" + "y" * 50), "hit")) == "..." + "z" * 30 + "Hit here" + "y" * 25 + "..."
    assert one(spark, tx.focus_terms(F.lit("Domain 3, cluster-3 and cell type 1"))) == ["cluster_3", "domain_3", "cell_type_1"]
    e = one(spark, tx.extract_entities(F.lit("Mouse small intestine on Visium HD")))
    assert (e["organism"], e["technology"], e["tissue"]) == ("Mus musculus", "Visium HD, 10x Visium", "small intestine")


def test_graph_paths_and_cycles(spark):
    edges = spark.createDataFrame([(1, "r", "a", "a"), (2, "a", "b", "b"), (3, "b", "a", "back")], "id long, parent_uuid string, child_uuid string, name string")
    roots = spark.createDataFrame([("d", "", "r")], "domain string, path string, node_uuid string")
    none = spark.createDataFrame([], "domain string, path string, edge_id long")
    assert {(r["path"], r["edge_id"]) for r in memory.materialize_paths(edges, roots, none).collect()} == {("a", 1), ("a/b", 2)}
    ask = spark.createDataFrame([("b", "r"), ("r", "b")], "parent_uuid string, child_uuid string")
    assert {(r["parent_uuid"], r["cycle"]) for r in memory.would_create_cycle(edges, ask).collect()} == {("b", True), ("r", False)}


def test_glossary_is_plain_substring(spark):
    docs = spark.createDataFrame([(1, "abcde fg"), (2, "xx"), (3, "cdefcdef")], "doc_id int, text string")
    words = ["bcde", "cde", "fg", "x", "cdef", "e f", "zzzz"]
    keys = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = {(r["doc_id"], w) for r in docs.collect() for w in words if w in r["text"]}
    assert {tuple(r) for r in memory.match_glossary(docs, keys).collect()} == want


def test_rule_ops(spark):
    text = "ADD: be kind.\nREMOVE 2: old rule.\nAGREE 3: no stop\nnoise."
    got = [tuple(x) for x in one(spark, memory.parse_rule_ops(F.lit(text)))]
    assert got == [("ADD", None, "be kind."), ("REMOVE", 2, "old rule.")]


MESSAGE = "channel string, message_id string, chat_id string, sender_id string, ts timestamp, is_group boolean, was_mentioned boolean, content string"


def message(i, seconds, sender="s", mid=None, group=False, mentioned=False, chat="c"):
    return ("ch", mid or f"m{i}", chat, sender, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds), group, mentioned, f"t{i}")


def run(spark, tmp_path, batches, operator):
    """Feed each batch as its own file and return the contents that came through."""
    source = tmp_path / "in"
    source.mkdir()
    stream = operator(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).json(str(source)))
    for batch in batches:
        spark.createDataFrame(batch, MESSAGE).coalesce(1).write.mode("append").json(str(source))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return sorted(r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_repeats_refresh_the_ttl(spark, tmp_path):
    batch = [message(1, 0, mid="x"), message(2, 50, mid="x"), message(3, 120, mid="x"), message(4, 300, mid="x")]
    assert run(spark, tmp_path, [batch[:2], batch[2:]], lambda m: ms.stream_dedup(m, 100)) == ["t1", "t4"]


def test_only_accepted_messages_count(spark, tmp_path):
    batch = [message(i, s) for i, s in enumerate([0, 1, 2, 100, 101, 102])] + [message(9, 3, sender="boss")]
    assert run(spark, tmp_path, [batch], lambda m: ms.stream_rate_limit(m, 2, 100, ("boss",))) == ["t0", "t1", "t3", "t4", "t9"]


def test_group_context_is_prepended_and_cleared(spark, tmp_path):
    rows = [message(1, 0, group=True), message(2, 10, group=True), message(3, 20, group=True, mentioned=True), message(4, 30, group=True, mentioned=True)]
    got = run(spark, tmp_path, [rows], lambda m: ms.stream_group_context(m))
    assert got == ["s: t1\ns: t2\nt3", "t4"]


def test_late_rows_do_not_reopen_windows(spark, tmp_path):
    late = [[message(1, 0), message(2, 30)], [message(3, 90000)], [message(4, 5)], [message(5, 90001)]]
    count = lambda m: ms.stream_sessions(m, "10 minutes", "1 minute").select(F.concat_ws("/", "chat_id", F.col("n_messages").cast("string")).alias("content"))
    assert run(spark, tmp_path, late, count) == ["c/2"]
