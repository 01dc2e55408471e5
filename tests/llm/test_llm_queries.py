"""The registered opN_ queries next to their SQL, and the pipeline next to a brute-force run."""

import os

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from cellweave.llm import quality_knn
from cellweave.llm.queries import ORACLE, QUERIES
from test_llm_operators import brute_components, brute_rules, brute_set

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want.select(", ".join(columns)).fetchall()))


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        frames[i] = docs.toPandas()
    source = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    voters = quality_knn.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    voted = source[voters.score(source["text"].tolist()) >= 0.5]
    assert sorted(voted["doc_id"]) == sorted(frames[0]["doc_id"])

    def fine(text):
        n, chars, symbols, dup, again = brute_rules(text)
        return n >= 50 and 100 * again <= 50 * n and 10 * symbols <= n and 2 * n <= chars <= 20 * n

    assert set(frames[1]["doc_id"]) <= {d for d, t in zip(frames[0]["doc_id"], frames[0]["text"], strict=True) if fine(t)}
    left = frames[1].sort_values("doc_id")
    sets = [brute_set(t) for t in left["text"]]
    label = brute_components(len(left), lambda i: [j for j in range(len(left)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    want = set(left["doc_id"].iloc[sorted(set(label))])
    assert want <= set(frames[2]["doc_id"]) and len(frames[2]) - len(want) <= 0.1 * (len(left) - len(want))
    assert set(frames[3]["doc_id"]) <= set(frames[2]["doc_id"]) and frames[3].groupby("doc_id").size().max() <= 2
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in frames[3]["text"])
    assert frames[4]["length"].sum() == ids and frames[4]["sequence_id"].nunique() <= -(-ids // 2048) + 1
    assert sorted(corpus_pipeline.run(spark, SF).toPandas()["ids_crc32"]) == sorted(frames[4]["ids_crc32"])
