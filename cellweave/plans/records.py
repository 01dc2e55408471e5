"""Sources and sinks, selections, recall, text cleaning and rollout bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.stats import r6
from cellweave.operators import domains as dm
from cellweave.operators import dynamics as dy
from cellweave.operators import enrichment as en
from cellweave.operators import features, normalize
from cellweave.operators import memory as me
from cellweave.operators import rollouts as ro
from cellweave.operators import text as tx
from cellweave.operators import tissue as ts
from cellweave.plans import tables as t
from cellweave.plans.biology import WILCOXON
from cellweave.plans.knowledge import TREE, edges, memories, paths
from cellweave.plans.registry import register
from cellweave.session import shared_folder
from cellweave.sources import datasets


# ---------------------------------------------------------------- sources and sinks
@register("io_write_tables", "SELECT l_returnflag AS flag, l_linestatus AS status, COUNT(*) AS n_lines, SUM(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1, 2")
def io_write_tables(spark, sf):
    summary = t.load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_linenumber").cast("long").alias("total"))
    folder = shared_folder(spark, "tables")
    datasets.write_tables({"summary": summary}, folder)
    return spark.read.option("header", True).schema("flag string, status string, n_lines long, total long").csv(f"{folder}/summary")


@register("io_summary_json", "SELECT o_orderstatus AS status, COUNT(*) AS n_orders, MAX(o_orderkey) AS last_key FROM orders GROUP BY 1")
def io_summary_json(spark, sf):
    summary = t.load(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("last_key"))
    folder = shared_folder(spark, "summary")
    datasets.write_summary_json(summary, folder)
    return spark.read.schema("status string, n_orders long, last_key long").json(folder)


@register("io_record_run", "SELECT 'count' AS skill, 'events' AS method, COUNT(*)::VARCHAR AS n_rows, 2::BIGINT AS n_runs FROM events")
def io_record_run(spark, sf):
    folder, n = shared_folder(spark, "runs"), t.load(spark, sf, "events").count()
    for _ in range(2):
        datasets.record_run(spark, folder, "count", "events", {"n_rows": n})
    log = spark.read.parquet(folder)
    return log.groupBy("skill", "method", F.col("params")["n_rows"].alias("n_rows")).agg(F.countDistinct("run_id").alias("n_runs"))


@register("io_dump_and_read_records", "SELECT event_id AS id, event_type AS output, round(value, 6) AS score FROM events")
def io_dump_and_read_records(spark, sf):
    folder = shared_folder(spark, "generations")
    rows = t.load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("output"), r6("value").alias("score"))
    datasets.dump_generations(rows.filter("id % 2 = 0"), folder, 1)
    rows.filter("id % 2 = 1").write.parquet(f"{folder}/rest.parquet")
    spark.read.json(f"{folder}/step=1").select(*rows.columns).write.json(f"{folder}/first.jsonl")
    return datasets.read_records(spark, [f"{folder}/first.jsonl", f"{folder}/rest.parquet"]).select("id", "output", "score")


@register("io_read_matrix", f"WITH {t.SQL_COUNTS}, {t.SQL_CELLS}, {t.SQL_GENES} SELECT sample_id, symbol, SUM(value) AS total FROM counts JOIN cells USING (cell_id) JOIN genes USING (gene_id) GROUP BY 1, 2")
def io_read_matrix(spark, sf):
    s = lambda c: F.col(c).cast("string").alias(c)
    folder = shared_folder(spark, "matrix")
    datasets.write_tables({
        "obs": t.cells(spark, sf).select(s("cell_id"), "sample_id", "cell_type", "x", "y"), "var": t.genes(spark, sf).select(s("gene_id"), "symbol"),
        "expr": t.counts(spark, sf).select(s("cell_id"), s("gene_id"), F.col("value").cast("double"))}, folder)
    read = datasets.read_matrix(spark, folder, "csv", "visium")
    return read["expr"].join(read["obs"], "cell_id").join(read["var"], "gene_id").groupBy("sample_id", "symbol").agg(F.sum("value").alias("total"))


@register("io_read_spots", "SELECT 'c' || c_custkey AS cell_id, c_custkey // 40 AS array_row, c_custkey % 40 AS array_col FROM customer WHERE c_custkey % 3 <> 0")
def io_read_spots(spark, sf):
    folder, key = shared_folder(spark, "spots"), F.col("c_custkey")
    rows = t.load(spark, sf, "customer").select(F.concat(F.lit("c"), key.cast("string")), (key % 3 != 0).cast("int"), F.floor(key / 40), key % 40, key % 40 * 10, F.floor(key / 40) * 10)
    rows.write.csv(folder)
    return datasets.read_spots(spark, folder).select("cell_id", F.col("array_row").cast("long").alias("array_row"), F.col("array_col").cast("long").alias("array_col"))


# ---------------------------------------------------------------- selections
@register("select_genes_listed", "SELECT p_partkey AS gene_id FROM part WHERE p_partkey IN (3, 5, 8)")
def select_genes_listed(spark, sf):
    return features.select_genes(t.counts(spark, sf), t.cells(spark, sf), t.genes(spark, sf), genes=[3, 5, 8, -1]).select("gene_id")


@register("expand_obs_pivot", f"WITH {t.SQL_COUNTS} SELECT c_custkey AS cell_id, coalesce(SUM(value) FILTER (gene_id = 3), 0)::DOUBLE AS \"3\", coalesce(SUM(value) FILTER (gene_id = 5), 0)::DOUBLE AS \"5\" FROM customer LEFT JOIN counts ON cell_id = c_custkey GROUP BY 1")
def expand_obs_pivot(spark, sf):
    return features.expand_obs_pivot(t.counts(spark, sf), t.cells(spark, sf), [3, 5])


@register("remap_gene_ids", "SELECT DISTINCT p_name AS gene_id FROM part")
def remap_gene_ids(spark, sf):
    var = t.genes(spark, sf)
    return normalize.remap_gene_ids(var, var.select("symbol"), ["gene_id", "symbol"]).select("gene_id").distinct()


@register("domain_export", "SELECT c_custkey AS cell_id, c_mktsegment AS cell_type, c_acctbal AS dim1, (c_custkey * 2)::DOUBLE AS dim2, NULL::DOUBLE AS dim3 FROM customer")
def domain_export(spark, sf):
    vec = t.load(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), F.array(F.col("c_acctbal").cast("double"), (F.col("c_custkey") * 2).cast("double")).alias("vec"))
    return dm.domain_export(t.cells(spark, sf), vec, "cell_type").select("cell_id", "cell_type", "dim1", "dim2", "dim3")


@register("tr_select_root", "SELECT arg_max(c_custkey, (c_acctbal, c_custkey)) AS overall, arg_min(c_custkey, (c_acctbal, c_custkey)) FILTER (c_mktsegment = 'BUILDING') AS inside FROM customer")
def tr_select_root(spark, sf):
    obs = t.cells(spark, sf)
    whole, inside = dy.select_root(obs, "pseudotime"), dy.select_root(obs, "pseudotime", label="cell_type", kind="BUILDING")
    return obs.filter(F.col("cell_id").isin(whole, inside)).agg(F.max(F.when(F.col("cell_id") == whole, whole)).alias("overall"), F.max(F.when(F.col("cell_id") == inside, inside)).alias("inside"))


# ---------------------------------------------------------------- targets
@register("tg_domain_biomarkers", f"""{WILCOXON}, r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(scores, 9) DESC, gene_id) AS rank FROM mk)
  SELECT "group" AS domain, gene_id AS gene, {t.r6_sql('scores')} AS scores, {t.r6_sql('p')} AS pvals, {t.r6_sql('lfc')} AS logfoldchanges, rank FROM r WHERE rank <= 50""")
def tg_domain_biomarkers(spark, sf):
    rows = ts.domain_biomarkers(t.lognorm(spark, sf), t.cells(spark, sf), "cell_type")
    return rows.select("domain", "gene", *[r6(c).alias(c) for c in ("scores", "pvals", "logfoldchanges")], "rank")


# ---------------------------------------------------------------- knowledge and recall
@register("me_resolve_keywords", f"WITH {TREE}, k AS (SELECT DISTINCT n_name AS keyword, 'n' || n_nationkey AS node_uuid FROM nation UNION SELECT 'nowhere', NULL) SELECT keyword, k.node_uuid, MIN(uri) AS uri FROM k LEFT JOIN u USING (node_uuid) GROUP BY 1, 2")
def me_resolve_keywords(spark, sf):
    nation = t.load(spark, sf, "nation")
    glossary = nation.select(F.col("n_name").alias("keyword"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_uuid"))
    wanted = nation.select(F.col("n_name").alias("keyword")).unionByName(nation.limit(1).select(F.lit("nowhere").alias("keyword")))
    return me.resolve_keywords(wanted, glossary, edges(spark, sf), paths(spark, sf)).select("keyword", "node_uuid", "uri")


CHANGES = "chg AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey AS key, l_returnflag, l_linestatus, l_extendedprice AS x, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_extendedprice) AS f, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC, l_extendedprice DESC) AS l FROM lineitem)"


def _changes(spark, sf):
    payload = lambda c: F.when(c, F.concat(F.lit('{"node_uuid":"n'), (F.col("l_partkey") % 50).cast("string"), F.lit('","v":"'), F.col("l_returnflag"), F.lit('"}')))
    return t.load(spark, sf, "lineitem").select(
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("s"), "l_extendedprice").alias("seq"), F.lit("memories").alias("tbl"), F.col("l_partkey").cast("string").alias("key"),
        payload(F.col("l_returnflag") != "A").alias("before"), payload(F.col("l_linestatus") != "F").alias("after"))


NET = f"{CHANGES}, net AS (SELECT key, MAX(CASE WHEN f = 1 AND l_returnflag <> 'A' THEN l_returnflag END) AS b, MAX(CASE WHEN l = 1 AND l_linestatus <> 'F' THEN l_returnflag END) AS a FROM chg GROUP BY 1)"


@register("me_changes_by_node", f"""WITH {NET} SELECT 'n' || (key % 50) AS node, COUNT(*) AS n_changes, COUNT(*) FILTER (b IS NULL) AS n_inserts, COUNT(*) FILTER (b IS NOT NULL AND a IS NOT NULL) AS n_updates,
  COUNT(*) FILTER (a IS NULL) AS n_deletes FROM net WHERE a IS DISTINCT FROM b GROUP BY 1""")
def me_changes_by_node(spark, sf):
    return me.changes_by_node(me.changeset_diff(_changes(spark, sf)))


@register("me_changeset_gc", f"WITH {NET} SELECT key::VARCHAR AS key, COUNT(*) AS n FROM chg WHERE key NOT IN (SELECT key FROM net WHERE a IS NULL AND b IS NULL) GROUP BY 1")
def me_changeset_gc(spark, sf):
    return me.changeset_gc(_changes(spark, sf)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


#: A session's log: customers in pairs share a node; a third of the paths came and went again.
SESSION = """lg AS (
  SELECT 1 AS seq, 'nodes' AS tbl, 'c' || c_custkey AS key, CASE WHEN c_custkey % 10 = 4 THEN '{"uuid":"c' || c_custkey || '"}' END AS before, '{"uuid":"c' || c_custkey || '"}' AS after FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 2, 'edges', c_custkey::VARCHAR, CASE WHEN c_custkey % 7 = 3 THEN '{}' END, '{"id":"' || c_custkey || '","child_uuid":"c' || (c_custkey - c_custkey % 2) || '"}' FROM customer
  UNION ALL SELECT 3, 'paths', 'p' || c_custkey, NULL, CASE WHEN c_custkey % 11 = 5 THEN '{"node_uuid":"c' || (c_custkey - c_custkey % 2) || '"}' ELSE '{"edge_id":"' || c_custkey || '"}' END FROM customer
  UNION ALL SELECT 9, 'paths', 'p' || c_custkey, '{}', NULL FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 4, 'memories', o_orderkey::VARCHAR, CASE WHEN o_orderstatus = 'F' THEN '{}' END, '{"node_uuid":"c' || (o_custkey - o_custkey % 2) || '"}' FROM orders
  UNION ALL SELECT 5, 'glossary_keywords', p_partkey::VARCHAR, NULL, '{"node_uuid":"c' || p_partkey || '"}' FROM part)"""


def _session(spark, sf):
    s = lambda c: F.col(c).cast("string")
    row = lambda df, seq, tbl, key, before, after: df.select(F.lit(seq).alias("seq"), F.lit(tbl).alias("tbl"), key.alias("key"), before.alias("before"), after.alias("after"))
    c, none = t.load(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") - F.col("c_custkey") % 2).cast("string").alias("even")), F.lit(None).cast("string")
    o = t.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") - F.col("o_custkey") % 2).cast("string").alias("even"))
    js = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    uuid = js('{"uuid":"c', s("c_custkey"), '"}')
    route = F.when(F.col("c_custkey") % 11 == 5, js('{"node_uuid":"c', F.col("even"), '"}')).otherwise(js('{"edge_id":"', s("c_custkey"), '"}'))
    path = F.concat(F.lit("p"), s("c_custkey"))
    parts = [
        row(c.filter("c_custkey % 2 = 0"), 1, "nodes", F.concat(F.lit("c"), s("c_custkey")), F.when(F.col("c_custkey") % 10 == 4, uuid), uuid),
        row(c, 2, "edges", s("c_custkey"), F.when(F.col("c_custkey") % 7 == 3, "{}"), js('{"id":"', s("c_custkey"), '","child_uuid":"c', F.col("even"), '"}')),
        row(c, 3, "paths", path, none, route), row(c.filter("c_custkey % 3 = 0"), 9, "paths", path, F.lit("{}"), none),
        row(o, 4, "memories", s("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "{}"), js('{"node_uuid":"c', F.col("even"), '"}')),
        row(t.load(spark, sf, "part"), 5, "glossary_keywords", s("p_partkey"), none, js('{"node_uuid":"c', s("p_partkey"), '"}')),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("me_changeset_sweep", f"""WITH {SESSION}, lp AS (SELECT after ->> '$.edge_id' AS edge_id, after ->> '$.node_uuid' AS node FROM lg WHERE tbl = 'paths' AND seq = 3 AND key NOT IN (SELECT key FROM lg WHERE seq = 9)),
 rc AS (SELECT node FROM lp WHERE node IS NOT NULL UNION SELECT after ->> '$.child_uuid' FROM lg WHERE tbl = 'edges' AND key IN (SELECT edge_id FROM lp)),
 cr AS (SELECT key AS node FROM lg WHERE tbl = 'nodes' AND before IS NULL AND key NOT IN (SELECT node FROM rc)),
 gn AS (SELECT tbl, key FROM lg WHERE seq = 9 UNION SELECT tbl, key FROM lg WHERE tbl = 'nodes' AND before IS NULL AND key NOT IN (SELECT node FROM rc)
   UNION SELECT tbl, key FROM lg WHERE tbl IN ('memories', 'glossary_keywords') AND before IS NULL AND (after ->> '$.node_uuid') IN (SELECT node FROM cr)
   UNION SELECT tbl, key FROM lg WHERE tbl = 'edges' AND before IS NULL AND key NOT IN (SELECT edge_id FROM lp WHERE edge_id IS NOT NULL))
 SELECT tbl, key, seq FROM lg WHERE NOT EXISTS (SELECT 1 FROM gn WHERE gn.tbl = lg.tbl AND gn.key = lg.key)""")
def me_changeset_sweep(spark, sf):
    return me.changeset_gc(_session(spark, sf)).select("tbl", "key", "seq")


CTX = "c AS (SELECT o_custkey AS session_id, o_orderkey AS memory_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'dataset' WHEN '2-HIGH' THEN 'analysis' WHEN '3-MEDIUM' THEN 'preference' WHEN '5-LOW' THEN 'insight' ELSE 'project_context' END AS memory_type, o_orderdate AS created_at, 'order ' || o_orderkey || ' cluster_' || (o_orderkey % 9) AS text FROM orders)"


def _typed(spark, sf):
    kind = F.create_map(*[F.lit(x) for x in ("1-URGENT", "dataset", "2-HIGH", "analysis", "3-MEDIUM", "preference", "5-LOW", "insight")])
    key = F.col("o_orderkey").cast("string")
    return t.load(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("memory_id"), F.coalesce(kind[F.col("o_orderpriority")], F.lit("project_context")).alias("memory_type"),
        F.col("o_orderdate").alias("created_at"), F.concat(F.lit("order "), key, F.lit(" cluster_"), (F.col("o_orderkey") % 9).cast("string")).alias("text"))


@register("me_context_topn", f"""WITH {CTX}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, memory_type ORDER BY created_at DESC, memory_id) AS r FROM c)
  SELECT session_id, memory_type, string_agg(text, chr(10) ORDER BY r) AS block FROM r WHERE r <= CASE memory_type WHEN 'project_context' THEN 1 WHEN 'dataset' THEN 1 WHEN 'preference' THEN 5 ELSE 3 END GROUP BY 1, 2""")
def me_context_topn(spark, sf):
    return me.context_topn(_typed(spark, sf))


@register("me_targeted_context", f"""WITH {CTX}, q AS (SELECT c_custkey AS query_id, c_custkey AS session_id, 'cluster_' || (c_custkey % 9) AS term FROM customer WHERE c_custkey % 2 = 0),
  nw AS (SELECT *, row_number() OVER (PARTITION BY session_id, memory_type ORDER BY created_at DESC, memory_id) AS r FROM c WHERE memory_type IN ('dataset', 'analysis')),
  f AS (SELECT query_id, memory_id, 'newest ' || memory_type AS why, CASE memory_type WHEN 'dataset' THEN 1 ELSE 2 END AS position FROM q JOIN nw USING (session_id) WHERE r = 1),
  h AS (SELECT query_id, c.memory_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, c.memory_id) AS r FROM q JOIN c USING (session_id) WHERE contains(text, term) AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = q.query_id AND f.memory_id = c.memory_id))
  SELECT * FROM f UNION ALL SELECT query_id, memory_id, 'focus term', r + 2 FROM h WHERE r <= 5""")
def me_targeted_context(spark, sf):
    key = F.col("c_custkey")
    ask = F.concat(F.when(key % 2 == 0, "what do you remember of Cluster ").otherwise("please plot cluster "), (key % 9).cast("string"))
    queries = t.load(spark, sf, "customer").select(key.alias("query_id"), key.alias("session_id"), ask.alias("query"))
    return me.targeted_context(queries, _typed(spark, sf))


@register("me_related_insights", "SELECT l_orderkey AS memory_id, COUNT(*) AS overlap FROM lineitem GROUP BY 1 HAVING COUNT(*) >= 2")
def me_related_insights(spark, sf):
    insights = t.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("memory_id")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("positive_task_uris"))
    uris = t.load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("uri"))
    return me.related_insights(insights, uris, 2)


@register("me_dedupe_insights", """WITH i AS (SELECT o_orderkey AS memory_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN 'Cluster ' || (o_custkey % 40) ELSE o_orderpriority || ' Zone' END AS v FROM orders),
  k AS (SELECT *, CASE WHEN regexp_extract(lower(v), '(\\d+)\\s*$', 1) <> '' THEN 'cluster_' || regexp_extract(lower(v), '(\\d+)\\s*$', 1)::BIGINT ELSE regexp_replace(trim(lower(v)), '[\\s\\-]+', '_', 'g') END AS canonical FROM i)
  SELECT canonical, arg_min(memory_id, (-epoch(created_at), memory_id)) AS memory_id FROM k GROUP BY 1""")
def me_dedupe_insights(spark, sf):
    key = F.col("o_orderkey")
    value = F.when(key % 2 == 0, F.concat(F.lit("Cluster "), (F.col("o_custkey") % 40).cast("string"))).otherwise(F.concat("o_orderpriority", F.lit(" Zone")))
    rows = t.load(spark, sf, "orders").select(key.alias("memory_id"), F.col("o_orderdate").alias("created_at"), F.lit("cluster").alias("entity_type"), value.alias("entity_id"))
    return me.dedupe_insights(rows).select("canonical", "memory_id")


@register("me_deprecate_short", "SELECT doc_id AS id, length(text) < 500 AS deprecated FROM documents")
def me_deprecate_short(spark, sf):
    rows = t.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.to_json(F.struct(F.col("text").alias("trajectory"))).alias("content"), F.lit(False).alias("deprecated"))
    return me.deprecate_short(rows).select("id", "deprecated")


PREF = "pr AS (SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN ' Preferred-' || event_type WHEN 1 THEN 'plot  style' WHEN 2 THEN event_type ELSE '__' END AS key, CASE event_id % 4 WHEN 0 THEN ' ' || event_type || '  mode ' WHEN 1 THEN 'see ' || event_type || '.csv' WHEN 2 THEN repeat(event_type || ' ', 17) ELSE '' END AS value FROM events)"


@register("me_validate_preferences", f"""WITH {PREF}, n AS (SELECT id, trim(regexp_replace(replace(replace(lower(trim(key)), '-', '_'), ' ', '_'), '_+', '_', 'g'), '_') AS norm_key, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS norm_value FROM pr)
  SELECT id, norm_key, norm_value, CASE WHEN norm_key = '' THEN 'empty key' WHEN NOT (norm_key = 'plot_style' OR starts_with(norm_key, 'preferred_')) THEN 'not a tendency' WHEN norm_value = '' THEN 'empty value' WHEN length(norm_value) > 120 THEN 'long value'
    WHEN len(string_split(norm_value, ' ')) > 16 THEN 'many words' WHEN contains(norm_value, '.csv') THEN 'fact-like value' END AS reason FROM n""")
def me_validate_preferences(spark, sf):
    kind, e, u = F.col("event_type"), F.col("event_id") % 4, F.col("user_id") % 4
    key = F.when(u == 0, F.concat(F.lit(" Preferred-"), kind)).when(u == 1, "plot  style").when(u == 2, kind).otherwise("__")
    value = F.when(e == 0, F.concat(F.lit(" "), kind, F.lit("  mode "))).when(e == 1, F.concat(F.lit("see "), kind, F.lit(".csv"))).when(e == 2, F.repeat(F.concat(kind, F.lit(" ")), F.lit(17))).otherwise("")
    rows = t.load(spark, sf, "events").select(F.col("event_id").alias("id"), key.alias("key"), value.alias("value"))
    return me.validate_preferences(rows).select("id", "norm_key", "norm_value", "reason")


# ---------------------------------------------------------------- text
@register("tx_clean_lines", r"""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?:\|\s*(?:<br>)?\s*\|[\s|]*\n?)+(?:\|[-|–]+\|[\s|]*\n?)+(?:\|\s*(?:<br>[^|]*)?\s*\|[\s|]*\n?)*', chr(10), 'g'),
   '(?:\|?\s*!\[image\s+\d+\]\([^)]+\)\s*(?:<br>)*\s*)+', chr(10), 'g'), '<br>\s*', ' ', 'g'), '(?m)^\d+\s*\|\s*Nature\s*\|[^\n]*$', '', 'g') AS text FROM documents),
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM b), s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM l),
  n AS (SELECT *, bare <> '' AND (regexp_matches(bare, '^[\d\s.,;:–−\-/]+$') OR (length(bare) <= 3 AND NOT regexp_matches(bare, '[a-zA-Z]{2,}')) OR regexp_matches(bare, '^\d+\s*\|\s*Nature\s*\|')
     OR (length(bare) < 15 AND NOT regexp_matches(bare, '[a-zA-Z]{4,}\s+[a-zA-Z]{4,}') AND NOT starts_with(bare, '#') AND NOT regexp_matches(bare, '\.\s*[A-Z]'))) AS noise FROM s),
  k AS (SELECT *, coalesce(lag(noise) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM n)
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (noise AND before)), ''), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '(?m)[ \t\x0b\f\r]+$', '', 'g') AS cleaned FROM k GROUP BY 1""")
def tx_clean_lines(spark, sf):
    return tx.clean_lines(t.load(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "cleaned")


@register("tx_catalog_search", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'promo') ORDER BY p_name, p_partkey LIMIT 15")
def tx_catalog_search(spark, sf):
    catalog = t.load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return tx.catalog_search(catalog, "PROMO").select("id", "name")


# ---------------------------------------------------------------- rollouts
@register("rl_throughput", "SELECT o_orderkey AS step, o_custkey AS total_tokens, o_totalprice AS time_per_step, round(o_custkey / (o_totalprice * 8), 9) AS tokens_per_second, round(o_totalprice * 1000 / o_custkey, 6) AS ms_per_token FROM orders WHERE o_custkey > 0")
def rl_throughput(spark, sf):
    log = t.load(spark, sf, "orders").filter("o_custkey > 0").select(F.col("o_orderkey").alias("step"), F.col("o_custkey").alias("n_tokens"), F.col("o_totalprice").alias("seconds"))
    return ro.throughput_metrics(log, 8).withColumn("tokens_per_second", F.round("tokens_per_second", 9)).withColumn("ms_per_token", F.round("ms_per_token", 6))


@register("rl_value_loss", f"""WITH tk AS (SELECT l_tax AS v, l_discount AS p, l_quantity / 50 AS r, CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END AS m FROM lineitem),
  ab AS (SELECT m, (p - r) * (p - r) AS a, pow(least(greatest(p, v - 0.02::DOUBLE), v + 0.02::DOUBLE) - r, 2) AS b FROM tk)
  SELECT {t.r6_sql('0.5 * SUM(greatest(a, b) * m) / (SUM(m) + 1e-8::DOUBLE)')} AS vf_loss, {t.r6_sql('SUM(CASE WHEN b > a THEN m ELSE 0 END) / (SUM(m) + 1e-8::DOUBLE)')} AS vf_clipfrac FROM ab""")
def rl_value_loss(spark, sf):
    lines = t.load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_tax", "l_discount", (F.col("l_quantity") / 50).alias("r"), F.when(F.col("l_returnflag") != "A", 1).otherwise(0).alias("m"))).alias("z"))  # the lines of one order
    pick = lambda k: F.transform("z", lambda x: x[k])
    rows = lines.select(pick("l_discount").alias("vpreds"), pick("l_tax").alias("values"), pick("r").alias("returns"), pick("m").alias("mask"))
    return ro.value_loss(rows, 0.02).select(r6("vf_loss").alias("vf_loss"), r6("vf_clipfrac").alias("vf_clipfrac"))


@register("rl_entropy", f"WITH l AS (SELECT l_orderkey AS id, list(l_discount * 10) AS x FROM lineitem GROUP BY 1), z AS (SELECT id, x, list_max(x) + ln(list_sum([exp(v - list_max(x)) for v in x])) AS lse FROM l) SELECT id, {t.r6_sql('lse - list_sum([exp(v - lse) * v for v in x])')} AS entropy FROM z")
def rl_entropy(spark, sf):
    rows = t.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_discount") * 10).alias("x"))  # the lines of one order
    return rows.select("id", r6(ro.entropy_from_logits(F.col("x"))).alias("entropy"))


@register("en_resolve_gene_sets", "SELECT p_type AS gene_set, p_partkey AS gene_id FROM part WHERE p_partkey % 3 = 1")
def en_resolve_gene_sets(spark, sf):
    names = F.create_map(*[F.lit(x) for x in (0, "GO_Biological_Process_2025", 1, "GO_Biological_Process_2023", 2, "KEGG_2021_Human")])
    libraries = t.load(spark, sf, "part").select(names[(F.col("p_partkey") % 3).cast("int")].alias("library"), F.col("p_type").alias("gene_set"), F.col("p_partkey").alias("gene_id"))
    return en.resolve_gene_sets(libraries.filter("library <> 'GO_Biological_Process_2025'"), "GO_Biological_Process").select("gene_set", "gene_id")
