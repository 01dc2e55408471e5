"""Knowledge graph and text search: regions, nations and customers as a tree, documents as memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.stats import r6
from cellweave.operators import memory as me
from cellweave.operators import text as tx
from cellweave.plans import tables as t
from cellweave.plans.registry import register

TREE = """e AS (SELECT r_regionkey::BIGINT AS id, 'root' AS parent_uuid, 'r' || r_regionkey AS child_uuid, r_name AS name, r_regionkey::INT AS priority FROM region
  UNION ALL SELECT 1000 + n_nationkey, 'r' || n_regionkey, 'n' || n_nationkey, n_name, n_nationkey FROM nation
  UNION ALL SELECT 100000 + c_custkey, 'n' || c_nationkey, 'c' || c_custkey, c_custkey::VARCHAR, (c_custkey % 7)::INT FROM customer),
 p AS (SELECT 'geo' AS domain, r_name AS path, r_regionkey::BIGINT AS edge_id FROM region UNION ALL SELECT 'geo', r_name || '/' || n_name, 1000 + n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'geo', r_name || '/' || n_name || '/' || c_custkey, 100000 + c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'segment', c_mktsegment || '/' || c_custkey, 100000 + c_custkey FROM customer),
 m AS (SELECT o_orderkey AS id, 'c' || o_custkey AS node_uuid, o_orderpriority || ' ' || o_orderkey AS content, o_orderstatus = 'F' AS deprecated, o_orderdate AS created_at FROM orders),
 act AS (SELECT node_uuid, arg_max(id, (created_at, id)) AS memory_id, arg_max(content, (created_at, id)) AS content FROM m WHERE NOT deprecated GROUP BY 1),
 u AS (SELECT child_uuid AS node_uuid, domain, path, domain || '://' || path AS uri FROM p JOIN e ON e.id = edge_id)"""


def edges(spark, sf):
    s = lambda c: F.col(c).cast("string")
    row = lambda i, p, c, n, pr: [i.cast("long").alias("id"), p.alias("parent_uuid"), c.alias("child_uuid"), n.alias("name"), pr.cast("int").alias("priority"), F.lit(None).cast("string").alias("disclosure")]
    r = t.load(spark, sf, "region").select(*row(F.col("r_regionkey"), F.lit("root"), F.concat(F.lit("r"), s("r_regionkey")), F.col("r_name"), F.col("r_regionkey")))
    n = t.load(spark, sf, "nation").select(*row(F.col("n_nationkey") + 1000, F.concat(F.lit("r"), s("n_regionkey")), F.concat(F.lit("n"), s("n_nationkey")), F.col("n_name"), F.col("n_nationkey")))
    c = t.load(spark, sf, "customer").select(*row(F.col("c_custkey") + 100000, F.concat(F.lit("n"), s("c_nationkey")), F.concat(F.lit("c"), s("c_custkey")), s("c_custkey"), F.col("c_custkey") % 7))
    return r.unionByName(n).unionByName(c)


def paths(spark, sf):
    r, n, c = (t.load(spark, sf, x) for x in ("region", "nation", "customer"))
    rn = n.join(r, n.n_regionkey == r.r_regionkey)
    cn = c.join(rn, c.c_nationkey == rn.n_nationkey)
    row = lambda df, d, p, e: df.select(F.lit(d).alias("domain"), p.alias("path"), e.cast("long").alias("edge_id"))
    return (
        row(r, "geo", F.col("r_name"), F.col("r_regionkey")).unionByName(row(rn, "geo", F.concat_ws("/", "r_name", "n_name"), F.col("n_nationkey") + 1000))
        .unionByName(row(cn, "geo", F.concat_ws("/", "r_name", "n_name", F.col("c_custkey").cast("string")), F.col("c_custkey") + 100000))
        .unionByName(row(c, "segment", F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string")), F.col("c_custkey") + 100000))
    )


def memories(spark, sf):
    return t.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node_uuid"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("content"),
        (F.col("o_orderstatus") == "F").alias("deprecated"), F.col("o_orderdate").alias("created_at"))


@register("me_resolve_path", f"WITH {TREE}, ac AS (SELECT node_uuid, COUNT(*) - 1 AS alias_count FROM u GROUP BY 1) SELECT domain, path, u.node_uuid, memory_id, content, alias_count FROM u JOIN act USING (node_uuid) JOIN ac USING (node_uuid)")
def me_resolve_path(spark, sf):
    p = paths(spark, sf)
    return me.resolve_paths(p.select("domain", "path"), edges(spark, sf), p, memories(spark, sf)).select("domain", "path", "node_uuid", "memory_id", "content", "alias_count")


@register("me_active_version", f"WITH {TREE} SELECT node_uuid, memory_id, content FROM act")
def me_active_version(spark, sf):
    return me.active_versions(memories(spark, sf)).select("node_uuid", "memory_id", "content")


@register("me_children", f"WITH {TREE}, g AS (SELECT parent_uuid AS c, COUNT(*) AS n FROM e GROUP BY 1) SELECT parent_uuid, child_uuid, name, priority, coalesce(n, 0) AS n_children, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS snippet FROM e LEFT JOIN g ON c = child_uuid LEFT JOIN act ON node_uuid = child_uuid")
def me_children(spark, sf):
    e = edges(spark, sf)
    return me.children(e, memories(spark, sf), e.select("parent_uuid").distinct())


@register("me_best_path", f"WITH {TREE} SELECT node_uuid, arg_min(uri, (CASE WHEN domain = 'segment' AND (path = 'MACHINERY' OR starts_with(path, 'MACHINERY/')) THEN 0 WHEN domain = 'segment' THEN 1 ELSE 2 END, domain, path)) AS uri FROM u GROUP BY 1")
def me_best_path(spark, sf):
    return me.best_path(me.node_uris(edges(spark, sf), paths(spark, sf)), "segment", "MACHINERY")


@register("me_all_paths", f"WITH {TREE} SELECT domain, path, name, priority FROM p JOIN e ON e.id = edge_id")
def me_all_paths(spark, sf):
    return me.all_paths(edges(spark, sf), paths(spark, sf))


@register("me_subtree", f"WITH {TREE} SELECT path, edge_id FROM p WHERE domain = 'geo' AND (path = 'ASIA' OR starts_with(path, 'ASIA/') OR path = 'REGION_1' OR starts_with(path, 'REGION_1/'))")
def me_subtree(spark, sf):
    p = paths(spark, sf)
    return me.subtree(p, "geo", "ASIA").unionByName(me.subtree(p, "geo", "REGION_1")).select("path", "edge_id")


@register("me_alias_counts", f"WITH {TREE} SELECT node_uuid, COUNT(*) AS n_paths FROM u WHERE NOT (domain = 'segment' AND starts_with(path, 'MACHINERY/')) GROUP BY 1")
def me_alias_counts(spark, sf):
    return me.alias_counts(edges(spark, sf), paths(spark, sf), ("segment", "MACHINERY"))


@register("me_next_child_number", f"WITH {TREE} SELECT parent_uuid, coalesce(MAX(try_cast(name AS INT)), 0) + 1 AS next_number FROM e GROUP BY 1")
def me_next_child_number(spark, sf):
    return me.next_child_number(edges(spark, sf))


@register("me_cycle_check", f"WITH {TREE} SELECT child_uuid AS parent_uuid, parent_uuid AS child_uuid, TRUE AS cycle FROM e UNION ALL SELECT parent_uuid, child_uuid, FALSE FROM e")
def me_cycle_check(spark, sf):
    e = edges(spark, sf)
    back = e.select(F.col("child_uuid").alias("parent_uuid"), F.col("parent_uuid").alias("child_uuid"))
    return me.would_create_cycle(e, back.unionByName(e.select("parent_uuid", "child_uuid")))


@register("me_materialize_paths", f"WITH {TREE} SELECT 'geo' AS domain, path, edge_id FROM p WHERE domain = 'geo' AND contains(path, '/')")
def me_materialize_paths(spark, sf):
    p = paths(spark, sf).filter("domain = 'geo'")
    top = p.filter(~F.contains("path", F.lit("/")))
    roots = top.join(edges(spark, sf).select(F.col("id").alias("edge_id"), F.col("child_uuid").alias("node_uuid")), "edge_id")
    return me.materialize_paths(edges(spark, sf), roots, top)


@register("me_apply_versions", f"WITH {TREE} SELECT id, lead(id) OVER (PARTITION BY node_uuid ORDER BY id) AS migrated_to, lead(id) OVER (PARTITION BY node_uuid ORDER BY id) IS NOT NULL AS deprecated FROM m")
def me_apply_versions(spark, sf):
    return me.apply_versions(memories(spark, sf)).select("id", "migrated_to", "deprecated")


@register("me_cascade_delete", f"""WITH {TREE} SELECT 'paths' AS tbl, domain || '://' || path AS key FROM p JOIN e ON e.id = edge_id WHERE NOT (domain = 'geo' AND parent_uuid = 'r1') AND NOT (domain = 'geo' AND child_uuid = 'r1')
   AND NOT (domain = 'geo' AND starts_with(path, (SELECT r_name FROM region WHERE r_regionkey = 1) || '/'))
 UNION ALL SELECT 'edges', id::VARCHAR FROM e WHERE parent_uuid <> 'r1' AND child_uuid <> 'r1' UNION ALL SELECT 'memories', id::VARCHAR FROM m WHERE node_uuid <> 'r1'""")
def me_cascade_delete(spark, sf):
    doomed = t.load(spark, sf, "region").filter("r_regionkey = 1").select(F.lit("r1").alias("node_uuid"))
    left = me.cascade_delete(edges(spark, sf), paths(spark, sf), memories(spark, sf), doomed)
    keys = {"paths": me.uri(), "edges": F.col("id").cast("string"), "memories": F.col("id").cast("string")}
    rows = [left[name].select(F.lit(name).alias("tbl"), key.alias("key")) for name, key in keys.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("me_orphans", f"WITH {TREE} SELECT 'empty_node' AS kind, child_uuid AS ref FROM e WHERE child_uuid NOT IN (SELECT node_uuid FROM m)")
def me_orphans(spark, sf):
    nodes = edges(spark, sf).select(F.col("child_uuid").alias("uuid"))
    return me.orphans(nodes, edges(spark, sf), paths(spark, sf), memories(spark, sf))


@register("me_recent", f"WITH {TREE} SELECT node_uuid, a.memory_id, MIN(uri) AS uri FROM (SELECT node_uuid, memory_id, (SELECT created_at FROM m WHERE id = memory_id) AS ts FROM act ORDER BY ts DESC, memory_id DESC LIMIT 10) a JOIN u USING (node_uuid) GROUP BY 1, 2")
def me_recent(spark, sf):
    return me.recent(edges(spark, sf), paths(spark, sf), memories(spark, sf)).select("node_uuid", "memory_id", "uri")


SIM = "sim AS (SELECT DISTINCT 's' || l_suppkey AS a, 's' || (l_partkey % 97) AS b, 0.1 + (l_suppkey % 9) / 10.0 AS s FROM lineitem WHERE l_suppkey <> l_partkey % 97)"


def similar(spark, sf):
    rows = t.load(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 97).alias("o")).distinct().filter("l_suppkey <> o")
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("parent_uuid"), F.concat(F.lit("s"), F.col("o").cast("string")).alias("child_uuid"),
                       F.lit("task_similar").alias("name"), (0.1 + (F.col("l_suppkey") % 9) / 10.0).cast("string").alias("disclosure"))


@register("me_khop", f"WITH {SIM}, k AS (SELECT a, b FROM sim WHERE s >= 0.75 UNION SELECT b, a FROM sim WHERE s >= 0.75), h1 AS (SELECT a AS start, b AS n FROM k), h2 AS (SELECT DISTINCT start, k.b AS n FROM h1 JOIN k ON k.a = h1.n WHERE k.b <> start EXCEPT SELECT start, n FROM h1) SELECT start, n AS node_uuid, 1 AS hops FROM h1 UNION ALL SELECT start, n, 2 FROM h2")
def me_khop(spark, sf):
    e = similar(spark, sf)
    starts = e.select(F.explode(F.array("parent_uuid", "child_uuid")).alias("start")).distinct()
    return me.neighbors_khop(e, starts, 2, 0.75)


@register("me_upsert_undirected", f"WITH {SIM} SELECT least(a, b) AS a, greatest(a, b) AS b, round(MAX(s)::DOUBLE, 4) AS similarity FROM sim GROUP BY 1, 2")
def me_upsert_undirected(spark, sf):
    new = similar(spark, sf).select(F.col("parent_uuid").alias("a"), F.col("child_uuid").alias("b"), F.col("disclosure").cast("double").alias("similarity"))
    return me.upsert_undirected(new.limit(0), new)


GLOSS = "gl AS (SELECT DISTINCT p_name AS keyword, 'c' || p_partkey AS node_uuid FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'zz' FROM part)"


def glossary(spark, sf):
    part = t.load(spark, sf, "part")
    return part.select(F.col("p_name").alias("keyword"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("node_uuid")).unionByName(
        part.select(F.split("p_name", " ")[0].alias("keyword"), F.lit("zz").alias("node_uuid"))).distinct()


@register("me_glossary_index", f"WITH {TREE}, {GLOSS}, f AS (SELECT node_uuid, MIN(uri) AS uri FROM u GROUP BY 1) SELECT keyword, gl.node_uuid, coalesce(uri, 'unlinked://' || gl.node_uuid) AS uri, replace(left(content, 100), chr(10), ' ') AS snippet FROM gl LEFT JOIN f USING (node_uuid) LEFT JOIN act USING (node_uuid)")
def me_glossary_index(spark, sf):
    return me.glossary_index(glossary(spark, sf), edges(spark, sf), paths(spark, sf), memories(spark, sf))


@register("me_match_glossary", "WITH k AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS keyword FROM benchmark WHERE item_id >= 0), k2 AS (SELECT keyword FROM k WHERE length(keyword) > 0) SELECT doc_id, keyword FROM documents JOIN k2 ON contains(text, keyword)")
def me_match_glossary(spark, sf):
    keywords = t.load(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("keyword"))
    return me.match_glossary(t.load(spark, sf, "documents"), keywords)


CHG = "chg AS (SELECT l_linenumber + l_orderkey * 10 AS seq, 'memories' AS tbl, l_partkey::VARCHAR AS key, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS before, CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_returnflag END AS after, l_extendedprice AS x FROM lineitem)"


@register("me_changeset_diff", f"WITH {CHG}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, x) AS f, row_number() OVER (PARTITION BY key ORDER BY seq DESC, x DESC) AS l FROM chg), d AS (SELECT key, MAX(before) FILTER (f = 1) AS before, MAX(after) FILTER (l = 1) AS after FROM o GROUP BY 1) SELECT key, before, after, CASE WHEN before IS NULL THEN 'insert' WHEN after IS NULL THEN 'delete' ELSE 'update' END AS change FROM d WHERE before IS DISTINCT FROM after")
def me_changeset_diff(spark, sf):
    c = t.load(spark, sf, "lineitem").select(
        F.struct((F.col("l_linenumber") + F.col("l_orderkey") * 10).alias("s"), "l_extendedprice").alias("seq"), F.lit("memories").alias("tbl"), F.col("l_partkey").cast("string").alias("key"),
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("before"), F.when(F.col("l_linestatus") != "F", F.col("l_returnflag")).alias("after"))
    return me.changeset_diff(c).select("key", "before", "after", "change")


@register("me_promotion", """SELECT o_orderkey AS id, round(0.4 + CASE WHEN o_orderstatus = 'F' THEN 0.2 ELSE 0 END + 0.1 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.15 ELSE 0 END, 3)::DOUBLE AS importance,
 round(0.4 + CASE WHEN o_orderstatus = 'F' THEN 0.25 ELSE 0 END + 0.1 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.1 ELSE 0 END, 3)::DOUBLE AS confidence, o_orderstatus = 'F' AS promote FROM orders""")
def me_promotion(spark, sf):
    none = lambda ty: F.lit(None).cast(ty)
    rows = t.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("analysis").alias("memory_type"), none("boolean").alias("file_exists"), none("string").alias("platform"), none("long").alias("n_obs"), none("long").alias("n_vars"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.col("o_custkey").cast("string").alias("source_dataset_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "/out").otherwise("").alias("output_path"), none("boolean").alias("confirmed"), none("string").alias("evidence"))
    return me.promotion_score(rows).select("id", "importance", "confidence", "promote")


@register("me_layered_latest", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, o_orderkey) AS r FROM orders) SELECT o_custkey AS memory_id, o_orderdate::VARCHAR[:10] AS day, CASE WHEN o_orderstatus = 'F' THEN 'semantic' ELSE 'episodic' END AS layer FROM l WHERE r = 1".replace("::VARCHAR[:10]", "::DATE::VARCHAR"))
def me_layered_latest(spark, sf):
    rows = t.load(spark, sf, "orders").select(F.col("o_custkey").alias("memory_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "semantic").otherwise("episodic").alias("layer"))
    return me.layered_latest(rows).select("memory_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "layer")


@register("me_rule_ops", "WITH o AS (SELECT user_id AS rule, SUM(CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END)::BIGINT AS score, COUNT(DISTINCT props) AS n_uris FROM events GROUP BY 1) SELECT * FROM o WHERE score > 0")
def me_rule_ops(spark, sf):
    op = F.create_map(*[F.lit(x) for x in ("signup", "ADD", "click", "AGREE", "view", "EDIT", "error", "REMOVE", "purchase", "KEEP")])
    ops = t.load(spark, sf, "events").select(F.col("user_id").alias("rule"), op[F.col("event_type")].alias("op"), F.array("props").alias("uris"))
    return me.apply_rule_ops(ops).select("rule", "score", F.size("uris").cast("long").alias("n_uris"))


# ----------------------------------------------------------------------------- text
DOCW = "w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[:/.\\\\-]+', ' ', 'g'), '[A-Za-z0-9_]+')) AS w FROM documents)"


@register("tx_tokenize", f"WITH {DOCW} SELECT doc_id, COUNT(DISTINCT w) AS n_tokens FROM w GROUP BY 1")
def tx_tokenize(spark, sf):
    d = t.load(spark, sf, "documents").select("doc_id", F.size(tx.tokenize(F.col("text"))).cast("long").alias("n_tokens"))
    return d.filter("n_tokens > 0")


QUERIES_CTE = "q AS (SELECT item_id AS query_id, array_to_string(string_split(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' ')[1:2], ' ') AS query FROM benchmark)"


def two_words(spark, sf):
    return t.load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.slice(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " "), 1, 2)).alias("query"))


@register("tx_search_bm25", f"""WITH {QUERIES_CTE}, qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[A-Za-z0-9_]+')) AS term FROM q),
 {DOCW.replace('text, ', 'lower(text), ', 1)}, ln AS (SELECT doc_id, COUNT(*) AS len FROM w GROUP BY 1), tf AS (SELECT doc_id, w AS term, COUNT(*) AS tf FROM w GROUP BY 1, 2), st AS (SELECT COUNT(*) AS n, SUM(len)::DOUBLE / COUNT(*) AS av FROM documents LEFT JOIN ln USING (doc_id)),
 df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1),
 sc AS (SELECT query_id, doc_id, SUM(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS s, COUNT(*) AS have FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY 1, 2),
 f AS (SELECT query_id, doc_id, s FROM sc JOIN (SELECT query_id, COUNT(*) AS need FROM qt GROUP BY 1) USING (query_id) WHERE have = need), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM f)
 SELECT query_id, doc_id, {t.r6_sql('s', 5)} AS score, rank FROM r WHERE rank <= 10""")
def tx_search_bm25(spark, sf):
    return tx.search_fts(t.load(spark, sf, "documents"), two_words(spark, sf), "doc_id", 10, {"text": 1.0}).withColumn("score", r6("score", 5))


@register("tx_search_like", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the th') OR contains(lower(source), 'the th')")
def tx_search_like(spark, sf):
    return tx.search_like(t.load(spark, sf, "documents"), "the th", ("text", "source")).select("doc_id")


@register("tx_snippet", "WITH p AS (SELECT doc_id, text, CASE WHEN strpos(lower(text), 'queux xyz') > 0 THEN strpos(lower(text), 'queux xyz') WHEN strpos(lower(text), 'queux') > 0 THEN strpos(lower(text), 'queux') WHEN strpos(lower(text), 'xyz') > 0 THEN strpos(lower(text), 'xyz') ELSE 0 END AS pos, CASE WHEN strpos(lower(text), 'queux xyz') > 0 THEN 9 WHEN strpos(lower(text), 'queux') > 0 THEN 5 ELSE 3 END AS ml FROM documents), s AS (SELECT *, greatest(pos - 31, 0) AS st, least(length(text), pos - 1 + ml + 30) AS en FROM p) SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN st > 0 THEN '...' ELSE '' END || substr(text, st + 1, en - st) || CASE WHEN en < length(text) THEN '...' ELSE '' END ELSE left(text, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END END AS snippet FROM s")
def tx_snippet(spark, sf):
    return t.load(spark, sf, "documents").select("doc_id", tx.snippet(F.col("text"), "queux xyz").alias("snippet"))


@register("tx_tfidf_topk", f"""WITH {QUERIES_CTE}, dw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents), c AS (SELECT doc_id, term, COUNT(*) AS tf FROM dw GROUP BY 1, 2),
 i AS (SELECT term, ln((1.0::DOUBLE + (SELECT COUNT(*) FROM documents)) / (1 + COUNT(*))) + 1 AS idf FROM c GROUP BY 1), nm AS (SELECT doc_id, sqrt(SUM(tf * idf * tf * idf)) AS norm FROM c JOIN i USING (term) GROUP BY 1),
 qw AS (SELECT query_id, term, COUNT(*) * any_value(idf) AS w FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM q) JOIN i USING (term) GROUP BY 1, 2), qn AS (SELECT query_id, sqrt(SUM(w * w)) AS qnorm FROM qw GROUP BY 1),
 s AS (SELECT query_id, doc_id, SUM(tf * idf * w) / any_value(norm) / any_value(qnorm) AS s FROM qw JOIN c USING (term) JOIN i USING (term) JOIN nm USING (doc_id) JOIN qn USING (query_id) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s) SELECT q.query_id, doc_id, {t.r6_sql('coalesce(s, 0)')} AS score, rank FROM q LEFT JOIN (SELECT * FROM r WHERE rank <= 3) x USING (query_id)""")
def tx_tfidf_topk(spark, sf):
    return tx.tfidf_topk(t.load(spark, sf, "documents"), two_words(spark, sf)).withColumn("score", r6("score"))


@register("tx_route_keywords", """WITH l AS (SELECT conv_id, turn, trim(lower(text)) AS x FROM conversations), s AS (SELECT *, CASE WHEN contains(x, 'the') THEN 3 ELSE 0 END + CASE WHEN contains(x, 'tion') THEN 4 ELSE 0 END AS a, CASE WHEN contains(x, 'eaux') THEN 4 ELSE 0 END + CASE WHEN contains(x, 'que') THEN 3 ELSE 0 END AS b, CASE WHEN contains(x, 'ung') THEN 3 ELSE 0 END AS c FROM l)
 SELECT conv_id, turn, CASE WHEN a + b + c = 0 THEN 'other' WHEN a >= b AND a >= c THEN 'en' WHEN b >= c THEN 'fr' ELSE 'de' END AS target, round(CASE WHEN a + b + c = 0 THEN 0 ELSE greatest(a, b, c) / 20.0 END, 2)::DOUBLE AS confidence FROM s""")
def tx_route_keywords(spark, sf):
    q = t.load(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return tx.route_keywords(q, {"the": "en", "tion": "en", "eaux": "fr", "que": "fr", "ung": "de"}, "other").drop("query")


@register("tx_route_extension", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.com$') THEN 'web' WHEN regexp_matches(lower(url), '\\.html$') THEN 'page' ELSE 'other' END AS target FROM pages")
def tx_route_extension(spark, sf):
    return t.load(spark, sf, "pages").select("page_id", tx.route_extension(F.col("url"), {".com": "web", ".html": "page"}, "other").alias("target"))


def _cues(cues) -> str:
    return " OR ".join(f"contains(x, '{c}')" for c in cues)


@register("tx_classify_intent", f"""SELECT doc_id, {_cues(tx.RECALL_CUES)} AS recall, {_cues(tx.RECENT_CUES)} AS recent,
 {_cues(tx.CONTINUE_CUES)} OR {' OR '.join(f"(contains(x, '{a}') AND contains(x, '{b}'))" for a, b in tx.CONTINUE_PAIRS)} AS continuation FROM (SELECT doc_id, lower(text) AS x FROM documents)""")
def tx_classify_intent(spark, sf):
    return t.load(spark, sf, "documents").select("doc_id", tx.classify_intent(F.col("text")).alias("i")).select("doc_id", "i.recall", "i.recent", "i.continuation")


@register("tx_focus_terms", "SELECT event_id, 'domain_' || user_id || ' cluster_' || user_id || CASE WHEN user_id = event_id THEN '' ELSE ' cell_type_' || event_id END AS terms FROM events WHERE user_id <> event_id UNION ALL SELECT event_id, 'domain_' || user_id || ' cluster_' || user_id || ' cell_type_' || event_id FROM events WHERE user_id = event_id")
def tx_focus_terms(spark, sf):
    text = F.concat(F.lit("Show spatial domain "), F.col("user_id").cast("string"), F.lit(" and Cell-Type: "), F.col("event_id").cast("string"))
    return t.load(spark, sf, "events").select("event_id", F.concat_ws(" ", tx.focus_terms(text)).alias("terms"))


@register("tx_accessions", "SELECT o_orderkey, 'GSE' || (10000 + o_custkey) || ' GSM' || (100000 + o_orderkey) AS ids FROM orders")
def tx_accessions(spark, sf):
    text = F.concat(F.lit("see gsm"), (F.col("o_orderkey") + 100000).cast("string"), F.lit(", GSE"), (F.col("o_custkey") + 10000).cast("string"), F.lit(" and gse"), (F.col("o_custkey") + 10000).cast("string"))
    return t.load(spark, sf, "orders").select("o_orderkey", F.concat_ws(" ", tx.extract_accessions(text)).alias("ids"))


@register("tx_entities", "SELECT doc_id, CASE WHEN contains(x, 'human') THEN 'Homo sapiens (inferred)' ELSE 'Unknown' END AS organism, 'Unknown' AS technology, CASE WHEN contains(x, 'heart') AND contains(x, 'skin') THEN 'heart, skin' WHEN contains(x, 'heart') THEN 'heart' WHEN contains(x, 'skin') THEN 'skin' ELSE 'Unknown' END AS tissue FROM (SELECT doc_id, lower(text) AS x FROM documents)")
def tx_entities(spark, sf):
    return t.load(spark, sf, "documents").select("doc_id", tx.extract_entities(F.col("text")).alias("e")).select("doc_id", "e.*")


@register("tx_jaccard", f"WITH a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(regexp_replace(text, '[:/.\\\\-]+', ' ', 'g'), '[A-Za-z0-9_]+')) AS w FROM conversations) SELECT a.conv_id, a.turn, {t.r6_sql('CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END')} AS similarity FROM a JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def tx_jaccard(spark, sf):
    c = t.load(spark, sf, "conversations").select("conv_id", "turn", tx.tokenize(F.col("text")).alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", r6(tx.jaccard(F.col("w"), F.col("v"))).alias("similarity"))


@register("tx_classify_section", """SELECT page_id, CASE WHEN contains(h, 'method') OR contains(h, 'experimental') OR contains(h, 'data processing') OR contains(h, 'data analysis') OR contains(h, 'computational') OR contains(h, 'statistical analysis') OR contains(h, 'bioinformatics') OR contains(h, 'pipeline')
  OR contains(h, 'preprocessing') OR contains(h, 'pre-processing') OR contains(h, 'implementation') OR contains(h, 'algorithm') OR contains(h, 'workflow') THEN 'methodology' WHEN contains(h, 'abstract') OR contains(h, 'introduction') OR contains(h, 'background') OR contains(h, 'conclusion') OR contains(h, 'summary') THEN 'abstract_conclusion'
  WHEN contains(h, 'result') OR contains(h, 'discussion') OR contains(h, 'finding') OR contains(h, 'observation') OR contains(h, 'analysis') OR contains(h, 'comparison') OR contains(h, 'evaluation') OR contains(h, 'performance') OR contains(h, 'validation') THEN 'results_figs' ELSE 'other' END AS section FROM (SELECT page_id, lower(html) AS h FROM pages)""")
def tx_classify_section(spark, sf):
    return t.load(spark, sf, "pages").select("page_id", tx.classify_section(F.col("html")).alias("section"))


@register("me_cluster_rules", """WITH tk AS (SELECT DISTINCT o_custkey % 50 AS cluster_id, o_orderkey % 1000 AS uri FROM orders), hit AS (SELECT DISTINCT cluster_id, event_id FROM events JOIN tk ON uri = user_id) SELECT cluster_id, COUNT(*) AS n_rules FROM hit GROUP BY 1 HAVING COUNT(*) >= 2""")
def me_cluster_rules(spark, sf):
    tasks = t.load(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("cluster_id"), (F.col("o_orderkey") % 1000).alias("uri"))
    insights = t.load(spark, sf, "events").select(F.col("event_id").alias("memory_id"), F.col("event_type").alias("rule"), F.array("user_id").alias("positive_task_uris"))
    return me.cluster_rules(tasks, insights).select("cluster_id", "n_rules").distinct()
