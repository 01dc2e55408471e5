"""The versioned knowledge graph as tables.

nodes(uuid), memories(id, node_uuid, content, deprecated, migrated_to, created_at),
edges(id, parent_uuid, child_uuid, name, priority, disclosure), paths(domain, path, edge_id),
glossary(keyword, node_uuid).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators import text as tx
from cellweave.operators.de import top_per_group
from cellweave.session import materialize


def uri(domain="domain", path="path"):
    return F.concat(F.col(domain), F.lit("://"), F.col(path))


def active_versions(memories: DataFrame) -> DataFrame:
    """Newest non-deprecated memory per node (ties by larger id)."""
    latest = F.max_by(F.struct("id", "content", "created_at"), F.struct("created_at", "id"))
    return memories.filter(~F.col("deprecated")).groupBy("node_uuid").agg(latest.alias("_m")).select(
        "node_uuid", F.col("_m.id").alias("memory_id"), F.col("_m.content").alias("content"), F.col("_m.created_at").alias("created_at"))


def node_uris(edges: DataFrame, paths: DataFrame) -> DataFrame:
    return paths.join(edges.select(F.col("id").alias("edge_id"), F.col("child_uuid").alias("node_uuid")), "edge_id").select("node_uuid", "domain", "path", uri().alias("uri"))


def resolve_paths(wanted: DataFrame, edges: DataFrame, paths: DataFrame, memories: DataFrame) -> DataFrame:
    """wanted(domain, path) -> node, newest active memory and number of further aliases."""
    at = wanted.join(paths, ["domain", "path"]).join(edges.select(F.col("id").alias("edge_id"), F.col("child_uuid").alias("node_uuid"), "priority", "disclosure"), "edge_id")
    aliases = alias_counts(edges, paths).select("node_uuid", (F.col("n_paths") - 1).alias("alias_count"))
    return at.join(active_versions(memories), "node_uuid").join(aliases, "node_uuid").select("domain", "path", "node_uuid", "memory_id", "content", "priority", "disclosure", "alias_count")


def alias_counts(edges: DataFrame, paths: DataFrame, exclude_prefix: tuple[str, str] | None = None) -> DataFrame:
    """Paths per node, optionally without those inside one subtree."""
    rows = node_uris(edges, paths)
    if exclude_prefix:
        domain, prefix = exclude_prefix
        rows = rows.filter(~((F.col("domain") == domain) & in_subtree(prefix)))
    return rows.groupBy("node_uuid").agg(F.count(F.lit(1)).alias("n_paths"))


def in_subtree(prefix: str):
    return (F.col("path") == prefix) | F.col("path").startswith(prefix + "/")


def subtree(paths: DataFrame, domain: str, prefix: str) -> DataFrame:
    return paths.filter((F.col("domain") == domain) & in_subtree(prefix))


def children(edges: DataFrame, memories: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of parents(parent_uuid): name, grandchild count, 100-character snippet, one row per child."""
    grand = edges.groupBy(F.col("parent_uuid").alias("child_uuid")).agg(F.count(F.lit(1)).alias("n_children"))
    own = edges.join(parents, "parent_uuid", "left_semi")
    first = top_per_group(own, ["parent_uuid", "child_uuid"], ["priority", "name", "id"], 1).drop("rank")
    snippet = F.when(F.length("content") > 100, F.concat(F.substring("content", 1, 100), F.lit("..."))).otherwise(F.col("content"))
    return first.join(grand, "child_uuid", "left").na.fill(0, ["n_children"]).join(active_versions(memories).withColumnRenamed("node_uuid", "child_uuid"), "child_uuid", "left").select(
        "parent_uuid", "child_uuid", "name", "priority", "n_children", snippet.alias("snippet"))


def best_path(aliases: DataFrame, ctx_domain: str, ctx_path: str) -> DataFrame:
    """One path per node: under the context path, else in its domain, else the first."""
    near = F.when((F.col("domain") == ctx_domain) & in_subtree(ctx_path), 0).when(F.col("domain") == ctx_domain, 1).otherwise(2)
    return aliases.groupBy("node_uuid").agg(F.min_by("uri", F.struct(near.alias("a"), F.col("domain"), F.col("path"))).alias("uri"))


def all_paths(edges: DataFrame, paths: DataFrame, domain: str | None = None) -> DataFrame:
    rows = paths if domain is None else paths.filter(F.col("domain") == domain)
    return rows.join(edges.select(F.col("id").alias("edge_id"), "name", "priority"), "edge_id").groupBy("domain", "path").agg(
        F.min(F.struct("priority", "name")).alias("_first")).select("domain", "path", "_first.name", "_first.priority")


def next_child_number(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent_uuid").agg((F.coalesce(F.max(F.col("name").try_cast("int")), F.lit(0)) + 1).alias("next_number"))


#: Starts that a task of :func:`_next_hop` follows, and children of a node that travel together.
STARTS, CHILDREN = 512, 16_384


def _hop_block(seen: pa.Table, lists: pa.Table, hop: int) -> pa.Table:
    """(start, node_uuid) of the children that the starts of ``seen`` reach with this hop for the first time."""
    kind = seen["node_uuid"].type
    children = lists["children"].combine_chunks()
    names = pa.concat_arrays([children.flatten().field("child_uuid").cast(kind), seen["node_uuid"].combine_chunks()]).dictionary_encode("encode")
    ends, nothing = np.r_[0, np.cumsum(pc.list_value_length(children).to_numpy(zero_copy_only=False))].astype(np.int64), names.dictionary.is_null().to_numpy(zero_copy_only=False)
    codes, unique = names.indices.to_numpy(), names.dictionary
    pieces: dict[int, list[np.ndarray]] = {}
    parents = pc.index_in(lists["node_uuid"].combine_chunks().cast(kind), unique).to_numpy(zero_copy_only=False)
    for i, node in enumerate(parents):
        pieces.setdefault(int(node), []).append(codes[ends[i] : ends[i + 1]])
    own, starts = codes[ends[-1] :], seen["start"].combine_chunks().dictionary_encode("encode")
    at, last = starts.indices.to_numpy(), seen["hops"].to_numpy() == hop - 1
    order = np.argsort(at, kind="stable")
    firsts, found = [], []
    for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
        reached = np.zeros(len(unique), bool)
        for node in own[rows[last[rows]]]:
            if not nothing[node]:
                for piece in pieces.get(int(node), ()):
                    reached[piece] = True
        start = at[rows[0]]
        if starts.dictionary[int(start)].is_valid:
            known = own[rows]
            reached[known[~nothing[known]]] = False
        found.append(np.flatnonzero(reached).astype(np.int32))
        firsts.append(np.full(len(found[-1]), start, np.int32))
    take = lambda values, parts: values.take(pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
    return pa.table({"start": take(starts.dictionary, firsts), "node_uuid": take(unique, found)})


def _next_hop(seen: DataFrame, links: DataFrame, hop: int) -> DataFrame:
    """Children that a start has not reached before: a task follows a block of starts, to which a node's children are sent once."""
    frontier = seen.filter(F.col("hops") == hop - 1)
    blocks = -(-max(frontier.agg(F.approx_count_distinct("start")).first()[0], 1) // STARTS)
    block = F.pmod(F.xxhash64("start"), F.lit(blocks))
    sizes = links.groupBy("parent_uuid").agg(F.count(F.lit(1)).alias("_n"))
    piece = F.pmod(F.xxhash64("child_uuid"), F.ceil(F.col("_n") / CHILDREN))
    lists = links.join(sizes, "parent_uuid").groupBy(F.col("parent_uuid").alias("node_uuid"), piece.alias("_piece")).agg(F.collect_list(F.struct("child_uuid")).alias("children"))  # about CHILDREN of them
    needed = frontier.select(block.alias("_block"), F.col("node_uuid").alias("node_uuid")).distinct()
    near = needed.join(lists, "node_uuid").select(F.col("_block").alias("_at"), "node_uuid", "children")
    types = dict(seen.dtypes) | {"child": dict(links.dtypes)["child_uuid"]}
    run = lambda left, right: _hop_block(left, right, hop)
    whole = seen.select(block.alias("_of"), F.col("start").alias("start"), F.col("node_uuid").alias("node_uuid"), "hops")
    step = whole.groupBy("_of").cogroup(near.groupBy("_at")).applyInArrow(run, f"start {types['start']}, node_uuid {types['child']}")
    return step.withColumn("hops", F.lit(hop))


def reachable(edges: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """starts(start, node_uuid) closed over parent -> child edges, with the hop count; ``hops`` bounds the search if given.

    The last hop of a bounded search, which may have as many rows as there are pairs, is not written here.
    """
    links = edges.select("parent_uuid", "child_uuid").distinct()
    seen = frontier = materialize(starts.select("start", "node_uuid", F.lit(0).alias("hops")))
    hop = 0
    if hops is not None:
        links = materialize(links)
        for hop in range(1, hops + 1):
            step = _next_hop(seen, links, hop)
            seen = seen.unionByName(step if hop == hops else materialize(step))
        return seen
    while True:
        hop += 1
        step = frontier.join(links, F.col("node_uuid") == F.col("parent_uuid")).select("start", F.col("child_uuid").alias("node_uuid")).distinct()
        frontier = materialize(step.join(seen, ["start", "node_uuid"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % 16 == 0:
            seen = materialize(seen)
    return seen


def would_create_cycle(edges: DataFrame, proposals: DataFrame, root: str | None = None) -> DataFrame:
    """proposals(parent_uuid, child_uuid) with a flag: the parent is reachable from the child.

    A proposal under the ``root`` node is always allowed.
    """
    closure = reachable(edges, proposals.select(F.col("child_uuid").alias("start"), F.col("child_uuid").alias("node_uuid")).distinct())
    back = closure.select(F.col("start").alias("child_uuid"), F.col("node_uuid").alias("parent_uuid"), F.lit(True).alias("cycle"))
    flagged = proposals.join(back, ["parent_uuid", "child_uuid"], "left").na.fill(False, ["cycle"])
    return flagged if root is None else flagged.withColumn("cycle", F.col("cycle") & ~F.col("parent_uuid").eqNullSafe(F.lit(root)))


def materialize_paths(edges: DataFrame, roots: DataFrame, existing: DataFrame) -> DataFrame:
    """roots(domain, path, node_uuid) -> new (domain, path, edge_id) of all descendants; a path never revisits a node."""
    links = edges.select(F.col("id").alias("edge_id"), "parent_uuid", "child_uuid", "name")
    frontier = materialize(roots.select("domain", "path", "node_uuid", F.array("node_uuid").alias("_trail")))
    found, depth = None, 0
    while True:
        depth += 1
        step = frontier.join(links, F.col("node_uuid") == F.col("parent_uuid")).filter(~F.array_contains("_trail", F.col("child_uuid")))
        frontier = materialize(step.select(
            "domain", F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name")).alias("path"), F.col("child_uuid").alias("node_uuid"),
            F.concat("_trail", F.array("child_uuid")).alias("_trail"), "edge_id"))
        if frontier.isEmpty():
            break
        new = frontier.select("domain", "path", "edge_id")
        found = new if found is None else found.unionByName(new)
        if depth % 16 == 0:
            found = materialize(found)
        frontier = frontier.drop("edge_id")
    if found is None:
        return existing.select("domain", "path", "edge_id").limit(0)
    return found.join(existing, ["domain", "path"], "left_anti")


def apply_versions(memories: DataFrame) -> DataFrame:
    """SCD-2: every version but the newest of a node is deprecated and points to its successor."""
    w = Window.partitionBy("node_uuid").orderBy("id")
    return memories.withColumn("migrated_to", F.lead("id").over(w)).withColumn("deprecated", F.col("migrated_to").isNotNull())


def cascade_delete(edges: DataFrame, paths: DataFrame, memories: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """Tables without doomed(node_uuid): its edges, the subtree paths through them, its memories."""
    dead = doomed.select(F.col("node_uuid").alias("_n"))
    kept = edges.join(dead, F.col("parent_uuid") == F.col("_n"), "left_anti").join(dead, F.col("child_uuid") == F.col("_n"), "left_anti")
    gone = paths.join(edges.join(kept.select("id"), "id", "left_anti").select(F.col("id").alias("edge_id")), "edge_id", "left_semi").select("domain", F.col("path").alias("_p"))
    # A path lies under a removed one when one of its own prefixes is removed: an equi-join on exploded prefixes.
    parts = F.split("path", "/")
    prefixes = paths.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))))
    hit = prefixes.join(gone, ["domain", "_p"], "left_semi").select("domain", "path").distinct()
    return {
        "edges": kept, "paths": paths.join(hit, ["domain", "path"], "left_anti"),
        "memories": memories.join(dead, F.col("node_uuid") == F.col("_n"), "left_anti"),
    }


def orphans(nodes: DataFrame, edges: DataFrame, paths: DataFrame, memories: DataFrame) -> DataFrame:
    """(kind, ref): edges without a path, nodes no path leads to, nodes without memories."""
    pathless = edges.join(paths.select(F.col("edge_id").alias("id")), "id", "left_anti").select(F.lit("pathless_edge").alias("kind"), F.col("id").cast("string").alias("ref"))
    led = node_uris(edges, paths).select(F.col("node_uuid").alias("uuid"))
    unreached = nodes.join(led, "uuid", "left_anti").select(F.lit("unreachable_node").alias("kind"), F.col("uuid").alias("ref"))
    empty = nodes.join(memories.select(F.col("node_uuid").alias("uuid")), "uuid", "left_anti").select(F.lit("empty_node").alias("kind"), F.col("uuid").alias("ref"))
    return pathless.unionByName(unreached).unionByName(empty)


def recent(edges: DataFrame, paths: DataFrame, memories: DataFrame, limit: int = 10) -> DataFrame:
    """Newest active memories with their first URI."""
    first = node_uris(edges, paths).groupBy("node_uuid").agg(F.min("uri").alias("uri"))
    return active_versions(memories).join(first, "node_uuid").orderBy(F.desc("created_at"), F.desc("memory_id")).limit(limit)


def neighbors_khop(edges: DataFrame, starts: DataFrame, hops: int = 1, min_similarity: float = 0.0) -> DataFrame:
    """(start, node_uuid, hops) over undirected similarity edges; an unparsable similarity is kept."""
    links = edges.filter(F.col("name") == "task_similar")
    if min_similarity > 0:
        sim = F.col("disclosure").try_cast("double")
        links = links.filter(sim.isNull() | (sim >= min_similarity))
    both = links.select("parent_uuid", "child_uuid").unionByName(links.select(F.col("child_uuid").alias("parent_uuid"), F.col("parent_uuid").alias("child_uuid")))
    return reachable(both, starts.select("start", F.col("start").alias("node_uuid")), hops).filter("hops > 0")


def upsert_undirected(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (a, b, similarity) not present in either direction; similarity to 4 places."""
    canon = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    fresh = canon(new).groupBy("a", "b").agg(F.max(F.round("similarity", 4)).alias("similarity"))
    return canon(existing).unionByName(fresh.join(canon(existing), ["a", "b"], "left_anti"))


def upsert_directed(existing: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.groupBy("a", "b").agg(F.max(F.round("similarity", 4)).alias("similarity"))
    return existing.select("a", "b", "similarity").unionByName(fresh.join(existing, ["a", "b"], "left_anti"))


# ------------------------------------------------------------------------ glossary
def glossary_index(glossary: DataFrame, edges: DataFrame, paths: DataFrame, memories: DataFrame) -> DataFrame:
    """keyword -> node, its first URI (or unlinked://node) and a one-line 100-character snippet."""
    first = node_uris(edges, paths).groupBy("node_uuid").agg(F.min("uri").alias("_u"))
    flat = F.replace(F.substring("content", 1, 100), F.lit("\n"), F.lit(" "))
    return glossary.select("keyword", "node_uuid").distinct().join(first, "node_uuid", "left").join(active_versions(memories), "node_uuid", "left").select(
        "keyword", "node_uuid", F.coalesce("_u", F.concat(F.lit("unlinked://"), "node_uuid")).alias("uri"), flat.alias("snippet"))


def match_glossary(docs: DataFrame, glossary: DataFrame, key: str = "doc_id", content: str = "text", gram: int = 4) -> DataFrame:
    """Every (doc, keyword) with the keyword a substring of the content.

    Keywords of at least ``gram`` characters meet the documents on their rarest
    n-gram, an equi-join, and are then verified; shorter ones are looked up
    among the document's short substrings of their own length.
    """
    keywords = glossary.select("keyword").distinct().filter(F.length("keyword") > 0)
    rest = 2**30

    def grams(c, n):
        """Distinct substrings of length n, by zipping shifted character arrays (linear in the text)."""
        chars = F.split(c, "")
        out, have = chars, 1
        while have < n:
            step = min(have, n - have)
            tail = out if step == have else chars
            out = F.zip_with(out, F.slice(tail, have + 1, rest), lambda x, y: F.concat(x, y))
            have += step
        return F.array_distinct(F.array_compact(out))

    long_kw, short_kw = keywords.filter(F.length("keyword") >= gram), keywords.filter(F.length("keyword") < gram)
    doc_grams = docs.select(key, F.explode(grams(F.col(content), gram)).alias("g"))
    kw_grams = long_kw.select("keyword", F.explode(grams(F.col("keyword"), gram)).alias("g"))
    freq = doc_grams.join(kw_grams.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("_f"))
    rarest = kw_grams.join(freq, "g", "left").groupBy("keyword").agg(F.min_by("g", F.struct(F.coalesce("_f", F.lit(0)), "g")).alias("g"))
    candidates = doc_grams.join(rarest, "g").select(key, "keyword").distinct()
    hits = candidates.join(docs.select(key, content), key).filter(F.contains(content, "keyword")).select(key, "keyword")
    lengths = range(1, gram)
    short_parts = docs.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col(content), n) for n in lengths])))).alias("keyword"))
    return hits.unionByName(short_parts.join(short_kw, "keyword", "left_semi").select(key, "keyword"))


def resolve_keywords(wanted: DataFrame, glossary: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    first = node_uris(edges, paths).groupBy("node_uuid").agg(F.min("uri").alias("uri"))
    return wanted.select("keyword").distinct().join(glossary.select("keyword", "node_uuid"), "keyword", "left").join(first, "node_uuid", "left")


# ------------------------------------------------------------------------- changes
def changeset_diff(changes: DataFrame) -> DataFrame:
    """changes(seq, tbl, key, before, after) -> net insert, update or delete per row; no-ops drop out."""
    net = changes.groupBy("tbl", "key").agg(F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"))
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return net.filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", kind)


def changeset_gc(changes: DataFrame) -> DataFrame:
    """Log without rows that were created and deleted again, and without what was created for them only.

    ``before`` and ``after`` hold rows as JSON; tables are nodes, memories, edges, paths and
    glossary_keywords.  If any row came and went, these created rows go too: nodes that no path which
    is left leads to (by its own node or over an edge that is left), memories and keywords of such nodes
    that were created here, and edges that no path which is left uses.
    """
    net = materialize(changes.groupBy("tbl", "key").agg(F.min_by("before", "seq").alias("_b"), F.max_by("after", "seq").alias("_a")))
    at = lambda name: F.get_json_object(F.coalesce("_a", "_b"), f"$.{name}")
    gone = F.col("_b").isNull() & F.col("_a").isNull()
    dead = net.filter(gone).select("tbl", "key")
    if dead.isEmpty():
        return changes
    left = net.filter(~gone)
    routes = left.filter("tbl = 'paths'").select(at("edge_id").alias("edge_id"), at("node_uuid").alias("node"))
    over = left.filter("tbl = 'edges'").select(F.col("key").alias("edge_id"), at("child_uuid").alias("node"))
    reached = routes.select("edge_id").join(over, "edge_id").select("node").unionByName(routes.select("node")).filter("node IS NOT NULL").distinct()
    created = net.filter("tbl = 'nodes' AND _b IS NULL").select(F.col("key").alias("node")).join(reached, "node", "left_anti")
    new = left.filter("_b IS NULL")
    nodes = new.filter("tbl = 'nodes'").select("tbl", "key", at("uuid").alias("node")).join(reached, "node", "left_anti")
    owned = new.filter("tbl IN ('memories', 'glossary_keywords')").select("tbl", "key", at("node_uuid").alias("node")).join(created, "node", "left_semi")
    edges = new.filter("tbl = 'edges'").select("tbl", "key", at("id").alias("edge_id")).join(routes, "edge_id", "left_anti")
    dead = dead.unionByName(nodes.select("tbl", "key")).unionByName(owned.select("tbl", "key")).unionByName(edges.select("tbl", "key"))
    return changes.join(dead, ["tbl", "key"], "left_anti")


def changes_by_node(diff: DataFrame) -> DataFrame:
    """Pending changes per node: the node key is taken from the row itself."""
    row = F.coalesce("after", "before")
    node = F.coalesce(F.get_json_object(row, "$.node_uuid"), F.get_json_object(row, "$.child_uuid"), F.get_json_object(row, "$.uuid"), F.col("key"))
    return diff.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n_changes"), F.count(F.when(F.col("change") == "insert", 1)).alias("n_inserts"),
                                                F.count(F.when(F.col("change") == "update", 1)).alias("n_updates"), F.count(F.when(F.col("change") == "delete", 1)).alias("n_deletes"))


# --------------------------------------------------------------- typed memories
# Base importance and confidence per type and the amounts each fact adds.
def promotion_score(memories: DataFrame) -> DataFrame:
    """Importance, confidence and layer flags per typed memory.

    Columns used: memory_type, file_exists, platform, n_obs, n_vars, status,
    source_dataset_id, output_path, confirmed, evidence.
    """
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    add = lambda *parts: sum((F.when(c, v).otherwise(0.0) for c, v in parts), F.lit(0.0))
    kind = F.col("memory_type")
    shape = F.col("n_obs").isNotNull() | F.col("n_vars").isNotNull()
    done, exists = F.col("status") == "completed", F.coalesce("file_exists", F.lit(True))
    confirmed, evidence = F.coalesce("confirmed", F.lit(False)), filled("evidence")
    importance = (
        F.when(kind == "preference", 0.95).when(kind == "project_context", 0.9)
        .when(kind == "dataset", 0.35 + add((filled("platform"), 0.15), (shape, 0.15)))
        .when(kind == "analysis", 0.4 + add((done, 0.2), (filled("source_dataset_id"), 0.1), (filled("output_path"), 0.15)))
        .when(kind == "insight", 0.35 + add((confirmed, 0.35), (evidence, 0.2))).otherwise(0.0)
    )
    confidence = (
        F.when(kind == "preference", 0.95).when(kind == "project_context", 0.9)
        .when(kind == "dataset", 0.45 + add((exists, 0.2), (filled("platform"), 0.15), (shape, 0.1)))
        .when(kind == "analysis", 0.4 + add((done, 0.25), (filled("source_dataset_id"), 0.1), (filled("output_path"), 0.1)))
        .when(kind == "insight", 0.45 + add((confirmed, 0.35), (evidence, 0.15))).otherwise(0.0)
    )
    clamp = lambda c: F.least(F.greatest(F.round(c, 3), F.lit(0.0)), F.lit(1.0))
    rows = memories.withColumn("importance", clamp(importance)).withColumn("confidence", clamp(confidence))
    promote = (
        kind.isin("preference", "project_context")
        | ((kind == "dataset") & (F.col("confidence") >= 0.75) & (F.col("importance") >= 0.55))
        | ((kind == "analysis") & F.coalesce(done, F.lit(False)) & (filled("output_path") | filled("source_dataset_id")))
        | ((kind == "insight") & (confirmed | evidence))
    )
    return rows.withColumn("promote", promote).withColumn("store_episodic", ~kind.isin("preference", "project_context"))


def layered_latest(layers: DataFrame, limit: int | None = None, session: str | None = None) -> DataFrame:
    """Newest row per memory_id over both layers; the semantic one wins ties."""
    rows = layers if session is None else layers.filter(F.col("session_id") == session)
    rank = F.when(F.col("layer") == "semantic", 1).otherwise(0)
    latest = top_per_group(rows.withColumn("_l", rank), ["memory_id"], [F.desc("created_at"), F.desc("_l")], 1).drop("rank", "_l")
    return latest if limit is None else latest.orderBy(F.desc("created_at"), "memory_id").limit(limit)


# How many memories of each type enter a session's context.
CONTEXT_SIZES = {"project_context": 1, "dataset": 1, "analysis": 3, "preference": 5, "insight": 3}


def context_topn(latest: DataFrame) -> DataFrame:
    """One text block per session and type with its newest memories."""
    size = F.coalesce(*[F.when(F.col("memory_type") == k, n) for k, n in CONTEXT_SIZES.items()])
    ranked = top_per_group(latest, ["session_id", "memory_type"], [F.desc("created_at"), "memory_id"], max(CONTEXT_SIZES.values())).filter(F.col("rank") <= size)
    packed = ranked.groupBy("session_id", "memory_type").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_t"))  # at most five
    return packed.select("session_id", "memory_type", F.concat_ws("\n", F.transform("_t", lambda x: x["text"])).alias("block"))


def rank_candidates(candidates: DataFrame, max_candidates: int = 10) -> DataFrame:
    """candidates(query_id, candidate_id, memory_type, query, text, source): one best per type first, then by score."""
    # Cues of a preferred type, in the order they are tried, and the default order.
    cues = {
        "dataset": ("dataset", "sample", "file", "h5ad", "visium"), "analysis": ("analysis", "method", "pipeline", "preprocess", "cluster", "run"),
        "preference": ("prefer", "language", "format", "english", "chinese", "中文"), "insight": ("cell type", "marker", "biological", "insight", "annotation"),
        "project_context": ("goal", "species", "tissue", "disease", "project"),
    }
    order = ("analysis", "dataset", "project_context", "insight", "preference")
    lower = F.lower("query")
    preferred = F.lit(None).cast("string")
    for name in reversed(cues):
        preferred = F.when(tx._any_of(lower, cues[name]), name).otherwise(preferred)
    base = F.coalesce(*[F.when(F.col("memory_type") == n, i) for i, n in enumerate(order)])
    pref_base = F.coalesce(*[F.when(preferred == n, i) for i, n in enumerate(order)], F.lit(len(order)))
    position = F.when(F.col("memory_type") == preferred, 0).when(base < pref_base, base + F.when(preferred.isNull(), 0).otherwise(1)).otherwise(base)
    lexical = tx.jaccard(tx.tokenize(lower), tx.tokenize(F.lower("text")))
    score = lexical + F.greatest(F.lit(0.0), 0.75 - 0.22 * position) + F.when(F.col("source") == "search", 0.1).otherwise(0.0)
    scored = candidates.withColumn("score", score).withColumn("_pos", position)
    by_type = Window.partitionBy("query_id", "memory_type").orderBy(F.desc("score"), "candidate_id")
    typed = scored.withColumn("_t", F.row_number().over(by_type))
    return top_per_group(typed, ["query_id"], [F.when(F.col("_t") == 1, 0).otherwise(1), F.desc("score"), "_pos", "candidate_id"], max_candidates).drop("_t", "_pos")


def retrieve_related(tasks: DataFrame, query_tokens: DataFrame, edges: DataFrame, seeds: int = 3, hops: int = 1, min_similarity: float = 0.1, top: int = 5) -> DataFrame:
    """Best matching tasks of each query, widened over similarity edges, split by status.

    tasks(node_uuid, tokens, status), query_tokens(query_id, tokens).  Token
    overlap is counted through an equi-join on tokens.
    """
    t = tasks.select("node_uuid", F.size("tokens").alias("_nt"), F.explode("tokens").alias("w"))
    q = query_tokens.select("query_id", F.size("tokens").alias("_nq"), F.explode("tokens").alias("w"))
    overlap = q.join(t, "w").groupBy("query_id", "node_uuid", "_nt", "_nq").agg(F.count(F.lit(1)).alias("_o"))
    scored = overlap.select("query_id", "node_uuid", (F.col("_o") / (F.col("_nt") + F.col("_nq") - F.col("_o"))).alias("score"))
    best = materialize(top_per_group(scored, ["query_id"], [F.desc("score"), "node_uuid"], seeds))
    wide = neighbors_khop(edges, best.select(F.col("node_uuid").alias("start")).distinct(), hops, min_similarity)
    grown = best.select("query_id", "node_uuid", "score").unionByName(
        best.join(wide.withColumnRenamed("node_uuid", "_n"), F.col("node_uuid") == F.col("start")).select("query_id", F.col("_n").alias("node_uuid"), F.lit(0.0).alias("score")))
    ranked = grown.groupBy("query_id", "node_uuid").agg(F.max("score").alias("score")).join(tasks.select("node_uuid", "status"), "node_uuid")
    return top_per_group(ranked, ["query_id", "status"], [F.desc("score"), "node_uuid"], top)


def related_insights(insights: DataFrame, uris: DataFrame, threshold: int = 1) -> DataFrame:
    """insights(memory_id, positive_task_uris) sharing at least ``threshold`` URIs, most first."""
    hits = insights.select("memory_id", F.explode("positive_task_uris").alias("uri")).join(uris.select("uri").distinct(), "uri", "left_semi")
    return hits.groupBy("memory_id").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= threshold)


def apply_rule_ops(ops: DataFrame) -> DataFrame:
    """ops(rule, op, uris) folded to (rule, score, uris): ADD 2, AGREE and EDIT +1, REMOVE -1, pruned at 0."""
    delta = F.when(F.col("op") == "ADD", 2).when(F.col("op").isin("AGREE", "EDIT"), 1).when(F.col("op") == "REMOVE", -1).otherwise(0)
    folded = ops.groupBy("rule").agg(F.sum(delta).alias("score"))
    uris = ops.select("rule", F.explode("uris").alias("u")).groupBy("rule").agg(F.array_sort(F.collect_set("u")).alias("uris"))
    return folded.filter("score > 0").join(uris, "rule", "left")


def parse_rule_ops(text):
    """Array of (op, ref, rule) from lines such as ``AGREE 3: text.``; the text must end with a full stop."""
    line = r"(?m)^((?:AGREE|REMOVE|EDIT|ADD)(?: \d+)?: .*\.)$"
    return F.transform(F.regexp_extract_all(text, F.lit(line), F.lit(1)), lambda m: F.struct(
        F.regexp_extract(m, r"^([A-Z]+)", 1).alias("op"), F.regexp_extract(m, r"^[A-Z]+ (\d+)", 1).try_cast("int").alias("ref"), F.regexp_extract(m, r": (.*)$", 1).alias("rule")))


def deprecate_short(memories: DataFrame, min_len: int = 500) -> DataFrame:
    """Active analysis memories whose trajectory text is shorter than the limit; unparsable JSON is left alone."""
    trajectory = F.get_json_object("content", "$.trajectory")
    return memories.withColumn("deprecated", F.col("deprecated") | F.coalesce(F.length(trajectory) < min_len, F.lit(False)))


def canonical_entity(kind, value):
    """cluster_3, domain_3 and the like from loosely written ids; text is lower-cased with underscores."""
    number = F.regexp_extract(F.lower(value), r"(\d+)\s*$", 1)
    return F.when(number != "", F.concat_ws("_", F.lower(kind), number.cast("bigint").cast("string"))).otherwise(F.regexp_replace(F.trim(F.lower(value)), r"[\s\-]+", "_"))


def dedupe_insights(insights: DataFrame) -> DataFrame:
    """Newest insight per canonical entity."""
    keyed = insights.withColumn("canonical", canonical_entity(F.col("entity_type"), F.col("entity_id")))
    return top_per_group(keyed, ["entity_type", "canonical"], [F.desc("created_at"), "memory_id"], 1).drop("rank")


def cluster_rules(analyses: DataFrame, insights: DataFrame, min_rules: int = 2) -> DataFrame:
    """analyses(cluster_id, uri) and insights(memory_id, rule, positive_task_uris) -> rules per task cluster sharing a URI.

    A null cluster counts as 0; clusters with fewer than ``min_rules`` insights drop out.
    """
    tasks = analyses.select(F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"), "uri").distinct()
    ruled = insights.filter(F.coalesce("rule", F.lit("")) != "").select("memory_id", "rule", F.explode("positive_task_uris").alias("uri"))
    hits = ruled.join(tasks, "uri").select("cluster_id", "memory_id", "rule").distinct()
    enough = hits.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_rules")).filter(F.col("n_rules") >= min_rules)
    return hits.join(enough, "cluster_id")


# Limits of a preference, words its key may hold, and marks of facts in its value.
PREFERENCE_LIMITS = {"key": 64, "value": 120, "tokens": 16}
PREFERENCE_WORDS = (
    "citation", "dpi", "explanation", "figure", "format", "language", "markdown", "method", "model", "palette",
    "provider", "resolution", "response", "style", "theme", "timezone", "tone", "verbosity", "workflow",
)
PREFERENCE_STARTS = ("current_", "default_", "preferred_")
FACT_MARKS = ("\n", "\r", "http://", "https://", "```", ".h5ad", ".h5mu", ".csv", ".tsv", ".txt", ".json", ".png", ".pdf", "/", "\\")


def validate_preferences(preferences: DataFrame) -> DataFrame:
    """preferences(key, value) with normalised columns, ``valid`` and the first ``reason`` against it."""
    key = F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce("key", F.lit("")))), "- ", "__"), "_+", "_")
    rows = preferences.withColumn("norm_key", F.regexp_replace(key, "^_+|_+$", "")).withColumn("norm_value", F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", " ")))
    stems = F.split("norm_key", "_")
    named = F.arrays_overlap(stems, F.array(*[F.lit(w) for w in PREFERENCE_WORDS])) | F.regexp_like("norm_key", F.lit("^(?:" + "|".join(PREFERENCE_STARTS) + ")"))
    lower = F.lower("norm_value")
    factual = F.lit(False)
    for mark in FACT_MARKS:
        factual = factual | F.contains(lower, F.lit(mark))
    reason = (
        F.when(F.col("norm_key") == "", "empty key").when(F.length("norm_key") > PREFERENCE_LIMITS["key"], "long key").when(~named, "not a tendency")
        .when(F.col("norm_value") == "", "empty value").when(F.length("norm_value") > PREFERENCE_LIMITS["value"], "long value")
        .when(F.size(F.split("norm_value", " ")) > PREFERENCE_LIMITS["tokens"], "many words").when(factual, "fact-like value")
    )
    return rows.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def targeted_context(queries: DataFrame, latest: DataFrame, terms: int = 5) -> DataFrame:
    """Memories to show for queries(query_id, session_id, query) that ask to recall or to go on.

    ``latest(memory_id, session_id, memory_type, created_at, text)``: the newest dataset and analysis of
    the session first, then at most ``terms`` distinct memories of it that hold a focus term of the query,
    newest first.  Rows: (query_id, memory_id, why, position).
    """
    intent = tx.classify_intent(F.col("query"))
    asking = queries.withColumn("_i", intent).filter("_i.recall or _i.continuation").select("query_id", "session_id", tx.focus_terms(F.col("query")).alias("focus"))
    newest = top_per_group(latest.filter(F.col("memory_type").isin("dataset", "analysis")), ["session_id", "memory_type"], [F.desc("created_at"), "memory_id"], 1).drop("rank")
    first = asking.join(newest, "session_id").select("query_id", "memory_id", F.concat(F.lit("newest "), "memory_type").alias("why"), F.when(F.col("memory_type") == "dataset", 1).otherwise(2).alias("position"))
    words = asking.select("query_id", "session_id", F.explode("focus").alias("term"))
    hits = words.join(latest, "session_id").filter(F.contains(F.lower("text"), "term")).groupBy("query_id", "memory_id").agg(F.max("created_at").alias("created_at"))
    others = hits.join(first.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    ranked = top_per_group(others, ["query_id"], [F.desc("created_at"), "memory_id"], terms)
    return first.unionByName(ranked.select("query_id", "memory_id", F.lit("focus term").alias("why"), (F.col("rank") + 2).cast("int").alias("position")))
