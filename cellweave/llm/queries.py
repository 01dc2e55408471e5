"""Registered queries opN_<name> of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm import conversation, embedding, language, mixing, packing, phrases, quality_knn, quality_rules, sharding, simhash, token_counts, toxicity, url_filter
from cellweave.llm.common import load, small_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


@register("op1_kd_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(load(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT lev FROM l WHERE ratio >= lev ORDER BY ratio, source NULLS LAST LIMIT 1) * weight, 2.0::DOUBLE * source_size)) AS target FROM l),
p AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS place,
             CAST(CAST('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(place * e + u) - floor((place - 1) * e + u) AS BIGINT) AS copies FROM p)
SELECT doc_id, size, source, source_size, target, copies, copies * size AS taken FROM c"""


@register("op5_mixing", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM b),
win AS (SELECT doc_id, i, word, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3 FROM e WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS c FROM win WHERE w3 IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct_words,
             CAST(len(regexp_extract_all(text, '\p{L}')) AS BIGINT) AS n_letters, CAST(len(regexp_extract_all(text, '\p{Lu}')) AS BIGINT) AS n_upper,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM b LEFT JOIN cov ON b.doc_id = cov.doc_id),
f AS (SELECT *, CAST(""" + " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(quality_rules.RULES.values())) + r""" AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       fail_bits = 0 AS kept, n_lines, n_distinct_words, n_letters, n_upper, fail_bits FROM f"""


@register("op7_quality_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.rejects(quality_rules.mask_of("base")).alias("base_failed"),
        (~quality_rules.rejects(quality_rules.mask_of("v1"))).alias("kept"), "n_lines", "n_distinct_words", "n_letters", "n_upper", "fail_bits")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

OP9_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
j AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j"""


@register("op9_url_filter", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = small_table(spark, RULES, "host string, path string, verdict string")
    return url_filter.judge(load(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@register("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


@register("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op3_bin_completion_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op8_multi_index_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(load(spark, sf_dir, "embeddings"))


@register("op10_quality_knn")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@register("op6_language_evidence")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(load(spark, sf_dir, "pages"), language.fit(load(spark, sf_dir, "documents")))


#: CRC32 of an ASCII string, bit by bit.
CRC32_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT))"


def crc32_sql(text: str) -> str:
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


#: The edit lattice row by row: every state keeps its cheapest edits; up to two insertions before each row and at the end.
OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT """ + CRC32_TABLE + r""" AS tab),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             """ + crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + r""" % 20 AS how FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
             CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS again FROM c WHERE how <> 0),
o AS (SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
r AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS ini, before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS clash,
             CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault FROM o),
k AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
pre AS (SELECT * FROM (VALUES (0,0,0,'',''), (0,2,3,'I','user:'), (0,3,6,'II',concat('user:', chr(10), 'assistant:')), (1,1,0,'',''), (1,2,3,'I','user:'), (1,3,6,'II',concat('user:', chr(10), 'assistant:')),
        (2,2,0,'',''), (2,3,3,'I','assistant:'), (2,2,6,'II',concat('assistant:', chr(10), 'user:')), (3,3,0,'',''), (3,2,3,'I','user:'), (3,3,6,'II',concat('user:', chr(10), 'assistant:'))) v(a, b, price, ins, made)),
op AS (SELECT * FROM (VALUES (0,0,4,'D',NULL,NULL), (1,1,4,'D',NULL,NULL), (2,2,4,'D',NULL,NULL), (3,3,4,'D',NULL,NULL), (0,2,3,'R',NULL,'user'), (1,2,3,'R',NULL,'user'), (3,2,3,'R',NULL,'user'), (2,3,3,'R',NULL,'assistant'),
        (0,1,0,'K','s',NULL), (0,2,0,'K','u',NULL), (1,2,0,'K','u',NULL), (3,2,0,'K','u',NULL), (2,3,0,'K','a',NULL)) v(b, e, price, edit, needs, becomes)),
lat AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, NULL::VARCHAR AS made FROM k
        UNION ALL
        SELECT conv_id, i + 1, s, best.cost, best.audit, best.made FROM (
          SELECT l.conv_id, l.i, op.e AS s, min(struct_pack(cost := l.cost + pre.price + op.price + CASE WHEN op.edit <> 'D' AND r.fault = 3 THEN 3 ELSE 0 END, audit := l.audit || pre.ins || op.edit,
                 made := nullif(concat_ws(chr(10), l.made, nullif(pre.made, ''), CASE WHEN op.edit <> 'D' THEN coalesce(op.becomes, r.role) || ':' || r.text END), ''))) AS best
          FROM lat l JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i JOIN pre ON pre.a = l.s JOIN op ON op.b = pre.b AND (op.needs IS NULL OR op.needs = r.ini) AND (op.edit = 'D' OR r.fault IN (0, 3))
          GROUP BY l.conv_id, l.i, op.e)),
fin AS (SELECT l.conv_id, min(struct_pack(cost := cost + pre.price, audit := audit || pre.ins, made := coalesce(concat_ws(chr(10), l.made, nullif(pre.made, '')), ''))) AS best
        FROM lat l JOIN k ON k.conv_id IS NOT DISTINCT FROM l.conv_id AND k.n = l.i JOIN pre ON pre.a = l.s AND pre.b IN (0, 3) GROUP BY l.conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
             count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE clash) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id"""


@register("op12_conversation_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return conversation.report(turns, conversation.damage(turns))


@register("op11_toxicity_neighbours")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, row_number() OVER () AS pid FROM d),
e AS (SELECT lang, pid, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM p),
x AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM e WINDOW o AS (PARTITION BY pid ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS a FROM x GROUP BY ALL UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM x WHERE w2 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM x WHERE w3 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE a >= 10),
s AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
c AS (SELECT s.lang, s.phrase, s.k, s.a, x.a AS l, y.a AS r, cut, CAST((1000000 * s.a::HUGEINT * s.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
      FROM s JOIN (SELECT unnest([1, 2]) AS cut) ON cut < s.k JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:cut], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[cut + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, inside, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inside FROM s WHERE k = 3) GROUP BY lang, inside),
t AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.inside = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT t.lang, CAST(row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM t JOIN n ON n.lang = t.lang QUALIFY rank <= 2000"""


@register("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(load(spark, sf_dir, "documents").select("text", "lang"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 2000")  # each task sends its first 2000 only
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
