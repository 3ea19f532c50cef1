"""The queries of this package, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontam, embed_dedup, line_dedup, pii, quality, secret_scan, sharding, simhash, substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(load(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(load(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(load(spark, sf_dir, "documents"), vocabulary())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"), 40)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(load(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(load(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_near(load(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    found = (
        op1_embedding_dedup, op2_pii, op3_bpe, op4_sharding, op5_substring_dedup,
        op6_secret_scan, op7_quality, op8_simhash, op9_decontamination, op10_line_dedup,
    )
    return {q.__name__: q for q in found}


def _sharding_sql() -> str:
    """Draws of every child under the chosen parent, level by level; CRC-32 byte by byte from a table made by its rule."""
    nodes, children = sharding.layout(40), []
    grown = sharding.layout(41)
    for tree, regions in (("old", nodes), ("new", grown)):
        for i, r in enumerate(regions):
            children.append(f"('{tree}', 'root', 'region {r.name}', {r.weight}, '{r.name}', {i})")
            for j, x in enumerate(r.racks):
                children.append(f"('{tree}', '{r.name}', 'rack {x.name}', {x.weight}, '{x.name}', {j})")
                children += [f"('{tree}', '{x.name}', 'shard {x.name}.{s}', {w}, '{s}', {s})" for s, w in x.shards]
    level = """, {out} AS (
SELECT k, tree, arg_min(child, ROW(draw, num)) AS at FROM (
 SELECT p.k, p.tree, c.child, c.num,
  -ln((CAST(CAST('0x' || substr(md5(c.name || '|' || p.k), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / c.weight AS draw
 FROM {src} p JOIN tree c ON c.tree = p.tree AND c.parent = p.at) GROUP BY k, tree)"""
    return (
        "WITH tree(tree, parent, name, weight, child, num) AS (VALUES " + ", ".join(children) + ")"
        ", keys AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents)"
        ", roots AS (SELECT k, t.tree, 'root' AS at FROM keys, (VALUES ('old'), ('new')) t(tree))"
        + level.format(out="region", src="roots") + level.format(out="rack", src="region") + level.format(out="leaf", src="rack")
        + """, crc0 AS (SELECT i::BIGINT AS i, i::BIGINT AS c FROM range(256) r(i)),
"""
        + ", ".join(f"crc{n + 1} AS (SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM crc{n})" for n in range(8))
        + """, crc AS (SELECT list(c ORDER BY i) AS t FROM crc8),
sums AS (SELECT text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc
 FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), crc),
rows AS (SELECT d.doc_id, CAST(strlen(coalesce(d.text, '')) + 16 AS BIGINT) AS size,
  CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE s.crc END AS BIGINT) AS text_crc32, 'key' AS law,
  CAST(o.at AS INTEGER) AS shard, CAST(n.at AS INTEGER) AS grown_shard
 FROM documents d
 JOIN sums s ON s.text = coalesce(d.text, '')
 JOIN leaf o ON o.k = coalesce(CAST(d.doc_id AS VARCHAR), 'null') AND o.tree = 'old'
 JOIN leaf n ON n.k = coalesce(CAST(d.doc_id AS VARCHAR), 'null') AND n.tree = 'new')
SELECT doc_id, size, text_crc32, law, shard,
 row_number() OVER (PARTITION BY shard ORDER BY
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || text_crc32 || '|' || size), 1, 13) AS BIGINT), doc_id, text_crc32, size) - 1 AS slot,
 grown_shard FROM rows"""
    )


LINE_DEDUP_SQL = """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, text FROM documents),
lines AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
 FROM docs WHERE text IS NOT NULL),
totals AS (SELECT host, count(*) AS total FROM docs GROUP BY host),
often AS (SELECT l.host, l.line FROM lines l JOIN totals t USING (host) WHERE length(trim(l.line, ' ')) > 0
 GROUP BY l.host, l.line, t.total HAVING count(DISTINCT r) > t.total * 0.05 AND count(DISTINCT r) >= least(5, greatest(3, ceil(t.total * 0.8)))),
kept AS (SELECT l.r, count(*) AS n_lines, count(o.line) AS n_dropped,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE o.line IS NULL), '') AS text
 FROM lines l LEFT JOIN often o ON o.host = l.host AND o.line = l.line GROUP BY l.r)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (r)"""


SUBSTRING_SQL = """WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT r, doc_id, s, sha256(array_to_string(list_slice(words, s, s + 49), ' ')) AS h
 FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM docs WHERE doc_id IS NOT NULL AND len(words) >= 50)),
least AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
hit AS (SELECT DISTINCT w.r, unnest(range(w.s, w.s + 50)) AS p FROM windows w JOIN least l USING (h) WHERE l.first < w.doc_id),
each AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs),
kept AS (SELECT e.r, count(*) AS n_words, count(h.p) AS n_removed,
  coalesce(string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE h.p IS NULL), '') AS text
 FROM each e LEFT JOIN hit h ON h.r = e.r AND h.p = e.p GROUP BY e.r)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (r)"""


EMBEDDING_SQL = """WITH RECURSIVE good AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
 WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
 WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM good UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
 e.vec_id = coalesce(l.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN low l ON l.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others are tested against brute force."""
    return {
        "op1_embedding_dedup": EMBEDDING_SQL,
        "op4_sharding": _sharding_sql(),
        "op5_substring_dedup": SUBSTRING_SQL,
        "op10_line_dedup": LINE_DEDUP_SQL,
    }
