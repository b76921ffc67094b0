"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.llm import context_mixing, exact_dedup, html, knn, merkle, mixing, packing, periodic, quality, secrets, sentencepiece, sharding, simhash
from voxcohort.plans.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


@query
def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


@query
def op4_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), all_hashes=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op4_progressive_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@query
def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.as_text(base).cast("binary"), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


@query
def op6_popcount_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights).select("doc_id", "source", "size", "source_size", "target", "taken")


ORACLES["op8_source_mix"] = r"""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
rows AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('42:' || d.doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)
      / (CASE l.q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS key
  FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w, 2 * source_size AS cap,
  1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s),
s2 AS (SELECT *, row_number() OVER r AS k, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM s1 WINDOW r AS (ORDER BY cap::DOUBLE / w, encode(source) NULLS LAST)),
s3 AS (SELECT *, (total - before::DOUBLE) / rest_w::DOUBLE AS level FROM s2),
s4 AS (SELECT *, min_by(level, k) FILTER (WHERE level * w <= cap) OVER () AS final FROM s3),
s5 AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(final * w, cap::DOUBLE)) AS target FROM s4),
p AS (SELECT rows.*, s5.source_size, s5.target, coalesce(sum(size) OVER (PARTITION BY rows.source ORDER BY key, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows JOIN s5 ON rows.source IS NOT DISTINCT FROM s5.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p)
SELECT doc_id, source, size, source_size, target,
  (size * least(whole + CASE WHEN before + size / 2::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM e
"""


@query
def op9_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % knn.EVERY == 0)


ORACLES["op9_voronoi_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs(table(spark, sf_dir, "documents"))


@query
def op12_merkle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": merkle.without_line_feeds()})
    return out.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLES["op12_merkle_levels"] = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h >> 1, (h & 1) * 3988292384) END), 4294967295::BIGINT) AS h
  FROM documents),
f AS (
  SELECT documents.doc_id, source, coalesce(strlen(documents.doc_id::VARCHAR) || ':' || documents.doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN h % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen
  FROM documents JOIN crc USING (doc_id)),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS seen_leaf FROM f),
low AS (
  SELECT source, 0 AS level, list(leaf ORDER BY doc_id) AS nodes FROM l GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, ((len(nodes) + 2) // 3)::BIGINT), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))
  FROM low WHERE len(nodes) > 1),
subs AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS k FROM low WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY k) AS nodes FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range(0, ((len(nodes) + 2) // 3)::BIGINT), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))
  FROM top WHERE len(nodes) > 1),
placed AS (
  SELECT l.*, subroot, subs.k AS source_at, row_number() OVER (PARTITION BY l.source ORDER BY doc_id) - 1 AS place
  FROM l JOIN subs ON l.source IS NOT DISTINCT FROM subs.source),
steps AS (
  SELECT doc_id, level, nodes, place // (3 ** level)::BIGINT AS i FROM placed JOIN low ON placed.source IS NOT DISTINCT FROM low.source WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 1000 + level, nodes, source_at // (3 ** level)::BIGINT AS i FROM placed, top WHERE len(nodes) > 1),
sides AS (
  SELECT doc_id, level, coalesce(array_to_string(nodes[3 * (i // 3) + 1 : i], ''), '') AS l, coalesce(array_to_string(nodes[i + 2 : 3 * (i // 3) + 3], ''), '') AS r FROM steps),
proof AS (SELECT doc_id, string_agg(l || r, '' ORDER BY level) AS proof, list(l || '|' || r ORDER BY level) AS path FROM sides GROUP BY doc_id),
folded AS (
  SELECT placed.*, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_concat([seen_leaf], path), lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root
  FROM placed LEFT JOIN proof USING (doc_id))
SELECT doc_id, source, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query
def op13_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))
