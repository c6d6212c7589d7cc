"""The registered queries of the corpus operators, and the DuckDB statements where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm import audit, bpe, caps, lattice, manifest, mixing, quality, sharding, simhash, substrings, suffixes, token_counts, topk
from leafpress.llm.common import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_vantage_prints(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op2_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    plan = mixing.mix_plan(table(spark, sf, "documents"), scratch=scratch)
    return scratch.result(plan.select("doc_id", "size", "source_size", "target", "taken"))


ORACLES["op2_source_mix"] = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes
), sorted AS (
  SELECT *, row_number() OVER o AS nth, coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed WINDOW o AS (ORDER BY 2.0 * source_size / weight, place)
), level AS (
  SELECT min_by(lifted, nth) AS lifted FROM (
    SELECT nth, weight, source_size, (1.5 * (SELECT sum(source_size) FROM sizes) - full_before) / weight_left AS lifted FROM sorted
  ) WHERE 2.0 * source_size > weight * lifted
), targets AS (
  SELECT *, least(2.0 * source_size, weight * (SELECT lifted FROM level)) AS target, CAST(ceil(source_size / 32.0) AS BIGINT) AS blocks FROM weighed
), seats AS (
  SELECT place, target / (2 * k + 1) AS quotient, k FROM targets, generate_series(0, CAST(ceil(target / 32) AS BIGINT) + 40) AS g(k)
), won AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place FROM seats ORDER BY quotient DESC, place, k LIMIT (SELECT CAST(round(round(sum(target), 3) / 32) AS BIGINT) FROM targets)
  ) GROUP BY place
), taken AS (
  SELECT t.*, least(coalesce(quota, 0), 2 * blocks) // greatest(blocks, 1) AS copies, least(coalesce(quota, 0), 2 * blocks) % greatest(blocks, 1) AS rest,
    ('0x' || substr(md5('7|' || place), 1, 15))::BIGINT % greatest(blocks, 1) AS start_at
  FROM targets t LEFT JOIN won USING (place)
), ordered AS (
  SELECT doc_id, size, place, sum(size) OVER (
    PARTITION BY place ORDER BY ('0x' || substr(md5('7|' || doc_id), 1, 15))::BIGINT, doc_id ROWS UNBOUNDED PRECEDING) - size AS begins
  FROM docs JOIN sizes ON docs.source IS NOT DISTINCT FROM sizes.source
), parts AS (
  SELECT doc_id, place, least(begins + size, (b + 1) * 32) - greatest(begins, b * 32) AS words, b
  FROM ordered, generate_series(CAST(begins // 32 AS BIGINT), CAST((begins + size - 1) // 32 AS BIGINT)) AS g(b) WHERE size > 0
), more AS (
  SELECT doc_id, sum(words) AS words FROM parts JOIN taken USING (place)
  WHERE (b + 1 + start_at) * rest // greatest(blocks, 1) > (b + start_at) * rest // greatest(blocks, 1) GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, CAST(copies * size + coalesce(words, 0) AS BIGINT) AS taken
FROM ordered JOIN taken USING (place) LEFT JOIN more USING (doc_id)
"""


@query
def op3_spherical_caps(spark: SparkSession, sf: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf, "embeddings"))


ORACLES["op3_spherical_caps"] = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
"""


@query
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op5_lattice_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.score_texts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_consistent_ring(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    return sharding.ring_shards(rows, "doc_id", 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf, "documents"), path, keep=["doc_id"], packed=True)
    decoded = bpe.decode(encoded, path, keep=["doc_id", "token_ids", "packed_ids"])
    return decoded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


@query
def op9_recompression(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.find_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op9_recompression"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM words, generate_series(1, len(w) - 49) AS g(s)
), gone AS (
  SELECT doc_id, s FROM windows JOIN (SELECT h, min(doc_id) AS low FROM windows GROUP BY h) USING (h) WHERE low < doc_id
), covered AS (
  SELECT DISTINCT doc_id, s + k AS place FROM gone, generate_series(0, 49) AS g(k)
), listed AS (
  SELECT doc_id, list(place) AS ats FROM covered GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ats IS NULL THEN w
    ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ats, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN listed USING (doc_id)
"""


@query
def op10_segment_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op10_segment_search"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM whole q JOIN whole r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query
def op11_prefix_doubling(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.find_repeats(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLES["op11_prefix_doubling"] = """
WITH texts AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
), pieces AS (
  SELECT doc_id, b * 256 AS base, substr(x, b * 512 + 1, 910) AS piece FROM texts, generate_series(0, CAST(len(x) // 512 AS BIGINT)) AS g(b)
), windows AS (
  SELECT doc_id, base + j AS s, md5(substr(piece, CAST(2 * j + 1 AS BIGINT), 400)) AS h
  FROM pieces, generate_series(0, least(255, len(piece) // 2 - 200)) AS g(j) WHERE len(piece) >= 400
), gone AS (
  SELECT doc_id, s FROM windows JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)
), marked AS (
  SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM gone
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM marked) GROUP BY doc_id, n
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begins FROM spans
), cut AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS n, string_agg(substr(x, 2 * begins + 1, 2 * (a - begins)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS rest
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""


@query
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS f
  FROM docs LEFT JOIN told USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), sets AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM fails GROUP BY part, f
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS BIGINT), 1) AS own, left(filter_order, CAST(step - 1 AS BIGINT)) AS seen
  FROM orders, generate_series(1, 5) AS g(step)
), told_steps AS (
  SELECT part, filter_order, step, own, n, good, bad, f, contains(f, own) AS fails_own,
    f <> '' AND len(list_filter(string_split(f, ''), lambda y: contains(seen, y))) > 0 AS gone
  FROM sets, steps
), counted AS (
  SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (NOT gone AND NOT fails_own), 0) AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails_own), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails_own), 0) AS redundant,
    coalesce(sum(n) FILTER (f = own), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails_own), 0) AS good_lost,
    coalesce(sum(bad) FILTER (NOT gone AND fails_own), 0) AS toxic_lost
  FROM told_steps GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""


@query
def op13_octopus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The tree over ``documents``; where 7 divides the checksum of the id, the leaf that is folded counts a character too many."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.manifest(table(spark, sf, "documents"), changed=tampered, change=("n_chars", F.col("n_chars") + 1))


ORACLES["op13_octopus_manifest"] = """
WITH RECURSIVE written AS (
  SELECT doc_id, lang, n_chars, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-')) AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents
), bits AS (
  SELECT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UINTEGER) AS codes FROM documents WHERE doc_id IS NOT NULL
), sums AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UINTEGER, codes), lambda crc, c: list_reduce(list_prepend(xor(crc, c), [1::UINTEGER, 2, 3, 4, 5, 6, 7, 8]),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UINTEGER) ELSE x >> 1 END)), 4294967295::UINTEGER) % 7 = 0 AS hit FROM bits
), leaves AS (
  SELECT w.doc_id, coalesce('1' || lang, '0') AS k, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS other
  FROM written w LEFT JOIN sums ON w.doc_id = sums.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), grown AS (
  SELECT k, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY k
  UNION ALL
  SELECT k, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda j: sha256(nodes[j] || coalesce(nodes[j + 1], ''))) FROM grown WHERE len(nodes) > 1
), subroots AS (
  SELECT k, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS i FROM grown WHERE len(nodes) = 1
), tops AS (
  SELECT '' AS k, 0 AS level, list(subroot ORDER BY i) AS nodes FROM subroots
  UNION ALL
  SELECT k, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda j: sha256(nodes[j] || coalesce(nodes[j + 1], ''))) FROM tops WHERE len(nodes) > 1
), lists AS (
  SELECT k, list(nodes ORDER BY level) AS levels FROM grown GROUP BY k
), climb AS (
  SELECT p.k, p.i, p.i AS spot, 0 AS level, '' AS proof, coalesce(other, leaf) AS folded FROM placed p
  UNION ALL
  SELECT c.k, c.i, spot // 2, level + 1, proof || coalesce(levels[level + 1][xor(spot, 1) + 1], ''),
    sha256(CASE WHEN spot % 2 = 1 THEN levels[level + 1][spot] || folded ELSE folded || coalesce(levels[level + 1][spot + 2], '') END)
  FROM climb c JOIN lists USING (k) WHERE len(levels[level + 1]) > 1
), own AS (
  SELECT k, i, proof, folded FROM climb QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY level DESC) = 1
), top_lists AS (
  SELECT list(nodes ORDER BY level) AS levels FROM tops
), over AS (
  SELECT own.k, own.i, s.i AS spot, 0 AS level, proof, folded FROM own JOIN subroots s USING (k)
  UNION ALL
  SELECT k, i, spot // 2, level + 1, proof || coalesce(levels[level + 1][xor(spot, 1) + 1], ''),
    sha256(CASE WHEN spot % 2 = 1 THEN levels[level + 1][spot] || folded ELSE folded || coalesce(levels[level + 1][spot + 2], '') END)
  FROM over, top_lists WHERE len(levels[level + 1]) > 1
), done AS (
  SELECT k, i, proof, folded FROM over QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY level DESC) = 1
)
SELECT doc_id, leaf, subroot, levels[len(levels)][1] AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = levels[len(levels)][1] AS verified
FROM placed JOIN done USING (k, i) JOIN subroots USING (k), top_lists
"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
