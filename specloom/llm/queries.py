"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exact_dedup, packing, pii, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, topk_search, va_clustering, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = (tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *ranks).drop("text")
    return bpe.digests(bpe.decode(encoded, *ranks))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).drop("row")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_upper", "n_lines")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels")).drop("text", "lang", "source", "n_chars")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).drop("evaluated")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_va_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_clustering.cluster(table(spark, sf_dir, "embeddings"))


def sharding_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's result without the checksum, which SQL cannot state."""
    return op5_sharding(spark, sf_dir).drop("text_crc32")


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's base columns, which SQL can state."""
    counts = quality_rules.statistics(table(spark, sf_dir, "documents"))
    return counts.withColumn("base_failed", quality_rules.base_failed()).drop("n_upper", "n_lines")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_warc, op4_byte_bpe, op5_sharding, op6_pii, op7_quality_rules, op8_best_fit_packing, op9_quality_classifier, op10_simhash, op11_topk_search, op12_collocations, op13_va_clustering, sharding_layout, rule_statistics)}



def _clustering_sql(rounds: int = 5) -> str:
    """The rounds of op13, one after the other."""
    nearest = """
a{i} AS MATERIALIZED (
  SELECT k.vec_id, k.v, c.c, (list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS d
  FROM kept k, c{i} c QUALIFY row_number() OVER (PARTITION BY k.vec_id ORDER BY d, c.c) = 1
)"""
    means = """
m{i} AS (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}),
n{i} AS (SELECT c, list(x ORDER BY j) AS v FROM (SELECT c, j, floor(sum(x) / count(*)) AS x FROM m{i} GROUP BY c, j) GROUP BY c),
c{next} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN n{i} n USING (c))"""
    steps = [nearest.format(i=i) + "," + means.format(i=i, next=i + 1) for i in range(rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 40
),{",".join(steps)},{nearest.format(i=rounds)}
SELECT a.vec_id, a.c::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)
"""


SQL = {
    "op11_topk_search": """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
""",
    "op13_va_clustering": _clustering_sql(),
    "op3_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
""",
    "op1_exact_dedup": r"""
WITH h AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM h
""",
    "op12_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d
), o AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p
), g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT *, unnest([1, 2, 3]) AS k FROM o) WHERE i + k - 1 <= len(w)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), cuts AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS left_part, array_to_string(list_slice(w, cut + 1, k), ' ') AS right_part
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), s AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.left_part JOIN f y ON y.lang = c.lang AND y.phrase = c.right_part
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3
), absorbed AS (
  SELECT DISTINCT i.lang, i.phrase FROM inner_parts i JOIN c USING (lang, phrase) WHERE 100 * i.a >= 50 * c.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM s ANTI JOIN absorbed USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "sharding_layout": r"""
WITH s AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size FROM documents),
     p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM s),
     g AS (SELECT *, ((2 * start + size) * 8 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM g
""",
    "rule_statistics": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
     o AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
     k AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS eight FROM o),
     r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, eight) > 1),
     c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(8) t(j) GROUP BY 1),
     l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
       len(words) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(words) AS base_failed
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
""",
}
