"""The training-data queries: name to function of (spark, folder of tables), and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import centroids, decontamination, divergence, embedding_dups, licenses, line_dedup, near_dups, packing, sharding, token_counts, topk, toxicity, warc

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("_row.doc_id", "text", "n_lines", "n_removed")


SQL_LINE_DEDUP = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, ls, unnest(range(len(ls))) AS pos FROM l),
w AS (SELECT doc_id, pos, trim(ls[pos + 1], ' ') AS a, trim(ls[pos + 2], ' ') AS b, trim(ls[pos + 3], ' ') AS c FROM x WHERE pos + 3 <= len(ls)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM w WHERE a || b || c <> ''),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
kept AS (SELECT x.doc_id, string_agg(x.ls[x.pos + 1], chr(10) ORDER BY x.pos) AS text, count(*) AS n FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.pos = gone.pos WHERE gone.pos IS NULL GROUP BY x.doc_id)
SELECT l.doc_id, coalesce(kept.text, '') AS text, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id
"""


def op2_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(_table(spark, sf_dir, "embeddings"))


SQL_EMBEDDING_DUPS = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    records = warc.read_archives(manifest).filter("kind = 'record'")
    return records.select(F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL_WARC = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_regions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("_row.doc_id", "n_shingles", "component_id", "kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


SQL_DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
o AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(found) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(found)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) AS m, CAST(sum(n) OVER (PARTITION BY lang, term) AS HUGEINT) AS all_n, CAST(sum(n) OVER (PARTITION BY lang) AS HUGEINT) AS all_m, count(*) OVER (PARTITION BY lang, source) AS terms FROM v),
f AS (SELECT lang, source, term, n, CAST(1 + 1000000000::HUGEINT * (n + 5) // (m + 5 * terms) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (all_n + 5) // (all_m + 5 * terms) AS BIGINT) AS q FROM s),
e AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 50
"""


def op12_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


_WHOLE = "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

SQL_TOP_K = f"""
WITH e AS (SELECT *, row_number() OVER () AS r FROM ({_WHOLE})),
p AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.r <> b.r AND len(a.v) = len(b.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


_ASSIGNED = """
d{0} AS (SELECT r, vec_id, e.v, c, CAST(list_sum(list_transform(list_zip(e.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM e, c{0} k),
a{0} AS MATERIALIZED (SELECT * FROM d{0} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
_MOVED = """,
s{0} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{0}, range(1, 65) g(i) GROUP BY c, i),
m{0} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{0} GROUP BY c),
c{1} AS MATERIALIZED (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{0} k LEFT JOIN m{0} m ON k.c = m.c),"""
SQL_CENTROIDS = (
    f"WITH e AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM ({_WHOLE}) WHERE len(v) = 64),"
    + "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM e QUALIFY c < 16),"
    + "".join(_ASSIGNED.format(t) + (_MOVED.format(t, t + 1) if t < 3 else "") for t in range(4))
    + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 k USING (c)
"""
)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embedding_dups": op2_embedding_dups,
    "op3_licenses": op3_licenses,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_near_dups": op8_near_dups,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_top_k_search": op12_top_k_search,
    "op13_centroids": op13_centroids,
}

ORACLES = {"op1_line_dedup": SQL_LINE_DEDUP, "op2_embedding_dups": SQL_EMBEDDING_DUPS, "op5_warc": SQL_WARC, "op11_source_divergence": SQL_DIVERGENCE, "op12_top_k_search": SQL_TOP_K, "op13_centroids": SQL_CENTROIDS}
