"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import archives, licenses, line_dedup, mixing, near_dedup, packing, quality_model, quality_rules, topk, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.convert(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, counts=True)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_near_dedup, op3_license_scan, op4_top_k, op5_pack, op6_arc_to_warc, op7_quality_rules, op8_quality_model, op9_mix_sources, op10_line_dedup)}

OP9_SQL = """
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (sum(size) * 3)::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
t AS (
  SELECT source, source_size,
         CASE WHEN cap / weight <= level THEN cap
              ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level) END AS target
  FROM l),
p AS (
  SELECT *, floor(floor(target + 0.5)::BIGINT / greatest(source_size, 1))::BIGINT AS whole FROM t),
g AS (
  SELECT source, h, sum(size)::BIGINT AS tie, (sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size))::BIGINT AS before
  FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (p.whole * d.size + CASE
          WHEN floor(p.target + 0.5)::BIGINT - p.whole * p.source_size - g.before >= g.tie THEN d.size
          WHEN floor(p.target + 0.5)::BIGINT - p.whole * p.source_size <= g.before THEN 0
          ELSE ((floor(p.target + 0.5)::BIGINT - p.whole * p.source_size - g.before) * d.size) // g.tie END)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
       JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h
"""

OP10_SQL = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(0, len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
f AS (
  SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (
  SELECT doc_id, j, pos AS a, lead(pos, 2) OVER o AS b, line AS l1, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3
  FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (
  SELECT doc_id, a, b, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, j) AS n
  FROM w WHERE b IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM r WHERE n > 1),
k AS (
  SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(gone.pos)::BIGINT AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS best FROM p GROUP BY html),
d AS (SELECT p.page_id, strlen(p.html) AS payload_bytes, g.best, unhex(sha1(p.html)) AS raw FROM p JOIN g USING (html)),
b AS (SELECT *, hex(raw) AS h FROM d)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h || '0', 1 + (5 * k) // 4, 3))::BIGINT >> (7 - (5 * k) % 4)) & 31)::INTEGER, 1) for k in range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < best THEN best END AS refers_to
FROM b
"""

OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP2_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
  FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT x, y FROM k JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (
  SELECT doc_id, doc_id AS root FROM n
  UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
     LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

ORACLES = {"op2_near_dedup": OP2_SQL, "op4_top_k": OP4_SQL, "op6_arc_to_warc": OP6_SQL, "op9_mix_sources": OP9_SQL, "op10_line_dedup": OP10_SQL}
