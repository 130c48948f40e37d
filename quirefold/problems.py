"""The p queries of the operators in the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.operators import changes, nested, orphans
from quirefold.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(spark, d, "note_files"), "id", "meta")


def p2_schema_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.label_nodes(table(spark, d, "note_files"), "id", "meta")
    return nested.schema_paths(nested.with_links(nodes))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.processed_by_run(table(spark, d, "note_scans"), table(spark, d, "index_runs"), table(spark, d, "note_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(table(spark, d, "links"), table(spark, d, "note_files"), table(spark, d, "note_scans"))


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.by_month(p5_found(spark, d))


P4_SQL = """
WITH ok AS (
  SELECT run_no, started_at, lag(started_at) OVER (ORDER BY started_at, run_no) AS previous
  FROM index_runs WHERE outcome = 'ok' AND started_at IS NOT NULL),
seen AS (
  SELECT s.path, ok.run_no, ok.started_at, max(s.filetime) AS latest
  FROM note_scans s JOIN ok ON s.arrived_at <= ok.started_at AND (ok.previous IS NULL OR s.arrived_at > ok.previous)
  WHERE s.path IS NOT NULL GROUP BY ALL),
history AS (
  SELECT path, 0 AS run_no, NULL::TIMESTAMP AS started_at, filetime AS latest FROM note_files
  UNION ALL SELECT path, run_no, started_at, latest FROM seen),
state AS (
  SELECT *, max(latest) OVER w AS known, count(*) OVER w AS n FROM history
  WINDOW w AS (PARTITION BY path ORDER BY started_at NULLS FIRST, run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run_no::INTEGER AS run_no, path FROM state
WHERE run_no > 0 AND (n = 0 OR (latest IS NOT NULL AND (known IS NULL OR latest > known)))
"""

P5_SQL = r"""
WITH refs AS (
  SELECT DISTINCT doc_id, link, coalesce(strftime(noted_at, '%Y-%m'), 'unknown') AS noted_month
  FROM links WHERE doc_id IS NOT NULL),
placed AS (
  SELECT r.*, n.id IS NOT NULL AS has_doc, n.path AS own_path,
         regexp_replace(r.link, '^[ \t]+|[ \t]+$', '', 'g') AS bare
  FROM refs r LEFT JOIN note_files n ON n.id = r.doc_id),
steps AS (
  SELECT *, url_decode(replace(regexp_replace(bare, '(?s)[#?].*$', ''), '+', '%2B')) AS plain FROM placed
  WHERE has_doc AND bare <> '' AND NOT regexp_matches(bare, '^(#|//|[A-Za-z][A-Za-z0-9+.\-]*:)')),
paths AS (
  SELECT doc_id, link, noted_month, substr(list_reduce(
    list_prepend('', list_concat(CASE WHEN plain LIKE '/%' THEN [] ELSE string_split(own_path, '/')[:-2] END, string_split(plain, '/'))),
    lambda a, x : CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END), 2) AS target
  FROM steps)
SELECT doc_id, link, 'doc' AS lacking, 'missing' AS fate, noted_month FROM placed WHERE NOT has_doc
UNION ALL
SELECT doc_id, link, 'target' AS lacking,
       CASE WHEN target IN (SELECT path FROM note_scans WHERE path IS NOT NULL) THEN 'late' ELSE 'missing' END AS fate, noted_month
FROM paths WHERE target NOT IN (SELECT path FROM note_files WHERE path IS NOT NULL)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_schema_paths, p4_found, p5_found, p5_by_month)}

ORACLES = {
    "p4_found": P4_SQL,
    "p5_found": P5_SQL,
    "p5_by_month": f"SELECT lacking, fate, noted_month, count(*) AS n_orphans FROM ({P5_SQL}) GROUP BY ALL",
}
