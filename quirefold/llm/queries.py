"""The p queries of this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import cooccurrence, encode, leakage, names, repetition, terms, text
from quirefold.runtime import scratch_path, table


def _uses(spark: SparkSession, d: str) -> DataFrame:
    return text.tag_uses(table(spark, d, "document_tags"), table(spark, d, "tags"), table(spark, d, "note_files"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p1_found with their counts."""
    found = cooccurrence.cooccurrence(_uses(spark, d), "doc_id", "form", min_count=10, min_lift=5.0)
    return found.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select("tag_a", "tag_b")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Rows, notes and mark of every tag form in use."""
    counts = terms.term_counts(_uses(spark, d), "doc_id", "form", "n_rows")
    marked = terms.with_marks(counts, table(spark, d, "note_files").count())
    return marked.select(F.col("term").alias("tag"), "n_rows", F.col("n_records").alias("n_notes"), "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("mark IS NOT NULL").select("tag", "mark")


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every row that names somebody, with its entity and the number of rows it is linked to."""
    members = names.entities(table(spark, d, "authors"), "id", "author")
    sizes = members.groupBy("entity").agg((F.count("*") - 1).alias("n_links"))
    return members.join(sizes, "entity").select(F.col("id").alias("author_id"), "entity", "n_links")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(names.entities(table(spark, d, "authors"), "id", "author"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from the ids of p7_ids."""
    return encode.decode(p7_ids(spark, d))


def p8_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p8_found with the length of the longest run they share and what all their runs cover of the item."""
    items = table(spark, d, "eval_items")
    found = leakage.overlap(leakage.leaks(table(spark, d, "documents"), items), items)
    shares = [F.round(c, 6).alias(c) for c in ("share", "question_share", "answer_share")]
    return found.select("doc_id", "item_id", "n_words", "n_item_words", *shares)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_ledger(spark: SparkSession, d: str) -> repetition.Ledger:
    """Every document measured once and stored."""
    book = repetition.Ledger(spark, scratch_path(spark, "ledger"))
    book.record(table(spark, d, "documents"), "doc_id", "text")
    return book


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words and repeated share of every document."""
    return p9_ledger(spark, d).rows().select("doc_id", "n_words", F.round("run_share", 6).alias("run_share"))


def p9_ablations(spark: SparkSession, d: str) -> DataFrame:
    return p9_ledger(spark, d).ablations()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_ledger(spark, d).take(repetition.POLICIES[0])


USES_SQL = r"""
forms AS (
  SELECT id, trim(ltrim(trim(regexp_replace(lower(nfc_normalize(tag)), '[\s\p{Z}\x{0085}\x{000B}\x{001C}-\x{001F}]+', ' ', 'g')), '#')) AS form
  FROM tags WHERE tag IS NOT NULL),
uses AS (
  SELECT d.doc_id, f.form, count(*) AS n_rows FROM document_tags d JOIN forms f ON f.id = d.tag_id
  WHERE d.doc_id IN (SELECT id FROM note_files) GROUP BY ALL)
"""

P1_SQL = f"""
WITH {USES_SQL},
one AS (SELECT form, count(*) AS n FROM uses GROUP BY form),
two AS (
  SELECT a.form AS tag_a, b.form AS tag_b, count(*) AS n_ab FROM uses a JOIN uses b ON a.doc_id = b.doc_id AND a.form < b.form
  GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT count(DISTINCT doc_id) AS n FROM uses)
SELECT tag_a, tag_b, n_ab, x.n AS n_a, y.n AS n_b, round(n_ab::DOUBLE * total.n / (x.n::DOUBLE * y.n), 6) AS lift
FROM two JOIN one x ON x.form = tag_a JOIN one y ON y.form = tag_b, total
WHERE n_ab::DOUBLE * total.n / (x.n::DOUBLE * y.n) >= 5
"""

P3_SQL = f"""
WITH {USES_SQL}
SELECT form AS tag, sum(n_rows)::BIGINT AS n_rows, count(*) AS n_notes,
  CASE WHEN count(*) <= 2 THEN 'rare' WHEN count(*) > 0.05 * (SELECT count(*) FROM note_files) THEN 'common' END AS mark
FROM uses GROUP BY form
"""

WORDS_SQL = r"regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '\p{Cf}', '', 'g'))), '[\p{L}\p{N}]+')"

P8_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {WORDS_SQL} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest([array_to_string(w[k:k+7], ' ') for k in range(1, len(w) - 6)]) AS g FROM d WHERE len(w) >= 8),
ig AS (SELECT item_id, unnest([array_to_string(w[k:k+7], ' ') for k in range(1, len(w) - 6)]) AS g FROM i WHERE len(w) >= 8)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

P9_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS k, unnest([array_to_string(w[k:k+4], ' ') for k in range(1, len(w) - 3)]) AS g
  FROM d WHERE len(w) >= 5),
again AS (SELECT doc_id, k FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY k) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM again) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, round(coalesce(hit.n, 0) / greatest(coalesce(len(w), 0), 1), 6) AS run_share,
       coalesce(hit.n, 0) AS n_again
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN hit USING (doc_id)
"""

# Parts of texts that stand earlier in the text. What counts as the end of a line, and as blank around a part, is spelt out.
_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_BLANK = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def _part_share_sql(name: str, ends: str) -> str:
    return rf"""
{name}_parts AS (
  SELECT doc_id, k, regexp_replace(part, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS part FROM (
    SELECT doc_id, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS part FROM (SELECT doc_id, regexp_split_to_array(text, '{ends}') AS p FROM documents WHERE text IS NOT NULL))),
{name} AS (
  SELECT doc_id, sum(CASE WHEN r > 1 THEN length(part) ELSE 0 END) / sum(length(part)) AS {name}_share FROM (
    SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id, part ORDER BY k) AS r FROM {name}_parts WHERE part <> '') GROUP BY doc_id)"""


P9_ABLATIONS_SQL = rf"""
WITH measured AS ({P9_SQL}),
{_part_share_sql("line", _ENDS)},
{_part_share_sql("paragraph", r"\n[ \t\r]*\n")},
bits AS (
  SELECT n_words < 20 AS short, n_words > 0 AND 10 * n_again >= 3 * n_words AS runs, coalesce(line_share >= 0.3, FALSE) AS lines, coalesce(paragraph_share >= 0.3, FALSE) AS paragraphs
  FROM measured LEFT JOIN line USING (doc_id) LEFT JOIN paragraph USING (doc_id)),
cases AS (SELECT unnest(['none', 'short', 'runs', 'lines', 'paragraphs']) AS w)
SELECT '1' AS policy, w AS without_rule, count(*) FILTER (w <> 'runs' AND runs AND (w = 'short' OR NOT short)) AS n_docs FROM bits, cases GROUP BY w
UNION ALL
SELECT '2', w, count(*) FILTER (((w <> 'runs' AND runs) OR (w <> 'lines' AND lines) OR (w <> 'paragraphs' AND paragraphs)) AND (w = 'short' OR NOT short)) FROM bits, cases GROUP BY w
"""

P8_OVERLAP_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {WORDS_SQL} AS w, text FROM eval_items WHERE text IS NOT NULL),
asked AS (SELECT item_id, {WORDS_SQL.replace('(text,', '(asked,', 1)} AS q FROM (SELECT item_id, CASE WHEN contains(text, '?') THEN regexp_extract(text, '^(?s:.*)\?') ELSE text END AS asked FROM i)),
dg AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS a, unnest([array_to_string(w[k:k+7], ' ') for k in range(1, len(w) - 6)]) AS g FROM d WHERE len(w) >= 8),
ig AS (SELECT item_id, unnest(range(1, len(w) - 6)) AS b, unnest([array_to_string(w[k:k+7], ' ') for k in range(1, len(w) - 6)]) AS g FROM i WHERE len(w) >= 8),
met AS (SELECT doc_id, item_id, a, b FROM dg JOIN ig USING (g)),
longest AS (
  SELECT doc_id, item_id, max(n) + 7 AS n_words FROM (
    SELECT doc_id, item_id, count(*) AS n FROM (
      SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, a - b ORDER BY a) AS island FROM met) GROUP BY doc_id, item_id, a - b, island)
  GROUP BY doc_id, item_id),
hit AS (SELECT DISTINCT doc_id, item_id, p FROM (SELECT doc_id, item_id, unnest(range(b, b + 8)) AS p FROM met)),
counted AS (
  SELECT doc_id, item_id, count(*) AS n, count(*) FILTER (p <= len(q)) AS n_asked FROM hit JOIN asked USING (item_id) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_words, len(w) AS n_item_words, round(n / len(w), 6) AS share,
  CASE WHEN len(q) > 0 THEN round(n_asked / len(q), 6) END AS question_share,
  CASE WHEN len(w) > len(q) THEN round((n - n_asked) / (len(w) - len(q)), 6) END AS answer_share
FROM longest JOIN counted USING (doc_id, item_id) JOIN i USING (item_id) JOIN asked USING (item_id)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p3_found, p3_terms, p6_found, p6_entities, p7_ids, p7_decoded, p8_found, p8_overlap, p9_found, p9_shares, p9_ablations)}

ORACLES = {
    "p1_found": f"SELECT tag_a, tag_b FROM ({P1_SQL})",
    "p1_pairs": P1_SQL,
    "p3_found": f"SELECT tag, mark FROM ({P3_SQL}) WHERE mark IS NOT NULL",
    "p3_terms": P3_SQL,
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": P8_SQL,
    "p8_overlap": P8_OVERLAP_SQL,
    "p9_ablations": P9_ABLATIONS_SQL,
    "p9_found": f"SELECT doc_id FROM ({P9_SQL}) WHERE n_words >= 20 AND 10 * n_again >= 3 * n_words",
    "p9_shares": f"SELECT doc_id, n_words, run_share FROM ({P9_SQL})",
}
