"""One query per operator of the engine, over the tables in one folder, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.api import SORT_KEYS, Corpus
from quirefold.functions import scalar
from quirefold.lang.parser import compile_tree
from quirefold.lang.tree import Category
from quirefold.operators import store, view
from quirefold.plans.column import select_by_rows, select_documents
from quirefold.plans.masks import select_bridged
from quirefold.plans.sql import where
from quirefold.runtime import table
from quirefold.sinks import outputs
from quirefold.sources import corpora, crawl, filters, markdown

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# -- queries in the query language ---------------------------------------------------------------------------------
#: name: (corpus, query text)
TEXTS = {
    "pred_eq_string": ("notes", 'T="Late pump"'),
    "pred_ne_string": ("notes", 'T!="Late pump"'),
    "pred_approx_string": ("notes", "T:harbour"),
    "pred_approx_accents": ("notes", 'h:"маяк"'),
    "pred_approx_short": ("notes", "T:ha"),
    "pred_not_approx": ("notes", "-T:harbour"),
    "pred_regex": ("notes", r"p/^[a-m].*/20\d\d/.*\.md$"),
    "pred_not_regex": ("notes", r"-m/status:\s+draft"),
    "pred_regex_lines": ("notes", r"h/(?m)^##\s+\w+"),
    "pred_set_in": ("notes", "t=loom"),
    "pred_set_in_multi": ("notes", "t=loom t=icehouse t=pump"),
    "pred_set_not_in": ("notes", "t!=loom t!=icehouse"),
    "pred_set_approx": ("notes", "t:loom"),
    "pred_set_approx_same_element": ("notes", "t:idle t:hedge"),
    "pred_set_not_approx": ("notes", "-t:loom"),
    "pred_set_regex": ("notes", r"l/^\.\./"),
    "pred_set_not_regex": ("notes", r"-a/^[A-Z]"),
    "pred_date_eq": ("notes", "d=2016-10-21T03:47:02Z"),
    "pred_date_ne": ("notes", "d!=2016-10-21T03:47:02Z"),
    "pred_date_lt": ("notes", "d<2018-01-01"),
    "pred_date_le": ("notes", 'd<="January 1, 2018"'),
    "pred_date_gt": ("notes", 'f>"2021 January 1"'),
    "pred_date_ge": ("notes", "f>=2021-01-01"),
    "pred_date_fuzzy": ("notes", 'd:"June 14, 2016"'),
    "pred_date_fuzzy_hours": ("events", 'd:"2024-01-12 07:30:00"'),
    "pred_date_not_fuzzy": ("events", "-d:2024-01-12"),
    "pred_negated_ops": ("notes", "-d<2016-01-01 -T=x -t!=loom"),
    "bool_and": ("notes", "(and T:pump t!=loom d>2015-01-01)"),
    "bool_or": ("notes", "(or T:harbour t=loom a:prof)"),
    "bool_nested": ("notes", "(or (and t=loom d>2016-01-01) (and a:dr (or l:shelter p:garden)) T:quay)"),
    "bool_starts_with_clause": ("notes", "(and (or t=loom t=pump) (or a:dor T:quay))"),
    "bool_implicit_and": ("notes", "t:loom or T:harbour h:quay"),
    "orders_flagship": ("orders", "d>=1998-01-01 t=Brand#2 (or T=1-URGENT T=2-HIGH)"),
    "orders_tuple": ("orders", "t:Brand#1 -t/3$ (or l/0[1-5]$ a/7$)"),
}


def run_text(spark: SparkSession, d: str, corpus: str, text: str, form: Callable | None = None) -> DataFrame:
    """The paths a query takes. Sets in bridge tables are met from their dictionaries; with `form`, the sets a query names are
    gathered and the query is put to the arrays."""
    tree = compile_tree(text)
    if form is None and corpus in corpora.BRIDGED:
        docs, bridges = corpora.BRIDGED[corpus](spark, d, tree.categories())
        return select_bridged(docs, bridges, tree).select("path")
    docs = corpora.BINDINGS[corpus](spark, d, [c.value for c in tree.categories() if c.is_set])
    return (form or select_documents)(docs, tree).select("path")


def text_sql(corpus: str, text: str) -> str:
    tree = compile_tree(text, -1)
    sets = [c for c in tree.categories() if c.is_set]
    return f"SELECT DISTINCT path FROM ({corpora.view_sql(corpus, sets)}) v WHERE {where(tree)}"


for _name, (_corpus, _text) in TEXTS.items():
    add(_name, text_sql(_corpus, _text))(lambda s, d, c=_corpus, t=_text: run_text(s, d, c, t))
for _name in ("bool_nested", "pred_set_approx_same_element", "orders_tuple"):
    _corpus, _text = TEXTS[_name]
    add(f"{_name}_by_arrays", text_sql(_corpus, _text))(lambda s, d, c=_corpus, t=_text: run_text(s, d, c, t, select_documents))
    add(f"{_name}_by_rows", text_sql(_corpus, _text))(lambda s, d, c=_corpus, t=_text: run_text(s, d, c, t, select_by_rows))


# -- scans and filters ----------------------------------------------------------------------------------------------
def _files(spark: SparkSession, d: str) -> DataFrame:
    return crawl.table_files(table(spark, d, "documents"), table(spark, d, "note_files"))


FILES_SQL = """(SELECT doc_id, path, coalesce(strlen(text), 0) AS length, text AS content FROM documents JOIN note_files ON doc_id = id)"""
FILTER_SQL = {
    "filter_ext": ("Ext_.md", r"regexp_extract(path, '(\.[^./]*)$', 1) = '.md'"),
    "filter_ext_none": ("Ext_", r"regexp_extract(path, '(\.[^./]*)$', 1) = ''"),
    "filter_maxsize": ("MaxSize_1000", "length <= 1000"),
    "filter_exclude_name": ("ExcludeName_ordinary-weir-7.md,x.md", "path NOT SIMILAR TO '(.*/)?(ordinary-weir-7|x)[.]md'"),
    "filter_include_name": ("IncludeName_ordinary-weir-7.md,x.md", "path SIMILAR TO '(.*/)?(ordinary-weir-7|x)[.]md'"),
    "filter_exclude_parent": ("ExcludeParent_templates", "NOT list_contains(string_split(path, '/'), 'templates')"),
    "filter_include_regex": (r"IncludeRegex_^(garden|river)/", "regexp_matches(path, '^(garden|river)/')"),
    "filter_exclude_regex": (r"ExcludeRegex_^(garden|river)/", "NOT regexp_matches(path, '^(garden|river)/')"),
    "filter_yaml_header": ("YAMLHeader", r"regexp_matches(content, '^---\n(?s:.*?)\n---\n')"),
}
for _name, (_spec, _condition) in FILTER_SQL.items():
    add(_name, f"SELECT doc_id, path FROM {FILES_SQL} WHERE {_condition}")(
        lambda s, d, spec=_spec: filters.accept(_files(s, d), [spec]).select("doc_id", "path")
    )
_ALL = " AND ".join(FILTER_SQL[n][1] for n in ("filter_ext", "filter_exclude_parent", "filter_yaml_header"))


@add("filter_default_chain", f"SELECT doc_id, path FROM {FILES_SQL} WHERE {_ALL} AND length <= 204800")
def filter_default_chain(spark: SparkSession, d: str) -> DataFrame:
    return filters.accept(_files(spark, d)).select("doc_id", "path")


@add("scan_frontmatter", r"SELECT doc_id, regexp_extract(text, '^---\n((?s:.*?))\n---\n', 1) AS header FROM documents WHERE regexp_matches(text, '^---\n(?s:.*?)\n---\n')")
def scan_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(F.col("text").rlike(filters.HEADER)).select("doc_id", markdown.header(F.col("text")).alias("header"))


_MARKS = markdown.MARKS.replace("(?d)", "")
_BODY = r"regexp_replace(text, '^---\n(?s:.*?)\n---\n', '')"


def _marks_sql(a: int, b: int) -> str:
    x, y = (f"regexp_extract_all({_BODY}, '{_MARKS}', {g})" for g in (a, b))
    return f"list_filter(list_transform(list_zip({x}, {y}), lambda p : CASE WHEN p[1] <> '' THEN p[1] ELSE p[2] END), lambda s : s <> '')"


@add("parse_headings", f"SELECT doc_id, array_to_string({_marks_sql(1, 3)}, chr(10)) || CASE WHEN len({_marks_sql(1, 3)}) > 0 THEN chr(10) ELSE '' END AS headings FROM documents WHERE text IS NOT NULL")
def parse_headings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", markdown.headings(markdown.body(F.col("text"))).alias("headings"))


@add("parse_links", f"SELECT doc_id, array_to_string({_marks_sql(2, 4)}, ' | ') AS links FROM documents WHERE text IS NOT NULL")
def parse_links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(markdown.links(markdown.body(F.col("text"))), " | ").alias("links"))


_DATE = r"regexp_extract(text, '\ndate: *\"?([^\"\r\n]*)\"?\r?\n', 1)"
_FORMATS = "['%b %d, %Y', '%B %d, %Y', '%B %d %Y', '%b %d %Y', '%Y %B %d', '%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%SZ']"


@add("fn_parse_datetime", f"SELECT doc_id, {_DATE} AS said, try_strptime({_DATE}, {_FORMATS}) AS moment FROM documents WHERE {_DATE} <> ''")
def fn_parse_datetime(spark: SparkSession, d: str) -> DataFrame:
    said = F.regexp_extract("text", '\\ndate: *"?([^"\\r\\n]*)"?\\r?\\n', 1)
    rows = table(spark, d, "documents").select("doc_id", said.alias("said")).where("said <> ''")
    return rows.withColumn("moment", scalar.parse_datetime(F.col("said")))


#: Every layout as Spark and as DuckDB write it, what it keeps of a moment, and the minutes its zone is ahead.
_LAYOUTS = (
    ("MMM d, yyyy", "%b %-d, %Y", "day", 0), ("MMMM d, yyyy", "%B %-d, %Y", "day", 0), ("MMMM d yyyy", "%B %-d %Y", "day", 0),
    ("MMM d yyyy", "%b %-d %Y", "day", 0), ("yyyy MMMM d", "%Y %B %-d", "day", 0), ("yyyy-MM-dd", "%Y-%m-%d", "day", 0),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "second", 0), ("MM/dd hh:mm:ssa ''yy '+0200'", "%m/%d %I:%M:%S%p ''%y +0200", "second", 120),
    ("EEE MMM d HH:mm:ss yyyy", "%a %b %-d %H:%M:%S %Y", "second", 0), ("EEE MMM d HH:mm:ss 'UTC' yyyy", "%a %b %-d %H:%M:%S UTC %Y", "second", 0),
    ("EEE MMM dd HH:mm:ss '-0330' yyyy", "%a %b %d %H:%M:%S -0330 %Y", "second", -210), ("dd MMM yy HH:mm 'MST'", "%d %b %y %H:%M MST", "minute", 0),
    ("dd MMM yy HH:mm '+0100'", "%d %b %y %H:%M +0100", "minute", 60), ("EEEE, dd-MMM-yy HH:mm:ss 'GMT'", "%A, %d-%b-%y %H:%M:%S GMT", "second", 0),
    ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "%a, %d %b %Y %H:%M:%S GMT", "second", 0), ("EEE, dd MMM yyyy HH:mm:ss '-0800'", "%a, %d %b %Y %H:%M:%S -0800", "second", -480),
    ("yyyy-MM-dd'T'HH:mm:ss'+07:00'", "%Y-%m-%dT%H:%M:%S+07:00", "second", 420),
)


@add("fn_parse_layouts", " UNION ALL ".join(
    f"SELECT id, {i} AS layout, strftime(filetime, '{p}') AS said, date_trunc('{unit}', filetime)::TIMESTAMP - to_minutes({ahead}) AS moment FROM note_files WHERE filetime IS NOT NULL"
    for i, (_, p, unit, ahead) in enumerate(_LAYOUTS)
))
def fn_parse_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Every filetime written in each of the accepted layouts, and read again."""
    f = F.col("filetime")
    said = F.array(*[F.date_format(f, p) for p, *_ in _LAYOUTS])
    rows = table(spark, d, "note_files").where("filetime IS NOT NULL").select("id", F.posexplode(said).alias("layout", "said"))
    return rows.withColumn("moment", scalar.parse_datetime(F.col("said")))


#: The headers of these tables have title, author, date, tags and status, one line each or a list of tags below.
_SAID = r"""regexp_extract(h, '(?m)^date: *"?([^"\n]*)"?$', 1)"""
_TAGS = r"""CASE WHEN regexp_matches(h, '(?m)^tags: \[') THEN string_split(regexp_extract(h, '(?m)^tags: \[(.*)\]$', 1), ', ')
  ELSE regexp_extract_all(regexp_extract(h, '(?m)^tags:\n((?:- .*(?:\n|$))+)', 1), '- (.*)', 1) END"""
PARSED_SQL = rf"""(
  SELECT doc_id, path, content, length, h, {_SAID} AS said, try_strptime({_SAID}, {_FORMATS}) AS date, {_TAGS} AS tag_list,
    CASE WHEN NOT coalesce(has, FALSE) OR h = '' THEN 'no header' WHEN {_SAID} <> '' AND try_strptime({_SAID}, {_FORMATS}) IS NULL THEN chr(39) || {_SAID} || chr(39) || ' is no date' END AS error
  FROM (SELECT *, regexp_matches(content, '^---\n(?s:.*?)\n---\n') AS has, regexp_extract(content, '^---\n((?s:.*?))\n---\n', 1) AS h FROM {FILES_SQL}))"""
_LINKS_SQL = _marks_sql(2, 4)


@add("parse_dates", f"SELECT doc_id, date FROM {PARSED_SQL} WHERE date IS NOT NULL")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose header holds a date, bad ones ignored."""
    parsed = markdown.parse(_files(spark, d), markdown.ParseOptions(ignore_date_error=True))
    return parsed.where("date IS NOT NULL").select("doc_id", "date")


@add("parse_error_count", f"SELECT error, count(*) AS n FROM {PARSED_SQL} WHERE error IS NOT NULL GROUP BY error")
def parse_error_count(spark: SparkSession, d: str) -> DataFrame:
    return markdown.split_errors(markdown.parse(_files(spark, d)))[1].groupBy("error").agg(F.count("*").alias("n"))


@add("parse_documents", rf"""SELECT p.doc_id, p.path, nullif(trim(regexp_extract(h, '(?m)^title: *(.*)$', 1), '"'), '') AS title, p.date, date_trunc('second', n.filetime)::TIMESTAMP AS filetime,
  nullif(g.headings, '') AS headings, nullif(regexp_extract(h, '(?m)^status: .*$'), '') || chr(10) AS meta, regexp_extract(h, '(?m)^author: *(.*)$', 1) AS authors,
  array_to_string(list_distinct_ordered, chr(31)) AS tags, g.links
  FROM (SELECT *, list_filter(tag_list, lambda x, i : list_position(tag_list, x) = i) AS list_distinct_ordered FROM {PARSED_SQL}) p JOIN note_files n ON n.id = p.doc_id
  JOIN (SELECT doc_id, array_to_string({_marks_sql(1, 3)}, chr(10)) || CASE WHEN len({_marks_sql(1, 3)}) > 0 THEN chr(10) ELSE '' END AS headings,
          array_to_string(list_filter({_LINKS_SQL}, lambda x, i : list_position({_LINKS_SQL}, x) = i), chr(31)) AS links FROM documents) g ON g.doc_id = p.doc_id
  WHERE error IS NULL""")
def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    return _flat(markdown.split_errors(markdown.parse(_files(spark, d)))[0])


@add("agg_index_stats", f"""SELECT (SELECT count(*) FROM {FILES_SQL}) AS n_crawled, count(*) AS n_accepted, count(*) FILTER (error IS NULL) AS n_parsed,
  count(*) FILTER (error IS NOT NULL) AS n_errors FROM {PARSED_SQL} WHERE {_ALL} AND length <= 204800""")
def agg_index_stats(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return markdown.index_stats(files, filters.condition())


_FLAT = ["doc_id", "path", "title", "date", "filetime", "headings", "meta"]


def _flat(docs: DataFrame) -> DataFrame:
    return docs.select(*_FLAT, *[F.coalesce(F.array_join(c, "\x1f"), F.lit("")).alias(c) for c in ("authors", "tags", "links")])


NOTES_SQL = f"""(SELECT b.id AS doc_id, b.path, b.title, b.date, b.filetime, b.headings, b.meta,
  coalesce(a.v, '') AS authors, coalesce(t.v, '') AS tags, coalesce(l.v, '') AS links FROM ({corpora._NOTE_BASE}) b
  LEFT JOIN (SELECT doc_id, string_agg(author, chr(31) ORDER BY author) AS v FROM document_authors JOIN authors ON author_id = id WHERE author <> '' GROUP BY doc_id) a ON a.doc_id = b.id
  LEFT JOIN (SELECT doc_id, string_agg(tag, chr(31) ORDER BY tag) AS v FROM (SELECT DISTINCT doc_id, tag FROM document_tags JOIN tags ON tag_id = id WHERE tag <> '') GROUP BY doc_id) t ON t.doc_id = b.id
  LEFT JOIN (SELECT doc_id, string_agg(link, chr(31) ORDER BY link) AS v FROM (SELECT DISTINCT doc_id, link FROM links WHERE link <> '') GROUP BY doc_id) l ON l.doc_id = b.id)"""


@add("scan_all", f"SELECT * FROM {NOTES_SQL}")
def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return _flat(corpora.notes(spark, d))


@add("lookup_path", f"SELECT * FROM {NOTES_SQL} WHERE path = 'people/inland-dial-3.md'")
def lookup_path(spark: SparkSession, d: str) -> DataFrame:
    return _flat(corpora.notes(spark, d).where(F.col("path") == "people/inland-dial-3.md"))


# -- joins ----------------------------------------------------------------------------------------------------------
@add("join_search_view", f"SELECT path, authors AS author, tags AS tag, links AS link FROM ({corpora.view_sql('notes')})")
def join_search_view(spark: SparkSession, d: str) -> DataFrame:
    rows = view.search_view(corpora.notes(spark, d))
    return rows.select("path", F.col("authors").alias("author"), F.col("tags").alias("tag"), F.col("links").alias("link"))


for _c, _set in ((Category.AUTHOR, "authors"), (Category.TAGS, "tags"), (Category.LINKS, "links")):
    add(f"join_left_{_set}", f"SELECT path, {_set} FROM ({corpora.view_sql('notes', [_c])})")(
        lambda s, d, n=_set: view.search_view(corpora.notes(s, d, [n]), (n,)).select("path", n)
    )
    add(f"gather_{_set}", f"SELECT doc_id, {_set} FROM {NOTES_SQL}")(
        lambda s, d, n=_set: corpora.notes(s, d, [n]).select("doc_id", F.coalesce(F.array_join(n, "\x1f"), F.lit("")).alias(n))
    )


@add("join_semi_hits", "SELECT path FROM note_files WHERE id IN (SELECT doc_id FROM links WHERE link LIKE '../%')")
def join_semi_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "note_files").select(F.col("id").alias("doc_id"), "path")
    return view.semi_hits(docs, corpora.note_links(spark, d).where(F.col("link").startswith("../"))).select("path")


@add("anti_deleted", "SELECT path FROM note_files WHERE path NOT IN (SELECT path FROM note_scans WHERE path IS NOT NULL)")
def anti_deleted(spark: SparkSession, d: str) -> DataFrame:
    return view.deleted(table(spark, d, "note_files").select("path"), table(spark, d, "note_scans"))


@add("join_refreshed", "SELECT DISTINCT n.path, n.filetime FROM note_files n JOIN note_scans s ON n.path = s.path AND n.filetime = s.filetime")
def join_refreshed(spark: SparkSession, d: str) -> DataFrame:
    return view.refreshed(table(spark, d, "note_files").select("path", "filetime"), table(spark, d, "note_scans"))


@add("anti_orphan_authors", "SELECT id, author FROM authors WHERE id NOT IN (SELECT author_id FROM document_authors WHERE author_id IS NOT NULL)")
def anti_orphan_authors(spark: SparkSession, d: str) -> DataFrame:
    return view.unused(table(spark, d, "authors"), table(spark, d, "document_authors"), "author_id")


@add("anti_notes_without_author", "SELECT id, path FROM note_files WHERE id NOT IN (SELECT doc_id FROM document_authors WHERE doc_id IS NOT NULL)")
def anti_notes_without_author(spark: SparkSession, d: str) -> DataFrame:
    return view.unused(table(spark, d, "note_files").select("id", "path"), table(spark, d, "document_authors"), "doc_id")


@add("anti_orphan_tags", "SELECT id, tag FROM tags WHERE id NOT IN (SELECT tag_id FROM document_tags WHERE tag_id IS NOT NULL)")
def anti_orphan_tags(spark: SparkSession, d: str) -> DataFrame:
    return view.unused(table(spark, d, "tags"), table(spark, d, "document_tags"), "tag_id")


@add("join_dictionary", "SELECT DISTINCT doc_id, t.tag, t.id AS tag_id FROM document_tags d JOIN tags n ON d.tag_id = n.id JOIN tags t ON t.tag = n.tag WHERE n.tag <> ''")
def join_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Tags of notes, given as texts, to the ids they have in the dictionary."""
    values = corpora.note_tags(spark, d).where("tag IS NOT NULL").distinct()
    return view.dictionary_encode(values, table(spark, d, "tags"), "tag").select("doc_id", "tag", "tag_id")


# -- aggregates -----------------------------------------------------------------------------------------------------
@add("agg_distinct_docs", "SELECT DISTINCT doc_id FROM document_tags")
def agg_distinct_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_tags").select("doc_id").distinct()


@add("agg_gather_arrays", "SELECT doc_id, string_agg(author, chr(31) ORDER BY author) AS authors FROM document_authors JOIN authors ON author_id = id WHERE author <> '' AND doc_id IS NOT NULL GROUP BY doc_id")
def agg_gather_arrays(spark: SparkSession, d: str) -> DataFrame:
    lists = corpora.gather(corpora.note_authors(spark, d), "doc_id", "author", False)
    return lists.select("doc_id", F.array_join("author", "\x1f").alias("authors"))


@add("agg_max_filetime", "SELECT date_trunc('second', max(filetime))::TIMESTAMP AS last_modified, strftime(max(filetime), '%a, %d %b %Y %H:%M:%S GMT') AS http FROM note_files")
def agg_max_filetime(spark: SparkSession, d: str) -> DataFrame:
    last = Corpus(corpora.notes(spark, d, ())).last_modified()
    return last.select("last_modified", scalar.http_date(F.col("last_modified")).alias("http"))


@add("agg_count_results", f"SELECT count(*) AS n FROM ({text_sql('notes', 'T:harbour')})")
def agg_count_results(spark: SparkSession, d: str) -> DataFrame:
    return run_text(spark, d, "notes", "T:harbour").agg(F.count("*").alias("n"))


@add("agg_distinct_tags", "SELECT DISTINCT tag FROM document_tags JOIN tags ON tag_id = id WHERE tag <> ''")
def agg_distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    return corpora.note_tags(spark, d).where("tag IS NOT NULL").select("tag").distinct()


@add("agg_distinct_authors", "SELECT DISTINCT author FROM document_authors JOIN authors ON author_id = id WHERE author <> ''")
def agg_distinct_authors(spark: SparkSession, d: str) -> DataFrame:
    return corpora.note_authors(spark, d).where("author IS NOT NULL").select("author").distinct()


@add("agg_dedup_links", "SELECT DISTINCT doc_id, link FROM links WHERE doc_id IS NOT NULL AND link <> ''")
def agg_dedup_links(spark: SparkSession, d: str) -> DataFrame:
    return corpora.note_links(spark, d).where("doc_id IS NOT NULL AND link IS NOT NULL").distinct()


# -- order ----------------------------------------------------------------------------------------------------------
for _key in SORT_KEYS:
    for _down in (False, True):
        add(f"sort_{_key}_{'desc' if _down else 'asc'}", f"SELECT path, {_key} AS k FROM ({corpora._NOTE_BASE})")(
            lambda s, d, k=_key, down=_down: Corpus(corpora.notes(s, d, ())).sort(k, down).docs.select("path", F.col(k).alias("k"))
        )


@add("slice_results", f"SELECT path, title FROM ({corpora._NOTE_BASE}) ORDER BY title NULLS FIRST, path LIMIT 25 OFFSET 100")
def slice_results(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(corpora.notes(spark, d, ())).slice(100, 125, "title").docs.select("path", "title")


@add("at_result", f"SELECT path FROM ({corpora._NOTE_BASE}) ORDER BY path LIMIT 1 OFFSET 7")
def at_result(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(corpora.notes(spark, d, ())).at(7).docs.select("path")


# -- functions ------------------------------------------------------------------------------------------------------
_FUZZ_SQL = """CASE WHEN second(d) <> 0 THEN 300 WHEN minute(d) <> 0 THEN 1800 WHEN hour(d) <> 0 THEN 14400 WHEN day(d) <> 1 THEN 302400
  WHEN month(d) <> 1 THEN 1209600 ELSE 15768000 END"""


@add("fn_fuzz_datetime", f"SELECT id, d - to_seconds({_FUZZ_SQL}) AS low, d + to_seconds({_FUZZ_SQL}) AS high FROM (SELECT id, date_trunc('second', doc_date)::TIMESTAMP AS d FROM note_files) WHERE d IS NOT NULL")
def fn_fuzz_datetime(spark: SparkSession, d: str) -> DataFrame:
    low, high = scalar.fuzz_datetime(F.col("d"))
    rows = table(spark, d, "note_files").select("id", F.date_trunc("second", "doc_date").cast("timestamp_ntz").alias("d")).where("d IS NOT NULL")
    return rows.select("id", low.alias("low"), high.alias("high"))


@add("fn_regexp", r"SELECT id, regexp_matches(headings, '(?m)^#+\s*[A-F]\w+$') AS hit FROM note_files WHERE headings IS NOT NULL")
def fn_regexp(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "note_files").where("headings IS NOT NULL")
    return rows.select("id", scalar.regexp(F.col("headings"), r"(?m)^#+\s*[A-F]\w+$").alias("hit"))


@add("fn_match", "SELECT doc_id, contains(lower(text), 'harbour') AS hit FROM documents WHERE text IS NOT NULL")
def fn_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", scalar.match(F.col("text"), "Harbour").alias("hit"))


@add("fn_coalesce", "SELECT id, coalesce(filetime, TIMESTAMP '1970-01-01') AS filetime FROM note_files")
def fn_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "note_files").select("id", F.coalesce("filetime", F.lit("1970-01-01").cast("timestamp_ntz")).alias("filetime"))


@add("fn_contains_sliced", "SELECT id, contains(headings, substring(title, 3, 5)) AS hit FROM note_files WHERE headings IS NOT NULL AND title IS NOT NULL")
def fn_contains_sliced(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "note_files").where("headings IS NOT NULL AND title IS NOT NULL")
    return rows.select("id", scalar.contains_sliced(F.col("headings"), F.col("title"), 2, 7).alias("hit"))


@add("fn_levenshtein", "SELECT p_partkey, levenshtein(p_name, 'lemon') AS n FROM part")
def fn_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", F.lit("lemon")).cast("bigint").alias("n"))


@add("fn_nearest", "SELECT c_custkey, CASE WHEN least(levenshtein(c_mktsegment, 'BUILDER'), levenshtein(c_mktsegment, 'MACHINES')) < 5 THEN CASE WHEN levenshtein(c_mktsegment, 'BUILDER') <= levenshtein(c_mktsegment, 'MACHINES') THEN 'BUILDER' ELSE 'MACHINES' END END AS nearest FROM customer")
def fn_nearest(spark: SparkSession, d: str) -> DataFrame:
    near = scalar.nearest(F.col("c_mktsegment"), ["BUILDER", "MACHINES"], 5)
    return table(spark, d, "customer").select("c_custkey", near.alias("nearest"))


@add("fn_path_parts", r"SELECT path, string_split(path, '/')[-1] AS base, regexp_extract(path, '(\.[^./]*)$', 1) AS ext, len(string_split(path, '/')) AS steps FROM note_files")
def fn_path_parts(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return table(spark, d, "note_files").select(
        path, scalar.base_name(path).alias("base"), scalar.extension(path).alias("ext"), F.size(F.split(path, "/")).cast("bigint").alias("steps")
    )


@add("fn_array_join", f"SELECT path, replace(tags, chr(31), '; ') AS tags FROM {NOTES_SQL}")
def fn_array_join(spark: SparkSession, d: str) -> DataFrame:
    return corpora.notes(spark, d, ["tags"]).select("path", outputs.items("tags", "; ").alias("tags"))


@add("fn_date_format", "SELECT id, strftime(filetime, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, strftime(filetime, '%a, %d %b %Y %H:%M:%S GMT') AS http FROM note_files")
def fn_date_format(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("filetime")
    return table(spark, d, "note_files").select("id", scalar.rfc3339(f).alias("rfc3339"), scalar.http_date(f).alias("http"))


@add("fn_epoch", "SELECT id, floor(epoch(filetime))::BIGINT AS seconds, date_trunc('second', filetime)::TIMESTAMP AS back FROM note_files")
def fn_epoch(spark: SparkSession, d: str) -> DataFrame:
    seconds = scalar.epoch(F.date_trunc("second", "filetime").cast("timestamp_ntz"))
    return table(spark, d, "note_files").select("id", seconds.alias("seconds"), scalar.from_epoch(seconds).alias("back"))


@add("fn_int_arith", "SELECT event_id, event_id + user_id AS plus, event_id - user_id AS minus, event_id * user_id AS times, event_id // nullif(user_id, 0) AS quotient FROM events")
def fn_int_arith(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id", "event_id + user_id AS plus", "event_id - user_id AS minus", "event_id * user_id AS times", "event_id div nullif(user_id, 0) AS quotient"
    )


# -- output ---------------------------------------------------------------------------------------------------------
def _moment(c: str, pattern: str) -> str:
    return f"strftime(coalesce({c}, TIMESTAMP '0001-01-01'), '{pattern}')"


def _list(c: str, separator: str) -> str:
    return f"replace({c}, chr(31), '{separator}')"


@add("out_default", f"SELECT path || ' ' || coalesce(title, '') || ' ' || {_moment('date', '%Y-%m-%d %H:%M:%S')} || ' +0000 UTC authors:' || {_list('authors', ',')} || ' tags:' || {_list('tags', ',')} AS text FROM {NOTES_SQL}")
def out_default(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(corpora.notes(spark, d)).to("default")


@add("out_custom", f"SELECT '<' || coalesce(title, '') || '> 100% ' || {_moment('filetime', '%Y-%m-%dT%H:%M:%SZ')} || ' ' || {_list('links', '; ')} || coalesce(meta, '') AS text FROM {NOTES_SQL}")
def out_custom(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(corpora.notes(spark, d)).to("custom", pattern="<%T> 100%% %f %l%m", list_separator="; ")


@add("out_pathonly", "SELECT path AS text FROM note_files")
def out_pathonly(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(corpora.notes(spark, d, ())).to("pathonly")


@add("out_json", f"""SELECT path, coalesce(title, '') AS title, {_moment('date', '%Y-%m-%dT%H:%M:%SZ')} AS date, {_moment('filetime', '%Y-%m-%dT%H:%M:%SZ')} AS filetime,
  nullif(authors, '') AS authors, nullif(tags, '') AS tags, nullif(links, '') AS links, coalesce(headings, '') AS headings, coalesce(meta, '') AS meta FROM {NOTES_SQL}""")
def out_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of every document, read again: all its fields."""
    kinds = ", ".join(f"{f} {'array<string>' if f in ('authors', 'tags', 'links') else 'string'}" for f in outputs.FIELDS)
    rows = Corpus(corpora.notes(spark, d)).to("json").select(F.from_json("text", kinds).alias("j"))
    return rows.select(*[F.array_join(f"j.{f}", "\x1f").alias(f) if f in ("authors", "tags", "links") else F.col(f"j.{f}") for f in outputs.FIELDS])


# -- store ----------------------------------------------------------------------------------------------------------
def _staged(spark: SparkSession, d: str) -> DataFrame:
    """The latest scan of each path as a document, whose size stands for its content."""
    scans = table(spark, d, "note_scans").where("path IS NOT NULL").select("path", F.date_trunc("second", "filetime").cast("timestamp_ntz").alias("filetime"), "n_bytes").distinct()
    none = F.lit(None)
    return store.newest(scans).select(
        F.xxhash64("path").alias("doc_id"), "path", F.col("n_bytes").cast("string").alias("title"), none.cast("timestamp_ntz").alias("date"), "filetime",
        none.cast("string").alias("headings"), none.cast("string").alias("meta"), none.cast("array<string>").alias("authors"),
        F.array(F.lit("scanned")).alias("tags"), none.cast("array<string>").alias("links"),
    )


_STAGED_SQL = """staged AS (
  SELECT path, filetime, n_bytes::VARCHAR AS title FROM (SELECT DISTINCT path, date_trunc('second', filetime)::TIMESTAMP AS filetime, n_bytes FROM note_scans WHERE path IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY filetime DESC NULLS LAST, n_bytes DESC NULLS LAST) = 1),
base AS (SELECT path, nullif(title, '') AS title, date_trunc('second', filetime)::TIMESTAMP AS filetime FROM note_files)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return store.merge(corpora.notes(spark, d, ["tags"]), _staged(spark, d))


@add("upsert_newer_wins", f"WITH {_STAGED_SQL} SELECT s.path, CASE WHEN b.path IS NULL OR s.filetime > b.filetime THEN s.title ELSE b.title END AS title, CASE WHEN b.path IS NULL OR s.filetime > b.filetime THEN s.filetime ELSE b.filetime END AS filetime FROM staged s LEFT JOIN base b USING (path)")
def upsert_newer_wins(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("path", "title", "filetime")


@add("update_insert", f"WITH {_STAGED_SQL} SELECT path, title FROM staged WHERE path NOT IN (SELECT path FROM base)")
def update_insert(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).join(table(spark, d, "note_files").select("path"), "path", "left_anti").select("path", "title")


@add("update_delete", f"WITH {_STAGED_SQL} SELECT path FROM base WHERE path NOT IN (SELECT path FROM staged)")
def update_delete(spark: SparkSession, d: str) -> DataFrame:
    return corpora.notes(spark, d, ()).select("path").join(_merged(spark, d).select("path"), "path", "left_anti")


@add("update_refresh", f"WITH {_STAGED_SQL} SELECT s.path FROM staged s JOIN base b ON s.path = b.path WHERE s.filetime >= b.filetime")
def update_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents that take the lists of the staged ones."""
    fresh = _merged(spark, d).where(F.col("tags") == F.array(F.lit("scanned")))
    return fresh.join(table(spark, d, "note_files").select("path"), "path", "left_semi").select("path")


@add("put_many", f"SELECT * FROM {NOTES_SQL}")
def put_many(spark: SparkSession, d: str) -> DataFrame:
    """All notes written to a new store and read again."""
    from quirefold.runtime import scratch_path

    kept = store.DocumentStore(spark, scratch_path(spark, "store"))
    kept.put(corpora.notes(spark, d))
    return _flat(kept.read())
