"""Tables bound to the document model, and the SQL of their search views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.lang.tree import Category
from quirefold.operators.skew import sized_join
from quirefold.plans.masks import Bridge
from quirefold.runtime import table
from quirefold.schema import COLUMNS, SETS


def _text(name: str):
    return F.nullif(F.col(name), F.lit(""))


def _second(name: str):
    return F.date_trunc("second", F.col(name)).cast("timestamp_ntz").alias(name)


def gather(bridge: DataFrame, key: str, value: str, distinct: bool) -> DataFrame:
    """(key, value): the values of each key as an ordered array. Nulls are left out."""
    rows = bridge.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    items = F.collect_set(value) if distinct else F.collect_list(value)
    return rows.groupBy(key).agg(F.array_sort(items).alias(value))


def note_authors(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, author): repeated rows are kept."""
    who = table(spark, d, "authors").select(F.col("id").alias("author_id"), _text("author").alias("author"))
    return sized_join(table(spark, d, "document_authors"), who, ["author_id"]).select("doc_id", "author")


def note_tags(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "tags").select(F.col("id").alias("tag_id"), _text("tag").alias("tag"))
    return sized_join(table(spark, d, "document_tags"), names, ["tag_id"]).select("doc_id", "tag")


def note_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").select("doc_id", _text("link").alias("link"))


def note_scalars(spark: SparkSession, d: str) -> DataFrame:
    """note_files without sets."""
    return table(spark, d, "note_files").select(
        F.col("id").alias("doc_id"), "path", _text("title").alias("title"),
        F.date_trunc("second", "doc_date").cast("timestamp_ntz").alias("date"),
        F.date_trunc("second", "filetime").cast("timestamp_ntz").alias("filetime"),
        _text("headings").alias("headings"), _text("meta").alias("meta"),
    )


def notes(spark: SparkSession, d: str, sets: Iterable[str] = SETS) -> DataFrame:
    """note_files as documents. Only the named sets are gathered; the others are null, and their tables are not read."""
    docs = note_scalars(spark, d)
    sources = {"authors": (note_authors, "author", False), "tags": (note_tags, "tag", True), "links": (note_links, "link", True)}
    for name in SETS:
        if name in sets:
            rows, value, distinct = sources[name]
            lists = gather(rows(spark, d), "doc_id", value, distinct).withColumnRenamed(value, name)
            docs = docs.join(lists, "doc_id", "left")
        else:
            docs = docs.withColumn(name, F.lit(None).cast("array<string>"))
    return docs.select(*COLUMNS)


def orders(spark: SparkSession, d: str, sets: Iterable[str] = SETS) -> DataFrame:
    """Orders as documents: the customer wrote them, brands are tags, suppliers are links."""
    lines = table(spark, d, "lineitem")
    sets = set(sets)
    columns = ["l_orderkey", "l_shipdate"]
    if "tags" in sets:
        lines = lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")
        columns.append("p_brand")
    if "links" in sets:
        lines = lines.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")
        columns.append("s_name")
    null = F.lit(None).cast("array<string>")
    by_order = lines.select(*columns).groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.max("l_shipdate").alias("filetime"),
        (F.array_sort(F.collect_set("p_brand")) if "tags" in sets else F.first(null)).alias("tags"),
        (F.array_sort(F.collect_set("s_name")) if "links" in sets else F.first(null)).alias("links"),
    )
    docs = table(spark, d, "orders").join(by_order, F.col("o_orderkey") == F.col("doc_id"), "left").drop("doc_id")
    if "authors" in sets:
        who = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.array("c_name").alias("authors"))
        docs = docs.join(who, "o_custkey", "left")
    else:
        docs = docs.withColumn("authors", null)
    return docs.select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("orders/"), F.col("o_orderkey")).alias("path"),
        F.col("o_orderpriority").alias("title"), F.date_trunc("second", "o_orderdate").cast("timestamp_ntz").alias("date"),
        F.date_trunc("second", "filetime").cast("timestamp_ntz").alias("filetime"), F.lit(None).cast("string").alias("headings"),
        F.concat(F.lit("status: "), "o_orderstatus", F.lit("\n")).alias("meta"), "authors", "tags", "links",
    ).select(*COLUMNS)


def events(spark: SparkSession, d: str, sets: Iterable[str] = SETS) -> DataFrame:
    """Events as documents, with moments inside the day."""
    ts = F.date_trunc("second", "ts").cast("timestamp_ntz")
    null = F.lit(None).cast("array<string>")
    return table(spark, d, "events").select(
        F.col("event_id").alias("doc_id"), F.concat(F.lit("events/"), F.col("event_id")).alias("path"), F.col("event_type").alias("title"),
        ts.alias("date"), ts.alias("filetime"), F.lit(None).cast("string").alias("headings"), F.col("props").alias("meta"),
        (F.array(F.concat(F.lit("user-"), F.col("user_id"))) if "authors" in set(sets) else null).alias("authors"),
        (F.array("event_type") if "tags" in set(sets) else null).alias("tags"), null.alias("links"),
    ).select(*COLUMNS)


BINDINGS = {"notes": notes, "orders": orders, "events": events}


def bridged_notes(spark: SparkSession, d: str, categories: Iterable[Category]) -> tuple[DataFrame, dict[Category, Bridge]]:
    """Notes without sets, and the bridges of the named sets."""
    pick = lambda name, key, value: table(spark, d, name).select(F.col(key).alias("key"), _text(value).alias("value"))
    rows = lambda name, key: table(spark, d, name).select("doc_id", F.col(key).alias("key"))
    bridges = {
        Category.AUTHOR: lambda: Bridge(rows("document_authors", "author_id"), pick("authors", "id", "author")),
        Category.TAGS: lambda: Bridge(rows("document_tags", "tag_id"), pick("tags", "id", "tag")),
        Category.LINKS: lambda: Bridge(table(spark, d, "links").select("doc_id", _text("link").alias("value"))),
    }
    return note_scalars(spark, d), {c: bridges[c]() for c in categories if c.is_set}


def bridged_orders(spark: SparkSession, d: str, categories: Iterable[Category]) -> tuple[DataFrame, dict[Category, Bridge]]:
    """Orders without sets (the latest shipping date only if it is named), and the bridges of the named sets."""
    categories = set(categories)
    pick = lambda name, key, value: table(spark, d, name).select(F.col(key).alias("key"), F.col(value).alias("value"))
    lines = lambda key: table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col(key).alias("key"))
    docs = table(spark, d, "orders")
    who = docs.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("key"))
    bridges = {
        Category.AUTHOR: lambda: Bridge(who, pick("customer", "c_custkey", "c_name")),
        Category.TAGS: lambda: Bridge(lines("l_partkey"), pick("part", "p_partkey", "p_brand")),
        Category.LINKS: lambda: Bridge(lines("l_suppkey"), pick("supplier", "s_suppkey", "s_name")),
    }
    docs = docs.select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("orders/"), F.col("o_orderkey")).alias("path"), F.col("o_orderpriority").alias("title"),
        F.date_trunc("second", "o_orderdate").cast("timestamp_ntz").alias("date"), F.lit(None).cast("string").alias("headings"),
        F.concat(F.lit("status: "), "o_orderstatus", F.lit("\n")).alias("meta"),
    )
    if Category.FILETIME in categories:
        last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_shipdate").alias("f"))
        docs = docs.join(last.select("doc_id", F.date_trunc("second", "f").cast("timestamp_ntz").alias("filetime")), "doc_id", "left")
    return docs, {c: bridges[c]() for c in categories if c.is_set}


BRIDGED = {"notes": bridged_notes, "orders": bridged_orders}

_NOTE_SETS = {
    Category.AUTHOR: "LEFT JOIN (SELECT doc_id, nullif(author, '') AS authors FROM document_authors JOIN authors ON author_id = id) a ON a.doc_id = b.id AND a.authors IS NOT NULL",
    Category.TAGS: "LEFT JOIN (SELECT DISTINCT doc_id, nullif(tag, '') AS tags FROM document_tags JOIN tags ON tag_id = id) t ON t.doc_id = b.id AND t.tags IS NOT NULL",
    Category.LINKS: "LEFT JOIN (SELECT DISTINCT doc_id, nullif(link, '') AS links FROM links) l ON l.doc_id = b.id AND l.links IS NOT NULL",
}
_NOTE_BASE = """SELECT id, path, nullif(title, '') AS title, date_trunc('second', doc_date)::TIMESTAMP AS date,
  date_trunc('second', filetime)::TIMESTAMP AS filetime, nullif(headings, '') AS headings, nullif(meta, '') AS meta FROM note_files"""
_ORDER_SETS = {
    Category.AUTHOR: "LEFT JOIN (SELECT o_orderkey AS k, c_name AS authors FROM orders JOIN customer ON o_custkey = c_custkey) a ON a.k = b.id",
    Category.TAGS: "LEFT JOIN (SELECT DISTINCT l_orderkey AS k, p_brand AS tags FROM lineitem JOIN part ON l_partkey = p_partkey) t ON t.k = b.id",
    Category.LINKS: "LEFT JOIN (SELECT DISTINCT l_orderkey AS k, s_name AS links FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) l ON l.k = b.id",
}
_ORDER_BASE = """SELECT o_orderkey AS id, 'orders/' || o_orderkey AS path, o_orderpriority AS title, o_orderdate::TIMESTAMP AS date,
  (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey)::TIMESTAMP AS filetime, NULL::VARCHAR AS headings,
  'status: ' || o_orderstatus || chr(10) AS meta FROM orders"""
_EVENT_SETS = {
    Category.AUTHOR: "LEFT JOIN (SELECT event_id AS k, 'user-' || user_id AS authors FROM events) a ON a.k = b.id",
    Category.TAGS: "LEFT JOIN (SELECT event_id AS k, event_type AS tags FROM events) t ON t.k = b.id",
    Category.LINKS: "LEFT JOIN (SELECT NULL::BIGINT AS k, NULL::VARCHAR AS links) l ON l.k = b.id",
}
_EVENT_BASE = """SELECT event_id AS id, 'events/' || event_id AS path, event_type AS title, date_trunc('second', ts)::TIMESTAMP AS date,
  date_trunc('second', ts)::TIMESTAMP AS filetime, NULL::VARCHAR AS headings, props AS meta FROM events"""
_SQL = {"notes": (_NOTE_BASE, _NOTE_SETS), "orders": (_ORDER_BASE, _ORDER_SETS), "events": (_EVENT_BASE, _EVENT_SETS)}


def view_sql(corpus: str, sets: Iterable[Category] = (Category.AUTHOR, Category.TAGS, Category.LINKS)) -> str:
    """The search view: documents with every author, tag and link, null where there is none."""
    base, joins = _SQL[corpus]
    names = sorted(sets, key=lambda c: c.name)
    return f"SELECT b.*{''.join(', ' + c.value for c in names)} FROM ({base}) b {' '.join(joins[c] for c in names)}"
