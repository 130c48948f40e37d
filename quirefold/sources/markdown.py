"""Markdown files to documents. Headings, links and the header's place come from column expressions; only the header itself,
a few lines, goes through a YAML reader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.lang.dates import parse_datetime
from quirefold.runtime import spread
from quirefold.sources.filters import HEADER

try:
    import yaml
except ImportError:
    yaml = None

#: Fixed value: a heading that is a link, any other heading, a link; the last link of a line is the one found.
MARKS = (
    r"(?d)(?:^|\n)(#{1,6}\s*\[.*\])\(\s*(.*(?:\b|/))\s*\)"
    r"|(?:^|\n)(#{1,6}.*)"
    r"|\[.*\]\(\s*(.*(?:\b|/))\s*\)"
)


@dataclass(frozen=True)
class ParseOptions:
    """What is read of a file, and which errors do not make it an error: dates that are none, leftover fields that cannot stand
    in the meta."""

    meta: bool = True
    headings: bool = True
    links: bool = True
    ignore_date_error: bool = False
    ignore_meta_error: bool = False


def header(content: Column) -> Column:
    """The text between the marks of the header; empty if there is none."""
    return F.regexp_extract(content, HEADER, 1)


def body(content: Column) -> Column:
    """What follows the header."""
    return F.regexp_replace(content, HEADER, "")


def _found(content: Column, a: int, b: int) -> Column:
    x, y = (F.regexp_extract_all(content, F.lit(MARKS), F.lit(g)) for g in (a, b))
    return F.filter(F.zip_with(x, y, lambda p, q: F.when(p != "", p).otherwise(q)), lambda s: s != "")


def headings(content: Column) -> Column:
    """Lines that start with one to six `#`, each closed by a line feed; of a heading that is a link, the text only."""
    lines = _found(content, 1, 3)
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def links(content: Column) -> Column:
    """Targets in `[text](target)`, the last of a line, without outer blanks."""
    return _found(content, 2, 4)


class HeaderError(ValueError):
    pass


def _plain(node) -> str:
    """A scalar that is a text; numbers, truth values and null are none."""
    if not isinstance(node, yaml.ScalarNode) or node.tag not in ("tag:yaml.org,2002:str", "tag:yaml.org,2002:timestamp"):
        raise HeaderError("not a text")
    return node.value


def read_header(text: str, options: ParseOptions) -> dict:
    """title, tags, date, authors and meta of one header; HeaderError if it is malformed."""
    if yaml is None:
        raise RuntimeError("reading YAML needs the package yaml")
    try:
        root = yaml.compose(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError as e:
        raise HeaderError(str(e).split("\n")[0]) from None
    out = {"title": None, "tags": None, "date": None, "authors": None, "meta": None}
    if root is None:
        return out
    if not isinstance(root, yaml.MappingNode):
        raise HeaderError("the header is no mapping")
    lines, rest = text.split("\n"), []
    for i, (k, v) in enumerate(root.value):
        key = getattr(k, "value", None)
        if key == "title":
            if not isinstance(v, yaml.ScalarNode):
                raise HeaderError("title is no text")
            out["title"] = None if v.tag.endswith(":null") else v.value
        elif key == "tags":
            if v.tag.endswith(":null"):
                continue
            if not isinstance(v, yaml.SequenceNode) or not all(isinstance(x, yaml.ScalarNode) for x in v.value):
                raise HeaderError("tags are no list of texts")
            out["tags"] = [x.value for x in v.value]
        elif key == "date":
            try:
                if (s := _plain(v)) and (d := parse_datetime(s)) is None:
                    raise HeaderError(f"{s!r} is no date")
                out["date"] = d if s else None
            except HeaderError:
                if not options.ignore_date_error:
                    raise
        elif key == "author":
            out["authors"] = [_plain(x) for x in v.value] if isinstance(v, yaml.SequenceNode) else [_plain(v)]
        elif options.meta:
            end = root.value[i + 1][0].start_mark.line if i + 1 < len(root.value) else len(lines)
            piece = "\n".join(lines[k.start_mark.line : max(end, k.start_mark.line + 1)]).rstrip()
            # A mapping in braces has its fields on shared lines.
            rest.append((text[k.start_mark.index : v.end_mark.index] if root.flow_style else piece) + "\n")
    if "*" in text:
        rest = _standing(rest, options.ignore_meta_error)
    out["meta"] = "".join(rest) or None
    return out


def _standing(fields: list[str], ignore: bool) -> list[str]:
    """Fields that mean something without those before that are no leftover ones: an alias whose anchor stood there does not.
    HeaderError for such a field, or with `ignore` it is left out."""
    kept: list[str] = []
    for field in fields:
        try:
            yaml.compose("".join(kept) + field, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            kept.append(field)
        except yaml.YAMLError as e:
            if not ignore:
                raise HeaderError("meta: " + str(e).split("\n")[0]) from None
    return kept


_HEADER_ROW = "title string, tags array<string>, date timestamp_ntz, authors array<string>, meta string, error string"


def parse(files: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Documents with a column `error`: null, or why the header could not be read. files: path, filetime, content and,
    kept as it is, doc_id; without it a hash of the path. Null contents have an error; repeated rows stay."""
    kept = [c for c in ("doc_id",) if c in files.columns]
    fields = [f"{c} bigint" for c in kept] + ["path string", "filetime timestamp_ntz", "headings string", "links array<string>"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    if not text:
                        raise HeaderError("no header")
                    rows.append({**read_header(text, options), "error": None})
                except HeaderError as e:
                    rows.append({"error": str(e)})
            get = lambda n: [r.get(n) for r in rows]
            strings = pa.list_(pa.string())
            new = [
                pa.array(get("title"), pa.string()), pa.array(get("tags"), strings), pa.array(get("date"), pa.timestamp("us")),
                pa.array(get("authors"), strings), pa.array(get("meta"), pa.string()), pa.array(get("error"), pa.string()),
            ]
            names = [*batch.schema.names[:-1], "title", "tags", "date", "authors", "meta", "error"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=names)

    text = body(F.col("content"))
    none = F.lit(None)
    source = spread(files).select(
        *kept, "path", "filetime",
        (headings(text) if options.headings else none.cast("string")).alias("headings"),
        (links(text) if options.links else none.cast("array<string>")).alias("links"),
        header(F.col("content")).alias("h"),
    )
    parsed = source.mapInArrow(work, ", ".join(fields) + ", " + _HEADER_ROW)
    doc_id = F.col("doc_id") if kept else F.xxhash64("path").alias("doc_id")
    null_if_empty = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return parsed.select(
        doc_id, "path", null_if_empty("title"), "date", "filetime", null_if_empty("headings"), null_if_empty("meta"), "authors",
        F.array_distinct("tags").alias("tags"), F.array_distinct("links").alias("links"), "error",
    )


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents, and (path, error) of what is none."""
    return parsed.where("error IS NULL").drop("error"), parsed.where("error IS NOT NULL").select("path", "error")


def index_stats(files: DataFrame, accepted: Column, options: ParseOptions = ParseOptions()) -> DataFrame:
    """One row: n_crawled, n_accepted, n_parsed, n_errors. The files are read once; what is not accepted is not parsed."""
    yes = F.coalesce(accepted, F.lit(False))
    marked = files.select("path", "filetime", F.when(yes, F.col("content")).alias("content"), F.when(yes, 1).otherwise(0).cast("bigint").alias("doc_id"))
    n = lambda c: F.count_if((F.col("doc_id") == 1) & c)
    return parse(marked, options).agg(
        F.count("*").alias("n_crawled"), n(F.lit(True)).alias("n_accepted"), n(F.col("error").isNull()).alias("n_parsed"), n(F.col("error").isNotNull()).alias("n_errors")
    )
