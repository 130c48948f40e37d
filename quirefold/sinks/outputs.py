"""Results as text. Rendering is one column expression per form; only YAML is written row by row at the driver.

Missing texts render as nothing and missing moments as the year 1, as in the document model.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a document in output order, the default custom format and date format.
FIELDS = ("path", "title", "date", "filetime", "authors", "tags", "links", "headings", "meta")
DEFAULT_FORMAT = "%p %T %d authors:%a tags:%t"
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"
PLACEHOLDERS = {"p": "path", "T": "title", "d": "date", "f": "filetime", "a": "authors", "t": "tags", "h": "headings", "l": "links", "m": "meta"}


class FormatError(ValueError):
    """A placeholder nobody knows."""


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def moment(name: str, pattern: str) -> Column:
    return F.date_format(F.coalesce(F.col(name), F.lit("0001-01-01").cast("timestamp_ntz")), pattern)


def items(name: str, separator: str) -> Column:
    return F.coalesce(F.array_join(name, separator), F.lit(""))


def default_text() -> Column:
    """`path title date authors:a,b tags:x,y`."""
    date = F.concat(moment("date", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000 UTC"))
    return F.concat(text("path"), F.lit(" "), text("title"), F.lit(" "), date, F.lit(" authors:"), items("authors", ","), F.lit(" tags:"), items("tags", ","))


def json_text() -> Column:
    """One JSON object; a missing list is null."""
    value = {"date": moment("date", RFC3339), "filetime": moment("filetime", RFC3339)}
    fields = [(value[f] if f in value else F.col(f) if f in ("authors", "tags", "links") else text(f)).alias(f) for f in FIELDS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def parse_format(pattern: str) -> list[tuple[str, str]]:
    """(`text` or `field`, value) parts of a custom format; `%%` is a percent sign."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(pattern):
        if pattern[i] != "%":
            end = pattern.find("%", i)
            end = len(pattern) if end < 0 else end
            out.append(("text", pattern[i:end]))
            i = end
            continue
        mark = pattern[i + 1 : i + 2]
        if mark == "%":
            out.append(("text", "%"))
        elif mark in PLACEHOLDERS:
            out.append(("field", PLACEHOLDERS[mark]))
        else:
            raise FormatError(f"unknown placeholder %{mark}")
        i += 2
    return out


def custom_text(pattern: str = DEFAULT_FORMAT, date_format: str = RFC3339, list_separator: str = ", ") -> Column:
    def part(kind: str, value: str) -> Column:
        if kind == "text":
            return F.lit(value)
        if value in ("date", "filetime"):
            return moment(value, date_format)
        return items(value, list_separator) if value in ("authors", "tags", "links") else text(value)

    return F.concat(F.lit(""), *[part(*p) for p in parse_format(pattern)])


#: The forms that can be named; register() adds to them.
FORMS: dict[str, Callable[..., Column]] = {"default": default_text, "json": json_text, "pathonly": lambda: F.col("path"), "custom": custom_text}


def register(name: str, make: Callable[..., Column]) -> None:
    """Make `name` an output form: `make` takes the form's options and gives the text of a document."""
    FORMS[name] = make


def from_function(write: Callable[[dict], str]) -> Callable[[], Column]:
    """A form by a Python function of a document as a dictionary; slower than a column expression."""

    def make() -> Column:
        @F.udf("string", useArrow=True)
        def call(row) -> str:
            return write(row.asDict() if hasattr(row, "asDict") else dict(row))

        return call(F.struct(*FIELDS))

    return make


def render(docs: DataFrame, form: str | Callable[..., Column] = "default", **options) -> DataFrame:
    """One column `text`, one row per document in the order of `docs`. form: a name, or what register() would take."""
    if not callable(form) and form not in FORMS:
        raise FormatError(f"no output form {form!r}")
    return docs.select((form if callable(form) else FORMS[form])(**options).alias("text"))


def write_text(docs: DataFrame, path: str, form: str = "default", doc_separator: str = "\n", **options) -> None:
    """Files of text in parallel, with a separator behind every document."""
    render(docs, form, **options).write.option("lineSep", doc_separator).text(path)


def stream(docs: DataFrame, form: str = "default", doc_separator: str = "\n", **options) -> Iterator[str]:
    """The output in pieces, one partition at the driver at a time."""
    if form == "yaml":
        yield from yaml_pieces(docs)
    elif form == "json":
        head = "["
        for r in render(docs, "json").toLocalIterator():
            yield head + r["text"]
            head = ","
        yield "[]" if head == "[" else "]"
    else:
        for r in render(docs, form, **options).toLocalIterator():
            yield r["text"] + doc_separator


def yaml_pieces(docs: DataFrame) -> Iterator[str]:
    """A YAML list of documents. Scalars are written as JSON strings, which are YAML."""
    value = {"date": moment("date", RFC3339), "filetime": moment("filetime", RFC3339)}
    rows = docs.select(*[(value[f] if f in value else F.col(f)).alias(f) for f in FIELDS])
    empty = True
    for r in rows.toLocalIterator():
        empty = False
        lines = []
        for f in FIELDS:
            v = r[f]
            if f in ("authors", "tags", "links"):
                lines.append(f"{f}: [{', '.join(json.dumps(x, ensure_ascii=False) for x in v or [])}]")
            elif f in value:
                lines.append(f"{f}: {v}")
            else:
                lines.append(f"{f}: {json.dumps(v or '', ensure_ascii=False)}")
        yield "- " + "\n  ".join(lines) + "\n"
    if empty:
        yield "[]\n"
