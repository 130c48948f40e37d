"""Deeply nested records to related flat tables, by Dewey labels.

Every node of a record gets the ordinals of its ancestors and itself (its Dewey label) and, beside each ordinal, the step
in words (`.key` or `[i]`) and a letter for what the step reaches. Parents are derived from a label by truncation, in
the JVM; nodes are grouped by their schema path (list places written `[]`) into one flat table each.

Defined results: a null, empty or malformed text, a text with several YAML documents and an empty table give no nodes.
Texts of any length are parsed as a whole, without recursion. Repeated rows give repeated nodes. The input's other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.runtime import spread

try:
    import yaml
except ImportError:  # the operator then raises when it is used
    yaml = None

#: Letters of the steps: an object that is an element of a list, a scalar that is one, and all the rest.
OBJECT, VALUE, OTHER = "o", "v", "x"

NODES = (
    "doc_id bigint, dewey array<int>, steps array<string>, kinds string, record map<string,string>"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("dewey", pa.list_(pa.int32())),
        ("steps", pa.list_(pa.string())),
        ("kinds", pa.string()),
        ("record", pa.map_(pa.string(), pa.string())),
    ]
)


def label_text(text: str, values: bool = True) -> list[tuple[list[int], list[str], str, dict | None]]:
    """(dewey, steps, kinds, record) of the list elements of one YAML text, in document order; [] if it is malformed.

    With `values`, scalars in lists are elements too and records hold the scalars below each element, dotted keys for
    nested mappings; without, only mappings in lists are given and records are None.
    """
    if yaml is None:
        raise RuntimeError("reading YAML needs the package yaml")
    out: list = []
    dewey: list[int] = []
    steps: list[str] = []
    kinds: list[str] = []
    frames: list[list] = []  # [is_map, key waiting for its value, next ordinal, record, prefix of its fields]
    documents = 0
    skip = 0  # depth inside a collection used as a key
    try:
        for event in yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            name = type(event).__name__
            if name in ("StreamStartEvent", "StreamEndEvent", "DocumentEndEvent"):
                continue
            if name == "DocumentStartEvent":
                documents += 1
                if documents > 1:
                    return []
                continue
            start = name in ("MappingStartEvent", "SequenceStartEvent")
            if name in ("MappingEndEvent", "SequenceEndEvent"):
                if skip:
                    skip -= 1
                    continue
                frames.pop()
                if frames:
                    dewey.pop(), steps.pop(), kinds.pop()
                continue
            if skip:
                skip += start
                continue
            top = frames[-1] if frames else None
            if top and top[0] and top[1] is None:  # a key
                if start:
                    skip, top[1] = 1, "?"
                else:
                    top[1] = getattr(event, "value", "*")
                continue
            if top is None:
                if start:
                    frames.append([name == "MappingStartEvent", None, 0, {} if values else None, ""])
                continue
            ordinal = top[2]
            top[2] += 1
            in_list = not top[0]
            key = None if in_list else top[1]
            top[1] = None
            if start:
                is_map = name == "MappingStartEvent"
                dewey.append(ordinal)
                steps.append(f"[{ordinal}]" if in_list else f".{key}")
                kinds.append(OBJECT if in_list and is_map else OTHER)
                if in_list and is_map:
                    record = {} if values else None
                    out.append((dewey.copy(), steps.copy(), "".join(kinds), record))
                    frames.append([True, None, 0, record, ""])
                elif is_map:
                    frames.append([True, None, 0, top[3], f"{top[4]}{key}."])
                else:
                    frames.append([False, None, 0, {} if values else None, ""])
            elif values:
                value = getattr(event, "value", None)
                if in_list:
                    out.append(([*dewey, ordinal], [*steps, f"[{ordinal}]"], "".join(kinds) + VALUE, {"value": value}))
                elif top[3] is not None:
                    top[3][f"{top[4]}{key}"] = value
    except yaml.YAMLError:
        return []
    return out


def label_nodes(df: DataFrame, id_col: str, text_col: str, values: bool = True) -> DataFrame:
    """The labelled list elements of the YAML in `text_col`, columns NODES; `values` as in label_text()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols = [], ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for node in label_text(text, values):
                    ids.append(doc)
                    for col, x in zip(cols, node, strict=True):
                        col.append(x if not isinstance(x, dict) else list(x.items()))
                if len(ids) >= 20_000:
                    yield _batch(ids, cols)
                    ids, cols = [], ([], [], [], [])
            if ids:
                yield _batch(ids, cols)

    source = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL AND t <> ''")
    return spread(source).mapInArrow(run, NODES)


def _batch(ids: list, cols: tuple) -> pa.RecordBatch:
    arrays = [pa.array(c, f.type) for c, f in zip((ids, *cols), _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def path_text(steps: Column) -> Column:
    """Steps in words: `a.b[0].c[2]`; the empty string for no steps."""
    return F.regexp_replace(F.array_join(steps, ""), r"^\.", "")


def parent_depth(kinds: Column) -> Column:
    """How many steps lead to the nearest enclosing object of a list: the label is truncated to so many; 0 for none."""
    above = kinds.substr(F.lit(1), F.length(kinds) - 1)
    return F.when(F.instr(above, OBJECT) == 0, F.lit(0)).otherwise(
        F.length(above) - F.instr(F.reverse(above), OBJECT) + 1
    )


def with_links(nodes: DataFrame) -> DataFrame:
    """Adds node_path, parent_path, parent_dewey and schema_path, all by truncating and rewriting the labels."""
    depth = parent_depth(F.col("kinds"))
    generic = F.transform("steps", lambda s: F.when(s.rlike(r"^\[[0-9]+\]$"), F.lit("[]")).otherwise(s))
    return nodes.select(
        "*",
        path_text(F.col("steps")).alias("node_path"),
        path_text(F.slice("steps", F.lit(1), depth)).alias("parent_path"),
        F.slice("dewey", F.lit(1), depth).alias("parent_dewey"),
        path_text(generic).alias("schema_path"),
    )


def schema_paths(linked: DataFrame) -> DataFrame:
    """schema_path, n_rows, n_docs: the flat tables there are. Rows are combined before the shuffle."""
    per_doc = linked.groupBy("schema_path", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("schema_path").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_docs"))


def flat_table(linked: DataFrame, schema_path: str, fields: list[str]) -> DataFrame:
    """The table of one schema path: doc_id, node_path, parent_path and the wanted fields as strings, null where absent."""
    return linked.where(F.col("schema_path") == schema_path).select(
        "doc_id", "node_path", "parent_path", *[F.col("record")[f].alias(f) for f in fields]
    )


def write_tables(linked: DataFrame, path: str) -> None:
    """All flat tables at once, as one folder per schema path, split evenly by size (no path is bound to one task)."""
    out = linked.select("doc_id", "node_path", "parent_path", "dewey", "parent_dewey", "record", "schema_path")
    out.hint("rebalance", "schema_path").write.partitionBy("schema_path").parquet(path)


def found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node_path and parent_path of every mapping that is directly an element of a list."""
    linked = label_nodes(df, id_col, text_col, values=False)
    depth = parent_depth(F.col("kinds"))
    return linked.select(
        "doc_id", path_text(F.col("steps")).alias("node_path"), path_text(F.slice("steps", F.lit(1), depth)).alias("parent_path")
    )
