import yaml

from quirefold.operators import nested

SCHEMA = "id bigint, meta string, doc_id string"
TEXTS = {
    1: "a:\n  b:\n  - c: 1\n    d: [{e: 1}, 2, {}]\n  - x\nz: [[{q: 1}, {q: 2}], [{}]]\n",
    2: "a: [{b: 1}\n",
    3: None,
    4: "",
    5: "# only a comment\n",
    6: "- {a: {b: [{c: d}]}}\n- [{x: y}]\n",
    7: "s: |\n  l:\n  - m: 1\n",
    8: "a: 1\n---\nb: [{c: 1}]\n",
    9: "? {k: v}\n: [{a: 1}]\n",
    10: "deep: " + "[{k: " * 200 + "1" + "}]" * 200,
    11: "long: [" + ", ".join("{n: %d}" % i for i in range(3000)) + "]",
}


def brute(text):
    """All mappings that are elements of lists, by recursion over PyYAML's composed tree."""
    out = []

    def walk(node, path, parent):
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                walk(v, f"{path}.{k.value if isinstance(k, yaml.ScalarNode) else '?'}".lstrip("."), parent)
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                p, own = f"{path}[{i}]", isinstance(v, yaml.MappingNode)
                if own:
                    out.append((p, parent))
                walk(v, p, p if own else parent)

    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader) if text else None
    except yaml.YAMLError:
        return []
    if root is not None:
        walk(root, "", "")
    return out


def test_found_equals_recursion(spark):
    df = spark.createDataFrame([(k, v, "x") for k, v in TEXTS.items()] + [(1, TEXTS[1], "again")], SCHEMA)
    got = sorted(tuple(r) for r in nested.found(df, "id", "meta").collect())
    want = sorted((k, *x) for k, v in [*TEXTS.items(), (1, TEXTS[1])] for x in brute(v))
    assert got == want


def test_whole_table_equals_recursion(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/note_files.parquet")
    got = sorted(tuple(r) for r in nested.found(df, "id", "meta").collect())
    assert got == sorted((r.id, *x) for r in df.select("id", "meta").collect() for x in brute(r.meta))


def test_flat_tables_keep_links_and_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, TEXTS[1], "x")], SCHEMA)
    linked = nested.with_links(nested.label_nodes(df, "id", "meta"))
    paths = {r.schema_path: (r.n_rows, r.n_docs) for r in nested.schema_paths(linked).collect()}
    assert paths == {"a.b[]": (2, 1), "a.b[].d[]": (3, 1), "z[][]": (3, 1)}
    rows = nested.flat_table(linked, "a.b[].d[]", ["e", "value", "none"]).collect()
    assert sorted((r.node_path, r.parent_path, r.e, r.value, r.none) for r in rows) == [
        ("a.b[0].d[0]", "a.b[0]", "1", None, None),
        ("a.b[0].d[1]", "a.b[0]", None, "2", None),
        ("a.b[0].d[2]", "a.b[0]", None, None, None),
    ]
    nested.write_tables(linked, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 8
    parents = {tuple(r.dewey) for r in linked.collect()}
    assert all(tuple(r.parent_dewey) in parents | {()} for r in linked.collect())


def test_empty_table(spark):
    assert nested.found(spark.createDataFrame([], SCHEMA), "id", "meta").collect() == []
