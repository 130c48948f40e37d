import random
from datetime import datetime

import duckdb
import pytest

from quirefold.api import Corpus, NotFoundError
from quirefold.lang.parser import QueryError, compile_tree
from quirefold.lang.rewrite import normalize
from quirefold.lang.tree import Category, Clause, Op, Statement
from quirefold.operators.view import search_view
from quirefold.plans.column import java_regex, select_by_rows, select_documents
from quirefold.plans.masks import Bridge, needs, select_bridged
from quirefold.plans.sql import where
from quirefold.schema import DOC_SCHEMA, SchemaError

T = datetime(2020, 6, 14)


def doc(i, title=None, date=None, authors=None, tags=None, links=None, headings=None, meta=None):
    return (i, f"p{i}.md", title, date, date, headings, meta, authors, tags, links)


ROWS = [
    doc(1, "Alpha", T, ["Ann"], ["x"], []),
    doc(2, "Beta", datetime(2020, 6, 15, 12), ["Bob"], ["x", "y"], ["l1", "l2"], "# One\n## Two\n", "status: draft\n"),
    doc(3, "alphabet", None, [], [], None),
    doc(4, None, None, None, None, None),
    doc(5, "Gamma x", datetime(2021, 1, 1), ["Ann", "Cy"], ["y"], ["l1"], "# Étude\n", "a: 1\nb: 2\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC_SCHEMA)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def bridged(spark, rows=ROWS):
    """The same documents with their sets in bridge tables, authors and tags through dictionaries."""
    at = {Category.AUTHOR: 7, Category.TAGS: 8, Category.LINKS: 9}
    values = {c: [(r[0], v) for r in rows for v in r[i] or []] for c, i in at.items()}
    bridges = {Category.LINKS: Bridge(spark.createDataFrame([*values[Category.LINKS], (None, "l1"), (77, "l1")], "doc_id bigint, value string"))}
    for c in (Category.AUTHOR, Category.TAGS):
        keys = {v: k for k, v in enumerate(sorted({v for _, v in values[c]}))}
        pairs = [(d, keys[v]) for d, v in values[c]]
        bridges[c] = Bridge(
            spark.createDataFrame(pairs + pairs[:2] + [(1, None), (None, 0), (3, 999)], "doc_id bigint, key bigint"),
            spark.createDataFrame([(k, v) for v, k in keys.items()] + [(500, None)], "key bigint, value string"),
        )
    return spark.createDataFrame(rows, DOC_SCHEMA).drop("authors", "tags", "links"), bridges


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("t=x", [1, 2]), ("t!=x", [2, 5]), ("-t=x", [2, 5]), ("t:xxx", []), ("t/^x", [1, 2]), ("-t/^x", [2, 5]), ("-t:xxx", [1, 2, 5]),
        ("T=Alpha", [1]), ("T!=Alpha", [2, 3, 5]), ("T:alpha", [1, 3]), ("-T:alpha", [2, 5]), ("T/^[AB]", [1, 2]), ("-T/^[AB]", [3, 5]),
        ("T:al", []), ("-T:al", [1, 2, 3, 5]), ("t=x t=y", [1, 2, 5]), ("(or t!=x t!=y)", []), ("t=x (or T=Beta t=y)", [2]),
        ("(and t=x l=l1)", [2]), ("a=Ann (or a=Cy t=x)", [1]), ("d:2020-06-14", [1, 2]), ("-d:2020-06-14", [5]), ("d=2020-06-14", [1]),
        ("d!=2020-06-14", [2, 5]), ("d<2020-06-15", [1]), ("-d<2020-06-15", [2, 5]), ("f>=2021-01-01", [5]), ("h/Two$", []), ("h/Two\\n$", [2]),
        ("h/(?i)éTUDE", [5]), ("m:draft", [2]), ("p=p4.md", [4]), ("T=Alpha T=Beta", []), ("T=Alpha T!=Alpha", []), ("(or T=Alpha T!=Alpha)", [1, 2, 3, 5]),
        ("t=x t:y", []), ("(or t=x p=p4.md)", [1, 2, 4]), ("(or a=Ann (and t=y l=l2))", [1, 2, 5]),
    ],
)
def test_meaning(spark, docs, text, want):
    tree = compile_tree(text)
    assert ids(select_documents(docs, tree)) == want
    assert ids(select_bridged(*bridged(spark), tree)) == want
    assert ids(select_by_rows(docs, tree)) == want


def random_tree(rng, depth):
    def statement():
        kind = rng.randrange(5)
        if kind == 0:
            c = rng.choice([Category.DATE, Category.FILETIME])
            op = rng.choice([Op.EQ, Op.NE, Op.LT, Op.LE, Op.GT, Op.GE, Op.AP])
            return Statement(c, op, rng.choice([T, datetime(2021, 1, 1), datetime(2020, 6, 15, 12)]), rng.random() < 0.3)
        c = rng.choice([Category.TITLE, Category.AUTHOR, Category.TAGS, Category.LINKS, Category.TAGS, Category.HEADINGS, Category.META])
        op = rng.choice([Op.EQ, Op.NE, Op.AP, Op.RE])
        value = rng.choice({Op.AP: ["alp", "ann", "One", "y"], Op.RE: ["^A", "x|l1", "[by]", "a$"]}.get(op, ["x", "y", "l1", "Ann", "Cy", "Beta"]))
        return Statement(c, op, value, rng.random() < 0.3)

    tree = Clause(rng.random() < 0.5, [statement() for _ in range(rng.randrange(1, 4))])
    if depth > 1:
        tree.clauses = [random_tree(rng, depth - 1) for _ in range(rng.randrange(3))]
    return tree


def test_random_trees_in_three_forms(spark, docs):
    rng = random.Random(11)
    rows = search_view(docs).toPandas()
    con = duckdb.connect()
    con.register("v", rows)
    hits, tables = 0, bridged(spark)
    for n in range(25):
        tree = normalize(random_tree(rng, 3))
        got = ids(select_documents(docs, tree))
        assert n > 11 or got == ids(select_bridged(*tables, tree)), str(tree)
        from quirefold.lang.rewrite import optimize

        want = sorted(r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM v WHERE {where(tree)}").fetchall())
        assert got == want == ids(select_by_rows(docs, tree)) == ids(select_documents(docs, optimize(tree))), str(tree)
        hits += len(got)
    assert hits


def test_regex_dialect():
    assert java_regex("a$") == "(?d)a\\z" and java_regex("[$]") == "(?d)[$]" and java_regex(r"\$") == r"(?d)\$"
    assert java_regex("(?i)é") == "(?d)(?iu)é"
    for bad in (r"(a)\1", "(?=a)", "(?<!a)", "(", "[a"):
        with pytest.raises(QueryError):
            java_regex(bad)


def test_corpus(docs):
    c = Corpus(docs)
    assert [r.doc_id for r in c.sort("title").docs.collect()] == [4, 1, 2, 5, 3]
    assert [r.doc_id for r in c.sort("title", True).docs.collect()] == [3, 5, 2, 1, 4]
    assert [r.doc_id for r in c.sort("date", True).docs.collect()][:3] == [5, 2, 1]
    assert c.sort("nothing") is c
    assert [r.doc_id for r in c.slice(1, 3).docs.collect()] == [2, 3] and c.at(0).docs.first().doc_id == 1
    assert c.query("t=x").count() == 2 and c.last_modified().first()[0] == datetime(2021, 1, 1)
    assert c.get("p1.md").first().title == "Alpha"
    with pytest.raises(NotFoundError):
        c.get("nowhere")
    with pytest.raises(IndexError):
        c.slice(3, 1)
    with pytest.raises(SchemaError):
        Corpus(docs.drop("tags"))


def test_scan_prunes_and_pushes(spark, tmp_path):
    spark.createDataFrame(ROWS, DOC_SCHEMA).write.parquet(str(tmp_path / "d"))
    kept = select_documents(spark.read.parquet(str(tmp_path / "d")), compile_tree("T=Alpha d>2019-01-01")).select("path")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(title,Alpha)" in plan and "GreaterThan(date" in plan and "headings" not in plan and "Exchange" not in plan


def test_many_statements_about_one_set(spark, docs):
    for n in (7, 70):
        tree = Clause(True, [Statement(Category.TAGS, Op.RE, f"^z{i}$", False) for i in range(n - 2)])
        tree.statements += [Statement(Category.TAGS, Op.RE, "^y", False), Statement(Category.LINKS, Op.EQ, "l2", False)]
        assert ids(select_bridged(*bridged(spark), tree)) == ids(select_documents(docs, tree)) == [2, 5]


def test_a_set_statement_starts_from_the_dictionary(spark):
    assert needs(compile_tree("t=x (or l=l1 T=A)"), Category.TAGS) and not needs(compile_tree("t=x (or l=l1 T=A)"), Category.LINKS)
    plan = select_bridged(*bridged(spark), compile_tree("t=x"))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner, (") :]
    assert "collect" not in plan and "Filter" in below and "= x)" in below
