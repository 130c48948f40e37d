from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quirefold.functions import scalar
from quirefold.lang.dates import parse_datetime
from quirefold.sources import crawl, filters, markdown

HEAD = "---\ntitle: One\n---\n"
FILES = {
    "a.md": HEAD + "text",
    "b": HEAD,
    "x/templates/c.md": HEAD,
    "x/.git/d.md": HEAD,
    ".e.md": HEAD,
    "_u.md": HEAD,
    "x/f.md": "no header",
    "x/y/g.txt": "---\ntitle: open\n",
    "x/y/h é.md": "---\n" + "k: v\n" * 2000 + "---\n",
    "big.md": HEAD + "z" * (204_801 - len(HEAD)),
    "fits.md": HEAD + "z" * (204_800 - len(HEAD)),
    "crlf.md": HEAD.replace("\n", "\r\n"),
    "short.md": "-",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("notes")
    for name, text in FILES.items():
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        (d / name).write_bytes(text.encode())
    return d.as_uri()


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_crawl(spark, root):
    assert paths(crawl.crawl(spark, root, False)) == sorted(FILES)
    assert paths(crawl.crawl(spark, root)) == sorted(f for f in FILES if f not in (".e.md", "x/.git/d.md"))


def test_a_hidden_root_and_many_folders(spark, tmp_path):
    for name in [".h/a.md", *[f"d{i}/_x/e{i}/n.md" for i in range(40)], "d0/.g/n.md", "d1/m.md"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(HEAD)
    assert paths(crawl.crawl(spark, (tmp_path / ".h").as_uri())) == [] and paths(crawl.crawl(spark, (tmp_path / ".h").as_uri(), False)) == ["a.md"]
    kept = paths(crawl.crawl(spark, tmp_path.as_uri()))
    assert kept == sorted([*[f"d{i}/_x/e{i}/n.md" for i in range(40)], "d1/m.md"])
    assert len(paths(crawl.crawl(spark, tmp_path.as_uri(), False))) == 43
    deep = crawl._folders(str(tmp_path), 3)
    assert {f for f, below in deep if not below} == {""} and len([f for f, below in deep if below]) == 41


def test_filters_of_ones_own(spark, root):
    files = crawl.crawl(spark, root)
    assert paths(filters.accept(files, ["Ext_.md", lambda path, length, content: length > 200_000])) == ["big.md", "fits.md"]
    assert paths(filters.accept(files, [F.col("path").startswith("x/"), "Ext_.txt"])) == ["x/y/g.txt"]
    filters.register("Starts", lambda s: F.col("path").startswith(s))
    try:
        assert paths(filters.accept(files, ["Starts_c"])) == ["crlf.md"]
    finally:
        del filters.FILTERS["Starts"]
    with pytest.raises(filters.FilterError):
        filters.register("a_b", filters.extension)


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ("Ext_.txt", ["x/y/g.txt"]), ("Extension_", ["b"]), ("IncludeName_b,a.md", ["a.md", "b"]), ("IncludeFilename_g.txt", ["x/y/g.txt"]),
        ("IncludeRegex_^x/y", ["x/y/g.txt", "x/y/h é.md"]), ("MaxSize_1", ["short.md"]),
        ("ExcludeRegex_m", ["b", "x/y/g.txt"]), ("ExcludeParent_x", ["_u.md", "a.md", "b", "big.md", "crlf.md", "fits.md", "short.md"]),
    ],
)
def test_filters(spark, root, spec, want):
    assert paths(filters.accept(crawl.crawl(spark, root), [spec])) == want


def test_default_filters_and_errors(spark, root):
    assert paths(filters.accept(crawl.crawl(spark, root))) == ["_u.md", "a.md", "fits.md", "x/y/h é.md"]
    for bad in ("Nothing_x", "Ext", "MaxSize_x"):
        with pytest.raises(filters.FilterError):
            filters.parse_filter(bad)


def read(spark, text, **options):
    files = spark.createDataFrame([(text, "p.md", datetime(2024, 1, 1))], "content string, path string, filetime timestamp_ntz")
    return markdown.parse(files, markdown.ParseOptions(**options)).first()


@pytest.mark.parametrize(
    ("header", "field", "value"),
    [
        ("title: One", "title", "One"), ("title: 12", "title", "12"), ("title:", "title", None), ("tags: [a, b, a]", "tags", ["a", "b"]),
        ("tags:\n- a\n- b", "tags", ["a", "b"]), ('date: "June 5, 2023"', "date", datetime(2023, 6, 5)), ("date: 2023-06-05", "date", datetime(2023, 6, 5)),
        ("date: ''", "date", None), ("author: Ann", "authors", ["Ann"]), ("author: [Ann, Bob, Ann]", "authors", ["Ann", "Bob", "Ann"]),
        ("k: v\nlist:\n  - 1\n\ntitle: x\nz: {a: b}", "meta", "k: v\nlist:\n  - 1\nz: {a: b}\n"), ("title: x", "meta", None),
    ],
)
def test_headers(spark, header, field, value):
    row = read(spark, f"---\n{header}\n---\n")
    assert row.error is None and row[field] == value


@pytest.mark.parametrize("header", ["tags: [a", "tags: x", "author: 12", "author: [1]", "author:", "date: 12", "date: never", "date: [x]", "- a", "title: [x]"])
def test_bad_headers(spark, header):
    assert read(spark, f"---\n{header}\n---\n").error
    assert (read(spark, f"---\n{header}\n---\n", ignore_date_error=True).error is None) == header.startswith("date")


def test_meta_that_cannot_stand_alone(spark):
    header = "tags: &t [a, b]\nk: v\nother: *t\nz: &y {b: 1}\nagain: *y"
    assert read(spark, f"---\n{header}\n---\n").error.startswith("meta")
    row = read(spark, f"---\n{header}\n---\n", ignore_meta_error=True)
    assert row.error is None and row.tags == ["a", "b"] and row.meta == "k: v\nz: &y {b: 1}\nagain: *y\n"
    assert read(spark, "---\n{title: x, k: v, l: [1, 2]}\n---\n").meta == "k: v\nl: [1, 2]\n"


def test_marks(spark):
    body = "# One\n##Two words\ntext [a]( ../x.md ) and [b](y)\n[c]()\n[d]( )\n### [Linked](z/)\n#### [Other](w) more\n[e](x) foo (bar)\n####### seven\n"
    row = read(spark, HEAD + body)
    assert row.headings == "# One\n##Two words\n### [Linked]\n#### [Other]\n####### seven\n" or row.headings.startswith("# One\n##Two words\n### [Linked]\n")
    assert row.links[0] == "y" and "z/" in row.links and "x) foo (bar" in row.links
    bare = read(spark, HEAD + body, headings=False, links=False, meta=False)
    assert bare.headings is None and bare.links is None


def test_errors_are_counted(spark, root):
    files = crawl.crawl(spark, root)
    accepted = filters.accept(files, ["Ext_.md"])
    parsed = markdown.parse(accepted)
    good, bad = markdown.split_errors(parsed)
    assert (good.count(), bad.count()) == (6, 3)
    assert markdown.index_stats(files, filters.condition(["Ext_.md"])).first().asDict() == {"n_crawled": 11, "n_accepted": 9, "n_parsed": 6, "n_errors": 3}


def test_column_dates_equal_python(spark):
    texts = [
        "Jan  2, 2024", "december 11, 2017", "March 3 2017", "2017 March 3", "2020-02-29", "2020-02-30", "2020-02-03 04:05:06", "01/02 03:04:05PM '06 -0700",
        "01/02 12:04:05AM '06 -0700", "01/02 13:04:05PM '06 -0700", "Mon Jan  2 15:04:05 2006", "Mon Jan  2 15:04:05 UTC 2006", "Mon Jan 02 15:04:05 +0130 2006",
        "02 Jan 70 15:04 MST", "02 Jan 68 15:04 -0100", "Monday, 02-Jan-06 15:04:05 GMT", "Mon, 02 Jan 2006 15:04:05 GMT", "Mon, 02 Jan 2006 15:04:05 +0200",
        "2006-01-02T15:04:05Z", "2006-01-02T15:04:05.25+07:00", "", "x", "2020-13-01", "2020-01-01 25:00:00", "é", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", scalar.parse_datetime(F.col("t")).alias("m")).collect():
        assert r.m == (parse_datetime(r.t) if r.t is not None else None), r.t


def test_scalar_functions(spark):
    df = spark.createDataFrame([("kitten",), ("a",), (None,)], "w string")
    rows = df.select(
        F.levenshtein("w", F.lit("sitting")).alias("d"), scalar.nearest(F.col("w"), ["mitten", "bitten", "b"], 3).alias("n"),
        scalar.match(F.col("w"), "ITT").alias("m"), scalar.match(F.col("w"), "it").alias("s"), scalar.regexp(F.col("w"), "t+e").alias("r"),
    ).collect()
    sliced = lambda a, b: [r[0] for r in df.select(scalar.contains_sliced(F.col("w"), F.lit("kitchen"), a, b)).collect()]
    assert sliced(0, 3) == sliced(-2, 3) == [True, False, None] and sliced(1, 99) == [False, False, None] and sliced(5, 2) == sliced(9, 12) == [True, True, None]
    assert [tuple(r) for r in rows] == [(3, "mitten", True, False, True), (7, "b", False, False, False), (None, None, None, False, None)]
    one = spark.range(1).select(scalar.http_date(F.lit("2024-03-05 06:07:08").cast("timestamp_ntz")), scalar.epoch(F.lit("1969-12-31 23:59:59").cast("timestamp_ntz")), scalar.from_epoch(F.lit(86400)))
    assert tuple(one.first()) == ("Tue, 05 Mar 2024 06:07:08 GMT", -1, datetime(1970, 1, 2))
