import random
from datetime import datetime
from posixpath import normpath
from urllib.parse import unquote

from pyspark.sql import functions as F

from quirefold.operators import orphans
from quirefold.operators.skew import hot_keys, skew_join

T = datetime(2024, 3, 5)
LINKS = "doc_id bigint, link string, noted_at timestamp_ntz, path string"


def test_orphans(spark):
    notes = spark.createDataFrame([(1, "a/b.md"), (2, "c d.md"), (3, "a/é.md")], "id bigint, path string")
    scans = spark.createDataFrame([("late.md",), ("late.md",), (None,)], "path string")
    rows = [
        (1, "b.md", T), (1, " b.md#x\t", T), (1, "../c%20d.md?q", T), (1, "/a/%C3%A9.md", T), (1, "./x/../../c d.md", T),
        (1, "none.md", T), (1, "none.md", T), (1, "none.md", None), (1, "/late.md", T), (2, "late.md", T), (2, "a//b.md", T),
        (1, None, T), (1, "  ", T), (1, "#h", T), (1, "//h/x", T), (1, "mailto:x", T), (1, "HTTPS://x", T), (1, "a+b%2", T),
        (9, "b.md", T), (9, None, T), (None, "none.md", T), (2, "../../c d.md", T), (1, "x" * 100_000, T),
    ]
    links = spark.createDataFrame([(*r, "other") for r in rows], LINKS)
    got = [tuple(r) for r in orphans.orphans(links, notes, scans).collect() if len(r.link or "") < 99]
    want = [
        (9, "b.md", "doc", "missing", "2024-03"),
        (9, None, "doc", "missing", "2024-03"),
        (1, "none.md", "target", "missing", "2024-03"),
        (1, "none.md", "target", "missing", "unknown"),
        (1, "/late.md", "target", "late", "2024-03"),
        (2, "late.md", "target", "late", "2024-03"),
        (1, "a+b%2", "target", "missing", "2024-03"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    links = spark.createDataFrame([(1, "a.md", T, "")], LINKS)
    notes, scans = spark.createDataFrame([], "id bigint, path string"), spark.createDataFrame([], "path string")
    assert [tuple(r) for r in orphans.orphans(links, notes, scans).collect()] == [(1, "a.md", "doc", "missing", "2024-03")]
    assert orphans.orphans(links.limit(0), notes, scans).collect() == []


def test_target_path_against_posix_rules(spark):
    links = ["x.md", "../x.md", "./a/./b//c", "/r/s/../t", "%C3%A9%20x", "a%2Fb", "..", "q?x#y", "%FFz", "a/.."]
    rng = random.Random(12)
    links += ["/".join(rng.choices(["..", ".", "", "a", "b c", "...", "x.md", ".h", "..y"], k=rng.randrange(1, 7))) or "x" for _ in range(400)]
    links = [x for x in links if x.strip() and not x.startswith("//")]
    df = spark.createDataFrame([(x,) for x in links], "link string")
    own = "f/g/n.md"
    for r in orphans.with_target(df.select("link", F.lit(own).alias("own_path"))).withColumnRenamed("target", "t").collect():
        p = unquote(r.link.split("#")[0].split("?")[0])
        want = normpath(p if p.startswith("/") else f"/f/g/{p}").lstrip("/")
        assert r.t == want, r.link


def test_bitmaps_round_trip_and_difference(spark):
    a = spark.createDataFrame([(x,) for x in [0, 1, 63, 64, 65, 10**12, 63, None, -1]], "k bigint")
    b = spark.createDataFrame([(x,) for x in [1, 64, 7]], "k bigint")
    assert sorted(r.k for r in orphans.decode(orphans.bitmap_words(a, "k"), "k").collect()) == [-1, 0, 1, 63, 64, 65, 10**12]
    left = orphans.and_not(orphans.bitmap_words(a, "k"), orphans.bitmap_words(b, "k"))
    assert sorted(r.k for r in orphans.decode(left, "k").collect()) == [-1, 0, 63, 65, 10**12]


def test_skew_join_equals_join(spark):
    left = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 7 = 0 THEN NULL ELSE id END AS k", "id AS x")
    right = spark.range(0, 3000, 7).selectExpr("id AS k", "id * 2 AS y")
    h = spark.sql("SELECT xxhash64(7L)").first()[0]
    shares = hot_keys(left, "k", 1 / 16)
    assert set(shares) == {h, None} and abs(shares[h] - 1 / 3) < 0.01 and abs(shares[None] - 2 / 21) < 0.01
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
        for support in (None, 1 / 100, 0.9):
            assert sorted(map(tuple, skew_join(left, right, ["k"], how, support).collect()), key=repr) == want
    assert skew_join(left.limit(0), right, ["k"]).count() == 0
    assert skew_join(left, right.select(F.col("k").cast("int"), "y"), ["k"], support=0.01).count() == skew_join(left, right, ["k"]).count()


def test_a_hot_key_is_spread_by_its_share(spark):
    """Of 24,000 rows a third have one key: no task of the join gets more than a few shares."""
    left = spark.range(24_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS x")
    right = spark.range(24_000).selectExpr("id AS k", "id AS y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most(left.join(right, "k")) > 9_000 and most(skew_join(left, right, ["k"], support=1 / 64)) < 8_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_an_orphan_side_too_large_to_broadcast(spark):
    links = spark.createDataFrame([(1, "a.md", T, ""), (2, "b.md", None, ""), (1, "n.md", T, "")], LINKS)
    notes, scans = spark.createDataFrame([(1, "a.md")], "id bigint, path string"), spark.createDataFrame([], "path string")
    few = sorted(map(tuple, orphans.orphans(links, notes, scans).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, orphans.orphans(links, notes, scans).collect())) == few and len(few) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
