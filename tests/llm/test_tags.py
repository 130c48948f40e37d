import random
import unicodedata
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import cooccurrence, terms, text
from quirefold.runtime import materialize

ROWS = "item string, basket bigint, name string, n bigint, a bigint"


def baskets(rng):
    rows = [(f"i{rng.randrange(40)}", b, "x", 1, 1) for b in range(150) for _ in range(rng.randrange(8))]
    rows += [(f"i{k}", 999, "x", 1, 1) for k in range(40)]  # a basket of everything
    rows += [("hot", b, "x", 1, 1) for b in range(150)] + rows[:30]
    return [*rows, (None, 1, "x", 1, 1), ("i1", None, "x", 1, 1), ("", 3, "x", 1, 1), ("z" * 50_000, 3, "x", 1, 1)]


@pytest.mark.parametrize(("chunk", "least", "lift"), [(128, 1, 0.0), (4, 1, 0.0), (4, 5, 1.5), (1, 2, 0.0)])
def test_pairs_equal_brute_force(spark, chunk, least, lift):
    rows = baskets(random.Random(1))
    df = spark.createDataFrame(rows, ROWS)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in cooccurrence.cooccurrence(df, "basket", "item", least, lift, chunk).collect()}
    sets = {}
    for i, b, *_ in rows:
        if i is not None and b is not None:
            sets.setdefault(b, set()).add(i)
    one, n = Counter(x for s in sets.values() for x in s), len(sets)
    two = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    assert got == {(a, b): (c, one[a], one[b]) for (a, b), c in two.items() if c >= least and c * n / (one[a] * one[b]) >= lift}


def test_a_basket_of_a_thousand_items(spark):
    """More items than a chunk of the size the queries use: its pairs come from the products of chunks."""
    rows = [(f"i{k}", 1, "x", 1, 1) for k in range(1000)] + [(f"i{k}", 2, "x", 1, 1) for k in range(0, 1000, 7)]
    uses = spark.createDataFrame(rows, ROWS)
    cut = cooccurrence.chunks(uses.selectExpr("basket", "item"), 128)
    assert cut.where("k > 1").count() == 8 + 2 and cut.where(F.size("items") > 200).isEmpty()
    got = cooccurrence.cooccurrence(uses, "basket", "item")
    assert got.count() == 1000 * 999 // 2 and got.where("n_ab = 2").count() == 143 * 142 // 2


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], ROWS)
    assert cooccurrence.cooccurrence(df, "basket", "item").collect() == []
    assert cooccurrence.cooccurrence(df, "basket", "item", 10, 5.0).collect() == []


@pytest.mark.parametrize(("burst", "flush", "route"), [(4096, 10**6, 10**6), (2, 50, 3), (1, 10**6, 1)])
def test_counts_equal_brute_force(spark, burst, flush, route):
    rng = random.Random(2)
    names = ["", "a", "aa", "aaa", "aaaa", "ab", "é", "z" * 20_000] + ["".join(rng.choices("ab", k=rng.randrange(9))) for _ in range(80)]
    rows = [(rng.choice(names), rng.randrange(60)) for _ in range(3000)] + [("hot", b % 60) for b in range(1500)]
    rows += [(None, 1), ("a", None)]
    df = spark.createDataFrame([(t, r, "x") for t, r in rows], "term string, record bigint, n_rows string")
    got = {r.term: (r.n_rows, r.n_records) for r in terms.term_counts(df, "record", "term", None, burst, flush, route).collect()}
    kept = [(t, r) for t, r in rows if t is not None and r is not None]
    n, k = Counter(t for t, _ in kept), Counter(t for t, _ in set(kept))
    assert got == {t: (n[t], k[t]) for t in n}


def test_counts_of_nothing_and_marks(spark):
    df = spark.createDataFrame([], "term string, record bigint")
    assert terms.term_counts(df, "record", "term").collect() == []
    c = spark.createDataFrame([("a", 9, 1), ("b", 9, 2), ("c", 9, 3), ("d", 9, 5), ("e", 9, 6)], terms.COUNTS)
    assert [r.mark for r in terms.with_marks(c, 100).orderBy("term").collect()] == ["rare", "rare", None, None, "common"]


def test_routes_open_heavy_prefixes():
    heavy = {"", "a", "ab"}
    assert [terms.route_of(t, heavy) for t in ("b", "abc", "abcd", "ab", "")] == ["b", "abc", "abc", None, None]


@pytest.mark.parametrize("shared", ["", "https://notes.example/" + "x" * 80 + "/"])
def test_many_terms_in_tries_that_never_burst_take_several_routes(spark, shared):
    """12,000 distinct terms, no task with more than 4,096, routes of at most 1,000."""
    rows = spark.range(0, 12_000, 1, 8).selectExpr(f"concat('{shared}', hex(id * 7919)) AS term", "id AS record", "1L AS n_rows")
    leaves = materialize(terms.local_tries(rows, 4096, 10**6), "test")
    assert {r.prefix for r in leaves.collect()} == {""}  # nothing has burst
    heavy = terms.heavy_prefixes(leaves, 1000)
    sizes = Counter()
    for r in terms.routed(leaves, heavy).collect():
        sizes[r.route] += len(r.suffixes)
    assert sum(sizes.values()) == 12_000 and max(sizes.values()) <= 1000 and len(sizes) > 12
    got = terms.merged(terms.routed(leaves, heavy), 4096)
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and got.count() == got.distinct().count() == 12_000 and got.where("n_rows <> 1 OR n_records <> 1").isEmpty()


def test_prefix_weights_equal_brute_force():
    rng = random.Random(8)
    names = ["".join(rng.choices("abé😀", k=rng.randrange(7))) for _ in range(300)] + ["a" * 90] * 9
    for least in (1, 5, 40):
        got = dict(terms.prefix_weights(pa.array(names, pa.large_string()), least, 10))
        want = Counter(n[:i] for n in names for i in range(min(len(n), 10) + 1))
        assert got == {p: c for p, c in want.items() if c >= least}


def test_tag_form():
    for raw, form in [
        (" #Two  Words\t", "two words"), ("##x", "x"), ("# x", "x"), ("é", "é"), ("É", "é"), ("a#b", "a#b"), ("", ""), (None, None),
    ]:
        assert text.tag_form(raw) == form


def test_uses(spark):
    tags = spark.createDataFrame([(1, "A", "x"), (2, "#a", "x"), (3, None, "x"), (4, "b", "x")], "id bigint, tag string, form string")
    notes = spark.createDataFrame([(10, "x"), (11, "y")], "id bigint, form string")
    rows = [(10, 1), (10, 1), (10, 2), (10, 3), (11, 4), (12, 4), (11, 9), (None, 1), (10, None)]
    uses = text.tag_uses(spark.createDataFrame(rows, "doc_id bigint, tag_id bigint"), tags, notes)
    assert sorted(map(tuple, uses.collect())) == [(10, "a", 3), (11, "b", 1)]


def test_words():
    assert text.words("A­B c_d\n-- Été 2² ​x y") == ["ab", "c", "d", "été", "2²", "x", "y"]
    assert text.words(None) == text.words("") == text.words(" \n#") == []
    import re

    rng = random.Random(3)
    chars = "aB9_ -\n­́é ßİΣ中ー😀٠\x1c\x85"
    for _ in range(500):
        t = "".join(rng.choices(chars, k=30))
        s = unicodedata.normalize("NFC", "".join(c for c in t if unicodedata.category(c) != "Cf")).lower()
        assert text.words(t) == re.findall(r"[^\W_]+", s)
    codes, offsets, names = text.word_codes(["b a b", None, "", "a"])
    assert [[names[c].as_py() for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [["b", "a", "b"], [], [], ["a"]]
