import random
from itertools import combinations

import pytest

from quirefold.llm import names

AUTHORS = "id bigint, author string, node string, name string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(("radius", "cell", "most"), [(1, 10, 64), (2, 5, 8), (3, 500, 64), (2, 1, 64)])
def test_radius_join_loses_nothing(spark, radius, cell, most):
    rng = random.Random(radius)
    points = {(b, "".join(rng.choices("abc", k=rng.randrange(1, 8)))) for b in "xy" for _ in range(90)} | {("x", "z" * 3000)}
    got = {tuple(r) for r in names.radius_join(spark.createDataFrame(sorted(points), "block string, name string"), radius, cell, most).collect()}
    want = set()
    for (b, x), (c, y) in combinations(sorted(points), 2):
        if b == c and abs(len(x) - len(y)) <= radius and (d := levenshtein(x, y)) <= radius:
            want.add((b, *sorted((x, y)), d))
    assert got == want


@pytest.mark.parametrize(("slips", "cell"), [(1, 5), (2, 10), (3, 8), (3, 500)])
def test_radius_join_finds_swaps(spark, slips, cell):
    rng = random.Random(slips)
    points = {("x", "".join(rng.choices("abcdefgh", k=rng.randrange(5, 10)))) for _ in range(40)}
    for _, name in sorted(points):
        for _ in range(4):
            n = list(name)
            for _ in range(slips):
                i = rng.randrange(len(n) - 1)
                n[i : i + 2] = rng.choice([n[i : i + 2][::-1], n[i : i + 2][::-1], [n[i], "k"], [n[i]]])
            points.add(("x", "".join(n)))
    join = names.radius_join(spark.createDataFrame(sorted(points), "block string, name string"), slips, cell, swaps=True).collect()
    got = {(r.name_a, r.name_b) for r in join if names.edits(r.name_a, r.name_b, slips) <= slips}
    want = {(a, b) for (_, a), (_, b) in combinations(sorted(points), 2) if names.edits(a, b, slips) <= slips}
    assert got == want and any(levenshtein(a, b) > slips for a, b in want)
    assert all(r.d == levenshtein(r.name_a, r.name_b) for r in join)


def test_swaps_are_linked(spark):
    rows = [(i, n, "x", "y") for i, n in enumerate(["Roderick Tarvolen", "Tarvolen, Rod", "R. Tarvolen", "Roderick Atrvoeln", "Roderick Atrvoelm", "Roderick Atvrolne"])]
    assert all(levenshtein("tarvolen", n[9:].lower()) > 3 for _, n, *_ in rows[3:])
    assert len({r.entity for r in names.entities(spark.createDataFrame(rows, AUTHORS), "id", "author").collect()}) == 1


@pytest.mark.parametrize(
    ("name", "reading"),
    [
        ("Dr. Mary-Ann  O'Neill", [("m", "oneill", ("mary",))]),
        ("Tarvolen, Bill K.", [("w", "tarvolen", ("william",))]),
        ("tarvolen w.", [("w", "tarvolen", ())]),
        ("W.K. Tarvolen PhD", [("w", "tarvolen", ())]),
        ("@wtarvolen", [("w", "tarvolen", ())]),
        ("will_tarvolen", [("w", "tarvolen", ("william",))]),
        ("Bil Trvolen <william.tarvolen@x.example>", [("w", "tarvolen", ("william",))]),
        ("Tarvolen Wiliam", [("w", "tarvolen", ("william",))]),
        ("Ted Tarvolen", [("e", "tarvolen", ("edward",)), ("t", "tarvolen", ("theodore",))]),
        ("Inst. of Hydrography, Tarvolen", [("o:hi", "tarvolen", ("hydrography institute",))]),
        ("Royal Harbour Society", [("o:s", "harbour royal", ("society",))]),
        ("Society, Harbour Royal", [("o:s", "harbour royal", ("society",))]),
        ("Grand Harbour Society", [("o:s", "grand harbour", ("society",))]),
        ("The Tarvolen Presss", [("o:p", "tarvolen", ("press",))]),
        ("Tarvolen MT", [("m", "tarvolen", ()), ("o:mt", "tarvolen", ())]),
        ("Tarvolen", [("?", "tarvolen", ())]),
        ("N/A", []), ("", []), ("  ", []), (None, []), ("-", []), ("Anon.", []), ("123", []),
    ],
)
def test_read(name, reading):
    assert names.read(name) == reading


def test_variants_are_linked_and_others_not(spark):
    groups = [
        ["Roderick Tarvolen", "Tarvolen, Rod", "R. Tarvolen", "Dr. Roderick Tarvolen", "Rodrick Tarvolen", "Roderick Tarvloen", "rod.tarvolen", "@rtarvolen"],
        ["Susannah Tarvolen", "Sue Tarvolen", "Tarvólen S."],
        ["Tarvolen Press", "Press, Tarvolen", "Tarvolen Pr."],
        ["Tarvolen Museum Trust", "TARVOLEN MT", "Tarvolen Mus. Trust"],
        ["Edward Bisgonnet", "Edward Bisgonnet", "Ted Bisgonnet"],
        ["Theodore Quimmarsh"],
        ["x" * 40_000],
    ]
    rows, want, n = [(900, None), (901, ""), (902, "unknown"), (903, "unknown"), (None, "Roderick Tarvolen")], set(), 0
    for g in groups:
        ids = list(range(n, n + len(g)))
        n += len(g)
        rows += list(zip(ids, g, strict=True))
        want |= set(combinations(ids, 2))
    rows += rows[5:9]  # repeated rows
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, a, "x", "y") for i, a in rows], AUTHORS)
    got = names.variant_pairs(names.entities(df, "id", "author"), chunk=3).collect()
    assert sorted(map(tuple, got)) == sorted(want)


SLIPS = [
    ["Roderick Tarvolen", "Tarvolen, Rod", "R. Tarvolen", "rod.tarvolen", "Roderick Tarvloen", "Roderick Tarvollenn", "Roderick Turbolin"],
    ["Susannah Tarvolen", "Sue Tarvolen"],
    ["Tarvolen Press", "Press, Tarvolen", "Tarvolne Press"],
]


@pytest.mark.parametrize("times", [1, 4, 10, 1000])
def test_links_do_not_depend_on_the_number_of_rows(spark, times):
    firsts, rows = {}, []
    for k, variants in enumerate(SLIPS):
        for v in variants:
            firsts[len(rows)] = k
            rows += [(len(rows) + i, v, "x", "y") for i in range(times)]
    entity = {r.id: r.entity for r in names.entities(spark.createDataFrame(rows, AUTHORS), "id", "author").collect()}
    assert len(entity) == len(rows)
    for a, b in combinations(firsts, 2):
        assert (entity[a] == entity[b]) == (firsts[a] == firsts[b]), (rows[a][1], rows[b][1])


def test_names_that_no_table_has(spark):
    """Given names outside the tables: slips, short forms and different people of one family."""
    groups = [
        ["Zorblaxian Tarvolen", "Zorblaxian Tarvolen", "Tarvolen, Zorblaxan", "Zorb Tarvolen", "Zorby Tarvolen", "Z. Tarvolen", "zorblaxian.tarvolen", "Zorblaxian Tarvloen"],
        ["Zuminette Tarvolen", "Zumminette Tarvolen"],
        ["Quill Tarvolen", "Quill Tarvolen", "Quil Tarvolen"],
        ["Zorblaxian Bisgonnet", "Zorblaxiam Bisgonnet"],
    ]
    flat = [(k, v) for k, g in enumerate(groups) for v in g]
    for times in (1, 5):
        rows = [(i * times + n, v, "x", "y") for i, (_, v) in enumerate(flat) for n in range(times)]
        entity = {r.id: r.entity for r in names.entities(spark.createDataFrame(rows, AUTHORS), "id", "author").collect()}
        for (i, (k, v)), (j, (m, w)) in combinations(enumerate(flat), 2):
            if "Z. Tarvolen" not in (v, w):  # two people of the family can be meant
                assert (entity[i * times] == entity[j * times]) == (k == m), (v, w)


def test_tables_of_ones_own(spark, tmp_path):
    import json
    import pickle

    (tmp_path / "names.json").write_text(json.dumps({"given": {"zorblaxian": "zed"}, "kinds": {"coven": "cov"}}))
    reader = pickle.loads(pickle.dumps(names.Reader.load(str(tmp_path / "names.json"))))
    assert reader.read("Zed Tarvolen") == [("z", "tarvolen", ("zorblaxian",))] and names.read("Zed Tarvolen") == [("z", "tarvolen", ("~zed",))]
    assert reader.read("Tarvolen Cov.") == [("o:c", "tarvolen", ("coven",))]
    rows = [(1, "Zed Tarvolen", "x", "y"), (2, "Zorblaxian Tarvolen", "x", "y"), (3, "Tarvolen Coven", "x", "y")]
    entity = {r.id: r.entity for r in names.entities(spark.createDataFrame(rows, AUTHORS), "id", "author", reader=reader).collect()}
    assert entity[1] == entity[2] != entity[3]


def test_cells_are_divided_into_bounded_products(spark):
    """One block of 600 names and cells of 20: no task of the join meets more than a few cells' worth, and nothing is lost."""
    rng = random.Random(5)
    points = sorted({("x", "".join(rng.choices("abcd", k=rng.randrange(4, 9)))) for _ in range(600)})
    got = {tuple(r) for r in names.radius_join(spark.createDataFrame(points, "block string, name string"), 1, 20, 4).collect()}
    want = {("x", x, y, levenshtein(x, y)) for (_, x), (_, y) in combinations(points, 2) if abs(len(x) - len(y)) <= 1 and levenshtein(x, y) <= 1}
    assert got == want and len(want) > 100


def test_established_names_close_to_each_other_stay_apart(spark):
    rows = [(i, "Roderick Tarvolen" if i % 5 < 3 else "Rod Tarvolen", "x", "y") for i in range(60)]
    rows += [(100 + i, "Roderick Tarvelan" if i % 5 < 3 else "Rod Tarvelan", "x", "y") for i in range(50)]
    entity = {r.id: r.entity for r in names.entities(spark.createDataFrame(rows, AUTHORS), "id", "author").collect()}
    assert len({entity[i] for i in range(60)}) == 1 and len({entity[100 + i] for i in range(50)}) == 1 and entity[0] != entity[100]


def test_nobody(spark):
    empty = spark.createDataFrame([], AUTHORS)
    assert names.variant_pairs(names.entities(empty, "id", "author")).collect() == []
    nobody = spark.createDataFrame([(1, None, "", ""), (2, " ", "", "")], AUTHORS)
    assert names.variant_pairs(names.entities(nobody, "id", "author")).collect() == []
