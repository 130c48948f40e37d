import random

import pytest

from quirefold.llm import encode, leakage, repetition
from quirefold.llm.text import words

DOCS = "doc_id bigint, text string, ids string, item_id bigint, bits string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], DOCS)


# -- encoding --------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


ODD = [
    (1, "It's  the\n\n  end\t of 12345 tests… don't!"), (2, None), (3, ""), (4, "   "), (5, "<|endoftext|> plain"), (6, "é é ñ 日本語 русский 😀👍🏽"),
    (7, "a b c\u0085d\x1ce"), (8, "x" * 30_000), (9, "word " * 40_000), (1, "again"), (1, "again"), (None, "no id"), (10, "\r\n\r\n"),
    (11, "''s 'll'd 're"), (12, "\U0001e4d0\U00011f04 newer letters ࡰ"), (13, "x²½ Ⅷ ٣"),
]


@pytest.mark.parametrize("size", [3, 1_000_000])
def test_ids_of_odd_texts(spark, tokenizer, size):
    got = [(r.doc_id, r.ids) for r in encode.encode(frame(spark, ODD), "doc_id", "text", block_words=size).collect()]
    want = [(i, tokenizer.encode(t, add_special_tokens=False).ids if t else []) for i, t in ODD]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ids_of_the_whole_table_and_back(spark, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = encode.encode(df, "doc_id", "text", block_words=20_000)
    ids, rows = {r.doc_id: r.ids for r in out.collect()}, df.select("doc_id", "text").collect()
    want = tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert ids == {r.doc_id: w.ids for r, w in zip(rows, want, strict=True)}


def test_round_trip_with_repeated_rows(spark):
    df = frame(spark, ODD)
    back = encode.decode(encode.encode(df, "doc_id", "text")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in ODD), key=repr)


def test_only_texts_with_newer_characters_are_cut_in_python(spark):
    rows = encode.blocks(frame(spark, ODD), "doc_id", "text", 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    kept = rows.collect()
    assert len({r.block for r in kept}) == len(kept) and sum(len(r.docs) for r in kept) == len(ODD)


def test_encode_nothing(spark):
    assert encode.encode(frame(spark, []), "doc_id", "text").collect() == []


# -- leakage ---------------------------------------------------------------------------------------------------------
def shared(doc, item, run=8):
    """The longest run of words two texts share, if it has `run` words."""
    a, b, best = words(doc), words(item), 0
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = last[j] + 1
                best = max(best, now[j + 1])
        last = now
    return best if best >= run else 0


@pytest.mark.parametrize("shard", [32_000_000, 300])
def test_leaks_equal_brute_force(spark, shard):
    rng = random.Random(4)
    vocabulary = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 30)))) for i in range(40)] + [(50, None), (51, ""), (None, "x " * 9)]
    items += [items[0], (52, items[1][1]), (53, "same " * 12)]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if d % 3 == 0:
            source = words(rng.choice(items[:40])[1])
            at = rng.randrange(max(1, len(source) - 9))
            w[10:10] = source[at : at + rng.randrange(6, 14)]
        docs.append((d, ", ".join(w).upper()))
    docs += [(70, None), (71, ""), (None, items[2][1]), docs[0], (72, "same " * 8), (73, "pad " * 90_000 + items[3][1])]
    got = {(r.doc_id, r.item_id): r.n_words for r in leakage.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), shard_bytes=shard).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            if d is not None and i is not None and t and x and d != 73 and (n := shared(t, x)):
                want[d, i] = n
    assert {k: v for k, v in got.items() if k[0] != 73} == want
    assert ((73, 3) in got) == (len(words(items[3][1])) >= 8)


def test_the_index_has_a_bounded_size_and_is_built_by_tasks(spark):
    import pickle

    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(9, 200)))) for i in range(400)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    blobs = [r.blob for r in leakage.shard_indexes(table, 3, 8).collect()]
    assert len(blobs) == 3
    for blob in blobs:
        index = pickle.loads(blob)
        n = len(index.coded)
        assert len(blob) <= leakage.INDEX_BYTES * n + index.terms.nbytes + 20_000 and index.nbytes() <= len(blob) + 1000
    whole = leakage.ItemIndex(items)
    assert len(whole.coded) == sum(len(words(t)) for _, t in items) and len(whole.run_hash) == sum(len(words(t)) - 7 for _, t in items)


def test_the_corpus_is_read_once_for_many_shards(spark):
    items = spark.createDataFrame([(i, f"a{i} b c d e f g h i{i} j") for i in range(30)], "item_id bigint, text string")
    docs = frame(spark, [(i, f"x a{i} b c d e f g h i{i} y") for i in range(0, 30, 3)] + [(99, "nothing of all this " * 9)])
    routed = dict(leakage.route(docs.select("doc_id", "text").toDF("i", "t"), leakage.shard_indexes(items, 4, 8), 4, 8, 32))
    sizes = [df.count() for df in routed.values()]
    assert len(sizes) == 4 and sum(sizes) >= 10 and all(df.where("i = 99").isEmpty() for df in routed.values())
    assert leakage.leaks(docs, items, shard_bytes=200).count() == 10


def test_leaks_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id bigint, text string")
    assert leakage.leaks(frame(spark, []), items).collect() == []
    assert leakage.leaks(frame(spark, [(1, "a b c d e f g h")]), items.limit(0)).collect() == []
    rows = leakage.overlap(leakage.leaks(frame(spark, [(1, "x A b c d e f g H")]), items), items).collect()
    assert [(r.doc_id, r.item_id, r.start, r.n_words, r.share, r.question_share, r.answer_share) for r in rows] == [(1, 1, 1, 8, 1.0, 1.0, None)]


def test_overlap_with_question_and_answer(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h? i j k l")], "item_id bigint, text string")
    docs = frame(spark, [(1, "z c d e f g h i j y"), (2, "a b c d e f g h"), (3, "a b c d e f g")])
    rows = leakage.overlap(leakage.leaks(docs, items), items).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_words, r.item_start, r.question_share, r.answer_share) for r in rows] == [(1, 1, 8, 2, 0.75, 0.5), (2, 0, 8, 0, 1.0, 0.0)]


def covering(doc, item, run=8):
    """Places of the item's words that lie in a run of `run` words it shares with the text."""
    a, b = words(doc), words(item)
    here = {tuple(a[i : i + run]) for i in range(len(a) - run + 1)}
    return {j + x for j in range(len(b) - run + 1) if tuple(b[j : j + run]) in here for x in range(run)}


def test_overlap_counts_all_shared_runs(spark):
    question, answer = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10?", "a1 a2 a3 a4 a5 a6 a7 a8"
    rng = random.Random(9)
    items = [(1, f"{question} {answer}"), (2, "b " * 30)] + [(i, " ".join(rng.choices("uvw", k=30)) + "? " + " ".join(rng.choices("uvw", k=20))) for i in range(3, 9)]
    docs = [(1, f"{question} between {answer}"), (2, f"{answer} {'pad ' * 50} q1 q2 q3 q4 q5 q6 q7 q8 x q3 q4 q5 q6 q7 q8 q9 q10"), (3, "b " * 9 + "x " + "b " * 8)]
    docs += [(2, f"again {question}"), (2, docs[1][1])] + [(i, " ".join(rng.choices("uvw", k=300))) for i in range(10, 30)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.share, r.question_share, r.answer_share) for r in leakage.overlap(leakage.leaks(frame(spark, docs), table), table).collect()}
    want = {}
    for d in {d for d, _ in docs}:
        for i, x in items:
            hit = set().union(*[covering(t, x) for e, t in docs if e == d])
            n, asked = len(words(x)), len(words(x[: x.rfind("?") + 1] or x))
            if hit:
                asked_hit = sum(p < asked for p in hit)
                want[d, i] = (len(hit) / n, asked_hit / asked, (len(hit) - asked_hit) / (n - asked) if n > asked else None)
    assert got == want and len(want) > 20
    assert got[1, 1] == got[2, 1] == (1.0, 1.0, 1.0)


# -- repetition ------------------------------------------------------------------------------------------------------
def repeated(text, run=5):
    w = words(text)
    seen, hit = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            hit.update(range(i, i + run))
        seen.add(g)
    return len(hit)


def test_shares_equal_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices("abc", k=rng.randrange(0, 60)))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "  \n "), (93, "x " * 50_000), (94, "a b c d e " * 4), (0, docs[0][1]), (None, "a b c d e a b c d e")]
    got = [(r.doc_id, r.n_words, r.run_share) for r in repetition.measure(frame(spark, docs), "doc_id", "text").collect()]
    want = [(i, len(words(t)), repeated(t) / max(1, len(words(t)))) for i, t in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ledger_policies_and_ablations(spark):
    docs = [(1, "a b c d e " * 6), (2, "one two\none two\nx\n"), (3, "p q\n\nr\n\np q\n\np q"), (4, None), (5, "a b c d e " * 2)]
    book = repetition.ledger(repetition.measure(frame(spark, docs), "doc_id", "text"))
    assert {r.doc_id: r.bits for r in book.collect()} == {1: 2, 2: 1 | 4, 3: 1 | 4 | 8, 4: 1, 5: 1 | 2}
    assert [r.doc_id for r in book.where(repetition.taken(repetition.POLICIES[0], book["bits"])).collect()] == [1]
    cases = {(r.policy, r.without_rule): r.n_docs for r in repetition.ablations(book).collect()}
    assert cases["1", "none"] == 1 and cases["1", "runs"] == 0 and cases["1", "short"] == 2 and cases["2", "short"] == 4
    assert repetition.ledger(repetition.measure(frame(spark, []), "doc_id", "text")).collect() == []


def test_a_stored_ledger_answers_without_texts(spark, tmp_path):
    docs = [(1, "a b c d e " * 6), (2, "one two\none two\nx\n"), (3, "p q\n\nr\n\np q\n\np q"), (4, None)]
    frame(spark, docs).write.parquet(f"{tmp_path}/docs")
    texts = spark.read.parquet(f"{tmp_path}/docs")
    book = repetition.Ledger(spark, f"file://{tmp_path}/book")
    book.record(texts, "doc_id", "text")
    book.record(frame(spark, [(5, "a b c d e " * 5)]), "doc_id", "text")
    assert [r.doc_id for r in book.take(repetition.POLICIES[0], 0).collect()] == [1]
    assert sorted(r.doc_id for r in book.take(repetition.POLICIES[0]).collect()) == [1, 5]
    for answer in (book.take(repetition.POLICIES[1]), book.ablations()):
        files = answer.inputFiles()
        assert files and all("/book/" in f for f in files)
        assert "MapInArrow" not in answer._jdf.queryExecution().executedPlan().toString()
    other = repetition.Ledger(spark, f"file://{tmp_path}/book", repetition.RULES[:2])
    with pytest.raises(repetition.RulesChangedError):
        other.record(texts, "doc_id", "text")
