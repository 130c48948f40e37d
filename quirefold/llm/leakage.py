"""Evaluation texts inside training texts: BM25 over the items, block-max bounds, exact verification.

The evaluation items are indexed, and every passage of every training text is a query. A passage is a window of `window`
words; windows overlap by run - 1 words, so every run of `run` words lies in one whole. All items at or above a threshold are
retrieved, and the threshold loses nothing: each item's is the least BM25 score that any of its runs of `run` words can give,
so a passage that holds one reaches it. Impacts are divided by it; the threshold is then 1 for all items.

Retrieval goes in the order of block-max WAND, over all passages of a batch at once: (1) the greatest impacts of a passage's
terms must add up to 1; (2) its terms' block maxima must add up to 1 in a block of items; (3) within such blocks the score is
computed. Retrieved pairs are verified word by word.

The index is made of arrays and hashes of runs, at most INDEX_BYTES for each word of the items beside their distinct words. Items
are divided into shards of about `shard_bytes` of text, whose indexes are built by tasks, so a broadcast has a bounded size. With
several shards the corpus is still read once: the greatest impacts a term has in each shard are the first level of block maxima;
a text goes to the shards where one of its passages can reach the threshold, and each shard then reads its own texts only.

Defined results: null ids and null, empty or short texts (fewer than `run` words) give no pair; repeated rows of
either side give one pair; empty tables give an empty result; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.text import word_codes, words
from quirefold.runtime import materialize, scratch_path, spread

PAIRS = "doc_id bigint, item_id bigint, start bigint, n_words bigint, item_start bigint, covered array<struct<first: bigint, end: bigint>>"
RANGES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


#: What a word of the items takes in an index at most: its code, its run, its posting, its block, its bound.
INDEX_BYTES = 4 + 16 + 12 + 16 + 16


def run_hashes(codes: np.ndarray, run: int) -> np.ndarray:
    """A hash of the `run` codes from each place on (equal runs have equal hashes; the words are compared afterwards)."""
    n = max(0, len(codes) - run + 1)
    h = np.zeros(n, np.uint64)
    for k in range(run):
        h = (h ^ codes[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class ItemIndex:
    """BM25 postings of the items, in blocks of items with their maxima, and the items' words for verification: flat arrays."""

    def __init__(self, items: list[tuple[int, str]], run: int = 8, block: int = 16, k1: float = 1.2, b: float = 0.75) -> None:
        ids = [i for i, _ in sorted(items)]
        codes, offsets, terms = word_codes([t for _, t in sorted(items)])
        long = np.flatnonzero(np.diff(offsets) >= run)
        at, which = ranges(offsets[long], offsets[long + 1])
        used, codes = np.unique(codes[at], return_inverse=True)
        self.run, self.ids = run, [ids[i] for i in long.tolist()]
        self.terms = terms.take(pa.array(used)).cast(pa.large_string())
        self.coded = codes.astype(np.int32)
        sizes = np.diff(offsets)[long]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        count, n_terms = len(self.ids), len(used)
        # One posting for each term of each item, ordered by term.
        key, tf = np.unique(codes * max(count, 1) + which, return_counts=True)
        term, item = key // max(count, 1), key % max(count, 1)
        df = np.bincount(term, minlength=n_terms)
        idf = np.log1p((count - df + 0.5) / (df + 0.5))
        mean = sizes.mean() if count else 1.0
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[item] / mean))
        # Each item's least score of a run: a term that stands in a run twice counts once.
        inside = np.ones(max(0, len(codes) - run + 1), bool)
        for end in self.offsets[1:-1]:
            inside[max(0, int(end) - run + 1) : int(end)] = False
        first = np.flatnonzero(inside)
        own = weight[np.searchsorted(key, codes * max(count, 1) + which)]
        score = np.zeros(len(first))
        for k in range(run):
            seen = np.zeros(len(first), bool)
            for j in range(k):
                seen |= codes[first + j] == codes[first + k]
            score += np.where(seen, 0.0, own[first + k])
        least = np.full(count, np.inf)
        np.minimum.at(least, which[first], score)
        impact = weight / (least[item] * (1 - 1e-9)) if count else weight  # for rounding
        self.post_item, self.post_impact = item.astype(np.int32), impact
        # Blocks: runs of postings of one term whose items share a block.
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (item[1:] // block != item[:-1] // block)
        starts = np.flatnonzero(new)
        self.block_start = np.append(starts, len(term)).astype(np.int32)
        self.block_no = (item[starts] // block).astype(np.int32)
        self.block_max = np.maximum.reduceat(impact, starts) if len(term) else np.zeros(0)
        self.term_blocks = np.searchsorted(term[starts], np.arange(n_terms + 1)).astype(np.int32)
        self.bound = np.zeros(n_terms + 1)  # the last is for words that no item has
        np.maximum.at(self.bound, term, impact)
        # The items' runs by hash.
        h = run_hashes(codes, run)[first]
        order = np.argsort(h, kind="stable")
        self.run_hash, self.run_item = h[order], which[first][order].astype(np.int32)
        self.run_at = (first - self.offsets[which[first]])[order].astype(np.int32)

    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray)) + self.terms.nbytes


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [start, end), and for each of them which range it is from."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), which


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the values of each."""
    distinct, inverse = np.unique(key, return_inverse=True)
    return distinct, np.bincount(inverse, value, len(distinct))


def retrieve(index: ItemIndex, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item) of all items that reach the threshold for the passages terms[starts[i]:ends[i]]."""
    none = np.zeros(0, np.int64)
    # 1. The terms' greatest impacts, repeated words counted each time, hence never too low.
    total = np.concatenate([[0.0], np.cumsum(index.bound[terms])])
    alive = np.flatnonzero(total[ends] - total[starts] >= 1 - 1e-6)
    if not len(alive):
        return none, none
    # The distinct terms of each passage.
    at, which = ranges(starts[alive], ends[alive])
    size = len(index.terms)
    known = terms[at] < size
    pairs = np.unique(which[known] * size + terms[at][known])
    passage, term = pairs // size, pairs % size
    # 2. Block maxima.
    entry, from_ = ranges(index.term_blocks[term], index.term_blocks[term + 1])
    blocks = int(index.block_no.max()) + 1
    cell = passage[from_] * blocks + index.block_no[entry]
    cells, bound = _sums(cell, index.block_max[entry])
    good = cells[bound >= 1 - 1e-6]
    keep = np.isin(cell, good)
    if not keep.any():
        return none, none
    # 3. Scores within the blocks that are left.
    entry, owner = entry[keep], passage[from_][keep]
    post, of = ranges(index.block_start[entry], index.block_start[entry + 1])
    count = len(index.ids)
    found, score = _sums(owner[of] * count + index.post_item[post], index.post_impact[post])
    hits = found[score >= 1 - 1e-6]
    return alive[hits // count], hits % count


def _passages(offsets: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the windows of all texts with at least `run` words."""
    n = np.diff(offsets)
    step = window - run + 1
    count = np.where(n >= run, np.maximum(1, -(-(n - run + 1) // step)), 0)
    k, text = ranges(np.zeros_like(count), count)
    start = offsets[text] + k * step
    return text, start, np.minimum(start + window, offsets[text + 1])


def leaks(docs: DataFrame, items: DataFrame, run: int = 8, window: int = 32, shard_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id, start, n_words, item_start, covered): documents and items that share at least `run` consecutive words,
    with the length of the longest run they share, its place in the words of both, and the item's words in all runs they share
    (ranges that may overlap). docs: doc_id, text. items: item_id, text."""
    spark = docs.sparkSession
    clean = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    volume = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(volume / shard_bytes))
    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("bigint").alias("i"), F.col("text").alias("t"))
    source = spread(source)
    indexes = shard_indexes(clean, shards, run)
    if shards == 1:
        out = _pass(source, spark.sparkContext.broadcast(_load(indexes, 0)), window)
    else:
        out = None
        for s, mine in route(source, indexes, shards, run, window):
            found = _pass(mine, spark.sparkContext.broadcast(_load(indexes, s)), window)
            out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("start", "n_words", "item_start"), F.struct("n_words", -F.col("start"), -F.col("item_start"))).alias("m")
    covered = F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered")  # rows of one id and text have equal ranges
    return out.groupBy("doc_id", "item_id").agg(best, covered).select("doc_id", "item_id", "m.*", "covered")


def shard_indexes(items: DataFrame, shards: int, run: int) -> DataFrame:
    """(shard, blob): the pickled index of each shard, built by tasks and written."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        index = ItemIndex(list(zip(frame["item_id"].tolist(), frame["text"].tolist(), strict=True)), run)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "blob": [pickle.dumps(index, pickle.HIGHEST_PROTOCOL)]})

    placed = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    return materialize(placed.groupBy("shard").applyInPandas(build, "shard int, blob binary"), "indexes")


def _load(indexes: DataFrame, shard: int) -> ItemIndex:
    row = indexes.where(F.col("shard") == shard).select("blob").first()
    return pickle.loads(row["blob"]) if row else ItemIndex([])


def route(source: DataFrame, indexes: DataFrame, shards: int, run: int, window: int, table_bytes: int = 256_000_000) -> Iterator[tuple[int, DataFrame]]:
    """(shard, texts) of the texts with a passage that can reach the threshold in the shard, judged by the terms' greatest impacts
    there. One reading of the corpus serves as many shards as have `table_bytes` of greatest impacts together."""
    spark = source.sparkSession
    group: list[tuple[int, pa.Array, np.ndarray]] = []
    held = 0
    for s in range(shards):
        index = _load(indexes, s)
        group.append((s, index.terms, index.bound))
        held += index.terms.nbytes + index.bound.nbytes
        if held < table_bytes and s + 1 < shards:
            continue
        shared = spark.sparkContext.broadcast(group)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, offsets, names = word_codes(batch.column(1).to_pylist())
                text, start, end = _passages(offsets, window, run)
                for shard, terms, bound in shared.value:
                    total = np.concatenate([[0.0], np.cumsum(bound[_known(names, terms)[codes]])])
                    hit = pa.array(np.unique(text[total[end] - total[start] >= 1 - 1e-6]), pa.int64())
                    if len(hit):
                        columns = [pa.array([shard] * len(hit), pa.int32()), *[c.take(hit) for c in batch.columns]]
                        yield pa.RecordBatch.from_arrays(columns, names=["shard", "i", "t"])

        path = scratch_path(spark, "routed")
        source.mapInArrow(work, "shard int, i bigint, t string").write.partitionBy("shard").parquet(path)
        routed = spark.read.schema("i bigint, t string, shard int").parquet(path)
        for shard, _, _ in group:
            yield shard, routed.where(F.col("shard") == shard).select("i", "t")
        group, held = [], 0


def _known(words_here: pa.Array, terms: pa.Array) -> np.ndarray:
    """The number of each word among the terms, their count for other words."""
    return pc.fill_null(pc.index_in(words_here, terms), len(terms)).to_numpy().astype(np.int64)


def _pass(source: DataFrame, shared, window: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            if not index.ids:
                continue
            codes, offsets, words_here = word_codes(batch.column(1).to_pylist())
            if not len(codes):
                continue
            terms = _known(words_here, index.terms)[codes]
            text, start, end = _passages(offsets, window, index.run)
            passage, item = retrieve(index, terms, start, end)
            rows = verify(index, terms, offsets, text[passage], start[passage], end[passage], item)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([index.ids[r[1]] for r in rows], pa.int64()),
                    *[pa.array([r[k] for r in rows], pa.int64()) for k in range(2, 5)],
                    pa.array([[{"first": k, "end": m} for k, m in r[5]] for r in rows], RANGES),
                ],
                names=["doc_id", "item_id", "start", "n_words", "item_start", "covered"],
            )

    return source.mapInArrow(work, PAIRS)


def verify(index: ItemIndex, terms: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> list[tuple]:
    """(text, item, start, n_words, item_start, covered) of the retrieved passages terms[start[i]:end[i]] whose words hold a run of
    the item, one for each text and item: the longest shared run, and the ranges of the item's words in all shared runs."""
    run = index.run
    at, of = ranges(start, end - run + 1)
    if not len(at):
        return []
    places, back = np.unique(at, return_inverse=True)
    spans = terms[places[:, None] + np.arange(run)]
    h = np.zeros(len(places), np.uint64)
    for k in range(run):
        h = (h ^ spans[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    low, high = np.searchsorted(index.run_hash, h, "left"), np.searchsorted(index.run_hash, h, "right")
    entry, pos = ranges(low[back], high[back])
    keep = index.run_item[entry] == item[of[pos]]
    entry, pos = entry[keep], pos[keep]
    here, its = at[pos], index.offsets[index.run_item[entry]] + index.run_at[entry]
    same = (terms[here[:, None] + np.arange(run)] == index.coded[its[:, None] + np.arange(run)]).all(axis=1)
    entry, here, owner = entry[same], here[same], text[of[pos[same]]]
    # Places of one text, item and distance that follow each other are one shared run.
    found = np.unique(np.stack([owner, index.run_item[entry], here - index.run_at[entry], here], axis=1), axis=0)
    if not len(found):
        return []
    joined = (np.diff(found[:, :3], axis=0) == 0).all(axis=1) & (np.diff(found[:, 3]) == 1)
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.append(first[1:], len(found)) - 1
    rows: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for a, b in zip(found[first].tolist(), found[last, 3].tolist(), strict=True):
        n = b - a[3] + run
        rows.setdefault((a[0], a[1]), []).append((n, a[3] - int(offsets[a[0]]), a[3] - a[2]))
    out = []
    for (t, i), runs in rows.items():
        n, s, k = min(runs, key=lambda r: (-r[0], r[1], r[2]))
        out.append((t, i, s, n, k, sorted({(r[2], r[2] + r[0]) for r in runs})))
    return out


def _covered(first, end):
    """How many of the item's words [first, end) lie in any of the ranges `covered`."""

    def step(s, r):
        more = F.least(r["end"], end) - F.greatest(r["first"], s["end"], first)
        return F.struct(F.greatest(s["end"], r["end"]).alias("end"), (s["n"] + F.greatest(more, F.lit(0))).alias("n"))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.array_sort("covered"), F.struct(zero.alias("end"), zero.alias("n")), step, lambda s: s["n"])


def overlap(found: DataFrame, items: DataFrame) -> DataFrame:
    """Adds what all shared runs together cover of the item: share of all its words, of the question (up to the last question
    mark; all of it if there is none) and of the answer (what follows; null if nothing does)."""
    texts = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropDuplicates(["item_id"])
    both = found.join(texts.mapInPandas(_sizes, "item_id bigint, n_item_words bigint, n_question_words bigint"), "item_id")
    size, asked, zero = F.col("n_item_words"), F.col("n_question_words"), F.lit(0).cast("bigint")
    answer = size - asked
    return both.select(
        *[c for c in found.columns if c != "covered"], "n_item_words", (_covered(zero, size) / size).alias("share"),
        F.when(asked > 0, _covered(zero, asked) / asked).alias("question_share"),
        F.when(answer > 0, _covered(asked, size) / answer).alias("answer_share"),
    )


def _sizes(frames):
    for f in frames:
        asked = [len(words(t[: t.rfind("?") + 1] if t and "?" in t else t)) for t in f["text"]]
        yield f.assign(n_item_words=[len(words(t)) for t in f["text"]], n_question_words=asked)[["item_id", "n_item_words", "n_question_words"]]
