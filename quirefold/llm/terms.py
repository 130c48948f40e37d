"""Frequency of every distinct term, by burst tries.

Each task counts its rows in a burst trie: terms lie in containers as suffixes of the container's prefix, and a container that
has grown too large bursts into one per next character. Tries leave the task as containers with their prefix. Then every task
reports which prefixes hold many of its terms, whether its containers have burst there or not; prefixes that are heavy over
all tasks are opened further, and the first prefix of a term that is not heavy is its route. So routes adapt to the terms, and
none holds more than `route_terms` local terms: a task reports a prefix from route_terms / (2 * tasks) terms on, hence what no
task reports adds up to route_terms / 2 at most, and a prefix is heavy if the reports reach the other half. Prefixes of
DEEPEST characters are not opened by the next character but by a hash. Containers are shuffled by route and matching subtrees
are merged route by route.

The driver receives heavy prefixes only, at most DEEPEST * 2 * (all local terms) / route_terms of DEEPEST characters.
Defined results: null terms and records are ignored, the empty term is a term, terms of any length, repeated rows count
as rows once each and as one record; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.runtime import materialize

#: Characters of the longest prefix that is a route; terms alike to there are routed by PIECES hashes.
DEEPEST, PIECES = 64, 64
LEAVES = "prefix string, suffixes array<string>, rows array<bigint>, records array<bigint>"
ROUTED = "route string, prefix string, suffixes array<string>, rows array<bigint>, records array<bigint>"
COUNTS = "term string, n_rows bigint, n_records bigint"


class _Node:
    __slots__ = ("bag", "kids")

    def __init__(self) -> None:
        self.bag: dict[str, int] = {}  # suffixes: places of their counters
        self.kids: dict[str, _Node] | None = None


class BurstTrie:
    """Counters of rows and records by term: the containers hold suffixes, the counters lie in two flat arrays."""

    def __init__(self, burst: int = 4096) -> None:
        self.burst, self.root = burst, _Node()
        self.rows, self.records = array("q"), array("q")

    def __len__(self) -> int:
        return len(self.rows)

    def add(self, term: str, rows: int, records: int) -> None:
        node, depth = self.root, 0
        while node.kids is not None and depth < len(term):
            kid = node.kids.get(term[depth])
            if kid is None:
                kid = node.kids[term[depth]] = _Node()
            node, depth = kid, depth + 1
        suffix = term[depth:] if depth else term
        at = node.bag.get(suffix)
        if at is not None:
            self.rows[at] += rows
            self.records[at] += records
            return
        node.bag[suffix] = len(self.rows)
        self.rows.append(rows)
        self.records.append(records)
        if node.kids is None and len(node.bag) > self.burst:
            self._burst(node)

    def _burst(self, first: _Node) -> None:
        todo = [first]
        while todo:
            node = todo.pop()
            node.kids, old, node.bag = {}, node.bag, {}
            for suffix, at in old.items():
                if suffix:
                    kid = node.kids.get(suffix[0])
                    if kid is None:
                        kid = node.kids[suffix[0]] = _Node()
                    kid.bag[suffix[1:]] = at
                else:
                    node.bag[suffix] = at  # it ends here
            todo += [kid for kid in node.kids.values() if len(kid.bag) > self.burst]

    def containers(self) -> Iterator[tuple[str, dict[str, int]]]:
        """Every container that holds something with its prefix, without recursion."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node.bag:
                yield prefix, node.bag
            for char, kid in (node.kids or {}).items():
                stack.append((prefix + char, kid))


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _leaves(trie: BurstTrie, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    prefixes: list[str] = []
    bags: list[dict[str, int]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        counters = [_lists([[c[at] for at in b.values()] for b in bags], pa.int64()) for c in (trie.rows, trie.records)]
        return pa.RecordBatch.from_arrays(
            [pa.array(prefixes, pa.string()), _lists([list(b) for b in bags], pa.string()), *counters], names=["prefix", "suffixes", "rows", "records"]
        )

    for prefix, bag in trie.containers():
        prefixes.append(prefix)
        bags.append(bag)
        held += len(bag)
        if held >= size:
            yield batch()
            prefixes, bags, held = [], [], 0
    if bags:
        yield batch()


def local_tries(df: DataFrame, burst: int, flush: int) -> DataFrame:
    """One trie per task (and per `flush` terms), as LEAVES. df: term, n_rows; one row per term and record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(burst)
        for batch in batches:
            # Equal terms of one batch enter the trie together.
            t = pa.Table.from_batches([batch]).group_by("term").aggregate([("n_rows", "sum"), ("n_rows", "count")])
            for term, n, k in zip(t["term"].to_pylist(), t["n_rows_sum"].to_pylist(), t["n_rows_count"].to_pylist(), strict=True):
                trie.add(term, n, k)
            if len(trie) > flush:
                yield from _leaves(trie)
                trie = BurstTrie(burst)
        yield from _leaves(trie)

    return df.select("term", F.col("n_rows").cast("bigint").alias("n_rows")).mapInArrow(run, LEAVES)


def prefix_weights(terms: pa.Array, least: float, deepest: int = DEEPEST) -> Iterator[tuple[str, int]]:
    """(prefix, terms) of every prefix that at least `least` of the terms have, the terms themselves being prefixes too."""
    if len(terms) >= least:
        yield "", len(terms)
    for depth in range(1, deepest + 1):
        terms = terms.filter(pc.greater_equal(pc.utf8_length(terms), depth))
        if len(terms) < max(least, 1):
            return
        heads = pc.utf8_slice_codeunits(terms, 0, depth).dictionary_encode()
        sizes = np.bincount(heads.indices.to_numpy(), minlength=len(heads.dictionary))
        large = sizes >= least
        if not large.any():
            return
        for i in np.flatnonzero(large).tolist():
            yield heads.dictionary[i].as_py(), int(sizes[i])
        terms = terms.filter(pa.array(large[heads.indices.to_numpy()]))


def heavy_prefixes(leaves: DataFrame, route_terms: int) -> set[str]:
    """Prefixes that may have more than `route_terms` terms over all local tries, and all they begin with."""
    tasks = max(1, leaves.rdd.getNumPartitions())
    least = route_terms / (2 * tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[pa.Array] = []
        for batch in batches:
            suffixes = batch.column(1)
            sizes = pc.list_value_length(suffixes).to_numpy(zero_copy_only=False)
            prefix = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            terms = pc.binary_join_element_wise(prefix, pc.list_flatten(suffixes), "")
            whole.append(pc.utf8_slice_codeunits(terms, 0, DEEPEST).cast(pa.large_string()))
        if whole:
            found = list(prefix_weights(pa.concat_arrays(whole), least))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["prefix", "n"]
            )

    reported = leaves.select("prefix", "suffixes").mapInArrow(run, "prefix string, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    return {r["prefix"] for r in reported.where(F.col("n") > route_terms / 2).select("prefix").collect()}


def route_of(term: str, heavy: set[str]) -> str | None:
    """The first prefix that is not heavy; None if all up to DEEPEST characters are, the term's own included."""
    for i in range(min(len(term), DEEPEST) + 1):
        if term[:i] not in heavy:
            return term[:i]
    return None


def routed(leaves: DataFrame, heavy: set[str]) -> DataFrame:
    """Containers by route. A container below a route goes there as a whole; others are divided."""

    def divide(x: dict) -> Iterator[tuple]:
        parts: dict[str, tuple[list, list, list]] = {}
        for suffix, n, k in zip(x["suffixes"], x["rows"], x["records"], strict=True):
            term = x["prefix"] + suffix
            route = route_of(term, heavy)
            if route is None:  # heavy to its end, or to the deepest prefix
                route = term if len(term) <= DEEPEST else f"{term[:DEEPEST]}{crc32(term.encode()) % PIECES}"
            to = parts.setdefault(route, ([], [], []))
            to[0].append(suffix), to[1].append(n), to[2].append(k)
        for route, (s, n, k) in parts.items():
            yield route, x["prefix"], s, n, k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                whole = route_of(x["prefix"], heavy)
                out += [(whole, *x.values())] if whole is not None else divide(x)
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["route", "prefix", "suffixes", "rows", "records"]
            )

    return leaves.mapInArrow(run, ROUTED)


def merged(containers: DataFrame, burst: int) -> DataFrame:
    """COUNTS: the subtrees of one route after another, each merged into one trie."""

    def result(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        for b in _leaves(trie):
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            prefix = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))
            terms = pc.binary_join_element_wise(prefix, pc.list_flatten(b.column(1)), "")
            yield pa.RecordBatch.from_arrays([terms, pc.list_flatten(b.column(2)), pc.list_flatten(b.column(3))], names=["term", "n_rows", "n_records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, trie = None, BurstTrie(burst)
        for batch in batches:
            for x in batch.to_pylist():
                if x["route"] != route:
                    yield from result(trie)
                    route, trie = x["route"], BurstTrie(burst)
                for suffix, n, k in zip(x["suffixes"], x["rows"], x["records"], strict=True):
                    trie.add(x["prefix"] + suffix, n, k)
        yield from result(trie)

    # A fixed number of tasks: merging costs by the term, so few bytes are no reason to put many routes into one.
    tasks = int(containers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return containers.repartition(tasks, "route").sortWithinPartitions("route").mapInArrow(run, COUNTS)


def term_counts(
    rows: DataFrame, record: str, term: str, n_rows: str | None = None, burst: int = 4096, flush: int = 400_000, route_terms: int = 200_000
) -> DataFrame:
    """COUNTS of every distinct term of `rows`: in how many rows and in how many records it stands.

    n_rows: a column with the number of rows a row stands for. burst, flush and route_terms bound containers, the trie of a
    task and the subtree of a route; they shape the work, not the result.
    """
    n = F.sum(n_rows) if n_rows else F.count("*")
    per_record = (
        rows.where(F.col(record).isNotNull() & F.col(term).isNotNull())
        .groupBy(F.col(record).alias("record"), F.col(term).alias("term"))
        .agg(n.alias("n_rows"))
    )
    leaves = materialize(local_tries(per_record, burst, flush), "tries")
    return merged(routed(leaves, heavy_prefixes(leaves, route_terms)), burst)


def with_marks(counts: DataFrame, n_all: int, rare: int = 2, common: float = 0.05) -> DataFrame:
    """Adds mark: `rare` in at most `rare` records, else `common` in more than the share `common` of `n_all`, else null."""
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > common * n_all, "common")
    return counts.withColumn("mark", mark)
