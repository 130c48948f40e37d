"""Repetition inside a document, as a ledger of rule bits.

Every document gets one ledger row: the measurements of all rules and an integer with the bit of each rule it fails. A
policy is a version of which bits count and which exempt. A Ledger is a stored table of immutable versions: texts are measured
once, when their rows are recorded; policies are applied, compared and ablated by bitwise operations on what is stored, without
reading a text again.

Measured are the words (see text.words), the share of words that lie in a run of `run` words that also starts earlier in
the same text, and the share of characters in lines and in paragraphs that stand earlier in the text.
Defined results: null, empty and blank texts have no words and shares 0; texts of any length are measured whole; repeated
rows give repeated ledger rows; an empty table gives an empty ledger; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.text import word_codes
from quirefold.operators.changes import Manifest, VersionedTable
from quirefold.runtime import spread

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
LEDGER = "doc_id bigint, n_words bigint, run_share double, line_share double, paragraph_share double, bits int"
MEASURES = "doc_id bigint, n_words bigint, run_share double, line_share double, paragraph_share double"


@dataclass(frozen=True)
class Rule:
    """Fails (sets its bit) where `condition` holds of the measurements."""

    name: str
    bit: int
    condition: str


RULES = (
    Rule("short", 1, "n_words < 20"),
    Rule("runs", 2, "run_share >= 0.3"),
    Rule("lines", 4, "line_share >= 0.3"),
    Rule("paragraphs", 8, "paragraph_share >= 0.3"),
)


@dataclass(frozen=True)
class Policy:
    """A document is taken if it fails a rule of `any_of` and none of `unless`."""

    version: str
    any_of: tuple[str, ...]
    unless: tuple[str, ...] = ()


POLICIES = (Policy("1", ("runs",), ("short",)), Policy("2", ("runs", "lines", "paragraphs"), ("short",)))


def repeated_words(codes: np.ndarray, offsets: np.ndarray, run: int = 5) -> np.ndarray:
    """How many words of each text lie in a run of `run` words that also starts at an earlier word of it. Exact: runs are
    numbered by numbering pairs, not hashed."""
    n, texts = len(codes), len(offsets) - 1
    owner = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offsets))
    starts = n - run + 1
    if starts <= 0:
        return np.zeros(texts, np.int64)
    key, size = codes[:starts], int(codes.max()) + 1
    for k in range(1, run):
        key = pd.factorize(key * size + codes[k : k + starts])[0].astype(np.int64)
    inside = owner[:starts] == owner[run - 1 :]
    at = np.flatnonzero(inside)
    again = at[pd.Series(owner[at] * (int(key.max()) + 1) + key[at]).duplicated().to_numpy()]
    cover = np.zeros(n + 1, np.int32)
    cover[again] += 1
    cover[again + run] -= 1
    return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=texts)


def repeated_share(parts: list[str]) -> float:
    """The share of characters in parts that equal an earlier part; blank parts do not count."""
    seen, total, again = set(), 0, 0
    for p in parts:
        if p := p.strip():
            total += len(p)
            if p in seen:
                again += len(p)
            seen.add(p)
    return again / total if total else 0.0


def measure(df: DataFrame, id_col: str, text_col: str, run: int = 5) -> DataFrame:
    """MEASURES of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            codes, offsets, _ = word_codes(texts)
            n = np.diff(offsets)
            runs = repeated_words(codes, offsets, run) / np.maximum(n, 1)
            lines = [repeated_share(t.splitlines()) if t else 0.0 for t in texts]
            paragraphs = [repeated_share(_PARAGRAPH.split(t)) if t else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(runs), pa.array(lines, pa.float64()), pa.array(paragraphs, pa.float64())],
                names=["doc_id", "n_words", "run_share", "line_share", "paragraph_share"],
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    return spread(rows).mapInArrow(work, MEASURES)


def ledger(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds bits: each rule evaluated once."""
    bits = F.lit(0)
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.condition), r.bit).otherwise(0))
    return measures.withColumn("bits", bits)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    known = {r.name: r.bit for r in rules}
    return sum(known[n] for n in set(names))


def taken(policy: Policy, bits: Column, without: str = "", rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a policy takes a document, by its bits; `without`: as if this rule did not exist."""
    off = ~mask((without,), rules) if without else -1
    return (bits.bitwiseAND(F.lit(mask(policy.any_of, rules) & off)) != 0) & (
        bits.bitwiseAND(F.lit(mask(policy.unless, rules) & off)) == 0
    )


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, without_rule, n_docs): what each policy takes as it is (`none`) and without each rule. The ledger is first
    reduced to its bit patterns, at most two to the number of rules."""
    patterns = book.groupBy("bits").agg(F.count("*").alias("n"))
    cases = [
        F.struct(F.lit(p.version).alias("policy"), F.lit(w or "none").alias("without_rule"), taken(p, F.col("bits"), w, rules).alias("t"))
        for p in policies
        for w in ("", *(r.name for r in rules))
    ]
    rows = patterns.select("n", F.inline(F.array(*cases)))
    return rows.groupBy("policy", "without_rule").agg(F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("n_docs"))


class RulesChangedError(ValueError):
    """The stored bits were made by other rules."""


class Ledger:
    """A stored ledger below a folder that all executors reach; every record is a version, and all versions can be read."""

    def __init__(self, spark: SparkSession, root: str, rules: tuple[Rule, ...] = RULES) -> None:
        self.table, self.rules = VersionedTable(spark, root, LEDGER), rules

    def record(self, df: DataFrame, id_col: str, text_col: str) -> Manifest:
        """Measure new texts and add their rows; rows that are stored are not touched. RulesChangedError if the rules are not those
        of the rows stored before."""
        base, rules = self.table.latest(), [[r.name, r.bit, r.condition] for r in self.rules]
        if base.notes.get("rules", rules) != rules:
            raise RulesChangedError("start a new ledger for new rules")
        return self.table.append(ledger(measure(df, id_col, text_col), self.rules), {"rules": rules}, base)

    def rows(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def take(self, policy: Policy, version: int | None = None) -> DataFrame:
        """(doc_id) of the documents a policy takes."""
        return self.rows(version).where(taken(policy, F.col("bits"), rules=self.rules)).select("doc_id")

    def ablations(self, policies: tuple[Policy, ...] = POLICIES, version: int | None = None) -> DataFrame:
        return ablations(self.rows(version), policies, self.rules)
