"""Encoding of a corpus with a public tokenizer, by a shuffle of its distinct words.

Texts are cut into pre-tokens in the JVM. Each task packs its documents into blocks: the distinct pre-tokens of the block, and
per document the positions as codes into them. Only the distinct words of blocks are shuffled; each distinct word of the
corpus is encoded once, its ids are joined back to the blocks, and every document is put together again by position. No word,
however frequent, stands in a block twice, so hot words do not gather; where blocks have few words, skew_join spreads them.

Decoding joins the table of token bytes. Defined results: null and empty texts have the empty list; text that looks like a
special token is plain text; texts of any length are encoded whole (a long text makes a block of its own); repeated rows are
encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators.skew import skew_join
from quirefold.runtime import materialize, spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that cuts texts into pre-tokens before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLOCKS = "block bigint, docs array<bigint>, sizes array<int>, codes binary, words array<string>"


def java_pattern(pattern: str = PATTERN) -> str:
    """The pattern for Java, where white space and its opposite have to be named as Unicode properties."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{IsWhite_Space}\p{L}\p{N}]")
    return inside.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


class Ranks:
    """A byte-level BPE, sent to the tasks as the content of its rank file (under a megabyte, whatever the corpus)."""

    def __init__(self, content: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def blocks(df: DataFrame, id_col: str, text_col: str, block_words: int = 1_000_000, pattern: str = PATTERN) -> DataFrame:
    """BLOCKS of at most about `block_words` pre-tokens (or one document), numbered by task and place within it."""

    def pack(ids: pa.Array, lists: pa.Array, number: Iterator[int]) -> Iterator[pa.RecordBatch]:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // block_words
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(sizes))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = pc.list_flatten(lists.slice(a, b - a)).dictionary_encode()
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([next(number)], pa.int64()),
                    one(ids.slice(a, b - a), pa.int64()),
                    one(pa.array(sizes[a:b]), pa.int32()),
                    pa.array([part.indices.to_numpy().astype("<u2" if len(part.dictionary) <= 65536 else "<u4").tobytes()], pa.binary()),
                    one(part.dictionary, pa.string()),
                ],
                names=["block", "docs", "sizes", "codes", "words"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            if batch.num_rows:
                ids, lists, odd = batch.columns
                if odd.null_count < len(odd):
                    pieces, last = [], 0
                    for at in np.flatnonzero(odd.is_valid().to_numpy(zero_copy_only=False)).tolist():
                        pieces += [lists.slice(last, at - last), pa.array([cut_here(odd[at].as_py(), pattern)], lists.type)]
                        last = at + 1
                    lists = pa.concat_arrays([*pieces, lists.slice(last)])
                yield from pack(ids, lists, number)

    # Characters that this Java does not know yet: their texts, and no others, are cut by the tokenizer's own library.
    text, newer = F.col(text_col), F.col(text_col).rlike(r"\p{Cn}")
    cut = F.when(~newer, F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0)))
    rows = spread(df.select(id_col, text_col))
    source = rows.select(F.col(id_col).cast("bigint").alias("i"), cut.alias("w"), F.when(newer, text).alias("t"))
    return source.mapInArrow(work, BLOCKS)


def cut_here(text: str, pattern: str = PATTERN) -> list[str]:
    """The pre-tokens of one text, by the library the tokenizers use."""
    import regex

    return regex.findall(pattern, text)


def encode_words(words: DataFrame, content: bytes, pattern: str = PATTERN) -> DataFrame:
    """(word, ids): each row of `words` encoded."""
    shared = words.sparkSession.sparkContext.broadcast(content)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(shared.value, pattern)
        for batch in batches:
            ids = [ranks.ids(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(work, "word string, ids array<int>")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            col = {n: batch.column(n) for n in batch.schema.names}
            docs, sizes = col["docs"][r].values, col["sizes"][r].values.to_numpy()
            entries = col["entries"][r].values
            if entries is None or not len(entries):
                codes = starts = lengths = values = np.zeros(0, np.int64)
            else:
                lists = entries.field("ids")
                order = np.argsort(entries.field("pos").to_numpy())
                values = pc.list_flatten(lists).to_numpy()
                n = pc.list_value_length(lists).to_numpy()
                starts, lengths = (np.cumsum(n) - n)[order], n[order]
                codes = np.frombuffer(col["codes"][r].as_py(), "<u2" if len(entries) <= 65536 else "<u4")
            n = lengths[codes].astype(np.int64)  # ids of each pre-token of the block
            ends = np.cumsum(n)
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            # The documents leave in parts, so that no batch grows beyond some million ids.
            cuts = np.append(np.flatnonzero(np.diff(bounds[:-1] // 2_000_000, prepend=-1)), len(docs))
            words_before = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                w = slice(int(words_before[a]), int(words_before[b]))
                m = n[w]
                at = np.repeat(starts[codes[w]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                offsets = pa.array((bounds[a : b + 1] - bounds[a]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(values[at].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), ids], names=["doc_id", "ids"])


def encode(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, ids) of every row."""
    packed = materialize(blocks(df, id_col, text_col, block_words), "blocks")
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(packed.select("block").count() / 8))
    placed = packed.select("block", F.posexplode("words").alias("pos", "word"))
    vocabulary = encode_words(placed.select("word").distinct(), rank_file(name, folder))
    joined = skew_join(placed, vocabulary, ["word"]).groupBy("block").agg(F.collect_list(F.struct("pos", "ids")).alias("entries"))
    whole = packed.select("block", "docs", "sizes", "codes").repartition(parts, "block").join(joined, "block", "left")
    return whole.select("docs", "sizes", "codes", "entries").mapInArrow(_assemble, "doc_id bigint, ids array<int>")


def token_bytes(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, bytes): the tokenizer's table, of fixed size."""
    rows = [(i, bytearray(b)) for b, i in Ranks(rank_file(name, folder)).ranks.items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text): ids back to text by joining the table of token bytes; the empty list gives the empty text.

    Documents of equal id count as one row each: rows are told apart before they are opened.
    """
    rows = encoded.select("doc_id", "ids").withColumn("r", F.monotonically_increasing_id())
    opened = materialize(rows, "ids").select("doc_id", "r", F.posexplode_outer("ids").alias("pos", "id"))
    table = F.broadcast(token_bytes(encoded.sparkSession, name, folder))  # some ten thousand rows, fixed
    byte_list = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("bytes").alias("h")))))
    grouped = opened.join(table, "id", "left").groupBy("doc_id", "r").agg(byte_list.alias("b"))
    return grouped.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("b", lambda x: x["h"]), "")), "UTF-8").alias("text"))
