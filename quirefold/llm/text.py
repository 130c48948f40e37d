"""What counts as a tag, and what as a word."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirefold.operators.skew import sized_join

_SPACE = re.compile(r"\s+")


def tag_form(tag: str | None) -> str | None:
    """Composed, lower case, white space of any kind one blank, without leading `#` and outer blanks; null stays null."""
    if tag is None:
        return None
    form = _SPACE.sub(" ", unicodedata.normalize("NFC", tag).lower()).strip()
    return form.lstrip("#").strip()


@F.pandas_udf(StringType())
def tag_forms(tags: pd.Series) -> pd.Series:
    return tags.map(tag_form, na_action="ignore")


#: ASCII bytes to a blank or to lower case; other bytes stay.
_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def plain(text: str | None) -> str:
    """The words of a text, with blanks between them: characters of category Cf dropped, composed, lower case, all that is
    no letter or digit blank. Null gives the empty string."""
    if not text:
        return ""
    if not text.isascii():
        if dropped := [c for c in set(text) if unicodedata.category(c) == "Cf"]:
            text = text.translate(dict.fromkeys(map(ord, dropped)))
        text = unicodedata.normalize("NFC", text).lower()
        for c in set(text):
            if c > "\x7f" and not c.isalnum():
                text = text.replace(c, " ")
    return text.encode().translate(_BYTES).decode().strip(" ")


def words(text: str | None) -> list[str]:
    """The words of a text, in order."""
    return plain(text).split()


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words of some texts as (codes, offsets, dictionary): text i has the words dictionary[codes[offsets[i]:offsets[i+1]]]."""
    lists = pc.ascii_split_whitespace(pa.array([plain(t) or None for t in texts], pa.large_string()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    encoded = pc.list_flatten(lists).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), offsets, encoded.dictionary


def tag_uses(document_tags: DataFrame, tags: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, form, n_rows): the distinct uses of tag forms by notes, with the rows that stand behind each.

    Rows whose note or tag does not exist, null keys and null tags give no use. Repeated rows are combined before any join;
    a tag or note with a large share of the rows is spread over many tasks.
    """
    rows = (
        document_tags.where("doc_id IS NOT NULL AND tag_id IS NOT NULL")
        .groupBy("doc_id", "tag_id")
        .agg(F.count("*").alias("n"))
    )
    forms = tags.select(F.col("id").alias("tag_id"), tag_forms("tag").alias("form")).where("form IS NOT NULL")
    known = notes.select(F.col("id").alias("doc_id")).where("doc_id IS NOT NULL")
    named = sized_join(sized_join(rows, forms, ["tag_id"]), known, ["doc_id"], "left_semi")
    return named.groupBy("doc_id", "form").agg(F.sum("n").alias("n_rows"))
