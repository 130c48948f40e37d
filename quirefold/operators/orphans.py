"""References to records that do not exist, by bitmaps.

Keys are integers (or are encoded by a dictionary). A set of keys is held as bitmap words: the key range `key >> 6` and a
64-bit word; empty ranges are not stored, which is what compresses them. References are held per period. References
AND-NOT parents leaves the orphans, decoded again from the surviving bits. Repeated references and hot keys collapse into
one bit before the shuffle, so no key can be too large for a task.

Defined results: a null key is no reference; empty tables give no orphans or, as parents, make every reference one;
repeated rows count once; texts may have any length; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.skew import sized_join, skew_join
from quirefold.runtime import materialize


def bitmap_words(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """(by..., key_range, word): the keys of `df` as 64-bit words, one row per range that is not empty."""
    k = F.col(key)
    one = F.expr(f"shiftleft(1L, cast(`{key}` & 63 AS int))")
    return (
        df.where(k.isNotNull())
        .groupBy(*(by or []), F.shiftright(k, 6).alias("key_range"))
        .agg(F.bit_or(one).alias("word"))
    )


def and_not(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The words of `refs` without the bits of `parents`; words that become empty are dropped."""
    p = parents.select("key_range", F.col("word").alias("p_word"))
    left = refs.join(p, "key_range", "left")
    word = F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("p_word", F.lit(0).cast("bigint"))))
    return left.withColumn("word", word).drop("p_word").where(F.col("word") != 0)


def decode(words: DataFrame, key: str) -> DataFrame:
    """One row per bit that is set, with the key it stands for."""
    bits = F.expr("filter(sequence(0, 63), b -> shiftright(word, b) & 1 = 1)")
    rest = [c for c in words.columns if c not in ("key_range", "word")]
    return words.select(*rest, "key_range", F.explode(bits).alias("b")).select(
        *rest, (F.shiftleft("key_range", 6).cast("bigint") + F.col("b")).alias(key)
    )


def dictionary(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Distinct texts with an integer each, contiguous within a partition. Written to the shared folder, so that ids
    stay the same when an executor is lost."""
    distinct = df.select(text_col).where(F.col(text_col).isNotNull()).distinct()
    return materialize(distinct.withColumn(id_col, F.monotonically_increasing_id()), "dictionary")


def month_of(ts: Column) -> Column:
    """`yyyy-MM`, or `unknown` for null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("unknown"))


def names_path(link: Column) -> Column:
    """Whether a link names a path: not null, not blank, not `#...`, `//...` and without a scheme."""
    bare = F.regexp_replace(link, r"^[ \t]+|[ \t]+$", "")
    return (bare != "") & ~bare.rlike(r"^(#|//|[A-Za-z][A-Za-z0-9+.\-]*:)")


def with_target(df: DataFrame, link: str = "link", own_path: str = "own_path") -> DataFrame:
    """Adds target: the path a link names, seen from the note at `own_path`; null if it names none.

    Outer blanks and tabs do not count; null, blank, `#...`, `//...` and links with a scheme name no path. Cut from the
    first `#` or `?`, percent escapes decoded as UTF-8 (a `%` without two hex digits stands for itself, bytes that are no
    UTF-8 become U+FFFD), `.`, `..` and empty steps resolved; `..` at the top stays at the top.

    Each step is a projection of its own, so that nothing is worked out twice. Links of some steps up and then plain steps, which
    most are, take no loop.
    """
    bare, cut, plain, base, lead, rest = (F.col(f"__{c}") for c in ("bare", "cut", "plain", "base", "lead", "rest"))
    escaped = F.regexp_replace(F.regexp_replace(cut, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    folder = F.split(F.col(own_path), "/")
    none = F.array().cast("array<string>")
    ups = ((F.length(lead) - F.length(F.replace(lead, F.lit("../"), F.lit("")))) / 3).cast("int")
    straight = F.concat(F.slice(base, F.lit(1), F.greatest(F.size(base) - ups, F.lit(0))), F.array(rest))
    resolved = F.aggregate(
        F.concat(base, F.split(plain, "/")),
        none,
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    out = df.withColumn("__bare", F.regexp_replace(link, r"^[ \t]+|[ \t]+$", ""))
    out = out.withColumn("__cut", F.when(names_path(bare), F.regexp_replace(bare, r"(?s)[#?].*$", "")))
    out = out.withColumn("__plain", F.when(cut.contains("%"), F.url_decode(escaped)).otherwise(cut))
    out = out.withColumn("__base", F.when(plain.isNotNull(), F.when(plain.startswith("/"), none).otherwise(F.slice(folder, F.lit(1), F.size(folder) - 1))))
    out = out.withColumn("__lead", F.regexp_extract(plain, r"^/?((?:\.\.?/)*)", 1))
    out = out.withColumn("__rest", F.substring(plain, F.length("__lead") + F.when(plain.startswith("/"), 2).otherwise(1), F.length(plain)))
    out = out.withColumn("__simple", ~F.concat_ws("/", base, rest).rlike(r"(^|/)\.{0,2}(/|$)"))
    target = F.when(base.isNotNull(), F.array_join(F.when(F.col("__simple"), straight).otherwise(resolved), "/"))
    return out.withColumn("target", target).select(*df.columns, "target")


def orphans(links: DataFrame, notes: DataFrame, scans: DataFrame) -> DataFrame:
    """Distinct (doc_id, link, lacking, fate, noted_month) of links whose note or whose target does not exist.

    links: doc_id, link, noted_at. notes: id, path. scans: path (names that come later).
    """
    refs = (
        links.where("doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "link", month_of(F.col("noted_at")).alias("noted_month"))
        .distinct()
    )
    refs = materialize(refs, "refs")
    own = notes.select(F.col("id").cast("bigint").alias("doc_id"), F.col("path").alias("own_path")).where("doc_id IS NOT NULL")
    # The side of the note: references AND-NOT notes, per month. What is written has a size the planner knows: few orphans are
    # broadcast, many are joined by shuffles.
    gone = decode(and_not(bitmap_words(refs, "doc_id", ["noted_month"]), bitmap_words(own, "doc_id")), "doc_id")
    no_doc = sized_join(refs, materialize(gone, "gone"), ["doc_id", "noted_month"]).select(
        "doc_id", "link", F.lit("doc").alias("lacking"), F.lit("missing").alias("fate"), "noted_month"
    )
    # The side of the target: paths become integers, then the same. Each path and month goes in once.
    # What names no path leaves before the join; a condition on the target itself would have it worked out twice.
    placed = with_target(skew_join(refs.where(names_path(F.col("link"))), own.where("own_path IS NOT NULL"), ["doc_id"]))
    placed = materialize(placed.drop("own_path"), "targets")
    used = materialize(placed.select("target", "noted_month").distinct(), "used")
    ids = dictionary(used, "target", "target_id")
    known = ids.join(notes.select(F.col("path").alias("target")).where("target IS NOT NULL"), "target", "left_semi")
    later = ids.join(scans.select(F.col("path").alias("target")).where("target IS NOT NULL").distinct(), "target", "left_semi")
    lost = and_not(bitmap_words(used.join(ids, "target"), "target_id", ["noted_month"]), bitmap_words(known, "target_id"))
    late = bitmap_words(later, "target_id").select("key_range", F.col("word").alias("late_word"))
    split = lost.join(late, "key_range", "left").withColumn("late_word", F.coalesce("late_word", F.lit(0).cast("bigint")))
    fates = F.array(
        F.struct(F.lit("late").alias("fate"), F.col("word").bitwiseAND(F.col("late_word")).alias("word")),
        F.struct(F.lit("missing").alias("fate"), F.col("word").bitwiseAND(F.bitwise_not("late_word")).alias("word")),
    )
    words = split.select("noted_month", "key_range", F.inline(fates)).where("word <> 0")
    dead = materialize(decode(words, "target_id").join(ids, "target_id").drop("target_id"), "dead")
    no_target = sized_join(placed, dead, ["target", "noted_month"]).select(
        "doc_id", "link", F.lit("target").alias("lacking"), "fate", "noted_month"
    )
    return no_doc.unionByName(no_target)


def by_month(found: DataFrame) -> DataFrame:
    """Orphans per side, fate and month."""
    return found.groupBy("lacking", "fate", "noted_month").agg(F.count("*").alias("n_orphans"))
