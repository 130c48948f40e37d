"""The store of documents: snapshots of a versioned table, each published as a whole.

put and update never change files that somebody reads; a new version becomes visible by one commit. Each version notes when it
was made and by what, which is the audit row of the store.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.operators.changes import ConflictError, Manifest, VersionedTable
from quirefold.runtime import materialize
from quirefold.schema import COLUMNS, DOC_SCHEMA, check_documents

SCALARS = ("doc_id", "title", "date", "filetime", "headings", "meta")
CHILDREN = ("authors", "tags", "links")


class DuplicatePathError(ValueError):
    """A path stands twice, or is stored already."""


def newest(staged: DataFrame) -> DataFrame:
    """One row per path: the one with the latest filetime (null: the earliest)."""
    order = Window.partitionBy("path").orderBy(F.col("filetime").desc_nulls_last(), *[F.col(c).desc() for c in staged.columns if c not in ("path", "filetime")])
    return staged.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def merge(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """What an update of `stored` by `staged` leaves: paths not staged are gone, new ones are in, scalars are the staged ones
    where the staged filetime is later, and the lists are the staged ones where the filetimes are then equal. Null filetimes
    are neither later nor equal. Both sides have one row per path."""
    old = stored.select("path", F.struct(*SCALARS, *CHILDREN).alias("o"))
    new = staged.select("path", F.struct(*SCALARS, *CHILDREN).alias("n"))
    both = new.join(old, "path", "left")
    later = F.col("o").isNull() | F.coalesce(F.col("n.filetime") > F.col("o.filetime"), F.lit(False))
    fresh = later | F.coalesce(F.col("n.filetime") == F.col("o.filetime"), F.lit(False))
    pick = lambda c, take: F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    # The surrogate of a stored document stays.
    scalars = [F.coalesce("o.doc_id", "n.doc_id").alias("doc_id"), *[pick(c, later) for c in SCALARS[1:]]]
    return both.select("path", *scalars, *[pick(c, fresh) for c in CHILDREN]).select(*COLUMNS)


class DocumentStore:
    """Documents below a folder that all executors reach.

    Every change reads one version, writes the rows it changes and a deletion vector of the rows they replace, and commits both
    as the version after the one it has read. If another writer was first, the change is made anew from what is there then.
    """

    def __init__(self, spark: SparkSession, root: str, tries: int = 5) -> None:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DOC_SCHEMA)
        self.table, self.tries = VersionedTable(spark, root, schema), tries

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).select(*COLUMNS)

    def _notes(self, what: str) -> dict:
        return {"last_update": what, "updated": datetime.now(timezone.utc).isoformat(timespec="seconds")}

    def _unique(self, docs: DataFrame) -> DataFrame:
        if not docs.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise DuplicatePathError("a path stands twice")
        return docs

    def _change(self, work: Callable[[Manifest], Manifest]) -> Manifest:
        for k in range(self.tries):
            try:
                return work(self.table.latest())
            except ConflictError:
                if k + 1 == self.tries:
                    raise
        raise ValueError("no tries")

    def put(self, docs: DataFrame, what: str = "put") -> Manifest:
        """Add documents; DuplicatePathError if a path is stored already. They are written once and looked through as written."""
        files = self.table.write_files(check_documents(docs).select(*COLUMNS).sortWithinPartitions("date"))
        try:
            written = self._unique(self.table.scan(files))

            def work(base: Manifest) -> Manifest:
                if not written.join(self.table.read(base).select("path"), "path", "left_semi").isEmpty():
                    raise DuplicatePathError("a path is stored already")
                return self.table.commit(base, files, notes=self._notes(what))

            return self._change(work)
        except Exception:
            self.table.discard(files)
            raise

    def update(self, staged: DataFrame, what: str = "update") -> Manifest:
        """Make the store equal what is staged (see merge)."""
        return self._upsert(staged, self._notes(what), True)

    def update_some(self, staged: DataFrame, notes: dict | None = None) -> Manifest:
        """Like update, but paths that are not staged stay."""
        return self._upsert(staged, {**self._notes("update_some"), **(notes or {})}, False)

    def _upsert(self, staged: DataFrame, notes: dict, whole: bool) -> Manifest:
        """Writes the staged rows that are new or change a stored one, and hides what they replace (with `whole`, also what is
        not staged): as many rows as change, however many are stored. A batch already noted is left out."""
        staged = self._unique(materialize(check_documents(staged).select(*COLUMNS), "staged"))

        def work(base: Manifest) -> Manifest:
            if "batch" in notes and base.notes.get("batch", -1) >= notes["batch"]:
                return base
            times = staged.select("path", F.col("filetime").alias("staged_time"), F.lit(True).alias("staged"))
            state = F.when(F.col("staged").isNull(), "gone").when(F.col("staged_time") >= F.col("filetime"), "changed").otherwise("same")
            met = self.table.positions(base).join(times, "path", "left" if whole else "inner").withColumn("state", state)
            # Only rows that change are carried on whole.
            row = F.when(F.col("state") == "changed", F.struct(*COLUMNS)).alias("o")
            met = materialize(met.select("path", "__file", "__row", "state", row), "met")
            old = met.where("state = 'changed'").select("o.*")
            kept = met.where("state <> 'gone'").select("path", "state")
            new = staged.join(kept, "path", "left").where("state IS NULL OR state = 'changed'").select(*COLUMNS)
            files = self.table.write_files(merge(old, new).sortWithinPartitions("date"))
            return self.table.commit(base, files, hide=self.table.write_deletes(met.where("state <> 'same'")), notes=notes)

        return self._change(work)

    def tidy(self, files: int | None = None, keep: int = 16, grace: float = 86400.0) -> Manifest:
        """Write the rows of the latest version anew, without hidden rows and small files, if it has any; then remove versions
        but the last `keep`, and files of no version that are older than `grace` seconds."""

        def work(base: Manifest) -> Manifest:
            if not base.deletes and len(base.files) <= (files or 1):
                return base
            docs = self.table.read(base).select(*COLUMNS)
            return self.table.replace(docs.coalesce(files) if files else docs.hint("rebalance"), self._notes("tidy"), base)

        done = self._change(work)
        self.table.expire(keep, grace)
        return done

    def info(self) -> dict:
        """Version, number of files, when and by what it was last changed."""
        m = self.table.latest()
        return {"version": m.version, "files": len(m.files), **m.notes}

    def authors(self) -> DataFrame:
        return self.read().select(F.explode("authors").alias("author")).distinct()

    def tags(self) -> DataFrame:
        return self.read().select(F.explode("tags").alias("tag")).distinct()
