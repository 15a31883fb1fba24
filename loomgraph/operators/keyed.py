"""Tables kept by key beside the graph: symbol documents, anchor inputs, summaries, projections, states, bookmarks.

They are all maintained alike. A table is a frame with a key and, where its rows belong to a file, that
file's id; every call gives a new table and leaves the old one as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.inventory import digest_by


@dataclass(frozen=True)
class Keyed:
    rows: DataFrame
    key: str = "node_id"
    file: str = "file_id"

    def _with(self, rows: DataFrame) -> Keyed:
        return replace(self, rows=rows.select(*self.rows.columns))

    def upsert(self, batch: DataFrame) -> Keyed:
        """Rows of the batch take the place of those with their key; of rows of one key in a batch the greatest stays."""
        rest = [c for c in self.rows.columns if c != self.key]
        last = batch.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("_r")).select(self.key, "_r.*")
        return self._with(self.rows.join(last.select(self.key), self.key, "left_anti").unionByName(last.select(*self.rows.columns)))

    def after(self, key: int, limit: int) -> DataFrame:
        """The page of the ``limit`` least keys above ``key``."""
        return self.rows.where(F.col(self.key) > key).orderBy(self.key).limit(limit)

    def by_keys(self, keys: DataFrame) -> DataFrame:
        return self.rows.join(keys.select(F.col(keys.columns[0]).alias(self.key)), self.key, "left_semi").select(*self.rows.columns)

    def cleared(self) -> Keyed:
        return self._with(self.rows.limit(0))

    def pruned_to(self, keys: DataFrame) -> Keyed:
        return self._with(self.by_keys(keys))

    def copied_from(self, other: Keyed, keys: DataFrame | None = None) -> Keyed:
        """With the rows of ``other`` (of some keys) whose keys are not here yet."""
        more = other.rows if keys is None else other.by_keys(keys)
        return self._with(self.rows.unionByName(more.select(*self.rows.columns).join(self.rows.select(self.key), self.key, "left_anti").select(*self.rows.columns)))

    def without_files(self, files: DataFrame, but: DataFrame | None = None) -> Keyed:
        """Without the rows of ``files`` (file id), those of the keys ``but`` apart."""
        gone = self.rows.join(files.select(F.col(files.columns[0]).alias(self.file)), self.file, "left_semi").select(self.key)
        if but is not None:
            gone = gone.join(but.select(F.col(but.columns[0]).alias(self.key)), self.key, "left_anti")
        return self._with(self.rows.join(gone, self.key, "left_anti"))

    def current(self, hashes: DataFrame) -> DataFrame:
        """Rows whose ``content_hash`` is still that of ``hashes`` (key, content_hash): what can be used again."""
        return self.rows.join(hashes.select(self.key, F.col("content_hash").alias("_h")), self.key).where(F.col("content_hash") == F.col("_h")).select(*self.rows.columns)

    def stats(self, column: str) -> DataFrame:
        return self.rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(self.file).alias("files"))

    def mismatched(self, column: str, contract: str) -> bool:
        """Whether a row was made under another contract."""
        return not self.rows.where(~F.col(column).eqNullSafe(F.lit(contract))).isEmpty()

    def manifest(self, *columns: str) -> DataFrame:
        """(group, n, digest) of the whole table, by which a publication is checked."""
        return digest_by(self.rows.withColumn("_all", F.lit("all")), "_all", self.key, *columns)


@dataclass(frozen=True)
class Annotations:
    """Bookmarks (bookmark, category, node_id, canonical_id, file_id, qualified_name, kind, signature, note) in categories (category, name)."""

    bookmarks: Keyed
    categories: Keyed

    def create_category(self, name: str) -> Annotations:
        if not name.strip() or not self.categories.rows.where(F.col("name") == name).isEmpty():
            raise ValueError("a category needs a name of its own")
        at = (self.categories.rows.agg(F.max("category")).first()[0] or 0) + 1
        return replace(self, categories=self.categories.upsert(self._rows(self.categories, [(at, name)])))

    def rename_category(self, category: int, name: str) -> Annotations:
        return replace(self, categories=self.categories.upsert(self._rows(self.categories, [(category, name)])))

    def delete_category(self, category: int) -> Annotations:
        """The category goes with its bookmarks."""
        keep = lambda t: t._with(t.rows.where(F.col("category") != category))
        return Annotations(keep(self.bookmarks), keep(self.categories))

    def add(self, category: int, anchors: DataFrame, note: str = "") -> Annotations:
        """A bookmark for each of ``anchors`` (node_id, canonical_id, file_id, qualified_name, kind, signature), numbered after those there."""
        at = self.bookmarks.rows.agg(F.max("bookmark")).first()[0] or 0
        from pyspark.sql import Window

        n = F.row_number().over(Window.orderBy("node_id"))
        new = anchors.withColumns({"bookmark": (n + at).cast("long"), "category": F.lit(category).cast("long"), "note": F.lit(note)})
        return replace(self, bookmarks=self.bookmarks.upsert(new.select(*self.bookmarks.rows.columns)))

    def noted(self, bookmark: int, note: str) -> Annotations:
        rows = self.bookmarks.rows
        return replace(self, bookmarks=self.bookmarks._with(rows.withColumn("note", F.when(F.col("bookmark") == bookmark, note).otherwise(F.col("note")))))

    def delete(self, bookmark: int) -> Annotations:
        return replace(self, bookmarks=self.bookmarks._with(self.bookmarks.rows.where(F.col("bookmark") != bookmark)))

    def rebound(self, anchors: DataFrame) -> Annotations:
        """Each bookmark at the node that it means now, without a node where none or several could be meant."""
        from loomgraph.operators.inventory import rebind

        now = rebind(self.bookmarks.rows, anchors).select("bookmark", F.col("node_id").alias("_now"))
        return replace(self, bookmarks=self.bookmarks._with(self.bookmarks.rows.join(now, "bookmark").withColumn("node_id", F.col("_now"))))

    @staticmethod
    def _rows(table: Keyed, rows: list[tuple]) -> DataFrame:
        return table.rows.sparkSession.createDataFrame(rows, table.rows.schema)
