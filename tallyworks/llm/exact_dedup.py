"""Exact duplicates against a persistent index of text digests, bucketed and sorted by digest.

The index is a Parquet table with one row per text that was ever loaded. A load reduces its texts to one row
per digest, finds the digests the index does not have by a sort-merge anti-join, for which the index is read bucket
by bucket without a shuffle, and appends them. What a load keeps is read back from the index, so a load that is
tried again after a failure appends only what is missing and decides as before.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.shared import discard, stored

ROWS_PER_BUCKET = 4_000_000  # of 40 bytes each: what one task sorts
LEAST_BUCKETS = 8
HOT_SHARE = 1000  # a text with more than one in so many rows is hot, so there are fewer hot texts than this


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """Digests of all texts loaded so far, in ``buckets`` buckets at ``path``.

    Columns: digest binary, keep_id bigint (the document that was kept), load string (what brought it).
    One load writes at a time; any number may read.
    """

    spark: SparkSession
    path: str
    name: str

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """The index at a path, which is made if there is none. The number of buckets belongs to the files: always
        give the one it was made with, or ``rebuild`` it with another."""
        name = f"digests_{uuid.uuid4().hex}"
        quoted = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, load STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{quoted}'"
        )
        return DigestIndex(spark, path, name)

    @property
    def buckets(self) -> int:
        rows = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").collect()
        return int(re.sub(r"\D", "", rows[0]["data_type"]))

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, digests: DataFrame, load: str) -> None:
        """Add the (digest, keep_id) that the index does not have yet; digests must be distinct."""
        known = self.table().select("digest").hint("merge")
        missing = digests.join(known, "digest", "left_anti").select("digest", "keep_id", F.lit(load).alias("load"))
        # One task per bucket, so that a load adds at most one file to each.
        missing.repartition(self.buckets, "digest").write.insertInto(self.name)

    def rebuild(self, path: str, buckets: int) -> DigestIndex:
        """The same index at another path, one sorted file per bucket; after many loads, or for more buckets."""
        other = DigestIndex.open(self.spark, path, buckets)
        self.table().repartition(buckets, "digest").sortWithinPartitions("digest").write.insertInto(other.name)
        return other

    def close(self) -> None:
        """Forget the table's name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets_for(rows: int) -> int:
    """Buckets of at most ``ROWS_PER_BUCKET`` digests each, as a power of two."""
    return max(LEAST_BUCKETS, 1 << max(0, -(-rows // ROWS_PER_BUCKET) - 1).bit_length())


def _hashed(docs: DataFrame) -> DataFrame:
    """A row's digest and number. Numbers hold only once the rows are written."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_digest(F.col("text")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def _per_text(hashed: DataFrame) -> DataFrame:
    """Every digest once, with the row that is kept: the largest doc_id, of equal ones the last row."""
    top = F.max(F.struct("doc_id", "row"))
    return hashed.groupBy("digest").agg(top.alias("top"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size"
    )


def load_documents(docs: DataFrame, load: str, index: DigestIndex | None = None, path: str | None = None) -> DataFrame:
    """What a load does with every row of ``docs`` (doc_id, text, anything else).

    Returns doc_id, keep_id, group_size (rows of this load with the same text), kept, text_sha256. Of equal texts
    the row with the largest doc_id stays (a null id is the least; of rows that repeat the id too, one), unless an
    earlier load has the text: then none does, and keep_id is the earlier document's. A null text is empty, and
    empty texts equal each other. No rows give no rows. Without an index a new one is made at ``path``, its buckets
    following from the number of texts.

    The digests of the rows are written once. Equal texts meet only as aggregates, combined before the shuffle;
    a text with more than one in ``HOT_SHARE`` rows is broadcast back to its rows, of which there are fewer than
    ``HOT_SHARE``, and the others are joined.
    """
    spark = docs.sparkSession
    hashed = stored(_hashed(docs), "digests")
    texts = stored(_per_text(hashed), "texts")
    total, distinct = texts.agg(F.sum("group_size"), F.count(F.lit(1))).first()
    if index is None:
        if path is None:
            raise ValueError("give an index or a path for a new one")
        index = DigestIndex.open(spark, path, buckets_for(distinct))
    index.append(texts.select("digest", "keep_id"), load)

    entries = index.table().select("digest", F.col("keep_id").alias("first_id"), "load").hint("merge")
    here = F.col("load") == F.lit(load)
    decided = stored(
        texts.join(entries, "digest").select(
            "digest", F.col("first_id").alias("keep_id"), "group_size", F.when(here, F.col("keep_row")).alias("keep_row")
        ),
        "decided",
    )
    hot = decided.where(F.col("group_size") > (total or 0) // HOT_SHARE)
    by_hot = hashed.join(F.broadcast(hot), "digest", "left")
    shared = by_hot.where("group_size is null").select("doc_id", "digest", "row")
    rare = decided.where(F.col("group_size") <= (total or 0) // HOT_SHARE)
    rows = by_hot.where("group_size is not null").unionByName(shared.join(rare, "digest"))
    result = stored(
        rows.select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        ),
        "dedup",
    )
    discard(hashed, texts, decided)
    return result


def new_documents(docs: DataFrame, load: str, index: DigestIndex) -> DataFrame:
    """Rows of ``docs`` that the load keeps, with all their columns.

    As ``load_documents``; rows equal in id and text are one row here, whichever of them. Texts move once, by
    digest and id, so that a text with very many copies is spread by their ids.
    """
    decisions = load_documents(docs, load, index).where("kept")
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}  # no clash with columns of the same name
    renamed = docs.toDF(*names.values()).withColumns(
        {"digest": text_digest(F.col(names["text"])), "id": F.col(names["doc_id"]).cast("bigint")}
    )
    kept = decisions.select(F.unhex("text_sha256").alias("kept_digest"), F.col("doc_id").alias("kept_id"))
    same = (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id"))
    rows = renamed.dropDuplicates(["digest", "id"]).join(kept, same, "left_semi")
    return rows.select(*[F.col(short).alias(name) for name, short in names.items()])
