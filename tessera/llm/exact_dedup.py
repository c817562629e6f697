"""Exact dedup against a persistent digest index.

The index is a folder of files bucketed and sorted by the SHA-256 of the normalised text. A batch is
aggregated by digest, anti-joined with the index by sort-merge (the index side needs no
shuffle: its buckets are the join's partitions), and its new digests are appended. A whole
table enters as batches of ascending ids, each met with what the ones before it left in the
index, so the smallest id of a text is the one that stays. All steps are DataFrame
operations; texts are read once, digests are what is shuffled.

Defined results: a null text counts as empty; empty texts are equal to each other; a null
doc_id sorts after every other; of rows that repeat the same doc_id and text one is kept;
very long texts are hashed whole; an empty batch gives no rows and appends nothing; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, delete, shared_dir, staged, text_or_empty, unstage


#: Batches that a whole table is dealt into.
BATCHES = 3
#: Digests of a bucket, some 100 MB of them, and the fewest buckets of an index.
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS = 8


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, ceil(rows / BUCKET_ROWS))


class DigestIndex:
    """The index in a folder of the shared file system: text_sha256, keep_id, keep_batch, keep_key.

    The folder is the index: another session, with another catalog, opens it by its path. It
    holds `digests`, the bucketed and sorted files, and `layout`, the number of buckets, which
    is fixed when the index is made (see buckets_for). A session knows the files as an external
    table under a name that follows from the path. A run that fails while it appends leaves the
    index as it was, and its batch may simply be added again.
    """

    FIELDS = "text_sha256 string, keep_id long, keep_batch string, keep_key long"

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "tessera_digests_" + hashlib.md5(self.path.encode()).hexdigest()
        layout = f"{self.path}/layout"
        if not _exists(spark, f"{layout}/_SUCCESS"):
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(layout)
        self.buckets = spark.read.parquet(layout).first()[0]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.FIELDS}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )
        spark.catalog.refreshTable(self.name)

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "text_sha256")
            .write.mode("append")
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .saveAsTable(self.name)
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)

    def append_new(self, digests: DataFrame, batch: str) -> None:
        """Appends the texts of a batch that the index doesn't hold, with their first row.

        digests has doc_id, text_sha256, row_key; batch is a name that no other batch has.
        """
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
        groups = digests.groupBy("text_sha256").agg(first)
        fresh = groups.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        # written first: the append must not read the table it writes to
        new = staged(fresh.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.lit(batch).alias("keep_batch"), F.col("first.row_key").alias("keep_key")), "fresh")
        self._append(new)
        unstage(new)

    def verdicts(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """One row per row of digests: doc_id, row_key, keep_id, group_size, kept, text_sha256.

        group_size counts the rows of digests. At most one row of a text is kept over all
        batches; with a batch name, rows are kept only if the text came with that batch.
        """
        sizes = digests.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
        known = staged(sizes.join(self.table().hint("merge"), "text_sha256"), "verdicts")
        ours = F.lit(True) if batch is None else F.col("keep_batch") == batch
        # both sides are shuffled here, so that adaptive execution splits a hot digest
        return digests.join(known, "text_sha256").select(
            "doc_id", "row_key", "keep_id", "group_size", ((F.col("row_key") == F.col("keep_key")) & ours).alias("kept"), "text_sha256"
        )

    def add(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None) -> DataFrame:
        """Appends a batch and returns its verdicts.

        row_key is row_column, which must tell rows apart, or else a number drawn here.
        keep_id is the smallest id of the text in the first batch that had it.
        """
        digests, batch = digested(docs, id_column, text_column, row_column), uuid.uuid4().hex
        self.append_new(digests, batch)
        return self.verdicts(digests, batch)


def digested(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None) -> DataFrame:
    """doc_id, text_sha256, row_key of each row, written once."""
    normal = F.regexp_replace(text_or_empty(text_column), SPACES, " ")
    key = F.col(row_column).cast("long") if row_column else F.monotonically_increasing_id()
    return staged(docs.select(F.col(id_column).alias("doc_id"), F.sha2(normal, 256).alias("text_sha256"), key.alias("row_key")), "digests")


def exact_duplicates(docs: DataFrame, row_column: str | None = None, batches: int = BATCHES) -> DataFrame:
    """The verdicts of a whole table, which enters an index of its own in batches.

    Batches are ranges of ids of about equal size, smallest ids first, null ids last. The
    index is dropped at the end; keep a DigestIndex where later data is to meet it.
    """
    spark = docs.sparkSession
    digests = digested(docs, row_column=row_column)
    about = digests.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("cuts")).first()
    index = DigestIndex(spark, f"{shared_dir(spark)}/tessera-index-{uuid.uuid4().hex}", buckets_for(about.n))
    cuts = [None, *sorted(set(about.cuts or [])), None]
    try:
        for low, high in zip(cuts, cuts[1:]):
            above = F.lit(True) if low is None else F.coalesce(F.col("doc_id") > low, F.lit(True))
            below = F.lit(True) if high is None else F.coalesce(F.col("doc_id") <= high, F.lit(False))
            index.append_new(digests.filter(above & below), f"ids to {high}")
        return index.verdicts(digests)
    finally:
        index.drop()
