"""A stored postings table for sparse search, with the largest count of each block.

Documents of similar length form a block; a row of the table is a term in a block: the ids
that hold it, how often, and the largest of these counts. Rows lie in folders by a hash of
the term, sorted by it, so a search reads the folders and row groups of its own terms; the
corpus is tokenised once, when the table is built.

A document's score is at most the sum of its query's weights times its block's largest
counts. A query scores its most promising blocks, and then each other block whose sum reaches
the k-th score found; the rest is skipped, and the result is that of a search of everything.
All steps are joins and aggregates; frequent terms are split over blocks.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import retrieval as rt
from tessera.operators.sparse import WORDS, query_terms
from tessera.shared import staged, unstage

#: Documents of a block, about, and folders of the table.
BLOCK_DOCS = 128
FOLDERS = 16


class PostingsIndex:
    """The index in a folder: `terms` (term, df), `total` (n) and `postings`."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = WORDS):
        self.spark, self.path, self.pattern = spark, path.rstrip("/"), pattern
        self.blocks = self.scored = 0  # (query, block) pairs of the last search: with a common term, and scored

    @classmethod
    def build(cls, docs: DataFrame, path: str, pattern: str = WORDS, prune: float | None = None, block_docs: int = BLOCK_DOCS, folders: int = FOLDERS) -> PostingsIndex:
        """Writes the postings of docs (id, text) to a fresh folder.

        With prune, the smallest share of each document's weights is left out, as
        retrieval.sparse_prune does; frequencies count all documents nevertheless. Null texts
        are empty; rows without an id take no part but are counted.
        """
        spark, path = docs.sparkSession, path.rstrip("/")
        # a class of length is a step of an eighth of a power of two: a few hundred at most
        length = F.floor(8 * F.log2(F.sum("tf").over(Window.partitionBy("id")))).cast("int")
        tf = staged(rt.term_weights(docs.select(F.col("id").alias("doc_id"), "text"), pattern=pattern).withColumn("length", length), "tf")
        total = docs.agg(F.count("*").alias("n"))
        total.write.parquet(f"{path}/total")
        tf.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        kept = tf.filter("id is not null")
        if prune is not None:
            weighted = rt.sparse_prune(rt.tf_idf(tf, spark.read.parquet(f"{path}/total"), ("tf",)), prune)
            kept = staged(weighted.filter("id is not null").select("id", "term", "tf").withColumn("length", length), "kept")
        sizes = kept.groupBy("length").agg(F.countDistinct("id").alias("size"))
        placed = kept.join(F.broadcast(sizes), "length")  # a row per class
        block = F.shiftleft(F.col("length").cast("long"), 32) + F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block_docs))
        rows = placed.select("id", "term", "tf", block.alias("block"))
        postings = rows.groupBy("term", "block").agg(F.collect_list(F.struct("id", "tf")).alias("held"), F.max("tf").alias("most"))
        stored = postings.select("term", "block", F.col("held.id").alias("ids"), F.col("held.tf").alias("tfs"), "most", _folder("term", folders).alias("folder"))
        stored.repartitionByRange("folder", "term", "block").sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{path}/postings")
        unstage(tf, kept if prune is not None else None)
        spark.createDataFrame([(folders,)], "folders int").write.parquet(f"{path}/layout")
        return cls(spark, path, pattern)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id, term, weight, folder: counts in the query times ln(1 + n / df)."""
        n = self.spark.read.parquet(f"{self.path}/total")
        folders = self.spark.read.parquet(f"{self.path}/layout").first()[0]
        known = query_terms(queries, self.pattern).join(self.spark.read.parquet(f"{self.path}/terms"), "term")
        weight = F.col("tf") * F.log1p(F.col("n") / F.col("df"))
        return known.crossJoin(F.broadcast(n)).select("query_id", "term", weight.alias("weight"), _folder("term", folders).alias("folder"))  # one row

    def search(self, queries: DataFrame, k: int, decimals: int = 6, first: int = 4) -> DataFrame:
        """query_id, id, score, rank, as sparse_topk gives them. queries has query_id, text.

        `first` blocks are scored before a query's k-th score is taken for the others' bound.
        """
        if "postings" not in self._parts():
            kind = queries.schema["query_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, id long, score double, rank int")
        asked = staged(self.asked(queries), "asked")
        on = ["folder", "term"]
        most = F.sum(F.col("weight") * F.col("most")).alias("bound")
        bounds = staged(asked.join(self.postings().select(*on, "block", "most"), on).groupBy("query_id", "block").agg(most), "bounds")

        def scored(chosen: DataFrame) -> DataFrame:
            met = asked.join(chosen.select("query_id", "block"), "query_id")
            hits = met.join(self.postings().drop("most"), [*on, "block"]).select("query_id", "weight", F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
            sums = hits.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.round(F.sum(F.col("weight") * F.col("p.tfs")), decimals).alias("score"))
            return sums.filter("score > 0")

        best = staged(rt.ranked(scored(rt.ranked(bounds, first, "bound", tie="block")), k), "best")
        kth = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        rest = rt.ranked(bounds, 2**31 - 1, "bound", tie="block").filter(F.col("rank") > first).join(kth, "query_id", "left")
        slack = 1e-9 * F.col("bound") + 10.0**-decimals  # for sums in another order, and for rounding
        rest = staged(rest.filter((F.coalesce("n", F.lit(0)) < k) | (F.col("bound") + slack >= F.col("kth"))).select("query_id", "block"), "rest")
        found = staged(rt.ranked(best.drop("rank").unionByName(scored(rest)), k), "found")
        self.blocks = bounds.count()
        self.scored = rest.count() + rt.ranked(bounds, first, "bound", tie="block").count()
        unstage(asked, bounds, best, rest)
        return found

    def _parts(self) -> set[str]:
        """Parts of the index that hold files; one of no documents has no postings."""
        spark = self.spark
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings/folder=*"))
        return {"postings"} if files else set()


def _folder(term: str, folders: int):
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")
