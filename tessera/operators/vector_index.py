"""A stored inverted file for inner-product search.

Cells are the nearest of about sqrt(N) centres, fitted by k-means on a bounded sample. All
vectors are written once, packed, one folder per cell; a cell's number of vectors and radius
stand beside its packs and are read without them. Vectors of another length than the index's
lie in a cell of that length, without a bound.

No vector of a cell scores above q.c + |q| r. A query meets its cells in the order of this
bound, in waves; in each wave only the folders of the cells that are met are read, and a
query stops once no cell left can hold a vector as good as its k-th. So the result is that of
a search of everything. With `probes` a query stops after that many cells at the latest, and
the result may miss some.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dense import asking, best_of, matrix, pack, products
from tessera.shared import staged, unstage

#: Vectors that centres are fitted on, and cells of an index, at most. Both bound what is broadcast.
SAMPLE = 50_000
MOST_CELLS = 16_384


class VectorIndex:
    """The index in a folder: `centres` and `vectors`. Made by build; later sessions open it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        centres = spark.read.parquet(f"{self.path}/centres")
        self.kind = centres.schema["ids"].dataType.elementType.simpleString()
        rows = centres.orderBy("cell").collect()  # MOST_CELLS at most
        self.centres = np.array([r.centre for r in rows], dtype=np.float64)
        self.dim = self.centres.shape[1] if len(rows) else 0
        self.scored = 0  # pairs that the last search scored

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> VectorIndex:
        """Fits centres and writes all vectors (id, vec) to a fresh folder."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        path = path.rstrip("/")
        sizes = vectors.groupBy(F.size("vec").alias("dim")).count().filter("dim > 0")
        most = sizes.orderBy(F.desc("count"), "dim").first()
        centres: list[list[float]] = []
        if most is not None:
            broken = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            good = vectors.filter((F.size("vec") == most.dim) & ~broken)
            bounded = good.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
            k = min(cells or ceil(sqrt(most["count"])), MOST_CELLS, sample)
            if not good.isEmpty():
                centres = [c.tolist() for c in KMeans(k=max(2, k), seed=seed, maxIter=10).fit(bounded).clusterCenters()]
        rows = [(i, c, None) for i, c in enumerate(centres)]
        kind = vectors.schema["id"].dataType.simpleString()  # kept in the files' schema, for an index without vectors
        spark.createDataFrame(rows, f"cell int, centre array<double>, ids array<{kind}>").coalesce(1).write.parquet(f"{path}/centres")
        index = cls(spark, path)
        index.append(vectors)
        return index

    def append(self, vectors: DataFrame) -> None:
        """Adds vectors to the cells of their nearest centres."""
        assigned = self._assigned(vectors).repartitionByRange("cell", "id").sortWithinPartitions("cell")
        packs = pack(assigned, "id", "vec", cell="cell", least="apart")
        stored = packs.select("cell", "dim", "ids", "data", F.array_max("least").alias("radius"), F.size("ids").alias("n"))
        stored.write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def _assigned(self, vectors: DataFrame) -> DataFrame:
        """id, vec, cell, apart: the nearest centre and the distance to it."""
        kind = vectors.schema["id"].dataType.simpleString()
        shipped = self.spark.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shipped.value
            for batch in batches:
                lengths = pc.fill_null(pc.list_value_length(batch.column("vec")), 0).to_numpy().astype(np.int64)
                cell, apart = -lengths, np.full(batch.num_rows, np.inf)
                if len(centres):
                    at, flat = matrix(batch.column("vec"), centres.shape[1])
                    near = np.argmin((centres**2).sum(axis=1) - 2 * flat @ centres.T, axis=1) if len(at) else np.zeros(0, np.int64)
                    cell[at], apart[at] = near, np.sqrt(((flat - centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(cell, pa.int32()), pa.array(apart)], names=["id", "vec", "cell", "apart"])

        rows = vectors.filter("id is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
        return rows.mapInArrow(run, f"id {kind}, vec array<double>, cell int, apart double")

    def packs(self) -> DataFrame:
        schema = f"dim int, ids array<{self.kind}>, data binary, radius double, n int, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        """cell, n, radius of every cell that holds vectors; the vectors are not read."""
        return self.packs().groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("dim").alias("dim"))

    def _met(self, asked: DataFrame, known: list, start: int, stop: int) -> DataFrame:
        """query_id, vec, least, cell: the cells in places start to stop of each query's order
        whose bound reaches `least`."""
        own = [r for r in known if r.cell >= 0]
        cell = np.array([r.cell for r in own], dtype=np.int64)
        shipped = self.spark.sparkContext.broadcast((self.centres[cell] if len(own) else np.zeros((0, self.dim)), np.array([r.radius for r in own]), cell, {r.dim: r.cell for r in known if r.cell < 0}))
        kind = asked.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radius, cells, others = shipped.value
            dim = centres.shape[1]
            lengths = np.sqrt((centres**2).sum(axis=1))
            for batch in batches:
                rows, found = [], []
                at, flat = matrix(batch.column("vec"), dim) if dim else (np.zeros(0, np.int64), None)
                least = batch.column("least").to_numpy(zero_copy_only=False)
                step = max(1, 1_000_000 // max(1, len(cells)))
                for first in range(0, len(at) if len(cells) else 0, step):
                    some, own = flat[first : first + step], at[first : first + step]
                    near = np.zeros((len(some), len(cells)))
                    for d in range(dim):  # sums in one order, so that every wave sees the same bounds
                        near += some[:, d : d + 1] * centres[:, d]
                    size = np.sqrt(np.cumsum(some**2, axis=1)[:, -1:])
                    bound = near + size * radius + 1e-9 * size * (lengths + radius)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
                    q, place = np.nonzero(np.take_along_axis(bound, order, axis=1) >= least[own][:, None])
                    rows.append(own[q])
                    found.append(cells[order[q, place]])
                if start == 0:
                    sizes = pc.fill_null(pc.list_value_length(batch.column("vec")), 0).to_numpy()
                    for size, cell in others.items():
                        rows.append(np.flatnonzero(sizes == size))
                        found.append(np.full(len(rows[-1]), cell))
                if rows:
                    taken = batch.take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(found), pa.int32())], names=["query_id", "vec", "least", "cell"])

        return asked.select("query_id", "vec", "least").mapInArrow(run, f"query_id {kind}, vec array<double>, least double, cell int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, first: int = 8) -> DataFrame:
        """query_id, id, score, rank, as dense_topk gives them. queries has query_id, query_vec.

        The first wave meets `first` cells, each later one twice as many as the one before.
        """
        known = self.cells().collect()  # a row per cell
        last = min(probes or len(known), len(known))
        asked = staged(queries.filter("query_id is not null").select("query_id", F.col("query_vec").cast("array<double>").alias("vec")), "asked")
        best, start, width, sizes = None, 0, first, {r.cell: r.n for r in known}
        self.scored = 0
        while start < last:
            if best is None:
                alive = asked.withColumn("least", F.lit(float("-inf")))
            else:
                kth = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
                alive = asked.join(kth, "query_id", "left").withColumn("least", F.when(F.col("n") >= k, F.col("kth")).otherwise(float("-inf")))
            met = self._met(alive, known, start, min(start + width, last)).repartition("cell", F.pmod(F.xxhash64("query_id"), F.lit(16)))
            wave = staged(pack(met.sortWithinPartitions("cell"), "query_id", "vec", cell="cell", least="least"), "wave")
            counts = {r.cell: r.n for r in wave.groupBy("cell").agg(F.sum(F.size("ids")).alias("n")).collect()}  # a row per cell
            if not counts:
                unstage(wave)
                break
            self.scored += sum(n * sizes[c] for c, n in counts.items())
            packs = self.packs().filter(F.col("cell").isin(*counts))
            q = asking(wave)
            hits = products(q.join(packs, (q["q_cell"] == packs["cell"]) & (q["q_dim"] == packs["dim"])), k)
            better = staged(best_of(hits if best is None else best.select("query_id", "id", "score").unionByName(hits), k), "best")
            unstage(best, wave)
            best, start, width = better, start + width, 2 * width
        unstage(asked)
        if best is None:
            kind = queries.schema["query_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, id {self.kind}, score double, rank int")
        return best
