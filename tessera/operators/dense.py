"""Exact inner-product search for whole batches of queries.

Queries and vectors are packed: a row holds the numbers of up to PACK vectors. Spark brings
packs of queries and packs of vectors together, by broadcast where the queries' table is
small and else partition by partition, so nothing of either passes through the driver. A task
multiplies packs as matrices, keeps what may be among the best k of each query, and sends
back its best k, no more. Products only choose; scores are sums in double, component by
component, so that they don't depend on the packs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import staged

#: Vectors of a pack and numbers in it, scores that a product makes at a time, and packs of
#: queries whose best rows a task holds at a time.
PACK = 4_096
PACK_VALUES = 500_000
SCORES = 4_000_000
HELD = 64


def matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of dim finite numbers, those vectors as rows)."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    whole = np.isfinite(flat).all(axis=1)
    return at[whole], flat[whole]


class Block:
    """Queries of one length."""

    def __init__(self, ids: list, rows: np.ndarray):
        self.ids, self.rows, self.dim = ids, rows, rows.shape[1]
        self.lengths = np.sqrt((rows**2).sum(axis=1))


class Top:
    """The k best rows of each of n queries so far: larger scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.id, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def keep(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, scores = np.concatenate([self.query, query]), np.concatenate([self.score, scores])
        ids = ids if self.id is None else np.concatenate([self.id, ids])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], scores[full])
        best = place < self.k
        self.query, self.id, self.score = query[best], ids[best], scores[best]


class Best(Top):
    def __init__(self, block: Block, k: int, least: np.ndarray | None = None):
        super().__init__(len(block.ids), k)
        self.block = block
        if least is not None:
            self.least = least.copy()

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        queries = self.block.rows
        longest = np.sqrt((vectors**2).sum(axis=1)).max()
        step = max(1, SCORES // len(ids))
        for start in range(0, len(queries), step):
            some = queries[start : start + step]
            products = some @ vectors.T
            kth = np.partition(products, -self.k, axis=1)[:, -self.k] if len(ids) > self.k else np.full(len(some), -np.inf)
            slack = 1e-9 * self.block.lengths[start : start + step] * longest  # for sums in another order
            q, v = np.nonzero(products >= (np.maximum(kth, self.least[start : start + step]) - slack)[:, None])
            for cut in range(0, len(q), SCORES // self.block.dim + 1):
                part = slice(cut, cut + SCORES // self.block.dim + 1)
                self.keep(q[part] + start, ids[v[part]], np.cumsum(some[q[part]] * vectors[v[part]], axis=1)[:, -1])


def pack(rows: DataFrame, id_column: str, vec_column: str, cell: str | None = None, least: str | None = None) -> DataFrame:
    """rows as packs: cell, dim, ids, data, least. Nothing is shuffled.

    Vectors of a pack have one length, and one value of the column `cell` if there is one
    (else cell is null). data holds their numbers in double, row by row; least holds the
    column of that name, or nothing. Null, empty and non-finite vectors and null ids go.
    """
    added = [F.col(c).cast(t).alias(n) for c, t, n in ((cell, "int", "cell"), (least, "double", "least")) if c]
    plain = rows.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vec_column).alias("vec"), *added)
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec")
            out = []
            for dim in pc.unique(pc.fill_null(pc.list_value_length(vectors), 0)).to_pylist():
                if not dim:
                    continue
                at, flat = matrix(vectors, dim)
                cells = batch.column("cell").to_numpy()[at] if cell else np.zeros(len(at), np.int64)
                order = np.argsort(cells, kind="stable")
                most = max(1, min(PACK, PACK_VALUES // dim))
                for run in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                    for start in range(0, len(run), most):
                        some = run[start : start + most]
                        ids = batch.column("id").take(pa.array(at[some])).to_pylist()
                        bar = batch.column("least").take(pa.array(at[some])).to_pylist() if least else []
                        out.append((int(cells[some[0]]) if cell else None, dim, ids, flat[some].tobytes(), bar))
            if out:
                columns = list(zip(*out))
                types = [pa.int32(), pa.int32(), pa.list_(batch.schema.field("id").type), pa.binary(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["cell", "dim", "ids", "data", "least"])

    return plain.mapInArrow(run, f"cell int, dim int, ids array<{kind}>, data binary, least array<double>")


def asking(packs: DataFrame) -> DataFrame:
    """Packs of queries under names of their own."""
    return packs.select(F.col("cell").alias("q_cell"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("least").alias("q_least"))


def products(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: of each pack of queries the k best rows of the packs that a task meets.

    pairs has the columns of `asking` and of `pack`, with equal lengths of vectors.
    """
    kinds = [pairs.schema[c].dataType.elementType.simpleString() for c in ("q_ids", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Best] = {}
        types = None

        def done(best: Best) -> Iterator[pa.RecordBatch]:
            if len(best.query):
                ids = [best.block.ids[q] for q in best.query]
                yield pa.RecordBatch.from_arrays([pa.array(ids, types[0]), pa.array(best.id, types[1]), pa.array(best.score)], names=["query_id", "id", "score"])

        for batch in batches:
            types = [batch.schema.field(c).type.value_type for c in ("q_ids", "ids")]
            for i in range(batch.num_rows):
                asked, least, dim = batch.column("q_data")[i].as_py(), batch.column("q_least")[i].as_py(), batch.column("dim")[i].as_py()
                ids = batch.column("q_ids")[i].as_py()
                key = (asked, tuple(ids))
                best = held.pop(key, None)
                if best is None:
                    best = Best(Block(ids, np.frombuffer(asked).reshape(-1, dim)), k, np.array(least) if least else None)
                held[key] = best  # now the youngest
                vectors = np.frombuffer(batch.column("data")[i].as_py()).reshape(-1, dim)
                best.add(np.array(batch.column("ids")[i].as_py()), vectors)
                if len(held) > HELD:
                    yield from done(held.pop(next(iter(held))))
        for best in held.values():
            yield from done(best)

    return pairs.select("q_ids", "q_data", "q_least", "dim", "ids", "data").mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def best_of(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k vectors of largest inner product per query, ties to the
    smaller id. queries has query_id, query_vec; vectors has id, vec.

    Only vectors of the query's length take part; those null or with null or non-finite
    components don't, and neither do such queries.
    """
    asked = asking(staged(pack(queries, "query_id", "query_vec"), "queries"))
    # every pack of queries meets every pack of vectors; no key deals them, lengths only choose
    pairs = asked.crossJoin(pack(vectors, "id", "vec")).filter(F.col("q_dim") - F.col("dim") == 0)
    return best_of(products(pairs, k), k)
