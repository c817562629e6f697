"""Character overlap of a batch of short queries with every document, exactly.

All pairs of a query and a document have to be looked at. Documents stay where they are:
queries come to them in blocks of bounded size, a document's n-grams are marked in the
block's list of n-grams, and the marks are summed per query. So a pair costs as much as the
query has n-grams, and a task sends back its best k documents of each query, no more.
Built-in functions would shuffle a row for each common n-gram, or rebuild a set for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.shared import staged

#: Queries of a block, and characters of their texts where the queries are longer than usual.
BLOCK = 4_096
BLOCK_CHARS = 16_000_000


def bigram_codes(bare: str) -> np.ndarray:
    """Distinct bigrams of a text without white space as numbers; one character stands alone."""
    codes = np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.unique(codes[:-1] << 21 | codes[1:]) if len(codes) > 1 else codes << 21 | 0x1FFFFF


class Block:
    """Queries with their n-grams as places in one sorted list."""

    def __init__(self, ids: list, texts: list[str], bare: list[str]):
        own = [bigram_codes(b) for b in bare]
        used = [i for i, codes in enumerate(own) if len(codes)]
        self.ids, self.texts = np.array([ids[i] for i in used]), [texts[i] for i in used]
        self.sizes = np.array([len(own[i]) for i in used])
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate([own[i] for i in used]) if used else np.zeros(0, np.int64)
        self.grams, self.places = np.unique(flat, return_inverse=True)

    def scores(self, bare: str) -> np.ndarray:
        """The share of each query's n-grams that the document has."""
        codes = bigram_codes(bare)
        at = np.searchsorted(self.grams, codes)
        at[at == len(self.grams)] = 0
        marked = np.zeros(len(self.grams), dtype=np.int64)
        marked[at[self.grams[at] == codes]] = 1
        return np.add.reduceat(marked[self.places], self.starts) / self.sizes


class Best:
    """The k best documents of each query so far: larger scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]
        self.least = np.zeros(n)  # a document without a common n-gram is no hit

    def add(self, document, scores: np.ndarray) -> None:
        for q in np.flatnonzero((scores >= self.least) & (scores > 0)):
            rows = self.rows[q]
            rows.append((-scores[q], document))
            rows.sort()
            del rows[self.k :]
            if len(rows) == self.k:
                self.least[q] = -rows[-1][0]


def query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[Block, bool]]:
    """The queries in parts by a hash of the id, each small enough for the driver, and whether it is the last."""
    rows = queries.select("query_id", tx.given(F.col("text")).alias("text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, ceil(n / block), ceil(chars / BLOCK_CHARS))
    for part in range(parts):
        mine = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        got = mine.select("query_id", "text", tx.without_space(F.col("text")).alias("bare")).collect()
        yield Block([r[0] for r in got], [r[1] for r in got], [r[2] for r in got]), part == parts - 1


def _scan(queries: DataFrame, docs: DataFrame, fields: str, run, block: int, best) -> DataFrame:
    """The union over the blocks of best(rows that run(block, batches) yields for the documents)."""
    spark = docs.sparkSession
    kinds = {"query": queries.schema["query_id"].dataType.simpleString(), "doc": docs.schema["id"].dataType.simpleString()}
    texts = docs.select("id", tx.given(F.col("text")).alias("text"), tx.without_space(F.col("text")).alias("bare"))
    out = None
    for one, last in query_blocks(queries, block):
        shipped = spark.sparkContext.broadcast(one)  # at most BLOCK queries and BLOCK_CHARS characters

        def task(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            block = shipped.value
            return run(block, batches) if len(block.ids) else iter(())

        found = best(texts.mapInArrow(task, fields.format(**kinds)))
        if not last:  # a block's rows are written before the next block is read, and its broadcast goes
            found = staged(found, "hits")
            shipped.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def overlap_topk(queries: DataFrame, docs: DataFrame, k: int = 3, block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank: the k documents with the largest bigram overlap per query.

    queries has query_id, text; docs has id, text. The score is the share of the query's
    distinct bigrams, white space left out, that the document has; documents without a
    common one are no hits; ties go to the smaller id; null texts are empty.
    """

    def run(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), k)
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for document, bare in zip(batch.column("id").to_pylist(), batch.column("bare")):
                best.add(document, block.scores(bare.as_py()))
        rows = [(q, d, -s) for q, found in zip(block.ids.tolist(), best.rows) for s, d in found]
        if rows:
            ids, documents, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(documents, kind), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda hits: hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return _scan(queries, docs.filter("id is not null"), "query_id {query}, id {doc}, score double", run, block, best)
