"""Which documents hold a query's whole text, by a prefix filter of rare n-grams.

A document that holds a text holds each of its n-grams, the rarest one too. So documents are
scanned once for the n-grams that any query has, these are counted, and only the documents
with a query's rarest n-gram are compared with its text. N-grams travel as 64-bit hashes,
which only choose; texts decide. A task sends them on in parts, as a batch of long documents
that hold every query has many times its own size of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.overlap import BLOCK, overlap_topk
from tessera.shared import staged

#: Characters of an n-gram; distinct n-grams of queries that are broadcast at most (16 MB);
#: n-grams that a task gathers before it sends them on; documents that reached() looks at first.
N = 8
BROADCAST_CODES = 2_000_000
PART_CODES = 500_000
LIKELY = 64
_FACTOR, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_codes(text: str, n: int) -> np.ndarray:
    """Distinct hashes of the text's n-grams; none if it is shorter."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(letters) < n:
        return np.zeros(0, np.int64)
    codes = np.full(len(letters) - n + 1, np.uint64(n) * _LENGTH)
    for i in range(n):
        codes = codes * _FACTOR + letters[i : len(letters) - n + 1 + i]
        codes ^= codes >> np.uint64(29)
    return np.unique(codes.view(np.int64))


def _parts(found: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts' codes one after another and each one's text, in parts of PART_CODES or a text more."""
    held, n, first = [], 0, 0
    for i, codes in enumerate(found):
        held.append(codes)
        n += len(codes)
        if n >= PART_CODES:
            yield np.repeat(np.arange(first, i + 1), [len(c) for c in held]), np.concatenate(held)
            held, n, first = [], 0, i + 1
    if n:
        yield np.repeat(np.arange(first, first + len(held)), [len(c) for c in held]), np.concatenate(held)


def _query_codes(queries: DataFrame, n: int) -> DataFrame:
    """query_id, size, code: the n-grams of each text; a shorter text is its own, of its size."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.array([min(n, len(t)) for t in texts], np.int32)
            for at, codes in _parts(gram_codes(t, size) for t, size in zip(texts, sizes.tolist())):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(sizes[at]), pa.array(codes)], names=["query_id", "size", "code"])

    rows = queries.select("query_id", tx.given(F.col("text")).alias("text")).filter("text <> ''")
    return rows.mapInArrow(run, f"query_id {kind}, size int, code long")


def _document_codes(docs: DataFrame, sizes: list[int], known: np.ndarray | None) -> DataFrame:
    """id, code: the n-grams of the documents, or those of them that are known (ascending)."""
    kind = docs.schema["id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(known)

    def found(text: str, known: np.ndarray | None) -> np.ndarray:
        codes = np.concatenate([gram_codes(text, size) for size in sizes])
        if known is None:
            return codes
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return codes[known[at] == codes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for at, codes in _parts(found(text.as_py(), known) for text in batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(codes)], names=["id", "code"])

    rows = docs.filter("id is not null").select("id", tx.given(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, code long")


def candidates(queries: DataFrame, docs: DataFrame, n: int = N, most: int = BROADCAST_CODES) -> DataFrame:
    """query_id, id: the documents that hold the rarest n-gram of a query, by its hash.

    Up to `most` distinct n-grams of queries go to the documents; more are joined with theirs.
    """
    asked = staged(_query_codes(queries, n), "asked")
    sizes = [r[0] for r in asked.select("size").distinct().collect()]  # n at most
    codes = asked.select("code").distinct()
    if not sizes:
        kinds = asked.schema["query_id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}")
    if codes.count() <= most:
        met = _document_codes(docs, sizes, np.sort(codes.toArrow().column(0).to_numpy()))
    else:
        met = _document_codes(docs, sizes, None).join(codes, "code", "left_semi")
    met = staged(met, "met")
    held = met.groupBy("code").agg(F.count("*").alias("held"))
    rarest = asked.join(held, "code", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "code")).alias("least"))
    chosen = rarest.filter("least.held > 0").select("query_id", F.col("least.code").alias("code"))
    return chosen.join(met, "code").select("query_id", "id").distinct()


def containing(queries: DataFrame, docs: DataFrame, n: int = N, most: int = BROADCAST_CODES) -> DataFrame:
    """query_id, id of the documents that contain the query's whole text, white space as given.

    Null and empty texts are in no document and hold none; rows without an id take no part;
    a query_id stands for one text.
    """
    pairs = candidates(queries, docs, n, most)
    texts = queries.select("query_id", F.col("text").alias("asked"))
    both = pairs.join(texts, "query_id").join(docs.select("id", "text"), "id")
    return both.filter(F.contains("text", F.col("asked"))).select("query_id", "id")


def reached(queries: DataFrame, docs: DataFrame, share: float, likely: int = LIKELY, block: int = BLOCK) -> DataFrame:
    """query_id of the queries of which some document has at least `share` of the bigrams.

    The longest documents hold most bigrams: they are asked first, and all documents only for
    the queries that none of them answers.
    """
    long = docs.filter("id is not null").orderBy(F.desc(F.length("text")), "id").limit(likely)
    found = staged(overlap_topk(queries, long, 1, block).filter(F.col("score") >= share).select("query_id"), "reached")
    rest = queries.join(found, "query_id", "left_anti")
    return found.unionByName(overlap_topk(rest, docs, 1, block).filter(F.col("score") >= share).select("query_id")).distinct()
