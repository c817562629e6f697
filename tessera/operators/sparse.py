"""Sparse search for whole batches of queries by term weights, exactly.

The weight of a term, tf * ln(1 + n / df), is put on the queries, which are few; documents
stay where they are and are scored against blocks of queries of bounded size. A document only
meets the postings of its own terms, and a task sends back its best k of each query. So no row
per document and term is shuffled, and frequent terms make no hot key.

A product of small matrices bounds the scores of a document from above; only pairs whose bound
reaches the query's k-th score so far are summed. In large searches that score comes from the
longest documents, which are asked before all others: the result is that of all sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.dense import Top
from tessera.shared import staged, unstage

#: Rows of (query, term) in a block, and hits that a task gathers before it ranks them.
BLOCK_ROWS = 3_000_000
HITS = 50_000
#: Groups of one term and of several in the bounds, documents that are bounded at a time, at
#: first and at most, and the relative error of a bound.
SINGLE, SHARED = 128, 512
FIRST, CHUNK = 32, 128
SLACK = 1e-4
#: Pairs of a query and a document from which on the longest documents, so many or this share, are asked first.
PAIRS = 50_000_000
LONGEST, LONG_SHARE = 2_048, 0.001
WORDS = r"[a-zà-ÿ]{3,}"


def words(text, pattern: str = WORDS):
    return F.regexp_extract_all(F.lower(tx.given(text)), F.lit(pattern), F.lit(0))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the ranges one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Block:
    """Postings of queries: rows of (query, weight) in the order of their terms, and in that of queries.

    `most` has each query's largest weight in each group of terms; the commonest terms are
    groups of their own. A document's words per group times these can't be below its score.
    """

    def __init__(self, rows: pa.Table):
        """rows has query_id, term, weight."""
        ids, terms = (rows.column(c).combine_chunks().dictionary_encode() for c in (0, 1))
        self.ids, self.terms = ids.dictionary.to_pylist(), terms.dictionary
        at, query = (x.indices.to_numpy().astype(np.int32) for x in (terms, ids))
        weight = rows.column(2).to_numpy()
        order = np.argsort(at, kind="stable")
        self.query, self.weight = query[order], weight[order]
        self.count = np.bincount(at, minlength=len(self.terms))
        self.start = np.cumsum(self.count) - self.count
        order = np.argsort(query, kind="stable")
        self.own_term, self.own_weight = at[order], weight[order]
        self.own_count = np.bincount(query, minlength=len(self.ids))
        self.own_start = np.cumsum(self.own_count) - self.own_count
        place = np.empty(len(self.terms), np.int64)
        place[np.argsort(-self.count, kind="stable")] = np.arange(len(self.terms))
        self.group = np.where(place < SINGLE, place, SINGLE + place % SHARED)
        self.most = np.zeros((len(self.ids), SINGLE + SHARED), np.float32)
        np.maximum.at(self.most, (query, self.group[at]), weight.astype(np.float32))

    def scores(self, own: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The score of each query with a document of these terms, tf times each."""
        n = self.count[own]
        at = _ranges(self.start[own], n)
        return np.bincount(self.query[at], self.weight[at] * np.repeat(tf, n), minlength=len(self.ids))

    def scores_of(self, some: np.ndarray, own: np.ndarray, tf: np.ndarray, held: np.ndarray) -> np.ndarray:
        """scores() of some queries; held has a zero per term, and has so again at the end."""
        n = self.own_count[some]
        at = _ranges(self.own_start[some], n)
        held[own] = tf
        found = np.add.reduceat(self.own_weight[at] * held[self.own_term[at]], np.cumsum(n) - n)
        held[own] = 0
        return found

    def bounds(self, place: np.ndarray, own: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """At least the scores of n documents (rows) with each query; place is the document of each term."""
        width = self.most.shape[1]
        sums = np.bincount(place * width + self.group[own], tf, minlength=n * width)
        return sums.reshape(n, width).astype(np.float32) @ self.most.T


def best_hits(block: Block, top: Top, ids: np.ndarray, codes: list[np.ndarray], decimals: int) -> int:
    """Adds the documents of these terms (-1: of no query) to the block's best; returns how many pairs were summed.

    The longest documents come first, as most of the best hits are among them. Later ones are
    only summed with the queries whose k-th score their bound reaches.
    """
    held, summed = np.zeros(len(block.terms)), 0
    order = np.argsort([-len(c) for c in codes], kind="stable")
    hits, n_hits, start, step = [], 0, 0, FIRST
    while start < len(order):
        chunk = order[start : start + step]
        start, step = start + step, min(2 * step, CHUNK)
        words = [codes[i] for i in chunk]
        keys, tf = np.unique(np.repeat(np.arange(len(chunk)), [len(c) for c in words]) * len(held) + np.concatenate(words), return_counts=True)
        place, own = np.divmod(keys, max(1, len(held)))
        reach = block.bounds(place, own, tf, len(chunk)) * np.float32(1 + SLACK)  # single precision, and rounding
        live = (reach >= top.least - 10.0**-decimals) & (reach > 0)
        ends = np.searchsorted(place, np.arange(len(chunk) + 1))
        for i, row, a, b in zip(chunk, live, ends, ends[1:]):
            q = np.flatnonzero(row)
            if not len(q):
                continue
            if block.own_count[q].sum() < block.count[own[a:b]].sum():
                scores = block.scores_of(q, own[a:b], tf[a:b], held)
            else:
                scores = block.scores(own[a:b], tf[a:b])[q]
            summed += len(q)
            scores = np.round(scores, decimals)
            good = (scores >= top.least[q]) & (scores > 0)
            hits.append((q[good], np.full(good.sum(), i), scores[good]))
            n_hits += len(hits[-1][0])
        if n_hits >= min(HITS, top.k * len(block.ids)) or n_hits and start >= len(order):
            q, at, found = map(np.concatenate, zip(*hits))
            top.keep(q, ids[at], found)
            hits, n_hits = [], 0
    return summed


def query_terms(queries: DataFrame, pattern: str = WORDS) -> DataFrame:
    """query_id, term, tf of rows with query_id, text."""
    found = queries.filter("query_id is not null").select("query_id", F.explode(words(F.col("text"), pattern)).alias("term"))
    return found.groupBy("query_id", "term").agg(F.count("*").alias("tf"))


def weighted(asked: DataFrame, docs: DataFrame, most: int = 200_000) -> DataFrame:
    """query_id, term, weight: a query's term counts times the terms' ln(1 + n / df) in docs (id, words).

    Terms that no query has don't leave the scan: up to `most` distinct ones are broadcast,
    more are joined as they are.
    """
    terms = asked.select("term").distinct()
    known = F.broadcast(terms) if terms.count() <= most else terms
    found = docs.select(F.explode(F.array_distinct("words")).alias("term")).join(known, "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return asked.join(df, "term").crossJoin(F.broadcast(n)).select("query_id", "term", (F.col("tf") * F.log1p(F.col("n") / F.col("df"))).alias("weight"))  # one row


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int, decimals: int = 6, pattern: str = WORDS) -> DataFrame:
    """query_id, id, score, rank: the k documents with the largest sums over common terms.

    queries has query_id, text; docs has id, text. Scores are rounded before they are ranked,
    so that sums in any order agree; ties go to the smaller id; documents without a common
    term are no hits; null texts are empty; rows without an id take no part.
    """
    spark = docs.sparkSession
    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    asked = staged(query_terms(queries, pattern), "asked")
    cut = staged(docs.select("id", words(F.col("text"), pattern).alias("words")), "words")  # once: cutting costs as much as a search
    parts = ceil(asked.count() / BLOCK_ROWS)
    postings = weighted(asked, cut)
    postings = staged(postings, "weights") if parts > 1 else postings
    given = cut.filter("id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda hits: hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    n_asked, n_docs = asked.select("query_id").distinct().count(), given.count()
    ahead, later = None, given
    if n_asked * n_docs >= PAIRS and n_docs > LONGEST:
        size = F.size("words")
        bar = given.agg(F.percentile_approx(size, 1 - max(LONGEST / n_docs, LONG_SHARE), 10_000)).first()[0]
        ahead, later = given.filter(size > bar), given.filter(size <= bar)
    found = best(spark.createDataFrame([], schema))
    for part in range(parts):
        got = postings if parts == 1 else postings.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        block = Block(got.toArrow())
        shipped = spark.sparkContext.broadcast(block)  # about BLOCK_ROWS rows
        hits, first = None, None
        if ahead is not None:
            first = staged(best(_scan(ahead, shipped, None, k, decimals, schema)), "ahead")
            kth = {r[0]: r[1] for r in first.filter(F.col("rank") == k).select("query_id", "score").toLocalIterator()}
            least = np.array([kth.get(q, -np.inf) for q in block.ids])
            hits = _scan(later, shipped, spark.sparkContext.broadcast(least), k, decimals, schema)
            hits = best(hits.unionByName(first.drop("rank")))
        else:
            hits = best(_scan(later, shipped, None, k, decimals, schema))
        if parts > 1:  # a block's rows are written before the next block is read, and its broadcast goes
            hits = staged(hits, "hits")
            shipped.destroy()
            unstage(first)
        found = hits if part == 0 else found.unionByName(hits)
    if parts > 1:
        unstage(asked, cut, postings)
    return found


def _scan(docs: DataFrame, shipped, least, k: int, decimals: int, schema: str) -> DataFrame:
    """query_id, id, score: each task's best k documents (id, words) of a block's queries, from a score of `least` on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kind = shipped.value, None
        top = Top(len(block.ids), k)
        if least is not None:
            top.least = least.value.copy()
        for batch in batches:
            kind = batch.schema.field("id").type
            lists = batch.column("words")
            if not len(lists):
                continue
            ids = np.array(batch.column("id").to_pylist())
            codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=block.terms), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            best_hits(block, top, ids, [own[own >= 0] for own in np.split(codes, ends[:-1])], decimals)
        if len(top.query):
            yield pa.RecordBatch.from_arrays([pa.array([block.ids[q] for q in top.query]), pa.array(top.id, kind), pa.array(top.score)], names=["query_id", "id", "score"])

    return docs.mapInArrow(task, schema)
