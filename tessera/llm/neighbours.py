"""Approximate nearest neighbours by additive quantisation.

A vector, scaled to length one, is the sum of one full-dimensional codeword from each of M
codebooks. The books are fitted on a bounded sample: residual k-means first, then rounds of
least squares for all books together and new codes. Every vector is encoded by beam search
over the residual. Of its sum c of words the part along the vector, c.x, and the length of
the part across it are stored with the codes: a query's q.c / c.x is its cosine with the
vector, but for what the part across adds, which is no longer than that part and, measured on
the sample, mostly far shorter. The entries with the largest such estimates give a threshold
by their own vectors; each other entry whose estimate may reach it, by REACH deviations of
what the part across adds, is compared as well. So the number of entries that are compared
follows from how well the codes tell them apart, and not from a fixed number: wide vectors or
large groups of close ones get more. Scores are exact cosines of the original vectors.

Equal vectors are one entry with its smallest ids, so that a vector that is repeated a
million times takes one place among the candidates. Queries are dealt into blocks and
entries into shards; each pair of a block and a shard is one task group, large but bounded,
so that entries are copied once per BLOCK_BYTES of queries only. Every query meets every code,
as the query set asks: the work is the product of both numbers.

Defined results: vectors that are null, zero or hold a null or non-finite component take no
part; components that a shorter vector lacks count as 0; vectors are scaled before they are
coded, so very small and very large ones are found alike (their squares must be doubles); a
query with fewer candidates than k gets them all; ties go to the smaller id; rows with null
ids take no part; of rows with equal ids and vectors one takes part; where an id repeats
with other vectors, a pair of ids scores as its best pair of vectors; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fitted, staged

BOOKS = 32
WORDS = 64
BEAM = 8
#: Below this part along the vector, codes tell nothing of it, and it is compared with every query.
LEAST_ALONG = 0.05
SAMPLE = 8_192
ROUNDS = 2
#: Entries that give a query its threshold, and that a shard sends back.
RERANK = 16
#: Deviations of what codes leave out by which an estimate may miss; queries of a step.
REACH = 4.0
STEP = 64
#: What single precision may get wrong in a cosine.
ROUNDING = 1e-5
#: Bytes of the query vectors of a block; entries of a shard, and bytes of their vectors, at most.
BLOCK_BYTES = 32_000_000
SHARD = 131_072
SHARD_BYTES = 64_000_000
#: Entries that are worth a shard of their own while there are fewer shards than cores.
LEAST_SHARD = 4_096


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows in double precision; shorter ones are filled up with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False) if isinstance(vectors, pa.Array) else pc.list_value_length(vectors).to_numpy()
    values = pc.cast(pc.list_flatten(vectors), pa.float64())
    values = values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values.to_numpy()
    if len(values) == len(lengths) * width:
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    out = rows / np.abs(rows).max(axis=1, initial=0, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[draw.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        counts = np.bincount(nearest, minlength=k)
        sums = (nearest == np.arange(k)[:, None]).astype(np.float32) @ x
        centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The codes of each row, by beam search."""
    n, (m, k, d) = len(x), books.shape
    residual = x[:, None, :]
    codes = np.zeros((n, 1, 0), dtype=np.uint8)
    for book in books:
        gain = residual @ book.T * 2 - (book**2).sum(1)  # what each word takes off the squared residual
        error = (residual**2).sum(2)[:, :, None] - gain
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
        path, word = best // k, best % k
        rows = np.arange(n)[:, None]
        residual = residual[rows, path] - book[word]
        codes = np.concatenate([codes[rows, path], word[:, :, None].astype(np.uint8)], axis=2)
    best = (residual**2).sum(2).argmin(1)
    return codes[np.arange(n), best]


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    draw = np.random.default_rng(seed)
    residual, out = x.copy(), []
    for _ in range(books):
        book = _kmeans(residual, words, draw)
        residual -= book[(residual @ book.T - 0.5 * (book**2).sum(1)).argmax(1)]
        out.append(book)
    table = np.stack(out)
    for _ in range(rounds):
        codes = encode_in_parts(x, table)
        at = codes.astype(np.int64)
        gram = np.zeros((books * words, books * words), dtype=np.float32)
        for i in range(books):
            for j in range(books):
                pair = np.bincount(at[:, i] * words + at[:, j], minlength=words * words)
                gram[i * words : (i + 1) * words, j * words : (j + 1) * words] = pair.reshape(words, words)
        moment = np.zeros((books * words, x.shape[1]), dtype=np.float32)
        for i in range(books):
            moment[i * words : (i + 1) * words] = (codes[:, i] == np.arange(words)[:, None]).astype(np.float32) @ x
        solved = np.linalg.solve(gram + 0.05 * np.eye(len(gram), dtype=np.float32), moment + 0.05 * table.reshape(-1, x.shape[1]))
        table = solved.reshape(table.shape).astype(np.float32)
    return table


def encode_in_parts(x: np.ndarray, books: np.ndarray, part: int = 1_024) -> np.ndarray:
    return np.concatenate([encode(x[i : i + part], books) for i in range(0, len(x), part)])


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The sum of each row's words."""
    out = books[0][codes[:, 0]]
    for m in range(1, len(books)):
        out += books[m][codes[:, m]]
    return out


def parts_of(sums: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sums of words for vectors of length one: the part along the vector, and the length of the part across it."""
    along = np.einsum("nd,nd->n", sums, x)
    return along, np.linalg.norm(sums - along[:, None] * x, axis=1)


def deviation(x: np.ndarray, books: np.ndarray, draw: int = 256, near: int = 10) -> float:
    """How far estimates of near pairs are off, in units of the part across: one over the root of the
    dimensions in which vectors differ, as the sample has it, and of all dimensions at least."""
    least = 1 / np.sqrt(max(1, x.shape[1] - 1))
    sums = decode(encode_in_parts(x, books), books)
    along, across = parts_of(sums, x)
    asked = np.unique(np.linspace(0, len(x) - 1, min(draw, len(x))).astype(int))
    true = x[asked] @ x.T
    true[np.arange(len(asked)), asked] = -2
    at = np.argsort(-true, axis=1)[:, :near]
    rows = np.arange(len(asked))[:, None]
    scale = across[at] / np.maximum(along[at], 1e-6) * np.sqrt(np.maximum(1 - true[rows, at] ** 2, 1e-6))
    off = (x[asked] @ sums.T)[rows, at] / np.maximum(along[at], 1e-6) - true[rows, at]
    told = (true[rows, at] > -2) & (along[at] > LEAST_ALONG) & (scale > ROUNDING)
    return float(max(least, np.sqrt(np.mean((off[told] / scale[told]) ** 2)))) if told.any() else 1.0


def nearest_of(asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, sums: np.ndarray, along: np.ndarray, across: np.ndarray, off: float, k: int, rerank: int):
    """Of each row of asked: (places of the entries with the largest cosines, cosines), best first, ties to the smaller id.

    sums are the sums of the vectors' words, along and across their parts.
    """
    single, norms = unit(vectors).astype(np.float32), np.sqrt(_sums(vectors * vectors))
    told = along > LEAST_ALONG
    by = np.where(told, 1 / np.where(told, along, 1), 0).astype(np.float32)
    miss = np.where(told, across * by * min(1.0, REACH * off), 2).astype(np.float32)
    n, most = len(ids), min(max(rerank, k + 1), len(ids))
    for i in range(0, len(asked), STEP):
        part = asked[i : i + STEP]
        q = unit(part).astype(np.float32)
        estimates = (q @ sums.T) * by
        chosen = []
        for estimate, own in zip(estimates, q):
            first = np.argpartition(estimate, n - most)[n - most :]
            found = np.sort(single[first] @ own)
            least = (found[-(k + 1)] if len(found) > k else -2) - ROUNDING
            may = np.flatnonzero(estimate + miss >= least)
            low = np.clip(estimate[may] - miss[may], 0, 1)
            may = may[estimate[may] + miss[may] * np.where(told[may], np.sqrt(1 - low * low), 1) + ROUNDING >= least]
            chosen.append(np.union1d(may, first))
        whole = q @ single.T if sum(map(len, chosen)) > n * len(part) // 8 else None
        for j, may in enumerate(chosen):
            cosines = single[may] @ q[j] if whole is None else whole[j, may]
            if len(may) > most:
                may = may[cosines >= np.partition(cosines, len(may) - most)[len(may) - most] - ROUNDING]
            scores = np.concatenate([_sums(vectors[may[a : a + 8_192]] * part[j]) for a in range(0, len(may), 8_192)])
            scores = scores / (np.sqrt(_sums(part[j : j + 1] * part[j])) * norms[may])
            order = np.lexsort((ids[may], -scores))[:most]
            yield may[order], scores[order]


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums of rows, from left to right as SQL's lists are added up."""
    return np.add.accumulate(rows, axis=1)[:, -1]


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vec of the rows that take part."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    plain = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vec"))
    return plain.filter("id is not null and vec is not null and size(vec) > 0").filter(~F.exists("vec", bad) & F.exists("vec", lambda v: v != 0))


def neighbours(rows: DataFrame, is_query: Column, k: int = 5, rerank: int = RERANK, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row where is_query holds (on `id`)."""
    valid = usable(rows, id_column, vector).distinct()
    by_id = Window.partitionBy("vec").orderBy("id")
    entries = staged(
        valid.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "vec", "ids"),
        "entries",
    )
    queries = staged(valid.filter(is_query).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec")), "queries")
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE)
    n_entries, width = entries.agg(F.count("*"), F.max(F.size("vec"))).first()

    def learn(table: pa.Table) -> tuple[np.ndarray, float]:
        x = unit(matrix(table["vec"], width)).astype(np.float32)
        books = fit(x)
        return books, deviation(x, books)

    model = fitted(sample, learn, ["entry", "vec"], ["entry", "vec"]) if n_entries else None
    if model is None:
        return queries.selectExpr("query_id", "1 as rank", "query_id as vec_id", "0.0D as score").limit(0)
    books, off = model

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("vec"), width)).astype(np.float32)
            codes = encode_in_parts(x, books)
            along, across = parts_of(decode(codes, books), x)
            yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(along, pa.float32()), pa.array(across, pa.float32())], names=["entry", "vec", "codes", "along", "across"])

    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, ceil(queries.count() * width * 4 / BLOCK_BYTES))
    shard = max(LEAST_SHARD, min(SHARD, SHARD_BYTES // (4 * width)))
    n_shards = max(ceil(n_entries / shard), min(ceil(cores / n_blocks), ceil(n_entries / LEAST_SHARD)))
    every = lambda n: F.explode(F.array(*map(F.lit, range(n)))) if n <= 64 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = entries.schema["vec"].dataType.simpleString()
    coded = entries.select("entry", "vec").mapInArrow(to_codes, f"entry long, vec {kind}, codes binary, along float, across float")
    shards = coded.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(n_shards)).cast("int")).withColumn("block", every(n_blocks))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).withColumn("shard", every(n_shards))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("entry", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        codes = np.frombuffer(b"".join(right["codes"].to_pylist()), dtype=np.uint8).reshape(right.num_rows, -1)
        ids, along, across = (right[c].to_numpy() for c in ("entry", "along", "across"))
        found = list(nearest_of(matrix(left["query_vec"], width), ids, matrix(right["vec"], width), decode(codes, books), along, across, off, k, rerank))
        asked = np.repeat(left["query_id"].to_numpy(), [len(at) for at, _ in found])
        return pa.table([asked, ids[np.concatenate([at for at, _ in found])], np.concatenate([score for _, score in found])], schema=out)

    found = blocks.groupBy("block", "shard").cogroup(shards.groupBy("block", "shard")).applyInArrow(best, "query_id long, entry long, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    chosen = found.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= max(rerank, k + 1)).select("query_id", "entry", "score")
    scored = chosen.join(entries.select("entry", "ids"), "entry").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
