"""Toxicity by a subword bag: n-gram embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, a document the
mean of its distinct words, times the root of their number; a softmax over two classes
follows. Vectors and softmax are trained jointly in numpy, so a misspelling that was never
seen shares the vectors of its n-grams. The rarer class weighs more. Since everything after
the vectors is linear, scoring folds vectors and softmax into one number per n-gram bucket
and remembers one number per word.

Training takes at most `rows` labelled documents, those with the smallest hash of the id,
and TRAINING_CHARS characters of them, whole texts, in one task; scoring reads all documents
in whole. Words of fewer than floor(n) of the n training documents teach nothing, as they
would be learnt by heart: one document in 500, one at least and ten at most.

Defined results: a null or word-free text gets the class prior of the training rows; with
no labelled rows every score is 0; without a word to learn from, every score is the prior;
of several labels of one id the largest counts; of documents that repeat an id the smallest
text trains; rows with null labels or ids are no training rows; empty tables give no
rows; other columns are passed on by `score` and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fitted, fold, released
from tessera.llm.subwords import WordRows, hashed_ngrams, words_of

ROWS = 10_000
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
WIDTH = 4
STEPS = 150
RATE = 0.05
GAIN = 10.0
#: Weight of a toxic training row; a clean one weighs 1.
WEIGHT = 4.0
#: Added to each gradient's own size, in units of the mean size: rare n-grams learn slowly.
CALM = 5.0
DECAY = 1e-4
BLOCK_CHARS = 2_000_000


def floor(n: int) -> int:
    """Training documents, of n, that a word must stand in to be learnt."""
    return min(10, 1 + n // 500)


class Sums:
    """Weighted sums of rows: out[index] += weight * values[source], for all entries."""

    def __init__(self, index: np.ndarray, source: np.ndarray, weight: np.ndarray, n: int):
        order = np.argsort(index, kind="stable")
        self.at, self.starts = np.unique(index[order], return_index=True)
        self.source, self.weight, self.n = source[order].astype(np.int32), weight[order, None].astype(np.float32), n

    def __call__(self, values: np.ndarray) -> np.ndarray:
        rows = values.take(self.source, axis=0)
        rows *= self.weight
        out = np.zeros((self.n, values.shape[1]), dtype=np.float32)
        if len(rows):
            out[self.at] = np.add.reduceat(rows, self.starts, axis=0)
        return out


class Texts(Sequence):
    """The texts of an Arrow column, made into strings one at a time."""

    def __init__(self, column: pa.ChunkedArray):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, i: int) -> str:
        return self.column[i].as_py()

    def __iter__(self) -> Iterator[str]:
        return (v.as_py() for v in self.column)


def vocabulary(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(word, document, weight) of each distinct word of each document, and the words' names.

    Words are told apart by 64-bit hashes until the rare ones are gone, so that only the
    names of frequent words are held.
    """
    import xxhash

    distinct = lambda t: sorted(set(words_of(t.lower())))
    hashed = [np.array([xxhash.xxh64_intdigest(w) for w in distinct(t)], dtype=np.uint64) for t in texts]
    known, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]), return_counts=True)
    known = known[counts >= floor(len(hashed))]
    words, owners, weights, names = [], [], [], [""] * len(known)
    for i, (text, codes) in enumerate(zip(texts, hashed)):
        at = np.searchsorted(known, codes)
        kept = at < len(known)
        kept[kept] = known[at[kept]] == codes[kept]
        at = at[kept]
        words.append(at.astype(np.int32))
        owners.append(np.full(len(at), i, dtype=np.int32))
        weights.append(np.full(len(at), max(1, len(codes)) ** -0.5, dtype=np.float32))
        if any(not names[k] for k in at):
            for k, name in zip(at, (w for w, keep in zip(distinct(text), kept) if keep)):
                names[k] = name
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *words]), np.concatenate([none, *owners]), np.concatenate([np.zeros(0, np.float32), *weights]), names


def train(texts: Sequence[str], labels: np.ndarray, steps: int = STEPS, seed: int = 3) -> dict:
    """{bucket: number per n-gram bucket, bias, prior}: the folded model."""
    word, owner, weight, names = vocabulary(texts)
    documents = len(labels)
    labels = np.asarray(labels, dtype=np.int64)
    y = np.eye(2, dtype=np.float32)[labels]
    prior = float(labels.mean()) if len(labels) else 0.0
    of_row = np.where(labels == 1, WEIGHT, 1.0)[:, None]
    of_row = (of_row / max(1.0, of_row.sum())).astype(np.float32)
    if not names:
        return {"bucket": np.zeros(BUCKETS, dtype=np.float32), "bias": 0.0, "prior": prior, "empty": True}
    grams, sizes = hashed_ngrams(names, SIZES, BUCKETS, whole=True)
    used, grams = np.unique(grams, return_inverse=True)
    grams, gram_word = grams.astype(np.int32), np.repeat(np.arange(len(names), dtype=np.int32), sizes)
    share = (1.0 / sizes).astype(np.float32)
    draw = np.random.default_rng(seed)
    vectors = draw.normal(0, 0.01, (len(used), WIDTH)).astype(np.float32)
    softmax = draw.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.log(np.array([1 - prior, prior], dtype=np.float32).clip(1e-3))

    of_gram = share[gram_word]
    to_words, to_bags = Sums(gram_word, grams, of_gram, len(names)), Sums(owner, word, weight, documents)
    back_to_words, back_to_grams = Sums(word, owner, weight, len(names)), Sums(grams, gram_word, of_gram, len(used))
    params, moments = [vectors, softmax, bias], [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    for step in range(1, steps + 1):
        bag = GAIN * to_bags(to_words(vectors))
        logits = bag @ softmax + bias
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=1, keepdims=True)
        error = (chance - y) * of_row
        back = GAIN * (error @ softmax.T)
        grads = [back_to_grams(back_to_words(back)) + DECAY * vectors, bag.T @ error, error.sum(axis=0)]
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            size = np.sqrt(v / (1 - 0.99**step))
            p -= RATE * (m / (1 - 0.9**step)) / (size + CALM * np.sqrt((size * size).mean()) + 1e-12)
    folded = np.zeros(BUCKETS, dtype=np.float32)
    folded[used] = GAIN * (vectors @ (softmax[:, 1] - softmax[:, 0]))
    return {"bucket": folded, "bias": float(bias[1] - bias[0]), "prior": prior, "empty": False}


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.rows = WordRows(self._numbers, 1)

    def _numbers(self, words: list[str]) -> np.ndarray:
        grams, sizes = hashed_ngrams(words, SIZES, BUCKETS, whole=True)
        owner = np.repeat(np.arange(len(words)), sizes)
        return (np.bincount(owner, self.model["bucket"][grams], len(words)) / sizes)[:, None]

    def scores(self, texts: list[str]) -> np.ndarray:
        documents = [sorted(set(words_of(t.lower()))) for t in texts]
        sizes = np.array([len(x) for x in documents])
        logit = self.rows.sums(documents)[:, 0] / np.sqrt(np.maximum(1, sizes)) + self.model["bias"]
        known = (sizes > 0) & (not self.model["empty"])
        return np.where(known, 1 / (1 + np.exp(-np.clip(logit, -60, 60))), self.model["prior"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, train_rows) -> DataFrame:
    """text, label of at most `rows` training documents, by the smallest hash of the id."""
    known = labels.filter(train_rows & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # one text an id, so that repeated ids don't take the sample past its bound
    return texts.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("doc_id").alias("place"), "doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, train_rows=None, rows: int = ROWS) -> dict | None:
    sample = labelled(docs, labels, "toxic", rows, F.lit(True) if train_rows is None else train_rows)

    def learn(table: pa.Table) -> dict:
        return train(Texts(table["text"]), table["label"].to_numpy())

    return fitted(sample, learn, ["place", "doc_id", "text", "label"], ["place", "doc_id", "text"], "text")


def text_blocks(texts: pa.Array, most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """The texts, null as empty, in lists of at most about `most` characters."""
    block, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def scorer(spark: SparkSession, model: dict | None):
    """A function from a text column to its scores. Only texts go to Python and only scores
    come back; the other columns stay with Spark."""
    shipped = spark.sparkContext.broadcast(model)  # BUCKETS floats, whatever the data

    @F.arrow_udf("double")
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = Scorer(shipped.value) if shipped.value else None
        for texts in batches:
            out = [tool.scores(part) if tool else np.zeros(len(part)) for part in text_blocks(texts)]
            yield pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())
        del tool
        released()

    return score_of


def score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """docs with the score; it replaces a column of that name."""
    return docs.withColumn(name, scorer(docs.sparkSession, model)(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are never read."""
    model = fit(docs, labels, fold("doc_id", folds) != held_out)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
