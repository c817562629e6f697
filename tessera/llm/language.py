"""Language by hierarchical discrimination: the family first, then the language within it.

Texts are bags of hashed character n-grams of words. One-versus-one linear support vector
machines vote on the family; those of the family's languages vote on the language. A
family of one language needs no second vote. All machines are linear in the n-grams, so a
word's margins are computed once and remembered.

Training takes at most `per_language` documents of each language, those with the smallest
hash of the id, and fewer of each where there are more than MOST_ROWS / per_language
languages: MOST_ROWS divided by their number, LEAST_ROWS at least. No language is left out.
Prediction reads all documents in whole.

The training matrix is dense, MOST_ROWS by BUCKETS numbers at most while there are no more
than MOST_ROWS / LEAST_ROWS languages, and of the sampled texts it takes TRAINING_CHARS
characters, whole texts.

Defined results: null texts and texts without a letter are `und` with score 0; so is
everything if no training row exists; rows with a null lang are no training rows; ties of
votes go to the larger sum of margins, then to the smaller name; of rows that repeat an id
and a language the smallest text trains; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fitted, fold, released
from tessera.llm.subwords import WordRows, hashed_ngrams, words_of
from tessera.llm.toxicity import text_blocks

PER_LANGUAGE = 600
MOST_ROWS = 8_000
LEAST_ROWS = 20
SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 13
RIDGE = 1e-4

# Language codes of each family; a language of none is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "indic": "hi bn mr gu pa ur ne si",
    "semitic": "ar he am mt",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def _features(texts: list[str]) -> np.ndarray:
    """Shares of the n-gram buckets in each text."""
    documents = [words_of(t.lower()) for t in texts]
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, words in enumerate(documents):
        if words:
            grams, _ = hashed_ngrams(words, SIZES, BUCKETS, whole=False)
            out[i] = np.bincount(grams, minlength=BUCKETS) / len(grams)
    return out


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge) by accelerated gradient; y is -1 or 1."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    bound = 2 * float((share * ((x * x).sum(axis=1) + 1)).sum()) + RIDGE
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead_w + ahead_b)) * share * y
        new_w = ahead_w - (RIDGE * ahead_w - 2 * (slack @ x)) / bound
        new_b = ahead_b + 2 * float(slack.sum()) / bound
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w, ahead_b = new_w + (t - 1) / nt * (new_w - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new_w, new_b, nt
    return w, b


def train(texts: list[str], langs: list[str]) -> dict:
    x = _features(texts)
    weight = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    x *= weight * 0.1
    names = np.array(langs)
    kinds = np.array([family(v) for v in langs])
    duels, columns, biases = [], [], []

    def add(level: str, of: np.ndarray, among: np.ndarray) -> None:
        for a, b in combinations(sorted(set(of[among])), 2):
            rows = among[np.isin(of[among], [a, b])]
            w, c = _machine(x[rows], np.where(of[rows] == a, 1, -1).astype(np.float32))
            duels.append((level, str(a), str(b)))
            columns.append(w * weight * 0.1)
            biases.append(c)

    add("", kinds, np.arange(len(kinds)))
    members = {}
    for kind in sorted(set(kinds)):
        among = np.flatnonzero(kinds == kind)
        members[str(kind)] = sorted({str(v) for v in names[among]})
        add(str(kind), names, among)
    table = np.stack(columns, 1) if columns else np.zeros((BUCKETS, 0), np.float32)
    return {"duels": duels, "weights": table.astype(np.float32), "biases": np.array(biases), "members": members}


class Predictor:
    def __init__(self, model: dict):
        self.model = model
        self.rows = WordRows(self._margins, len(model["duels"]) + 1)

    def _margins(self, words: list[str]) -> np.ndarray:
        """Sums of each machine's weights over a word's n-grams, and their number."""
        grams, sizes = hashed_ngrams(words, SIZES, BUCKETS, whole=False)
        cuts = np.cumsum(sizes) - sizes
        table = self.model["weights"]
        sums = np.stack([np.add.reduceat(table[:, k][grams].astype(float), cuts) for k in range(table.shape[1])], 1) if table.shape[1] else np.zeros((len(words), 0))
        return np.column_stack([sums, sizes])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        sums = self.rows.sums([words_of(t.lower()) for t in texts])
        margins = sums[:, :-1] / np.maximum(1, sums[:, -1:]) + self.model["biases"]
        langs, scores = [], []
        for text, row in zip(texts, margins):
            if not any(map(str.isalpha, text)):
                langs.append("und")
                scores.append(0.0)
                continue
            kind, sure = self._vote("", sorted(self.model["members"]), row)
            lang, more = self._vote(kind, self.model["members"][kind], row)
            langs.append(lang)
            scores.append(sure * more)
        return langs, scores

    def _vote(self, level: str, names: list[str], row: np.ndarray) -> tuple[str, float]:
        votes = {n: [0, 0.0, np.inf] for n in names}
        for (of, a, b), margin in zip(self.model["duels"], row):
            if of == level:
                for n, m in ((a, margin), (b, -margin)):
                    votes[n] = [votes[n][0] + (m > 0), votes[n][1] + m, min(votes[n][2], m)]
        best = min(names, key=lambda n: (-votes[n][0], -votes[n][1], n))
        least = votes[best][2]
        return best, 1.0 if least == np.inf else float(1 / (1 + np.exp(-np.clip(2 * least, -60, 60))))


def fit(docs: DataFrame, train_rows=None, per_language: int = PER_LANGUAGE) -> dict | None:
    usable = docs.filter((F.lit(True) if train_rows is None else train_rows) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    place = F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id")
    # the smallest of each part of a language, then of the language: partial aggregates, no window over a hot one
    parts = usable.select("lang", (F.xxhash64("doc_id") % 64).alias("part"), place.alias("place")).distinct()
    smallest = lambda of: F.slice(F.sort_array(of), 1, per_language)
    by_part = parts.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("place"))).filter(F.col("n") <= per_language)
    by_lang = by_part.groupBy("lang").agg(smallest(F.collect_list("place")).alias("places"))
    share = by_lang.agg(F.count("*").alias("langs")).select(F.greatest(F.lit(LEAST_ROWS), F.floor(MOST_ROWS / F.greatest("langs", F.lit(1)))).alias("share"))
    chosen = by_lang.crossJoin(F.broadcast(share)).select(F.col("lang").alias("c_lang"), F.explode(F.slice("places", F.lit(1), F.col("share").cast("int"))).alias("place"))  # one row
    chosen = chosen.select("c_lang", F.col("place.doc_id").alias("c_doc"), F.col("place.hash").alias("place"))
    sample = usable.join(F.broadcast(chosen), (F.col("doc_id") == F.col("c_doc")) & (F.col("lang") == F.col("c_lang"))).groupBy("place", "doc_id", "lang").agg(F.min("text").alias("text"))

    def learn(table: pa.Table) -> dict:
        return train(table["text"].to_pylist(), table["lang"].to_pylist())

    return fitted(sample, learn, ["place", "doc_id", "text", "lang"], ["place", "doc_id", "lang", "text"], "text")


def languages(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score; lang of the held-out fold is never read."""
    model = fit(docs, fold("doc_id", folds) != held_out)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a machine

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = Predictor(shipped.value) if shipped.value else None
        for texts in batches:
            langs, scores = [], []
            for part in text_blocks(texts):
                found = predictor.predict(part) if predictor else (["und"] * len(part), [0.0] * len(part))
                langs += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])
        del predictor
        released()

    found = docs.select("doc_id", predicted(F.col("text")).alias("found"))
    return found.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "found.lang_pred", "found.score")
