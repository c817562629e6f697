"""Evaluation metrics: overlap, support, latency reports, ranking and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx


def unsupported_rate(rows: DataFrame, keys: list[str], least: float = 0.12) -> DataFrame:
    """keys, rate: the share of answer sentences whose bigrams the context supports too little.

    rows has answer, context. An answer without sentences counts 1 if it isn't blank, else 0.
    """
    grams = tx.char_ngrams(F.col("context"))
    sentences = rows.select(*keys, grams.alias("context_grams"), F.explode(tx.claim_sentences(F.col("answer"))).alias("sentence"))
    weak = (tx.overlap_ratio(tx.char_ngrams(F.col("sentence")), F.col("context_grams")) < least).cast("int")
    rates = sentences.groupBy(*keys).agg(F.avg(weak).alias("rate"))
    blank = tx.strip(tx.given(F.col("answer"))) == ""
    return rows.select(*keys, blank.alias("blank")).join(rates, keys, "left").select(*keys, F.coalesce("rate", F.when(F.col("blank"), 0.0).otherwise(1.0)).alias("rate"))


def km_report(runs: DataFrame) -> DataFrame:
    """One row per configuration (k, m). runs has k, m, latency, hit, unsupported, outcome.

    Latency counts every run, quality only those that succeeded.
    """
    ok = F.col("outcome") == "ok"
    return runs.groupBy("k", "m").agg(
        F.count("*").alias("runs"),
        F.avg("latency").alias("latency_mean"),
        F.percentile("latency", 0.95).alias("latency_p95"),
        F.avg(F.when(ok, F.col("hit"))).alias("hit_quality"),
        F.avg(F.when(ok, F.col("unsupported"))).alias("unsupported_rate"),
        F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )


def ranking_metrics(ranked: DataFrame, queries: DataFrame, relevant: Column, cut: int = 5, deep: int = 10) -> DataFrame:
    """queries, mrr, hit, recall over all queries. ranked has query_id, rank; queries has query_id, n_relevant."""
    found = ranked.withColumn("relevant", relevant).filter("relevant").groupBy("query_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= deep).alias("deep"))
    joined = queries.join(found, "query_id", "left")
    return joined.agg(
        F.count("*").alias("queries"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce((F.col("first") <= cut).cast("int"), F.lit(0))).alias("hit_at_cut"),
        F.avg(F.coalesce(F.col("deep") / F.nullif(F.col("n_relevant"), F.lit(0)), F.lit(0.0))).alias("recall_deep"),
    )


def confusion_matrix(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """actual, predicted, n, share of the actual class."""
    counts = rows.groupBy(F.col(true).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def classification_report(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1, accuracy, macro_f1, weighted_f1, rating, is_best, is_worst."""
    counts = confusion_matrix(rows, true, predicted)
    t = counts.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"))
    p = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    hit = counts.filter(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("label"), F.col("n").alias("hits"))
    joined = t.join(p, "label", "full").join(hit, "label", "left").na.fill(0, ["support", "guessed", "hits"])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    scored = joined.withColumns({"precision": ratio("hits", "guessed"), "recall": ratio("hits", "support")})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    everyone = Window.partitionBy()  # a row per label
    total = F.sum("support").over(everyone)
    full = scored.withColumn("f1", f1).withColumns(
        {
            "accuracy": F.sum("hits").over(everyone) / total,
            "macro_f1": F.avg("f1").over(everyone),
            "weighted_f1": F.sum(F.col("f1") * F.col("support")).over(everyone) / total,
            "is_best": F.row_number().over(everyone.orderBy(F.desc("f1"), "label")) == 1,
            "is_worst": F.row_number().over(everyone.orderBy("f1", "label")) == 1,
        }
    )
    bands = F.when(F.col("accuracy") >= 0.85, "excellent").when(F.col("accuracy") >= 0.8, "good").when(F.col("accuracy") >= 0.75, "fair").otherwise("poor")
    return full.select("label", "support", "precision", "recall", "f1", "accuracy", "macro_f1", "weighted_f1", bands.alias("rating"), "is_best", "is_worst")
