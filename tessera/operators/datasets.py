"""Building question-answer and label datasets: scoring, sampling, balancing, splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.checks import required
from tessera.operators.ranks import global_rank, group_rank, hash_bucket, hash_order


def stratified_split(rows: DataFrame, label: str, key: str, shares: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """Adds split: inside each label the first shares by seeded hash, the last split the rest."""
    hashed = rows.withColumn("_hash", hash_order(F.col(key), seed))
    placed = group_rank(hashed, label, hash_bucket(F.col("_hash")), "_hash", key, name="_n", size="_total")
    split, end = F.lit(shares[-1][0]), 0.0
    cuts = []
    for name, share in shares[:-1]:
        end += share
        cuts.append((name, end))
    for name, end in reversed(cuts):
        split = F.when(F.col("_n") <= F.floor(F.col("_total") * end), name).otherwise(split)
    return placed.withColumn("split", split).drop("_n", "_total", "_hash")


def fixed_count_split(rows: DataFrame, key: str, counts: Sequence[tuple[str, int]], seed: int = 42, exact: bool = False) -> DataFrame:
    """key, split: exact counts in seeded order; rows beyond their sum get no split.

    With exact, the job fails unless the counts add up to the number of rows.
    """
    hashed = rows.withColumn("_hash", hash_order(F.col(key), seed))
    ranked = global_rank(hashed, hash_bucket(F.col("_hash")), "_hash", key, name="_rank")
    split, end = F.lit(None).cast("string"), 0
    edges = []
    for name, n in counts:
        end += n
        edges.append((name, end))
    end_of_all = end
    for name, end in reversed(edges):
        split = F.when(F.col("_rank") <= end, name).otherwise(split)
    found = ranked.withColumn("split", split).drop("_hash", "_rank")
    if exact:
        found = required(found, F.count("*") == end_of_all, f"the splits hold {end_of_all} rows, the table another number", rows)
    return found


def balance_classes(rows: DataFrame, label: str, order: str, per_class: int, bucket: int = 65_536) -> DataFrame:
    """per_class rows of each label: the first ones by a number, repeated in turn where there are fewer.

    A label is numbered by ranges of the order, so no task holds a whole label.
    """
    placed = group_rank(rows, label, F.floor(F.col(order) / bucket), order, name="_n", size="_total")
    times = F.ceil((F.lit(per_class) - F.col("_n") + 1) / F.col("_total"))
    return placed.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_n", "_total")


def cycle_to_target(rows: DataFrame, order: str, target: int, bucket: int = 65_536) -> DataFrame:
    """The whole set repeated in order until there are `target` rows; adds position and copy."""
    ranked = global_rank(rows, F.floor(F.col(order) / bucket), order, name="_rank")
    size = rows.agg(F.count("*").alias("_size"))
    times = F.ceil((F.lit(target) - F.col("_rank") + 1) / F.col("_size")).cast("int")
    repeated = ranked.crossJoin(F.broadcast(size)).filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))  # one row
    return repeated.withColumn("position", (F.col("copy") - 1) * F.col("_size") + F.col("_rank")).drop("_rank", "_size")


def quota_sample(rows: DataFrame, label: str, key: str, quotas: dict, seed: int = 42) -> DataFrame:
    """Up to the label's quota of rows by seeded hash; labels without a quota go.

    A label is numbered by ranges of the hash, so no task holds a whole label.
    """
    quota = F.try_element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col(label))
    hashed = rows.filter(F.coalesce(quota, F.lit(0)) > 0).withColumn("_hash", hash_order(F.col(key), seed))
    placed = group_rank(hashed, label, hash_bucket(F.col("_hash")), "_hash", key, name="_n")
    return placed.filter(F.col("_n") <= quota).drop("_n", "_hash")


def dedup_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, chosen by digest so that texts aren't shuffled for it.

    Rows that repeat the key and the order value all stay; null orders come last.
    """
    keyed = rows.withColumn("_key", F.md5(key))
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    kept = keyed.join(first.withColumnRenamed("_key", "_its_key"), F.col("_key").eqNullSafe(F.col("_its_key")) & F.col(order).eqNullSafe(F.col("_first")), "left_semi")
    return kept.drop("_key")


def _points(*rules: tuple[Column, float]) -> Column:
    parts = [F.when(when, F.lit(float(by))).otherwise(0.0) for when, by in rules]
    return sum(parts[1:], parts[0])


def final_union(*parts: DataFrame) -> DataFrame:
    """The parts one behind the other; the job fails if a row has no label or no row remains."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return required(both, (F.count("*") > 0) & (F.count("*") == F.count("label")), "the union is empty or has rows without a label")


def qa_score_a(question: Column, answer: Column, context: Column, char_class: str = tx.HAN, ends: Sequence[str] = ("？", "?"), listing: Sequence[str] = ("、", "，", "。"), banned_start: str = "谁主编了现代采矿手册", banned: Sequence[str] = ("ISBN", "页码")) -> Column:
    """Points for well-formed questions, answers and contexts, fewer for known faults."""
    q, a, c = tx.norm_question_curated(question), tx.without_space(answer), tx.without_space(context)
    broken = F.lit("�" * 4)
    ends_ok = F.endswith(q, F.lit(ends[0]))
    for e in ends[1:]:
        ends_ok = ends_ok | F.endswith(q, F.lit(e))
    return _points(
        (F.length(q).between(6, 28), 2),
        (tx.matches(q, char_class + "{2,}"), 2),
        (ends_ok, 1),
        (F.size(F.array_distinct(F.split(q, ""))) >= 5, 1),
        (F.length(a).between(2, 24), 1),
        (tx.matches(a, char_class), 2),
        (~tx.matches(a, r"^[\d.\-]+$"), 1),
        (tx.keyword_any(a, listing), 0.5),
        (F.length(c) >= 120, 1),
        (tx.matches(c, char_class + "{20,}"), 1),
        (F.startswith(q, F.lit(banned_start)), -4),
        (tx.matches(a, r"^[\d.]+$"), -2),
        ((F.length(a) <= 4) & tx.matches(a, r"^\d"), -1),
        (tx.keyword_any(q, banned), -2),
        (tx.keyword_any(a, banned), -2),
        (F.contains(q, broken) | F.contains(a, broken), -4),
    )


def quality_tier(score: Column) -> Column:
    return F.when(score >= 7.5, "high").when(score >= 5.0, "medium").otherwise("low")


def qa_score_b(question: Column, answer: Column, context: Column, char_class: str = tx.HAN, end: str = "？", how_many: Sequence[str] = ("多少", "几"), topic: Sequence[str] = ("矿",), blacklist: Sequence[str] = (r"^\d+$",), cover: Sequence[Sequence[str]] = (), latin: str = r"[A-Za-z]{2,}") -> Column:
    """A second score: readable questions, answers of the class, contexts on topic."""
    q, a, c = question, tx.strip(tx.given(answer)), tx.given(context)
    numeric = tx.matches(a, r"^[\d.]+$")
    rules = [
        (F.length(q).between(6, 36), 2),
        (tx.char_class_count(q, char_class) >= 4, 2),
        (F.endswith(q, F.lit(end)), 1),
        (tx.matches(q, latin), -2),
        (tx.matches(q, r"[=:/\\]"), -2),
        (tx.matches(q, r"\d{4,}"), -1),
        (F.length(a).between(2, 24), 1),
        (tx.char_class_count(a, char_class) >= 1, 2),
        (numeric, -3),
        (numeric & tx.keyword_any(q, how_many) & (F.length(a) <= 6), 1),
        (tx.char_class_count(c, char_class) >= 40, 1),
        (tx.keyword_any(q, topic) | tx.keyword_any(c, topic), 2),
        (tx.blacklist_regex(q, blacklist), -4),
    ]
    if cover:
        rules.append((tx.cover_page_flag(c, cover), -5))
    return _points(*rules)


def best_per_question(rows: DataFrame, key: Column, least: float) -> DataFrame:
    """The highest score per question key, at least `least`; ties go to the first position."""
    w = Window.partitionBy("question_key").orderBy(F.desc("score"), "pos")
    return rows.filter(F.col("score") >= least).withColumn("question_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_per_question_counts(rows: DataFrame, key: Column, least: float, cover: Column) -> DataFrame:
    """One row: rows, dropped_cover, dropped_low, questions. Cover pages go before scores are asked."""
    low = ~cover & ~F.coalesce(F.col("score") >= least, F.lit(False))
    kept = F.when(~cover & ~low, F.md5(key))
    return rows.agg(F.count("*").alias("rows"), F.count_if(cover).alias("dropped_cover"), F.count_if(low).alias("dropped_low"), F.countDistinct(kept).alias("questions"))


def staged_counts(rows: DataFrame, n: int) -> DataFrame:
    """stage, pool, questions, chosen: rows of each stage, those whose question has no earlier
    stage, and those among the n of staged_topn."""
    pool = rows.groupBy("stage").agg(F.count("*").alias("pool"))
    first = rows.groupBy("question_key").agg(F.min("stage").alias("stage")).groupBy("stage").agg(F.count("*").alias("questions"))
    before = F.coalesce(F.sum("questions").over(Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per stage
    chosen = F.greatest(F.lit(0), F.least(F.col("questions"), n - before))
    both = pool.join(first, "stage", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))
    return both.withColumn("chosen", chosen)


def staged_topn(rows: DataFrame, n: int) -> DataFrame:
    """n rows filled from ordered stages: of each key the row of its first stage, stages in
    order, inside a stage by score; the result is ranked by score. rows has question_key,
    stage, score, question, pos. Only the n chosen rows meet in a window."""
    w = Window.partitionBy("question_key").orderBy("stage", F.desc("score"), "pos")
    once = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    chosen = once.orderBy("stage", F.desc("score"), "question", "pos").limit(n)
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "question", "pos")))
