"""Sessions, feedback, audit and version logs as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.checks import valid_rows

# How the events of the test tables stand for feedback.
FEEDBACK_TYPES = {"purchase": "like", "error": "dislike", "view": "partial_correct", "click": "correction"}


def session_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: each user text with the assistant text after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    spoken = conversations.filter("role <> 'system'").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return spoken.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def flattened_turns(turns: DataFrame) -> DataFrame:
    """The inverse of session_turns: conv_id, turn, role, text."""
    two = F.array(
        F.struct(F.col("turn").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")),
        F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")),
    )
    return turns.select("conv_id", F.explode(two).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def recent(turns: DataFrame, n: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each session; all of them for n <= 0."""
    if n <= 0:
        return turns
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def history_context(turns: DataFrame, n: int = 5) -> DataFrame:
    """conv_id, context: the last n turns as numbered questions and answers."""
    last = recent(turns, n).withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    line = F.concat(F.lit("第"), F.col("i").cast("string"), F.lit("轮:\n  问："), F.coalesce("question", F.lit("")), F.lit("\n  答："), F.coalesce("answer", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("i", line.alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("context"))


def _tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")), "")


def relevant_history(turns: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """Of each session's last 2n turns the n that share most words with the session's query.

    queries has conv_id, query. Adds overlap and rank; turns without a shared word are left out.
    """
    shared = F.size(F.array_intersect(_tokens(F.col("query")), _tokens(F.col("question"))))
    scored = recent(turns, 2 * n).join(queries, "conv_id").withColumn("overlap", shared).filter("overlap > 0")
    w = Window.partitionBy("conv_id").orderBy(F.desc("overlap"), "turn")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def session_list(events: DataFrame, session: str = "user_id", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.col(session).alias("session_id")).agg(F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), F.count("*").alias("message_count"))


def session_delete(turns: DataFrame, gone: DataFrame, by: str = "conv_id") -> DataFrame:
    return turns.join(gone.select(by).distinct(), by, "left_anti")


def top_questions(turns: DataFrame, key: Column, n: int = 20, least: int = 4) -> DataFrame:
    """question_key, times, first_text, rank of the n most asked questions.

    The n rows are taken before they are numbered, so that no window holds the corpus.
    """
    asked = turns.withColumn("question_key", key).filter(F.length("question_key") >= least)
    where = F.struct("conv_id", "turn")
    counted = asked.groupBy("question_key").agg(F.count("*").alias("times"), F.min_by("question", where).alias("first_text"), F.min(where).alias("first"))
    best = counted.orderBy(F.desc("times"), "first").limit(n)
    w = Window.orderBy(F.desc("times"), "first")
    return best.withColumn("rank", F.row_number().over(w)).select("question_key", "times", "first_text", "rank")


def feedback(events: DataFrame) -> DataFrame:
    """Feedback rows of the events table: session_id, user_id, feedback_type, content, ts."""
    kinds = F.create_map(*[F.lit(x) for pair in FEEDBACK_TYPES.items() for x in pair])
    typed = events.withColumn("feedback_type", F.try_element_at(kinds, F.col("event_type"))).filter("feedback_type is not null")
    return typed.select("event_id", F.col("user_id").alias("session_id"), "user_id", "feedback_type", F.col("props").alias("content"), "ts")


def feedback_measures() -> list[Column]:
    """The aggregates of a feedback report; they serve batch and streaming groups."""
    n = F.count("*")
    of = lambda *kinds: F.count_if(F.col("feedback_type").isin(*kinds))
    return [
        n.alias("total_feedback"),
        of("like").alias("likes"),
        of("dislike").alias("dislikes"),
        of("partial_correct").alias("partial_correct"),
        of("correction").alias("corrections"),
        F.coalesce(of("like") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("satisfaction_rate"),
        F.coalesce(of("dislike", "partial_correct") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("error_rate"),
    ]


def feedback_validate(rows: DataFrame) -> DataFrame:
    """Adds valid: a correction needs content."""
    has = F.trim(F.coalesce("content", F.lit(""))) != ""
    return rows.withColumn("valid", (F.col("feedback_type") != "correction") | has)


def feedback_accepted(rows: DataFrame) -> DataFrame:
    """rows; the job fails at a correction without content."""
    return valid_rows(rows, (F.col("feedback_type") != "correction") | (F.trim(F.coalesce("content", F.lit(""))) != ""), "a correction needs content")


def version_state(log: DataFrame) -> DataFrame:
    """version, status, is_current from a log of (seq, op, version).

    create: the first one of a version counts, later ones are rejected. publish and
    rollback need a version created before; the version they name becomes the published one
    and the one published before is archived. So at the end the last valid publish is
    published, every other version that ever was is archived, the rest are drafts.
    """
    created = log.filter("op = 'create'").groupBy("version").agg(F.min("seq").alias("created_seq"))
    published = log.filter("op in ('publish', 'rollback')").join(created, "version").filter("seq > created_seq")
    last = published.groupBy("version").agg(F.max("seq").alias("last_seq"))
    current = published.agg(F.max_by("version", "seq").alias("current"))
    state = created.join(last, "version", "left").crossJoin(F.broadcast(current))  # one row
    is_current = F.coalesce(F.col("version") == F.col("current"), F.lit(False))
    status = F.when(is_current, "published").when(F.col("last_seq").isNotNull(), "archived").otherwise("draft")
    return state.select("version", status.alias("status"), is_current.alias("is_current"), "created_seq")


def failure_streaks(events: DataFrame, failed: Column, least: int = 3, by: str = "user_id", ts: str = "ts", open_s: int = 90) -> DataFrame:
    """Runs of at least `least` failures of one key: start, the moment the breaker opens and
    closes again, and the run's length. A success ends a run (gaps and islands)."""
    w = Window.partitionBy(by).orderBy(ts, "event_id")
    marked = events.withColumn("failed", failed).withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    runs = marked.filter("failed").withColumn("n", F.row_number().over(Window.partitionBy(by, "island").orderBy(ts, "event_id")))
    found = runs.groupBy(by, "island").agg(F.min(ts).alias("started_at"), F.min(F.when(F.col("n") == least, F.col(ts))).alias("opened_at"), F.count("*").alias("failures"))
    return found.filter(F.col("failures") >= least).select(by, "started_at", "opened_at", (F.col("opened_at") + F.make_dt_interval(secs=F.lit(open_s))).alias("closes_at"), "failures")


def gaps(rows: DataFrame, group: str, time_us: str, order: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """rows with gap_us, the time since the row before it in its group, null for the first.

    A group is dealt into ranges of time; the first row of a range takes its predecessor from
    the last row of the range before, so no task holds a whole group.
    """
    keyed = rows.withColumn("_range", F.floor(F.col(time_us) / bucket_us))
    inside = keyed.withColumn("_before", F.lag(time_us).over(Window.partitionBy(group, "_range").orderBy(time_us, order)))
    last = keyed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_its")).agg(F.max(time_us).alias("_last"))
    edges = last.withColumn("_edge", F.lag("_last").over(Window.partitionBy("_group").orderBy("_its"))).drop("_last")
    joined = inside.join(edges, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_its")))
    return joined.withColumn("gap_us", F.col(time_us) - F.coalesce("_before", "_edge")).drop("_range", "_before", "_group", "_its", "_edge")
