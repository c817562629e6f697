"""Queries over conversations, feedback, audit and version logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import logs
from tessera.operators.ranks import group_rank
from tessera.plans.registry import query
from tessera.plans.texts import PAIRS, PUNCT, SP, conversations
from tessera.session import table
from tessera.shared import scratch
from tessera.sources import daily

FEEDBACK = """feedback as (
  select event_id, user_id as session_id, user_id, case event_type when 'purchase' then 'like' when 'error' then 'dislike' when 'view' then 'partial_correct' else 'correction' end as feedback_type,
    props as content, ts from events where event_type in ('purchase', 'error', 'view', 'click'))"""
MEASURES = """count(*) as total_feedback, count(*) filter (feedback_type = 'like') as likes, count(*) filter (feedback_type = 'dislike') as dislikes,
  count(*) filter (feedback_type = 'partial_correct') as partial_correct, count(*) filter (feedback_type = 'correction') as corrections,
  coalesce(count(*) filter (feedback_type = 'like') / nullif(count(*), 0), 0.0) as satisfaction_rate,
  coalesce(count(*) filter (feedback_type in ('dislike', 'partial_correct')) / nullif(count(*), 0), 0.0) as error_rate"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.session_turns(conversations(spark, sf_dir))


@query("select user_id as session_id, min(ts) as created_at, max(ts) as updated_at, count(*) as message_count from events group by user_id")
def session_list(spark, sf_dir):
    return logs.session_list(events(spark, sf_dir))


@query(f"with {PAIRS} select * from pairs")
def session_turns(spark, sf_dir):
    return turns(spark, sf_dir)


@query(f"with {PAIRS} select conv_id, turn, 'user' as role, question as text from pairs union all select conv_id, turn + 1, 'assistant', answer from pairs")
def session_messages(spark, sf_dir):
    return logs.flattened_turns(turns(spark, sf_dir))


@query(f"with {PAIRS}, r as (select *, row_number() over (partition by conv_id order by turn desc) as n from pairs) select conv_id, turn, question, answer from r where n <= 2")
def recent_history(spark, sf_dir):
    return logs.recent(turns(spark, sf_dir), 2)


@query(
    f"""with {PAIRS}, r as (select *, row_number() over (partition by conv_id order by turn desc) as n from pairs), l as (select *, row_number() over (partition by conv_id order by turn) as i from r where n <= 5)
    select conv_id, string_agg('第' || i || '轮:' || chr(10) || '  问：' || question || chr(10) || '  答：' || answer, chr(10) order by i) as context from l group by conv_id"""
)
def history_context(spark, sf_dir):
    return logs.history_context(turns(spark, sf_dir))


@query(
    f"""with {PAIRS}, q as (select conv_id, max_by(question, turn) as query from pairs group by conv_id),
    r as (select *, row_number() over (partition by conv_id order by turn desc) as n from pairs),
    s as (select r.conv_id, r.turn, len(list_intersect(list_filter(list_distinct(string_split_regex(lower(q.query), '\\s+')), lambda x: x <> ''), list_filter(list_distinct(string_split_regex(lower(r.question), '\\s+')), lambda x: x <> '')))::int as overlap
      from r join q using (conv_id) where n <= 10),
    k as (select *, row_number() over (partition by conv_id order by overlap desc, turn)::int as rank from s where overlap > 0)
    select * from k where rank <= 5"""
)
def relevant_history(spark, sf_dir):
    all_turns = turns(spark, sf_dir)
    asked = all_turns.groupBy("conv_id").agg(F.max_by("question", "turn").alias("query"))
    return logs.relevant_history(all_turns, asked).select("conv_id", "turn", "overlap", "rank")


@query("select count(distinct conv_id) as sessions, count(*) as messages, count(*) filter (role = 'user') as questions, max(turn) as last_turn from conversations")
def session_stats(spark, sf_dir):
    return conversations(spark, sf_dir).agg(F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("questions"), F.max("turn").alias("last_turn"))


@query("select * from conversations where conv_id not in (select conv_id from conversations where role = 'system')")
def session_delete(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    return logs.session_delete(rows, rows.filter("role = 'system'"))


@query(
    f"""with {PAIRS}, k as (select *, lower(regexp_replace(regexp_replace(question, '{SP}+', '', 'g'), '{PUNCT}', '', 'g')) as question_key from pairs),
    g as (select question_key, count(*) as times, arg_min(question, row(conv_id, turn)) as first_text, min(row(conv_id, turn)) as first from k where len(question_key) >= 4 group by 1),
    r as (select *, row_number() over (order by times desc, first)::int as rank from g)
    select question_key, times, first_text, rank from r where rank <= 20"""
)
def top_questions(spark, sf_dir):
    return logs.top_questions(turns(spark, sf_dir), tx.norm_question_key(F.col("question")))


@query(f"with {FEEDBACK} select session_id, {MEASURES} from feedback group by session_id")
def feedback_by_session(spark, sf_dir):
    return logs.feedback(events(spark, sf_dir)).groupBy("session_id").agg(*logs.feedback_measures())


@query(f"with {FEEDBACK} select user_id, feedback_type, count(*) as n, max(ts) as last_ts from feedback group by all")
def feedback_by_user(spark, sf_dir):
    return logs.feedback(events(spark, sf_dir)).groupBy("user_id", "feedback_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query(f"with {FEEDBACK} select * from feedback")
def feedback_all(spark, sf_dir):
    return logs.feedback(events(spark, sf_dir))


@query(f"with {FEEDBACK} select {MEASURES}, count(distinct user_id) as unique_users, count(distinct session_id) as unique_sessions, (select string_agg(event_id::varchar, ',' order by ts desc, event_id) from (select event_id, ts from feedback order by ts desc, event_id limit 5)) as recent from feedback")
def feedback_stats(spark, sf_dir):
    rows = logs.feedback(events(spark, sf_dir))
    latest = rows.orderBy(F.desc("ts"), "event_id").limit(5)  # five rows, so the list is bounded
    listed = latest.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"), "event_id"))), lambda s: s["event_id"].cast("string")), ",").alias("recent"))
    return rows.agg(*logs.feedback_measures(), F.countDistinct("user_id").alias("unique_users"), F.countDistinct("session_id").alias("unique_sessions")).crossJoin(listed)


@query(f"with {FEEDBACK} select event_id, feedback_type, feedback_type <> 'correction' or trim(coalesce(case when event_id % 7 = 0 then '' else content end, '')) <> '' as valid from feedback")
def feedback_validate(spark, sf_dir):
    rows = logs.feedback(events(spark, sf_dir)).withColumn("content", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("content")))
    return logs.feedback_validate(rows).select("event_id", "feedback_type", "valid")


@query(
    f"""with {FEEDBACK}, {PAIRS}, f as (select count(*) as n, count(*) filter (feedback_type = 'like') as likes from feedback), t as (select count(*) as turns, count(distinct conv_id) as sessions from pairs), v as (select count(*) as vectors from embeddings)
    select sessions, turns, vectors, coalesce(100.0::double * likes / nullif(n, 0), 0.0) as satisfaction, coalesce(least(100, round(100.0::double * n / nullif(turns, 0))), 0.0)::double as coverage from f, t, v"""
)
def dashboard(spark, sf_dir):
    f = logs.feedback(events(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_if(F.col("feedback_type") == "like").alias("likes"))
    t = turns(spark, sf_dir).agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("sessions"))
    v = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"))
    one = f.crossJoin(t).crossJoin(v)  # single rows
    rate = F.coalesce(100.0 * F.col("likes") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    coverage = F.coalesce(F.least(F.lit(100.0), F.round(100.0 * F.col("n") / F.nullif(F.col("turns"), F.lit(0)))), F.lit(0.0))
    return one.select("sessions", "turns", "vectors", rate.alias("satisfaction"), coverage.alias("coverage"))


@query("select event_id, user_id, event_type as action, props as details, ts from events where ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-16'")
def audit_by_day(spark, sf_dir):
    day = F.lit("2024-01-15").cast("date")
    inside = (F.col("ts") >= day.cast("timestamp_ntz")) & (F.col("ts") < F.date_add(day, 1).cast("timestamp_ntz"))  # a range, so that the scan can skip row groups
    return events(spark, sf_dir).filter(inside).select("event_id", "user_id", F.col("event_type").alias("action"), F.col("props").alias("details"), "ts")


@query("select strftime(ts, '%Y-%m-%d') as day, event_type as action, count(*) as n, count(distinct user_id) as users from events group by rollup (strftime(ts, '%Y-%m-%d'), event_type)")
def audit_rollup(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("action"), "user_id")
    return rows.rollup("day", "action").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    """with log as (select event_id as seq, user_id as version, ['create', 'publish', 'rollback'][(event_id % 3 + 1)::int] as op from events),
    created as (select version, min(seq) as created_seq from log where op = 'create' group by 1),
    pub as (select log.* from log join created using (version) where op <> 'create' and seq > created_seq),
    cur as (select arg_max(version, seq) as current from pub)
    select version, case when version = current then 'published' when version in (select version from pub) then 'archived' else 'draft' end as status, coalesce(version = current, false) as is_current, created_seq from created, cur"""
)
def version_state(spark, sf_dir):
    op = F.element_at(F.array(F.lit("create"), F.lit("publish"), F.lit("rollback")), (F.col("event_id") % 3 + 1).cast("int"))
    return logs.version_state(events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("version"), op.alias("op")))


@query(
    "select source as version, doc_id // 1024 as part, count(*) as n, sum(count(*)) over (partition by source)::bigint as document_count, md5(string_agg(doc_id::varchar, ',' order by doc_id)) as documents_md5 from documents group by 1, 2"
)
def version_documents(spark, sf_dir):
    """The documents of each version, in ranges of ids, since a version may hold any number."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    parts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("version"), F.floor(F.col("doc_id") / 1024).alias("part")).agg(F.count("*").alias("n"), F.md5(ids).alias("documents_md5"))
    return parts.withColumn("document_count", F.sum("n").over(Window.partitionBy("version")))  # a row per range


@query("select source as version, doc_id, md5(text) as file_hash, row_number() over (partition by source order by doc_id)::int as n, count(*) over (partition by source) as document_count from documents")
def version_detail(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("version"), "doc_id", F.md5("text").alias("file_hash"))
    placed = group_rank(rows, "version", F.floor(F.col("doc_id") / 65_536), "doc_id", name="n", size="document_count")
    return placed.withColumn("n", F.col("n").cast("int"))


@query(
    """with m as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id) as island from events),
    r as (select *, row_number() over (partition by user_id, island order by ts, event_id) as n from m where event_type = 'error'),
    g as (select user_id, min(ts) as started_at, min(case when n = 3 then ts end) as opened_at, count(*) as failures from r group by user_id, island)
    select user_id, started_at, opened_at, opened_at + interval 90 second as closes_at, failures from g where failures >= 3"""
)
def failure_streaks(spark, sf_dir):
    return logs.failure_streaks(events(spark, sf_dir), F.col("event_type") == "error")


@query(
    """with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts, event_id) as gap_us from events)
    select event_id, event_type, gap_us, 20.0::double * pow(2, event_id % 4) as backoff_s from g where gap_us < 2500000"""
)
def min_interval_gaps(spark, sf_dir):
    timed = events(spark, sf_dir).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = logs.gaps(timed, "event_type", "us", "event_id")
    return rows.filter("gap_us < 2500000").select("event_id", "event_type", "gap_us", (20.0 * F.pow(F.lit(2.0), F.col("event_id") % 4)).alias("backoff_s"))


@query("select event_id, ts, ts >= timestamp '2024-01-20' - interval 7 day as fresh from events where ts <= timestamp '2024-01-20'")
def ttl_freshness(spark, sf_dir):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return events(spark, sf_dir).filter(F.col("ts") <= now).select("event_id", "ts", (F.col("ts") >= now - F.expr("interval 7 days")).alias("fresh"))


@query(
    """with g as (select user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events)
    select user_id, max(gap) as longest_gap_us, coalesce(max(gap) > 43200000000, false) as idle_timeout, max(epoch_us(ts)) - min(epoch_us(ts)) > 2160000000000 as total_timeout from g group by user_id"""
)
def timeout_flags(spark, sf_dir):
    from pyspark.sql import Window

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events(spark, sf_dir).select("user_id", micros.alias("us"), (micros - F.lag(micros).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap"))
    return rows.groupBy("user_id").agg(F.max("gap").alias("longest_gap_us"), F.coalesce(F.max("gap") > 43_200_000_000, F.lit(False)).alias("idle_timeout"), (F.max("us") - F.min("us") > 2_160_000_000_000).alias("total_timeout"))


AUDIT_ROW = "event_id long, user_id long, action string, details string, ts timestamp_ntz"


def audit_days(spark, sf_dir):
    """The audit log as a table by day, with the 15th written once more by a late rerun."""
    rows = events(spark, sf_dir).select("event_id", "user_id", F.col("event_type").alias("action"), F.col("props").alias("details"), "ts")
    path = scratch(spark, "audit-days")
    daily.write_days(rows.withColumn("action", F.when(F.to_date("ts") == "2024-01-15", "unread").otherwise(F.col("action"))), path)
    daily.write_days(rows.filter(F.to_date("ts") == "2024-01-15"), path)
    return path


@query("select event_id, user_id, event_type as action, props as details, ts, strftime(ts, '%Y-%m-%d') as day from events where ts >= timestamp '2024-01-14' and ts < timestamp '2024-01-17'")
def audit_table_days(spark, sf_dir):
    """Three days of the table, of which one was replaced after it had been written."""
    rows = daily.read_days(spark, audit_days(spark, sf_dir), AUDIT_ROW, "2024-01-14", "2024-01-16")
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


FEEDBACK_ROW = "event_id long, session_id long, user_id long, feedback_type string, content string, ts timestamp_ntz"


@query(f"with {FEEDBACK} select strftime(ts, '%Y-%m-%d') as day, {MEASURES} from feedback where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-15' group by 1")
def feedback_table_week(spark, sf_dir):
    """Measures of each day of a week from the feedback log by day."""
    path = scratch(spark, "feedback-days")
    daily.write_days(logs.feedback(events(spark, sf_dir)), path)
    rows = daily.read_days(spark, path, FEEDBACK_ROW, "2024-01-08", "2024-01-14")
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(*logs.feedback_measures())
