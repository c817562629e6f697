"""Queries of the streaming jobs, run once over what the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.logs import FEEDBACK, MEASURES
from tessera.plans.registry import query
from tessera.shared import scratch
from tessera.streaming import jobs, stateful


def _plain(df, *columns):
    """Instants as text, so that engines with and without time zones agree."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query(f"with {FEEDBACK} select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M:%S.000000') as start, {MEASURES} from feedback group by time_bucket(interval 1 day, ts)")
def stream_feedback_stats(spark, sf_dir):
    """Complete mode: every day, the open one included."""
    return _plain(jobs.run_available(jobs.feedback_stats(jobs.events_stream(spark, sf_dir)), scratch(spark, "feedback"), "complete"))


@query(
    """with d as (select time_bucket(interval 1 day, ts) as day, event_type as action, count(*) as n from events group by all)
    select strftime(day, '%Y-%m-%d %H:%M:%S.000000') as start, action, n from d where day + interval 1 day <= (select max(ts) from events) - interval 1 hour"""
)
def stream_audit_daily(spark, sf_dir):
    """Append mode: the days that end before the last watermark."""
    return _plain(jobs.run_available(jobs.audit_daily(jobs.events_stream(spark, sf_dir)), scratch(spark, "audit")))


@query("with u as (select md5(text) as id, source, doc_id as pos, row_number() over (partition by md5(text) order by doc_id desc) as n from documents) select id, source, pos from u where n = 1")
def stream_kb_upsert(spark, sf_dir):
    path = scratch(spark, "chunks")
    stream = jobs.table_stream(spark, sf_dir, "documents").select("text", "source", F.col("doc_id").alias("pos"))
    run = stream.writeStream.foreachBatch(jobs.append_batches(f"{path}/table")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return jobs.chunk_table(spark, f"{path}/table").select("id", "source", "pos")


@query(
    """with g as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour, true) as fresh from events), s as (select *, sum(fresh::int) over (partition by user_id order by ts) as k from g),
    r as (select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as n from s group by user_id, k)
    select user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') as start, strftime("end", '%Y-%m-%d %H:%M:%S.%f') as "end", n from r where "end" <= (select max(ts) from events) - interval 1 hour"""
)
def stream_sessions(spark, sf_dir):
    """Append mode: sessions that ended before the last watermark."""
    return _plain(jobs.run_available(jobs.sessions(jobs.events_stream(spark, sf_dir)), scratch(spark, "sessions")))


@query(
    """with w as (select unnest([time_bucket(interval 15 minute, ts), time_bucket(interval 15 minute, ts) - interval 15 minute, time_bucket(interval 15 minute, ts) - interval 30 minute, time_bucket(interval 15 minute, ts) - interval 45 minute]) as start from events)
    select strftime(start, '%Y-%m-%d %H:%M:%S.000000') as start, count(*) as n from w group by w.start"""
)
def hourly_sliding(spark, sf_dir):
    return _plain(jobs.run_available(jobs.sliding_counts(jobs.events_stream(spark, sf_dir)), scratch(spark, "sliding"), "complete"))


@query(
    """with m as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id) as island from events),
    r as (select *, row_number() over (partition by user_id, island order by ts, event_id) as n from m where event_type = 'error')
    select user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as opened_at from r where n = 3"""
)
def stream_failure_alarms(spark, sf_dir):
    return _plain(jobs.run_available(jobs.failure_alarms(jobs.events_stream(spark, sf_dir)), scratch(spark, "alarms")))


#: The table's events of one user lie hours apart: ranges of a day, and limits of hours.
DAY_US = 86_400_000_000
LIMIT = "(select max(epoch_us(ts)) - 3600000000 from events)"


def _followed(spark, sf_dir, machine, key, flag=None):
    events = jobs.events_stream(spark, sf_dir)
    found = stateful.followed(events, machine, key, flag=flag, range_us=DAY_US, ranges=64 if key == "user_id" else 1)
    return stateful.with_rocksdb(spark, lambda: jobs.run_available(found, scratch(spark, "followed")))


def passed(us: str) -> str:
    """Whether the last watermark has passed the end of the day of a moment."""
    return f"(({us}) // {DAY_US} + 1) * {DAY_US} <= {LIMIT}"


@query(
    f"""with e as (select user_id, event_id, epoch_us(ts) as us, event_type = 'error' as failed from events where {passed('epoch_us(ts)')}),
    m as (select *, sum(case when failed then 0 else 1 end) over w as island, lead(us) over w as next_us, lead(failed) over w as next_failed from e window w as (partition by user_id order by us, event_id)),
    f as (select *, row_number() over (partition by user_id, island order by us, event_id) as n, lag(us) over (partition by user_id, island order by us, event_id) as before from m where failed),
    o as (select user_id, 'opened' as event, us as at_us, event_id as row_id from f where n = 3 or n > 3 and us - before >= 21600000000),
    c as (select user_id, us, next_us, next_failed, us + 21600000000 as until from f where n >= 3),
    s as (select c.user_id, 'closed' as event, case when next_us < until then next_us else until end as at_us, case when next_us < until then e.event_id else 0 end as row_id
      from c left join (select user_id, us, min(event_id) as event_id from e group by all) e on e.user_id = c.user_id and e.us = c.next_us
      where not coalesce(next_us < until and next_failed, false) and (next_us < until or {passed('until')}))
    select user_id as key, event, at_us, row_id from o union all select user_id, event, at_us, row_id from s"""
)
def stream_breaker(spark, sf_dir):
    """Breakers of users: three errors in a row, six hours of cooling."""
    return _followed(spark, sf_dir, stateful.Breaker(3, 6 * 3_600), "user_id", F.col("event_type") == "error")


@query(
    f"""with e as (select user_id, epoch_us(ts) as us from events where {passed('epoch_us(ts)')}),
    g as (select *, lead(us) over (partition by user_id order by us) as next_us, us + 43200000000 as until from e)
    select user_id as key, 'idle' as event, until as at_us, 0::bigint as row_id from g where coalesce(next_us >= until, {passed('until')})"""
)
def stream_idle_timeouts(spark, sf_dir):
    """Twelve hours without an event of a user, told by the watermark where no event follows."""
    return _followed(spark, sf_dir, stateful.Silence(12 * 3_600), "user_id")


@query(
    f"""with e as (select event_type, event_id, epoch_us(ts) as us from events where {passed('epoch_us(ts)')}),
    g as (select *, us - lag(us) over (partition by event_type order by us, event_id) as gap from e)
    select event_type as key, 'early' as event, us as at_us, event_id as row_id from g where gap < 2500000"""
)
def stream_min_interval(spark, sf_dir):
    return _followed(spark, sf_dir, stateful.Interval(2.5), "event_type")


@query(
    f"""with recursive e as (select user_id, event_id, epoch_us(ts) as us from events where {passed('epoch_us(ts)')}),
    made as (select user_id, min(us) as us from e group by user_id
      union all select m.user_id, n.us from made m join lateral (select min(e.us) as us from e where e.user_id = m.user_id and e.us >= m.us + 604800000000) n on n.us is not null)
    select m.user_id as key, 'made' as event, m.us as at_us, min(e.event_id) as row_id from made m join e using (user_id, us) group by all
    union all select user_id, 'expired', us + 604800000000, 0 from made where {passed('us + 604800000000')} or exists (select 1 from e where e.user_id = made.user_id and e.us >= made.us + 604800000000)"""
)
def stream_ttl(spark, sf_dir):
    """A value per user that lives for seven days from the event that made it."""
    return _followed(spark, sf_dir, stateful.Lifetime(), "user_id")
