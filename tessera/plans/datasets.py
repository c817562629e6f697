"""Queries that build and profile datasets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import datasets as ds
from tessera.operators import logs
from tessera.operators.ranks import global_rank, hash_bucket, hash_order
from tessera.plans.registry import query
from tessera.plans.texts import BLACK_Q, BLACKLIST, LATIN, PAIRS, PUNCT, SP, STRIP, conversations, documents
from tessera.session import table

LABELLED = "labelled as (select doc_id, text, lang, source, quality as label from documents join labels using (doc_id))"


def labelled(spark, sf_dir):
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "lang", "source", F.col("quality").alias("label"))


def qa(spark, sf_dir):
    """Questions and answers of the conversations, with the benchmark text of the session's number as context."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id"), F.col("text").alias("context"))
    rows = logs.session_turns(conversations(spark, sf_dir)).join(bench, "conv_id", "left")
    return rows.select("conv_id", "turn", tx.given(F.col("question")).alias("question"), tx.given(F.col("answer")).alias("answer"), tx.given(F.col("context")).alias("context"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))


QA = f"{PAIRS}, qa as (select conv_id, turn, question, answer, coalesce(b.text, '') as context, conv_id * 1000 + turn as pos from pairs left join benchmark b on b.item_id = conv_id)"


@query("select r_regionkey, p_partkey, replace('What is {topic} in ' || r_name || '?', '{topic}', p_name) as question from region, part")
def template_expand(spark, sf_dir):
    """Every template with every topic: the five templates are the bounded side."""
    templates = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("What is {topic} in "), "r_name", F.lit("?")).alias("template"))
    return table(spark, sf_dir, "part").crossJoin(templates).select("r_regionkey", "p_partkey", F.replace("template", F.lit("{topic}"), F.col("p_name")).alias("question"))


PLACES, ACTIONS = ("shaft", "tunnel", "plant"), ("inspect", "close", "repair", "vent")


def _pick(values, salt: str):
    i = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), 1, 7), 16, 10).cast("long"), F.lit(len(values)))
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _pick_sql(values, salt: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][(('0x' || substring(md5('{salt}' || doc_id), 1, 7))::bigint % {len(values)} + 1)::int]"


@query(f"select doc_id, 'How to ' || {_pick_sql(ACTIONS, 'a')} || ' the ' || {_pick_sql(PLACES, 'p')} || ' of ' || source || '?' as question from documents")
def template_fill(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("How to "), _pick(ACTIONS, "a"), F.lit(" the "), _pick(PLACES, "p"), F.lit(" of "), "source", F.lit("?")).alias("question"))


VARIANTS = ("Please say: ", "In short: ", "I wonder: ", "Tell me: ", "Now: ")


@query(f"with {PAIRS}, n as (select *, row_number() over (order by conv_id, turn) as rn from pairs) select conv_id, turn, [{', '.join(repr(v) for v in VARIANTS)}][((rn - 1) % 5 + 1)::int] || question as question from n")
def variant_cycle(spark, sf_dir):
    rows = logs.session_turns(conversations(spark, sf_dir)).select("conv_id", "turn", tx.given(F.col("question")).alias("question"))
    ranked = global_rank(rows, F.floor(F.col("conv_id") / 64), "conv_id", "turn")
    variant = F.element_at(F.array(*map(F.lit, VARIANTS)), ((F.col("rank") - 1) % 5 + 1).cast("int"))
    return ranked.select("conv_id", "turn", F.concat(variant, "question").alias("question"))


@query(
    f"""with {LABELLED}, p as (select *, row_number() over (partition by label order by doc_id) as n, count(*) over (partition by label) as size from labelled),
    r as (select *, unnest(range(ceil((200 - n + 1) / size::double)::int)) + 1 as copy from p where n <= 200) select doc_id, label, copy::int as copy from r"""
)
def balance_classes(spark, sf_dir):
    return ds.balance_classes(labelled(spark, sf_dir), "label", "doc_id", 200).select("doc_id", "label", "copy")


@query(
    """with r as (select *, row_number() over (order by item_id) as n, count(*) over () as size from benchmark), e as (select *, unnest(range(ceil((500 - n + 1) / size::double)::int)) + 1 as copy from r where n <= 500)
    select item_id, ((copy - 1) * size + n)::bigint as position from e"""
)
def cycle_to_target(spark, sf_dir):
    return ds.cycle_to_target(table(spark, sf_dir, "benchmark"), "item_id", 500).select("item_id", "position")


@query(f"with {LABELLED}, p as (select *, row_number() over (partition by label order by md5('42:' || doc_id), doc_id) as n from labelled) select doc_id, label from p where n <= case label when 1 then 140 when 0 then 60 else 0 end")
def quota_sample(spark, sf_dir):
    return ds.quota_sample(labelled(spark, sf_dir), "label", "doc_id", {1: 140, 0: 60}).select("doc_id", "label")


@query("select item_id, row_number() over (order by md5('42:' || item_id), item_id) as rank from benchmark")
def stable_shuffle(spark, sf_dir):
    hashed = table(spark, sf_dir, "benchmark").withColumn("h", hash_order(F.col("item_id")))
    return global_rank(hashed, hash_bucket(F.col("h")), "h", "item_id").select("item_id", "rank")


@query("select min(doc_id) as doc_id, md5(text) as text_md5, count(*) - 1 as removed from documents group by text")
def dedup_first(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kept = ds.dedup_first(docs, F.col("text"), "doc_id")
    removed = docs.groupBy(F.md5("text").alias("text_md5")).agg((F.count("*") - 1).alias("removed"))
    return kept.select("doc_id", F.md5("text").alias("text_md5")).join(removed, "text_md5").select("doc_id", "text_md5", "removed")


@query(
    """with base as (select doc_id, lang as label, row_number() over (partition by text order by doc_id) as n from documents), u as (select label, doc_id from base where n = 1 union all select 'benchmark', item_id from benchmark)
    select label, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from u group by label"""
)
def final_union(spark, sf_dir):
    base = ds.dedup_first(documents(spark, sf_dir), F.col("text"), "doc_id").select(F.col("lang").alias("label"), "doc_id")
    both = ds.final_union(base, table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("label"), F.col("item_id").alias("doc_id")))
    counts = both.groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("select quality, toxic, count(*) as n, min(doc_id) as sample from labels group by all")
def label_distribution(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.min("doc_id").alias("sample"))


@query(
    """with f as (select lang, text, len(text) as n, (regexp_matches(text, '[0-9]')::int + (len(regexp_extract_all(text, ',')) >= 2)::int + (len(text) > 25)::int) >= 2 as complex from documents)
    select lang, count(*) as n, avg(n) as avg_len, min(n)::int as min_len, max(n)::int as max_len, count(*) filter (complex) / count(*) as complex_share, count(*) filter (complex) / count(*) >= 0.8 as gate,
    count(*) filter (trim(text) = '') as blank, count(*) - count(distinct text) as duplicates, count(*) filter (lang not in ('en', 'de', 'fr')) as invalid from f group by lang"""
)
def length_profile(spark, sf_dir):
    text, n = F.col("text"), F.length("text")
    marks = tx.matches(text, "[0-9]").cast("int") + (F.regexp_count(text, F.lit(",")) >= 2).cast("int") + (n > 25).cast("int")
    share = F.count_if(marks >= 2) / F.count("*")
    return documents(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("n"),
        F.avg(n).alias("avg_len"),
        F.min(n).alias("min_len"),
        F.max(n).alias("max_len"),
        share.alias("complex_share"),
        (share >= 0.8).alias("gate"),
        F.count_if(F.trim("text") == "").alias("blank"),
        (F.count("*") - F.countDistinct(F.md5("text"))).alias("duplicates"),
        F.count_if(~F.col("lang").isin("en", "de", "fr")).alias("invalid"),
    )


COMPLEX = ("the", "how", "and", "des", "para")


@query(f"with {PAIRS}, k as (select *, {' + '.join(f'''contains(question, '{w}')::int''' for w in COMPLEX)} as hits from pairs) select conv_id, turn, hits::int as hits, len(question)::int as n_chars, len(question) > 30 as is_long from k where hits >= 2 or len(question) > 25")
def complex_queries(spark, sf_dir):
    q = F.col("question")
    rows = logs.session_turns(conversations(spark, sf_dir)).select("conv_id", "turn", tx.given(q).alias("question")).withColumn("hits", tx.keyword_count(q, COMPLEX))
    return rows.filter((F.col("hits") >= 2) | (F.length("question") > 25)).select("conv_id", "turn", "hits", F.length("question").alias("n_chars"), (F.length("question") > 30).alias("is_long"))


@query(f"with {PAIRS}, c as (select len(question) as n, len(regexp_extract_all(question, '[,，?？]')) + 1 as clauses from pairs) select count(*) as queries, avg(n) as avg_len, avg(clauses) as avg_clauses, min(clauses)::int as min_clauses, max(clauses)::int as max_clauses from c")
def clause_count(spark, sf_dir):
    rows = logs.session_turns(conversations(spark, sf_dir)).select(tx.given(F.col("question")).alias("q"))
    counted = rows.select(F.length("q").alias("n"), (F.regexp_count("q", F.lit("[,，?？]")) + 1).alias("clauses"))
    return counted.agg(F.count("*").alias("queries"), F.avg("n").alias("avg_len"), F.avg("clauses").alias("avg_clauses"), F.min("clauses").alias("min_clauses"), F.max("clauses").alias("max_clauses"))


NQ = f"regexp_replace(regexp_replace(question, {STRIP}), '{SP}+', '', 'g')"
NA, NC = f"regexp_replace(answer, '{SP}+', '', 'g')", f"regexp_replace(context, '{SP}+', '', 'g')"
SCORE_A = f"""scored as (select conv_id, turn, question, pos,
  (2 * (len(q) between 6 and 28)::int + 2 * regexp_matches(q, '{LATIN}{{2,}}')::int + ends_with(q, '.')::int + (len(list_distinct(regexp_extract_all(q, '(?s).'))) >= 5)::int
  + (len(a) between 2 and 24)::int + 2 * regexp_matches(a, '{LATIN}')::int + (not regexp_matches(a, '^[\\d.\\-]+$'))::int + 0.5 * (contains(a, ',') or contains(a, '.'))::int
  + (len(c) >= 120)::int + regexp_matches(c, '{LATIN}{{20,}}')::int - 4 * starts_with(q, 'The')::int - 2 * regexp_matches(a, '^[\\d.]+$')::int - (len(a) <= 4 and regexp_matches(a, '^\\d'))::int
  - 2 * contains(q, 'License')::int - 2 * contains(a, 'License')::int - 4 * (contains(q, repeat(chr(65533), 4)) or contains(a, repeat(chr(65533), 4)))::int)::double as score
  from (select *, {NQ} as q, {NA} as a, {NC} as c from qa))"""


def _score_a():
    return ds.qa_score_a(F.col("question"), F.col("answer"), F.col("context"), LATIN, (".",), (",", "."), "The", ("License",))


@query(f"with {QA}, {SCORE_A} select conv_id, turn, score from scored")
def qa_score_a(spark, sf_dir):
    return qa(spark, sf_dir).select("conv_id", "turn", _score_a().alias("score"))


@query(f"with {QA}, {SCORE_A} select case when score >= 7.5 then 'high' when score >= 5 then 'medium' else 'low' end as tier, count(*) as n, avg(score) as mean_score from scored group by tier")
def quality_tier(spark, sf_dir):
    scored = qa(spark, sf_dir).select(_score_a().alias("score"))
    return scored.groupBy(ds.quality_tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


A2 = f"regexp_replace(answer, {STRIP})"
SCORE_B = f"""scored_b as (select conv_id, turn, question, pos,
  (2 * (len(question) between 6 and 36)::int + 2 * (len(regexp_extract_all(question, '{LATIN}')) >= 4)::int + ends_with(question, '.')::int - 2 * regexp_matches(question, '[A-Z]{{2,}}')::int
  - 2 * regexp_matches(question, '[=:/\\\\]')::int - regexp_matches(question, '\\d{{4,}}')::int + (len({A2}) between 2 and 24)::int + 2 * (len(regexp_extract_all({A2}, '{LATIN}')) >= 1)::int - 3 * regexp_matches({A2}, '^[\\d.]+$')::int
  + (regexp_matches({A2}, '^[\\d.]+$') and (contains(question, 'how') or contains(question, 'wh')) and len({A2}) <= 6)::int + (len(regexp_extract_all(context, '{LATIN}')) >= 40)::int
  + 2 * (contains(question, 'the') or contains(context, 'the'))::int - 4 * {BLACK_Q}::int)::double as score from qa)"""


def _score_b():
    return ds.qa_score_b(F.col("question"), F.col("answer"), F.col("context"), LATIN, ".", ("how", "wh"), ("the",), BLACKLIST, latin="[A-Z]{2,}")


@query(f"with {QA}, {SCORE_B} select conv_id, turn, score from scored_b")
def qa_score_b(spark, sf_dir):
    return qa(spark, sf_dir).select("conv_id", "turn", _score_b().alias("score"))


KEY_B = f"lower(regexp_replace(regexp_replace(question, '{SP}+', '', 'g'), '{PUNCT}', '', 'g'))"
TRUSTED = f"trusted as (select {KEY_B.replace('question', 'text')} as question_key, text as question, 10.0::double as score, item_id as pos from benchmark)"


def trusted(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(tx.norm_question_key(F.col("text")).alias("question_key"), F.col("text").alias("question"), F.lit(10.0).alias("score"), F.col("item_id").alias("pos"))


@query(
    f"""with {QA}, {SCORE_A}, {TRUSTED}, pool as (select question_key, 1 as stage, score, question, pos from trusted union all select {KEY_B}, 2, score, question, pos from scored),
    once as (select *, row_number() over (partition by question_key order by stage, score desc, pos) as n from pool), c as (select *, row_number() over (order by stage, score desc, question, pos) as k from once where n = 1)
    select stage, score, question, pos, row_number() over (order by score desc, question, pos)::int as rank from c where k <= 100"""
)
def curated_topn(spark, sf_dir):
    scored = qa(spark, sf_dir).select(tx.norm_question_key(F.col("question")).alias("question_key"), F.lit(2).alias("stage"), _score_a().alias("score"), "question", "pos")
    pool = trusted(spark, sf_dir).select("question_key", F.lit(1).alias("stage"), "score", "question", "pos").unionByName(scored)
    return ds.staged_topn(pool, 100).select("stage", "score", "question", "pos", "rank")


@query(f"with {QA}, {SCORE_B}, k as (select *, {KEY_B} as question_key, row_number() over (partition by {KEY_B} order by score desc, pos) as n from scored_b where score >= 3) select conv_id, turn, question_key, score from k where n = 1")
def best_per_question(spark, sf_dir):
    rows = qa(spark, sf_dir).withColumn("score", _score_b())
    return ds.best_per_question(rows, tx.norm_question_key(F.col("question")), 3.0).select("conv_id", "turn", "question_key", "score")


COVERED = "((contains(context, 'Licensed') and contains(context, 'Apache')) or (contains(context, 'rights') and contains(context, 'reserved')))"


@query(
    f"""with {QA}, {SCORE_B}, c as (select s.*, {COVERED} as cover, {KEY_B.replace('question', 's.question')} as question_key from scored_b s join qa using (conv_id, turn))
    select count(*) as rows, count(*) filter (cover) as dropped_cover, count(*) filter (not cover and score < 3) as dropped_low, count(distinct case when not cover and score >= 3 then question_key end) as questions from c"""
)
def best_per_question_counts(spark, sf_dir):
    rows = qa(spark, sf_dir).withColumn("score", _score_b())
    cover = tx.cover_page_flag(F.col("context"), [("Licensed", "Apache"), ("rights", "reserved")])
    return ds.best_per_question_counts(rows, tx.norm_question_key(F.col("question")), 3.0, cover)


STAGE_B = "case when score >= 6 then 2 when score >= 4 then 3 when pos % 2 = 0 and score >= 2 then 4 when score >= 1 then 5 end"


@query(
    f"""with {QA}, {SCORE_B}, {TRUSTED}, pool as (select question_key, 1 as stage, score + 100 as score, question, pos from trusted union all select * from (select {KEY_B} as question_key, {STAGE_B} as stage, score, question, pos from scored_b) where stage is not null),
    once as (select *, row_number() over (partition by question_key order by stage, score desc, pos) as n from pool), c as (select *, row_number() over (order by stage, score desc, question, pos) as k from once where n = 1)
    select stage, score, question, pos, row_number() over (order by score desc, question, pos)::int as rank from c where k <= 150"""
)
def staged_topn(spark, sf_dir):
    return ds.staged_topn(_stages(spark, sf_dir), 150).select("stage", "score", "question", "pos", "rank")


def _stages(spark, sf_dir):
    s = F.col("score")
    stage = F.when(s >= 6, 2).when(s >= 4, 3).when((F.col("pos") % 2 == 0) & (s >= 2), 4).when(s >= 1, 5)
    rows = qa(spark, sf_dir).withColumn("score", _score_b())
    scored = rows.select(tx.norm_question_key(F.col("question")).alias("question_key"), stage.alias("stage"), "score", "question", "pos").filter("stage is not null")
    return trusted(spark, sf_dir).select("question_key", F.lit(1).alias("stage"), (F.col("score") + 100).alias("score"), "question", "pos").unionByName(scored)


@query(
    f"""with {QA}, {SCORE_B}, {TRUSTED}, pool as (select question_key, 1 as stage, score + 100 as score, question, pos from trusted union all select * from (select {KEY_B} as question_key, {STAGE_B} as stage, score, question, pos from scored_b) where stage is not null),
    once as (select *, row_number() over (partition by question_key order by stage, score desc, pos) as n from pool), c as (select *, row_number() over (order by stage, score desc, question, pos) as k from once where n = 1)
    select stage, count(*) as pool, (select count(*) from c where c.stage = pool.stage) as questions, (select count(*) from c where c.stage = pool.stage and k <= 150) as chosen from pool group by stage"""
)
def staged_counts(spark, sf_dir):
    return ds.staged_counts(_stages(spark, sf_dir), 150)


@query(f"with {QA} select conv_id, turn, question, answer, case when context = '' then 0 else 1 end as n_contexts, coalesce(nullif(trim(case when turn % 2 = 0 then '' else answer end), ''), answer) as ground_truth from qa")
def canonical_record(spark, sf_dir):
    truth = F.coalesce(F.nullif(F.trim(F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("answer"))), F.lit("")), "answer")
    contexts = F.filter(F.array("context"), lambda c: c != "")
    return qa(spark, sf_dir).select("conv_id", "turn", "question", "answer", F.size(contexts).alias("n_contexts"), truth.alias("ground_truth"))


@query("select (select count(*) from documents) as pool, (select count(*) from documents where len(text) > 80) as usable, (select count(distinct text) from documents where len(text) > 80) as distinct_texts, (select string_agg(distinct source, ',' order by source) from documents) as sources")
def qg_summary(spark, sf_dir):
    usable = F.length("text") > 80
    return documents(spark, sf_dir).agg(F.count("*").alias("pool"), F.count_if(usable).alias("usable"), F.countDistinct(F.when(usable, F.md5("text"))).alias("distinct_texts"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query(
    """with f as (select * from documents where len(text) > 80 order by doc_id limit 200), s as (select * from f order by md5('42:' || doc_id), doc_id limit 25)
    select doc_id, source, coalesce(nullif(regexp_extract(text, '^([^.]+)[.]', 1), ''), 'What is this about?') as question, left(text, 400) as context from s"""
)
def sample_for_testgen(spark, sf_dir):
    """A test set of 25 of the first min(8 x 25, 1000) usable rows: the sample is the feature."""
    pool = documents(spark, sf_dir).filter(F.length("text") > 80).orderBy("doc_id").limit(200)
    chosen = pool.orderBy(hash_order(F.col("doc_id")), "doc_id").limit(25)
    question = F.coalesce(F.nullif(F.regexp_extract("text", r"^([^.]+)[.]", 1), F.lit("")), F.lit("What is this about?"))
    return chosen.select("doc_id", "source", question.alias("question"), F.substring("text", 1, 400).alias("context"))


@query(f"with {QA} select conv_id, turn, {NQ} as question, context, 'mining' as source from qa where {NQ} <> '' and context <> '' order by conv_id, turn limit 20")
def load_eval_samples(spark, sf_dir):
    rows = qa(spark, sf_dir).withColumn("question", tx.norm_question_curated(F.col("question"))).filter("question <> '' and context <> ''")
    return rows.orderBy("conv_id", "turn").limit(20).select("conv_id", "turn", "question", "context", F.lit("mining").alias("source"))


@query(f"with {LABELLED}, p as (select *, row_number() over (partition by label order by md5('42:' || doc_id), doc_id) as n, count(*) over (partition by label) as size from labelled) select doc_id, label, case when n <= floor(size * 0.8::double) then 'train' when n <= floor(size * (0.8::double + 0.1::double)) then 'val' else 'test' end as split from p")
def train_test_split(spark, sf_dir):
    return ds.stratified_split(labelled(spark, sf_dir), "label", "doc_id", [("train", 0.8), ("val", 0.1), ("test", 0.1)]).select("doc_id", "label", "split")


@query("with r as (select item_id, row_number() over (order by md5('42:' || item_id), item_id) as n, count(*) over () as size from benchmark) select item_id, case when n <= size - 10 then 'train' when n <= size - 5 then 'val' else 'test' end as split from r")
def fixed_count_split(spark, sf_dir):
    """Five rows to validate, five to test, the rest to train; counts that don't add up fail."""
    rows = table(spark, sf_dir, "benchmark")
    return ds.fixed_count_split(rows, "item_id", [("train", rows.count() - 10), ("val", 5), ("test", 5)], exact=True).select("item_id", "split")
