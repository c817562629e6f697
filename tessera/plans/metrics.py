"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import logs
from tessera.operators import metrics as mt
from tessera.operators import retrieval as rt
from tessera.operators.containment import containing
from tessera.plans.registry import query
from tessera.plans.retrieval import OVERLAP, SPARSE, chars, grams, overlap_top, sparse_top, top
from tessera.plans.texts import PAIRS, STRIP, conversations, documents, spread_documents
from tessera.session import table


@query(f"with c as (select doc_id, {chars('text')} as c from documents), g as (select doc_id, unnest({grams('c', 2)}) as gram from c) select doc_id, count(*) as n_grams, min(gram) as first_gram, max(gram) as last_gram from g group by doc_id")
def char_ngrams(spark, sf_dir):
    # one row per document, not per gram, is grouped
    found = spread_documents(spark, sf_dir).select("doc_id", F.explode(F.array(tx.char_ngrams(F.col("text")))).alias("grams")).filter(F.size("grams") > 0)
    own = found.select("doc_id", F.size("grams").alias("n"), F.array_min("grams").alias("first"), F.array_max("grams").alias("last"))
    return own.groupBy("doc_id").agg(F.sum("n").alias("n_grams"), F.min("first").alias("first_gram"), F.max("last").alias("last_gram"))


@query(f"with {OVERLAP} select query_id, id, score from overlap_top")
def overlap_ratio(spark, sf_dir):
    return overlap_top(spark, sf_dir).select("query_id", "id", "score")


@query(
    f"""with {OVERLAP}, c as (select query_id, string_agg(text, chr(10) order by rank) as context from overlap_top join documents d on d.doc_id = id where text <> '' group by query_id),
    g as (select item_id, {chars('b.text')} as a, {chars('context')} as c from benchmark b left join c on query_id = item_id),
    s as (select item_id, {grams('a', 2)} as a, {grams('c', 2)} as b from g), r as (select case when len(a) = 0 then 0.0::double else len(list_intersect(a, b))::double / len(a) end as ratio from s)
    select count(*) as samples, round(avg(ratio), 9) as hit_quality from r"""
)
def hit_quality(spark, sf_dir):
    hits = overlap_top(spark, sf_dir).join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(rt.context_of(hits), "query_id", "left")
    ratio = tx.overlap_ratio(tx.char_ngrams(F.col("text")), tx.char_ngrams(F.col("context")))
    return items.agg(F.count("*").alias("samples"), F.round(F.avg(ratio), 9).alias("hit_quality"))


@query(
    f"""with {PAIRS}, parts as (select conv_id, turn, question, list_filter(list_transform(string_split_regex(answer, '[。！？；.\\n]+'), lambda x: regexp_replace(x, {STRIP})), lambda x: len(x) >= 8) as s, regexp_replace(answer, {STRIP}) = '' as blank from pairs),
    e as (select conv_id, turn, {chars('x')} as c, {chars('question')} as q from (select conv_id, turn, question, unnest(s) as x from parts)),
    g as (select conv_id, turn, {grams('c', 2)} as a, {grams('q', 2)} as b from e),
    r as (select conv_id, turn, avg((case when len(a) = 0 then 0.0::double else len(list_intersect(a, b))::double / len(a) end < 0.12)::int) as rate from g group by all)
    select p.conv_id, p.turn, coalesce(rate, case when blank then 0.0 else 1.0 end)::double as rate from parts p left join r using (conv_id, turn)"""
)
def unsupported_rate(spark, sf_dir):
    rows = logs.session_turns(conversations(spark, sf_dir)).select("conv_id", "turn", F.translate(tx.given(F.col("answer")), ".", "。").alias("answer"), tx.given(F.col("question")).alias("context"))
    return mt.unsupported_rate(rows, ["conv_id", "turn"])


RUNS = """runs as (select [5, 8, 10][(user_id % 3 + 1)::int] as k, [2, 3, 3][(user_id % 3 + 1)::int] as m, value as latency, (event_id % 100) / 100.0::double as hit, (event_id % 10) / 10.0::double as unsupported,
  case event_type when 'error' then 'error' when 'click' then 'timeout' else 'ok' end as outcome from events)"""


@query(
    f"""with {RUNS} select k, m, count(*) as runs, round(avg(latency), 6) as latency_mean, round(quantile_cont(latency, 0.95), 6) as latency_p95, round(avg(hit) filter (outcome = 'ok'), 9) as hit_quality,
    round(avg(unsupported) filter (outcome = 'ok'), 9) as unsupported_rate, count(*) filter (outcome = 'timeout') as timeouts, count(*) filter (outcome = 'error') as errors from runs group by k, m"""
)
def km_report(spark, sf_dir):
    at = (F.col("user_id") % 3 + 1).cast("int")
    runs = table(spark, sf_dir, "events").select(
        F.element_at(F.array(F.lit(5), F.lit(8), F.lit(10)), at).alias("k"),
        F.element_at(F.array(F.lit(2), F.lit(3), F.lit(3)), at).alias("m"),
        F.col("value").alias("latency"),
        (F.col("event_id") % 100 / 100.0).alias("hit"),
        (F.col("event_id") % 10 / 10.0).alias("unsupported"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "timeout").otherwise("ok").alias("outcome"),
    )
    report = mt.km_report(runs)
    return report.select("k", "m", "runs", F.round("latency_mean", 6).alias("latency_mean"), F.round("latency_p95", 6).alias("latency_p95"), F.round("hit_quality", 9).alias("hit_quality"), F.round("unsupported_rate", 9).alias("unsupported_rate"), "timeouts", "errors")


@query(
    f"""with {SPARSE}, h as ({top('sparse_all', 20)}), rel as (select item_id as query_id, doc_id as id from benchmark b, documents d where contains(d.text, b.text)),
    q as (select b.item_id as query_id, count(rel.id) as n_relevant from benchmark b left join rel on rel.query_id = b.item_id group by 1),
    f as (select h.query_id, min(rank) as first, count(*) filter (rank <= 10) as deep from h join rel using (query_id, id) group by 1)
    select count(*) as queries, round(avg(coalesce(1.0::double / first, 0)), 9) as mrr, round(avg(coalesce((first <= 5)::int, 0)), 9) as hit_at_cut, round(avg(coalesce(deep::double / nullif(n_relevant, 0), 0)), 9) as recall_deep from q left join f using (query_id)"""
)
def ranking_metrics(spark, sf_dir):
    hits = sparse_top(spark, sf_dir, 20).select("query_id", "id", "rank")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    relevant = containing(asked, docs).withColumn("is_relevant", F.lit(True))
    counts = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    queries = asked.join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_relevant"))
    out = mt.ranking_metrics(hits.join(relevant, ["query_id", "id"], "left"), queries, F.coalesce("is_relevant", F.lit(False)))
    return out.select("queries", *(F.round(c, 9).alias(c) for c in ("mrr", "hit_at_cut", "recall_deep")))


@query("select round(corr(l_quantity, l_extendedprice), 9) as quantity_price, round(corr(l_quantity, l_discount), 9) as quantity_discount, round(corr(l_discount, l_tax), 9) as discount_tax from lineitem")
def metric_correlation(spark, sf_dir):
    pairs = {"quantity_price": ("l_quantity", "l_extendedprice"), "quantity_discount": ("l_quantity", "l_discount"), "discount_tax": ("l_discount", "l_tax")}
    return table(spark, sf_dir, "lineitem").agg(*[F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 9).alias(n) for n, (a, b) in pairs.items()])


ACCURACY = ", ".join(f"avg(case when lang = '{x}' then (quality <> toxic)::int end) as {x}" for x in ("de", "en", "es", "fr"))


@query(f"with p as (select source, {ACCURACY} from documents join labels using (doc_id) group by source) select source, round(de, 9) as de, round(en, 9) as en, round(es, 9) as es, round(fr, 9) as fr, round((coalesce(de, 0) + coalesce(en, 0) + coalesce(es, 0) + coalesce(fr, 0)) / nullif((de is not null)::int + (en is not null)::int + (es is not null)::int + (fr is not null)::int, 0), 9) as mean from p")
def strategy_accuracy_pivot(spark, sf_dir):
    langs = ["de", "en", "es", "fr"]
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    wide = rows.groupBy("source").pivot("lang", langs).agg(F.avg((F.col("quality") != F.col("toxic")).cast("int")))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in langs[1:]), F.coalesce(langs[0], F.lit(0.0)))
    n = sum((F.col(x).isNotNull().cast("int") for x in langs[1:]), F.col(langs[0]).isNotNull().cast("int"))
    return wide.select("source", *(F.round(x, 9).alias(x) for x in langs), F.round(total / F.nullif(n, F.lit(0)), 9).alias("mean"))


@query(
    f"""with {PAIRS}, {OVERLAP}, c as (select query_id, count(*) as n_contexts from overlap_top group by query_id)
    select conv_id, turn, question, answer as expected, coalesce(n_contexts, 0) as n_contexts, coalesce(n_contexts, 0) > 0 as success from pairs left join c on query_id = conv_id"""
)
def rag_eval_join(spark, sf_dir):
    contexts = overlap_top(spark, sf_dir).groupBy(F.col("query_id").alias("conv_id")).agg(F.count("*").alias("n"))
    rows = logs.session_turns(conversations(spark, sf_dir)).join(contexts, "conv_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("conv_id", "turn", tx.given(F.col("question")).alias("question"), tx.given(F.col("answer")).alias("expected"), n.alias("n_contexts"), (n > 0).alias("success"))


@query("with c as (select quality as actual, toxic as predicted, count(*) as n from labels group by all) select *, n / sum(n) over (partition by actual) as share from c")
def confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    """with t as (select quality as label, count(*) as support from labels group by 1), p as (select toxic as label, count(*) as guessed from labels group by 1), h as (select quality as label, count(*) as hits from labels where quality = toxic group by 1),
    j as (select coalesce(t.label, p.label) as label, coalesce(support, 0) as support, coalesce(guessed, 0) as guessed from t full join p on t.label = p.label), k as (select j.*, coalesce(hits, 0) as hits from j left join h using (label)),
    s as (select *, coalesce(hits / nullif(guessed, 0), 0.0) as precision, coalesce(hits / nullif(support, 0), 0.0) as recall from k), f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) as f1 from s),
    a as (select *, sum(hits) over () / sum(support) over () as accuracy, avg(f1) over () as macro_f1, sum(f1 * support) over () / sum(support) over () as weighted_f1, row_number() over (order by f1 desc, label) = 1 as is_best, row_number() over (order by f1, label) = 1 as is_worst from f)
    select label, support, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, round(accuracy, 9) as accuracy, round(macro_f1, 9) as macro_f1, round(weighted_f1, 9) as weighted_f1, case when accuracy >= 0.85 then 'excellent' when accuracy >= 0.8 then 'good' when accuracy >= 0.75 then 'fair' else 'poor' end as rating, is_best, is_worst from a"""
)
def classification_report(spark, sf_dir):
    out = mt.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("label", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1", "weighted_f1")), "rating", "is_best", "is_worst")
