"""Queries of retrieval: the benchmark's items ask, documents and vectors answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import logs
from tessera.operators import retrieval as rt
from tessera.operators.containment import reached
from tessera.operators.dense import dense_topk as vector_topk
from tessera.operators.overlap import overlap_topk
from tessera.operators.postings import PostingsIndex
from tessera.operators.sparse import sparse_topk as terms_topk
from tessera.plans.registry import query
from tessera.plans.texts import PAIRS, SP, conversations, documents, spread_documents
from tessera.operators.vector_index import VectorIndex
from tessera.session import table
from tessera.shared import scratch
from tessera.sources import files

# Names of retrieval strategies, and their (K, M).
DIRECT, HYPOTHETICAL, SUBQUERY, SCENE, OLD_SCENE = "直接检索", "假设问题检索", "子查询检索", "场景重构检索", "回溯问题检索"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def vector_queries(spark, sf_dir):
    """The query set of searches: every row whose id is divisible by 50."""
    return vectors(spark, sf_dir).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


DOT = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::double * x[2]::double))"
DENSE = f"dense_all as (select q.vec_id as query_id, v.vec_id as id, v.label, {DOT} as score from embeddings q, embeddings v where q.vec_id % 50 = 0)"


def top(source: str, k: int | str, where: str = "") -> str:
    return f"select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from {source} {where}) where rank <= {k}"


@query(f"with {DENSE} {top('dense_all', 5)}")
def dense_topk(spark, sf_dir):
    return vector_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 5)


@query(f"with {DENSE} {top('dense_all', 5)}")
def dense_topk_ivf(spark, sf_dir):
    """The same rows from a stored inverted file, whose cells are probed until no other can matter."""
    VectorIndex.build(vectors(spark, sf_dir), path := scratch(spark, "tessera-ivf"))
    return VectorIndex(spark, path).search(vector_queries(spark, sf_dir), 5)


@query(f"with {DENSE} {top('dense_all', 5, 'where label = 3')}")
def filtered_topk(spark, sf_dir):
    return vector_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir).filter("label = 3"), 5)


WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]{3,}')"
SPARSE = f"""tf as (select id, term, count(*) as tf from (select doc_id as id, unnest({WORDS}) as term from documents) group by all),
df as (select term, count(*) as df from tf group by term),
weights as (select id, term, tf * ln(1 + (select count(*) from documents)::double / df) as weight from tf join df using (term)),
asked as (select query_id, term, count(*) as tf from (select item_id as query_id, unnest({WORDS}) as term from benchmark) group by all),
sparse_all as (select query_id, id, round(sum(weight * asked.tf), 6) as score from weights join asked using (term) group by all)"""


def weights(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return rt.tf_idf(rt.term_weights(docs), docs.agg(F.count("*").alias("n")))


def texts(spark, sf_dir):
    return spread_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


def sparse_top(spark, sf_dir, k: int):
    return terms_topk(items(spark, sf_dir), texts(spark, sf_dir), k)


@query(f"with {SPARSE} {top('sparse_all', 5)}")
def sparse_topk(spark, sf_dir):
    return sparse_top(spark, sf_dir, 5)


@query(f"with {SPARSE} {top('sparse_all', 5)}")
def sparse_topk_stored(spark, sf_dir):
    """The rows of sparse_topk from a stored postings table, blocks that can't matter left out."""
    PostingsIndex.build(texts(spark, sf_dir), path := scratch(spark, "tessera-postings"))
    return PostingsIndex(spark, path).search(items(spark, sf_dir), 5)


PRUNED = """pruned as (select id, term, weight from (select *, percent_rank() over (partition by id order by weight, term) as p, count(*) over (partition by id) as n from weights) where p >= 0.2 or n = 1),
sparse_pruned as (select query_id, id, round(sum(weight * asked.tf), 6) as score from pruned join asked using (term) group by all)"""


@query(f"with {SPARSE}, {PRUNED} {top('sparse_pruned', 5)}")
def sparse_topk_pruned(spark, sf_dir):
    """Search over postings without the smallest fifth of each document's weights."""
    index = PostingsIndex.build(texts(spark, sf_dir), scratch(spark, "tessera-postings"), prune=0.2)
    return index.search(items(spark, sf_dir), 5)


@query(
    f"with {SPARSE}, r as (select *, percent_rank() over (partition by id order by weight, term) as p, count(*) over (partition by id) as n from weights) select id, count(*) as terms, round(sum(weight), 4) as weight from r where p >= 0.2 or n = 1 group by id"
)
def sparse_prune(spark, sf_dir):
    pruned = rt.sparse_prune(weights(spark, sf_dir))
    return pruned.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"))


HYBRID = f"""with {DENSE}, d as ({top('dense_all', 20)}),
{SPARSE.replace('select item_id as query_id, unnest', 'select doc_id as query_id, unnest').replace('from benchmark', 'from documents where doc_id % 50 = 0')}, s as ({top('sparse_all', 20)}),
both_legs as (select query_id, id, coalesce(d.score, 0) * 1.0::double + coalesce(s.score, 0) * 0.7::double as score from d full join s using (query_id, id))"""


@query(f"{HYBRID} {top('both_legs', 5)}")
def hybrid_topk(spark, sf_dir):
    dense = vector_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 20)
    asked = texts(spark, sf_dir).filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    return rt.fused(dense, terms_topk(asked, texts(spark, sf_dir), 20), 5)


@query(
    f"""with {SPARSE}, h as ({top('sparse_all', 20)}), t as (select h.*, d.text from h join documents d on d.doc_id = h.id where trim(d.text) <> ''),
    k as (select *, row_number() over (partition by query_id, md5(text) order by rank) as n from t) select query_id, id, score, rank from k where n = 1"""
)
def parent_dedup(spark, sf_dir):
    hits = sparse_top(spark, sf_dir, 20).join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id")
    return rt.parent_dedup(hits).select("query_id", "id", "score", "rank")


def chars(t: str) -> str:
    return f"regexp_extract_all(regexp_replace(coalesce({t}, ''), '{SP}+', '', 'g'), '(?s).')"


def grams(c: str, n: int) -> str:
    shifted = ", ".join([c, *(f"{c}[{i}:]" for i in range(2, n + 1))])
    joined = " || ".join(f"x[{i}]" for i in range(1, n + 1))
    return f"case when len({c}) = 0 then [] when len({c}) < {n} then [array_to_string({c}, '')] else list_distinct(list_transform(list_zip({shifted})[:len({c}) - {n - 1}], lambda x: {joined})) end"


OVERLAP = f"""qc as (select item_id as query_id, {chars('text')} as c from benchmark), dc as (select doc_id as id, {chars('text')} as c from documents),
q2 as (select query_id, {grams('c', 2)} as a from qc), d2 as (select id, {grams('c', 2)} as b from dc),
shared as (select query_id, id, len(list_intersect(a, b))::double / len(a) as score from q2, d2 where len(a) > 0),
overlap_all as (select * from shared where score > 0),
overlap_top as ({top('overlap_all', 3)})"""


def overlap_top(spark, sf_dir, k: int = 3):
    return overlap_topk(items(spark, sf_dir), texts(spark, sf_dir), k)


@query(f"with {OVERLAP} select query_id, id, score, rank from overlap_top where rank <= 2")
def rerank_topm(spark, sf_dir):
    hits = overlap_top(spark, sf_dir, 3).drop("rank")
    return rt.rerank(hits, F.col("score"), 2)


@query(
    f"""with {OVERLAP}, t as (select query_id, rank, id, source, text from overlap_top join documents d on d.doc_id = id)
    select query_id, string_agg(source, ',' order by rank) as sources, md5(string_agg(text, chr(10) order by rank)) as context_md5, count(*) as n_hits from t where text <> '' group by query_id"""
)
def retrieved_context(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source")
    hits = overlap_top(spark, sf_dir).join(docs, "id")
    sources = hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"]), ",").alias("sources"), F.count("*").alias("n_hits"))
    return rt.context_of(hits).select("query_id", F.md5("context").alias("context_md5")).join(sources, "query_id")


STRATEGY = f"case when contains(question, 'the') and contains(question, 'and') then '{SUBQUERY}' when len(question) > 200 then '{OLD_SCENE}' when len(question) < 40 then '{HYPOTHETICAL}' else '{DIRECT}' end"


def _strategy():
    q = F.col("question")
    return F.when(F.contains(q, F.lit("the")) & F.contains(q, F.lit("and")), SUBQUERY).when(F.length(q) > 200, OLD_SCENE).when(F.length(q) < 40, HYPOTHETICAL).otherwise(DIRECT)


def _turns(spark, sf_dir):
    rows = logs.session_turns(conversations(spark, sf_dir))
    return rows.select("conv_id", "turn", tx.given(F.col("question")).alias("question"), tx.given(F.col("answer")).alias("answer"))


@query(f"with {PAIRS}, s as (select *, replace({STRATEGY}, '{OLD_SCENE}', '{SCENE}') as strategy from pairs) select conv_id, turn, strategy, case when strategy in ('{SUBQUERY}', '{SCENE}') then 8 else 5 end as k, case when strategy in ('{SUBQUERY}', '{SCENE}') then 3 else 2 end as m from s")
def strategy_km(spark, sf_dir):
    strategy = F.when(_strategy() == OLD_SCENE, SCENE).otherwise(_strategy())
    rows = _turns(spark, sf_dir).withColumn("strategy", strategy)
    wide = F.col("strategy").isin(SUBQUERY, SCENE)
    return rows.select("conv_id", "turn", "strategy", F.when(wide, 8).otherwise(5).alias("k"), F.when(wide, 3).otherwise(2).alias("m"))


# two variants of each item: the whole text, and for odd items its first half as a sub-query
VARIANTS = """variants as (select item_id * 10 as variant_id, item_id as query_id, 0 as variant_ix, text, case when item_id % 2 = 0 then 5 else 2 end as k from benchmark
  union all select item_id * 10 + 1, item_id, 1, left(text, len(text) // 2), 2 from benchmark where item_id % 2 = 1)"""
ROUTED = f"""tf as (select id, term, count(*) as tf from (select doc_id as id, unnest({WORDS}) as term from documents) group by all), df as (select term, count(*) as df from tf group by term),
weights as (select id, term, tf * ln(1 + (select count(*) from documents)::double / df) as weight from tf join df using (term)), {VARIANTS},
asked as (select variant_id, term, count(*) as tf from (select variant_id, unnest({WORDS}) as term from variants) group by all),
scores as (select variant_id, id, round(sum(weight * asked.tf), 6) as score from weights join asked using (term) group by all),
r as (select s.*, v.query_id, v.variant_ix, v.k, row_number() over (partition by variant_id order by score desc, id)::int as rank from scores s join variants v using (variant_id)),
routed as (select query_id, variant_ix, id, score, rank from r where rank <= k)"""


def routed(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    whole = bench.select((F.col("item_id") * 10).alias("variant_id"), F.col("item_id").alias("query_id"), F.lit(0).alias("variant_ix"), "text", F.when(F.col("item_id") % 2 == 0, 5).otherwise(2).alias("k"))
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    parts = bench.filter("item_id % 2 = 1").select((F.col("item_id") * 10 + 1).alias("variant_id"), F.col("item_id").alias("query_id"), F.lit(1).alias("variant_ix"), half.alias("text"), F.lit(2).alias("k"))
    variants = whole.unionByName(parts)
    found = terms_topk(variants.select(F.col("variant_id").alias("query_id"), "text"), texts(spark, sf_dir), 5).withColumnRenamed("query_id", "variant_id")
    return found.join(variants.drop("text"), "variant_id").filter(F.col("rank") <= F.col("k")).select("query_id", "variant_ix", "id", "score", "rank")


@query(f"with {ROUTED} select * from routed")
def strategy_route_retrieve(spark, sf_dir):
    return routed(spark, sf_dir)


@query(
    f"""with {ROUTED}, h as (select r.*, (variant_ix * 100 + rank)::int as pos, md5(text) as text_md5 from routed r join documents d on d.doc_id = r.id),
    g as (select query_id, text_md5, min(pos) as pos, arg_max(id, pos) as id, arg_max(score, pos) as score from h group by all), k as (select *, row_number() over (partition by query_id order by pos)::int as rank from g) select * from k where rank <= 3"""
)
def subquery_merge(spark, sf_dir):
    hits = routed(spark, sf_dir).withColumn("pos", (F.col("variant_ix") * 100 + F.col("rank")).cast("int"))
    return rt.subquery_merge(hits.join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id"), 3)


@query(
    f"""with {SPARSE}, h as ({top('sparse_all', 20)}), p as (select h.*, source as parent_id from h join documents d on d.doc_id = h.id), k as (select *, row_number() over (partition by query_id, parent_id order by rank) as n from p)
    select query_id, parent_id, string_agg(id::varchar, ',' order by rank) as children, min(rank) as rank from k where n <= 3 group by all"""
)
def matched_children(spark, sf_dir):
    hits = sparse_top(spark, sf_dir, 20).join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id")), "id")
    found = rt.matched_children(hits)
    return found.select("query_id", "parent_id", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"), "rank")


@query(
    f"""with {SPARSE}, h as ({top('sparse_all', 5)})
    select query_id, rank, id, score, left(text, 220) as preview, case source when 'src0' then 'Main archive' when 'src1' then 'News' else source end as shown_source, coalesce([0.95, 0.88, 0.79][rank], 0.68)::double as display_score
    from h join documents d on d.doc_id = h.id"""
)
def source_details(spark, sf_dir):
    names = F.create_map(F.lit("src0"), F.lit("Main archive"), F.lit("src1"), F.lit("News"))
    shown = F.try_element_at(F.array(F.lit(0.95), F.lit(0.88), F.lit(0.79)), F.col("rank"))
    hits = sparse_top(spark, sf_dir, 5).join(documents(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id")
    return hits.select("query_id", "rank", "id", "score", F.substring("text", 1, 220).alias("preview"), F.coalesce(F.try_element_at(names, F.col("source")), "source").alias("shown_source"), F.coalesce(shown, F.lit(0.68)).alias("display_score"))


@query(f"with {OVERLAP} select item_id as query_id, case when item_id in (select query_id from overlap_all where score >= 0.5) then 'professional' else 'general' end as query_type from benchmark")
def promote_by_hit(spark, sf_dir):
    hits = reached(items(spark, sf_dir), texts(spark, sf_dir), 0.5).withColumn("hit", F.lit(True))
    return items(spark, sf_dir).join(hits, "query_id", "left").select("query_id", F.when(F.col("hit"), "professional").otherwise("general").alias("query_type"))


@query(
    f"""with {PAIRS}, {OVERLAP}, c as (select query_id, string_agg(text, chr(10) order by rank) as context from overlap_top join documents d on d.doc_id = id where text <> '' group by query_id)
    select conv_id, turn, md5('Context:' || chr(10) || coalesce(context, '') || chr(10) || 'Question: ' || question || chr(10) || 'Phone: 12345') as prompt_md5 from pairs left join c on c.query_id = conv_id"""
)
def prompt_assembly(spark, sf_dir):
    hits = overlap_top(spark, sf_dir).join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id")
    context = rt.context_of(hits).withColumnRenamed("query_id", "conv_id")
    prompt = F.format_string("Context:\n%s\nQuestion: %s\nPhone: %s", F.coalesce("context", F.lit("")), F.col("question"), F.lit("12345"))
    return _turns(spark, sf_dir).join(context, "conv_id", "left").select("conv_id", "turn", F.md5(prompt).alias("prompt_md5"))


KB_ROWS = """kb as (select doc_id as pos, coalesce(nullif(case when doc_id % 13 = 0 then '' else source end, ''), 'unknown') as source,
    case when doc_id % 2 = 0 then 'f' || source else '' end as file_id, case when doc_id % 3 = 0 then lang || '.pdf' else '' end as file_name, case when doc_id % 3 = 1 then '/data/' || source || '/' || lang || '.txt' end as file_path from documents),
  named as (select *, coalesce(nullif(file_name, ''), nullif(regexp_extract(coalesce(file_path, ''), '([^/]*)$', 1), ''), source || '_未命名文档') as file from kb)"""


@query(
    f"""with {KB_ROWS}, t as (select count(*) as n, count(distinct file) as files, count(distinct source) as sources from named),
    f as (select file, count(*) as n, arg_min(source, pos) as source, arg_min(file_id, pos) as file_id from named group by file), s as (select source, count(*) as n from named group by source)
    select 'total' as level, '' as name, '' as source, '' as file_id, n as chunks, (n > 0)::int::double as ratio, false as can_delete, files, sources, coalesce(round(n::double / nullif(files, 0), 1), 0.0)::double as average from t
    union all select 'source', source, source, '', s.n, round(s.n::double / t.n, 4), false, 0, 0, 0.0 from s, t
    union all select 'file', file, source, file_id, f.n, round(f.n::double / t.n, 4), file_id <> '', 0, 0, 0.0 from f, t"""
)
def kb_overview(spark, sf_dir):
    """Documents as chunks whose files go by a name, a path or neither."""
    d = F.col("doc_id")
    rows = documents(spark, sf_dir).select(
        d.alias("pos"),
        F.when(d % 13 == 0, "").otherwise(F.col("source")).alias("source"),
        F.when(d % 2 == 0, F.concat(F.lit("f"), "source")).otherwise("").alias("file_id"),
        F.when(d % 3 == 0, F.concat("lang", F.lit(".pdf"))).otherwise("").alias("file_name"),
        F.when(d % 3 == 1, F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit(".txt"))).alias("file_path"),
    )
    return rt.kb_overview(rows)


@query(
    f"""with {SPARSE}, h as ({top('sparse_all', 20)}), d as (select source, lang as file from h join documents on doc_id = id)
    select 'total' as level, 'total_docs' as name, count(*) as n from d union all select 'total', 'unique_sources', count(distinct source) from d union all select 'total', 'unique_files', count(distinct file) from d
    union all select 'source', source, count(*) from d group by source union all select 'file', file, count(*) from d group by file"""
)
def export_statistics(spark, sf_dir):
    """The statistics that go with an export of hits, written and read back as JSON."""
    hits = sparse_top(spark, sf_dir, 20).join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("file")), "id")
    path = scratch(spark, "statistics")
    files.write_json_lines(rt.export_statistics(hits), path)
    return files.read_json_lines(spark, path, "level string, name string, n long")


@query(
    """with stored as (select distinct source as file, 'f' || source as file_id from documents where lang <> 'en'), kb as (select 'f' || source as file_id, source as file, count(*) as n_chunks, max(doc_id) as newest from documents join labels using (doc_id) group by all)
    select coalesce(s.file_id, k.file_id) as file_id, coalesce(s.file, k.file) as file, coalesce(n_chunks, 0) as n_chunks, s.file_id is not null as is_stored, coalesce(newest, -1) as newest from stored s full join kb k on s.file_id = k.file_id"""
)
def file_listing_merge(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("file_id", F.concat(F.lit("f"), "source"))
    stored = docs.filter("lang <> 'en'").select("file_id", F.col("source").alias("stored_file")).distinct().withColumn("is_stored", F.lit(True))
    kb = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("file_id", "source").agg(F.count("*").alias("n_chunks"), F.max("doc_id").alias("newest"))
    return stored.join(kb, "file_id", "full").select("file_id", F.coalesce("stored_file", "source").alias("file"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("is_stored", F.lit(False)).alias("is_stored"), F.coalesce("newest", F.lit(-1)).alias("newest"))


@query(
    f"""with {SPARSE}, h as ({top('sparse_all', 20)}), d as (select source, lang from h join documents on doc_id = id)
    select source, count(*) as hits, count(distinct lang) as langs, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from d group by source"""
)
def hit_statistics(spark, sf_dir):
    hits = sparse_top(spark, sf_dir, 20).join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "lang"), "id")
    counts = hits.groupBy("source").agg(F.count("*").alias("hits"), F.countDistinct("lang").alias("langs"))
    return counts.withColumn("percent", F.round(100.0 * F.col("hits") / F.sum("hits").over(Window.partitionBy()), 6))


@query("select d.doc_id, d.source, left(replace(text, chr(10), ' '), 80) as preview, n as source_rows from documents d join (select source, count(*) as n from documents group by source) using (source) order by doc_id limit 5")
def kb_sample_preview(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counts = docs.groupBy("source").agg(F.count("*").alias("source_rows"))
    first = docs.select("doc_id", "source", F.substring(F.translate("text", "\n", " "), 1, 80).alias("preview")).orderBy("doc_id").limit(5)
    return first.join(counts, "source")


CITED = """cited as (select query_id, rank as ref_id, case when id % 3 = 0 then '' else 'Doc ' || id end as title, case when id % 2 = 0 then id % 97 end as page, case when id % 5 = 0 then lang end as section, case when id % 7 = 0 then id % 11 end as paragraph, source from overlap_top join documents d on d.doc_id = id),
placed as (select *, concat_ws('，', nullif(title, ''), 'p.' || page, section, '段落' || paragraph) as loc from cited), texts as (select query_id, string_agg('[' || ref_id || '] ' || coalesce(nullif(loc, ''), source, 'unknown'), chr(10) order by ref_id) as citations from placed group by query_id)"""


def cited(spark, sf_dir):
    i = F.col("id")
    hits = overlap_top(spark, sf_dir).join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "lang"), "id")
    return hits.select(
        "query_id",
        F.col("rank").alias("ref_id"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Doc "), i.cast("string"))).alias("title"),
        F.when(i % 2 == 0, i % 97).alias("page"),
        F.when(i % 5 == 0, F.col("lang")).alias("section"),
        F.when(i % 7 == 0, i % 11).alias("paragraph"),
        "source",
    )


@query(f"with {OVERLAP}, {CITED} select query_id, ref_id, title, source, section from cited")
def citation_block(spark, sf_dir):
    return cited(spark, sf_dir).select("query_id", "ref_id", "title", "source", "section")


@query(f"with {OVERLAP}, {CITED} select * from texts")
def citation_text(spark, sf_dir):
    return rt.citation_text(cited(spark, sf_dir))


@query(f"with {PAIRS}, {OVERLAP}, {CITED} select conv_id, turn, md5(case when coalesce(citations, '') = '' then answer else answer || chr(10) || chr(10) || '【来源引用】' || chr(10) || citations end) as answer_md5 from pairs left join texts on query_id = conv_id")
def inject_citations(spark, sf_dir):
    texts = rt.citation_text(cited(spark, sf_dir)).withColumnRenamed("query_id", "conv_id")
    headed = F.concat("answer", F.lit("\n\n【来源引用】\n"), "citations")
    answer = F.when(F.coalesce("citations", F.lit("")) == "", F.col("answer")).otherwise(headed)
    return _turns(spark, sf_dir).join(texts, "conv_id", "left").select("conv_id", "turn", F.md5(answer).alias("answer_md5"))


# answers that cite: each turn cites its own number and the next
REFS = "refs as (select conv_id, turn, unnest(regexp_extract_all(answer || ' [' || turn || '][' || (turn + 1) || ']', '\\[(\\d+)\\]', 1))::int as ref_id from pairs)"


def _refs(spark, sf_dir):
    text = F.format_string("%s [%d][%d]", F.col("answer"), F.col("turn"), F.col("turn") + 1)
    return _turns(spark, sf_dir).select("conv_id", "turn", F.explode(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1))).alias("r")).select("conv_id", "turn", F.col("r").cast("int").alias("ref_id"))


@query(f"with {PAIRS}, {REFS} select * from refs")
def extract_refs(spark, sf_dir):
    return _refs(spark, sf_dir)


@query(f"with {PAIRS}, {OVERLAP}, {REFS} select distinct conv_id, turn, ref_id from refs where not exists (select 1 from overlap_top o where o.query_id = refs.conv_id and o.rank = refs.ref_id)")
def ref_coverage(spark, sf_dir):
    known = overlap_top(spark, sf_dir).select(F.col("query_id").alias("conv_id"), F.col("rank").alias("ref_id"))
    return _refs(spark, sf_dir).join(known, ["conv_id", "ref_id"], "left_anti").select("conv_id", "turn", "ref_id").distinct()
