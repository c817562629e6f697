"""Queries of the splitters and of chunk statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking as ck
from tessera.plans.registry import query
from tessera.plans.texts import SP, STRIP, documents, spread_documents
from tessera.session import table


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP})"


@query()
def recursive_chunks(spark, sf_dir):
    rows = spread_documents(spark, sf_dir).select("doc_id", F.posexplode(ck.recursive_chunks(F.col("text"))).alias("chunk_ix", "chunk"))
    return rows.select("doc_id", "chunk_ix", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query()
def parent_child_chunks(spark, sf_dir):
    children = ck.child_chunks(ck.parent_chunks(spread_documents(spark, sf_dir)))
    return children.select("id", "doc_id", "parent_ix", "child_ix", F.md5("text").alias("text_md5"))


@query("""select doc_id, lower(trim(source)) as source, case when lower(trim(source)) in ('src1', 'src3') then 'hybrid' when lower(trim(source)) = 'src2' then 'markdown' else 'rule' end as mode from documents""")
def chunk_mode_by_source(spark, sf_dir):
    modes = F.create_map(*[F.lit(x) for pair in {"src1": "hybrid", "src3": "hybrid", "src2": "markdown"}.items() for x in pair])
    source = F.lower(F.trim("source"))
    return documents(spark, sf_dir).select("doc_id", source.alias("source"), F.coalesce(F.try_element_at(modes, source), F.lit("rule")).alias("mode"))


@query()
def markdown_chunks(spark, sf_dir):
    rows = spread_documents(spark, sf_dir).select("doc_id", F.posexplode(ck.markdown_chunks(F.col("text"))).alias("chunk_ix", "chunk"))
    return rows.select("doc_id", "chunk_ix", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query(
    f"""with recursive parts as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n+'), lambda x: {_strip('x')}), lambda x: x <> '') as p from documents),
    steps as (
      select doc_id, p, 1 as i, [] :: varchar[] as out, coalesce(p[1], '') as buffer from parts
      union all
      select doc_id, p, i + 1, case when len(buffer) < 80 then out else list_append(out, buffer) end, case when len(buffer) < 80 then buffer || chr(10) || p[i + 1] else p[i + 1] end from steps where i < len(p)
    ), done as (select doc_id, case when buffer = '' then out else list_append(out, buffer) end as chunks from steps where i >= len(p)),
    numbered as (select doc_id, unnest(range(len(chunks)))::int as chunk_ix, unnest(chunks) as chunk from done)
    select doc_id, chunk_ix, len(chunk)::int as n_chars, md5(chunk) as chunk_md5 from numbered"""
)
def structure_split(spark, sf_dir):
    # the documents have no blank lines, so every line counts as a paragraph here
    lines = F.regexp_replace(tx.given(F.col("text")), "\n+", "\n\n")
    rows = spread_documents(spark, sf_dir).select("doc_id", F.posexplode(ck.structure_split(lines)).alias("chunk_ix", "chunk"))
    return rows.select("doc_id", "chunk_ix", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


SENTENCES = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^。！？!?；;\\n]+[。！？!?；;\\n]?'), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(
    f"""with s as (select doc_id, {SENTENCES} as found, coalesce(text, '') as text from documents), t as (select doc_id, case when len(found) > 0 then found else [text] end as s from s)
    select doc_id, unnest(range(len(s)))::int as sentence_ix, unnest(list_transform(s, lambda x: md5(x))) as sentence_md5 from t"""
)
def sentence_split(spark, sf_dir):
    return spread_documents(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sentence_ix", "s")).select("doc_id", "sentence_ix", F.md5("s").alias("sentence_md5"))


@query()
def semantic_break_chunks(spark, sf_dir):
    chunks = ck.semantic_break_chunks(ck.with_vectors(tx.sentences(F.col("text"))))
    return spread_documents(spark, sf_dir).select("doc_id", F.posexplode(chunks).alias("chunk_ix", "chunk")).select("doc_id", "chunk_ix", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query()
def hybrid_chunks(spark, sf_dir):
    return ck.hybrid_chunks(spread_documents(spark, sf_dir)).select("doc_id", "chunk_ix", F.length("text").alias("n_chars"), F.md5("text").alias("chunk_md5"))


WINDOWS = f"""windows as (
  select doc_id, n as raw_ix, {_strip("substring(text, n * 250 + 1, 300)")} as chunk
  from (select doc_id, text, unnest(range(greatest(0, ceil((len(text) - 300) / 250.0))::int + 1)) as n from documents)
), chunks as (select doc_id, (row_number() over (partition by doc_id order by raw_ix) - 1)::int as chunk_ix, chunk from windows where chunk <> '')"""


def window_rows(spark, sf_dir):
    return spread_documents(spark, sf_dir).select("doc_id", "source", "lang", F.posexplode(ck.window_chunks(F.col("text"))).alias("chunk_ix", "chunk"))


@query(
    f"""with {WINDOWS}, lagged as (select *, lag(chunk) over (partition by doc_id order by chunk_ix) as prev, lag(chunk, 2) over (partition by doc_id order by chunk_ix) as prev2 from chunks)
    select doc_id, chunk_ix, md5(case when prev is null then chunk else right(case when prev2 is null then prev else right(prev2, 50) || prev end, 50) || chunk end) as chunk_md5 from lagged"""
)
def chunk_overlap_prefix(spark, sf_dir):
    headed = ck.chunk_overlap_prefix(ck.window_chunks(F.col("text")), 50)
    return documents(spark, sf_dir).select("doc_id", F.posexplode(headed).alias("chunk_ix", "chunk")).select("doc_id", "chunk_ix", F.md5("chunk").alias("chunk_md5"))


def _lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw")).select("doc_id", "n", tx.strip(F.col("raw")).alias("line"))


LINES = f"lines as (select doc_id, n, {_strip('raw')} as line from (select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as n, unnest(string_split(text, chr(10))) as raw from documents))"
HEADING = r"regexp_matches(line, '^[A-Z]') and regexp_matches(line, '[a-zA-Z\x{c0}-\x{24f}]') and len(line) <= 80 and len(regexp_extract_all(line, '\d'))::double / greatest(len(line), 1) < 0.45"


@query(f"with {LINES} select doc_id, n, {HEADING} as heading from lines where line <> ''")
def heading_flag(spark, sf_dir):
    flag = tx.heading_flag(F.col("line"), tx.LATIN, "^[A-Z]")
    return _lines(spark, sf_dir).filter("line <> ''").select("doc_id", "n", flag.alias("heading"))


@query(
    f"""with raws as (select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as n, unnest(string_split(text, chr(10))) as raw from documents), lines as (select *, {_strip('raw')} as line from raws),
    marked as (select *, sum((line <> '' and {HEADING})::int) over (partition by doc_id order by n) as section_ix from lines),
    grouped as (select doc_id, section_ix::int as section_ix, arg_min(line, n) as title, {_strip("string_agg(raw, chr(10) order by n)")} as text from marked where section_ix > 0 group by all),
    found as (select * from grouped where len(text) >= 40)
    select doc_id, section_ix, title, md5(text) as text_md5 from found
    union all select doc_id, 0, '全文', md5({_strip('text')}) from documents where doc_id not in (select doc_id from found)"""
)
def heading_sections(spark, sf_dir):
    flag = lambda line: tx.heading_flag(line, tx.LATIN, "^[A-Z]")
    return ck.sections(spread_documents(spark, sf_dir), flag).select("doc_id", "section_ix", "title", F.md5("text").alias("text_md5"))


@query(
    f"""with lines as (select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as n, unnest(string_split(text, chr(10))) as line from documents),
    marked as (select *, regexp_matches(line, '^(The|En|Der)\\s') as heading from lines), numbered as (select *, sum(heading::int) over (partition by doc_id order by n) as c from marked),
    chapters as (select doc_id, c, {_strip("arg_min(line, n)")} as title, {_strip("coalesce(string_agg(line, chr(10) order by n) filter (not heading), '')")} as content from numbered where c > 0 group by doc_id, c)
    select doc_id, md5(title) as title_md5, md5(content) as content_md5 from chapters qualify row_number() over (partition by doc_id, title order by c desc) = 1"""
)
def chapter_map(spark, sf_dir):
    return ck.chapter_map(spread_documents(spark, sf_dir), r"^(The|En|Der)\s").select("doc_id", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"))


@query(f"with {WINDOWS} select doc_id, chunk_ix, len(chunk)::int as n_chars, md5(chunk) as chunk_md5 from chunks")
def window_chunks(spark, sf_dir):
    return window_rows(spark, sf_dir).select("doc_id", "chunk_ix", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query(
    """with p as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as ix, count(*) over (partition by source) as size from documents),
    h as (select *, size <= 15 or ix in (select round_even(i * (size - 1) / 14.0::double, 0) from range(15) t(i)) as hit from p),
    k as (select *, row_number() over (partition by source order by hit desc, ix) as k from h) select source, doc_id from k where k <= 15"""
)
def evenly_pick(spark, sf_dir):
    return ck.evenly_pick(documents(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 15)


@query(
    """with p as (select source, text, row_number() over (partition by source order by doc_id) - 1 as pos, count(*) over (partition by source) as size from documents),
    a as (select source, pos as anchor, size, pos = size // 2 as long from p),
    r as (select *, case when long then greatest(0, least(size, greatest(0, anchor - 2) + 5) - 5) else anchor end as lo, case when long then least(size, greatest(0, anchor - 2) + 5) when anchor % 2 = 0 then least(size, anchor + 2) else anchor + 1 end as hi from a)
    select r.source, r.anchor::int as anchor, case when r.long then 'long' else 'short' end as window_type, count(*) as n_chunks, md5(string_agg(p.text, chr(10) || chr(10) order by p.pos)) as text_md5
    from r join p on p.source = r.source and p.pos >= r.lo and p.pos < r.hi group by all"""
)
def context_windows(spark, sf_dir):
    found = ck.context_windows(documents(spark, sf_dir).select("source", F.col("doc_id").alias("chunk_ix"), "text"))
    return found.select("source", "anchor", "window_type", "n_chunks", F.md5("text").alias("text_md5"))


STATS = """count(*) as n_chunks, avg(len(chunk)) as avg_len, median(len(chunk)) as median_len, min(len(chunk))::int as min_len, max(len(chunk))::int as max_len, avg((len(chunk) < 120)::int) as short_share,
  (list_sort(list(len(chunk)))[least(count(*) - 1, floor(count(*) * 0.9)::bigint) + 1])::int as p90_len"""


@query(f"with {WINDOWS} select d.lang, {STATS} from chunks join documents d using (doc_id) group by d.lang")
def chunk_length_stats(spark, sf_dir):
    return ck.length_stats(window_rows(spark, sf_dir), "lang", text="chunk")


@query(
    """with o as (select label, vec_id, embedding, row_number() over (partition by label order by vec_id) as n from embeddings), f as (select * from o where n <= 50),
    p as (select label, vec_id, list_sum(list_transform(list_zip(embedding, lead(embedding) over (partition by label order by vec_id)), lambda x: x[1]::double * x[2]::double)) as sim, lead(embedding) over (partition by label order by vec_id) as nxt from f)
    select label, round(avg(sim), 9) as coherence from p where nxt is not null group by label"""
)
def chunk_coherence(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    first = table(spark, sf_dir, "embeddings").withColumn("n", F.row_number().over(w)).filter("n <= 50")
    pairs = first.withColumn("next", F.lead("embedding").over(w)).filter("next is not null")
    return pairs.groupBy("label").agg(F.round(F.avg(ck.dot(F.col("embedding"), F.col("next"))), 9).alias("coherence"))


@query(
    f"""with {WINDOWS}, lines as (select doc_id, unnest(string_split(text, chr(10))) as chunk from documents), all_modes as (select 'window' as mode, chunk from chunks union all select 'line', chunk from lines where chunk <> ''),
    s as (select mode, count(*) as n, avg(len(chunk)) as a, max(len(chunk)) as m from all_modes group by mode)
    select (w.n - l.n) as n_delta, w.a - l.a as avg_delta, (w.m - l.m)::int as max_delta from s w, s l where w.mode = 'window' and l.mode = 'line'"""
)
def chunk_mode_delta(spark, sf_dir):
    windows = window_rows(spark, sf_dir).select(F.lit("window").alias("mode"), "chunk")
    lines = documents(spark, sf_dir).select(F.lit("line").alias("mode"), F.explode(F.split("text", "\n")).alias("chunk")).filter("chunk <> ''")
    both = windows.unionByName(lines).withColumn("n", F.length("chunk"))
    wide = both.groupBy().pivot("mode", ["window", "line"]).agg(F.count("n").alias("count"), F.avg("n").alias("avg"), F.max("n").alias("max"))
    return wide.select((F.col("window_count") - F.col("line_count")).alias("n_delta"), (F.col("window_avg") - F.col("line_avg")).alias("avg_delta"), (F.col("window_max") - F.col("line_max")).alias("max_delta"))


ANCHORS = ((r"(?:of|that|with) ([^.,;\n]{2,16})", 1), (r"(\d+(?:[.]\d+)?)", 1))
STOP = ("the", "and", "of")


def _clean(x: str) -> str:
    edge = tx.CANDIDATE_EDGE
    return f"regexp_replace(regexp_replace({_strip(x)}, '^{edge}+|{edge}+$', '', 'g'), '{SP}+', '', 'g')"


CANDIDATES = f"""sents as (select doc_id, chunk_ix, chunk, unnest(range(len(ss))) as si, unnest(ss) as s from (
    select doc_id, chunk_ix, chunk, list_filter(list_transform(regexp_extract_all(chunk, '[^.!?]+[.!?]?'), lambda x: {_strip('x')}), lambda x: x <> '') as ss from chunks)),
lists as (select doc_id, chunk_ix, si, [{', '.join(f"regexp_extract_all(s, '{p}', 1)" for p, _ in ANCHORS)}, list_filter(list_transform(string_split_regex(s, '[,|;\\s]+'), lambda x: {_clean('x')}), lambda x: len(x) between 2 and 12)] as f from sents),
fams as (select doc_id, chunk_ix, si, unnest(range(len(f))) as fi, unnest(f) as c from lists),
rows as (select doc_id, chunk_ix, si, fi, unnest(range(len(c))) as ci, unnest(c) as raw from fams),
cleaned as (select *, {_clean('raw')} as c from rows),
firsts as (select doc_id, chunk_ix, c, min(row(si, fi, ci)) as first from cleaned where len(c) between 2 and 18 and not starts_with(c, '-') and not ends_with(c, '-') and c not in ('the', 'and', 'of') group by all),
placed as (select doc_id, chunk_ix, c, (row_number() over (partition by doc_id, chunk_ix order by case when regexp_matches(c, '^\\d+(?:[.]\\d+)?$') then 0 when contains(c, '.') then 1 else 2 end, first) - 1)::int as pos from firsts)"""


def _found(limit: int):
    return tx.answer_candidates(F.col("chunk"), ANCHORS, ".!?", r"[,|;\s]+", ".", r"^\d+(?:[.]\d+)?$", STOP, "-", limit)


@query(f"with {WINDOWS}, {CANDIDATES} select doc_id, chunk_ix, pos, c as answer from placed where pos < 8")
def answer_candidates(spark, sf_dir):
    return window_rows(spark, sf_dir).select("doc_id", "chunk_ix", F.posexplode(_found(8)).alias("pos", "answer"))


@query(
    f"""with {WINDOWS}, {CANDIDATES}, p as (select doc_id, chunk_ix, pos, c as answer, chunk, instr(chunk, c) as i from placed join chunks using (doc_id, chunk_ix) where pos < 20),
    j as (select *, row_number() over (partition by doc_id, chunk_ix order by pos)::int as job from p where i > 0)
    select doc_id, chunk_ix, job, answer, md5('知识：' || substring(chunk, 1, i - 1) || '<ans>' || substring(chunk, i + len(answer)) || chr(10) || '回答：' || answer) as prompt_md5 from j where job <= 12"""
)
def prompt_jobs(spark, sf_dir):
    """The first 12 usable prompts of each window, found inside its row: texts are never shuffled."""
    prompts = F.transform(_found(20), lambda c: F.struct(c.alias("answer"), F.md5(tx.mask_answer_prompt(F.col("chunk"), c)).alias("prompt_md5")))
    usable = F.slice(F.filter(prompts, lambda p: p["prompt_md5"].isNotNull()), 1, 12)
    rows = window_rows(spark, sf_dir).select("doc_id", "chunk_ix", F.posexplode(usable).alias("at", "p"))
    return rows.select("doc_id", "chunk_ix", (F.col("at") + 1).alias("job"), "p.answer", "p.prompt_md5")
