"""The contract queries of the operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, bpe, conversations, html_text, language, line_dedup, mixing, near_dedup, neighbours, quality, token_counts, toxicity
from tessera.llm.common import small_batches, table
from tessera.llm.exact_dedup import exact_duplicates

COUNT_TOKENIZER = "byte_bpe_50k.json"
BPE_TOKENIZER = "byte_bpe_multi_50k.tiktoken"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_TOKENIZER))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.languages(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_TOKENIZER), public_tokenizers.PATTERN)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return conversations.digests(conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_token_counts, op3_near_dedup, op4_toxicity, op5_mixing, op6_quality, op7_language, op8_exact_dedup, op9_bpe, op10_neighbours, op11_alignment, op12_line_dedup, op13_conversations, pipeline)
}

NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

OP3 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) end as s
  from words
), kinds as (
  select s, min(doc_id) as rep, len(s) as n from (select doc_id, list_sort(s) as s from sets where len(s) > 0) group by s
), posted as (
  select rep, n, unnest(s) as shingle from kinds
), shared as (
  select a.rep as a, b.rep as b, count(*) as n_shared, any_value(a.n) as na, any_value(b.n) as nb
  from posted a join posted b on a.shingle = b.shingle and a.rep < b.rep
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by 1, 2
), links as (
  select a, b from shared where 100 * n_shared >= 80 * (na + nb - n_shared)
), sides as (
  select a, b from links union all select b, a from links
), reach as (
  select rep as a, rep as b from kinds
  union
  select reach.a, sides.b from reach join sides on reach.b = sides.a
), least_of as (
  select a as rep, min(b) as component from reach group by a
)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(l.component, d.doc_id) as component_id,
  d.doc_id = coalesce(l.component, d.doc_id) as kept
from sets d left join kinds k on k.s = list_sort(d.s) left join least_of l on l.rep = k.rep
"""

OP5 = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(coalesce(doc_id::varchar, '')) as key
  from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from sized group by source
), ranked as (
  select *, [3, 1, 2][((rank - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as cap,
    (sum(source_size) over ())::bigint * 1.5::double as budget
  from sources
), filled as (
  select *,
    coalesce(sum(cap) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0.0) as caps_before,
    sum(weight) over (order by source_size / weight, rank rows between current row and unbounded following) as weights_left
  from ranked
), marked as (
  select *, cap * weights_left <= (budget - caps_before) * weight as filled_up from filled
), targets as (
  select source, source_size, case when filled_up then cap else weight * (budget - sum(case when filled_up then cap else 0.0 end) over ())
    / nullif(sum(case when filled_up then 0.0 else weight end) over (), 0.0) end::double as target
  from marked
), placed as (
  select s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::bigint as budget,
    (sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and current row))::bigint - s.size as before
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (case when source_size > 0 then budget // source_size else 0 end * size
    + greatest(0, least(size, budget - (case when source_size > 0 then budget // source_size else 0 end) * source_size - before)))::bigint as taken
from placed
"""

OP8 = f"""
with digests as (select doc_id, sha256({NORMAL}) as text_sha256 from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = min(doc_id) over same as kept, text_sha256
from digests window same as (partition by text_sha256)
"""

OP10 = """
with valid as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), lengths as (
  select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from valid
), scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) / (q.norm * c.norm) as score
  from lengths q join lengths c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP12 = r"""
with lines as (
  select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place
  from documents
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), shared as (
  select key, min(doc_id) as keep_id from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), judged as (
  select k.doc_id, k.text, k.line, k.place, s.key is not null and k.doc_id <> s.keep_id as dropped from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, (count(*) filter (where dropped))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id, text
"""

OP13 = r"""
with recursive crc_table as (
  select list(list_reduce(range(9), lambda c, i: case when i = 0 then c when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b) as t
  from (select unnest(range(256)) as b)
), coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 as code
  from conversations, crc_table
), hurt as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case when code = 1 then '' when code = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when code = 3 then 2 else 1 end)) as copy
  from coded where code <> 0
), placed as (
  select *, row_number() over w as i, left(role, 1) as initial, lag(left(role, 1)) over w as before,
    row_number() over (partition by conv_id, role, text order by turn nulls first, role, text, copy) > 1 as again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
  from hurt window w as (partition by conv_id order by turn nulls first, role, text, copy)
), faulty as (
  select *, case when bare = '' then 2 when again then 3 when right(bare, 1) not in ('.', '!', '?') then 1 else 0 end as fault from placed
), counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where fault = 2) as blank, count(*) filter (where fault = 3) as duplicate, count(*) filter (where fault = 1) as truncated,
    count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id
), ways as (  -- the cheapest edits from row i on, by what stands before it: nothing, a system, user or assistant row
  select conv_id, n + 1 as i, {'c': 0, 'p': ''} as none, {'c': 10, 'p': 'II'} as system, {'c': 5, 'p': 'I'} as user, {'c': 0, 'p': ''} as assistant from counts
  union all
  select conv_id, i,
    least(s.none, {'c': 5 + u.c, 'p': 'I' || u.p}), least(s.system, {'c': 5 + u.c, 'p': 'I' || u.p}), u, least(s.assistant, {'c': 5 + s.user.c, 'p': 'I' || s.user.p})
  from (
    select *, least(s.user, {'c': 5 + s.assistant.c, 'p': 'I' || s.assistant.p}) as u
    from (
      select conv_id, i, {
        'none': least({'c': 2 + w.none.c, 'p': 'D' || w.none.p}, {'c': no + 1 + w.user.c, 'p': 'R' || w.user.p},
          {'c': no + w.system.c + case when initial = 's' then 0 else 1000000 end, 'p': 'K' || w.system.p},
          {'c': no + w.user.c + case when initial = 'u' then 0 else 1000000 end, 'p': 'K' || w.user.p}),
        'system': least({'c': 2 + w.system.c, 'p': 'D' || w.system.p}, {'c': no + 1 + w.user.c, 'p': 'R' || w.user.p},
          {'c': no + w.user.c + case when initial = 'u' then 0 else 1000000 end, 'p': 'K' || w.user.p}),
        'user': least({'c': 2 + w.user.c, 'p': 'D' || w.user.p}, {'c': no + 1 + w.assistant.c, 'p': 'R' || w.assistant.p},
          {'c': no + w.assistant.c + case when initial = 'a' then 0 else 1000000 end, 'p': 'K' || w.assistant.p}),
        'assistant': least({'c': 2 + w.assistant.c, 'p': 'D' || w.assistant.p}, {'c': no + 1 + w.user.c, 'p': 'R' || w.user.p},
          {'c': no + w.user.c + case when initial = 'u' then 0 else 1000000 end, 'p': 'K' || w.user.p})} as s
      from (
        select w.*, f.i as at, f.initial, case f.fault when 0 then 0 when 1 then 5 else 1000000 end as no
        from ways w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i - 1
      ) as w(conv_id, later, none, system, user, assistant, i, initial, no)
    )
  )
), best as (
  select conv_id, none.c as cost, none.p as audit from ways where i = 1
), applied as (  -- one row per edit, with the number of rows that the ones before it consume
  select conv_id, audit, k, audit[k] as edit, k - length(replace(left(audit, k), 'I', '')) as n_inserted, length(replace(left(audit, k), 'I', '')) as i
  from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as k from best)
), stand as (
  select a.conv_id, a.edit, a.k, f.role, f.text, row_number() over (partition by a.conv_id order by a.k) as place,
    max(case when a.edit = 'K' and left(f.role, 1) = 's' then 1 else 0 end) over (partition by a.conv_id) as headed
  from applied a left join faulty f on a.edit <> 'I' and f.conv_id is not distinct from a.conv_id and f.i = a.i
  where a.edit <> 'D'
), lines as (
  select conv_id, place, case when edit = 'K' then role when (place - headed) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end as line
  from stand
), hashes as (
  select conv_id, sha256(string_agg(line, chr(10) order by place)) as h from lines group by conv_id
), known as (select distinct conv_id from conversations)
select k.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate,
  coalesce(c.truncated, 0)::bigint as truncated, coalesce(c.illegal, 0)::bigint as illegal, coalesce(b.cost, 0)::bigint as cost,
  coalesce(b.audit, '') as audit, coalesce(h.h, sha256('')) as repaired_sha256
from known k left join counts c on c.conv_id is not distinct from k.conv_id
  left join best b on b.conv_id is not distinct from k.conv_id left join hashes h on h.conv_id is not distinct from k.conv_id
"""

ORACLES: dict[str, str] = {"op3_near_dedup": OP3, "op5_mixing": OP5, "op8_exact_dedup": OP8, "op10_neighbours": OP10, "op12_line_dedup": OP12, "op13_conversations": OP13}
