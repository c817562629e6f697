"""Queries of the text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import scanning
from tessera.operators import logs
from tessera.plans.registry import query
from tessera.session import spread, table

SP = tx.UNICODE_SPACE
STRIP = f"'^{SP}+|{SP}+$', '', 'g'"
LATIN = tx.LATIN
PUNCT = tx.QUESTION_PUNCTUATION.replace("'", "''")
BLACKLIST = (r"^\d+$", "license", "rights reserved")
HOW_MANY = ("how", "wh")
GENERIC = ("It.", "This.", "The.")
PAIRS = """
turns as (
  select conv_id, turn, role, text, lead(text) over w as next_text, lead(role) over w as next_role
  from conversations where role <> 'system' window w as (partition by conv_id order by turn)
), pairs as (
  select conv_id, turn, coalesce(text, '') as question, coalesce(next_text, '') as answer from turns where role = 'user' and next_role = 'assistant'
)
"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "documents")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.session_turns(conversations(spark, sf_dir))
    return found.select("conv_id", "turn", tx.given(F.col("question")).alias("question"), tx.given(F.col("answer")).alias("answer"))


@query(f"select conv_id, turn, lower(regexp_replace(regexp_replace(coalesce(text, ''), '{SP}+', '', 'g'), '{PUNCT}', '', 'g')) as question_key from conversations")
def norm_question_key(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", tx.norm_question_key(F.col("text")).alias("question_key"))


CURATED = f"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^The[:：]?{SP}*', ''), {STRIP}), '{SP}+', '', 'g')"


@query(f"select conv_id, turn, {CURATED} as question from conversations")
def norm_question_curated(spark, sf_dir):
    prefixed = tx.without_space(tx.strip(F.regexp_replace(tx.given(F.col("text")), f"^The[:：]?{SP}*", "")))
    return conversations(spark, sf_dir).select("conv_id", "turn", prefixed.alias("question"))


@query(
    f"""with q as (select conv_id, turn, replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^问题[:：]{SP}*', ''), {STRIP}), '{SP}+', '', 'g'), '?', '？') as s from conversations)
    select conv_id, turn, case when s = '' or contains('？。！!', right(s, 1)) then s else s || '？' end as question from q"""
)
def norm_question_mark(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", tx.norm_question_mark(F.col("text")).alias("question"))


@query(
    f"""select doc_id, md5(regexp_replace(coalesce(text, ''), '{SP}+', '', 'g')) as bare_md5, md5(regexp_replace(coalesce(text, ''), '\\n{{3,}}', chr(10) || chr(10), 'g')) as two_md5,
    md5(regexp_replace(coalesce(text, ''), '\\n{{2,}}', chr(10), 'g')) as one_md5 from documents"""
)
def norm_whitespace(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id",
        F.md5(tx.without_space(text)).alias("bare_md5"),
        F.md5(tx.collapse_newlines(text, 3, 2)).alias("two_md5"),
        F.md5(tx.collapse_newlines(text, 2, 1)).alias("one_md5"),
    )


@query(f"select doc_id, len(regexp_extract_all(coalesce(text, ''), '{tx.HAN}'))::int as han, len(regexp_extract_all(coalesce(text, ''), '[0-9]'))::int as digits, len(regexp_extract_all(coalesce(text, ''), '{LATIN}'))::int as latin from documents")
def char_class_count(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", tx.char_class_count(t).alias("han"), tx.char_class_count(t, "[0-9]").alias("digits"), tx.char_class_count(t, LATIN).alias("latin"))


KEYWORDS = ("license", "token", "the", "trash", "des")
HITS = " + ".join(f"contains(coalesce(text, ''), '{k}')::int" for k in KEYWORDS)


@query(f"select doc_id, ({HITS}) > 0 as any_hit from documents")
def keyword_any(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.keyword_any(F.col("text"), KEYWORDS).alias("any_hit"))


@query(f"select doc_id, ({HITS})::int as hits from documents")
def keyword_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.keyword_count(F.col("text"), KEYWORDS).alias("hits"))


@query(f"select doc_id, regexp_matches(coalesce(text, ''), '{'|'.join(f'(?:{p})' for p in BLACKLIST)}') as listed from documents")
def blacklist_regex(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.blacklist_regex(F.col("text"), BLACKLIST).alias("listed"))


@query("select doc_id, (contains(coalesce(text, ''), 'Licensed') and contains(coalesce(text, ''), 'Apache')) or (contains(coalesce(text, ''), 'rights') and contains(coalesce(text, ''), 'reserved')) as cover from documents")
def cover_page_flag(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.cover_page_flag(F.col("text"), [("Licensed", "Apache"), ("rights", "reserved")]).alias("cover"))


READABLE_Q = rf"""len(question) between 8 and 200 and len(regexp_extract_all(question, '{LATIN}')) >= 6 and not regexp_matches(question, '[=:/\\]')
    and not regexp_matches(question, '[()（）\[\]{{}}]') and not regexp_matches(question, '\d{{4,}}') and ends_with(question, '.')"""


@query(f"with {PAIRS} select conv_id, turn, {READABLE_Q} as readable from pairs")
def readable_question(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", tx.readable_question(F.col("question"), LATIN, latin=r"[=:/\\]", end=".", most=200).alias("readable"))


def _answer_sql(least: int, most: int, chars: int, digits: int) -> str:
    a = f"regexp_replace(answer, {STRIP})"
    how = " or ".join(f"contains(question, '{w}')" for w in HOW_MANY)
    generic = ", ".join(f"'{g}'" for g in GENERIC)
    return f"""case when {a} = '' then false when regexp_matches({a}, '^[\\d.]+$') then ({how}) and len({a}) <= {digits}
    else len({a}) between {least} and {most} and len(regexp_extract_all({a}, '{LATIN}')) >= {chars} and {a} not in ({generic}) end"""


@query(f"with {PAIRS} select conv_id, turn, {_answer_sql(4, 80, 2, 8)} as readable from pairs")
def readable_answer(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", tx.readable_answer(F.col("question"), F.col("answer"), LATIN, HOW_MANY, GENERIC).alias("readable"))


BLACK_Q = f"regexp_matches(question, '{'|'.join(f'(?:{p})' for p in BLACKLIST)}')"


@query(f"with {PAIRS} select conv_id, turn, len(question) >= 6 and regexp_replace(answer, {STRIP}) <> '' and not {BLACK_Q} as accepted from pairs")
def curated_primary_ok(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", tx.curated_primary_ok(F.col("question"), F.col("answer"), BLACKLIST).alias("accepted"))


@query(
    rf"with {PAIRS} select conv_id, turn, len(question) between 6 and 64 and len(regexp_extract_all(question, '{LATIN}')) >= 4 and not regexp_matches(question, '[=:/\\]{{2,}}') and not {BLACK_Q} and ({_answer_sql(2, 220, 1, 10)}) as accepted from pairs"
)
def curated_fallback_ok(spark, sf_dir):
    ok = tx.curated_fallback_ok(F.col("question"), F.col("answer"), LATIN, r"[=:/\\]{2,}", HOW_MANY, BLACKLIST, GENERIC)
    return pairs(spark, sf_dir).select("conv_id", "turn", ok.alias("accepted"))


@query(
    f"""with {PAIRS} select conv_id, turn, len(question) between 4 and 30 and len(regexp_extract_all(question, '？')) <= 1 and len(regexp_extract_all(question, '\\?')) <= 1
    and regexp_matches(question, '{LATIN}{{2,}}') and not contains(question, repeat(chr(65533), 4)) as plausible from pairs"""
)
def question_plausible(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", tx.question_plausible(F.col("question"), LATIN).alias("plausible"))


@query(f"with {PAIRS} select conv_id, turn, len(question) between 4 and 80 and not contains(question, '<ans>') and len(list_distinct(regexp_extract_all(question, '(?s).'))) > 2 as valid from pairs")
def valid_generated_question(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", tx.valid_generated_question(F.col("question")).alias("valid"))


@query(f"select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), {STRIP}), '^{tx.CANDIDATE_EDGE}+|{tx.CANDIDATE_EDGE}+$', '', 'g'), '{SP}+', '', 'g') as candidate from conversations")
def clean_candidate(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", tx.clean_candidate(F.col("text")).alias("candidate"))


@query(
    """with a as (select doc_id, text, regexp_extract(text, '([A-Za-z]+)[.]', 1) as answer from documents), b as (select *, instr(text, answer) as pos from a where answer <> '')
    select doc_id, md5('知识：' || substring(text, 1, pos - 1) || '<ans>' || substring(text, pos + len(answer)) || chr(10) || '回答：' || answer) as prompt_md5, answer from b where pos > 0"""
)
def mask_answer_prompt(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("answer", F.regexp_extract("text", "([A-Za-z]+)[.]", 1))
    prompt = tx.mask_answer_prompt(F.col("text"), F.col("answer"))
    return docs.withColumn("prompt", prompt).filter("prompt is not null").select("doc_id", F.md5("prompt").alias("prompt_md5"), "answer")


@query("with p as (select conv_id, turn, replace(coalesce(text, ''), chr(10), ' ') as s from conversations) select conv_id, turn, case when len(s) > 80 then left(s, 80) || '…' else s end as preview from p")
def history_preview(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", tx.history_preview(F.col("text")).alias("preview"))


@query(
    r"""with m as (select event_id, event_type || ' ' || coalesce(props, '') || ' ' || (400 + event_id % 110)::varchar as msg from events),
    c as (select event_id, lower(msg) as low, nullif(regexp_extract(msg, '\b(401|403|408|409|429|500|502|503|504)\b', 1), '')::int as code from m)
    select event_id, coalesce(code, 0) as error_code, case when code in (401, 403) or contains(low, '无效的令牌') or (contains(low, 'invalid') and contains(low, 'token')) then 'auth'
      when code = 429 or (contains(low, 'rate') and contains(low, 'limit')) or contains(low, 'too many requests') or contains(low, '限流') then 'rate_limit'
      when code >= 500 then 'upstream' else 'unknown' end as error_type from c"""
)
def error_code_class(spark, sf_dir):
    message = F.concat_ws(" ", "event_type", F.coalesce("props", F.lit("")), (400 + F.col("event_id") % 110).cast("string"))
    events = table(spark, sf_dir, "events").select("event_id", message.alias("msg"))
    return events.select("event_id", F.coalesce(tx.error_code(F.col("msg")), F.lit(0)).alias("error_code"), tx.error_class(F.col("msg")).alias("error_type"))


@query("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.page') as page from events")
def json_prop(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M') as shown from events")
def time_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"))


SCAN = "\n union all ".join(f"select doc_id, text, '{name}' as pattern, regexp_extract_all(text, '{rx}') as hits, string_split_regex(text, '{rx}') as parts from filled" for name, rx in tx.SENSITIVE)
SCAN = f"""filled as (select doc_id, coalesce(text, '') as text from documents), found as ({SCAN}),
numbered as (select *, unnest(range(1, len(hits) + 1)) as n from found),
placed as (select doc_id, pattern, text, hits[n] as hit, (1 + list_sum(list_transform(parts[1:n], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:n - 1], lambda x: len(x))), 0))::int as start_at from numbered),
scan as (select * from placed where not contains(hit, 'YOUR_') and not contains(lower(hit), 'your-'))"""


@query(f"with {SCAN} select doc_id, pattern, start_at, hit, replace(substring(text, greatest(1, start_at - 50), least(50, start_at - 1) + len(hit) + 50), chr(10), ' ') as context from scan")
def sensitive_scan(spark, sf_dir):
    return scanning.scan(spread_documents(spark, sf_dir))


PATHS = "'corpus/' || case doc_id % 7 when 0 then '.git/' when 1 then 'models/' else 'notes/' end || case when doc_id % 11 = 0 then 'tokenizer_config.json' else doc_id || ['.py', '.md', '.png', '.json', '.ocr_cache.json'][(doc_id % 5 + 1)::int] end"


@query(
    f"""with {SCAN.replace('from documents', f"from (select *, {PATHS} as path from documents) where regexp_matches(path, '[.](py|md|json)$') and not contains(path, '/.git/') and not contains(path, '/models/') and not ends_with(path, '.ocr_cache.json') and not ends_with(path, 'tokenizer_config.json')", 1)}
    select 'corpus' as folder, pattern, count(*) as hits, count(distinct doc_id) as files from scan group by pattern"""
)
def sensitive_scan_files(spark, sf_dir):
    """Hits in files that a scan of a folder reads: by extension, folder and name."""
    d = F.col("doc_id")
    folder = F.when(d % 7 == 0, ".git/").when(d % 7 == 1, "models/").otherwise("notes/")
    ends = F.element_at(F.array(*map(F.lit, [".py", ".md", ".png", ".json", ".ocr_cache.json"])), (d % 5 + 1).cast("int"))
    name = F.when(d % 11 == 0, "tokenizer_config.json").otherwise(F.concat(d.cast("string"), ends))
    rows = spread_documents(spark, sf_dir).withColumn("path", F.concat(F.lit("corpus/"), folder, name))
    found = scanning.scan_files(rows, keep=("doc_id", "path"))
    return found.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), "pattern").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("files"))


@query(f"with {SCAN} select pattern, count(*) as hits, count(distinct doc_id) as docs from scan group by pattern")
def sensitive_summary(spark, sf_dir):
    return scanning.scan(spread_documents(spark, sf_dir)).groupBy("pattern").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


_masked = "text"
for _rx, _by in tx.MASKS:
    _masked = f"regexp_replace({_masked}, '{_rx}', '{_by.replace('$1', chr(92) + '1')}', 'g')"


@query(f"select doc_id, md5({_masked}) as masked_md5, {_masked} <> text as changed from documents")
def mask_sensitive(spark, sf_dir):
    masked = tx.mask_sensitive(F.col("text"))
    return spread_documents(spark, sf_dir).select("doc_id", F.md5(masked).alias("masked_md5"), (masked != F.col("text")).alias("changed"))
