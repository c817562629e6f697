"""Text rules as Column functions: normalisation, predicates, scans and masks.

Word lists, character classes and thresholds are parameters; the defaults suit Chinese
questions, and the queries pass Latin ones. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, and character classes, as regular expressions.
UNICODE_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HAN = r"[\x{4e00}-\x{9fff}]"
LATIN = r"[a-zA-Z\x{c0}-\x{24f}]"
QUESTION_PUNCTUATION = r"""[？?。！!；;，,、·\-—_\[\]【】()（）<>《》"'“”‘’:]"""
ERROR_CODES = r"\b(401|403|408|409|429|500|502|503|504)\b"
EDGE_CHARS = "。；，,：:、"
CANDIDATE_EDGE = f"[{EDGE_CHARS}]"

# What a log must not show, in the order of replacement.
MASKS = (
    (r"(?i)(api[_-]?key\s*[=:]\s*)([^\s,;]+)", "$1***"),
    (r"(?i)(password\s*[=:]\s*)([^\s,;]+)", "$1***"),
    (r"(?i)(token\s*[=:]\s*)([^\s,;]+)", "$1***"),
    (r"(?i)(Bearer\s+)([A-Za-z0-9\-._~+/]+=*)", "$1***"),
    (r"(sk-[A-Za-z0-9\-_]{8,})", "***"),
)

# Secrets that a scan reports.
SENSITIVE = (
    ("api_key", r"(?i)sk-[a-zA-Z0-9]{20,}"),
    ("phone", r"(?i)1[3-9]\d{9}"),
    ("mysql_password", r"(?i)password\s*=\s*123456"),
    ("redis_password", r"(?i)password\s*=\s*1234[^_]"),
)


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def replaced(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def strip(text: Column) -> Column:
    return replaced(text, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$")


def without_space(text: Column) -> Column:
    return replaced(given(text), UNICODE_SPACE + "+")


def norm_question_key(question: Column) -> Column:
    return F.lower(replaced(without_space(question), QUESTION_PUNCTUATION))


def norm_question_curated(question: Column, prefix: str = "问题") -> Column:
    return without_space(strip(replaced(given(question), f"^{prefix}[:：]{UNICODE_SPACE}*")))


def norm_question_mark(question: Column, prefix: str | None = "问题", mark: str = "？", ends: str = "？。！!") -> Column:
    bare = norm_question_curated(question, prefix) if prefix else without_space(question)
    asked = F.replace(bare, F.lit("?"), F.lit(mark))
    closed = (asked == "") | F.contains(F.lit(ends), F.substring(asked, -1, 1))
    return F.when(closed, asked).otherwise(F.concat(asked, F.lit(mark)))


def collapse_newlines(text: Column, least: int = 3, to: int = 2) -> Column:
    return replaced(given(text), f"\n{{{least},}}", "\n" * to)


def char_class_count(text: Column, char_class: str = HAN) -> Column:
    return F.regexp_count(given(text), F.lit(char_class))


def keyword_count(text: Column, keywords: Sequence[str]) -> Column:
    hits = [F.contains(given(text), F.lit(k)).cast("int") for k in keywords]
    return sum(hits[1:], hits[0])


def keyword_any(text: Column, keywords: Sequence[str]) -> Column:
    return keyword_count(text, keywords) > 0


def blacklist_regex(text: Column, patterns: Sequence[str]) -> Column:
    return matches(given(text), "|".join(f"(?:{p})" for p in patterns))


def cover_page_flag(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Some group all of whose substrings occur."""
    flag = F.lit(False)
    for group in groups:
        flag = flag | (keyword_count(text, group) == len(group))
    return flag


def question_plausible(question: Column, char_class: str = HAN, least: int = 4, most: int = 30, mark: str = "?") -> Column:
    q = given(question)
    return (
        F.length(q).between(least, most)
        & (F.regexp_count(q, F.lit("？")) <= 1)
        & (F.regexp_count(q, F.lit(r"\?")) <= 1)
        & matches(q, char_class + "{2,}")
        & ~F.contains(q, F.lit("�" * 4))
    )


def readable_question(question: Column, char_class: str = HAN, least_chars: int = 6, latin: str = r"[A-Za-z]{2,}|[=:/\\]", end: str = "？", blacklist: Sequence[str] = (), least: int = 8, most: int = 40) -> Column:
    q = given(question)
    ok = (
        F.length(q).between(least, most)
        & (char_class_count(q, char_class) >= least_chars)
        & ~matches(q, latin)
        & ~matches(q, r"[()（）\[\]{}]")
        & ~matches(q, r"\d{4,}")
        & F.endswith(q, F.lit(end))
    )
    return ok & ~blacklist_regex(q, blacklist) if blacklist else ok


def readable_answer(question: Column, answer: Column, char_class: str = HAN, how_many: Sequence[str] = ("多少", "几"), generic: Sequence[str] = (), least: int = 4, most: int = 80, least_chars: int = 2, most_digits: int = 8) -> Column:
    a = strip(given(answer))
    length_ok = F.length(a).between(least, most) & (char_class_count(a, char_class) >= least_chars)
    if generic:
        length_ok = length_ok & ~a.isin(*generic)
    return (
        F.when(a == "", False)
        .when(matches(a, r"^[\d.]+$"), keyword_any(question, how_many) & (F.length(a) <= most_digits))
        .otherwise(length_ok)
    )


def curated_primary_ok(question: Column, answer: Column, blacklist: Sequence[str] = ()) -> Column:
    ok = (F.length(given(question)) >= 6) & (strip(given(answer)) != "")
    return ok & ~blacklist_regex(question, blacklist) if blacklist else ok


def curated_fallback_ok(question: Column, answer: Column, char_class: str = HAN, latin: str = r"[A-Za-z]{3,}|[=:/\\]{2,}", how_many: Sequence[str] = ("多少", "几"), blacklist: Sequence[str] = (), generic: Sequence[str] = ()) -> Column:
    q = given(question)
    ok = F.length(q).between(6, 64) & (char_class_count(q, char_class) >= 4) & ~matches(q, latin)
    if blacklist:
        ok = ok & ~blacklist_regex(q, blacklist)
    return ok & readable_answer(q, answer, char_class, how_many, generic, 2, 220, 1, 10)


def valid_generated_question(question: Column) -> Column:
    q = given(question)
    distinct = F.size(F.array_distinct(F.split(q, "")))
    return F.length(q).between(4, 80) & ~F.contains(q, F.lit("<ans>")) & (distinct > 2)


def clean_candidate(text: Column) -> Column:
    """Trimmed, without punctuation at its ends and without white space; a text that has none
    is spared the patterns for it."""
    bare = lambda t: F.btrim(t, F.lit(EDGE_CHARS))
    full = without_space(bare(strip(given(text))))
    return F.when(matches(given(text), UNICODE_SPACE), full).otherwise(bare(given(text)))


def mask_answer_prompt(text: Column, answer: Column) -> Column:
    """The prompt with the first occurrence of the answer masked; null where it is absent."""
    at = F.instr(text, answer)
    masked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("<ans>"), F.substring(text, at + F.length(answer), F.length(text)))
    return F.when((at > 0) & (F.length(answer) > 0), F.concat(F.lit("知识："), masked, F.lit("\n回答："), answer))


def history_preview(text: Column, most: int = 80) -> Column:
    flat = F.translate(given(text), "\n", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def error_code(text: Column) -> Column:
    found = F.regexp_extract(given(text), ERROR_CODES, 1)
    return F.when(found != "", found.cast("int"))


def error_class(text: Column) -> Column:
    low, code = F.lower(given(text)), error_code(text)
    has = lambda *words: keyword_count(low, words) == len(words)
    return (
        F.when(code.isin(401, 403) | has("无效的令牌") | has("invalid", "token"), "auth")
        .when((code == 429) | has("rate", "limit") | has("too many requests") | has("限流"), "rate_limit")
        .when(code >= 500, "upstream")
        .otherwise("unknown")
    )


def mask_sensitive(text: Column, masks: Sequence[tuple[str, str]] = MASKS) -> Column:
    for pattern, by in masks:
        text = replaced(text, pattern, by)
    return text


def char_ngrams(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams of the text without white space; a shorter text is its own."""
    bare = without_space(text)
    grams = F.array_distinct(F.regexp_extract_all(bare, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1)))
    return F.when(bare == "", F.array().cast("array<string>")).when(F.length(bare) < n, F.array(bare)).otherwise(grams)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a's distinct n-grams that b has; 0 for no n-grams."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def sentences(text: Column) -> Column:
    """Sentences with their end mark, trimmed; the whole text if there is none."""
    found = F.regexp_extract_all(given(text), F.lit("[^。！？!?；;\n]+[。！？!?；;\n]?"), F.lit(0))
    clean = F.filter(F.transform(found, strip), lambda s: s != "")
    return F.when(F.size(clean) > 0, clean).otherwise(F.array(given(text)))


def claim_sentences(text: Column, least: int = 8, ends: str = "[。！？；\n]+") -> Column:
    parts = F.transform(F.split(given(text), ends), strip)
    return F.filter(parts, lambda s: F.length(s) >= least)


def heading_flag(line: Column, char_class: str = HAN, pattern: str = r"^\d+(?:\.\d+){1,3}\s+\S+", most: int = 80, digits: float = 0.45) -> Column:
    share = F.regexp_count(line, F.lit(r"\d")) / F.greatest(F.length(line), F.lit(1))
    return matches(line, pattern) & matches(line, char_class) & (F.length(line) <= most) & (share < digits)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def safe_name(name: Column) -> Column:
    return F.coalesce(F.nullif(strip(replaced(given(name), r"""[<>:"/\\|?*]""", "_")), F.lit("")), F.lit("unnamed"))

# What marks an answer in a sentence, as (pattern, groups), and units of numbers.
UNITS = "[%％]|种|个|条|项|米|m|吨|年|月|日|天|小时|人|元|km|公里|平方公里|左右|以上|以下"
ANCHORS = (
    (r"(?:包括|分为|主要是|主要有|适用于|适合于|属于|由|依据|根据|表现为|意味着|称为|是指)([^。；\n，,]{2,20})", 1),
    (r"([^。；\n，,]{2,16})(?:是|为|属于|包括|分为|称为)([^。；\n，,]{2,20})", 2),
    (rf"(\d+(?:\.\d+)?(?:{UNITS})?)", 1),
    (r"([\x{4e00}-\x{9fff}]{2,12}(?:、[\x{4e00}-\x{9fff}]{2,12}){1,5})", 1),
)


# Phrases that are no answers.
STOP_PHRASES = ("方法", "技术", "步骤", "条件", "要求", "标准", "流程", "特点", "内容", "范围", "依据", "定义", "原理", "意义", "作用", "问题", "措施", "现状", "现象", "影响", "过程", "方案", "结果", "原因")


def answer_candidates(text: Column, anchors: Sequence[tuple[str, int]] = ANCHORS, ends: str = "。！？!?；;", delimiters: str = r"[、，,；;\s]+", listing: str = "、", number: str = rf"^\d+(?:\.\d+)?(?:{UNITS})?$", stop: Sequence[str] = STOP_PHRASES, edge: str = "的", limit: int = 8) -> Column:
    """Distinct answer candidates: numbers first, then lists, then other texts, each in order
    of first occurrence. Candidates come from the anchors and the parts between delimiters."""
    found = F.regexp_extract_all(given(text), F.lit(f"[^{ends}]+[{ends}]?"), F.lit(0))
    clean_sentences = F.filter(F.transform(found, strip), lambda s: s != "")

    def of_sentence(s: Column) -> Column:
        sources = []
        for pattern, groups in anchors:
            each = [F.regexp_extract_all(s, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
            sources.append(each[0] if groups == 1 else F.flatten(F.zip_with(each[0], each[1], lambda a, b: F.array(a, b))))
        parts = F.filter(F.transform(F.split(s, delimiters), clean_candidate), lambda p: F.length(p).between(2, 12))
        return F.concat(*sources, parts)

    cleaned = F.transform(F.flatten(F.transform(clean_sentences, of_sentence)), clean_candidate)

    def usable(c: Column) -> Column:
        ok = F.length(c).between(2, 18) & ~F.startswith(c, F.lit(edge)) & ~F.endswith(c, F.lit(edge))
        return ok & ~c.isin(*stop) if stop else ok

    kind = lambda c: F.when(matches(c, number), 0).when(F.contains(c, F.lit(listing)), 1).otherwise(2)

    def ordered(all_: Column) -> Column:
        """all_ has struct(kind, text), the kind found once."""
        of = lambda k: F.filter(all_, lambda c: c["kind"] == k)
        return F.transform(F.slice(F.concat(of(0), of(1), of(2)), 1, limit), lambda c: c["text"])

    kinds = F.transform(F.array_distinct(F.filter(cleaned, usable)), lambda c: F.struct(kind(c).alias("kind"), c.alias("text")))
    return F.transform(F.array(kinds), ordered)[0]
