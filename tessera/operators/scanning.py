"""Looking for sensitive strings in texts and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.chunking import let

# What a scan of a folder reads and what it leaves out.
EXTENSIONS = (".py", ".md", ".ini", ".txt", ".json", ".yaml", ".yml")
SKIPPED_DIRS = (".git", "__pycache__", "node_modules", "models", "bert_results", "bert_strategy_results", ".idea", ".vscode")
SKIPPED_FILES = (".ocr_cache.json", "tokenizer_config.json")


def scannable(path: Column) -> Column:
    """Whether a scan reads the file: by its extension, its folders and the end of its name."""
    parts = F.split(path, "[/\\\\]")
    name = F.element_at(parts, -1)
    extension = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    skipped = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: d.isin(*SKIPPED_DIRS))
    ends = F.lit(False)
    for end in SKIPPED_FILES:
        ends = ends | F.endswith(name, F.lit(end))
    return extension.isin(*EXTENSIONS) & ~skipped & ~ends


def occurrences(text: Column, pattern: str, around: int) -> Column:
    """array<struct(start_at, hit, context)> of every match, in order; start_at counts from 1.

    The text is cut at the matches, so that lengths of the parts give each match its own
    place, also where it repeats. Line breaks in the context become spaces.
    """

    def located(parts: Column, hits: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, p: Column) -> Column:
            at = s["at"] + F.length(p["part"])
            return F.struct((at + F.length(p["hit"])).alias("at"), F.array_append(s["out"], at).alias("out"))

        pairs = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda part, hit: F.struct(part.alias("part"), hit.alias("hit")))
        places = F.aggregate(pairs, start, step, lambda s: s["out"])
        return F.zip_with(places, hits, lambda at, hit: F.struct(at.alias("start_at"), hit.alias("hit"), context(at, hit).alias("context")))

    def context(at: Column, hit: Column) -> Column:
        seen = F.substring(text, F.greatest(F.lit(1), at - around), F.least(F.lit(around), at - 1) + F.length(hit) + around)
        return F.translate(seen, "\n", " ")

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start_at:int,hit:string,context:string>>")
    return let(found, lambda hits: F.when(F.size(hits) == 0, none).otherwise(located(F.split(text, pattern, -1), hits)))


def scan(docs: DataFrame, patterns: Sequence[tuple[str, str]] = tx.SENSITIVE, text: str = "text", around: int = 50, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep, pattern, start_at, hit, context: one row per match, placeholders left out.

    Texts are read once and not carried along.
    """
    given = tx.given(F.col(text))
    per_pattern = F.array(*[F.struct(F.lit(name).alias("pattern"), occurrences(given, rx, around).alias("hits")) for name, rx in patterns])
    rows = docs.select(*keep, F.explode(per_pattern).alias("p")).select(*keep, "p.pattern", F.inline("p.hits"))
    return rows.filter(~F.contains("hit", F.lit("YOUR_")) & ~F.contains(F.lower("hit"), F.lit("your-")))


def scan_files(files: DataFrame, patterns: Sequence[tuple[str, str]] = tx.SENSITIVE, text: str = "text", around: int = 50, keep: Sequence[str] = ("path",)) -> DataFrame:
    """scan of the files that a folder's scan reads; files has path and the text."""
    return scan(files.filter(scannable(F.col("path"))), patterns, text, around, keep)
