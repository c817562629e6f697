"""Catalogues, caches and the chunk table's upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import group_rank


def cache_status(manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """manifest with status: missing, valid (size and time equal) or stale. Keyed by file_id."""
    known = cache.select("file_id", F.col("size_bytes").alias("c_size"), F.col("mtime").alias("c_mtime"))
    same = (F.col("c_size") == F.col("size_bytes")) & (F.col("c_mtime") == F.col("mtime"))
    status = F.when(F.col("c_size").isNull(), "missing").when(same, "valid").otherwise("stale")
    return manifest.join(known, "file_id", "left").withColumn("status", status).drop("c_size", "c_mtime")


def parsed_cache(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cache rows, corrupt rows) of rows with file_id, content, the JSON text of a cache file.

    The first have file_id, size_bytes, mtime; the others file_id, content. Each row is in one
    of the two: one that doesn't parse, or lacks its size or time, is corrupt.
    """
    fields = F.from_json("content", "file_size long, file_mtime long, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = rows.withColumn("_c", fields)
    whole = F.coalesce(F.col("_c._corrupt").isNull() & F.col("_c.file_size").isNotNull() & F.col("_c.file_mtime").isNotNull(), F.lit(False))
    good = parsed.filter(whole).select("file_id", F.col("_c.file_size").alias("size_bytes"), F.col("_c.file_mtime").alias("mtime"))
    return good, parsed.filter(~whole).select("file_id", "content")


def cache_gc(manifest: DataFrame, cache: DataFrame, corrupt: DataFrame | None = None, clean_all: bool = False) -> DataFrame:
    """file_id, reason of cache rows to delete: orphan, stale or corrupt; with clean_all all rows.

    corrupt has file_id of the caches that don't parse; one without its file is an orphan.
    """
    broken = corrupt.select("file_id") if corrupt is not None else cache.select("file_id").limit(0)
    known = cache.select("file_id").unionByName(broken)
    if clean_all:
        return known.select("file_id", F.lit("all").alias("reason"))
    orphan = known.join(manifest.select("file_id"), "file_id", "left_anti").select("file_id", F.lit("orphan").alias("reason"))
    stale = cache_status(manifest, cache).filter("status = 'stale'").select("file_id", F.lit("stale").alias("reason"))
    unread = broken.join(manifest.select("file_id"), "file_id", "left_semi").select("file_id", F.lit("corrupt").alias("reason"))
    return orphan.unionByName(stale).unionByName(unread)


def chunk_rows(rows: DataFrame, age: int) -> DataFrame:
    """id, text, source, pos, age of rows with text, source, pos: the id is the text's digest."""
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    return rows.select(F.md5("text").alias("id"), "text", source.alias("source"), "pos", F.lit(age).alias("age"))


def newest_chunks(rows: DataFrame) -> DataFrame:
    """Of each id the row of the largest age, then position. The surviving row is found on
    (id, age, pos) alone; texts are joined back."""
    last = rows.groupBy("id").agg(F.max(F.struct("age", "pos")).alias("last"))
    return rows.join(last.select("id", "last.age", "last.pos"), ["id", "age", "pos"])


def kb_upsert(base: DataFrame, batch: DataFrame) -> DataFrame:
    """The chunk table after a batch: the batch overwrites the base and later positions
    overwrite earlier ones. Both have text, source, pos."""
    return newest_chunks(chunk_rows(base, 0).unionByName(chunk_rows(batch, 1)))


def kb_delete_file(chunks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table without the files' chunks, a report per file). files has file_id."""
    gone = chunks.join(files.select("file_id").distinct(), "file_id", "left_semi")
    report = gone.groupBy("file_id").agg(F.count("*").alias("deleted"), F.countDistinct("path").alias("paths"))
    return chunks.join(files.select("file_id").distinct(), "file_id", "left_anti"), report


def ragas_parts(rows: DataFrame, by: str, key: str, bucket: Column, size: int = 1000) -> DataFrame:
    """Columnar records of at most `size` rows of a group: by, part, n, first and last key, the
    parallel arrays in key order, a digest of the questions.

    Parts of a group are in key order and all full but the last. bucket never falls along the
    key, as in group_rank.
    """
    placed = group_rank(rows, by, bucket, key, name="_at").withColumn("part", F.floor((F.col("_at") - 1) / size))
    ordered = F.sort_array(F.collect_list(F.struct("_at", key, "question", "answer", "contexts", "ground_truth")))
    column = lambda name: F.transform("r", lambda s: s[name]).alias(name)
    one = placed.groupBy(by, "part").agg(ordered.alias("r"), F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    columns = one.select(by, "part", "n", "first", "last", column("question"), column("answer"), column("contexts"), column("ground_truth"))
    return columns.withColumn("questions_md5", F.md5(F.array_join("question", "|")))


def ragas_means(rows: DataFrame, by: str) -> DataFrame:
    """by, level, questions, mean_contexts, mean_truth_chars of columnar records, per group and in total.

    Means have one decimal; null contexts count none, null truths no characters.
    """
    n = F.coalesce(F.when(F.col("contexts").isNotNull(), F.size("contexts")), F.lit(0))
    chars = F.length(F.coalesce("ground_truth", F.lit("")))
    level = F.when(F.grouping(by) == 1, "total").otherwise("group").alias("level")
    found = rows.rollup(by).agg(level, F.count("*").alias("questions"), F.round(F.avg(n), 1).alias("mean_contexts"), F.round(F.avg(chars), 1).alias("mean_truth_chars"))
    return found.select(by, "level", "questions", "mean_contexts", "mean_truth_chars")


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
