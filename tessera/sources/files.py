"""File sources and sinks: text corpora, manifests, JSON lines, JSON arrays, sessions, CSV."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx

# Loaders and format groups by extension.
PRIMARY = {".txt": "text", ".pdf": "pdf", ".docx": "doc", ".ppt": "ppt", ".pptx": "ppt", ".jpg": "image", ".jpeg": "image", ".png": "image", ".webp": "image", ".bmp": "image", ".gif": "image", ".md": "markdown"}
FALLBACK = (".doc", ".rtf", ".odt", ".html", ".htm", ".xlsx", ".xls", ".csv", ".epub")
FORMATS = {".pdf": "pdf", ".doc": "doc", ".docx": "doc", ".ppt": "ppt", ".pptx": "ppt", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".bmp": "image", ".gif": "image", ".txt": "text", ".md": "markdown"}
UPLOAD = r"^([0-9a-fA-F]{8,})__(.+)$"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


#: What ends a document in a file of many, what stands for it and for itself inside documents.
RECORD, ESCAPE = "\u0003", "\u0010"


def write_corpus(rows: DataFrame, path: str) -> None:
    """Texts as files below path, one folder per value of `folder`; rows has text, folder.

    Each task writes the texts of a folder to one file, each text ended by RECORD: a file per
    document would cost some ten milliseconds each, and its entry in the driver's list.
    """
    escaped = F.replace(F.replace("text", F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(RECORD), F.lit(ESCAPE + "3"))
    rows.select(escaped.alias("value"), "folder").write.partitionBy("folder").option("lineSep", RECORD).text(path)


def corpus_scan(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """One row per text file below path: file_path, file_name, source, text. The source is the
    folder's name without _data; OCR caches are skipped. Files of write_corpus are packed: they
    give one row per document, and large ones are read by several tasks."""
    reader = spark.read.option("recursiveFileLookup", True)
    files = reader.text(path, lineSep=RECORD) if packed else reader.text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    text = F.col("value")
    if packed:
        text = F.replace(F.replace(text, F.lit(ESCAPE + "3"), F.lit(RECORD)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))
    rows = files.select(where.alias("file_path"), tx.base_name(where).alias("file_name"), F.regexp_extract(where, r"([^/]+)/[^/]*$", 1).alias("folder"), text.alias("text"))
    return rows.filter(~F.endswith("file_name", F.lit(".ocr_cache.json"))).withColumn("source", F.regexp_replace("folder", "_data$", "")).drop("folder")


def file_manifest(spark: SparkSession, path: str, origin: str) -> DataFrame:
    """One row per file below path with its size and format, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    extension = tx.file_extension(F.col("path"))
    return files.select(F.lit(origin).alias("origin"), F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("source"), format_group(extension).alias("format_group"), extension.alias("extension"), tx.base_name(F.col("path")).alias("file_name"), F.col("length").alias("size_bytes"))


def loader(extension: Column) -> Column:
    """primary loader name, `fallback`, or `unsupported`."""
    return F.coalesce(lookup(PRIMARY, extension), F.when(extension.isin(*FALLBACK), "fallback"), F.lit("unsupported"))


def format_group(extension: Column) -> Column:
    return F.coalesce(lookup(FORMATS, extension), F.lit("other"))


def upload_name(name: Column) -> tuple[Column, Column]:
    """(upload id or empty, original name)."""
    upload = F.regexp_extract(name, UPLOAD, 1)
    return upload, F.when(upload != "", F.regexp_extract(name, UPLOAD, 2)).otherwise(name)


def page_text(html: Column) -> Column:
    """Plain text of a page: scripts, styles and tags go, common entities are decoded."""
    text = tx.replaced(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = tx.replaced(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(tx.replaced(text, r"[ \t\n\r]+", " "))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_lines_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of JSON lines: each line is in one of the two.

    The quarantine has file_path, line, reason of the lines that don't parse.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))
    parsed = lines.withColumn("_r", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    whole = F.coalesce(F.col("_r").isNotNull() & F.col("_r._corrupt").isNull(), F.lit(False))
    broken = parsed.filter(~whole).select("file_path", "line", F.lit("does not parse").alias("reason"))
    return parsed.filter(whole).select("_r.*").drop("_corrupt"), broken


def loadable(rows: DataFrame, extension: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with their loader, rows that no loader takes with the reason)."""
    found = rows.withColumn("loader", loader(extension))
    missing = F.concat(F.lit("no loader for "), F.coalesce(F.nullif(extension, F.lit("")), F.lit("a name without extension")))
    return found.filter("loader <> 'unsupported'"), found.filter("loader = 'unsupported'").drop("loader").withColumn("reason", missing)


def read_json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file arrays of objects, one row per object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_arrays(df: DataFrame, path: str, key: str, size: int = 10_000) -> None:
    """Files of one array each, of about `size` rows that a hash of the key deals out.

    A reader of whole files takes one value per file, so no file holds two arrays.
    """
    files = max(1, ceil(df.count() / size))
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("p"), F.struct(*df.columns).alias("r"))
    arrays = rows.groupBy("p").agg(F.to_json(F.collect_list("r")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """session_id, turn_ix, question, answer from whole files of one session or an array of
    sessions; files that don't parse are dropped."""
    schema = "session_id string, history array<struct<question: string, answer: string, timestamp: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.select("session_id", F.posexplode("history").alias("turn_ix", "t")).select("session_id", "turn_ix", "t.question", "t.answer")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
