"""Retrieval for whole batches of questions: dense, sparse and hybrid top-k and what follows.

Rankings are windows with `rank <= k` right above them, so that Spark prunes each partition
to its best k rows before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.sparse import WORDS, words
from tessera.shared import staged


def ranked(rows: DataFrame, k: int | Column, score: str = "score", by: str = "query_id", tie: str = "id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Distinct terms whose counts are broadcast to all rows at most.
BROADCAST_TERMS = 500_000


def term_weights(docs: DataFrame, id_column: str = "doc_id", pattern: str = WORDS) -> DataFrame:
    """id, term, tf: counts of lower-cased words, in long form.

    Texts are dealt by id before they are cut, so that neither the counts nor windows over
    an id shuffle a row per word; to a given number of parts, as small texts make many words.
    """
    spark = docs.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col(id_column).alias("id"), "text").repartition(parts, "id")
    found = texts.select("id", F.explode(words(F.col("text"), pattern)).alias("term"))
    return found.groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_counts(tf: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """term, df: in how many documents each term stands; up to `most` terms are marked for a broadcast."""
    df = staged(tf.groupBy("term").agg(F.count("*").alias("df")), "df")
    return F.broadcast(df) if df.count() <= most else df


def tf_idf(tf: DataFrame, n_docs: DataFrame, keep: tuple[str, ...] = (), most: int = BROADCAST_TERMS) -> DataFrame:
    """id, term, weight = tf * ln(1 + n / df), and the columns of tf in `keep`. n_docs is one row with n."""
    weighted = tf.join(document_counts(tf, most), "term").crossJoin(F.broadcast(n_docs))  # one row
    return weighted.select("id", "term", (F.col("tf") * F.log1p(F.col("n") / F.col("df"))).alias("weight"), *keep)


def sparse_prune(weights: DataFrame, share: float = 0.2) -> DataFrame:
    """Without the smallest share of each row's weights."""
    w = Window.partitionBy("id").orderBy("weight", "term")
    placed = weights.withColumns({"p": F.percent_rank().over(w), "n": F.count("*").over(Window.partitionBy("id"))})
    return placed.filter((F.col("p") >= share) | (F.col("n") == 1)).drop("p", "n")


def fused(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = 1.0, sparse_weight: float = 0.7, norm: str = "none") -> DataFrame:
    """The k best per query by the weighted sum of both legs, each of which may miss a row."""
    scaled = (lambda c: F.atan(c) * (2 / 3.141592653589793)) if norm == "atan" else (lambda c: c)
    d = dense.select("query_id", "id", scaled(F.col("score")).alias("d"))
    s = sparse.select("query_id", "id", scaled(F.col("score")).alias("s"))
    both = d.join(s, ["query_id", "id"], "full")
    score = F.coalesce("d", F.lit(0.0)) * dense_weight + F.coalesce("s", F.lit(0.0)) * sparse_weight
    return ranked(both.select("query_id", "id", score.alias("score")), k)


def parent_dedup(hits: DataFrame, text: str = "text") -> DataFrame:
    """The first hit of each distinct parent text per query; blank texts go. hits has query_id, rank."""
    w = Window.partitionBy("query_id", F.md5(text)).orderBy("rank")
    return hits.filter(tx.strip(tx.given(F.col(text))) != "").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rerank(hits: DataFrame, score: Column, m: int) -> DataFrame:
    return ranked(hits.withColumn("score", score), m)


def subquery_merge(hits: DataFrame, m: int) -> DataFrame:
    """Hits of all sub-queries of a question, one per text: the place of the first, the values
    of the last; cut to m. hits has query_id, pos, id, text, score."""
    merged = hits.groupBy("query_id", F.md5("text").alias("text_md5")).agg(F.min("pos").alias("pos"), F.max_by("id", "pos").alias("id"), F.max_by("score", "pos").alias("score"))
    w = Window.partitionBy("query_id").orderBy("pos")
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= m)


def matched_children(hits: DataFrame, most: int = 3) -> DataFrame:
    """query_id, parent_id, children: the first hits of each parent, in order."""
    w = Window.partitionBy("query_id", "parent_id").orderBy("rank")
    first = hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    children = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"])
    return first.groupBy("query_id", "parent_id").agg(children.alias("children"), F.min("rank").alias("rank"))


def context_of(hits: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    """query_id, context: the texts of a query's hits in rank order, blanks dropped."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", text))), lambda s: s[text])
    return hits.filter(F.coalesce(text, F.lit("")) != "").groupBy("query_id").agg(F.array_join(ordered, separator).alias("context"))


def citation_text(sources: DataFrame) -> DataFrame:
    """query_id, citations: numbered references; parts that are null are skipped, and the
    source stands where there is no part. sources has query_id, ref_id, title, page, section,
    paragraph, source."""
    page = F.concat(F.lit("p."), F.col("page").cast("string"))
    paragraph = F.concat(F.lit("段落"), F.col("paragraph").cast("string"))
    where = F.concat_ws("，", F.nullif(F.col("title"), F.lit("")), page, F.nullif(F.col("section"), F.lit("")), paragraph)
    line = F.concat(F.lit("["), F.col("ref_id").cast("string"), F.lit("] "), F.coalesce(F.nullif(where, F.lit("")), "source", F.lit("unknown")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ref_id", line.alias("line")))), lambda s: s["line"])
    return sources.groupBy("query_id").agg(F.array_join(ordered, "\n").alias("citations"))


def file_label(name: Column, path: Column, source: Column) -> Column:
    """The file's name; else its path's last part; else a name made of the source."""
    given = F.coalesce(F.nullif(name, F.lit("")), F.nullif(tx.base_name(path), F.lit("")))
    return F.coalesce(given, F.concat(source, F.lit("_未命名文档")))


def kb_overview(chunks: DataFrame) -> DataFrame:
    """The overview of a chunk table: level, name, source, file_id, chunks, ratio, can_delete,
    and on the row of the total files, sources and average (chunks of a file); what a level
    doesn't have is empty, false or zero.

    chunks has source, file_name, file_path, file_id, pos. A file's source and id are those of
    its first chunk; a file without an id can't be deleted. An empty table has one row of zeros.
    """
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    rows = chunks.select(source.alias("source"), F.coalesce("file_id", F.lit("")).alias("file_id"), "pos", "file_name", "file_path")
    rows = rows.withColumn("file", file_label(F.col("file_name"), F.col("file_path"), F.col("source")))
    # a row per file and source carries everything; the levels are aggregates of it
    first = F.min(F.struct("pos", "file_id"))
    parts = rows.groupBy("file", "source").agg(F.count("*").alias("n"), first.alias("first"))
    files = parts.groupBy("file").agg(F.sum("n").alias("n"), F.min(F.struct("first.pos", "source", "first.file_id")).alias("first"))
    sources = parts.groupBy("source").agg(F.sum("n").alias("n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.countDistinct("file").alias("files"), F.countDistinct("source").alias("sources"))
    empty = {"long": 0, "double": 0.0, "boolean": False, "string": ""}
    none = lambda kind, *names: [F.lit(empty[kind]).cast(kind).alias(n) for n in names]
    ratio = F.round(F.col("n") / F.col("all"), 4).alias("ratio")
    of_file = files.crossJoin(F.broadcast(total.select("all"))).select(  # one row
        F.lit("file").alias("level"), F.col("file").alias("name"), "first.source", "first.file_id", F.col("n").alias("chunks"), ratio, (F.col("first.file_id") != "").alias("can_delete"), *none("long", "files", "sources"), *none("double", "average")
    )
    of_source = sources.crossJoin(F.broadcast(total.select("all"))).select(  # one row
        F.lit("source").alias("level"), F.col("source").alias("name"), "source", *none("string", "file_id"), F.col("n").alias("chunks"), ratio, *none("boolean", "can_delete"), *none("long", "files", "sources"), *none("double", "average")
    )
    average = F.coalesce(F.round(F.col("all") / F.nullif("files", F.lit(0)), 1), F.lit(0.0)).alias("average")
    whole = F.when(F.col("all") > 0, 1.0).otherwise(0.0).alias("ratio")
    of_all = total.select(F.lit("total").alias("level"), *none("string", "name", "source", "file_id"), F.col("all").alias("chunks"), whole, *none("boolean", "can_delete"), "files", "sources", average)
    return of_all.unionByName(of_source).unionByName(of_file)


def export_statistics(hits: DataFrame) -> DataFrame:
    """level, name, n: how many hits there are, and how many of each source and each file.

    hits has source, file; null sources are `unknown`, null files `N/A`.
    """
    rows = hits.select(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("file", F.lit("N/A")).alias("file"))
    by = lambda c: rows.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(c).alias("level"), "name", "n")
    one = rows.agg(F.count("*").alias("total_docs"), F.countDistinct("source").alias("unique_sources"), F.countDistinct("file").alias("unique_files"))
    names = ("total_docs", "unique_sources", "unique_files")
    totals = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in names])).alias("t"))
    return totals.select(F.lit("total").alias("level"), "t.name", "t.n").unionByName(by("source")).unionByName(by("file"))
