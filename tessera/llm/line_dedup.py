"""Line dedup: lines that several documents hold stay in one of them only.

Lines are exploded, normalised and hashed; documents are counted per hash; the lines of
hashes over the threshold go, and each text is put together again by position. What is
shuffled per line is two 64-bit hashes, the id, a version of the text and the position;
texts are shuffled once, with the positions that they lose. All steps are DataFrame
operations. A line that a third of all documents hold is folded before the shuffle when it
is counted; the table of shared hashes is written, so the join with it is a broadcast where
its files are small and else one that adaptive execution splits at hot hashes.

Defined results: a null or empty text is one empty line; rows that share a doc_id are one
document, whose texts all keep the lines that the document keeps; rows without an id are
one document that comes after all others; repeated rows give equal results; a line of any
length counts whole; extra columns are passed on, and the added ones replace columns of
their names; an empty table gives no rows. Lines are told apart by 128 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, free_name, staged, text_or_empty, unstage

#: Documents that hold a line at least, and code points of its key at least, for it to go.
LEAST_DOCUMENTS = 2
SHORTEST = 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, version, place, one, two: each line with a key of `shortest` code points or more.

    version tells the texts of rows apart that share an id.
    """
    text = text_or_empty()
    # hashed before the lines are exploded, else the whole text would be hashed for each of them
    whole = docs.select("doc_id", F.xxhash64(text).alias("version"), _lines(text).alias("parts"))
    lines = whole.select("doc_id", "version", F.posexplode("parts").alias("place", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= shortest)
    return keyed.select("doc_id", "version", "place", F.xxhash64("key").alias("one"), F.xxhash64(F.lit(len(BLANKS)), "key").alias("two"))


def shared_lines(lines: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """one, two, keep_id: the hashes that at least `least` documents hold, and the first of these."""
    nameless = F.max(F.col("doc_id").isNull()).alias("nameless")
    if least == 2:  # two documents differ where the smallest and the largest id do
        held = lines.groupBy("one", "two").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last"), nameless)
        many = (F.col("keep_id") < F.col("last")) | (F.col("nameless") & F.col("keep_id").isNotNull())
    else:
        held = lines.groupBy("one", "two").agg(F.min("doc_id").alias("keep_id"), F.count_distinct("doc_id").alias("last"), nameless)
        many = F.col("last") + F.col("nameless").cast("int") >= least
    return held.filter(many).select("one", "two", "keep_id")


def drop_repeated_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, shortest: int = SHORTEST) -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept_text."""
    lines = staged(hashed_lines(docs, shortest), "lines")
    shared = staged(shared_lines(lines, least), "shared")
    lost = lines.join(shared, ["one", "two"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    version, lost_places = free_name(docs, "line_version"), free_name(docs, "lost_places")
    lost = staged(lost.groupBy("doc_id", "version").agg(F.collect_set("place").alias(lost_places)), "lost")
    unstage(lines)
    unstage(shared)

    rows = docs.withColumn(version, F.xxhash64(text_or_empty()))
    same = rows["doc_id"].eqNullSafe(lost["doc_id"]) & (rows[version] == lost["version"])
    rows = rows.join(lost, same, "left").select(rows["*"], lost[lost_places])
    found, n = _lines(text_or_empty()), F.size(_lines(text_or_empty()))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col(lost_places))
    # the split text is bound to a name, else it would be split again for each line
    kept = F.get(F.transform(F.array(found), lambda parts: F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")), F.lit(0))
    added = {
        "n_lines": n.cast("long"),
        "n_dropped": F.coalesce(F.size(lost_places), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col(lost_places).isNull(), text_or_empty()).otherwise(kept),
    }
    others = [c for c in docs.columns if c.lower() not in added]
    return rows.select(*others, *[value.alias(name) for name, value in added.items()])
