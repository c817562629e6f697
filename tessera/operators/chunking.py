"""Splitting documents into chunks with array functions: no Python workers, no shuffles.

Splitters take a text Column and give an array<string> Column; a document is split inside
its task, so cost is bounded by document length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ranks import group_rank

# Separators from coarse to fine, as regular expressions; an empty one cuts
# between any two characters.
PROSE = ("\n\n", "\n", "。|！|？", r"\.\s|\!\s|\?\s", r"；|;\s", r"，|,\s")
MARKDOWN = ("\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", "")
PARENT, CHILD, OVERLAP = 1200, 300, 50
_CUT = "\u0001"


def _pieces(text: Column, separator: str) -> Column:
    """The text cut behind each separator; empty pieces left out."""
    marked = F.regexp_replace(text, F.lit(f"({separator})"), F.lit("$1" + _CUT))
    return F.filter(F.split(marked, _CUT), lambda p: p != "")


def _state(out: Column, open_: Column, size: Column) -> Column:
    return F.struct(out.alias("out"), open_.alias("open"), size.alias("size"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _strings() -> Column:
    return F.array().cast("array<string>")


def _closed(state: Column) -> Column:
    """The finished chunks with the open pieces joined to one more."""
    return F.when(F.size(state["open"]) > 0, F.array_append(state["out"], F.array_join(state["open"], ""))).otherwise(state["out"])


def _tail(pieces: Column, room: Column) -> Column:
    """The longest run of last pieces that fits into room: struct(keep, size)."""
    start = F.struct(F.lit(0).alias("keep"), F.lit(0).alias("size"), F.lit(False).alias("full"))

    def step(s: Column, p: Column) -> Column:
        full = s["full"] | (s["size"] + F.length(p) > room)
        return F.struct(
            F.when(full, s["keep"]).otherwise(s["keep"] + 1).alias("keep"),
            F.when(full, s["size"]).otherwise(s["size"] + F.length(p)).alias("size"),
            full.alias("full"),
        )

    return F.aggregate(F.reverse(pieces), start, step)


def _merge(state: Column, piece: Column, size: int, overlap: int) -> Column:
    """One piece of less than size characters enters the open chunk, or opens the next one.
    What is kept of the old chunk is looked for only where the piece doesn't fit."""
    length = F.length(piece)

    def next_chunk(tail: Column) -> Column:
        kept = F.slice(state["open"], F.size(state["open"]) - tail["keep"] + 1, tail["keep"])
        return _state(_closed(state), F.array_append(kept, piece), tail["size"] + length)

    fits = (state["size"] + length <= size) | (F.size(state["open"]) == 0)
    grown = _state(state["out"], F.array_append(state["open"], piece), state["size"] + length)
    return F.when(fits, grown).otherwise(let(_tail(state["open"], F.least(F.lit(overlap), F.lit(size) - length)), next_chunk))


def _split(text: Column, separators: Sequence[str], size: int, overlap: int) -> Column:
    """A separator that doesn't occur leaves one piece, so trying all levels in order takes
    the first that occurs; each level stands once inside the level before."""
    if not separators:
        return F.array(text)
    if separators[0] == "":  # what merging single characters gives
        step = max(1, size - overlap)
        last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    deeper = lambda piece: _split(piece, separators[1:], size, overlap)

    def step(state: Column, piece: Column) -> Column:
        long = _state(F.concat(_closed(state), deeper(piece)), _strings(), F.lit(0))
        return F.when(F.length(piece) < size, _merge(state, piece, size, overlap)).otherwise(long)

    return F.aggregate(_pieces(text, separators[0]), _state(_strings(), _strings(), F.lit(0)), step, _closed)


def recursive_chunks(text: Column, size: int = PARENT, overlap: int = OVERLAP, separators: Sequence[str] = PROSE) -> Column:
    chunks = F.transform(_split(tx.given(text), separators, size, overlap), lambda c: tx.replaced(tx.strip(c), "\n{2,}", "\n"))
    return F.filter(chunks, lambda c: c != "")


def markdown_chunks(text: Column, size: int = PARENT, overlap: int = OVERLAP) -> Column:
    return recursive_chunks(text, size, overlap, MARKDOWN)


def parent_chunks(docs: DataFrame, text: str = "text", size: int = PARENT, overlap: int = OVERLAP, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    return docs.select(*keep, F.posexplode(recursive_chunks(F.col(text), size, overlap)).alias("parent_ix", "parent"))


def child_chunks(parents: DataFrame, size: int = CHILD, overlap: int = OVERLAP, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Chunks of each parent with an id; the parent's text stays in its own table."""
    rows = parents.select(*keep, "parent_ix", F.posexplode(recursive_chunks(F.col("parent"), size, overlap)).alias("child_ix", "text"))
    return rows.withColumn("id", F.format_string("child_doc_%d_parent_%d_child_%d", "doc_id", "parent_ix", "child_ix"))


# Larger blocks for entity extraction.
GRAPH_PARENT, GRAPH_CHILD, GRAPH_OVERLAP = 1600, 500, 100


def graph_blocks(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep, parent_ix, child_ix, id, role, text: the blocks that entities are extracted from."""
    parents = parent_chunks(docs, text, GRAPH_PARENT, GRAPH_OVERLAP, keep)
    return child_chunks(parents, GRAPH_CHILD, GRAPH_OVERLAP, keep).withColumn("role", F.lit("graph"))


def structure_split(text: Column, least: int = 80) -> Column:
    """Paragraphs, each merged with the next while it is shorter than `least`."""
    parts = F.filter(F.transform(F.split(tx.given(text), "\n\\s*\n+"), tx.strip), lambda p: p != "")
    start = F.struct(_strings().alias("out"), F.lit("").alias("buffer"))

    def step(s: Column, part: Column) -> Column:
        joined = F.when(s["buffer"] == "", part).otherwise(F.concat(s["buffer"], F.lit("\n"), part))
        return F.when(F.length(s["buffer"]) < least, F.struct(s["out"].alias("out"), joined.alias("buffer"))).otherwise(F.struct(F.array_append(s["out"], s["buffer"]).alias("out"), part.alias("buffer")))

    return F.aggregate(parts, start, step, lambda s: F.when(s["buffer"] == "", s["out"]).otherwise(F.array_append(s["out"], s["buffer"])))


def term_vector(sentence: Column, width: int = 16) -> Column:
    """A sentence's counts of hashed words: the vectors used where no model's are given.

    Each word becomes the letter of its slot; a slot's count is what the string of letters
    loses without that letter.
    """
    letters = "".join(chr(65 + i) for i in range(width))
    words = F.filter(F.split(F.lower(sentence), r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.substring(F.lit(letters), (F.pmod(F.crc32(w.cast("binary")), F.lit(width)) + 1).cast("int"), F.lit(1)))
    count = lambda s, letter: (F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))).cast("double")
    return let(F.array_join(slots, ""), lambda s: F.array(*[count(s, letter) for letter in letters]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def _unlike(a: Column, b: Column, similar: float) -> Column:
    """Whether the cosine of two (vec, norm) is below similar; that of a zero vector is 0."""
    return F.coalesce(dot(a["vec"], b["vec"]) / F.nullif(a["norm"] * b["norm"], F.lit(0.0)), F.lit(0.0)) < similar


def semantic_break_chunks(pieces: Column, similar: float = 0.74, least: int = 220, most: int = 520) -> Column:
    """Joins array<struct(sentence, vec, norm)>: a new chunk starts where neighbours are unlike and
    the chunk is long enough, or where it would be too long."""

    def step(s: Column, p: Column) -> Column:
        length = F.length(p["sentence"])
        breaks = (s["size"] + length > most) | ((s["size"] >= least) & _unlike(s["last"], p, similar))
        closed = F.struct(F.array_append(s["out"], tx.strip(s["open"])).alias("out"), p["sentence"].alias("open"), length.alias("size"), p.alias("last"))
        grown = F.struct(s["out"].alias("out"), F.concat(s["open"], p["sentence"]).alias("open"), (s["size"] + length).alias("size"), p.alias("last"))
        return F.when(breaks, closed).otherwise(grown)

    def joined(all_: Column) -> Column:
        first = all_[0]
        start = F.struct(_strings().alias("out"), first["sentence"].alias("open"), F.length(first["sentence"]).alias("size"), first.alias("last"))
        rest = F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0)))
        return F.when(F.size(all_) > 0, F.aggregate(rest, start, step, lambda s: F.array_append(s["out"], tx.strip(s["open"])))).otherwise(_strings())

    return let(pieces, joined)


def with_vectors(sentences: Column, width: int = 16) -> Column:
    return F.transform(sentences, lambda s: let(term_vector(s, width), lambda v: F.struct(s.alias("sentence"), v.alias("vec"), F.sqrt(dot(v, v)).alias("norm"))))


def chunk_overlap_prefix(chunks: Column, overlap: int = OVERLAP) -> Column:
    """Each chunk headed by the last characters of its already headed predecessor."""

    def step(s: Column, c: Column) -> Column:
        head = F.when(F.length(s["last"]) > overlap, F.substring(s["last"], -overlap, overlap)).otherwise(s["last"])
        text = F.concat(head, c)
        return F.struct(F.array_append(s["out"], text).alias("out"), text.alias("last"))

    return F.aggregate(chunks, F.struct(_strings().alias("out"), F.lit("").alias("last")), step, lambda s: s["out"])


def hybrid_chunks(docs: DataFrame, most: int = 520, overlap: int = OVERLAP, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Structure, then semantic breaks of long paragraphs, then the recursive splitter for
    what is still too long; ends with the overlap. All inside the row: no shuffle, and rows
    with equal ids stay apart."""
    parts = F.transform(structure_split(F.col("text")), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(semantic_break_chunks(with_vectors(tx.sentences(p)), most=most)))
    cut = F.transform(F.flatten(parts), lambda i: F.when(F.length(i) <= most, F.array(i)).otherwise(recursive_chunks(i, most, 0)))
    clean = F.filter(F.transform(F.flatten(cut), lambda c: tx.strip(tx.collapse_newlines(c))), lambda c: c != "")
    return docs.select(*keep, F.posexplode(chunk_overlap_prefix(clean, overlap)).alias("chunk_ix", "text"))


def window_chunks(text: Column, size: int = 300, step: int = 250) -> Column:
    """Windows of `size` characters every `step`, the last one reaching the end; trimmed."""
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: tx.strip(F.substring(text, i * step + 1, F.lit(size))))
    return F.filter(cut, lambda c: c != "")


def _after_headings(lines: Column, marked: Column, body) -> Column:
    """body(number of the heading from 0, its place, the place of the next one or the end) for each line that is marked."""
    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(marked, i))
    return let(places, lambda at: F.transform(at, lambda p, j: body(j, p, F.coalesce(F.get(at, j + 1), F.size(lines)))))


def sections(docs: DataFrame, is_heading: Callable[[Column], Column], least: int = 40) -> DataFrame:
    """doc_id, section_ix, title, text: the lines from each heading to the next.

    Lines before the first heading belong to no section; a document without a section of
    `least` characters is one section of its own. is_heading tells of a line without white
    space at its ends. Everything happens inside the row: equal and null ids stay apart.
    """

    def found(raws: Column) -> Column:
        bare = F.transform(raws, tx.strip)
        marked = let(bare, lambda lines: F.transform(lines, lambda line: (line != "") & is_heading(line)))
        text = lambda p, end: tx.strip(F.array_join(F.slice(raws, p + 1, end - p), "\n"))
        section = lambda j, p, end: F.struct((j + 1).alias("section_ix"), tx.strip(F.get(raws, p)).alias("title"), text(p, end).alias("text"))
        return F.filter(let(marked, lambda m: _after_headings(raws, m, section)), lambda s: F.length(s["text"]) >= least)

    whole = F.array(F.struct(F.lit(0).alias("section_ix"), F.lit("全文").alias("title"), tx.strip(F.col("text")).alias("text")))
    own = let(F.split(tx.given(F.col("text")), "\n"), found)
    return docs.select("doc_id", F.inline(let(own, lambda parts: F.when(F.size(parts) > 0, parts).otherwise(whole))))


def chapter_map(docs: DataFrame, heading: str = r"^\d+[\.\d]*\s+\S") -> DataFrame:
    """doc_id, title, content: what follows each heading line; of equal titles the last.

    Everything happens inside the row: equal and null ids stay apart.
    """

    def found(lines: Column) -> Column:
        marked = F.transform(lines, lambda line: tx.matches(line, heading))
        content = lambda p, end: tx.strip(F.array_join(F.slice(lines, p + 2, end - p - 1), "\n"))
        chapter = lambda j, p, end: F.struct(tx.strip(F.get(lines, p)).alias("title"), j.alias("j"), content(p, end).alias("content"))
        by_title = F.sort_array(let(marked, lambda m: _after_headings(lines, m, chapter)))
        return let(by_title, lambda all_: F.filter(all_, lambda c, i: ~c["title"].eqNullSafe(F.get(all_, i + 1)["title"])))

    chapters = docs.select("doc_id", F.inline(let(F.split(tx.given(F.col("text")), "\n"), found)))
    return chapters.select("doc_id", "title", "content")


def evenly_pick(rows: DataFrame, group: str, order: str, n: int, bucket: int = 65_536) -> DataFrame:
    """n rows of each group, evenly spaced by position (ties of rounding to even); all rows of
    smaller groups, the middle one for n = 1. Places that two picks share are filled from
    the front. order is a whole number; its ranges of `bucket` values are numbered apart."""
    placed = group_rank(rows, group, F.floor(F.col(order) / bucket), order, name="_at", size="_all").withColumn("_ix", F.col("_at") - 1)
    if n == 1:
        return placed.filter(F.col("_ix") == F.floor(F.col("_all") / 2)).drop("_ix", "_at", "_all")
    step = (F.col("_all") - 1) / F.lit(float(n - 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * step).cast("long"))
    # the first n places of a group fill up what rounding leaves open
    picked = placed.withColumn("_hit", (F.col("_all") <= n) | F.array_contains(wanted, F.col("_ix"))).filter(F.col("_hit") | (F.col("_ix") < n))
    first = Window.partitionBy(group).orderBy(F.desc("_hit"), "_ix")
    return picked.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= n).drop("_ix", "_at", "_all", "_hit", "_k")


def context_windows(chunks: DataFrame, most: int = 5, bucket: int = 4_096) -> DataFrame:
    """source, anchor, window_type, n_chunks, text: the middle chunk of a file anchors a long
    window, even ones a window of two chunks, odd ones stand alone. chunks has source,
    chunk_ix, text, with chunk_ix a whole number, unique in a source.

    Positions are found on ids; texts are joined to them last.
    """
    ids = group_rank(chunks.select("source", "chunk_ix"), "source", F.floor(F.col("chunk_ix") / bucket), "chunk_ix", name="at", size="size")
    placed = ids.withColumn("pos", F.col("at") - 1)
    is_long = F.col("pos") == F.floor(F.col("size") / 2)
    long_end = F.least(F.col("size"), F.greatest(F.lit(0), F.col("pos") - 2) + most)
    start = F.when(is_long, F.greatest(F.lit(0), long_end - most)).otherwise(F.col("pos"))
    end = F.when(is_long, long_end).when(F.col("pos") % 2 == 0, F.least(F.col("size"), F.col("pos") + 2)).otherwise(F.col("pos") + 1)
    anchors = placed.select("source", F.col("pos").cast("int").alias("anchor"), F.when(is_long, "long").otherwise("short").alias("window_type"), F.explode(F.sequence(start, end - 1)).alias("pos"))
    places = anchors.join(placed.select("source", "pos", "chunk_ix"), ["source", "pos"])
    joined = places.join(chunks.select("source", "chunk_ix", "text"), ["source", "chunk_ix"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n\n")
    return joined.groupBy("source", "anchor", "window_type").agg(F.count("*").alias("n_chunks"), text.alias("text"))


def length_stats(chunks: DataFrame, *by: str, text: str = "text", short: int = 120) -> DataFrame:
    """Count, mean, median, p90 (the value at rank int(0.9 n)), bounds and share below short."""
    n = F.length(text)
    # value counts, not values, are what a group gathers: as many as there are lengths
    counted = chunks.groupBy(*by, n.alias("len")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    ranked = counted.withColumn("end", F.sum("c").over(w.orderBy("len"))).withColumn("n", F.sum("c").over(w))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9))
    middle = lambda rank: F.min(F.when(F.col("end") > rank, F.col("len")))
    return ranked.groupBy(*by).agg(
        F.max("n").alias("n_chunks"),
        (F.sum(F.col("len") * F.col("c")) / F.max("n")).alias("avg_len"),
        ((middle(F.floor((F.col("n") - 1) / 2)) + middle(F.floor(F.col("n") / 2))) / 2.0).alias("median_len"),
        middle(at).alias("p90_len"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        (F.sum(F.when(F.col("len") < short, F.col("c")).otherwise(0)) / F.max("n")).alias("short_share"),
    )
