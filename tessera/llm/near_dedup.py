"""Near-duplicate documents by min-max hashing.

A document's set are its distinct word shingles. Under each of K random permutations both
the minimum and the maximum of the set are kept, so K hash evaluations give 2K unbiased
values. Bands join the minima, or the maxima, of `rows` different permutations; documents
that share a band are candidates. With 20 groups of 6 permutations there are 40 bands: a
pair at the threshold 0.8 escapes all of them with probability 5e-6.

Documents with equal sets form a class with the smallest id as representative; only
representatives are compared. In a band's bucket, members are first paired with two hubs,
the smallest and the largest id, then with their neighbours in a random order, which is
linear in the bucket. Links are confirmed on full sets and joined to components, so a large
group of near copies becomes one component without giving all its pairs. What is left are
documents whose bucket still holds several components. Between them every link is found by
an exact prefix filter: with shingles ordered by rarity, two sets that overlap enough share
one of their first n - ceil(0.8 n) + 1 shingles, and enough shingles from there on. Only pairs across components are formed,
so no candidate link is lost.

Shingles are 64-bit hashes; at 10^5 shingles two of a document collide with probability
3e-10. Rows are told apart by a number, not by their id. Defined results: null and word-free
texts have the empty set, are linked with nothing, are their own component and are kept; the
component's id is the smallest that is not null; rows that repeat an id are compared each;
a row with a null id is kept if its component has no id at all and it is its first row;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import released, staged, unstage
from tessera.llm.components import components

GROUPS = 20
ROWS = 6
SEED = 7
#: Words whose hashes a task remembers, and the longest that it remembers.
CACHED_WORDS = 150_000
LONG_WORD = 64
#: Ratio of the sizes of neighbouring classes of sets.
CLASS = 1.05
#: Shingles hashed at once, so that a long document needs no more memory than a short one.
STRIP = 4_096


class WordHashes(dict):
    """word -> hash; long words are not remembered, so the number bounds the memory."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > CACHED_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(width, len(words))
    out = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - span + 1 + i])
    return np.unique(out)


def permutations(groups: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    a = draw.integers(0, 2**32, groups * rows, dtype=np.uint32) | np.uint32(1)
    return a, draw.integers(0, 2**32, groups * rows, dtype=np.uint32)


def bands(values: np.ndarray, a: np.ndarray, b: np.ndarray, groups: int, rows: int) -> np.ndarray:
    """2 * groups band hashes from minima and maxima."""
    low = np.full(groups * rows, 2**32 - 1, dtype=np.uint32)
    high = np.zeros(groups * rows, dtype=np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), STRIP):
        hashed = a[:, None] * short[None, i : i + STRIP] + b[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    both = np.concatenate([low.reshape(groups, rows), high.reshape(groups, rows)]).astype(np.uint64)
    out = np.arange(1, 2 * groups + 1, dtype=np.uint64)
    for column in both.T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def signatures(docs: DataFrame, row_column: str, width: int, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """row_key, doc_id, n_shingles, set_key (a digest of the set), bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(groups, rows)
        known = WordHashes()
        for batch in batches:
            sizes, keys, found = [], [], []
            for text in batch.column(2):
                values = shingles(text.as_py(), width, known)
                sizes.append(len(values))
                keys.append(set_key(values) if len(values) else None)
                found.append(bands(values, a, b, groups, rows) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["row_key", "doc_id", "n_shingles", "set_key", "bands"],
            )
        known.clear()
        released()

    plain = docs.select(F.col(row_column).cast("long").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "row_key long, doc_id long, n_shingles long, set_key binary, bands array<long>")


def set_key(values: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(values.tobytes())


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """set_key, shingles of the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingles(t.as_py(), width, known) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_key", "shingles"])
        known.clear()
        released()

    return texts.select("text").mapInArrow(run, "set_key binary, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.asarray(x.values), np.asarray(y.values)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct()


def _mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: band, id, n, component, size."""
    labelled = members.select("band", "id", "n").join(labels, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    return labelled.join(mixed.select("band", "size"), "band")


def _neighbours_in_buckets(mixed: DataFrame, near, orders: int = 1, most: int = 1_000) -> DataFrame:
    """(a, b) that follow each other in a random order of their bucket and lie in different
    components. Buckets above `most` members are dealt into parts of about that size."""
    found = []
    for order in range(orders):
        drawn = mixed.withColumn("draw", F.xxhash64("id", "band", F.lit(order))).withColumn("part", F.pmod("draw", F.ceil(F.col("size") / most)))
        w = Window.partitionBy("band", "part").orderBy("draw", "id")
        before = {f"{c}_2": F.lag(c).over(w) for c in ("id", "n", "component")}
        pairs = drawn.withColumns(before).filter((F.col("component") != F.col("component_2")) & near(F.col("n"), F.col("n_2")))
        found.append(pairs.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")))
    return found[0].union(found[1]).distinct() if orders == 2 else found[0].distinct()


def _prefix_pairs(still: DataFrame, sets: DataFrame, percent: int, near) -> DataFrame:
    """(a, b) of different components that share a shingle of their prefixes: a superset of
    all links between the documents of still."""
    posted = still.join(sets, "id").select("id", "n", "component", F.explode("shingles").alias("shingle"))
    counts = posted.groupBy("shingle").agg(F.count("*").alias("f"))
    rare = Window.partitionBy("id").orderBy("f", "shingle")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = staged(
        posted.join(counts.filter("f > 1"), "shingle", "left")
        .withColumn("f", F.coalesce("f", F.lit(1)))
        .withColumn("place", F.row_number().over(rare))
        .filter((F.col("place") <= length) & (F.col("f") > 1))
        .select("id", "n", "component", "shingle", "place"),
        "prefix",
    )
    # Partners are met by classes of their size. The larger the partner, the more it must share,
    # so a row looks for it with fewer of its first shingles; then no list of a common passage
    # is joined that the sizes and places rule out.
    share = percent / 100
    of_size = F.floor(F.log(F.col("n").cast("double")) / log(CLASS)).cast("int")
    classed = prefix.withColumn("size_class", of_size)
    reach = F.sequence(F.col("size_class"), F.floor(F.log(F.col("n") / share + 1) / log(CLASS)).cast("int"))
    least = F.greatest(F.col("n").cast("double"), F.floor(F.pow(F.lit(CLASS), F.col("partner").cast("double")) - 1))  # of the class, or the row's own size
    looking = classed.withColumn("partner", F.explode(reach)).filter(F.col("place") <= F.col("n") - F.ceil((F.col("n") + least) * percent / (100 + percent) - 1e-6) + 1)
    other = classed.select("shingle", F.col("size_class").alias("partner"), *(F.col(c).alias(f"{c}_2") for c in ("id", "n", "component", "place")))
    differ = (F.col("component") != F.col("component_2")) & (F.col("n") <= F.col("n_2")) & near(F.col("n"), F.col("n_2"))
    # all that a linked pair shares stands at or behind its first common shingle
    enough = F.least(F.col("n") - F.col("place"), F.col("n_2") - F.col("place_2")) + 1 >= F.ceil((F.col("n") + F.col("n_2")) * percent / (100 + percent))
    pairs = looking.join(other, ["shingle", "partner"]).filter(differ & enough)
    return pairs.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, groups: int = GROUPS, rows: int = ROWS, row_column: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, row_key, n_shingles, component_id, kept, kept_row.

    row_key is row_column, a number that tells rows apart, or else one drawn here. kept holds
    where doc_id is the component's; kept_row holds for exactly one row of each component.
    """
    keyed = docs.select("doc_id", "text", (F.col(row_column) if row_column else F.monotonically_increasing_id()).alias("row_key"))
    signed = staged(signatures(keyed, "row_key", width, groups, rows), "signatures")
    usable = signed.filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    classes = staged(usable.groupBy("set_key").agg(first.alias("first")).select("set_key", "first", F.col("first.row_key").alias("id")), "classes")
    # a class is compared by its first row
    reps = usable.join(classes.select("set_key", F.col("id").alias("row_key")), ["set_key", "row_key"], "left_semi")
    posted = reps.select(F.col("row_key").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    here = F.struct("id", "n")
    hubs = posted.groupBy("band").agg(F.min(here).alias("low"), F.max(here).alias("high")).filter("low.id < high.id")
    members = staged(posted.join(hubs.select("band"), "band", "left_semi"), "members")
    hubs = staged(hubs, "hubs")

    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    hub = F.explode(F.array("low", "high"))
    to_hub = members.join(hubs, "band").select("id", "n", hub.alias("hub")).filter((F.col("id") != F.col("hub.id")) & near(F.col("n"), F.col("hub.n")))
    first_pairs = staged(to_hub.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct(), "pairs")
    # sets of the rows in buckets; texts are found by id, equal sets and ids give one row
    in_buckets = staged(members.select("id").distinct().join(classes, "id").select("id", "set_key", F.col("first.doc_id").alias("found_id")), "in_buckets")
    texts = docs.select("doc_id", "text").join(in_buckets.select("found_id").distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("found_id")), "left_semi")
    sets = staged(shingle_sets(texts, width).join(in_buckets.select("id", "set_key"), "set_key").dropDuplicates(["id"]).select("id", "shingles"), "sets")
    links = staged(confirmed(first_pairs, sets, percent), "links")
    labels = components(links)

    chained = staged(_neighbours_in_buckets(_mixed_buckets(members, labels), near).join(first_pairs, ["a", "b"], "left_anti"), "pairs")
    chain_links = staged(confirmed(chained, sets, percent), "links")
    links_2 = staged(links.union(chain_links), "links")
    labels = components(links_2)
    still = staged(_mixed_buckets(members, labels).select("id", "n", "component").distinct(), "still")
    rest = staged(_prefix_pairs(still, sets, percent, near).join(first_pairs.union(chained), ["a", "b"], "left_anti"), "pairs")
    more = staged(confirmed(rest, sets, percent), "links")
    final = components(links_2.union(more))
    labelled = classes.join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labelled.groupBy("component").agg(F.min("first").alias("least"))
    verdict = staged(labelled.join(least, "component").select("set_key", "least"), "verdict")
    # both sides are shuffled here, so that adaptive execution splits a hot set
    out = signed.select("doc_id", "row_key", "n_shingles", "set_key").join(verdict, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    kept_row = (F.col("n_shingles") == 0) | (F.col("row_key") == F.col("least.row_key"))
    result = out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), kept_row.alias("kept_row"))
    for table in (classes, members, hubs, in_buckets, still, sets, first_pairs, chained, rest, chain_links, links, links_2, more):
        unstage(table)
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("kept_row")))
