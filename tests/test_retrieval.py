"""Searches against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import containment, dense, sparse
from tessera.operators.dense import dense_topk
from tessera.operators.containment import candidates, containing, gram_codes, reached
from tessera.operators.overlap import overlap_topk
from tessera.operators.postings import PostingsIndex
from tessera.operators.vector_index import VectorIndex
from tessera.plans import registry, retrieval
from tessera.shared import scratch

registry.load()


def pairs(frame):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in frame.collect())


def test_stored_index_gives_what_a_search_of_everything_gives(spark):
    path = "/root/testdata/sf0.1"
    vectors, queries = retrieval.vectors(spark, path), retrieval.vector_queries(spark, path)
    folder = scratch(spark, "ivf")
    VectorIndex.build(vectors, folder)
    index = VectorIndex(spark, folder)  # as another session opens it
    exact = pairs(dense_topk(queries, vectors, 5))
    assert pairs(index.search(queries, 5)) == exact
    assert pairs(index.search(queries, 5, first=1)) == exact
    # these vectors lie evenly on a sphere, where no bound helps: three in four cells give nine in ten neighbours
    some = pairs(index.search(queries, 5, probes=len(index.centres) * 3 // 4))
    assert len({(q, i) for q, _, i, _ in some} & {(q, i) for q, _, i, _ in exact}) >= 0.9 * len(exact)


def test_stored_index_reads_and_scores_the_cells_that_matter(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 4
    rows = [(i, (centres[i % 30] + rng.normal(size=16) / 4).tolist()) for i in range(3_000)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)
    queries = vectors.filter("id % 50 = 0").selectExpr("id as query_id", "vec as query_vec")
    index = VectorIndex.build(vectors, scratch(spark, "ivf"))
    assert pairs(index.search(queries, 5)) == pairs(dense_topk(queries, vectors, 5))
    assert 0 < index.scored < 60 * 3_000 / 3
    plan = index.packs().filter(F.col("cell").isin(1, 2))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    assert index.cells().agg(F.sum("n")).first()[0] == 3_000


def test_stored_index_grows_and_keeps_odd_vectors(spark):
    rows = [(i, [float(i % 7), float(i % 5), float(i // 40)]) for i in range(200)]
    odd = [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 0.0]), (205, [0.0, 0.0, 0.0]), (206, [3.0, -1.0]), (None, [9.0, 9.0, 9.0])]
    kind = "id long, vec array<float>"
    old, new = spark.createDataFrame(rows[:120], kind), spark.createDataFrame(rows[120:] + odd, kind)
    index = VectorIndex.build(old, scratch(spark, "ivf"), cells=9)
    index.append(new)
    both = old.union(new)
    queries = both.filter("id % 20 = 0 or id > 200").selectExpr("id as query_id", "transform(vec, x -> -x) as query_vec")
    assert pairs(index.search(queries, 5, first=1)) == pairs(dense_topk(queries, both, 5))
    assert index.search(queries.limit(0), 5).count() == 0
    empty = VectorIndex.build(old.limit(0), scratch(spark, "ivf"))
    assert empty.search(queries, 5).count() == 0
    empty.append(new.filter("id > 200"))
    assert pairs(empty.search(queries, 5)) == pairs(dense_topk(queries, new.filter("id > 200"), 5))


@pytest.mark.parametrize("values, scores, broadcast", [(500_000, 4_000_000, "10m"), (9, 8, "10m"), (9, 8, "-1")])
def test_dense_search_equals_brute_force(spark, monkeypatch, values, scores, broadcast):
    """Ties, repeated, null, ragged and broken vectors; packs and products of any size, broadcast or not."""
    monkeypatch.setattr(dense, "PACK_VALUES", values)
    monkeypatch.setattr(dense, "SCORES", scores)
    monkeypatch.setattr(dense, "HELD", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rows = [(i, [float(i % 7), float(i % 5), float(i // 40) / 3]) for i in range(100)]
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 0.0]), (205, [0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    asked = [(i, v) for i, v in rows if i is not None and (i % 20 == 0 or i > 200)]
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)]
    want = []
    for q, a in asked:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if len(b) == len(a)) if (q, a) in good else []
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:5])]
    queries = spark.createDataFrame(asked, "query_id long, query_vec array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in dense_topk(queries, vectors, 5).collect())
    assert got == sorted(want)
    assert dense_topk(queries.limit(0), vectors, 5).count() == 0
    assert dense_topk(queries, vectors.limit(0), 5).count() == 0
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows, hits, batch", [(1_000_000, 200_000, 10_000), (4, 3, 2)])
def test_sparse_search_equals_brute_force(spark, monkeypatch, rows, hits, batch):
    """Ties, repeated, null and empty texts, frequent and unknown terms; blocks of any size."""
    monkeypatch.setattr(sparse, "BLOCK_ROWS", rows)
    monkeypatch.setattr(sparse, "HITS", hits)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    words = ["the", "stone", "mine", "été", "Ore", "ab", "drill", "vein"]
    docs = [(i, " ".join(["the"] + [words[(i * j + j) % 8] for j in range(i % 6)])) for i in range(60)] + [(90, None), (91, ""), (92, "the " * 50), (None, "stone mine")]
    asked = [(1, "the stone"), (2, "mine mine ore"), (3, None), (4, "unknown"), (5, "the"), (6, "été drill vein drill")]
    terms = lambda t: Counter(re.findall("[a-zà-ÿ]{3,}", (t or "").lower()))
    df = Counter(w for _, t in docs for w in terms(t))
    want = []
    for q, a in asked:
        mine = terms(a)
        scores = [(-round(sum(n * tf[w] * math.log1p(len(docs) / df[w]) for w, n in mine.items() if w in tf), 6), i) for i, tf in ((i, terms(t)) for i, t in docs) if i is not None]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(x for x in scores if x[0])[:5])]
    queries, table = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "id long, text string").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in sparse.sparse_topk(queries, table, 5).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want)
    assert sparse.sparse_topk(queries.limit(0), table, 5).count() == 0
    assert sparse.sparse_topk(queries, table.limit(0), 5).count() == 0


def test_sparse_search_sums_few_pairs_and_loses_no_hit():
    rng, k = np.random.default_rng(2), 5
    docs = [rng.zipf(1.3, rng.integers(0, 20) if i % 50 else 2_000) % 500 for i in range(2_000)]
    rows = [(q, f"t{t}", float(n * (1 + t % 7))) for q in range(40) for t, n in Counter((rng.zipf(1.3, 60) % 500).tolist()).items()]
    block = sparse.Block(pa.table({"query_id": [r[0] for r in rows], "term": [r[1] for r in rows], "weight": [r[2] for r in rows]}))
    place = {t: i for i, t in enumerate(block.terms.to_pylist())}
    codes = [np.array([place[f"t{t}"] for t in d if f"t{t}" in place], np.int64) for d in docs]
    top = dense.Top(40, k)
    assert sparse.best_hits(block, top, np.arange(2_000), codes, 6) < 0.2 * 40 * 2_000
    weights = np.zeros((40, len(place)))
    for q, t, w in rows:
        weights[block.ids.index(q), place[t]] = w
    sums = np.stack([weights @ np.bincount(c, minlength=len(place)) for c in codes], 1)
    want = [(q, i) for q in range(40) for i in sorted(range(2_000), key=lambda i: (-sums[q, i], i))[:k]]
    assert list(zip(top.query.tolist(), top.id.tolist())) == want


@pytest.mark.parametrize("rows", [3_000_000, 2_000])
def test_sparse_search_asks_the_longest_first_and_cuts_texts_once(spark, monkeypatch, rows):
    docs = retrieval.texts(spark, "/root/testdata/sf0.01")
    queries = docs.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    want = pairs(sparse.sparse_topk(queries, docs, 20))
    monkeypatch.setattr(sparse, "BLOCK_ROWS", rows)
    monkeypatch.setattr(sparse, "PAIRS", 1)
    monkeypatch.setattr(sparse, "LONGEST", 50)
    cut, words = [], sparse.words
    monkeypatch.setattr(sparse, "words", lambda *a: cut.append(a) or words(*a))
    assert pairs(sparse.sparse_topk(queries, docs, 20)) == want
    assert len(cut) == 2  # queries and documents


def test_stored_postings_give_what_a_scan_gives(spark):
    path = "/root/testdata/sf0.01"
    docs, queries = retrieval.texts(spark, path), retrieval.items(spark, path)
    folder = scratch(spark, "postings")
    PostingsIndex.build(docs, folder, block_docs=16)
    index = PostingsIndex(spark, folder)
    assert pairs(index.search(queries, 5)) == pairs(sparse.sparse_topk(queries, docs, 5))
    assert 0 < index.scored < index.blocks / 2
    plan = index.postings().filter("folder = 3 and term = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(term,x)" in plan


def test_stored_postings_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "the " * (i % 6) + "stone vein " * (i % 4)) for i in range(60)] + [(90, None), (91, ""), (92, "the " * 50), (None, "stone mine")], "id long, text string")
    queries = spark.createDataFrame([(1, "the stone"), (2, "mine mine"), (3, None), (4, "unknown"), (5, "the")], "query_id long, text string")
    index = PostingsIndex.build(docs, scratch(spark, "postings"), block_docs=4)
    for first in (1, 4):
        assert pairs(index.search(queries, 5, first=first)) == pairs(sparse.sparse_topk(queries, docs, 5))
    assert index.search(queries.limit(0), 5).count() == 0
    assert PostingsIndex.build(docs.limit(0), scratch(spark, "postings")).search(queries, 5).count() == 0


def bigrams(text):
    bare = "".join((text or "").split())
    return {bare[i : i + 2] for i in range(len(bare) - 1)} or ({bare} if bare else set())


@pytest.mark.parametrize("block", [7, 4_096])
def test_overlap_with_all_documents(spark, block):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    items = spark.read.parquet(f"{path}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    queries = items.union(spark.createDataFrame([(-1, "short"), (-2, ""), (-3, None), (-4, "x")], items.schema))
    sets = [(r.id, bigrams(r.text)) for r in docs.collect()]
    want = []
    for r in queries.collect():
        own = bigrams(r.text)
        scores = sorted((-len(own & b) / len(own), i) for i, b in sets if own & b)
        want += [(r.query_id, rank, i, -score) for rank, (score, i) in enumerate(scores[:3], 1)]
    got = overlap_topk(queries, docs, block=block).select("query_id", "rank", "id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_documents_that_contain_a_text(spark, most):
    docs = spark.createDataFrame([(1, "one two three"), (2, "onetwo"), (3, None), (4, "x"), (5, "two three one two"), (5, "one two"), (None, "one two")], "id long, text string")
    queries = spark.createDataFrame([(10, "one two"), (11, "x"), (12, ""), (13, "two three"), (14, None), (15, "nowhere at all")], "query_id long, text string")
    got = sorted(map(tuple, containing(queries, docs, most=most).collect()))
    assert got == [(10, 1), (10, 5), (10, 5), (11, 4), (13, 1), (13, 5)]
    assert containing(queries.limit(0), docs).count() == containing(queries, docs.limit(0)).count() == 0


def test_containment_compares_few_pairs(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    asked = docs.filter("id % 10 = 0 and text <> ''").select(F.col("id").alias("query_id"), F.substring("text", 40, 60).alias("text")).filter("text <> ''")
    texts = [(r.id, r.text or "") for r in docs.collect()]
    want = sorted((q, i) for q, t in map(tuple, asked.collect()) for i, text in texts if t in text)
    assert sorted(map(tuple, containing(asked, docs).collect())) == want
    pairs = candidates(asked, docs).count()
    assert len(want) <= pairs <= 2 * len(want) < asked.count() * len(texts) / 50


def test_codes_of_a_batch_are_sent_on_in_parts(spark, monkeypatch):
    tasks = []
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "id long, text string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: tasks.append(f))
    monkeypatch.setattr(containment, "PART_CODES", 1_000, raising=False)
    letters = np.random.default_rng(5).integers(97, 123, (59, 400), dtype=np.uint8)
    texts = [row.tobytes().decode() for row in letters] + ["short"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    codes = [gram_codes(t, 8) for t in texts]
    known = np.unique(np.concatenate(codes))
    containment._document_codes(rows, [8], known)
    containment._document_codes(rows, [8], None)
    containment._query_codes(rows.withColumnRenamed("id", "query_id"), 8)
    want = [(i, c) for i, own in enumerate(codes) for c in own]
    for task, more in zip(tasks, ([], [], [(59, gram_codes("short", 5)[0])])):
        got = list(task(iter([batch, batch.slice(0, 0)])))
        assert max(part.num_rows for part in got) < 1_000 + 400 < len(want)
        assert [(r[0].as_py(), r[-1].as_py()) for part in got for r in zip(*part.columns)] == want + more


@pytest.mark.parametrize("likely", [64, 1])
def test_queries_that_some_document_reaches(spark, likely):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    items = spark.read.parquet(f"{path}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    queries = items.union(spark.createDataFrame([(-1, "QXZJ"), (-2, ""), (-3, None)], items.schema))
    want = sorted(r.query_id for r in overlap_topk(queries, docs, 1).filter("score >= 0.5").collect())
    assert sorted(r.query_id for r in reached(queries, docs, 0.5, likely=likely).collect()) == want


def test_pruning_shuffles_texts_by_id_and_no_row_per_word(spark):
    from tessera.operators import retrieval as rt

    docs = spark.createDataFrame([(i, f"alpha beta{chr(97 + i)} gamma gamma delta") for i in range(9)], "doc_id long, text string")
    pruned = rt.sparse_prune(rt.tf_idf(rt.term_weights(docs), docs.groupBy().count().withColumnRenamed("count", "n")))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1 and "hashpartitioning(term" not in plan and "hashpartitioning(id" in plan
    assert {r.id: r.n for r in pruned.groupBy("id").agg(F.count("*").alias("n")).collect()} == {i: 3 for i in range(9)}
