"""The pipeline against the operators applied one by one, and each stage's own promises."""

import corpus_pipeline
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm.test_operators import brute_near


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
    texts = [" ".join(r.text.split()) for r in seen["exact_dedup"]]
    assert len(set(texts)) == len(texts) and set(texts) == {" ".join(r.text.split()) for r in seen["toxicity"]}
    before = sorted(seen["exact_dedup"], key=lambda r: r.doc_id)
    kept = [before[i].doc_id for i, _, c in brute_near([r.text for r in before], 5, 80) if i == c]
    assert sorted(r.doc_id for r in seen["near_dedup"]) == kept
    times = {}
    for r in seen["mixing"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= set(kept) and set(times.values()) <= {1, 2}
    assert len(seen["bpe"]) == len(seen["mixing"])
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(seen["bpe"])


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "en", "x", 5), (None, "a b c", "en", "x", 5), (7, "d e", "en", None, 3), (7, "d f", None, "x", 3), (8, None, "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_copies(spark, docs, SF)
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "a b c", "d e", "d f"]
    mixed = [r.text for r in corpus_pipeline.mix_sources(spark, kept, SF).collect()]
    assert set(mixed) == {"a b c", "d e", "d f"} and all(mixed.count(t) <= 2 for t in mixed)
    assert corpus_pipeline.encode(spark, docs, SF).count() == 5


def test_clashing_names_empty_tables_and_long_texts(spark):
    columns = "row_number row_number_ times turn score kept component_id taken size key".split()
    rows = [(3, "a b c d e f"), (7, "a b c d e f g h i j k l m n"), (7, "x y z u v w"), (9, "a b c d e f g h i j k l m n"), (11, "long " * 300_000), (12, None), (13, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in columns:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    empty = docs.limit(0)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = corpus_pipeline.staged(stage(spark, empty, SF), name)
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert empty.count() == 0 and empty.columns == names == docs.columns
        assert all(r[c] == f"own {c}" for r in docs.collect() for c in columns)
        if name == "near_dedup":
            assert sorted(r.doc_id for r in docs.collect()) == [3, 7, 7, 11, 12]
    assert corpus_pipeline.encode(spark, empty, SF).count() == 0
    assert {r.doc_id for r in corpus_pipeline.encode(spark, docs, SF).collect()} <= {3, 7, 11}


def test_only_the_last_stages_input_is_left(spark, monkeypatch):
    from pathlib import Path
    from tempfile import mkdtemp

    from tessera.llm import common

    folder = mkdtemp(prefix="spark-left-")
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{folder}")
    monkeypatch.setattr("tessera.llm.exact_dedup.shared_dir", lambda spark: f"file://{folder}")
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0
    assert sorted(p.name.split("-")[1] for p in Path(folder).iterdir()) == ["mixing", "sized"] or [p.name.split("-")[1] for p in Path(folder).iterdir()] == ["mixing"]


def test_numbers_of_rows_are_places_in_files(spark, tmp_path):
    from tessera.llm.common import numbered

    path = f"file://{tmp_path}/docs"
    spark.range(1000, numPartitions=5).selectExpr("id as doc_id", "'x' as row_number").write.parquet(path)
    rows, name = numbered(spark.read.parquet(path))
    assert name == "row_number_" and rows.inputFiles() and rows.select(name).distinct().count() == 1000
    again = {r.doc_id: r[name] for r in numbered(spark.read.parquet(path))[0].select(name, "doc_id").collect()}
    assert again == {r.doc_id: r[name] for r in rows.repartition(3).collect()}
    twice, name = numbered(spark.read.parquet(path).union(spark.read.parquet(path)))
    assert twice.select(name).distinct().count() == 2000
