"""The columnar record in parts."""

from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.sources import daily, files
from tessera.streaming import jobs
from tests.conftest import SF


def test_parts_hold_whole_texts_in_order(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    shaped = rows.select("quality", "doc_id", F.col("text").alias("question"), F.col("source").alias("answer"), F.array("source").alias("contexts"), F.col("lang").alias("ground_truth"))
    parts = ingest.ragas_parts(shaped, "quality", "doc_id", F.floor(F.col("doc_id") / 16), 7).orderBy("quality", "part").collect()
    assert len(parts) > 2 and all(p.n == len(p.question) <= 7 for p in parts)
    got = [(p.quality, *r) for p in parts for r in zip(p.question, p.answer, p.ground_truth)]
    assert got == [(r.quality, r.text, r.source, r.lang) for r in rows.orderBy("quality", "doc_id").collect()]


def test_json_arrays_of_many_files(spark, tmp_path):
    rows = spark.range(1000, numPartitions=7).select("id", F.concat(F.lit("t"), "id").alias("text"))
    path = f"file://{tmp_path}/arrays"
    files.write_json_arrays(rows, path, "id", 100)
    back = files.read_json_arrays(spark, path, "id long, text string")
    assert sorted(back.collect()) == sorted(rows.collect())
    files.write_json_arrays(rows.limit(0), f"{path}-none", "id")
    assert files.read_json_arrays(spark, f"{path}-none", "id long, text string").count() == 0


def test_sessions_of_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"session_id": "1",\n "history": [{"question": "q1", "answer": "a1"}, {"question": "q2", "answer": null}]}')
    (tmp_path / "b.json").write_text('[{"session_id": "2", "history": [{"question": "q3", "answer": "a3"}]}, {"session_id": "3", "history": []}]')
    (tmp_path / "c.json").write_text('{"session_id": "4", "history": [')
    got = sorted(tuple(r) for r in files.read_sessions(spark, f"file://{tmp_path}").collect())
    assert got == [("1", 0, "q1", "a1"), ("1", 1, "q2", None), ("2", 0, "q3", "a3")]


def test_upserts_follow_the_batches(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    write = jobs.append_batches(path)
    columns = "text string, source string, pos long"
    first = spark.createDataFrame([("a", "s1", 9), ("b", "", 2), ("b", "s2", 3)], columns)
    second = spark.createDataFrame([("a", "s3", 1), ("c", None, 4)], columns)
    for batch, n in ((first, 0), (second, 1), (second, 1)):
        write(batch, n)
    want = [("a", "s3", 1), ("b", "s2", 3), ("c", "unknown", 4)]
    read = lambda p: sorted(tuple(r) for r in jobs.chunk_table(spark, p).select("text", "source", "pos").collect())
    assert read(path) == want
    jobs.compact(spark, path, f"{path}-compact")
    assert read(f"{path}-compact") == want
    jobs.append_batches(f"{path}-compact")(spark.createDataFrame([("b", "s9", 0)], columns), 2)
    assert read(f"{path}-compact") == [("a", "s3", 1), ("b", "s9", 0), ("c", "unknown", 4)]


def test_good_and_quarantined_lines_add_up(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    lines = ['{"id": 1, "text": "a"}', '{"id": 2, "text": "b"', "", "null", '{"id": "three", "text": "c"}', "[]", '{"id": 4}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good, bad = files.read_json_lines_checked(spark, path, "id long, text string")
    assert sorted((r.id, r.text) for r in good.collect()) == [(1, "a"), (4, None)]
    assert good.count() + bad.count() == len(lines)
    assert '{"id": 2, "text": "b"' in {r.line for r in bad.collect()} and bad.columns == ["file_path", "line", "reason"]
    named = spark.createDataFrame([("a.pdf", ".pdf"), ("b", ""), ("c", None), ("d.exe", ".exe")], "name string, extension string")
    taken, left = files.loadable(named, F.col("extension"))
    assert [r.loader for r in taken.collect()] == ["pdf"] and sorted(r.name for r in left.collect()) == ["b", "c", "d.exe"]


def test_caches_are_read_or_corrupt(spark):
    rows = [(1, '{"file_size": 3, "file_mtime": 5}'), (2, '{"file_size": 3, "file_mti'), (3, "{}"), (4, None), (5, '{"file_size": 9, "file_mtime": 5}'), (6, "x"), (7, '{"file_size": 3, "file_mtime": 5}')]
    cache, corrupt = ingest.parsed_cache(spark.createDataFrame(rows, "file_id long, content string"))
    assert cache.count() + corrupt.count() == len(rows)
    manifest = spark.createDataFrame([(i, 3, 5) for i in range(1, 6)], "file_id long, size_bytes long, mtime long")
    assert sorted(map(tuple, ingest.cache_gc(manifest, cache, corrupt).collect())) == [(2, "corrupt"), (3, "corrupt"), (4, "corrupt"), (5, "stale"), (6, "orphan"), (7, "orphan")]
    assert ingest.cache_gc(manifest, cache, corrupt, clean_all=True).count() == len(rows)


def test_a_day_written_again_replaces_that_day_only(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    rows = spark.range(1000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id % 72) as ts", "'old' as state").withColumn("ts", F.when(F.col("id") != 999, F.col("ts")))
    daily.write_days(rows, path)
    daily.write_days(rows.filter("to_date(ts) = '2024-01-02' and id < 500").withColumn("state", F.lit("new")), path)
    back = daily.read_days(spark, path, "id long, ts timestamp_ntz, state string")
    want = rows.selectExpr("to_date(ts) as day", "id", "state").filter("day is null or day <> '2024-01-02'").collect()
    new = [r for r in back.filter("day = '2024-01-02'").collect()]
    assert {r.state for r in new} == {"new"} and len(new) == rows.filter("to_date(ts) = '2024-01-02' and id < 500").count()
    assert sorted((str(r.day), r.id, r.state) for r in back.filter("day is null or day <> '2024-01-02'").collect()) == sorted((str(r.day), r.id, r.state) for r in want)
    plan = daily.read_days(spark, path, "id long, ts timestamp_ntz, state string", "2024-01-03", "2024-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_corpus_of_many_documents_a_file_comes_back_whole(spark, tmp_path):
    from tessera.sources import files

    texts = ["a\nb", "", "x\u0003y", "\u00103\u0010\u0003\u0010", "e\r\n ", "\u00100"] * 50
    rows = spark.createDataFrame([(t, f"s{i % 3}_data") for i, t in enumerate(texts)], "text string, folder string").repartition(2)
    files.write_corpus(rows, str(tmp_path / "c"))
    found = files.corpus_scan(spark, str(tmp_path / "c"), packed=True)
    assert sorted(r.text for r in found.collect()) == sorted(texts)
    assert len(found.inputFiles()) <= 6 and {r.source for r in found.select("source").collect()} == {f"folder=s{i}" for i in range(3)}
