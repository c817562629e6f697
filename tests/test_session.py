from tessera.session import spread, table
from tests.conftest import SF


def test_spread_deals_small_tables_of_some_parts(spark, monkeypatch):
    import tessera.session as s

    rows = table(spark, SF, "documents")
    want = sorted(r[0] for r in rows.select("doc_id").collect())
    assert sorted(r[0] for r in spread(spark, SF, "documents").select("doc_id").collect()) == want
    monkeypatch.setattr(s, "PART", 16)  # many parts: capped by the cores
    dealt = spread(spark, SF, "documents")
    assert dealt.columns == rows.columns
    assert sorted(r[0] for r in dealt.select("doc_id").collect()) == want
    assert dealt.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(s, "SMALL", 1)  # a large table is read as it lies
    assert "Exchange" not in spread(spark, SF, "documents")._jdf.queryExecution().toString()


def test_spread_keeps_pruning_and_pushed_filters(spark, monkeypatch):
    import tessera.session as s

    monkeypatch.setattr(s, "PART", 16)
    plan = spread(spark, SF, "documents").filter("doc_id > 5").select("text")._jdf.queryExecution().toString()
    assert "GreaterThan(doc_id,5)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_spread_deals_large_tables_of_one_row_group(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pa.table({"id": range(70), "text": [os.urandom(1_000_000) for _ in range(70)]})
    pq.write_table(rows, tmp_path / "one.parquet", compression="none", use_dictionary=False)
    pq.write_table(rows, tmp_path / "many.parquet", compression="none", use_dictionary=False, row_group_size=1)
    dealt = spread(spark, str(tmp_path), "one")
    assert dealt.rdd.getNumPartitions() == 9 and sorted(r.id for r in dealt.select("id").collect()) == list(range(70))
    assert "Exchange" not in spread(spark, str(tmp_path), "many")._jdf.queryExecution().toString()
